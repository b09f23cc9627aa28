from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}$"

STRICT_FORMATS = ("yyyy-MM-dd",)
RECOVERING_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy")

#: Forms in which day and month may stand in either order, the usual order first.
_EITHER_ORDER = (("M/d/yyyy", "d/M/yyyy"), ("d-M-yyyy", "M-d-yyyy"), ("d.M.yyyy", "M.d.yyyy"))
_EITHER_ORDER += tuple((one.replace("yyyy", "yy"), two.replace("yyyy", "yy")) for one, two in _EITHER_ORDER)
#: Two digits mean a year from 1969 to 2068.
_FIRST_LATE_YEAR = 2069
_OTHER_FORMS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")
#: Forms of fixed width that a cast reads once its separators are hyphens.
_CAST = ("yyyy-MM-dd", "yyyy/MM/dd")
#: A time of day behind a date, which is cut off.
_TIME = r"([T ]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?( ?[AaPp][Mm])?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?)?"


def _shape(pattern: str) -> str:
    """What a text must look like to be read by a date pattern."""

    def field(found: re.Match) -> str:
        letter, width = found.group()[0], len(found.group())
        if letter == "M" and width >= 3:
            return "[A-Za-z]{3,}"
        return rf"\d{{{width}}}" if width > 1 else r"\d{1,2}"

    literal = "".join(part if part.isalnum() else re.escape(part) for part in re.split(r"([^A-Za-z0-9])", pattern))
    return re.sub(r"y+|M+|d+", field, literal)


def _is_plain(text: Column, pattern: str) -> Column:
    """A cheap look at a text of ten characters: where this holds and a cast reads a date, the text has the pattern's shape."""
    ends = [F.substring(text, at, 1) == pattern[4] for at in (5, 8)]
    return (F.length(text) == 10) & ends[0] & ends[1] & F.substring(text, 10, 1).between("0", "9")


def _apart(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work`` of a value by a lambda, which stays out of the generated code: the JVM leaves methods of over 8,000 bytes uncompiled."""
    return F.get(F.transform(F.array(value), work), F.lit(0))


def _plain_day(text: Column, pattern: str) -> Column:
    """The day of a text that is all in a fixed form; NULL says nothing."""
    digits = text if pattern[4] == "-" else F.replace(text, F.lit(pattern[4]), F.lit("-"))
    return F.when(_is_plain(text, pattern) & ~text.startswith("0000"), digits.try_cast("date"))


def parse_date(text: Column, formats: Sequence[str] = RECOVERING_FORMATS, with_time: bool = False) -> Column:
    """First format that fits, as DATE; NULL when none does. ``with_time`` allows a time of day behind it."""
    if len(formats) > 2 and formats[0] in _CAST:
        return F.coalesce(_plain_day(text, formats[0]), _apart(text, lambda t: _first_fit(t, formats, with_time)))
    return _first_fit(text, formats, with_time)


def _first_fit(text: Column, formats: Sequence[str], with_time: bool) -> Column:
    attempts = []
    for f in formats:
        shape = _shape(f)
        fits = text.rlike(f"^{shape}{_TIME if with_time else ''}$")
        if f in _CAST:  # a cast is many times faster than a formatter; only it knows a year 0
            digits = F.translate(F.substring(text, 1, 10), "/", "-")
            day = F.when(~digits.startswith("0000"), digits.try_cast("date"))
            fits = _is_plain(text, f) | fits
        else:
            day = F.try_to_date(F.regexp_extract(text, f"^({shape})", 1) if with_time else text, f)
        if re.fullmatch(r".*[^y]yy", f):
            day = F.when(F.year(day) >= _FIRST_LATE_YEAR, F.add_months(day, -1200)).otherwise(day)
        attempts.append(F.when(fits, day))
    return F.coalesce(*attempts)


@dataclass(frozen=True)
class DateReading:
    """The forms in which a column's texts are read as dates, and how many values are read and lost."""

    formats: tuple[str, ...]
    read: int
    lost: int


def date_reading(df: DataFrame, column: str) -> DateReading:
    """Formats for a text column, decided from all its values in one pass.

    Where day and month may be swapped, the order that reads more of the
    column's values comes first, on a tie the usual one for that form; the other
    reads what only it can, as a 25th month.
    """
    # No form in which the order is open begins with four digits.
    text = F.trim(F.col(f"`{column}`").cast("string"))
    orders = [f for pair in _EITHER_ORDER for f in pair]

    def readings(t: Column) -> Column:
        """Whether each open order reads a text, and whether any form does."""
        year_first = t.rlike(r"^\d{4}")
        read = [~year_first & _first_fit(t, [f], True).isNotNull() for f in orders]
        return F.array(*read, _first_fit(t, (*RECOVERING_FORMATS[:2], *orders, *_OTHER_FORMS), True).isNotNull())

    texts = df.select(text.alias("text")).select("text", _plain_day(F.col("text"), "yyyy-MM-dd").isNotNull().alias("plain"))
    texts = texts.select("text", "plain", F.when(~F.col("plain"), _apart(F.col("text"), readings)).alias("readings"))
    counts = [F.count_if(F.get("readings", F.lit(i))) for i in range(len(orders) + 1)]
    found = texts.agg(*[c.alias(f"n{i}") for i, c in enumerate([*counts, F.count_if("plain"), F.count("text")])]).first()
    *by_order, read, plain, values = found
    read += plain
    counted = dict(zip(orders, by_order))
    chosen = [(usual, other) if counted[usual] >= counted[other] else (other, usual) for usual, other in _EITHER_ORDER]
    return DateReading((*RECOVERING_FORMATS[:2], *[f for pair in chosen for f in pair], *_OTHER_FORMS), read, values - read)


def formats_of(df: DataFrame, column: str) -> tuple[str, ...]:
    return date_reading(df, column).formats


def is_typed_date(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.DatetimeType)


def day_of(df: DataFrame, column: str) -> Column:
    """The day of a DATE or TIMESTAMP column as it is, or of well-formed yyyy-MM-dd texts; else NULL."""
    value = F.col(f"`{column}`")
    return value.cast("date") if is_typed_date(df, column) else iso_date(value)


def iso_date(text: Column) -> Column:
    """DATE for a well-formed, existing yyyy-MM-dd day, else NULL."""
    return parse_date(text, STRICT_FORMATS)


def is_iso_date(text: Column) -> Column:
    return iso_date(text).isNotNull()


def date_key(day: Column) -> Column:
    """yyyymmdd as INT."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def is_date_column(name: str) -> bool:
    return "date" in name.lower() or "time" in name.lower()
