"""Recommended cleaning rules and their application."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ledgerlake.functions.dates import STRICT_FORMATS, DateReading, date_reading, is_date_column, is_typed_date, parse_date
from ledgerlake.operators.duplicates import first_copies
from ledgerlake.operators.fills import forward_then_backward
from ledgerlake.operators.frequencies import nan_as_null, numeric_columns
from ledgerlake.operators.heavy import modes_of
from ledgerlake.operators.profile import Profile
from ledgerlake.operators.quality import consistency
from ledgerlake.operators.selection import exact_quantiles
from ledgerlake.staging import stage, together

RULE_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("default_value", T.BooleanType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Rule:
    type: str
    column: str | None = None
    message: str = ""
    severity: str = "medium"
    default_value: bool = True
    parameters: dict = field(default_factory=dict)

    def as_row(self) -> Row:
        return Row(**{n: getattr(self, n) for n in RULE_SCHEMA.names})

    @property
    def method(self) -> str:
        return self.parameters.get("method", "median")


def _rules_frame(source: DataFrame, *columns: Column) -> DataFrame:
    return source.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, RULE_SCHEMA.fields)])


def recommend_rules(profile: Profile, formats: Sequence[str] = STRICT_FORMATS) -> DataFrame:
    """Rules worth applying: (ord, type, column, message, severity, default_value, parameters)."""
    profile.require_rows()
    spark = profile.source.sparkSession
    order = {c: i for i, c in enumerate(profile.source.columns)}
    no_parameters = F.create_map().cast("map<string,string>")

    copies = profile.duplicates
    duplicates = spark.range(1).filter(F.lit(copies) > 0)
    rules = _rules_frame(
        duplicates,
        F.lit("remove_duplicates"),
        F.lit(None),
        F.format_string("%d duplicate rows detected. Remove them?", F.lit(copies)),
        F.lit("medium"),
        F.lit(True),
        no_parameters,
    ).withColumn("ord", F.lit(0))

    method = F.when(F.col("column").isin(profile.numeric), "median").otherwise("mode")
    missing = [(c, profile.row_count - n) for c, n in profile.value_counts.items() if n < profile.row_count]
    gaps = spark.createDataFrame(missing, "column string, null_count long")
    fills = _rules_frame(
        gaps,
        F.lit("fill_nulls"),
        F.col("column"),
        F.format_string("%d missing values in '%s'. Fill with %s?", "null_count", "column", method),
        F.lit("high"),
        F.lit(True),
        F.create_map(F.lit("method"), method),
    )
    position = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    rules = rules.unionByName(fills.withColumn("ord", F.lit(1) + position[F.col("column")]))

    dated = [c for c in profile.source.columns if is_date_column(c)]
    if dated:
        uneven = consistency(profile, formats).filter("score < 100")
        dates = _rules_frame(
            uneven,
            F.lit("standardize_dates"),
            F.lit(dated[0]),
            F.lit(f"Inconsistent date format found in '{dated[0]}'. Standardize to YYYY-MM-DD?"),
            F.lit("high"),
            F.lit(True),
            no_parameters,
        )
        rules = rules.unionByName(dates.withColumn("ord", F.lit(1 + len(order))))
    return rules.select("ord", *RULE_SCHEMA.names)


def rules_list(rules: DataFrame) -> list[Rule]:
    """The recommended rules in order; at most one per column and two more."""
    rows = rules.orderBy("ord").collect()
    return [Rule(**{n: r[n] for n in RULE_SCHEMA.names}) for r in rows]


def keep_first(df: DataFrame, position: str) -> DataFrame:
    """Drop rows equal to an earlier one in everything but the position."""
    return first_copies(df, position).select(*[F.col(f"`{c}`") for c in df.columns])


def remove_duplicates(df: DataFrame, position: str) -> tuple[DataFrame, int]:
    """The first copies, written, and how many rows went.

    The number is the sum of a column that is written along, which costs a look
    at that column only. (``observe`` would count in the write itself, but in a
    session that has observed anything, Spark 4.1 can no longer send out a
    classifier's ``transform``.)
    """
    written = stage(first_copies(df, position, "_dropped"), "deduplicated")
    gone = written.agg(F.sum("_dropped").alias("rows")).first()["rows"] or 0
    return written.drop("_dropped"), gone


def standardize_dates(
    df: DataFrame, column: str, position: str, formats: Sequence[str] | None = None, unread: str = "fill"
) -> tuple[DataFrame, str]:
    """Dates rewritten as yyyy-MM-dd, and a log line that says what could not be read.

    Typed columns only change their form. Without ``formats`` all usual ones are
    read, day or month first as fits the column. A column of which more would be
    lost than is read stays as it is. What cannot be read and is no gap

    * ``fill``: takes a neighbour's date, as all gaps do then;
    * ``keep``: stays as it is, and gaps take a neighbour's date;
    * ``null``: becomes a gap, and gaps stay.
    """
    if unread not in ("fill", "keep", "null"):
        raise ValueError(f"unread texts can be filled, kept or nulled, not {unread!r}")
    value = F.col(f"`{column}`")
    done = f"Standardized date formatting in '{column}' to YYYY-MM-DD."
    if is_typed_date(df, column):
        return df.withColumn(column, F.date_format(value, "yyyy-MM-dd")), done
    text = F.trim(value.cast("string"))
    if formats:
        day = parse_date(text, formats)
        found = DateReading(tuple(formats), *df.agg(F.count(day), F.count_if(day.isNull() & value.isNotNull())).first())
    else:
        found = date_reading(df, column)
        day = parse_date(text, found.formats, with_time=True)
    if found.lost > found.read:
        return df, f"Left '{column}' as it is: only {found.read} of {found.read + found.lost} values are dates."
    parsed = df.withColumns({"_day": day, "_unread": day.isNull() & value.isNotNull()})
    if found.lost:
        fate = {"fill": "took a neighbour's date", "keep": "stayed as they are", "null": "became null"}[unread]
        done = f"{done} {found.lost} values could not be read and {fate}."
        if unread != "null":
            parsed = forward_then_backward(parsed, "_day", position)
    text = F.date_format("_day", "yyyy-MM-dd")
    if unread == "keep":
        text = F.when(F.col("_unread"), value.cast("string")).otherwise(text)
    return parsed.withColumn(column, text).select(*[F.col(f"`{c}`") for c in df.columns]), done


def fill_values(df: DataFrame, fills: Sequence[Rule]) -> dict[str, object]:
    """The value each rule would put in place of nulls: one scalar per column."""
    numeric = set(numeric_columns(df))
    by_median = [r.column for r in fills if r.method not in ("mean", "mode") and r.column in numeric]
    by_mean = [r.column for r in fills if r.method == "mean" and r.column in numeric]
    by_mode = [r.column for r in fills if r.column not in by_median + by_mean]
    values: dict[str, object] = {}
    if by_mean:
        values.update(df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in by_mean]).first().asDict())
    if by_median or by_mode:
        quantiles = lambda: exact_quantiles(df, by_median, [0.5]) if by_median else {}
        middles, top = together(df.sparkSession, quantiles, lambda: modes_of(df, sorted(by_mode), sorted(numeric)))
        values.update({c: middles[c][0] if c in middles else None for c in by_median})
        for c in by_mode:
            # A number column without values cannot hold the text placeholder.
            values[c] = top.get(c, None if c in numeric else "N/A")
    return values


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first().asDict()


def fill_nulls(df: DataFrame, fills: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    """Apply fill rules on different columns together: one pass for all their statistics."""
    gaps = null_counts(df, [r.column for r in fills])
    needed = [r for r in fills if gaps[r.column]]
    if not needed:
        return df, []
    values = fill_values(df, needed)
    types = {f.name: f.dataType for f in df.schema.fields}

    def target(name: str) -> T.DataType:
        # A fractional mean or median turns a whole-number column into doubles.
        whole = isinstance(types[name], T.IntegralType)
        return T.DoubleType() if whole and isinstance(values[name], float) else types[name]

    filled = df.select(
        *[
            F.coalesce(F.col(f"`{c}`").cast(target(c)), F.lit(values[c]).cast(target(c))).alias(c)
            if c in values
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
    return filled, [
        f"Filled {gaps[r.column]} nulls in '{r.column}' using {r.method} (value: {values[r.column]})."
        for r in needed
    ]


def apply_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    position: str,
    formats: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Apply the rules in order; unknown rules and columns are passed over.

    ``position`` is a unique BIGINT column giving the row order. Returns the
    cleaned table and one log line per rule that did something.
    """
    logs: list[str] = []
    df = nan_as_null(df)
    usable = [
        r
        for r in rules
        if r.type == "remove_duplicates"
        or (r.type in ("fill_nulls", "standardize_dates") and r.column in df.columns)
    ]
    for kind, run in groupby(usable, key=lambda r: r.type):
        steps = list(run)
        if kind == "remove_duplicates":
            df, dropped = remove_duplicates(df, position)
            logs.append(f"Dropped {dropped} duplicate rows.")
            logs += ["Dropped 0 duplicate rows."] * (len(steps) - 1)
        elif kind == "fill_nulls":
            while steps:
                # Rules on the same column run one after the other.
                batch: list[Rule] = []
                while steps and steps[0].column not in [r.column for r in batch]:
                    batch.append(steps.pop(0))
                df, lines = fill_nulls(df, batch)
                logs += lines
        else:
            for rule in steps:
                df, line = standardize_dates(df, rule.column, position, formats, rule.parameters.get("unread", "fill"))
                logs.append(line)
    return df, logs


def preview(df: DataFrame, position: str, rows: int = 50) -> DataFrame:
    """The first rows in row order."""
    return df.orderBy(position).limit(rows).drop(position)
