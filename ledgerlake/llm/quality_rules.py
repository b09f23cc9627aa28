"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``plan_cascade`` estimates each rule's cost and selectivity on a sample, in one
pass: which rules reject a row, and how many characters it has. Rules are then
chosen one after the other, each time the one with most rejections per cost
among the rows that are left; what it costs are the counts that no earlier rule
has made. The sample is taken by a hash of the text and costs are weights per
character, so the same table gives the same order, however it is partitioned.
``keep_good`` works the rules off in that order: a row that an early rule
rejects is spared the counts of the later ones. The order changes the time
taken, never the verdict: a row is kept when no rule rejects it. ``judge``
reports most counts for every row and makes the others only where no rule has
rejected so far.

Words in repeated windows: all 3-word windows are hashed; only where some hash
repeats are (hash, place) pairs sorted, neighbours compared, and the places of
repeated windows walked in order.

Defined results: a null or empty text has no words and is rejected; ties and
repeated rows are judged one by one; an empty table gives an empty result and
the rules in their written order; other columns pass through ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.tables import named, text_of, whole_row

_SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARACTERS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SAMPLE_ROWS = 2000
#: Parts of the hash range in which the sample is taken.
_LOTS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``rejects``: a condition over the columns of ``measure``."""

    name: str
    rejects: str

    @property
    def reads(self) -> list[str]:
        return [name for name in _COUNTS if re.search(rf"\b{name}\b", self.rejects)]


#: Thresholds are parameters: pass other rules to change them.
BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)

def _removed(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text).cast("long") - F.length(F.translate(text, characters, ""))


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _windows(word: Column) -> Column:
    hashed = F.transform(word, lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)))
    return F.slice(hashed, 1, F.greatest(F.size(word) - 2, F.lit(0)))


def _in_order(hashes: Column) -> Column:
    """(hash, place) pairs by hash; null where no hash repeats, so that most texts are not sorted."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def _repeated_places(window: Column) -> Column:
    def like(x: Column, neighbour: Column) -> Column:
        return F.coalesce(neighbour["h"] == x["h"], F.lit(False))

    twice = F.filter(window, lambda x, i: like(x, F.get(window, i + 1)) | ((i > 0) & like(x, F.get(window, i - 1))))
    return F.sort_array(F.transform(twice, lambda x: x["at"]))


def _covered(place: Column) -> Column:
    """Words in three-word windows at sorted places: each covers up to three new ones."""
    new = F.transform(place, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(place, i + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))


def _with_word(lines: Column) -> Column:
    return F.filter(lines, lambda line: F.length(F.translate(line, _SPACE_CHARACTERS, "")) > 0)


#: Counts and the columns they are made from, each after those it reads.
_STEPS = {
    "_words": ((), lambda: F.filter(F.split("_text", _SPACES), lambda word: word != "")),
    "_windows": (("_words",), lambda: _windows(F.col("_words"))),
    "_sorted": (("_windows",), lambda: _in_order(F.col("_windows"))),
    "_places": (("_sorted",), lambda: _repeated_places(F.col("_sorted"))),
    "_lines": ((), lambda: _with_word(F.split("_text", "\n"))),
    "n_words": (("_words",), lambda: _size(F.col("_words"))),
    "word_chars": ((), lambda: F.length(F.translate("_text", _SPACE_CHARACTERS, "")).cast("long")),
    "n_symbols": ((), lambda: _removed(F.col("_text"), _SYMBOLS)),
    "n_lines": (("_lines",), lambda: _size(F.col("_lines"))),
    "n_dup_lines": (("_lines",), lambda: _size(F.col("_lines")) - _size(F.array_distinct("_lines"))),
    "n_upper": ((), lambda: _removed(F.col("_text"), _UPPER)),
    "n_repeat_words": (("_places",), lambda: _covered(F.col("_places"))),
}
_COUNTS = tuple(name for name in _STEPS if not name.startswith("_"))
#: What ``judge`` says of every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Work per character of text for each column, about, in units of one replacement over the text.
_WORK = {
    "_words": 4, "_windows": 4, "_sorted": 3, "_places": 2, "_lines": 2, "n_words": 0.1, "word_chars": 1, "n_symbols": 1,
    "n_lines": 0.1, "n_dup_lines": 2, "n_upper": 1, "n_repeat_words": 1,
}
#: What passing a rule costs besides, so that no rule is free.
_PASSING = 0.01


def _steps_of(names: Sequence[str]) -> set[str]:
    """The counts and all that they are made from."""
    found: set[str] = set()
    for name in names:
        found |= {name} | _steps_of(_STEPS[name][0])
    return found


def _with_step(rows: DataFrame, name: str, wanted: Column | None = None) -> DataFrame:
    """Adds a count and what it reads; only in rows where ``wanted`` holds, else null."""
    if name in rows.columns:
        return rows
    reads, make = _STEPS[name]
    for read in reads:
        rows = _with_step(rows, read, wanted)
    return rows.withColumn(name, make() if wanted is None else F.when(wanted, make()))


def _measured(rows: DataFrame, names: Sequence[str] = _COUNTS) -> DataFrame:
    """``rows`` has ``_text``; adds the counts."""
    for name in names:
        rows = _with_step(rows, name)
    return rows


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules by rejections per cost among the rows that earlier rules leave, as seen on about ``sample_rows`` rows."""
    texts = docs.select(text_of(text).alias("_text"))
    lots = int(min(1.0, sample_rows / max(docs.count(), 1)) * _LOTS)
    sample = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(_LOTS)) <= lots)
    rejects = [F.coalesce(F.expr(rule.rejects), F.lit(False)) for rule in rules]
    read = sorted({name for rule in rules for name in rule.reads}, key=list(_STEPS).index)
    judged = _measured(sample, read).select(F.array(*rejects).alias("rejected"), F.length("_text").alias("characters"))
    # A row per set of rules that reject together.
    sets = judged.groupBy("rejected").agg(F.count(F.lit(1)).alias("rows"), F.sum("characters").alias("characters")).collect()

    order: list[int] = []
    made: set[str] = set()
    while len(order) < len(rules):
        alive = [s for s in sets if not any(s["rejected"][i] for i in order)]
        characters = sum(s["characters"] for s in alive)

        def worth(i: int) -> tuple[float, int]:
            work = _PASSING + sum(_WORK[step] for step in _steps_of(rules[i].reads) - made)
            return sum(s["rows"] for s in alive if s["rejected"][i]) / (work * max(characters, 1)), -i

        best = max((i for i in range(len(rules)) if i not in order), key=worth)
        order.append(best)
        made |= _steps_of(rules[best].reads)
    return [rules[i] for i in order]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    narrow = docs.select(named(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    rows = _cascaded(_measured(narrow, REPORTED), plan_cascade(docs, rules, text))
    base = F.expr(" OR ".join(f"({rule.rejects})" for rule in BASE_RULES))
    return rows.select("doc_id", *REPORTED, base.alias("base_failed"), (~base & F.col("_alive")).alias("kept"))


def _cascaded(rows: DataFrame, cascade: Sequence[Rule]) -> DataFrame:
    """Adds ``_alive``: whether no rule rejects; counts that are not there are made rule by rule, where none has rejected so far."""
    rows = rows.withColumn("_alive", F.lit(True))
    for rule in cascade:
        for name in rule.reads:
            rows = _with_step(rows, name, F.col("_alive"))
        rows = rows.withColumn("_alive", F.col("_alive") & ~F.coalesce(F.expr(rule.rejects), F.lit(False)))
    return rows


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Rows that no rule rejects, with all their columns; counts are made rule by rule, in rows not rejected so far."""
    rows = docs.select(whole_row(docs).alias("row"), text_of(text).alias("_text"))
    rows = _cascaded(rows, plan_cascade(docs, rules, text))
    # The row number keeps the filter above the counts; moved below, each mention would count again.
    rows = rows.withColumn("_pin", F.monotonically_increasing_id())
    return rows.filter("_alive AND _pin >= 0").select("row.*")
