"""Modes without counting every value: mergeable heavy-hitter summaries, then an exact recount of candidates.

Each task keeps a bounded number of counters per column. When there are more,
the smallest go and all others lose as much, which is added to what the column
has lost; so no value comes more often than its counters of all tasks and that
loss say, and a value without a counter no more often than the loss. Where
nothing was lost the counters are exact. Elsewhere the values that may be the
mode are counted anew, and where even that does not decide, as in a column of
different values only, all values of that column are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlake.operators.frequencies import as_texts, modes, value_frequencies
from ledgerlake.staging import stage

#: Counters of a column in one task.
COUNTERS = 1024

_SUMMARY = "column string, text string, n long, lost long"


def _summaries(columns: Sequence[str], counters: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, int]] = [{} for _ in columns]
        lost = [0] * len(columns)

        def shrink(i: int) -> None:
            """Down to ``counters``: the next largest count is taken off all."""
            least = sorted(held[i].values(), reverse=True)[counters]
            held[i] = {text: n - least for text, n in held[i].items() if n > least}
            lost[i] += least

        for batch in batches:
            for i, column in enumerate(batch.columns):
                counted = pc.value_counts(column.drop_null())
                for text, n in zip(counted.field(0).to_pylist(), counted.field(1).to_pylist()):
                    held[i][text] = held[i].get(text, 0) + n
                if len(held[i]) > 2 * counters:
                    shrink(i)
        for i, name in enumerate(columns):
            if len(held[i]) > counters:
                shrink(i)
            texts = [None, *held[i]]
            counts = [0, *held[i].values()]
            losses = [lost[i], *[0] * len(held[i])]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(losses, pa.int64())], ["column", "text", "n", "lost"])

    return summarise


def modes_of(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = (), counters: int = COUNTERS) -> dict[str, str]:
    """Most frequent text per column, the smallest on ties; all-null columns are left out."""
    columns = list(columns)
    if not columns:
        return {}
    texts = as_texts(df, columns)
    summary = stage(texts.mapInArrow(_summaries(columns, counters), _SUMMARY), "heavy-hitters")
    merged = summary.filter("text IS NOT NULL").groupBy("column", "text").agg(F.sum("n").alias("n"))
    lost = {r["column"]: r["lost"] for r in summary.groupBy("column").agg(F.sum("lost").alias("lost")).collect()}
    most = {r["column"]: r["n"] for r in merged.groupBy("column").agg(F.max("n").alias("n")).collect()}

    exact = [c for c in columns if not lost.get(c) and c in most]
    found = modes(merged, exact, numeric) if exact else {}
    # A value that was lost altogether cannot be the mode if another's counters alone are above the loss.
    likely = [c for c in columns if lost.get(c) and most.get(c, 0) > lost[c]]
    if likely:
        may_be = F.lit(False)
        for c in likely:
            may_be = may_be | ((F.col("column") == c) & (F.col("n") + lost[c] >= most[c]))
        candidates = stage(merged.filter(may_be).select("column", "text"), "mode-candidates")
        again = as_texts(df, likely).unpivot([], likely, "column", "text").join(candidates, ["column", "text"])
        found |= modes(stage(again.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n")), "mode-counts"), likely, numeric)
    rest = [c for c in columns if lost.get(c) and c not in likely]
    if rest:
        found |= modes(stage(value_frequencies(df, rest), "frequencies"), rest, numeric)
    return found
