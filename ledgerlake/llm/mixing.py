"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

1. Sources get weights in code-point order and share a budget of words. A
   source whose share is above ``epochs`` times its size is clamped there; what
   is left is shared among the others by weight, until no share is too high.
   Every round is one aggregate over the small table of sources.
2. A source's target is whole repetitions of all its documents and a fraction
   of one more. For the fraction its documents are dealt by a seeded hash into
   buckets, whose sizes are summed before they are lined up; buckets that lie
   wholly below the wanted size are taken, and only the bucket at the edge is
   lined up row by row, so a hot source never meets in one task. The document
   at the edge gives just the words that are missing.

Defined results: a null text has no words and takes none; null is a source of
its own, after all others; equal rows get the same hash and are lined up in any
order, which gives the same rows; sources without words get target 0; an empty
table gives an empty result; other columns pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.tables import WORD, named, text_of, whole_row, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 6
#: A source has 16**BUCKET_DIGITS buckets for its fractional repetition; the one at the edge is lined up row by row.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS
) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    totals = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    # One row per source: the order of sources is the only thing that is not summed in parts.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = written(totals.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(epochs))
    found = sources.agg((F.sum("source_size") * F.lit(float(share))).alias("budget"), F.count(F.lit(1)).alias("n")).first()
    level = None  # words per unit of weight for sources that are not clamped
    for _ in range(found["n"] + 1):
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        free = sources.agg(
            F.sum(F.when(clamped, cap).otherwise(0.0)).alias("clamped"), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not free["weight"]:
            level = float("inf")
            break
        raised = (found["budget"] - free["clamped"]) / free["weight"]
        if level is not None and raised <= level:
            break
        level = raised
    filled = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", filled.alias("target"))


def _sized(rows: DataFrame, doc_id: Column, text: Column, source: Column, seed: int) -> DataFrame:
    """Adds source, size and the draw: hexadecimal digits that depend on the seed, the id and the text only."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return rows.withColumns(
        {"source": source, "size": n_words(text), "draw": F.md5(F.concat_ws(":", F.lit(str(seed)), own, F.md5(text)))}
    ).withColumn("bucket", F.conv(F.substring("draw", 1, BUCKET_DIGITS), 16, 10).cast("int"))


def _plan(sized: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """One row per source: its target, whole repetitions, and the bucket at the edge with the words missing there."""
    targets = written(source_targets(sized, weights, share, epochs), "mix-targets")
    # Rounded first: a target just below a multiple of the size is whole repetitions, so that part < source_size.
    rounded = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(rounded / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = rounded - whole * F.col("source_size")
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), part.alias("part"))
    # At most 16**BUCKET_DIGITS rows of a source meet in this window.
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lined = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edges = (
        lined.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .filter((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("words")))
        .select(F.col("source").alias("edge_of"), F.col("bucket").alias("edge"), (F.col("part") - F.col("before")).alias("missing"))
    )
    return written(targets.join(edges, F.col("of").eqNullSafe(F.col("edge_of")), "left").drop("edge_of"), "mix-plan")


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan of the row's source and ``taken``."""
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    below = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))
    whole = F.col("whole") * F.col("size")
    earlier = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.filter(at_edge).withColumn("_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("missing") - F.col("_before")))
    edge = edge.withColumn("taken", whole + some).drop("_before")
    rest = dealt.filter(~at_edge).withColumn("taken", whole + F.when(below, F.col("size")).otherwise(0))
    return edge.unionByName(rest)


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    narrow = docs.select(named(doc_id).alias("doc_id"), named(source).alias("_source"), text_of(text).alias("_text"))
    sized = _sized(narrow, F.col("doc_id"), F.col("_text"), F.col("_source"), seed).drop("_source", "_text")
    sized = written(sized, "mix-sizes")
    return _taken(sized, _plan(sized, weights, share, epochs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mixture, with the columns of ``docs``: a row per whole repetition, and one with the first words of a fractional one."""
    rows = docs.select(whole_row(docs).alias("row"))
    row = F.col("row")
    words = F.coalesce(row.getField(text).cast("string"), F.lit(""))
    sized = _sized(rows, row.getField(doc_id), words, row.getField(source), seed)
    plan = _plan(written(sized.drop("row"), "mix-sizes"), weights, share, epochs)
    taken = _taken(sized, plan)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    left = (F.col("taken") - whole * F.col("size")).cast("int")
    # Cut behind each word: the white space before a word stays with it.
    cut = F.array_join(F.slice(F.split(words, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), left), "")
    repeated = F.concat(
        F.array_repeat(F.struct(words.alias("text")), whole),
        F.when(left > 0, F.array(F.struct(cut.alias("text")))).otherwise(F.array().cast("array<struct<text:string>>")),
    )
    out = taken.select("row", F.explode(repeated).alias("piece"))
    return out.select(*[F.col("piece.text").alias(c) if c == text else row.getField(c).alias(c) for c in docs.columns])
