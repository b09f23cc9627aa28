"""Isolation forest (Liu, Ting and Zhou, 2008) over any number of rows.

Each tree grows from a fixed small sample, so growing is cheap however large
the table: one scan tags sampled rows with a tree, and each tree is grown in
its own task. Scoring is one pass with the forest, whose size is fixed by the
tree count and sample size, sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlake.errors import NotEnoughData
from ledgerlake.staging import stage

TREES, SAMPLE = 100, 256
CONTAMINATION = 0.02
MEASURES = ["sales", "quantity", "discount", "profit"]
_MIN_ROWS = 50
# Candidates drawn per sampled row: a tree finds fewer than it needs with a chance of about e**-300.
_MARGIN = 4
_HASHES = 2**62
# Equal parts of the range of scores that are counted to find a rank among them.
_SCORE_BINS = 1 << 16


def average_path(rows: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of that many rows."""
    n = np.asarray(rows, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    longer = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, longer, np.where(n == 2, 1.0, 0.0))


def _depth_limit(sample: int) -> int:
    return int(np.ceil(np.log2(max(sample, 2))))


def tree_samples(df: DataFrame, key: str, rows: int, sample: int, seed: int, trees: int = TREES) -> DataFrame:
    """(tree, key, ...): for every tree the ``sample`` rows with the lowest hash of key and tree.

    Hashes that cannot be among the lowest are left out before the rows are
    ranked, so a few times the sample size is ranked per tree.
    """
    share = min(1.0, _MARGIN * sample / max(rows, 1))

    def drawn(tree):
        return F.struct(tree.alias("tree"), F.pmod(F.xxhash64(key, tree, F.lit(seed)), F.lit(_HASHES)).alias("_draw"))

    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)
    low = F.filter(draws, lambda d: d["_draw"] <= F.lit(int(share * _HASHES)))
    candidates = df.select("*", F.inline(low))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", key))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= sample).drop("_place", "_draw")


def low_quantile(scored: DataFrame, rows: int, share: float) -> float:
    """Exact quantile of ``score`` (in -1 to 0) with linear interpolation.

    Scores are counted in bins, which combine before they are shuffled; only the
    bins that hold the two neighbouring ranks are looked at value by value.
    """
    at = share * (rows - 1)
    ranks = (int(at), min(int(at) + 1, rows - 1))
    place = F.least(F.floor((F.col("score") + 1) * _SCORE_BINS), F.lit(_SCORE_BINS - 1))
    # At most _SCORE_BINS rows.
    bins = scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    before, wanted = 0, {}
    for b in bins:
        for rank in ranks:
            if before <= rank < before + b["n"]:
                wanted[rank] = (b["bin"], rank - before)
        before += b["n"]
    values = {}
    for bin_ in {b for b, _ in wanted.values()}:
        counted = scored.filter(place == bin_).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("score"))
        for rank, (own, inside) in wanted.items():
            if own == bin_:
                values[rank] = counted.withColumn("_upto", upto).filter(F.col("_upto") > inside).agg(F.min("score")).first()[0]
    low, high = values[ranks[0]], values[ranks[1]]
    return low + (high - low) * (at - ranks[0])


def _grow(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes as (feature, split, left, right, path): feature -1 marks a leaf."""
    nodes: list[list] = []
    waiting = [(points, 0, None, 0)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        place = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = place
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(varied):
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        nodes.append([feature, split, -1, -1, 0.0])
        below = rows[:, feature] <= split
        waiting.append((rows[~below], depth + 1, place, 1))
        waiting.append((rows[below], depth + 1, place, 0))
    return [tuple(n) for n in nodes]


_NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


def grow_forest(samples: DataFrame, key: str, features: Sequence[str], sample: int, seed: int) -> DataFrame:
    """One tree per group of at most ``sample`` rows; returns the trees' nodes."""
    columns = list(features)
    max_depth = _depth_limit(sample)

    def grow(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = rows.sort_values(key)[columns].to_numpy(dtype=float)
        nodes = _grow(points, np.random.default_rng([seed, int(group[0])]), max_depth)
        table = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "path"])
        table.insert(0, "node", range(len(nodes)))
        table.insert(0, "tree", int(group[0]))
        return table

    return samples.groupBy("tree").applyInPandas(grow, _NODE_SCHEMA)


def strangeness(points: np.ndarray, trees: list[tuple], depth: int, norm: float) -> np.ndarray:
    """Score per row, from -1 (stands alone) to 0 (deep in the crowd).

    Leaves lead back to themselves, so all rows take the same number of steps.
    """
    cells = np.ascontiguousarray(points).ravel()
    row_start = np.arange(len(points)) * points.shape[1]
    total = np.zeros(len(points))
    for feature, split, children, path in trees:
        at = np.zeros(len(points), dtype=np.int64)
        for _ in range(depth):
            right = cells.take(row_start + feature.take(at)) > split.take(at)
            at = children.take(2 * at + right)
        total += path.take(at)
    return -np.exp2(-(total / len(trees)) / norm)


def _scoring_form(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(feature, split, children, path) of one tree, with leaves as their own children."""
    leaf = (nodes["feature"] < 0).to_numpy()
    own = np.arange(len(nodes))
    children = np.empty(2 * len(nodes), dtype=np.int64)
    children[0::2] = np.where(leaf, own, nodes["left"])
    children[1::2] = np.where(leaf, own, nodes["right"])
    feature = np.where(leaf, 0, nodes["feature"]).astype(np.int64)
    return feature, nodes["split"].to_numpy(), children, nodes["path"].to_numpy()


@dataclass(frozen=True)
class Anomalies:
    """``labelled``: facts with score and label; product names are joined where rows are shown."""

    labelled: DataFrame
    products: DataFrame
    total: int

    @property
    def scored(self) -> DataFrame:
        return self._named(self.labelled)

    def _named(self, rows: DataFrame) -> DataFrame:
        named = rows.join(self.products.select("product_key", "product_name"), "product_key")
        return named.select("fact_key", "order_id", "product_name", *MEASURES, "anomaly_label", "anomaly_score")

    def flagged(self) -> DataFrame:
        return self._named(self.labelled.filter("anomaly_label = -1"))

    def samples(self, count: int = 100) -> DataFrame:
        return self.flagged().orderBy("fact_key").limit(count)

    def metrics(self) -> DataFrame:
        flagged = F.count_if(F.col("anomaly_label") == -1)
        return self.labelled.agg(
            F.count(F.lit(1)).alias("total_transactions"),
            flagged.alias("anomaly_count"),
            F.round(flagged / F.count(F.lit(1)) * 100, 2).alias("anomaly_rate_pct"),
        )


def isolation_scores(
    df: DataFrame, key: str, features: Sequence[str], rows: int, seed: int = 42, trees: int = TREES, sample: int = SAMPLE
) -> DataFrame:
    """Adds ``score``, lower for stranger rows; missing measures count as 0."""
    sample = min(sample, rows)
    measures = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    samples = tree_samples(df.select(key, *measures), key, rows, sample, seed, trees)
    # At most trees * 2 * sample short rows.
    nodes = grow_forest(samples, key, features, sample, seed).orderBy("tree", "node").toPandas()
    forest = df.sparkSession.sparkContext.broadcast([_scoring_form(tree) for _, tree in nodes.groupby("tree")])
    norm, depth = float(average_path(sample)), _depth_limit(sample)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            # A single column comes without a tuple around it.
            each = columns if isinstance(columns, tuple) else (columns,)
            points = np.column_stack([c.to_numpy(dtype=float) for c in each])
            yield pd.Series(strangeness(points, forest.value, depth, norm))

    return df.withColumn("score", score(*measures))


def detect_anomalies(
    facts: DataFrame,
    dim_products: DataFrame,
    seed: int = 42,
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
) -> Anomalies:
    """Flags the strangest transaction lines, a share of ``contamination`` of all."""
    rows = facts.count()
    if rows < _MIN_ROWS:
        raise NotEnoughData(f"anomaly detection needs {_MIN_ROWS} transaction lines, there are {rows}")
    lines = facts.select("fact_key", "order_id", "product_key", *MEASURES)
    scored = stage(isolation_scores(lines, "fact_key", MEASURES, rows, seed, trees, sample), "anomaly-scores")
    threshold = low_quantile(scored, rows, contamination)
    labelled = scored.withColumn("anomaly_score", F.col("score") - F.lit(threshold)).withColumn(
        "anomaly_label", F.when(F.col("anomaly_score") < 0, -1).otherwise(1)
    )
    return Anomalies(labelled.drop("score"), dim_products, rows)
