"""A quality classifier trained without labels: a weak-label model and a hashed linear scorer.

1. Heuristic labellers, which overlap, vote good, bad or nothing on each text.
   All documents are counted by their pattern of votes, of which there are at
   most ``3 ** len(LABELLERS)``.
2. Expectation-maximisation over the patterns estimates the share of good texts
   and, for each labeller, how often it votes what on good and on bad ones. That
   gives each pattern, and so each document, a posterior label.
3. On a sample of at most about ``TRAIN_ROWS`` documents a logistic scorer learns
   the posteriors from hashed shapes of the text (which characters follow each
   other, how words repeat), not from the labellers' own votes.
4. The scorer is applied to all documents.

The driver holds the pattern counts, the sample's features and the weights, all
bounded by parameters.

Defined results: a null text counts as empty; labellers abstain on it and its
score is the scorer's for no shapes at all; repeated rows score alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.shingles import Shingler, texts_in_chunks
from ledgerlake.llm.tables import named, text_of, written

TRAIN_ROWS = 8000
TRAIN_SEED = 7
DIMENSIONS = 1024
EM_ROUNDS = 100
GOOD, BAD, NOTHING = "g", "b", "-"


@dataclass(frozen=True)
class Labeller:
    """Conditions over the facts of a text; neither true is no vote."""

    name: str
    good: str
    bad: str


NEVER = "false"
#: Those for faults are silent on other texts; those for good prose overlap with each other and with the former.
LABELLERS = (
    Labeller("symbols", NEVER, "3 * symbols > words"),
    Labeller("bars", NEVER, "10 * bars > words"),
    Labeller("capitals", NEVER, "2 * capitals > letters AND words >= 3"),
    Labeller("marks", NEVER, "2 * marks > words AND words >= 3"),
    Labeller("stutter", "20 * same < words AND words >= 20", "4 * same > words"),
    Labeller("vocabulary", "2 * distinct > words", "4 * distinct < words AND words BETWEEN 20 AND 2000"),
    Labeller("sentences", "words < 20 OR words BETWEEN 2 * enders AND 60 * enders", "words > 150 * enders AND words >= 50"),
    Labeller("calm", "20 * symbols <= 20 + words AND 2 * capitals <= letters AND 20 * marks <= 20 + words", NEVER),
)

_FACTS = ("words", "letters", "capitals", "symbols", "same", "distinct", "enders", "bars", "marks")

# Bytes told apart by the shapes; all others fall in one class by kind.
_OWN_CLASS = b" \n.,!?#*$%&|-:;"
_SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.int64)  # controls and rare punctuation
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 3, 4
    for i, byte in enumerate(_OWN_CLASS):
        kinds[byte] = 5 + i
    return kinds


class Shapes:
    """Facts and hashed features of texts."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self._classes = _classes()
        self._kinds = int(self._classes.max()) + 1
        rng = np.random.default_rng(TRAIN_SEED)
        self._hashed = rng.integers(0, dimensions, self._kinds**3)
        self._bucket = rng.integers(0, dimensions, (2, 11))
        self._shingler = Shingler(1)
        self._is_symbol = np.isin(np.arange(256), list(_SYMBOLS))

    def facts(self, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        starts = np.r_[0, ends[:-1]]

        def among(mask: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(mask, dtype=np.int64)]
            return sums[ends] - sums[starts]

        kinds = self._classes[data]
        hashes, first = self._shingler._word_hashes(data, ends)
        same = np.r_[False, hashes[1:] == hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        same[first[:-1][first[:-1] < len(hashes)]] = False
        sums = np.r_[0, np.cumsum(same, dtype=np.int64)]
        capitals = among(kinds == 2)
        return {
            "words": np.diff(first),
            "letters": among(kinds == 1) + capitals,
            "capitals": capitals,
            "symbols": among(self._is_symbol[data]),
            "same": sums[first[1:]] - sums[first[:-1]],
            "distinct": np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:])], np.int64),
            "enders": among((data == 46) | (data == 33) | (data == 63)),
            "bars": among(data == 124),
            "marks": among(data == 33),
        }

    def features(self, data: np.ndarray, ends: np.ndarray, facts: dict[str, np.ndarray]) -> np.ndarray:
        """A row per text: square roots of the shares of its shapes, and which tenths its repetition falls in."""
        n = len(ends)
        kinds = self._classes[data]
        if len(data) > 2:
            shape = self._hashed[(kinds[:-2] * self._kinds + kinds[1:-1]) * self._kinds + kinds[2:]]
            text = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
            within = text[:-2] == text[2:]
            counts = np.bincount(text[:-2][within] * self.dimensions + shape[within], minlength=n * self.dimensions)
        else:
            counts = np.zeros(n * self.dimensions, np.int64)
        counts = counts.reshape(n, self.dimensions).astype(np.float32)
        rows = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        words = np.maximum(facts["words"], 1)
        for bucket, share in zip(self._bucket, (facts["same"] / words, facts["distinct"] / words)):
            rows[np.arange(n), bucket[np.floor(10 * share).astype(int)]] += 1
        return rows


def _facts_of(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(dimensions)
        for batch in batches:
            found = [shapes.facts(data, ends) for data, ends in texts_in_chunks(batch.column(1))]
            if found:
                columns = [pa.array(np.concatenate([f[name] for f in found]).astype(np.int64)) for name in _FACTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_FACTS])

    return run


def _features_of(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(dimensions)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                rows = [shapes.features(d, e, shapes.facts(d, e)) for d, e in texts_in_chunks(some.column(1))]
                flat = np.concatenate(rows).ravel()
                offsets = pa.array(np.arange(0, len(flat) + 1, dimensions, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["posterior", "x"])

    return run


def _scorer(weights: np.ndarray, bias: float, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(dimensions)
        for batch in batches:
            found, columns = [], []
            for data, ends in texts_in_chunks(batch.column(1)):
                facts = shapes.facts(data, ends)
                columns.append(facts)
                found.append(1 / (1 + np.exp(-(shapes.features(data, ends, facts) @ weights + bias).astype(np.float64))))
            if found:
                facts = [pa.array(np.concatenate([f[name] for f in columns]).astype(np.int64)) for name in _FACTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *facts, pa.array(np.concatenate(found))], ["id", *_FACTS, "score"])

    return run


def pattern(labellers: Sequence[Labeller] = LABELLERS):
    """The votes on a row of facts, a letter each."""
    votes = [F.when(F.expr(v.bad), BAD).when(F.expr(v.good), GOOD).otherwise(NOTHING) for v in labellers]
    return F.concat(*votes)


@dataclass(frozen=True)
class LabelModel:
    """``rates[k, label, vote]``: how often labeller k votes so on bad (0) and good (1) texts."""

    share_good: float
    rates: np.ndarray
    posteriors: dict[str, float]

    @property
    def accuracies(self) -> list[float]:
        """Of the votes given, the share that agrees with the posterior label."""
        prior = np.array([1 - self.share_good, self.share_good])
        right = prior[0] * self.rates[:, 0, 0] + prior[1] * self.rates[:, 1, 1]
        given = (prior[None, :, None] * self.rates[:, :, :2]).sum(axis=(1, 2))
        return (right / np.maximum(given, 1e-12)).tolist()


def fit_label_model(counts: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation; labellers start as better than chance, which fixes which class is good.

    Not to vote is an outcome like the votes, so silence tells something too.
    """
    if not counts:
        return LabelModel(0.5, np.zeros((0, 2, 3)), {})
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[(BAD, GOOD, NOTHING).index(v) for v in p] for p in patterns])
    shown = np.eye(3)[votes]  # pattern, labeller, vote
    rates = np.tile(np.array([[0.3, 0.2, 0.5], [0.02, 0.58, 0.4]]), (votes.shape[1], 1, 1))
    share = 0.8
    for _ in range(rounds):
        fit = np.einsum("pkv,kcv->pc", shown, np.log(rates)) + np.log([1 - share, share])
        fit = np.exp(fit - fit.max(axis=1, keepdims=True))
        belief = fit / fit.sum(axis=1, keepdims=True)
        weight = belief * n[:, None]
        # One made-up vote of each kind keeps rates above zero.
        rates = np.einsum("pc,pkv->kcv", weight, shown) + 1
        rates /= rates.sum(axis=2, keepdims=True)
        share = float(np.clip(weight[:, 1].sum() / n.sum(), 1e-6, 1 - 1e-6))
    return LabelModel(share, rates, dict(zip(patterns, belief[:, 1].tolist())))


def fit_scorer(x: np.ndarray, posterior: np.ndarray, steps: int = 400, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by gradient steps with moments."""
    weights, bias = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return weights, bias
    first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(x @ weights + bias))) - posterior
        slope = np.r_[x.T @ error / len(x) + decay * weights, error.mean()]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) / np.sqrt(step)
        weights, bias = weights - move[:-1].astype(np.float32), bias - float(move[-1])
    return weights, bias


def classify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS
) -> DataFrame:
    """One row per document: doc_id, votes, posterior, score, kept."""
    rows = docs.select(named(doc_id).alias("id"), text_of(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    facts = ", ".join(f"{name} long" for name in _FACTS)
    voted = rows.mapInArrow(_facts_of(dimensions), f"id {kind}, {facts}").groupBy(pattern().alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["votes"]: r["n"] for r in voted.collect()}
    model = fit_label_model(counts)

    share = min(1.0, train_rows / max(sum(counts.values()), 1))
    sample = written(rows.sample(fraction=share, seed=TRAIN_SEED), "quality-sample")
    known = docs.sparkSession.createDataFrame([*model.posteriors.items()], "votes string, posterior double")
    texts = sample.withColumn("place", F.monotonically_increasing_id())
    votes = texts.select(F.col("place").alias("id"), "text").mapInArrow(_facts_of(dimensions), f"id long, {facts}").select("id", pattern().alias("votes"))
    labelled = texts.join(votes, F.col("place") == votes["id"]).join(F.broadcast(known), "votes").select("posterior", "text")
    table = labelled.mapInArrow(_features_of(dimensions), "posterior double, x array<float>").toArrow().combine_chunks()
    posterior = table.column("posterior").to_numpy()
    x = table.column("x").combine_chunks()
    x = (x.values if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks).values).to_numpy().reshape(-1, dimensions) if len(posterior) else np.zeros((0, dimensions), np.float32)
    weights, bias = fit_scorer(x, posterior)

    scored = rows.mapInArrow(_scorer(weights, bias, dimensions), f"id {kind}, {facts}, score double")
    scored = scored.select(F.col("id").alias("doc_id"), pattern().alias("votes"), "score").join(F.broadcast(known), "votes", "left")
    return scored.select("doc_id", "votes", "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
