"""Radix selection, duplicates by hashes and distinct counts against plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import selection
from ledgerlake.operators.correlation import correlation_matrix
from ledgerlake.operators.duplicates import duplicate_rows, first_copies
from ledgerlake.operators.frequencies import distinct_counts
from ledgerlake.operators.heavy import modes_of
from ledgerlake.operators.profile import Profile

RNG = np.random.default_rng(7)
COLUMNS = {
    "uniform": RNG.random(3000),
    "heavy_tail": np.exp(RNG.normal(0, 40, 3000)),
    "two_values": RNG.integers(0, 2, 3000).astype(float),
    "tiny_and_huge": np.r_[RNG.random(2990) * 5e-324 * 1000, [1.7e308, -1.7e308] * 5],
    "with_infinities": np.r_[RNG.normal(size=2900), [math.inf] * 60, [-math.inf] * 40],
    "constant": np.full(3000, 4.5),
}


def interpolated(values, p):
    values = sorted(values)
    step = p * (len(values) - 1)
    first, second = values[int(step)], values[min(int(step) + 1, len(values) - 1)]
    return first + (second - first) * (step - int(step)) if first != second else first


@pytest.mark.parametrize("bins, fetched, aside", [(1 << 17, 1 << 16, 16), (64, 20, 16), (64, 5, 2), (64, 1, 10**9)])
def test_quantiles_of_hard_columns(spark, monkeypatch, bins, fetched, aside):
    """Whether values are fetched early, set aside or refined down to one value."""
    monkeypatch.setattr(selection, "MOST_BINS", bins)
    monkeypatch.setattr(selection, "MOST_FETCHED", fetched)
    monkeypatch.setattr(selection, "SET_ASIDE", aside)
    names = list(COLUMNS) if bins > 64 else ["heavy_tail", "two_values", "with_infinities"]
    rows = list(zip(*(map(float, COLUMNS[c]) for c in names)))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    df = df.withColumn("missing", F.lit(None).cast("double"))
    got = selection.exact_quantiles(df, [*names, "missing"], [0.0, 0.25, 0.5, 0.975, 1.0])
    assert got == {c: [interpolated(COLUMNS[c].tolist(), p) for p in (0.0, 0.25, 0.5, 0.975, 1.0)] for c in names}


def test_numbers_are_not_unpivoted_as_text(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.lit("t").alias("t"))
    plans = []
    explain = lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString())
    real = selection._refined
    selection._refined = lambda its, binned: (explain(binned), real(its, binned))[1]
    try:
        selection.MOST_FETCHED, before = 10, selection.MOST_FETCHED
        assert selection.exact_quantiles(df, ["id", "x"], [0.5]) == {"id": [499.5], "x": [499.5 / 7]}
    finally:
        selection._refined, selection.MOST_FETCHED = real, before
    assert plans and not any("as string" in p for p in plans)


def test_duplicates_are_whole_rows_and_nulls_are_equal(spark, monkeypatch):
    rows = [(0, "a", None, 1.0), (1, None, "a", 1.0), (2, "a", None, 1.0), (3, "ab", "c", 0.0), (4, "a", "bc", 0.0), (5, "ab", "c", -0.0), (6, None, None, None), (7, None, None, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, "p bigint, s string, `t.u` string, x double")
    data = df.drop("p")
    groups = Counter(r[1:3] + (r[3] and abs(r[3]),) for r in rows)
    assert duplicate_rows(data).first()[0] == sum(n - 1 for n in groups.values()) == 4
    kept = {r["p"]: r["_dropped"] for r in first_copies(df, "p").collect()}
    assert kept == {0: 1, 1: 0, 3: 1, 4: 0, 6: 2}
    # Were all hashes equal, whole rows would still be told apart.
    from ledgerlake.operators import duplicates

    monkeypatch.setattr(duplicates, "_with_hashes", lambda d, columns: d.withColumns({h: F.lit(1).cast("long") for h in duplicates._HASHES}))
    assert duplicate_rows(data).first()[0] == 4
    assert {r["p"]: r["_dropped"] for r in first_copies(df, "p").collect()} == kept
    assert duplicate_rows(data.limit(0)).first()[0] == 0


def test_rows_that_stand_alone_are_not_shuffled(spark, monkeypatch):
    """Lone rows meet no join; a sketch that is full only lets more rows be compared."""
    from ledgerlake.operators import duplicates

    rows = [(i, f"s{i % 900}", None if i % 5 == 0 else i % 900) for i in range(1000)]
    df = spark.createDataFrame(rows, "p bigint, s string, n int")
    groups = Counter(r[1:] for r in rows)
    for bits in (duplicates._MOST_BITS, 64):
        monkeypatch.setattr(duplicates, "_MOST_BITS", bits)
        first = first_copies(df, "p")
        assert "Join" not in first._jdf.queryExecution().optimizedPlan().toString()
        kept = {r["p"]: r["_dropped"] for r in first.collect()}
        assert kept == {p: groups[s, n] - 1 for p, s, n in rows if p == min(q for q in (p, p - 900) if q >= 0)}
        assert duplicate_rows(df.drop("p")).first()[0] == 100


def test_distinct_counts_by_type(spark):
    rows = [(1, 1.0, "1", None, True), (2, 2.5, "1", None, False), (2**60 + 1, 0.0, "x", None, None), (2**60, -0.0, None, None, True)]
    df = spark.createDataFrame(rows, "n long, x double, s string, e string, b boolean").withColumn("d", F.col("n").cast("decimal(38,2)"))
    assert distinct_counts(df) == {"n": 4, "x": 3, "s": 2, "e": 0, "b": 2, "d": 4}


def test_sketched_distinct_counts_of_a_wide_table(spark):
    """1,000 columns of 1 to 3,000 values each: the error stays near what was asked for."""
    width, rows = 1000, 3000
    df = spark.range(rows).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3 * i + 1)).alias(f"c{i}") for i in range(width)])
    pdf = df.toPandas()
    exact = {c: pdf[c].nunique() for c in df.columns}
    got = distinct_counts(df, 0.05)
    off = np.array([(got[c] - exact[c]) / exact[c] for c in df.columns])
    assert np.sqrt((off**2).mean()) < 0.05 and np.abs(off).max() < 0.25
    profile = Profile(df.select("c10", "c999"), distinct_error=0.05)
    assert {r["column"]: r["unique_count"] for r in profile.null_counts().collect()} == {c: got[c] for c in ("c10", "c999")}


def test_correlations_of_a_wide_table(spark):
    """1,000 columns with gaps, large means, constants; a few pairs against numpy."""
    rng = np.random.default_rng(5)
    rows, width = 400, 1000
    base = rng.normal(size=(rows, 8))
    x = base @ rng.normal(size=(8, width)) + rng.normal(size=(rows, width)) + 1e6 * rng.integers(0, 2, width)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 17], x[:, 18] = 1e9 + 0.1, np.nan
    df = spark.createDataFrame(pa.table({f"c{i}": pa.array(x[:, i], from_pandas=True) for i in range(width)})).repartition(3)
    found = correlation_matrix(df)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    cells = {(r[0], r[1]): r[2] for r in found.filter("column_a IN ('c0', 'c17', 'c130', 'c999')").collect()}
    assert len(cells) == 4 * width and found.count() == width**2
    for a in (0, 130, 999):
        for b in [*range(0, width, 37), a, 17, 18]:
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            if b in (17, 18):
                assert cells[f"c{a}", f"c{b}"] is None
            else:
                assert cells[f"c{a}", f"c{b}"] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)
    assert cells["c17", "c17"] is None and cells["c0", "c0"] == 1.0


@pytest.mark.parametrize("counters", [4, 64, 4096])
def test_modes_by_heavy_hitters(spark, counters):
    """Equal to the exact mode whether counters are exact, candidates are counted anew, or all values are."""
    rng = np.random.default_rng(8)
    n = 4000
    columns = {
        "skewed": [f"v{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 900)],
        "uniform": [f"u{int(x)}" for x in rng.integers(0, 800, n)],
        "distinct": [f"d{i:05d}" for i in rng.permutation(n)],
        "few": [["x", "y", None][i % 3] for i in range(n)],
        "numbers": [int(x) for x in rng.integers(8, 12, n)],
        "empty": [None] * n,
        "tied": [f"t{i % 2}" if i % 4 else f"z{i}" for i in range(n)],
    }
    types = {c: "bigint" if c == "numbers" else "string" for c in columns}
    df = spark.createDataFrame([*zip(*columns.values())], ", ".join(f"{c} {t}" for c, t in types.items())).repartition(4)
    expected = {}
    for c, values in columns.items():
        counts = Counter(v for v in values if v is not None)
        if counts:
            expected[c] = str(min((v for v, k in counts.items() if k == max(counts.values())), key=lambda v: v))
    assert modes_of(df, list(columns), ["numbers"], counters) == expected
    assert modes_of(df.limit(0), ["few"]) == {} and modes_of(df, []) == {}
