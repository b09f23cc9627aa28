"""Collocations, periodic runs and SimHash against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd import TEXTS, odd_documents
from xxhash import xxh64_intdigest

from ledgerlake.llm import hat_trie, phrases, queries, runs, simhash
from ledgerlake.llm.components import components
from ledgerlake.llm.hat_trie import HatTrie, prefix_counts
from ledgerlake.llm.words import stretches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def table_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@given(st.binary(max_size=60), st.integers(1, 9))
def test_stretches_hold_all_words(text, size):
    assert [w for part in stretches(text, size) for w in part] == WORD.findall(text)


# Collocations


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 6), min_size=3, max_size=5), max_size=80), st.integers(1, 5), st.integers(2, 30))
def test_trie_counts_all_prefixes(windows, burst, held):
    """Whatever bursts and spills on the way."""
    trie = HatTrie(5, burst=burst, held=held)
    got = Counter()

    def take(everything):
        for rows, counts in prefix_counts(*trie.spill(everything), 3):
            assert len({tuple(r) for r in rows.tolist()}) == len(rows)
            got.update({tuple(r): n for r, n in zip(rows.tolist(), counts.tolist())})

    for start in range(0, len(windows), 7):
        rows = np.array([w + [-1] * (5 - len(w)) for w in windows[start : start + 7]], np.int32)
        trie.add(*phrases._distinct(rows))
        while trie.full():
            take(False)
    take(True)
    assert got == Counter(tuple(w[:k]) for w in windows for k in range(3, len(w) + 1))


def brute_collocations(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                inside |= {(p[i : i + k]) for i in range(len(p) - k + 1) if 100 * a >= 100 * own[p[i : i + k]]}
        ranked = []
        for p, a in candidates.items():
            if p not in inside:
                cuts = [(1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(3, 40), (20, 2000)])
def test_collocations_of_the_test_table(spark, data, least, top):
    docs = table_of(spark, data)
    got = [tuple(r) for r in phrases.collocations(docs, least_count=least, top=top).collect()]
    assert sorted(got) == brute_collocations([tuple(r) for r in docs.select("lang", "text").collect()], least, top)


def test_windows_of_a_long_text_do_not_depend_on_stretches(monkeypatch):
    language = phrases._Language("x")
    rng = np.random.default_rng(2)
    text = " ".join("." if x == 9 else f"w{x}" for x in rng.integers(0, 10, 500)).encode()
    numbers = language.numbers([text])
    full = np.full(1 << (phrases.SKETCH_BITS - 6), 2**64 - 1, np.uint64)
    whole = phrases._windows_in(language, numbers, full, full).tolist()
    monkeypatch.setattr(phrases, "STRETCH_WORDS", 7)
    parts = [phrases._windows_in(language, numbers[a : a + 7 + 4], full, full).tolist() for a in range(0, len(numbers), 7)]
    assert sum(parts, []) == whole and len(whole) > 300


def test_collocations_of_odd_rows(spark, monkeypatch):
    """Null and missing languages, ties, pieces and repeats; with tries that burst and spill all the time."""
    monkeypatch.setattr(phrases, "STRETCH_WORDS", 5)
    monkeypatch.setattr(hat_trie, "BURST", 3)
    rows = [(None, "a b a b a b! a b"), ("und", "A  B\tc d c d"), ("xx", None), ("xx", ""), ("xx", " .,;\r\n"), ("xx", "é ü é ü é ü"), ("xx", "z y\x0bz y")]
    rows += [("xx", text) for _, text in TEXTS]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS f", "3 AS words", "4 AS rank")
    got = [tuple(r) for r in phrases.collocations(docs, least_count=2, top=30).collect()]
    assert sorted(got) == brute_collocations(rows, 2, 30)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    frequent = spark.createDataFrame([("x", "a b", big - 7), ("x", "a", big + 1), ("x", "b", big + 3)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("x", 10**17 + 1)], "lang string, n long")
    row = phrases.scored(frequent, totals).first()
    assert row.score == 1000 * (big - 7) * (10**17 + 1) // ((big + 1) * (big + 3))


# Periodic runs


def brute_runs(words):
    """Every stretch that no neighbour extends, by period; of several periods of one stretch the least."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((a, n, p) for (a, n), p in found.items())


def numbered(parts):
    parts = sorted(parts, key=len, reverse=True)
    joined = [x for at, part in enumerate(parts) for x in [*part, -1 - at]]
    return np.array(joined, np.int32), np.cumsum([len(p) + 1 for p in parts])


def all_runs(*parts):
    s, ends = numbered(parts)
    return sorted(zip(*(x.tolist() for x in runs.find_in(s, ends)))), brute_runs(s.tolist())


_periodic = st.builds(
    lambda root, n, more, m, change: [x if i != change else 9 for i, x in enumerate((root * n)[:n] + (more * m)[:m])],
    st.lists(st.integers(0, 2), min_size=1, max_size=30),
    st.integers(0, 200),
    st.lists(st.integers(0, 2), min_size=1, max_size=5),
    st.integers(0, 200),
    st.integers(0, 400),
)


@settings(deadline=None, max_examples=200)
@given(_periodic, _periodic, st.integers(1, 3))
def test_runs_of_periodic_sequences(one, two, times):
    got, expected = all_runs(one * times, two, one[:7], two[:40] * 2)
    assert got == expected


def test_runs_of_hard_sequences():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    binary = [bin(i).count("1") & 1 for i in range(1024)]
    touching = ([0, 1] * 90)[:179] + ([0, 1] * 100)
    for s in (fibonacci[-1], binary, touching, touching * 2, [5] * 800, list(range(300)) * 2, list(range(300)) * 3 + [1]):
        got, expected = all_runs(s)
        assert got == expected


def brute_described(doc_id, text, tail=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if tail and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = [r for r in brute_runs(words) if r[1] >= max(12, 2 * r[2])]
    dropped = {i for a, length, q in found for i in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    rest = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    exponent = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def test_runs_of_the_test_table(spark, data):
    docs = table_of(spark, data)
    short = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, data).collect()}
    assert len(got) == docs.count()
    assert {i: got[i] for i in short} == {i: brute_described(i, text) for i, text in short.items()}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_BYTES", 300)
    more = [(20, "a b c " * 9), (21, "x " * 12), (21, "x " * 11), (22, "x x " * 4 + "y z " * 7 + "x"), (None, "q r " * 8)]
    rows = [r for r in TEXTS if len(r[1] or "") < 10_000] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS period", "3 AS n_runs")
    for tail in (None, runs.circular_tail):
        got = Counter(tuple(r) for r in runs.find_runs(docs, tail=tail).collect())
        assert got == Counter(brute_described(*r, tail=tail is not None) for r in rows)
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark):
    """A long run inside a long text, many touching regions, and nothing else."""
    words = [f"w{i}" for i in range(60_000)]
    text = " ".join(words[:20_000] + words[:9_000] * 5 + words[20_000:])
    docs = spark.createDataFrame([(1, text), (2, "one two"), (3, "a b " * 2_000 + "a " + "a b " * 2_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 20_000, 45_000, 9_000)
    assert got[2].n_runs == 0 and got[3].n_runs > 1_000


# SimHash


def brute_print(text):
    words = lower(text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least position that can be reached over links of 4 bits at most, for each position."""
    u, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(u))]


def test_any_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.sampled_from(["a", "B", "é", "longer"]), max_size=40), st.integers(1, 20))
def test_fingerprints_do_not_depend_on_stretches(words, size):
    text, old = " ".join(words), simhash.stretches
    simhash.stretches = lambda t: old(t, size)
    try:
        assert simhash.fingerprint_of(lower(text).encode()) == brute_print(text)
    finally:
        simhash.stretches = old


def test_simhash_of_the_test_table(spark, data):
    rows = sorted((r.doc_id, brute_print(r.text)) for r in table_of(spark, data).select("doc_id", "text").collect())
    component = brute_components([p for _, p in rows])
    expected = {i: (f"{p:016x}", rows[c][0]) for (i, p), c in zip(rows, component)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash(spark, data).collect()}
    assert got == expected


@pytest.mark.parametrize("long_list", [256, 20, 2])
def test_links_in_families(spark, long_list):
    """Chains, dense families and strangers; short, long and very long lists find the same components."""
    rng = np.random.default_rng(13)
    prints = set(rng.integers(0, 2**64, 400, dtype=np.uint64).tolist())
    for size, most in ((120, 9), (200, 5), (60, 2)):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for bits in rng.integers(0, most + 1, size).tolist():
            prints.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, bits).tolist())))
    prints = sorted(np.array(list(prints), np.uint64).view(np.int64).tolist())
    component = brute_components(np.array(prints, np.int64).view(np.uint64))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    stars = {r.node: r.least for r in components(simhash.links(table, long_list)).collect()}
    assert [stars.get(p, p) for p in prints] == [prints[c] for c in component]


def test_simhash_of_odd_rows(spark):
    got = simhash.find_similar(odd_documents(spark).withColumnRenamed("size", "fp")).collect()
    expected, least = Counter(), {}
    prints = [brute_print(text) for _, text in TEXTS]
    component = brute_components(prints)
    for (doc_id, _), c in zip(TEXTS, component):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    for (doc_id, _), p, c in zip(TEXTS, prints, component):
        expected[doc_id, f"{p:016x}", least.get(c)] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert simhash.find_similar(odd_documents(spark).limit(0)).count() == 0
