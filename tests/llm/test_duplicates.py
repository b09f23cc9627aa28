"""Exact, near and substring duplicates against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from odd import TEXTS, odd_documents

from ledgerlake.llm import exact_dedup, minhash, queries, repeats
from ledgerlake.llm.components import components
from ledgerlake.llm.quotient_filter import QuotientFilter
from ledgerlake.llm.transforms import Strings, merge


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@settings(deadline=None, max_examples=50)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 5), max_size=40), min_size=1, max_size=5))
def test_quotient_filters_merge_without_loss(parts):
    filters = [QuotientFilter.of(np.array(p, np.uint64), 24) for p in parts]
    merged = QuotientFilter.merged([QuotientFilter.unpack(f.pack()) for f in filters])
    counts = Counter(x for p in parts for x in p)
    assert dict(zip(merged.slots.tolist(), merged.counts.tolist())) == counts
    assert set(merged.more_than_once().tolist()) == {x for x, n in counts.items() if n > 1}
    cut = [f for _, f in merged.blocks(10)]
    assert [x for f in cut for x in f.slots.tolist()] == sorted(counts)


def test_exact_copies_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = exact_dedup.find_copies(docs).collect()
    groups = defaultdict(list)
    for doc_id, text in TEXTS:
        groups[text or ""].append(doc_id)
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            expected[i, keep, len(ids), digest] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({d: 1 for _, _, _, d in expected})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns
    assert Counter(r.text or "" for r in stay.collect()) == Counter({t: 1 for t in groups})
    assert exact_dedup.find_copies(docs.limit(0)).count() == exact_dedup.drop_copies(docs.limit(0)).count() == 0


def shingle_sets(texts, words):
    sets = {}
    for key, text in texts.items():
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[key] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return sets


def near_components(texts, words=3, similarity=85):
    sets = shingle_sets(texts, words)
    posted = defaultdict(list)
    for key, found in sets.items():
        for s in found:
            posted[s].append(key)
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for key, found in sets.items():
        for other, shared in Counter(o for s in found for o in posted[s] if o < key).items():
            if 100 * shared >= similarity * (len(found) + len(sets[other]) - shared):
                a, b = root(key), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in texts}


def test_near_copies_of_the_test_table(spark, data):
    expected = near_components(texts_of(spark, data))
    got = queries.op4_near_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_of_a_larger_table(spark):
    """Every component of ten times the rows, with hubs and, in a family of near copies, without."""
    folder = "/root/testdata/sf0.01"
    expected = near_components(texts_of(spark, folder))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dedup(spark, folder).collect()}
    assert got == expected


def test_dense_family_by_hubs_of_first_shingles(spark):
    """Members differ from each other in places of their own; many are under the limit to all others."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(5000)]
    base, texts = list(rng.choice(words, 200)), {}
    for i in range(260):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(0, 14)), replace=False):
            own[at] = f"own{i}x{at}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(6)
    expected = near_components(texts)
    for rounds in (0, 1, 2):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.find_near_copies(docs, rounds=rounds).collect()} == expected


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_parity_sketches_never_differ_more_than_sets(one, two, both):
    a, b = (np.array(sorted(x | both), np.uint64) for x in (one, two))
    apart = int(np.bitwise_count((minhash.parity_sketch(a) ^ minhash.parity_sketch(b)).view(np.uint64)).sum())
    assert apart <= len((one | both) ^ (two | both))


def test_near_copies_in_chains_and_large_groups(spark):
    """Chains link what is not similar itself; two families share a long passage without being similar."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choice(words, 60))
    texts, base = {}, list(rng.choice(words, 120))
    for i in range(40):
        base = list(base)
        base[(i * 3) % 120] = f"changed{i}"
        texts[i] = " ".join(base)
    family = list(rng.choice(words, 150))
    for i in range(40, 140):
        own = list(family)
        for at in rng.integers(0, 150, 2):
            own[at] = f"x{i}{at}"
        texts[i] = " ".join(own)
    for i in range(140, 200):
        texts[i] = passage + " " + " ".join(rng.choice(words, 40 + i % 30))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.find_near_copies(docs).collect()}
    assert got == near_components(texts)
    no_hubs = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.find_near_copies(docs, rounds=0).collect()}
    assert no_hubs == got


def test_near_copies_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = defaultdict(set)
    for r in minhash.find_near_copies(docs).collect():
        got[r.doc_id].add((r.component_id, r.kept))
    assert got[1] == {(1, True)} and got[2] == {(1, False)}
    assert got[4] == {(4, True)} and got[5] == {(5, True)} and got[6] == {(6, True)}
    assert got[8] == {(8, True)} and got[9] == {(8, False)}
    assert got[None] == {(None, True)}
    stay = minhash.drop_near_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(TEXTS) - 3 - (1 if got[11] == {(3, False)} else 0)
    assert minhash.find_near_copies(docs.limit(0)).count() == minhash.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (6, 6)], "a long, b long")
    assert {(r.node, r.least) for r in components(links).collect()} == {(4, 3), (5, 3), (9, 3), (8, 7)}


def removed(texts, window):
    """Per row: bytes, removed, spans, what is left. Windows are compared as they are."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 2])
def test_repeats_of_the_test_table(spark, data, monkeypatch, most):
    monkeypatch.setattr(repeats, "GROUP_STRINGS", most)
    texts = texts_of(spark, data)
    expected = dict(zip(texts, removed(texts.values(), 200)))
    got = queries.op2_repeats(spark, data).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected


def test_repeats_of_odd_rows(spark):
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in TEXTS]
    docs = odd_documents(spark).drop("doc_id", "text").limit(1).crossJoin(spark.createDataFrame(short, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.find_repeats(docs).collect())
    assert got == Counter((i, *row) for (i, _), row in zip(short, removed([t for _, t in short], 200)))
    assert repeats.find_repeats(docs.limit(0)).count() == 0


def steps_of_repeats(docs, monkeypatch):
    """Plans before they ran and rows of the written steps, by label, and the result."""
    plans, rows, write = {}, {}, repeats.written

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        table = write(df, label)
        rows[label] = table.count()
        return table

    monkeypatch.setattr(repeats, "written", watched)
    result = repeats.find_repeats(docs)
    plans["result"] = result._jdf.queryExecution().executedPlan().toString()
    return plans, rows, result


def test_repeats_move_every_anchor_once_a_step(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = "".join(chr(97 + x) for x in rng.integers(0, 26, 6000))
    texts = {i: letters[i * 90 : i * 90 + 900] + f"own {i} " * 40 for i in range(40)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    plans, _, result = steps_of_repeats(docs, monkeypatch)
    assert plans["repeats-strings"].count("Exchange hashpartitioning") == 1 and "Join" not in plans["repeats-strings"]
    for label, key in (("repeats-bytes", "k1"), ("repeats-spans", "h"), ("result", "k1")):
        assert f"SortMergeJoin [{key}#" in plans[label]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result.collect()}
    assert got == dict(zip(texts, removed(texts.values(), 200)))


def test_anchors_of_grams_that_occur_once_are_dropped(spark, monkeypatch):
    """Half the texts come twice: the others' anchors, which have the least hashes of their windows, do not pass."""
    rng = np.random.default_rng(9)
    texts = [bytes(x).decode() for x in rng.integers(97, 123, (1600, 2000)).astype(np.uint8)]
    rows = [*enumerate(texts), *enumerate(texts[:800], 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, rows, result = steps_of_repeats(docs, monkeypatch)
    # Two thirds of all anchors are of texts that come twice.
    assert rows["repeats-grams"] * 2 <= rows["repeats-met"] <= rows["repeats-anchors"] * 0.68
    assert result.filter("n_removed = n_bytes").count() == 1600 and result.filter("n_removed = 0").count() == 800


def test_combined_anchors_are_strings_with_weights(spark):
    rng = np.random.default_rng(10)
    table = rng.integers(-2, 2, (3000, 5))
    anchors = spark.createDataFrame(table.tolist(), "k1 long, k2 long, h long, c long, seen long").repartition(3)
    expected = {}
    for k1, k2, h, c, seen in table.tolist():
        n, rep = expected.get((h, c), (0, (9, 9, 9)))
        expected[h, c] = n + 1, min(rep, (k1, k2, seen))
    got = {}
    for r in anchors.mapInArrow(repeats._combined, repeats._COMBINED).collect():
        n, rep = got.get((r.h, r.c), (0, (9, 9, 9)))
        got[r.h, r.c] = n + r.weight, min(rep, (r.k1, r.k2, r.seen))
    assert got == expected
    assert anchors.limit(0).mapInArrow(repeats._combined, repeats._COMBINED).count() == 0


def test_repeats_across_pieces_of_a_long_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letters = "".join(chr(97 + x) for x in rng.integers(0, 26, 4000))
    texts = {1: letters[:3000] + letters[1000:1400], 2: letters[2500:3300]}
    finder = repeats.AnchorFinder(200, 48)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 500)
    import pyarrow as pa

    seen = Counter()
    for data, ends, number, skipped in repeats._pieces(pa.array(list(texts.values())), 200):
        _, _, text, place, first, last = finder.find(data, ends)
        for t, a, b in zip(text.tolist(), (place + skipped - first).tolist(), (place + skipped - last).tolist()):
            seen.update((t + number, s) for s in range(a, b + 1))
    assert seen == Counter((t, s) for t, text in enumerate(texts.values()) for s in range(len(text) - 199))
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.find_repeats(docs).collect()}
    assert got == dict(zip(texts, removed(texts.values(), 200)))


def test_merged_transforms_find_the_repeated_windows():
    rng = np.random.default_rng(1)
    window, starts = 6, 5
    for trial in range(150):
        n = int(rng.integers(1, 14))
        group = np.sort(rng.integers(0, 3, n))
        first = rng.integers(0, starts, n)
        strings = [rng.integers(97, 99, rng.integers(a, starts) - a + window).astype(np.uint8) for a in first]
        weight = rng.integers(1, 2 + trial % 2, n)
        sizes = np.array([len(s) for s in strings])
        single = Strings.single(group, weight, np.concatenate(strings), np.cumsum(sizes) - sizes, sizes, first, window + starts - 1)
        shard = np.cumsum(np.r_[0, (np.diff(group) != 0) | (rng.random(n - 1) < 0.4)]).astype(int)
        shards = []
        for s in range(shard[-1] + 1):
            own = np.flatnonzero(shard == s)
            shards.append(merge(Strings(group[own], np.arange(len(own)), weight[own], single.columns[:, own]), window, starts)[0])
        _, repeated = merge(Strings(group, shard, weight, np.concatenate(shards, axis=1)), window, starts)
        seen = Counter()
        for g, a, s, w in zip(group, first, strings, weight):
            for i in range(len(s) - window + 1):
                seen[g, a + i, s[i : i + window].tobytes()] += w
        for k, (g, a, s) in enumerate(zip(group, first, strings)):
            for i in range(len(s) - window + 1):
                assert repeated[k, a + i] == (seen[g, a + i, s[i : i + window].tobytes()] > 1)
