"""Resharding, licences, mixing, quality, chat and the pipeline."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import differences
from hypothesis import given, settings, strategies as st
from odd import LONG, TEXTS, odd_documents
from pyspark.sql import functions as F
from test_duplicates import near_components
from test_packing import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlake.llm import chat, licenses, mixing, packing, quality_model, quality_rules, queries, resharding
from ledgerlake.llm.flow import cheapest_transfers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Resharding.


def test_flow_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = rng.integers(1, 4, 2)
        supply = rng.integers(0, 4, n).tolist()
        room = rng.integers(0, 5, m).tolist()
        cost = rng.integers(0, 5, (n, m))
        if sum(supply) > sum(room):
            with pytest.raises(ValueError):
                cheapest_transfers(supply, room, lambda i, j: int(cost[i, j]))
            continue
        got = cheapest_transfers(supply, room, lambda i, j: int(cost[i, j]))
        assert [sum(v for (i, _), v in got.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in got.items() if j == k) <= room[k] for k in range(m))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        prices = [
            sum(int(cost[i, j]) for i, j in zip(units, choice))
            for choice in product(range(m), repeat=len(units))
            if all(choice.count(j) <= room[j] for j in range(m))
        ] if len(units) <= 6 else None
        if prices is not None:
            assert sum(int(cost[i, j]) * v for (i, j), v in got.items()) == min(prices)


def test_shards_are_even_and_whole(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op3_resharding(spark, data).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id]].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) < max(r.size for r in rows)


def test_blocks_move_no_more_than_the_flow_asks_for():
    sizes = [((0, b, None), 0, 10) for b in range(30)] + [((1, b, None), 1, 10) for b in range(10)] + [((2, b, None), 2, 10) for b in range(20)]
    shard_of, moved = resharding.choose_blocks(sizes, 3)
    assert moved == {(0, 1): 100} and Counter(shard_of.values()) == {0: 20, 1: 20, 2: 20}
    assert resharding.capacities(100, [70, 10], 3) == [70, 15, 15]
    assert resharding.capacities(0, [], 3) == [0, 0, 0]


def test_odd_rows_are_sharded(spark):
    docs = odd_documents(spark)
    rows = resharding.place(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 8) for i, t in TEXTS)
    assert resharding.place(docs.limit(0)).count() == 0


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    texts = ["x" * (10 if i % 5 else 4000) + str(i) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = str(tmp_path / "shards")
    resharding.write_old(docs, path, shards=6)
    files = lambda: {s: set(os.listdir(f"{path}/shard={s}")) for s in range(6)}
    before = files()
    layout = resharding.rewrite(docs, path, shards=6)
    after = files()
    assert layout.affected and all((before[s] == after[s]) == (s not in layout.affected) for s in range(6))
    back = spark.read.parquet(path)
    assert sorted(r.text for r in back.collect()) == sorted(texts)
    loads = [r[0] for r in back.groupBy("shard").agg(F.sum(F.length("text") + 8)).select("sum((length(text) + 8))").collect()]
    assert max(loads) - min(loads) < 4011  # the largest text


def test_shard_files_of_documents_with_a_shard_column(spark, tmp_path):
    docs = odd_documents(spark).withColumn("SHARD_2", F.lit("mine")).withColumnRenamed("n_chars", "old_shard")
    path = str(tmp_path / "files")
    resharding.write_old(docs, path, shards=4)
    resharding.rewrite(docs, path, shards=4)
    read = spark.read.parquet(path)
    assert resharding.folder_column(docs) == "shard_3" and set(read.columns) == {*docs.columns, "shard_3"}
    key = lambda r: (r.doc_id, r.text, r.shard, r.SHARD_2, r.old_shard)
    assert Counter(map(key, read.collect())) == Counter(map(key, docs.collect()))


def test_long_conversations(spark):
    """Thousands of turns, some of them hard, come back under the mask."""
    n = 3000
    rows = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("\U0001f600 é </turn>\n### assistant: "), F.col("id").cast("string")).alias("text"),
    )
    formatted = chat.format_conversations(rows)
    (row,) = chat.under_mask(formatted).collect()
    said = [f"\U0001f600 é </turn>\n### assistant: {i}" for i in range(0, n, 3)]
    assert row.masked == said and len(row.turns) == n
    assert [chat_unescaped(row.formatted[m.start : m.start + m.length]) for m in row.mask] == said


def chat_unescaped(text):
    return text.replace("\\e", "</turn>").replace("\\h", "###").replace("\\b", "\\")


# Licences.


def test_licences_in_odd_places(spark):
    texts = {
        1: "Released under the MIT License, not the mit-licence. CC BY-NC 4.0 too",
        2: "GNU   General\nPublic License; gnu general public licenses. The GNU General Public License",
        3: "Permission is hereby granted, free of charge, to any PERSON who is obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction",
        4: None,
        5: "apache",
        6: "Apache LICENSE " * 3,
        7: LONG + " the Apache License, Version 2.0",
    }
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "words", "gram", "place", "template", "at")})
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 3, 9, "cc-by,mit")
    assert got[1].labels == "cc-by,cc-by-nc,mit" and got[1].score == 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (2, 0, 9, "gpl")
    assert got[3].n_base == 0 and got[3].labels == "mit" and 0.8 <= got[3].score < 1
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0)
    assert (got[5].n_words, got[5].labels) == (1, "")
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (3, 0, 4)
    assert got[7].labels == "apache,apache-2.0" and got[7].n_words > 100_000
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs.unionByName(docs)).count() == 2 * len(texts)


def test_licence_versions_are_told_apart(spark):
    texts = {
        1: "under the GNU General Public License version 2 only",
        2: "under the GNU General Public License, Version 3.",
        3: "under the GNU General Public License version",
        4: "under the GNU General Public License (GPL) version 3",
        5: "GNU General Public License version 2 or version 3",
        6: "Apache License, Version 2.0",
    }
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: "gpl,gpl-2", 2: "gpl,gpl-3", 3: "gpl", 4: "gpl,gpl-3", 5: "gpl,gpl-2,gpl-3", 6: "apache,apache-2.0"}


_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU {0}General Public License as published by the Free Software Foundation, {1}. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY. See the GNU {0}General Public License for more details."""
_CC = 'This work is licensed under a <a href="x">Creative Commons Attribution{} 4.0 International License</a>.'


def test_notices_have_no_strangers_label(spark):
    later = "either version {} of the License, or (at your option) any later version"
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit-text").text
    bsd = next(t for t in licenses.TEMPLATES if t.label == "bsd-text").text
    three = next(t for t in licenses.TEMPLATES if t.label == "bsd-3").text
    isc, zlib = (next(t for t in licenses.TEMPLATES if t.label == label).text for label in ("isc-text", "zlib-text"))
    expected = {
        _NOTICE.format("", later.format(3)): "gpl,gpl-3",
        _NOTICE.format("", later.format(2)): "gpl,gpl-2",
        _NOTICE.format("", "version unknown"): "gpl",
        _NOTICE.format("Lesser ", later.format("2.1")): "lgpl",
        _NOTICE.format("Lesser ", later.format(3)): "lgpl",
        _NOTICE.format("Affero ", later.format(3)): "agpl",
        _CC.format(""): "cc-by",
        _CC.format("-ShareAlike"): "cc-by-sa",
        _CC.format("-NonCommercial"): "cc-by-nc",
        _CC.format("-NoDerivatives"): "cc-by-nd",
        _CC.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        _CC.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        "Copyright (c) 2020 Someone\n\n" + mit.replace(" the ", "\nthe ", 9): "mit,mit-text",
        mit.replace("merge", "mix").replace("sublicense", "sub license"): "mit",
        bsd: "bsd,bsd-text",
        bsd + " 3. " + three: "bsd,bsd-3,bsd-text",
        "ISC License. " + isc: "isc-text",
        zlib: "zlib-text",
        "the software of the authors is provided to the public under the license of the software " * 20: "",
    }
    docs = spark.createDataFrame([*enumerate(expected)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert got == dict(enumerate(expected.values()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(expected)])
    assert {r[0]: r[6] for r in con.execute(licenses.sql()).fetchall()} == got


def test_templates_of_more_than_64_positions(spark):
    def words(n):
        return " ".join(f"w{i}x" for i in range(n))

    templates = [licenses.Template(f"t{n}", words(n)) for n in (65, 66, 170)] + [licenses.Template("base", words(170), base=True)]
    texts = {1: words(170), 2: words(138), 3: words(136), 4: words(65), 5: words(100) + " and more " + words(170).split(" ", 100)[100]}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_base) for r in licenses.scan_licenses(docs, templates).collect()}
    every = "t170,t65,t66"
    assert got == {1: (f"base,{every}", 1), 2: (every, 0), 3: ("t65,t66", 0), 4: ("t65,t66", 0), 5: (every, 0)}


# Mixing.


def test_the_mixture_is_what_was_planned(spark):
    docs = odd_documents(spark)
    plan = mixing.plan_mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((i, len(WORD.findall(t or ""))) for i, t in TEXTS)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    planned = Counter()
    for r in plan:
        planned[r.doc_id] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert words == Counter({k: n for k, n in planned.items() if n})
    by_source = defaultdict(int)
    target = {}
    for r in plan:
        by_source[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(by_source[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(r.size for r in plan))
    assert mixing.plan_mix(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(3)).collect()))


def test_water_fills_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 1665 words for weights 5, 2, 1, 5: a and b end at twice their size, null has none, c takes the rest.
    assert got == {"a": 200.0, "b": 20.0, "c": 1445.0, None: 0.0}


def test_a_target_just_below_a_whole_repetition(spark):
    sizes = {"a": 294, "b": 31, "c": 324}
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    got = {r.source: (r.target, r.taken) for r in mixing.plan_mix(docs).collect()}
    assert got == {"a": (588.0, 588), "b": (62.0, 62), "c": (323.5, 324)}
    assert Counter(r.source for r in mixing.mix(docs).collect()) == {"a": 2, "b": 2, "c": 1}
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', repeat('w ', {n}))" for i, (s, n) in enumerate(sizes.items())) + ") AS v(doc_id, source, text)")
    assert differences(mixing.plan_mix(docs), con, queries.all_sql()["op6_source_mix"]) == ""


# Quality.


def test_rules_on_odd_rows(spark):
    docs = odd_documents(spark)
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(TEXTS)
    for r in judged:
        if r.doc_id in (4, 5, 6, None) and r.n_words == 0:
            assert r.base_failed and not r.kept and r.word_chars == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert {r.doc_id for r in judged if r.kept} >= {1, 2, 3, 11}
    assert quality_rules.judge(docs.limit(0)).count() == quality_rules.keep_good(docs.limit(0)).count() == 0


def test_cascade_is_the_same_however_the_table_is_partitioned(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    orders = {tuple(r.name for r in quality_rules.plan_cascade(docs.repartition(n), sample_rows=100)) for n in (1, 3, 8)}
    assert len(orders) == 1


def test_cascade_looks_at_the_rows_that_are_left(spark):
    """Of two rules that reject the same rows the second has nothing left to reject; shared counts are paid once."""
    docs = spark.createDataFrame([("a " * n + "# " * (n % 3),) for n in range(60)], "text string")
    rules = [quality_rules.Rule(name, rejects) for name, rejects in (
        ("windows", "n_repeat_words >= 0 AND n_words < 40"), ("few", "n_words < 40"), ("symbols", "n_symbols > 1"), ("many", "n_words > 58"),
    )]
    assert [r.name for r in quality_rules.plan_cascade(docs, rules)] == ["symbols", "few", "many", "windows"]


def test_cascade_puts_the_rule_that_pays_first(spark):
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(50)], "doc_id long, text string")
    never = quality_rules.Rule("never", "n_words < 0")
    always = quality_rules.Rule("always", "n_words > 10")
    assert [r.name for r in quality_rules.plan_cascade(docs, [never, always])] == ["always", "never"]


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.op7_quality_model(spark, folder).select("doc_id", "kept")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aAbZ \n\t.!?|#$&<é9-", max_size=40), min_size=1, max_size=6))
def test_facts_against_plain_python(texts):
    data = [t.encode() for t in texts]
    found = quality_model.Shapes(64).facts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    for i, text in enumerate(data):
        words = text.lower().split()
        plain = {
            "words": len(words),
            "letters": sum(chr(c).isascii() and chr(c).isalpha() for c in text),
            "capitals": sum(65 <= c <= 90 for c in text),
            "symbols": sum(c in b"#*$%&|<>" for c in text),
            "same": sum(a == b for a, b in zip(words, words[1:])),
            "distinct": len(set(words)),
            "enders": sum(c in b".!?" for c in text),
            "bars": text.count(b"|"),
            "marks": text.count(b"!"),
        }
        assert {name: int(values[i]) for name, values in found.items()} == plain


def test_classifier_on_odd_rows(spark):
    docs = odd_documents(spark)
    rows = quality_model.classify(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows)
    assert quality_model.classify(docs.limit(0)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    rates = [0.9, 0.8, 0.7, 0.85]
    counts = Counter(
        "".join("-" if rng.random() < 0.3 else ("g" if (rng.random() < a) == t else "b") for a in rates) for t in truth.tolist()
    )
    model = quality_model.fit_label_model(counts)
    assert abs(model.share_good - 0.7) < 0.03
    assert np.allclose(model.accuracies, rates, atol=0.03)


# Chat.


def test_hard_texts_survive_formatting(spark):
    hard = ["", None, "\\", "\\b", "\\h\\e", "###", "</turn>", " </turn>\n### user: hi", "a: b", "\n", "### user: </turn>\n\\b", "é 東京", LONG]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)]
    rows += [(2, 0, "odd: role", "x"), (2, 1, None, "y"), (2, 2, "### r", "z"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "shown", "plain", "source", "mask")})
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    for conv in (1, 2, 3, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        spans = [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].mask]
        assert len(spans) == sum(role == "assistant" for role, _ in own)
        assert all("###" not in s and "</turn>" not in s for s in spans)
    digests = {r.conv_id: r for r in chat.digest(chat.format_conversations(table)).collect()}
    said = "".join(f"{role}\n{text}\n" for role, text in [(r[2] or "", r[3] or "") for r in rows if r[0] == 1])
    lost = "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert digests[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (digests[1].loss_chars, digests[1].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat.format_conversations(table.limit(0)).count() == 0


# The pipeline.


def test_pipeline_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    judged = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, data).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    expected = {i: r for i, r in rows.items() if judged[i]}
    best = {}
    for i, r in expected.items():
        best[r.text or ""] = max(i, best.get(r.text or "", i))
    expected = {i: rows[i] for i in best.values()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, data)
    single = stages["exact_dedup"](spark, good, data)
    assert single.columns == docs.columns
    assert {r.doc_id: r for r in single.collect()} == expected

    linked = near_components({i: r.text for i, r in expected.items()}, words=5, similarity=80)
    apart = stages["near_dedup"](spark, single, data)
    expected = {i: r for i, r in expected.items() if linked[i][1] == i}
    assert {r.doc_id: r for r in apart.collect()} == expected

    mixed = stages["source_mix"](spark, apart, data)
    assert mixed.columns == docs.columns
    taken, sizes = Counter(), Counter()
    mixed_rows = mixed.collect()
    for r in mixed_rows:
        taken[r.source] += len(WORD.findall(r.text))
        assert expected[r.doc_id].text.startswith(r.text) or expected[r.doc_id].text.strip().startswith(r.text.strip())
    for r in expected.values():
        sizes[r.source] += len(WORD.findall(r.text))
    targets = {r.source: r.target for r in mixing.plan_mix(apart).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - t) <= 1 and t <= 2 * sizes[s] for s, t in targets.items())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    numbered = mixed.withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r.doc_id: r.text for r in numbered.collect()}
    assert check_pieces(packing.pack_documents(numbered).collect(), texts, tokenizer) < 0.05
    total = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert corpus_pipeline.run(spark, data).agg(F.sum("length")).first()[0] == total
