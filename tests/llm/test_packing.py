"""Packed pieces against the tokenizer file itself, and cuts against plain dynamic programming."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from ledgerlake.llm import packing, queries
from ledgerlake.llm.tokens import TextEncoder, load_encoding

ROOM = packing.ROOM


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(rows, texts, tokenizer):
    """Whole texts come back, sequences are gapless and short enough; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array(ids_of(tokenizer, texts[doc_id]), "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= ROOM
        padding += 0 if at & (at - 1) == 0 else ROOM - at
    return padding / max(1, sum(r.length for r in rows))


def test_query_over_the_test_table(spark, data, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert check_pieces(queries.op9_packing(spark, data).collect(), texts, tokenizer) < 0.02


def test_odd_rows(spark, tokenizer):
    texts = {1: None, 2: "", 3: " ", 4: "a  b\n c \t", 5: "x" * 30_000, 6: "Word. " * 20_000, 7: "<|endoftext|> é ü 東京"}
    rows = spark.createDataFrame([Row(doc_id=k, text=v, length="clash", ids=[1]) for k, v in texts.items()], "doc_id long, text string, length string, ids array<int>")
    check_pieces(packing.pack_documents(rows).collect(), texts, tokenizer)
    assert packing.pack_documents(rows.limit(0)).count() == 0
    twice = packing.pack_documents(rows.unionByName(rows)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in twice} == {k: 2 * len(ids_of(tokenizer, v)) for k, v in texts.items()}


def test_pieces_between_spaces_give_the_ids_of_whole_texts(tokenizer):
    encoder = TextEncoder(load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), most_pieces=3)
    texts = ["a b", " a", "a ", "", "a\n b", "a\tb c", "don't 12 3.4 x's", "a  b", "no-break here it is", "a\r\n\r\n b"]
    for _ in range(2):
        assert [list(x) for x in encoder.encode(texts)] == [ids_of(tokenizer, t)[:-1] for t in texts]


def plain_cost(places, cost, room):
    f = [0]
    for j in range(1, len(places)):
        f.append(
            cost[j]
            + min(
                f[i] + (0 if (d := places[j] - places[i]) & (d - 1) == 0 else room - d)
                for i in range(j)
                if places[j] - places[i] <= room
            )
        )
    return f[-1]


def test_cuts_cost_no_more_than_plain_dynamic_programming():
    rng = np.random.default_rng(9)
    lanes, room = [], 64
    for _ in range(40):
        places = np.r_[0, np.cumsum(rng.integers(1, 30, rng.integers(1, 60)))]
        lanes.append((places, rng.choice([0, 4, 64], len(places))))
    for (places, cost), cuts in zip(lanes, packing.best_cuts(lanes, room)):
        price = dict(zip(places.tolist(), cost.tolist()))
        sizes = np.diff(np.r_[0, cuts])
        assert cuts[-1] == places[-1] and (sizes <= room).all()
        paid = sum(price[c] for c in cuts.tolist()) + sum(0 if d & (d - 1) == 0 else room - d for d in sizes.tolist())
        assert paid == plain_cost(places.tolist(), cost.tolist(), room)


def test_a_long_lane_does_not_stretch_the_others():
    """Tables hold a few times the places there are; and every lane has the cuts that it has alone."""
    import tracemalloc

    rng = np.random.default_rng(9)

    def lane(n):
        places = np.r_[0, np.cumsum(rng.integers(1, 40, n))]
        return places, np.r_[0, rng.choice([0, packing.SENTENCE_CUT], n - 1), 0].astype(np.int64)

    lanes = [lane(300) for _ in range(60)] + [lane(20_000)] + [lane(7) for _ in range(30)]
    tracemalloc.start()
    together = packing.best_cuts(lanes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    for one, cuts in zip(lanes, together):
        assert packing.best_cuts([one])[0].tolist() == cuts.tolist()
