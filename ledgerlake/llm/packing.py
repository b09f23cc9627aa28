"""Packing token streams into sequences by order-preserving dynamic programming.

Documents keep their order and stand in lanes: runs of consecutive documents of
one input partition. Within a lane the stream of ids is cut into windows of at
most ``room`` ids. A cut behind a document costs nothing, one behind a sentence
costs ``SENTENCE_CUT`` and any other ``HARD_CUT``; a window costs its padding up
to ``room``, or nothing when its length is a power of two. With x the place of a
cut and f its least cost,

    f(j) = cut(j) + min( min over x(j) - x(i) <= room of f(i) + x(i)  + room - x(j),
                         min over powers of two p of f(i) where x(j) - x(i) = p )

The first minimum slides with j and is kept in a monotone queue; lanes of a
block take each step together, as columns of arrays.

A task holds one block of lanes, whatever the partition's size; nothing is
shuffled. A lane's last window may be padded, which is less than one in sixty.

Defined results: a null or empty text is its closing id alone; a document
longer than a lane is a lane; repeated rows and ids are packed like any others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerlake.llm.tables import named, text_of
from ledgerlake.llm.tokens import TextEncoder, load_encoding

ROOM = 1024
END_ID = 0
SENTENCE_CUT = 4
HARD_CUT = 64
#: Ids after which a lane is closed, and lanes of a block.
LANE_IDS = 1 << 16
BLOCK_LANES = 96
#: Where a sentence is longer, cuts are also allowed every so many ids.
HARD_STEP = 128

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (ids before the cut) where a lane may be cut, 0 and its end included, and what each costs."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[1:][ends_sentence[ids]] = SENTENCE_CUT
    cost[0] = 0
    cost[doc_ends] = 0
    soft = np.flatnonzero(cost >= 0)
    gaps = np.diff(soft)
    for at, gap in zip(soft[:-1][gaps > HARD_STEP], gaps[gaps > HARD_STEP]):
        cost[at + HARD_STEP : at + gap : HARD_STEP] = HARD_CUT
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def _alike(lengths: list[int]) -> list[int]:
    """Where to part lengths that fall, so that no part takes over four times its places when all are as long as its first."""
    ends, begin = [], 0
    while begin < len(lengths):
        end = begin + 1
        total = lengths[begin]
        while end < len(lengths) and lengths[begin] * (end - begin + 1) <= 4 * (total + lengths[end]):
            total += lengths[end]
            end += 1
        ends.append(end)
        begin = end
    return ends


def best_cuts(lanes: list[tuple[np.ndarray, np.ndarray]], room: int = ROOM) -> list[np.ndarray]:
    """Least-cost cut places of every lane, from its candidate places and their costs.

    Lanes of like length are solved together, so that one of a very long text
    does not stretch the tables of all.
    """
    order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i][0]))
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lanes)
    begin = 0
    for end in _alike([len(lanes[i][0]) for i in order]):
        for lane, cuts in zip(order[begin:end], _cuts_together([lanes[i] for i in order[begin:end]], room)):
            found[lane] = cuts
        begin = end
    return found


def _cuts_together(lanes: list[tuple[np.ndarray, np.ndarray]], room: int) -> list[np.ndarray]:
    """The longest lane comes first, so that those still running are always the first ones."""
    order = range(len(lanes))
    running = np.array([len(lanes[i][0]) for i in order])
    n, steps = len(lanes), int(running[0])
    far = np.iinfo(np.int64).max // 4
    x = np.full((steps, n), far, np.int64)
    cut = np.zeros((steps, n), np.int64)
    powers = 1 << np.arange(room.bit_length())
    powers = powers[powers <= room]
    # Step before by a power of two, or the row behind the last, which stands for none.
    jump = np.full((steps, len(powers), n), steps, np.int32)
    for column, lane in enumerate(order):
        places, cost = lanes[lane]
        x[: len(places), column], cut[: len(places), column] = places, cost
        back = places[:, None] - powers
        at = np.searchsorted(places, back)
        hit = (back >= 0) & (places[np.minimum(at, len(places) - 1)] == back)
        jump[: len(places), :, column] = np.where(hit, at, steps)
    f = np.full((steps + 1, n), far, np.int64)
    f[0] = 0
    came = np.zeros((steps, n), np.int32)
    queue = np.zeros((steps, n), np.int32)  # steps by rising f + x; the first in reach is the least
    keys = np.zeros((steps, n), np.int64)
    head, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
    columns = np.arange(n)
    for j in range(1, steps):
        k = int(np.searchsorted(-running, -j))  # lanes longer than j
        own, h, t = columns[:k], head[:k], tail[:k]
        key, here = f[j - 1, :k] + x[j - 1, :k], x[j, :k]
        while (worse := (t > h) & (keys[np.maximum(t - 1, 0), own] >= key)).any():
            t -= worse
        keys[t, own], queue[t, own] = key, j - 1
        t += 1
        while (out := x[queue[h, own], own] < here - room).any():
            h += out
        back = jump[j, :, :k]
        offers = f[back, own]
        least = offers.argmin(axis=0)
        offer, padded = offers[least, own], keys[h, own] + room - here
        better = offer < padded
        f[j, :k] = np.where(better, offer, padded) + cut[j, :k]
        came[j, :k] = np.where(better, back[least, own], queue[h, own])
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for column, lane in enumerate(order):
        places, path, j = lanes[lane][0], [], len(lanes[lane][0]) - 1
        while j > 0:
            path.append(j)
            j = int(came[j, column])
        found[lane] = places[path[::-1]]
    return found


class _Lane:
    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.parts.append(np.append(ids, np.uint32(END_ID)))
        self.size += len(ids) + 1


def _packed(lanes: list[_Lane], ends_sentence: np.ndarray, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    streams = [np.concatenate(lane.parts).astype("<u4", copy=False) for lane in lanes]
    ends = [np.cumsum([len(p) for p in lane.parts]) for lane in lanes]
    cuts = best_cuts([candidate_cuts(s, e, ends_sentence) for s, e in zip(streams, ends)])
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    doc_ids: list[int | None] = []
    for lane, stream, doc_ends, windows in zip(lanes, streams, ends, cuts):
        stops = np.union1d(doc_ends, windows)
        starts = np.r_[0, stops[:-1]]
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(windows, starts, side="right")
        doc_start = np.r_[0, doc_ends[:-1]][doc]
        data = memoryview(stream).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        doc_ids += [lane.doc_ids[d] for d in doc.tolist()]
        for held, values in zip(
            columns,
            (starts - doc_start, stops - starts, np.array(crc, np.int64), doc_ends[doc] - doc_start, first_sequence + window, starts - np.r_[0, windows[:-1]][window]),
        ):
            held.append(values)
        first_sequence += len(windows)
    arrays = [pa.array(doc_ids, pa.int64()), *(pa.array(np.concatenate(held).astype(np.int64)) for held in columns)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECES.split(", ")]), first_sequence


def _packer(vocabulary: str, pattern: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary, pattern)
        encoder = TextEncoder(encoding)
        closing = (b".", b"!", b"?", b"\n")
        ends_sentence = np.array([encoding.decode_single_token_bytes(i).endswith(closing) for i in range(encoding.max_token_value + 1)])
        sequence = TaskContext.get().partitionId() << 33
        lanes, lane = [], _Lane()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    lane.add(doc_id, ids)
                    if lane.size >= LANE_IDS:
                        lanes.append(lane)
                        lane = _Lane()
                    if len(lanes) == BLOCK_LANES:
                        out, sequence = _packed(lanes, ends_sentence, sequence)
                        yield out
                        lanes = []
        if lane.size:
            lanes.append(lane)
        if lanes:
            yield _packed(lanes, ends_sentence, sequence)[0]

    return pack


def pack_documents(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(_packer(path, public_tokenizers.PATTERN), PIECES)
