"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

A 200-byte window is repeated when the same bytes start anywhere else. To find
all of them without one order over all suffixes:

1. *Anchors.* The anchor of a window is its gram of ``GRAM`` bytes with the least
   hash (the leftmost of equals), which depends on the window's bytes alone.
   Equal windows have equal anchors at equal offsets. Neighbouring windows with
   one anchor form a string; strings with equal grams form a group. A group that
   weighs one holds no repeat and goes no further.
2. *Collapse.* Equal strings of a group are one string with a weight. A group
   that is one string of weight two or more is repeated throughout.
3. *Shards.* Each task turns the other strings it holds into transforms, one per
   group and shard (``transforms.py``); shards of a group are merged by
   interleave refinement, which yields the shared prefixes and so the repeated
   windows.
4. *Hot groups.* A group of more than ``GROUP_STRINGS`` distinct strings is split
   by where its windows start relative to the anchor; the bytes that all windows
   of a half share become the key of the smaller group. Equal halves collapse
   again, and at one start per group nothing is left to differ, so every group
   ends small, whatever a third of all documents share.
5. Repeated windows become spans of their documents, and their bytes are removed.

Disk: anchors whose gram certainly occurs once are dropped before strings are
made of the rest. No step moves a row of anchors more than once, and the
shuffles of a step are freed before the next, so that what lies on disk at any
time stays in proportion to the input even where the sketch is full.

Strings are told apart by 128 bits of hash when they are collapsed; windows of
strings that differ are compared by their bytes.

Defined results: a null text is empty; documents shorter than a window lose
nothing unless a longer repeat covers them, which none can; repeated rows are
documents of their own, so each makes the other's windows repeated; an empty
table gives an empty result; other columns are ignored. What is left is bytes: a
cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.shingles import texts_in_chunks
from ledgerlake.llm.sketch import passes_sketch
from ledgerlake.llm.tables import discard, named, sweep, text_of, written
from ledgerlake.llm.transforms import PAD, Strings, merge

WINDOW = 200
GRAM = 48
#: Distinct strings of a group beyond which it is split.
GROUP_STRINGS = 256
#: Strings that a task merges at a time.
BLOCK_STRINGS = 16384
#: A text is read in pieces of so many bytes, which overlap by a window.
PIECE_BYTES = 3 << 20
SKETCH_BITS = 24

_U = np.uint64
_PLACE_BITS = 22


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class AnchorFinder:
    """Strings of windows with one anchor: gram hash, content hash, place of the anchor, offsets of the windows."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        rng = np.random.default_rng(2)
        self._values = rng.integers(1, 2**64, 256, dtype=_U)
        base = int(rng.integers(1, 2**63, dtype=_U)) * 2 + 1
        self._base, self._inverse = _U(base), _U(pow(base, -1, 2**64))
        self._powers = self._inverses = np.ones(1, _U)

    def _powers_to(self, n: int) -> None:
        if len(self._powers) < n:
            self._powers = np.cumprod(np.r_[_U(1), np.full(n - 1, self._base)])
            self._inverses = np.cumprod(np.r_[_U(1), np.full(n - 1, self._inverse)])

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(h, c, text, place, first, last) by string; windows start from ``place - first`` to ``place - last`` of text."""
        n, window, gram = len(data), self.window, self.gram
        if n < window:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        self._powers_to(n + 1)
        sums = np.r_[_U(0), np.cumsum(self._values[data] * self._powers[:n])]
        grams = _mixed((sums[gram:] - sums[:-gram]) * self._inverses[: n - gram + 1])
        # Least of all grams in a window: minima over spans that double, the place in the low bits.
        place_mask = _U((1 << _PLACE_BITS) - 1)
        least = (grams & ~place_mask) | np.arange(len(grams), dtype=_U)
        span, wide = 1, window - gram + 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        anchor = (least & place_mask).astype(np.int64)
        starts_text = np.r_[0, ends[:-1]]
        crossing = np.zeros(len(anchor) + 1, np.int32)
        np.add.at(crossing, np.minimum(np.maximum(ends - window + 1, starts_text), len(anchor)), 1)
        np.add.at(crossing, np.minimum(ends, len(anchor)), -1)
        inside = np.cumsum(crossing[:-1]) == 0
        other = np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1], True]
        first = np.flatnonzero(inside & other[:-1])
        last = np.flatnonzero(inside & (other[1:] | ~np.r_[inside[1:], False]))
        text = np.searchsorted(ends, first, side="right")
        place = anchor[first]
        content = _mixed((sums[last + window] - sums[first]) * self._inverses[first] + (last - first).astype(_U))
        begin = starts_text[text]
        return grams[place].view(np.int64), content.view(np.int64), text, place - begin, place - first, place - last


def _pieces(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, ends, number of the first text, and how many bytes of it were left out; long texts overlap by a window."""
    number = 0
    for data, ends in texts_in_chunks(column):
        if len(data) <= PIECE_BYTES + window or len(ends) > 1:
            yield data, ends, number, 0
        else:
            for start in range(0, len(data) - window + 1, PIECE_BYTES):
                piece = data[start : start + PIECE_BYTES + window - 1]
                yield piece, np.array([len(piece)]), number, start
        number += len(ends)


_ANCHORS = "k1 long, k2 long, h long, c long, seen long"
#: ``seen`` holds the anchor's place and the first and last offsets of its windows, which need so many bits each.
_OFFSET_BITS = 12


def _unpacked(seen: Column) -> dict[str, Column]:
    mask = F.lit((1 << _OFFSET_BITS) - 1)
    return {
        "place": F.shiftright(seen, 2 * _OFFSET_BITS),
        "first": F.shiftright(seen, _OFFSET_BITS).bitwiseAND(mask).cast("int"),
        "last": seen.bitwiseAND(mask).cast("int"),
    }


def _anchors(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(window, gram)
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, ends, number, skipped in _pieces(batch.column(2), window):
                h, c, text, place, first, last = finder.find(data, ends)
                text = text + number
                seen = ((place + skipped) << (2 * _OFFSET_BITS)) | (first << _OFFSET_BITS) | last
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[text], k2[text], h, c, seen)], ["k1", "k2", "h", "c", "seen"])

    return find


_SHARD = "h long, c array<long>, first array<int>, last array<int>, weight array<long>, columns binary"


def _shards(window: int, gram: int):
    """Strings (h, c, first, last, weight, bytes) to transforms of each group's strings that came together."""
    starts = window - gram + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, first, last, weight = (batch.column(i).to_numpy() for i in range(5))
            order = np.argsort(h, kind="stable")
            text = batch.column(5).cast(pa.large_binary()).take(pa.array(order))
            _, offsets, data = text.buffers()
            at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            h, c, first, last, weight = h[order], c[order], first[order], last[order], weight[order]
            single = Strings.single(h, weight, np.frombuffer(data, np.uint8), at[:-1], np.diff(at), starts - 1 - first, window + starts - 1)
            merged, _ = merge(single, window, 0)
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            stops = np.r_[cuts[1:], len(h)]

            def lists(values: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(h)].astype(np.int32)), pa.array(values))

            blobs = pa.array([np.ascontiguousarray(merged[:, a:b]).tobytes() for a, b in zip(cuts, stops)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[cuts]), lists(c), lists(first), lists(last), lists(weight), blobs], ["h", "c", "first", "last", "weight", "columns"]
            )

    return build


_REPEATED = "h long, c long, lo int, hi int"


def _merge_shards(window: int, gram: int):
    """Shards in order of their group to the offsets (lo to hi) of repeated windows, by string."""
    starts = window - gram + 1
    width = window + starts - 1

    def merged(rows: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([np.full(len(r[1]), r[0]) for r in rows])
        c, first, last, weight = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
        shard = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        columns = np.concatenate([np.frombuffer(r[5], np.uint8).reshape(width, len(r[1])) for r in rows], axis=1)
        _, repeated = merge(Strings(h, shard, weight, columns), window, starts)
        offset = starts - 1 - np.arange(starts)
        repeated &= (offset <= first[:, None]) & (offset >= last[:, None])
        edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        string, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        arrays = [h[string], c[string], (starts - 1 - end).astype(np.int32), (starts - 1 - begin).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["h", "c", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = [batch.column(i) for i in range(1, 5)]
            for i, h in enumerate(batch.column(0).to_pylist()):
                row = (h, *(x[i].values.to_numpy() for x in lists), batch.column(5)[i].as_buffer())
                if held and held[-1][0] != h and size >= BLOCK_STRINGS:
                    yield merged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield merged(held)

    return run


def _keys(doc_id: Column, text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(2), doc_id, text)}


_COMBINED = "h long, c long, weight long, k1 long, k2 long, seen long"


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors to one row per string of a batch, with its weight and the least place it was seen at."""
    names = ["h", "c", "k1", "k2", "seen"]
    for batch in batches:
        h, c, k1, k2, seen = (batch.column(name).to_numpy() for name in names)
        order = np.lexsort((seen, k2, k1, c, h))
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)])
        weight, order = np.diff(np.r_[first, len(h)]), order[first]
        columns = [h[first], c[first], weight, k1[order], k2[order], seen[order]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "c", "weight", "k1", "k2", "seen"])


def _groups(strings: DataFrame) -> DataFrame:
    """Adds to (h, c, weight, ...) how many strings the group has and what they weigh; groups that weigh one are left out."""
    group = Window.partitionBy("h")
    sized = strings.withColumns({"strings": F.count(F.lit(1)).over(group), "weighs": F.sum("weight").over(group)})
    return sized.filter("weighs > 1")


def _halves(strings: DataFrame, window: int) -> DataFrame:
    """Each string cut for the two halves of its group's offsets (klo to khi); ``ph`` and ``pc`` name the string."""
    middle = F.floor((F.col("klo") + F.col("khi") + 1) / 2).cast("int")

    def half(lo: Column, hi: Column) -> Column:
        first, last = F.least("first", hi), F.greatest("last", lo)
        part = F.substring("bytes", F.col("first") - first + 1, F.lit(window) + first - last)
        # What every window from lo to hi covers: from the anchor less lo to the anchor less hi plus a window.
        shared = F.substring("bytes", F.col("first") - lo + 1, F.lit(window) - hi + lo)
        return F.when(
            first >= last,
            F.struct(
                F.xxhash64(F.col("h"), lo, hi, shared).alias("h"),
                F.xxhash64(first, last, part).alias("c"),
                F.col("weight").alias("weight"),
                first.alias("first"),
                last.alias("last"),
                part.alias("bytes"),
                lo.alias("klo"),
                hi.alias("khi"),
            ),
        )

    halves = F.array(half(F.col("klo"), middle - 1), half(middle, F.col("khi")))
    cut = strings.select(F.col("h").alias("ph"), F.col("c").alias("pc"), F.explode(halves).alias("s")).filter("s IS NOT NULL")
    return cut.select("ph", "pc", "s.*")


def repeated_windows(strings: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, c, lo, hi): offsets of repeated windows of written strings (h, c, weight, first, last, bytes, strings)."""
    found, mappings, levels = [], [], [strings]
    level = strings.withColumns({"klo": F.lit(0), "khi": F.lit(window - gram)})
    columns = ["h", "c", "first", "last", "weight", "bytes"]
    while True:
        if mappings:
            level = written(_groups(level), "repeats-level")
            levels.append(level)
        hot = (F.col("strings") > GROUP_STRINGS) & (F.col("khi") > F.col("klo"))
        alone = level.filter("strings = 1").select("h", "c", F.col("last").alias("lo"), F.col("first").alias("hi"))
        together = level.filter((F.col("strings") > 1) & ~hot).select(*columns)
        shards = together.mapInArrow(_shards(window, gram), _SHARD)
        dealt = shards.repartition("h").sortWithinPartitions("h")
        merged = dealt.mapInArrow(_merge_shards(window, gram), _REPEATED)
        found.append(written(alone.unionByName(merged), "repeats-merged"))
        rest = level.filter(hot)
        if rest.isEmpty():
            break
        cut = written(_halves(rest, window), "repeats-halves")
        mappings.append(cut.select("ph", "pc", "h", "c").distinct())
        level = cut.groupBy("h", "c", "first", "last", "klo", "khi").agg(F.sum("weight").alias("weight"), F.first("bytes").alias("bytes"))
        levels.append(cut)
    result = found.pop()
    while mappings:
        of = mappings.pop()
        up = of.join(result, ["h", "c"]).select(F.col("ph").alias("h"), F.col("pc").alias("c"), "lo", "hi")
        lower = [found.pop(), result]
        result = written(lower[0].unionByName(up), "repeats-found")
        discard(*lower)
    discard(*levels)
    return result


def _shuffled(table: DataFrame) -> DataFrame:
    """For joins in which both sides grow with the input: neither is sent whole to the driver and every executor."""
    return table.hint("merge")


def _spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, spans): byte ranges (start, end) that repeated windows cover, sorted; ``docs`` has k1, k2, text."""
    anchors = written(docs.mapInArrow(_anchors(window, gram), _ANCHORS), "repeats-anchors")
    twice = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeats-grams")
    sweep(docs.sparkSession)
    # Anchors have the least hashes of their windows, whose high bits are much alike; the sketch needs them mixed.
    spread = F.xxhash64("h").alias("spread")
    met = passes_sketch(anchors.select("*", spread), twice.select(spread), "spread", SKETCH_BITS)
    met = written(met.filter("routed").drop("routed", "spread"), "repeats-met")
    discard(anchors, twice)
    # Dealt by group once: strings, and what their groups weigh, are summed where the rows lie.
    dealt = met.mapInArrow(_combined, _COMBINED).repartition("h")
    rep = F.min(F.struct("k1", "k2", "seen")).alias("rep")
    strings = _groups(dealt.groupBy("h", "c").agg(F.sum("weight").alias("weight"), rep))
    strings = strings.select("h", "c", "weight", "strings", "rep.k1", "rep.k2", *[x.alias(n) for n, x in _unpacked(F.col("rep.seen")).items()])
    strings = written(strings, "repeats-strings")
    sweep(docs.sparkSession)

    several = strings.filter("strings > 1")
    wanted = written(several.select("k1", "k2").distinct(), "repeats-wanted")
    texts = passes_sketch(docs, wanted.select("k1"), "k1", SKETCH_BITS).filter("routed").select("k1", "k2", F.col("text").cast("binary").alias("data"))
    cut = F.substring("data", (F.col("place") - F.col("first") + 1).cast("int"), F.lit(window) + F.col("first") - F.col("last"))
    fetched = several.join(_shuffled(texts), ["k1", "k2"]).select("h", "c", "weight", "first", "last", "strings", cut.alias("bytes"))
    fetched = written(fetched, "repeats-bytes")
    sweep(docs.sparkSession)
    merged = repeated_windows(fetched, window, gram)
    sweep(docs.sparkSession)
    alone = strings.filter("strings = 1").select("h", "c", F.col("last").alias("lo"), F.col("first").alias("hi"))
    found = written(alone.unionByName(merged).groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("offsets")), "repeats-offsets")

    discard(strings, wanted, merged)
    sweep(docs.sparkSession)
    place = _unpacked(F.col("seen"))["place"]
    start, end = place - F.col("o.hi"), place - F.col("o.lo") + window
    spans = met.join(_shuffled(found), ["h", "c"]).select("k1", "k2", "seen", F.explode("offsets").alias("o")).select("k1", "k2", start.alias("start"), end.alias("end"))
    spans = written(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "repeats-spans")
    discard(met, found)
    sweep(docs.sparkSession)
    return spans


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to (id, n_removed, n_spans, kept): spans that touch or overlap are one; null is none."""
    for batch in batches:
        removed, runs, kept = [], [], []
        spans = batch.column(2)
        for i in range(batch.num_rows):
            data = memoryview(batch.column(1)[i].as_buffer())
            own = spans[i].values
            if own is None:
                removed.append(0)
                runs.append(0)
                kept.append(data.tobytes())
                continue
            start, end = own.field(0).to_numpy(), np.maximum.accumulate(own.field(1).to_numpy())
            new = np.r_[True, start[1:] > end[:-1]]
            start, end = start[new], end[np.r_[new[1:], True]]
            removed.append(int((end - start).sum()))
            runs.append(len(start))
            edges = np.r_[0, np.stack([start, end], 1).ravel(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in edges.reshape(-1, 2).tolist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_removed", "n_spans", "kept"]
        )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the bytes that are left, ``kept``."""
    rows = docs.select(named(doc_id).alias("id"), text_of(text).alias("text"))
    rows = rows.withColumns(_keys(F.col("id"), F.col("text")))
    spans = _spans(rows.select("k1", "k2", "text"), window, gram)
    routed = passes_sketch(rows, spans.select("k1"), "k1", SKETCH_BITS)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    none = F.lit(0).cast("long")
    untouched = routed.filter("NOT routed").select(
        F.col("id").alias("doc_id"), size, none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    met = routed.filter("routed").join(_shuffled(spans), ["k1", "k2"], "left")
    met = met.select(F.struct(F.col("id").alias("doc_id"), size).alias("id"), F.col("text").cast("binary"), "spans")
    kind = met.schema["id"].dataType.simpleString()
    cut = met.mapInArrow(_cutter, f"id {kind}, n_removed long, n_spans long, kept binary")
    return untouched.unionByName(cut.select("id.doc_id", "id.n_bytes", "n_removed", "n_spans", "kept"))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = cut_repeats(docs, doc_id, text, window, gram)
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
