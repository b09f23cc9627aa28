"""Phrase collocations, counted in HAT-tries whose sorted runs are merged by prefix.

1. A survey counts the words of each language, and hashes of neighbouring words
   in blocks by their first bits. Hashes that come often enough set the bits of
   a sketch of fixed size: it may let other pairs pass, but misses none that is
   frequent. A second survey does the same for three words whose pairs pass.
2. From every word on, a window is extended as long as the next pair and the next
   three words pass, to ``MAX_WORDS`` at most. All parts of a frequent phrase are
   frequent, so each of its places lies at the start of a window. A trie holds the
   windows: the first word leads to a branch, which is a hash container of rests
   and bursts into containers by the second word when it grows.
3. When a trie is full its largest subtrees are spilled whole: sorted, with a sum
   for every prefix, for the occurrences of a phrase are the windows that begin
   with it. Each prefix has a partition by its hash; a run is cut by partition,
   and there the sorted runs of all tasks are merged. So a word or pair that
   begins a third of all phrases is spread, and a prefix comes once per run.
4. Candidates meet the counts of the parts of each cut; products are decimals.

Memory: a trie and the words of one task; rows of a run are bounded by what a
trie holds. Phrases are told by their bytes: hashes and the sketch only spare work.

Defined results: a null text counts as empty; a null language is ``und``; ties
of score are settled by count, then by the phrase's UTF-8 bytes; rows that
repeat count each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from ledgerlake.llm.hat_trie import HatTrie, prefix_counts
from ledgerlake.llm.tables import named, text_of, written
from ledgerlake.llm.words import ASCII_LOWER, Vocabulary

MAX_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
#: 2**SKETCH_BITS bits: 4 MB, of which no more than 2**(SKETCH_BITS - 6) words reach the driver.
SKETCH_BITS = 25
#: Words in sequence are hashed to so many bits, of which the first ones name a block.
HASH_BITS, BLOCK_BITS = 46, 14
#: Distinct hashes and words that a task holds before it hands on a sorted run.
HELD_HASHES, HELD_WORDS = 1 << 19, 1 << 18
#: Each language's prefixes are dealt to 2**PREFIX_BITS partitions.
PREFIX_BITS = 12
#: Phrases of one partition that are gathered from runs before they are merged.
MERGED = 1 << 18
#: First selection of the top phrases of a language: parts by hash.
TOP_PARTS = 64

#: What ends a piece, and the word that stands for it (no word holds it).
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"."
_CLEAN = bytes(_END[0] if c in _ENDS else c for c in ASCII_LOWER)

_U = np.uint64
_TEXTS_BYTES = 2 << 20
#: Windows are made for so many words at a time, however long a text is.
STRETCH_WORDS = 1 << 19


def _texts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, some megabytes at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] > _TEXTS_BYTES:
                yield lang, held.pop(lang)
                del sizes[lang]
        yield from held.items()


def _hash_of(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    x = one * _U(0x9E3779B97F4A7C15) + (two ^ (two >> _U(31)))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x >> _U(64 - HASH_BITS)


class _Language:
    """Words of one language in one task, by number, with their hashes."""

    def __init__(self, lang: str):
        self.lang, self._seed = lang, xxh64_intdigest(lang.encode())
        self._vocabulary, self._hashes = Vocabulary(), np.zeros(0, _U)
        self._vocabulary[_END] = 0
        self.names: list[bytes] = []

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """Word numbers of all texts; 0 stands between pieces and texts."""
        numbers = self._vocabulary.numbers(_END.join(texts).translate(_CLEAN).replace(_END, b" . "))
        self.names = list(self._vocabulary)
        new = [xxh64_intdigest(word, self._seed) for word in self.names[len(self._hashes) :]]
        self._hashes = np.concatenate([self._hashes, np.array(new, _U)])
        return numbers

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word and the next stand in one piece, and the hash of both."""
        hashes = self._hashes[numbers]
        return (numbers[:-1] > 0) & (numbers[1:] > 0), _hash_of(hashes[:-1], hashes[1:])

    def hashes_in_order(self, rank: np.ndarray) -> np.ndarray:
        """The words' hashes in the order of :meth:`in_order`."""
        found = np.empty_like(self._hashes)
        found[rank[:-1]] = self._hashes
        return found

    def in_order(self) -> tuple[pa.Array, np.ndarray]:
        """The words sorted by their bytes, and the place of each number among them."""
        order = sorted(range(len(self.names)), key=self.names.__getitem__)
        rank = np.empty(len(order) + 1, np.int32)
        rank[order], rank[-1] = np.arange(len(order)), -1
        return pa.array([self.names[i] for i in order], pa.binary()), rank


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])


_COUNTED = "lang string, phrase string, f long"
_HASHED = "block int, hashes binary, counts binary"
_SURVEY = f"{_COUNTED}, {_HASHED}"
_NAMES = [field.split()[0] for field in _SURVEY.split(", ")]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first) if len(first) else count


class _HashCounts:
    """Counts of hashes in one task, handed on in runs sorted by block.

    Counts end at ``most``: what has reached it is frequent anyway.
    """

    def __init__(self, most: int):
        self._most, self._kind = most, np.dtype(np.min_scalar_type(most))
        self._keys, self._counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]

    def add(self, hashes: np.ndarray) -> None:
        found, often = np.unique(hashes, return_counts=True)
        self._keys.append(found)
        self._counts.append(often)
        if sum(map(len, self._keys)) > 2 * HELD_HASHES:
            self._keys, self._counts = ([x] for x in _sums(self._keys, self._counts))

    def full(self) -> bool:
        return sum(map(len, self._keys)) > HELD_HASHES

    def run(self) -> list[pa.Array]:
        """(block, hashes, counts), and nothing is held any more."""
        keys, counts = _sums(self._keys, self._counts)
        self._keys, self._counts = [keys[:0]], [counts[:0]]
        block = (keys >> _U(HASH_BITS - BLOCK_BITS)).astype(np.int32)
        first = np.flatnonzero(np.r_[len(block) > 0, block[1:] != block[:-1]])
        cuts = np.r_[first, len(keys)].astype(np.int32)
        parts = keys.astype(np.uint32), np.minimum(counts, self._most).astype(self._kind)
        held = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts * x.itemsize), pa.py_buffer(x)]) for x in parts]
        return [pa.array(block[first]), *held]


def _word_run(language: _Language, counts: np.ndarray) -> list[pa.Array]:
    """(lang, phrase, f) of the words, sorted."""
    words, rank = language.in_order()
    own, end = np.zeros(len(words), np.int64), int(rank[0])
    own[rank[: len(counts)]] = counts
    return _batch(language.lang, pa.concat_arrays([words[:end], words[end + 1 :]]), np.delete(own, end)).columns


def _surveyor(least_count: int):
    """Two kinds of rows: the words of a task with their counts, and hashes of its pairs with theirs."""

    def row_of(words: list[pa.Array] | None, hashes: list[pa.Array] | None) -> pa.RecordBatch:
        words = words or [pa.nulls(len(hashes[0]), t) for t in (pa.string(), pa.string(), pa.int64())]
        hashes = hashes or [pa.nulls(len(words[0]), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*words, *hashes], _NAMES)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[_Language, np.ndarray]] = {}
        pairs = _HashCounts(least_count)
        for lang, texts in _texts_by_language(batches):
            language, before = seen.get(lang) or (_Language(lang), np.zeros(0, np.int64))
            numbers = language.numbers(texts)
            own = np.bincount(numbers, minlength=len(language.names))
            own[: len(before)] += before
            seen[lang] = language, own
            inside, hashes = language.pairs(numbers)
            pairs.add(hashes[inside])
            if pairs.full():
                yield row_of(None, pairs.run())
            if sum(len(x.names) for x, _ in seen.values()) > HELD_WORDS:
                yield row_of(_word_run(*seen.pop(max(seen, key=lambda x: len(seen[x][0].names)))), None)
        yield row_of(None, pairs.run())
        for language, own in seen.values():
            yield row_of(_word_run(language, own), None)

    return survey


def _in_sketch(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> _U(HASH_BITS - SKETCH_BITS)
    return (sketch[place >> _U(6)] >> (place & _U(63)) & _U(1)).astype(bool)


def _triples(language: _Language, numbers: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a pair passes; where three words begin whose pairs both pass, and their hashes."""
    inside, hashes = language.pairs(numbers)
    joined = inside & _in_sketch(pairs, hashes)
    at = np.flatnonzero(joined[:-1] & joined[1:])
    return joined, at, _hash_of(hashes[at], hashes[at + 1])


def _triple_surveyor(least_count: int, sketch):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, _Language] = {}
        triples = _HashCounts(least_count)
        for lang, texts in _texts_by_language(batches):
            language = seen.get(lang) or seen.setdefault(lang, _Language(lang))
            triples.add(_triples(language, language.numbers(texts), sketch.value)[2])
            if triples.full():
                yield pa.RecordBatch.from_arrays(triples.run(), _NAMES[3:])
        yield pa.RecordBatch.from_arrays(triples.run(), _NAMES[3:])

    return survey


def _block_merger(least_count: int):
    """Hashes whose counts, over all runs of a block, reach ``least_count``; rows come sorted by block."""
    kind = np.dtype(np.min_scalar_type(least_count))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, counts = None, [], []

        def frequent() -> pa.RecordBatch:
            key, count = _sums(keys, counts)
            found = key[count >= least_count].astype(np.int64) | last << (HASH_BITS - BLOCK_BITS)
            return pa.RecordBatch.from_arrays([pa.array(found)], ["hash"])

        for batch in batches:
            for block, hashes, often in zip(*(column.to_pylist() for column in batch.columns)):
                if block != last:
                    if keys:
                        yield frequent()
                    last, keys, counts = block, [], []
                keys.append(np.frombuffer(hashes, np.uint32))
                counts.append(np.frombuffer(often, kind).astype(np.int64))
        if keys:
            yield frequent()

    return merge


def _sketch(runs: DataFrame, least_count: int) -> np.ndarray:
    """Bits of the frequent hashes; a fixed number of bytes whatever their number."""
    dealt = runs.repartition("block").sortWithinPartitions("block")
    place = F.shiftright("hash", HASH_BITS - SKETCH_BITS).alias("place")
    mask = F.expr("shiftleft(1L, cast(place & 63 as int))")
    places = dealt.mapInArrow(_block_merger(least_count), "hash long").select(place)
    found = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    bits = np.zeros(1 << (SKETCH_BITS - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(_U)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word numbers, sorted, and how often each comes."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    wide = int(rows.max() + 1).bit_length()
    each = 63 // wide
    keys = []
    for start in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), np.int64)
        for k in range(start, min(start + each, rows.shape[1])):
            key = key << wide | rows[:, k].astype(np.int64) + 1
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([key[order[1:]] != key[order[:-1]] for key in keys])
    first = np.flatnonzero(new)
    return rows[order[first]], np.diff(np.r_[first, len(rows)])


def _windows_in(language: _Language, numbers: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """From each of the first ``STRETCH_WORDS`` words on, the words as far as pairs and threes pass; two at least."""
    joined, at, hashes = _triples(language, numbers, pairs)
    goes_on = np.zeros(len(joined) + MAX_WORDS, bool)
    goes_on[at] = _in_sketch(triples, hashes)
    at = np.flatnonzero(joined[:STRETCH_WORDS])
    rows = np.full((len(at), MAX_WORDS), -1, np.int32)
    rows[:, 0], rows[:, 1] = numbers[at], numbers[at + 1]
    on = np.ones(len(at), bool)
    for k in range(2, MAX_WORDS):
        on &= goes_on[at + k - 2]
        rows[on, k] = numbers[at[on] + k]
    return rows


def _sorted_run(language: _Language, trie: HatTrie, everything: bool) -> pa.RecordBatch:
    """What a trie spills: (lang, partition, phrases, counts), the phrases of a length in the order of their words."""
    rows, counts = trie.spill(everything)
    words, rank = language.in_order()
    hashes = language.hashes_in_order(rank)
    phrases, sums, partitions = [pa.array([], pa.binary())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for found, often in prefix_counts(rank[rows], counts, 2):
        phrases.append(pc.binary_join_element_wise(*[words.take(pa.array(found[:, k])) for k in range(found.shape[1])], b" "))
        hashed = reduce(_hash_of, (hashes[found[:, k]] for k in range(found.shape[1])))
        partitions.append((hashed & _U((1 << PREFIX_BITS) - 1)).astype(np.int64))
        sums.append(often)
    partition = np.concatenate(partitions)
    order = np.argsort(partition, kind="stable")
    partition = partition[order]
    first = np.flatnonzero(np.r_[len(partition) > 0, partition[1:] != partition[:-1]])
    cuts = pa.array(np.r_[first, len(partition)].astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(cuts, pa.concat_arrays(phrases).cast(pa.string()).take(pa.array(order))),
        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sums)[order])),
    ]
    names = ["lang", "partition", "phrases", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([language.lang] * len(first), pa.string()), pa.array(partition[first].astype(np.int32)), *lists], names)


_RUNS = "lang string, partition int, phrases array<string>, counts array<long>"


def _phrase_counter(pairs, triples):
    """Sorted runs of the task's phrases of two words and more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[_Language, HatTrie]] = {}
        for lang, texts in _texts_by_language(batches):
            language, trie = seen.get(lang) or seen.setdefault(lang, (_Language(lang), HatTrie(MAX_WORDS)))
            numbers = language.numbers(texts)
            for start in range(0, len(numbers), STRETCH_WORDS):
                some = numbers[start : start + STRETCH_WORDS + MAX_WORDS - 1]
                trie.add(*_distinct(_windows_in(language, some, pairs.value, triples.value)))
                while trie.full():
                    yield _sorted_run(language, trie, False)
        for language, trie in seen.values():
            yield _sorted_run(language, trie, True)

    return count


def _merged(phrases: list[pa.Array], counts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of several runs with the sums of their counts."""
    joined = pa.concat_arrays(phrases)
    order = pc.sort_indices(joined)
    joined = joined.take(order)
    new = np.ones(len(joined), bool)
    new[1:] = pc.not_equal(joined[1:], joined[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    return joined.take(pa.array(first)), np.add.reduceat(pa.concat_arrays(counts).to_numpy()[order.to_numpy()], first)


def _run_merger(least_count: int):
    """Frequent phrases of each partition; rows come sorted by language and partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, phrases, counts, held = None, [], [], 0

        def frequent() -> pa.RecordBatch:
            found, sums = _merged(phrases, counts)
            chosen = np.flatnonzero(sums >= least_count)
            return _batch(last[0], found.take(pa.array(chosen)), sums[chosen])

        for batch in batches:
            cuts = batch.column(2).offsets.to_pylist()
            parts = batch.column(2).values, batch.column(3).values
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != last:
                    if phrases:
                        yield frequent()
                    last, phrases, counts, held = key, [], [], 0
                phrases.append(parts[0][cuts[i] : cuts[i + 1]])
                counts.append(parts[1][cuts[i] : cuts[i + 1]])
                held += cuts[i + 1] - cuts[i]
                if held > MERGED:
                    found, sums = _merged(phrases, counts)
                    phrases, counts, held = [found], [pa.array(sums)], 0
        if phrases:
            yield frequent()

    return merge


def frequent_phrases(texts: DataFrame, least_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of 1 to MAX_WORDS words with ``f >= least_count``, written; and (lang, n): all word occurrences."""
    context = texts.sparkSession.sparkContext
    survey = written(texts.mapInArrow(_surveyor(least_count), _SURVEY), "phrase-survey")
    words = survey.filter("phrase IS NOT NULL").select("lang", "phrase", "f")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent_words = words.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least_count)
    pairs = context.broadcast(_sketch(survey.filter("block IS NOT NULL").select("block", "hashes", "counts"), least_count))
    triples = context.broadcast(_sketch(texts.mapInArrow(_triple_surveyor(least_count, pairs), _HASHED), least_count))
    runs = texts.mapInArrow(_phrase_counter(pairs, triples), _RUNS)
    dealt = runs.repartition("lang", "partition").sortWithinPartitions("lang", "partition")
    frequent = written(frequent_words.unionByName(dealt.mapInArrow(_run_merger(least_count), _COUNTED)), "phrase-frequent")
    pairs.destroy()
    triples.destroy()
    return frequent, totals


def _part(first: int | Column, count: int | Column) -> Column:
    """``count`` words of the column ``words``."""
    return F.array_join(F.slice("words", first, count), " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates, each by its lowest cut."""
    cuts = frequent.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 1)
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("words")).alias("rest"))
    counted = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    rows = cuts.join(counted("first", "l"), ["lang", "first"]).join(counted("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # Exact: a * n and l * r have up to 38 digits, so the factor of 1000 is taken after the division.
    factor = lambda name: f"cast({name} AS decimal(19,0))"
    rows = rows.withColumn("whole", F.expr(f"{factor('a')} * {factor('n')}")).withColumn("under", F.expr(f"{factor('l')} * {factor('r')}"))
    rows = rows.withColumn("score", F.expr("(whole div under) * 1000 + ((whole % under) * 1000) div under"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return rows.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _independent(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """Without phrases that always come inside one longer phrase.

    Occurrences never grow with a phrase, so one that lies in a longer phrase
    of the same count lies in one with a single word more.
    """
    longer = frequent.withColumn("words", F.split("phrase", " ")).filter(F.size("words") > 2)
    inner = F.array(_part(1, F.size("words") - 1), _part(2, F.size("words") - 1))
    inside = longer.select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("a")).distinct()
    return candidates.join(inside, ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least_count: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    frequent, totals = frequent_phrases(texts, least_count)
    candidates = written(_independent(scored(frequent, totals), frequent), "phrase-candidates")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    best = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
