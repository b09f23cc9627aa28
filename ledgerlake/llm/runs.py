"""Periodic runs of words: string synchronising sets propose periods, an exact comparison confirms them.

A run is a stretch that repeats with a period and that no neighbouring word
extends. Runs with a period below ``4 * FIRST_SCALE`` are read off directly. At
each scale t = FIRST_SCALE, 2 t, 4 t, ... those with a period p of 4 t to 8 t
follow:

1. Position i is synchronising if the least hash of the windows of t words that
   begin at i ... i + t belongs to the first or the last of them. That depends
   on the 2 t words from i only, so equal contexts choose equal positions. In
   any t places there is one, unless the words around repeat with a period of
   t / 3 at most; such windows take no part.
2. Synchronising positions with equal contexts of 2 t words and a distance of
   4 t to 8 t propose that distance as a period. The same context comes at most
   every t / 3 words, so each position has a bounded number of partners.
3. The highly periodic regions left out are runs of smaller scales, which are
   known by then. Where two of them with the same period and the same root
   touch, their phases tell all periods of the runs around the touching point
   that have no synchronising position.
4. Proposals are compared word by word in both directions. What repeats at
   least once over is a run; of several periods of one stretch the least counts.

Hashes choose and propose only; a run is what the comparison of words found.
Documents of a batch are joined with separators that equal nothing, the longest
first, so a scale passes over the documents that are long enough for it.

Defined results: null and empty texts have no words and no runs; documents
without an id are treated as any other; rows that repeat count each for itself;
equal longest runs are settled by smallest start, then period; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.tables import named, text_of
from ledgerlake.llm.words import Vocabulary

FIRST_SCALE = 4
MIN_WORDS = 12
#: Documents are worked on together up to so many bytes; a longer one is taken alone.
BATCH_BYTES = 4 << 20

_U = np.uint64
_LAST = np.iinfo(_U).max
_Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _doubled(windows: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows twice as long."""
    return _mixed(windows[:-size] * _U(0x9E3779B97F4A7C15) + _mixed(windows[size:]))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: block by block from the left and from the right."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, _LAST)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _least_periods(runs: _Runs) -> _Runs:
    """One run for each stretch, sorted by start: that with the least period."""
    start, length, period = runs
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], period[first]


def _joined(parts: list[_Runs]) -> _Runs:
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))


def _short_periods(s: np.ndarray, below: int) -> _Runs:
    found = []
    for p in range(1, min(below, len(s))):
        at = np.flatnonzero(s[p:] == s[:-p])
        if len(at):
            first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
            count = np.diff(np.r_[first, len(at)])
            long = count >= p
            found.append((at[first[long]], count[long] + p, np.full(long.sum(), p)))
    return _joined(found)


def _agree(s: np.ndarray, x: int, y: int) -> int:
    """How many words from x on equal those from y on."""
    done, step, most = 0, 64, len(s) - y
    while done < most:
        differ = s[x + done : x + min(done + step, most)] != s[y + done : y + min(done + step, most)]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += len(differ)
        step *= 4
    return done


def _agree_back(s: np.ndarray, x: int, y: int) -> int:
    """How many words before x equal those before y."""
    done, step = 0, 64
    while done < x:
        size = min(step, x - done)
        differ = s[x - done - size : x - done][::-1] != s[y - done - size : y - done][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += size
        step *= 4
    return done


def _confirmed(s: np.ndarray, at: np.ndarray, period: np.ndarray) -> _Runs:
    """Runs through the proposed places; a place inside the stretch just read with its period is not read again."""
    found = []
    order = np.lexsort((at, period))
    last, end = 0, 0
    for x, p in zip(at[order].tolist(), period[order].tolist()):
        if p == last and x < end:
            continue
        start = x - _agree_back(s, x, x + p)
        last, end = p, x + _agree(s, x, x + p)
        if end - start >= p:
            found.append((start, end - start + p, p))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _synchronising(windows: np.ndarray, size: int, runs: _Runs) -> np.ndarray:
    start, length, period = runs
    calm = (3 * period <= size) & (length >= size)
    change = np.zeros(len(windows) + 1, np.int32)
    np.add.at(change, start[calm], 1)
    np.add.at(change, np.minimum(start[calm] + length[calm] - size + 1, len(windows)), -1)
    chosen = np.where(np.cumsum(change[:-1]) > 0, _LAST, windows)
    least = _sliding_least(chosen, size + 1)
    return np.flatnonzero((least != _LAST) & ((least == chosen[: len(least)]) | (least == chosen[size:])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of positions with equal contexts, 4 to 8 sizes apart."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    places, periods = [at[:0]], [at[:0]]
    for step in range(1, len(at)):
        gap = at[step:] - at[:-step]
        near = (context[step:] == context[:-step]) & (gap < 8 * size)
        if not near.any():
            break
        near &= gap >= 4 * size
        places.append(at[:-step][near])
        periods.append(gap[near])
    return np.concatenate(places), np.concatenate(periods)


def _root_at(s: np.ndarray, root: np.ndarray, start: int) -> int:
    """Where from ``start`` on, within one period, ``root`` stands; -1 if nowhere."""
    around, wanted, wide = s[start : start + 2 * len(root) - 1].tobytes(), root.tobytes(), s.itemsize
    at = around.find(wanted)
    while at % wide and at >= 0:
        at = around.find(wanted, at + 1)
    return at // wide if at >= 0 else -1


def _touching(s: np.ndarray, size: int, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) from pairs of highly periodic regions that touch and have one root."""
    start, length, period = runs
    calm = np.flatnonzero((3 * period <= size) & (length >= 4 * size))
    calm = calm[np.lexsort((start[calm], period[calm]))]
    one, two = calm[:-1], calm[1:]
    touch = (period[one] == period[two]) & (start[one] + length[one] >= start[two])
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(one[touch].tolist(), two[touch].tolist()):
        q, most = int(period[a]), min(int(length[a]), int(length[b]), 8 * size - 1)
        phase = _root_at(s, s[start[b] : start[b] + q], int(start[a]))
        if phase < 0:
            continue
        least = int(start[b] - start[a] - phase) % q
        fits = np.arange(least + -(-(4 * size - least) // q) * q, most + 1, q)
        places.append(np.maximum(start[a], start[b] - fits))
        periods.append(fits)
    return np.concatenate(places), np.concatenate(periods)


def find_in(s: np.ndarray, ends: np.ndarray) -> _Runs:
    """(start, length, period) of all runs of ``s``, by start; ``ends`` closes its parts, the longest first.

    Runs that would cross parts must be ruled out by separators.
    """
    lengths = np.diff(np.r_[0, ends])
    runs = _least_periods(_short_periods(s, 4 * FIRST_SCALE))
    windows = _mixed(s.astype(np.int64).view(_U) + _U(1))
    size = 1
    while size < FIRST_SCALE and len(windows) > size:
        windows, size = _doubled(windows, size), 2 * size
    while size >= FIRST_SCALE and (parts := np.searchsorted(-lengths, -8 * size, side="right")):
        n = int(ends[parts - 1])
        s, windows = s[:n], windows[: n - size + 1]
        longer = _doubled(windows, size)
        own = tuple(x[: np.searchsorted(runs[0], n)] for x in runs)
        at = _synchronising(windows, size, own)
        proposed = zip(_equal_contexts(at, longer[at], size), _touching(s, size, own))
        runs = _least_periods(_joined([runs, _confirmed(s, *map(np.concatenate, proposed))]))
        windows, size = longer, 2 * size
    return runs


def circular_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Of every tenth document by the checksum of its id: from which word on it is to repeat, and with which period."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not n:
        return None
    lot = mark // 10
    first = lot % n
    return first, 1 + (n - first) // (3 + lot % 8)


def _hashed_words(names: list[bytes], numbers: np.ndarray) -> str:
    digest = hashlib.sha256()
    for start in range(0, len(numbers), 1 << 16):
        digest.update((b" " if start else b"") + b" ".join([names[i] for i in numbers[start : start + (1 << 16)].tolist()]))
    return digest.hexdigest()


def _described(names: list[bytes], numbers: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """What the result holds of one document, whose runs come by start and period."""
    digest, best = hashlib.sha256(), (None, None, None)
    dropped = np.zeros(len(numbers) + 1, np.int32)
    if len(start):
        for a, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
            digest.update(f"{a},{n},{q}\n".encode())
        longest = int(np.argmax(length))
        best = int(start[longest]), int(length[longest]), int(period[longest])
        np.add.at(dropped, start + period, 1)
        np.add.at(dropped, start + length, -1)
    kept = numbers[np.cumsum(dropped[:-1]) == 0]
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return len(start), *best, exponent, digest.hexdigest(), _hashed_words(names, kept)


def _of_documents(ids: list, texts: list[bytes], tail: Callable | None) -> list[tuple]:
    words = Vocabulary()
    numbers = []
    for doc_id, text in zip(ids, texts):
        own = words.numbers(text)
        if tail and (repeats := tail(doc_id, len(own))):
            first, period = repeats
            own[first:] = own[first + np.arange(len(own) - first) % period]
        numbers.append(own)
    names = list(words)
    longest_first = sorted(range(len(numbers)), key=lambda i: -len(numbers[i]))
    parts = [np.append(numbers[i], np.int32(-1 - at)) for at, i in enumerate(longest_first)]
    ends = np.cumsum([len(p) for p in parts])
    start, length, period = find_in(np.concatenate(parts), ends)
    counted = length >= np.maximum(MIN_WORDS, 2 * period)
    start, length, period = start[counted], length[counted], period[counted]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    cuts = np.searchsorted(start, np.r_[0, ends])
    out: list = [None] * len(texts)
    for at, i in enumerate(longest_first):
        own = slice(cuts[at], cuts[at + 1])
        begin = ends[at] - len(parts[at])
        out[i] = _described(names, numbers[i], start[own] - begin, length[own], period[own])
    return out


_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _finder(tail: Callable | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            rows, begin, held = [], 0, 0
            for at, text in enumerate(texts):
                if held and held + len(text) > BATCH_BYTES:
                    rows += _of_documents(ids[begin:at], texts[begin:at], tail)
                    begin, held = at, 0
                held += len(text)
            rows += _of_documents(ids[begin:], texts[begin:], tail)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows), kinds)], ["doc_id", *_COLUMNS])

    return find


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tail: Callable | None = None) -> DataFrame:
    """doc_id; number of runs; the longest; digests of all runs and of the words left when repetitions go.

    ``tail`` gives, from a document's id and number of words, the place from
    which its words are replaced by a repetition of the first ones there, and
    the period; None leaves the text as it is.
    """
    plain = docs.select(named(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return plain.mapInArrow(_finder(tail), schema)
