"""Word shingles and MinHash signatures of whole texts, on numpy arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Texts are taken together up to so many bytes; a longer one is taken alone.
CHUNK_BYTES = 4 << 20
_SEED = 4


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a finaliser of multiplications and shifts)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte (A-Z as a-z), which bytes are white space, and the hash's base with its inverse."""
    rng = np.random.default_rng(_SEED)
    values = rng.integers(1, 2**64, 256, dtype=_U)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    base = int(rng.integers(1, 2**63, dtype=_U)) * 2 + 1
    return values, space, np.array([base, pow(base, -1, 2**64)], _U)


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self._values, self._space, (self._base, self._inverse) = _tables()
        self._powers = self._inverses = np.ones(1, _U)
        self._weights = np.random.default_rng(_SEED + 1).integers(0, 2**63, 64, dtype=_U) * _U(2) + _U(1)

    def _powers_to(self, n: int) -> None:
        if len(self._powers) < n:
            with np.errstate(over="ignore"):
                self._powers = np.cumprod(np.r_[_U(1), np.full(n - 1, self._base)])
                self._inverses = np.cumprod(np.r_[_U(1), np.full(n - 1, self._inverse)])

    def _word_hashes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and how many words stand before each text and after the last."""
        n = len(data)
        self._powers_to(n + 1)
        word = ~self._space[data]
        before = np.r_[False, word[:-1]]
        starts_text = np.r_[0, ends[:-1]]
        before[starts_text[starts_text < n]] = False
        starts = np.flatnonzero(word & ~before)
        after = np.r_[word[1:], False]
        after[ends[(ends > 0)] - 1] = False
        stops = np.flatnonzero(word & ~after) + 1
        sums = np.r_[_U(0), np.cumsum(self._values[data] * self._powers[:n])]
        hashes = _mixed((sums[stops] - sums[starts]) * self._inverses[starts] + (stops - starts).astype(_U))
        return hashes, np.searchsorted(starts, np.r_[starts_text, n])

    def sets(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct shingle hashes of each text; ``ends`` cut ``data`` into texts."""
        hashes, first = self._word_hashes(data, ends)
        k = self.words
        joined = np.zeros(max(len(hashes) - k + 1, 0), _U)
        for i in range(k):
            joined += hashes[i : i + len(joined)] * self._weights[i]
        joined = _mixed(joined)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(joined[a : b - k + 1])
            elif b > a:  # the whole sequence; its length keeps it apart from longer ones
                whole = (hashes[a:b] * self._weights[k : k + b - a]).sum(dtype=_U) + _U(b - a)
                yield _mixed(np.array([whole]))
            else:
                yield np.zeros(0, _U)


def texts_in_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and ends of the texts of a string column without nulls, a bounded number of bytes at a time."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        yield held[at[start] : at[stop]], at[start + 1 : stop + 1] - at[start]
        start = stop


class Signer:
    """``size`` MinHash coordinates of a set of 64-bit values, 32 bits each."""

    def __init__(self, size: int):
        rng = np.random.default_rng(_SEED + 2)
        self._flips = rng.integers(0, 2**64, size, dtype=_U)[:, None]
        self._factors = (rng.integers(0, 2**63, size, dtype=_U) * _U(2) + _U(1))[:, None]

    def sign(self, values: np.ndarray) -> np.ndarray:
        least = np.full(len(self._flips), np.iinfo(_U).max)
        for start in range(0, len(values), 1 << 15):
            part = values[None, start : start + (1 << 15)]
            least = np.minimum(least, ((part ^ self._flips) * self._factors).min(axis=1))
        return (least >> _U(32)).astype(np.uint32).view(np.int32)
