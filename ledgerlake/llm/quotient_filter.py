"""A counting quotient filter over 64-bit fingerprints, held in numpy arrays.

A fingerprint is split into a quotient (its high bits, the home slot) and a
remainder (its low bits). All remainders with one quotient form a run, kept
sorted, with a count each; no bits are thrown away, so the filter is exact on
fingerprints. Two filters over the same quotient space merge without loss by
interleaving their runs in remainder order and adding counts of equal ones.

Serialised, a filter is its run lengths by quotient, the remainders in slot
order, and counts only for the slots marked in a bitmap as counted more than
once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class QuotientFilter:
    """``slots``: fingerprints in (quotient, remainder) order, each once; ``counts``: how often each came."""

    quotient_bits: int
    slots: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(fingerprints: np.ndarray, quotient_bits: int) -> QuotientFilter:
        slots, counts = np.unique(fingerprints.astype(np.uint64, copy=False), return_counts=True)
        return QuotientFilter(quotient_bits, slots, counts.astype(np.int64))

    @staticmethod
    def merged(filters: Iterable[QuotientFilter]) -> QuotientFilter:
        """All filters as one; runs of equal quotients are merged by sorted remainder, two filters at a time."""
        level = list(filters)
        while len(level) > 1:
            level = [_merge(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def more_than_once(self) -> np.ndarray:
        return self.slots[self.counts > 1]

    def blocks(self, block_bits: int) -> Iterable[tuple[int, QuotientFilter]]:
        """The filter cut by the first ``block_bits`` bits of the quotient; empty blocks are left out."""
        if not len(self.slots):
            return
        home = self.slots >> np.uint64(64 - block_bits) if block_bits else np.zeros(len(self.slots), np.uint64)
        starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
        for start, end in zip(starts, [*starts[1:], len(home)]):
            yield int(home[start]), QuotientFilter(self.quotient_bits, self.slots[start:end], self.counts[start:end])

    def pack(self) -> bytes:
        low = 64 - self.quotient_bits
        quotients = self.slots >> np.uint64(low)
        runs, lengths = np.unique(quotients, return_counts=True)
        remainders = self.slots & np.uint64((1 << low) - 1)
        width = (low + 7) // 8
        narrow = remainders.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
        counted = self.counts > 1
        head = np.array([self.quotient_bits, len(runs), len(self.slots), int(counted.sum())], "<u8")
        parts = (
            head,
            runs.astype("<u4"),
            lengths.astype("<u4"),
            np.ascontiguousarray(narrow),
            np.packbits(counted),
            self.counts[counted].astype("<u8"),
        )
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def unpack(data: bytes) -> QuotientFilter:
        quotient_bits, n_runs, n_slots, n_counted = (int(x) for x in np.frombuffer(data, "<u8", 4))
        low = 64 - quotient_bits
        width = (low + 7) // 8
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        runs, lengths = take("<u4", n_runs), take("<u4", n_runs)
        wide = np.zeros((n_slots, 8), np.uint8)
        wide[:, 8 - width :] = take("u1", n_slots * width).reshape(n_slots, width)
        remainders = wide.view(">u8").reshape(n_slots).astype(np.uint64)
        counts = np.ones(n_slots, np.int64)
        counted = np.unpackbits(take("u1", (n_slots + 7) // 8), count=n_slots).astype(bool)
        counts[counted] = take("<u8", n_counted)
        slots = (np.repeat(runs.astype(np.uint64), lengths) << np.uint64(low)) | remainders
        return QuotientFilter(quotient_bits, slots, counts)


def _merge(left: QuotientFilter, right: QuotientFilter) -> QuotientFilter:
    if left.quotient_bits != right.quotient_bits:
        raise ValueError("filters with different quotients cannot be merged")
    # Both are sorted: places of the right slots among the left ones give the interleave.
    at = np.searchsorted(left.slots, right.slots)
    held = np.zeros(len(right.slots), bool)
    inside = at < len(left.slots)
    held[inside] = left.slots[at[inside]] == right.slots[inside]
    counts = left.counts.copy()
    counts[at[held]] += right.counts[held]
    return QuotientFilter(
        left.quotient_bits,
        np.insert(left.slots, at[~held], right.slots[~held]),
        np.insert(counts, at[~held], right.counts[~held]),
    )
