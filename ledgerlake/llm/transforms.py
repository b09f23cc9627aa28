"""Burrows-Wheeler transforms of aligned strings, and their merge by interleave refinement.

Strings of one group stand in columns that are aligned on a shared anchor; a
string has a byte in the columns it covers and ``PAD`` elsewhere (0xFF, which
UTF-8 never uses). The transform of a set of strings holds, for every column,
the strings' bytes in the order of what follows that column.

Merging keeps one interleave of the shards' strings per group. Reading the
columns from the last to the first, every step takes from each shard its next
bytes in the order of the interleave, and refines the interleave by a stable
partition on them: each shard's own order is kept, so suffixes are never
compared or sorted again. The length of the prefix that neighbours share grows
by one where their bytes agree and starts anew where they do not, which gives
the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 0xFF


@dataclass(frozen=True)
class Strings:
    """Transforms of many groups side by side; strings of a shard, and shards of a group, are neighbours."""

    group: np.ndarray
    shard: np.ndarray
    weight: np.ndarray
    columns: np.ndarray  # bytes: a row per column, in which every shard holds its strings in its own order

    @staticmethod
    def single(group: np.ndarray, weight: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, width: int) -> Strings:
        """Every string a shard of its own; its bytes are ``data[starts:starts + sizes]`` and begin in column ``at``."""
        n = len(group)
        columns = np.full((width, n), PAD, np.uint8)
        owner = np.repeat(np.arange(n), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns[np.repeat(at, sizes) + within, owner] = data[np.repeat(starts, sizes) + within]
        return Strings(group, np.arange(n), weight, columns)


def merge(strings: Strings, window: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform of each group's merged shards, and which strings have a repeated window at which column.

    A window is ``window`` bytes from one of the first ``starts`` columns; it is
    repeated when the strings that share it weigh two or more. The result is a
    row per column (in merged order) and a row per string.
    """
    width, n = strings.columns.shape
    narrow = np.uint16 if n < 65536 else np.int64
    group = np.unique(strings.group, return_inverse=True)[1].astype(narrow)
    shard = np.unique(strings.shard, return_inverse=True)[1].astype(narrow)
    merged = np.empty_like(strings.columns)
    repeated = np.zeros((n, starts), bool)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # prefix shared with the string before
    first_of_group = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    for column in range(width - 1, -1, -1):
        # Each shard's next bytes, given to its strings in the order of the interleave.
        own = np.argsort(shard[order], kind="stable")
        byte = np.empty(n, np.uint8)
        byte[own] = strings.columns[column]
        merged[column] = byte
        turn = np.argsort(byte, kind="stable")
        turn = turn[np.argsort(group[turn], kind="stable")]  # ``group`` is the same for any order within groups
        order, byte = order[turn], byte[turn]
        agree = np.r_[False, byte[1:] == byte[:-1]] & ~first_of_group & (byte != PAD)
        refined = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(agree)
        low, high = turn[at - 1] + 1, turn[at]
        least = common[high]
        far = np.flatnonzero(low < high)
        if len(far):
            spans = np.empty(2 * len(far), np.int64)
            spans[::2], spans[1::2] = low[far], high[far] + 1
            least[far] = np.minimum.reduceat(common, spans)[::2]
        refined[at] = least + 1
        common = refined
        if column < starts:
            cut = np.flatnonzero(common[:n] < window)
            weight = np.add.reduceat(strings.weight[order], cut) if n else cut
            heavy = np.repeat(weight > 1, np.diff(np.r_[cut, n]))
            repeated[order[heavy], column] = True
    return merged, repeated
