"""Counts of word sequences in a burst trie of hash containers, spilled as sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A container of more entries is burst: the next word becomes a branch of the trie.
BURST = 4096
#: Entries of all containers together before the largest subtrees are spilled.
HELD = 1 << 18

_WORD = 4
_Rows = tuple[np.ndarray, np.ndarray]


class _Container(dict):
    """Counts by the rest of a sequence, as bytes of its word numbers."""

    __slots__ = ()

    def add(self, rests: list[bytes], counts: list[int]) -> None:
        get = self.get
        for rest, count in zip(rests, counts):
            self[rest] = get(rest, 0) + count


class HatTrie:
    """Sequences of ``width`` word numbers, shorter ones filled up with -1.

    The first word leads to a branch for itself. A branch is a hash container
    of rests until it bursts; then its rests go to containers by their first
    word. The trie stays that shallow: below two words there are containers only.
    """

    def __init__(self, width: int, burst: int = BURST, held: int = HELD):
        self._width, self._burst, self._most = width, burst, held
        self._branches: dict[int, _Container | dict[int, _Container]] = {}
        self._sizes: dict[int, int] = {}
        self._held = 0

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """``rows`` are distinct and sorted by their first word."""
        if not len(rows):
            return
        rests = np.ascontiguousarray(rows[:, 1:]).view(f"V{_WORD * (self._width - 1)}").reshape(-1).tolist()
        counts = counts.tolist()
        cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True]).tolist()
        for begin, end in zip(cuts, cuts[1:]):
            self._insert(int(rows[begin, 0]), rests[begin:end], counts[begin:end])

    def _insert(self, word: int, rests: list[bytes], counts: list[int]) -> None:
        branch = self._branches.get(word)
        if branch is None:
            branch = self._branches[word] = _Container()
        if isinstance(branch, _Container):
            branch.add(rests, counts)
            size = len(branch)
            if size > self._burst and self._width > 2:
                self._branches[word] = self._split(branch)
        else:
            for rest, count in zip(rests, counts):
                container = branch.setdefault(int.from_bytes(rest[:_WORD], "little", signed=True), _Container())
                container[rest[_WORD:]] = container.get(rest[_WORD:], 0) + count
            size = sum(map(len, branch.values()))
        self._held += size - self._sizes.get(word, 0)
        self._sizes[word] = size

    @staticmethod
    def _split(container: _Container) -> dict[int, _Container]:
        children: dict[int, _Container] = {}
        for rest, count in container.items():
            child = children.setdefault(int.from_bytes(rest[:_WORD], "little", signed=True), _Container())
            child[rest[_WORD:]] = count
        return children

    def full(self) -> bool:
        return self._held > self._most

    def spill(self, everything: bool = False) -> _Rows:
        """Takes whole subtrees out, the largest first until half of what may be held is left."""
        goal = -1 if everything else self._most // 2
        words = []
        for word in sorted(self._sizes, key=self._sizes.get, reverse=True):
            if self._held <= goal or not self._sizes:
                break
            words.append(word)
            self._held -= self._sizes.pop(word)
        return self._rows([(word, self._branches.pop(word)) for word in words])

    def _rows(self, branches: list) -> _Rows:
        leads, keys, counts = [], [], []
        for word, branch in branches:
            children = {None: branch} if isinstance(branch, _Container) else branch
            for second, container in children.items():
                lead = np.array([word] if second is None else [word, second], np.int32).tobytes()
                leads.append((lead, len(container)))
                keys += container.keys()
                counts += container.values()
        wide = self._width * _WORD
        flat = b"".join(lead + key for lead, key in zip((lead for lead, n in leads for _ in range(n)), keys))
        return np.frombuffer(flat, np.int32).reshape(-1, wide // _WORD), np.array(counts, np.int64)


def prefix_counts(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from ``least`` to the width: the distinct prefixes of that length with the sums of their counts."""
    if not len(rows):
        return
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, : least - 1] != rows[:-1, : least - 1]).any(axis=1)
    for length in range(least, rows.shape[1] + 1):
        new[1:] |= rows[1:, length - 1] != rows[:-1, length - 1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts, first)
        whole = rows[first, length - 1] >= 0
        yield rows[first[whole], :length], sums[whole]
