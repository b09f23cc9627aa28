"""Words of whole texts as bytes and as numbers, a bounded stretch of text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: What stands for A-Z.
ASCII_LOWER = bytes(range(256)).lower()
#: A long text is split into words stretch by stretch, so that its words never all exist as objects.
STRETCH_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, size: int = STRETCH_BYTES) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order, as lists of some ``size`` bytes, none of them empty."""
    start = 0
    while start < len(text):
        stop = len(text)
        if start + size < stop and (cut := _SPACE.search(text, start + size)):
            stop = cut.start()
        if words := text[start:stop].split():
            yield words
        start = stop


class Vocabulary(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in stretches(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)
