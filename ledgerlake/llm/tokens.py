"""Token ids of whole texts with the byte-level vocabulary.

The vocabulary's pre-tokenizer never joins what stands on both sides of a
single space between two other characters. Texts are therefore cut there, each
distinct piece is encoded once per task, and a text's ids are gathered from the
ids of its pieces. Texts with other white space around a space are encoded
whole. Tests hold the ids against those of the tokenizer file itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np


def load_encoding(path: str, pattern: str):
    """The vocabulary at ``path`` (ranks by token), read on the machine that uses it."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Pieces(dict):
    """Number of a piece; pieces asked for the first time are noted as ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class TextEncoder:
    def __init__(self, encoding, most_pieces: int = 2_000_000):
        """``most_pieces`` bounds the memory for known pieces; beyond it they are forgotten and learnt anew."""
        self._encode = encoding.encode_ordinary
        self._widths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.max_token_value + 1)])
        self._most = most_pieces
        self._forget()

    def _forget(self) -> None:
        self._pieces = _Pieces()
        self._ids, self._sizes, self._unsafe = (np.zeros(0, kind) for kind in (np.uint32, np.int64, bool))

    def _learn(self) -> None:
        """Encode all new pieces as one text, and cut its ids where the pieces end, by bytes."""
        new, self._pieces.new = self._pieces.new, []
        # A piece that is empty or has white space at an end cannot stand between single spaces.
        unsafe = np.array([not piece or piece.strip() is not piece for piece in new], bool)
        joined = [" " + piece for piece, odd in zip(new, unsafe) if not odd]
        ids = np.array(self._encode("".join(joined)), np.uint32)
        ends = np.cumsum([len(piece.encode()) for piece in joined], dtype=np.int64)
        sizes = np.zeros(len(new), np.int64)
        sizes[~unsafe] = np.diff(np.searchsorted(np.cumsum(self._widths[ids]), ends, side="left") + 1, prepend=0)
        self._ids = np.concatenate([self._ids, ids])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._unsafe = np.concatenate([self._unsafe, unsafe])

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text. All texts are looked up before the first is given out, so pass bounded lists."""
        if len(self._pieces) > self._most:
            self._forget()
        number = self._pieces.__getitem__
        looked_up = []
        for text in texts:
            first, *rest = text.split(" ")
            looked_up.append((text, first, np.fromiter(map(number, rest), np.int64, len(rest))))
        if self._pieces.new:
            self._learn()
        ends = np.cumsum(self._sizes)
        for text, first, index in looked_up:
            if self._unsafe[index].any() or (len(index) and first.strip() is not first):
                yield np.array(self._encode(text), np.uint32)
                continue
            size = self._sizes[index]
            upto = np.cumsum(size)
            rest = self._ids[np.repeat(ends[index] - upto, size) + np.arange(upto[-1] if len(upto) else 0)]
            yield np.concatenate([np.array(self._encode(first), np.uint32), rest])
