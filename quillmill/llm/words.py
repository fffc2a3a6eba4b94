"""Vectorised word arrays of whole texts: positions and 64-bit hashes of words and word windows.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np

from .bpe import mix64, slice_hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = np.uint64(0x9FB21C651E98DF25)


class Words:
    """Words of many texts at once, on their UTF-8 bytes.

    data: the bytes of all texts, a line feed after each; text_end: where each text ends (its line feed);
    start, end: of each word; text: the number of its text; first: of each text, its first word (one more at the end).
    """

    def __init__(self, texts: list[str | None]):
        coded = [(t or "").encode() for t in texts]
        self.data = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
        self.text_end = np.cumsum([len(c) + 1 for c in coded]).astype(np.int64) - 1 if coded else np.zeros(0, dtype=np.int64)
        gap = _SPACE[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(self.text_end, self.start)
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.data, self.start, self.end)


def windows(hashes: np.ndarray, text: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie in one text, and the number of their first words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    out = hashes[at].copy()
    for k in range(1, size):
        out = mix64(out * _FACTOR + hashes[at + k])
    return out, at
