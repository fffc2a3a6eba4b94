"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation uses no regular expression on texts. Every code point has a class (letter,
number, space, other white space, apostrophe, ...). The split pattern of the public byte-level
vocabularies is a finite automaton over these classes; the effect of a code point on the
automaton is a function from states to states, and such functions compose associatively.
The transition monoid is closed once (a few hundred functions), so that a run of text is folded
by look-ups in a composition table, blocks beside each other, blocks of blocks above them;
a second pass turns the block entry states into boundary bits.

The slices between boundaries are hashed; each distinct slice of a batch is merged once (the
cache of the batch), all distinct slices in step, one lowest-ranked leftmost pair a round. Equal hashes
are never trusted: every slice is compared with the one that was merged for it, byte by byte.

Defined cases: null and empty texts have no ids; texts of any length are cut, before the scan, at places
that are always boundaries: where white space follows something else, and between letters, numbers and
other characters (but not after an apostrophe). So memory is bounded by ``MAX_CHARS`` and the longest
single slice, of which merging takes some 30 bytes a byte and a queue of the pairs that merges make.
Added tokens of a `.json` vocabulary are found in texts as the tokenizers library finds them; a
`.tiktoken` file has none, so that such strings are ordinary text there.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MAX_CHARS = 1 << 20
#: Slices longer than this are merged with a heap, one by one.
LONG_SLICE = 64
#: Bytes of short slices that are merged at once: positions in a chunk have 22 bits.
MERGED_BYTES = 1 << 21
#: Slices that the memo of a worker keeps, about 60 MB.
MEMO_SLICES = 1 << 19
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
_NONE = np.int64(1) << 40

# Classes of code points.
OTHER, LETTER, NUMBER, BLANK, WHITE, QUOTE, ONE, R, V, L, E, END = range(12)
# States of the automaton.
S_BEGIN, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_WHITE, S_QUOTE, S_QR, S_QV, S_QL, S_DONE = range(11)
N_CLASS, N_STATE = 12, 11
HERE, BEFORE = 1, 2


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state; bits: a slice starts HERE, or (seen one code point late) BEFORE."""
    if state in (S_QR, S_QV, S_QL):
        if (state == S_QL and kind == L) or (state != S_QL and kind == E):
            return S_DONE, 0
        after, bits = _step(S_LETTER, kind)
        return after, bits | BEFORE
    if kind == END:
        return S_BEGIN, HERE
    if kind in (BLANK, WHITE):
        return (S_BLANK if kind == BLANK else S_WHITE), 0 if state in (S_BLANK, S_WHITE) else HERE
    late = BEFORE if state in (S_BLANK, S_WHITE) else 0
    if kind == QUOTE:
        if state in (S_BLANK, S_OTHER, S_QUOTE):
            return S_OTHER, late
        return S_QUOTE, late | HERE
    if kind == OTHER:
        return S_OTHER, late | (0 if state in (S_BLANK, S_OTHER, S_QUOTE) else HERE)
    if kind == NUMBER:
        return S_NUMBER, late | (0 if state in (S_BLANK, S_NUMBER) else HERE)
    if state == S_QUOTE and kind in (ONE, R, V, L):
        return {ONE: S_DONE, R: S_QR, V: S_QV, L: S_QL}[kind], 0
    return S_LETTER, late | (0 if state in (S_BLANK, S_LETTER) else HERE)


@lru_cache(1)
def _automaton():
    """step and bits by state * N_CLASS + class; of each class the function's number; the composition table; functions by number."""
    step = np.array([[_step(s, k)[0] for k in range(N_CLASS)] for s in range(N_STATE)], dtype=np.uint8)
    bits = np.array([[_step(s, k)[1] for k in range(N_CLASS)] for s in range(N_STATE)], dtype=np.uint8)
    identity = tuple(range(N_STATE))
    number, todo = {identity: 0}, [identity]
    generators = [tuple(int(x) for x in step[:, k]) for k in range(N_CLASS)]
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    functions = np.array(list(number), dtype=np.uint8)
    compose = np.empty((len(number), len(number)), dtype=np.uint16)
    for i, f in enumerate(number):
        compose[i] = [number[tuple(row)] for row in functions[:, list(f)]]
    of_class = np.array([number[g] for g in generators], dtype=np.uint16)
    return step.ravel(), bits.ravel(), of_class, compose.ravel(), len(number), functions


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            table[a : b + 1] = kind
    for c, kind in ((" ", BLANK), ("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E), *((c, ONE) for c in "stmd")):
        table[ord(c)] = kind
    return table


def _entry_states(codes: np.ndarray, width: int = 64) -> np.ndarray:
    """For each block of `width` codes (a 2-d array, position in block first) the state on entry."""
    _, _, _, compose, size, functions = _automaton()
    total = codes[0].astype(np.intp)
    for row in codes[1:]:
        total = compose[total * size + row].astype(np.intp)
    before = _scan(total.astype(np.uint16), width)
    return functions[before, S_BEGIN]


def _scan(f: np.ndarray, width: int) -> np.ndarray:
    """Exclusive scan of functions under composition."""
    _, _, _, compose, size, _ = _automaton()
    n = len(f)
    if n <= width:
        out, now = np.zeros(n, dtype=np.uint16), 0
        for i in range(n):
            out[i] = now
            now = compose[now * size + int(f[i])]
            now = int(now)
        return out
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, dtype=np.uint16)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    total = grid[0].astype(np.intp)
    for row in grid[1:]:
        total = compose[total * size + row].astype(np.intp)
    now = _scan(total.astype(np.uint16), width).astype(np.intp)
    out = np.empty_like(grid)
    for j in range(width):
        out[j] = now
        now = compose[now * size + grid[j]].astype(np.intp)
    return np.ascontiguousarray(out.T).ravel()[:n]


def boundaries(kinds: np.ndarray, width: int = 64) -> np.ndarray:
    """Where slices start, as a boolean array; END code points start a slice of their own."""
    step, bits, of_class, _, _, _ = _automaton()
    n = len(kinds)
    blocks = -(-n // width)
    grid = np.full(blocks * width, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    state = _entry_states(of_class[grid], width).astype(np.intp)
    out = np.empty_like(grid)
    for j in range(width):
        at = state * N_CLASS + grid[j]
        out[j] = bits[at]
        state = step[at].astype(np.intp)
    flags = np.ascontiguousarray(out.T).ravel()[:n]
    starts = (flags & HERE) != 0
    starts[:-1] |= (flags[1:] & BEFORE) != 0
    return starts


#: Letters, numbers, other characters with the apostrophe, white space: of each class.
_GROUP = np.array([2, 0, 1, 3, 3, 2, 0, 0, 0, 0, 0, 4], dtype=np.uint8)


def _sure(text: str, p: int) -> int:
    """The first offset from p on that is a boundary whatever stands before it; the end of the text if there is none."""
    while p < len(text):
        kinds = classes()[np.frombuffer(text[p - 1 : p + 4096].encode("utf-32-le"), dtype=np.uint32)]
        before, after = _GROUP[kinds[:-1]], _GROUP[kinds[1:]]
        found = np.flatnonzero((before != after) & (before != 3) & ~((kinds[:-1] == QUOTE) & (after == 0)))
        if len(found):
            return p + int(found[0])
        p += len(before)
    return len(text)


def cut_points(text: str, most: int | None = None) -> list[int]:
    """Offsets that cut a long text into pieces of about `most` code points, each at a sure boundary."""
    most = most or MAX_CHARS
    cuts, at = [0], 0
    while len(text) - at > most and (at := _sure(text, at + most)) < len(text):
        cuts.append(at)
    return cuts


def spans(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after another."""
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    index = np.repeat(start.astype(np.int64) - (ends - length), length)
    index += np.arange(ends[-1])
    return flat[index]


_BASE = 0x9E3779B97F4A7C15


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset of data on, as one number each (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by their bytes: eight bytes after another are mixed in; long slices sum mixes of bytes and place.

    Nothing in it is linear in the bytes, so that no family of texts collides by construction of a polynomial.
    """
    data = np.ascontiguousarray(data)
    unit = data.itemsize
    word = _eights(data.view(np.uint8))
    start, length = start.astype(np.int64) * unit, (end - start).astype(np.int64) * unit
    h = mix64(length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(_BASE))
    live, at = np.arange(len(start)), 0
    while at < LONG_SLICE and len(live := live[length[live] > at]):
        part = word[start[live] + at] & _LOW[np.minimum(length[live] - at, 8)]
        h[live] = mix64(h[live] * np.uint64(0x9FB21C651E98DF25) + part)
        at += 8
    live = live[length[live] > LONG_SLICE] if len(live) else live
    if len(live):
        n = (length[live] - LONG_SLICE + 7) >> 3
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        offset = LONG_SLICE + 8 * place
        part = word[np.repeat(start[live], n) + offset] & _LOW[np.minimum(np.repeat(length[live], n) - offset, 8)]
        h[live] = mix64(h[live] + np.add.reduceat(mix64(part ^ mix64(place.astype(np.uint64) + np.uint64(_BASE))), first))
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices of data (bytes) at a and at b, of the same length each, are equal."""
    word = _eights(data)
    same = np.ones(len(a), dtype=bool)
    live, at = np.flatnonzero(a != b), 0
    while at < LONG_SLICE and len(live := live[length[live] > at]):
        same[live] = ((word[a[live] + at] ^ word[b[live] + at]) & _LOW[np.minimum(length[live] - at, 8)]) == 0
        live = live[same[live]]
        at += 8
    for i in live[length[live] > LONG_SLICE].tolist() if len(live) else []:
        same[i] = np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]])
    return same


class Vocabulary:
    """Ranks of a public byte-level vocabulary: a `.tiktoken` rank file or a `.json` of the tokenizers library."""

    def __init__(self, path: str):
        self.added: dict[str, int] = {}
        if path.endswith(".json"):
            import json

            with open(path, encoding="utf-8") as f:
                whole = json.load(f)
            model = whole["model"]
            for t in whole.get("added_tokens", ()):
                if t["single_word"] or t["lstrip"] or t["rstrip"]:
                    raise ValueError(f"the added token {t['content']!r} takes more than its own text")
                self.added[t["content"]] = t["id"]
            shown = {c: b for b, c in _shown_bytes().items()}
            merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
            self.ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t in merged or len(t) == 1 and t in shown}
        else:
            with open(path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max([*self.ranks.values(), *self.added.values()]) + 1
        self.size = size
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        words = [b""] * size
        for w, i in self.ranks.items():
            words[i] = w
        for t, i in self.added.items():
            words[i] = t.encode()
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length[:-1])]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        said = [b" %d" % i for i in range(size)]
        self.said_length = np.array([len(w) for w in said], dtype=np.int32)
        self.said_start = np.concatenate([[0], np.cumsum(self.said_length[:-1])]).astype(np.int64)
        self.said = np.frombuffer(b"".join(said), dtype=np.uint8)
        pairs = {}
        get = self.ranks.get
        for w, i in self.ranks.items():
            for k in range(1, len(w)):
                a = get(w[:k])
                if a is not None:
                    b = get(w[k:])
                    if b is not None:
                        pairs[a << 20 | b] = i
        self._hash(pairs)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[int, int] = {}
        self.memo_offset, self.memo_count = np.zeros(MEMO_SLICES, dtype=np.int64), np.zeros(MEMO_SLICES, dtype=np.int32)
        self.memo_flat, self.memo_used = np.zeros(4 * MEMO_SLICES, dtype=np.int32), 0

    def merged(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As merge_all, for slices that are distinct by hash; slices of earlier batches come from the memo.

        The memo holds MEMO_SLICES slices of up to LONG_SLICE bytes at most, and starts afresh when full.
        """
        keys = hashes.tolist()
        known = np.fromiter(map(self.memo.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        fresh = known < 0
        old = np.flatnonzero(~fresh)
        known[old[~self._said(known[old], data, start[old], length[old])]] = -1  # another slice of the same hash is in the memo
        new = np.flatnonzero(known < 0)
        flat, offset, count = self.merge_all(data, start[new], length[new])
        old = np.flatnonzero(known >= 0)
        n_old = self.memo_count[known[old]]
        old_flat = spans(self.memo_flat, self.memo_offset[known[old]], n_old)
        all_offset, all_count = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        all_offset[new], all_count[new] = offset, count
        all_offset[old], all_count[old] = len(flat) + np.cumsum(n_old) - n_old, n_old
        short = (length[new] <= LONG_SLICE) & fresh[new]
        add, n_add, lengths = new[short], offset[short], count[short]
        total = int(lengths.sum())
        if len(self.memo) + len(add) > MEMO_SLICES or self.memo_used + total > len(self.memo_flat):
            self._forget()
        if len(add) <= MEMO_SLICES and total <= len(self.memo_flat):
            a, b = len(self.memo), len(self.memo) + len(add)
            self.memo_flat[self.memo_used : self.memo_used + total] = spans(flat, n_add, lengths)
            self.memo_offset[a:b] = self.memo_used + np.cumsum(lengths) - lengths
            self.memo_count[a:b] = lengths
            self.memo.update(zip(hashes[add].tolist(), range(a, b), strict=True))
            self.memo_used += total
        return np.concatenate([flat, old_flat]), all_offset, all_count

    def _said(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the memo's entries decode to these slices."""
        n = self.memo_count[entry]
        ids = spans(self.memo_flat, self.memo_offset[entry], n)
        size = self.length[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        upto = np.concatenate([[0], np.cumsum(n)])
        own = total[upto[1:]] - total[upto[:-1]]
        if np.array_equal(own, length) and np.array_equal(spans(self.flat, self.start[ids], size), spans(data, start, length)):
            return np.ones(len(entry), dtype=bool)
        return np.array([self.decode(ids[a:b]) == data[s : s + k].tobytes() for a, b, s, k in zip(upto[:-1], upto[1:], start, length, strict=True)], dtype=bool)

    def _hash(self, pairs: dict[int, int]) -> None:
        """Open addressing, filled round by round so that look-ups are vectorised."""
        self.bits = 21
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        keys, values = np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(keys), dtype=bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_one(self, word: bytes) -> list[int]:
        return self.merge_long(word).tolist()

    def merge_long(self, word: bytes) -> np.ndarray:
        """One slice, pair after pair: by rank, then from the left.

        The pairs of the bytes are sorted once; only pairs that merges make go to a heap.
        """
        get, words, n = self.ranks.get, self.words, len(word)
        first = self.byte[np.frombuffer(word, dtype=np.uint8)]
        rank = self.pair_rank(first[:-1], first[1:])
        begin = np.flatnonzero(rank < _NONE)
        queue = np.sort(rank[begin] << np.int64(40) | begin)
        tok, nxt, prv = array("i", first.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        del first, rank, begin
        stream = (k for at in range(0, len(queue), 1 << 16) for k in queue[at : at + (1 << 16)].tolist())
        heap: list[int] = []
        none, low = 1 << 62, (1 << 40) - 1
        head = next(stream, none)
        while True:
            if heap and heap[0] < head:
                key = heapq.heappop(heap)
            elif head < none:
                key, head = head, next(stream, none)
            else:
                break
            r, i = key >> 40, key & low
            if tok[i] < 0 or (j := nxt[i]) >= n or get(words[tok[i]] + words[tok[j]]) != r:
                continue
            tok[i], tok[j] = r, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (x := get(words[r] + words[tok[k]])) is not None:
                    heapq.heappush(heap, x << 40 | i)
            if (p := prv[i]) >= 0 and (x := get(words[tok[p]] + words[r])) is not None:
                heapq.heappush(heap, x << 40 | p)
        out = np.frombuffer(tok, dtype=np.int32)
        return out[out >= 0]

    def merge_all(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the slices: a flat array, and of each slice the offset and number there. Short slices are merged in chunks of bounded size."""
        n = len(start)
        chunk = np.cumsum(np.where(length <= LONG_SLICE, length, 0).astype(np.int64)) // MERGED_BYTES
        if n and chunk[-1]:
            edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), n]
            parts = [self.merge_all(data, start[a:b], length[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            moved = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + m for p, m in zip(parts, moved, strict=True)]), np.concatenate([p[2] for p in parts])
        offset, count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        done: list[np.ndarray] = []
        filled = 0
        for i in np.flatnonzero(length > LONG_SLICE):
            ids = self.merge_long(data[start[i] : start[i] + length[i]].tobytes())
            done.append(ids)
            offset[i], count[i] = filled, len(ids)
            filled += len(ids)
        who = np.flatnonzero((length <= LONG_SLICE) & (length > 0))
        tok = self.byte[spans(data, start[who], length[who])]
        size = length[who].astype(np.int64)
        while len(who):
            first = np.cumsum(size) - size
            last = first + size - 1
            if "rank" not in locals():
                rank = np.full(len(tok), _NONE, dtype=np.int64)
                rank[:-1] = self.pair_rank(tok[:-1], tok[1:])
                rank[last] = _NONE
            best = np.minimum.reduceat(rank << np.int64(22) | np.arange(len(tok)), first) if len(tok) < 1 << 22 else None
            assert best is not None, "a batch of slices is too large"
            ready = best >= _NONE << np.int64(22)
            if ready.any():
                members = np.repeat(ready, size)
                ids = tok[members]
                done.append(ids.astype(np.int32))
                n_ready = size[ready]
                offset[who[ready]] = filled + np.cumsum(n_ready) - n_ready
                count[who[ready]] = n_ready
                filled += len(ids)
                keep = ~ready
                tok, rank, who, best = tok[~members], rank[~members], who[keep], best[keep]
                shift = (first - np.cumsum(np.where(ready, size, 0)))[keep]
                moved = first[keep] - shift
                size = size[keep]
                if not len(who):
                    break
                first = np.cumsum(size) - size
                at = (best & ((1 << 22) - 1)) - moved
            else:
                at = best & ((1 << 22) - 1)
            last = first + size - 1
            tok[at] = best >> np.int64(22)
            keep = np.ones(len(tok), dtype=bool)
            keep[at + 1] = False
            tok, rank = tok[keep], rank[keep]
            at = at - np.arange(len(at))
            size = size - 1
            first = np.cumsum(size) - size
            last = first + size - 1
            inner = at < last
            rank[at] = _NONE
            if inner.any():
                rank[at[inner]] = self.pair_rank(tok[at[inner]], tok[at[inner] + 1])
            left = at > first
            if left.any():
                rank[at[left] - 1] = self.pair_rank(tok[at[left] - 1], tok[at[left]])
        flat = np.concatenate(done) if done else np.zeros(0, dtype=np.int32)
        return flat, offset, count

    def decode(self, ids: np.ndarray) -> bytes:
        return spans(self.flat, self.start[ids], self.length[ids]).tobytes()


def _shown_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level JSON vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + extra)
            extra += 1
    return shown


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the offset of each text among them (one more at the end). Added tokens keep their ids."""
    voc = vocabulary(path)
    if voc.added_pattern is None or not any(t and s in t for s in voc.added for t in texts):
        return _encode(texts, voc)
    parts: list[str | None] = []
    owner: list[int] = []
    found: list[tuple[int, int]] = []  # after which part, which id
    for i, t in enumerate(texts):
        at = 0
        for m in voc.added_pattern.finditer(t or ""):
            parts.append(t[at : m.start()])
            owner.append(i)
            found.append((len(parts), voc.added[m[0]]))
            at = m.end()
        parts.append(t[at:] if t else None)
        owner.append(i)
    ids, offset = _encode(parts, voc)
    after, which = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
    ids = np.insert(ids, offset[after], which)
    counts = np.bincount(owner, weights=np.diff(offset), minlength=len(texts)) + np.bincount(np.array(owner)[after - 1], minlength=len(texts))
    return ids, np.concatenate([[0], np.cumsum(counts.astype(np.int64))])


def _encode(texts: list[str | None], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    kinds_of = classes()
    counts = np.zeros(len(texts), dtype=np.int64)
    parts: list[np.ndarray] = []
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not batch:
            return
        joined = "\n".join(batch) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
        ends = np.cumsum([len(b) + 1 for b in batch]) - 1
        kinds = kinds_of[points]
        kinds[ends] = END
        at = np.flatnonzero(boundaries(kinds))
        if len(data) == len(points):
            byte_at = at
        else:
            # one start byte for each code point, in order
            byte_at = np.flatnonzero((data & 0xC0) != 0x80)[at]
        real = kinds[at] != END
        stop = np.append(byte_at[1:], len(data))[real]
        begin = byte_at[real]
        length = stop - begin
        code, distinct = pd.factorize(slice_hashes(data, begin, stop))
        where = np.zeros(len(distinct), dtype=np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        flat, offset, number = voc.merged(distinct, data, begin[where], length[where])
        odd = length != length[where[code]]
        even = np.flatnonzero(~odd)
        odd[even] = ~same_bytes(data, begin[even], begin[where[code[even]]], length[even])
        if odd.any():  # slices whose hash another slice of the batch has: merged on their own
            odd = np.flatnonzero(odd)
            more, more_offset, more_number = voc.merge_all(data, begin[odd], length[odd])
            code[odd] = len(offset) + np.arange(len(odd))
            offset, number, flat = np.concatenate([offset, more_offset + len(flat)]), np.concatenate([number, more_number]), np.concatenate([flat, more])
        n_ids = number[code]
        parts.append(spans(flat, offset[code], n_ids))
        text_of = np.searchsorted(ends, at[real])
        per = np.bincount(text_of, weights=n_ids, minlength=len(batch)).astype(np.int64)
        np.add.at(counts, owner, per)
        batch.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        cuts = cut_points(text) if len(text) > MAX_CHARS else [0]
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
            if held and held + b - a > MAX_CHARS:
                flush()
            batch.append(text[a:b])
            owner.append(i)
            held += b - a
    flush()
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return ids, np.concatenate([[0], np.cumsum(counts)])


def text_groups(texts: list[str | None], most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Ranges of rows of about `most` code points, so that what is derived from them stays small."""
    out, a, held = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and held + n > most:
            out.append((a, i))
            a, held = i, 0
        held += n
    if len(texts) > a:
        out.append((a, len(texts)))
    return out


def column_groups(*columns: pa.Array, most: int = MAX_CHARS):
    """Ranges of rows of about `most` bytes in all columns, and the texts of each; no more of a batch is held as Python texts at once."""
    size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    a, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > a and held + n > most:
            yield a, i, [c.slice(a, i - a).to_pylist() for c in columns]
            a, held = i, 0
        held += n
    if len(size) > a:
        yield a, len(size), [c.slice(a).to_pylist() for c in columns]


def _sums(voc: Vocabulary, ids: np.ndarray) -> tuple[str, str, int]:
    """SHA-256 of the ids as text and of the decoded bytes, and the number of these; in pieces, so that memory is bounded."""
    told, back, size = hashlib.sha256(), hashlib.sha256(), 0
    for lo in range(0, len(ids), 1 << 18):
        some = ids[lo : lo + (1 << 18)]
        said = spans(voc.said, voc.said_start[some], voc.said_length[some])
        text = spans(voc.flat, voc.start[some], voc.length[some])
        told.update(said if lo else said[1:])
        back.update(text)
        size += len(text)
    return told.hexdigest(), back.hexdigest(), size


def digest_batches(batches, path: str):
    """Rows (doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_equal."""
    voc = vocabulary(path)
    for batch in batches:
        keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        rows: list[tuple[int, str, str, bool]] = []
        for a, b in text_groups(texts):
            ids, offset = encode(texts[a:b], path)
            for i in range(b - a):
                sha, back, size = _sums(voc, ids[offset[i] : offset[i + 1]])
                whole = (texts[a + i] or "").encode()
                rows.append((int(offset[i + 1] - offset[i]), sha, back, size == len(whole) and back == hashlib.sha256(whole).hexdigest()))
        n, ids_sha, text_sha, equal = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([keys, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(equal, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])


def encode_batches(batches, path: str):
    """Rows (doc_id, text) to doc_id, ids (int32 list), byte_offsets (where each id's bytes start in the text).

    The byte offsets let any range of ids be decoded, or mapped to the text, without the rest.
    """
    voc = vocabulary(path)
    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in text_groups(texts):
            ids, offset = encode(texts[a:b], path)
            size = voc.length[ids].astype(np.int64)
            ends = np.cumsum(size)
            base = np.concatenate([[0], ends])[offset[:-1]]
            at = ends - size - np.repeat(base, np.diff(offset))
            lists = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(ids, pa.int32()))
            places = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(keys[a:b], batch.schema.field("doc_id").type), lists, places], names=["doc_id", "ids", "byte_offsets"])


def encode_frame(documents, path: str):
    """doc_id, ids, byte_offsets of all documents (doc_id, text)."""
    from . import runtime

    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(runtime.shipped("quillmill.llm.bpe:encode_batches", path=path), "doc_id long, ids array<int>, byte_offsets array<long>")


def decode_frame(encoded, path: str):
    """doc_id, text of all rows (doc_id, ids)."""
    from . import runtime

    return encoded.select("doc_id", "ids").mapInArrow(runtime.shipped("quillmill.llm.bpe:decode_batches", path=path), "doc_id long, text string")


def decode_batches(batches, path: str):
    """Rows (doc_id, ids) to doc_id, text: the inverse of encode_batches."""
    voc = vocabulary(path)
    for batch in batches:
        texts = [None if ids is None else voc.decode(np.array(ids, dtype=np.int64)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
