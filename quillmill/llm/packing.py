"""Cost-balanced packing of token documents into sequences of bounded length.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (attention stays inside a
piece). Documents are cut at the sequence length; what is left of each goes, in descending cost,
to the lowest-cost sequence with enough room; what fits nowhere whole is cut over the cheapest
sequences with room. Only as many sequences are opened as the tokens fill, so each is filled to
the last token; what remains of a task's last window is laid into sequences whose lengths are
powers of two. There is no padding at all.

Each task packs windows of its own rows: no shuffle, memory bounded by ``window`` tokens plus the
longest document, and a lost task redoes only its own sequences. Sequence ids carry the task's
number in the upper bits.

Defined cases: a null or empty text is its end id alone; every row is packed by itself, so repeated
rows and null ids are kept; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, runtime

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, cost double"
TASK_BITS = 36


class Packer:
    """Takes documents of ids; gives pieces (document, start, length, sequence, offset, cost)."""

    def __init__(self, size: int, linear: float, quadratic: float):
        self.size, self.linear, self.quadratic = size, linear, quadratic
        self.left: list[tuple[int, int, int]] = []  # document, start, length
        self.opened = 0

    def cost(self, n: float) -> float:
        return self.linear * n + self.quadratic * n * n

    def pack(self, lengths: list[tuple[int, int]], last: bool) -> list[tuple[int, int, int, int, int, float]]:
        """Pieces of the documents (number, length) and of what earlier calls left over."""
        size, out, rest = self.size, [], self.left
        for doc, n in lengths:
            for start in range(0, n - n % size, size):
                out.append((doc, start, size, self.opened, 0, self.cost(size)))
                self.opened += 1
            if n % size:
                rest.append((doc, n - n % size, n % size))
        n_open = sum(n for _, _, n in rest) // size
        room, cost = np.full(n_open, size, dtype=np.int64), np.zeros(n_open)
        rest.sort(key=lambda x: -x[2])

        def lay(doc: int, start: int, n: int, at: int) -> None:
            spent = self.cost(n)
            out.append((doc, start, n, self.opened + at, int(size - room[at]), spent))
            room[at] -= n
            cost[at] += spent

        cut: list[tuple[int, int, int]] = []
        for doc, start, n in rest:
            open_ = np.where(room >= n, cost, np.inf)
            if n_open and (at := int(open_.argmin())) >= 0 and open_[at] < np.inf:
                lay(doc, start, n, at)
            else:
                cut.append((doc, start, n))
        self.left = []
        for doc, start, n in cut:
            while n:
                open_ = np.where(room > 0, cost, np.inf)
                at = int(open_.argmin()) if n_open else 0
                if not n_open or open_[at] == np.inf:
                    self.left.append((doc, start, n))
                    break
                k = min(n, int(room[at]))
                lay(doc, start, k, at)
                start, n = start + k, n - k
        self.opened += n_open
        if last:
            total = sum(n for _, _, n in self.left)
            sizes = [1 << b for b in range(total.bit_length()) if total >> b & 1][::-1]
            used = 0
            for doc, start, n in self.left:
                while n:
                    k = min(n, sizes[0] - used)
                    out.append((doc, start, k, self.opened, used, self.cost(k)))
                    start, n, used = start + k, n - k, used + k
                    if used == sizes[0]:
                        sizes.pop(0)
                        self.opened, used = self.opened + 1, 0
            self.left = []
        return out


def pack_batches(batches, path: str, size: int, end: int, linear: float, quadratic: float, window: int, with_ids: bool):
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << TASK_BITS
    packer = Packer(size, linear, quadratic)
    held: dict[int, np.ndarray] = {}  # ids of documents that still have pieces to come
    keys: dict[int, int | None] = {}
    waiting: list[tuple[int, int]] = []
    tokens, number = 0, 0

    def give(last: bool):
        nonlocal tokens
        pieces = packer.pack(waiting, last)
        waiting.clear()
        rows = []
        for doc, start, n, sequence, offset, cost in pieces:
            ids = held[doc]
            raw = ids[start : start + n].tobytes()
            rows.append((keys[doc], start, n, zlib.crc32(raw), len(ids), base | sequence, offset, cost, raw))
        keep = {doc for doc, _, _ in packer.left}
        for doc in [d for d in held if d not in keep]:
            del held[doc], keys[doc]
        tokens = 0
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.float64(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"]
        n_columns = 9 if with_ids else 8
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns[:n_columns], kinds, strict=False)], names=names[:n_columns])

    for batch in batches:
        ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts):
            ids, offset = bpe.encode(texts[a:b], path)
            ids = np.insert(ids, offset[1:], end).astype("<u4")
            offset = offset + np.arange(len(offset))
            for i in range(b - a):
                held[number], keys[number] = ids[offset[i] : offset[i + 1]], ids_of[a + i]
                waiting.append((number, int(offset[i + 1] - offset[i])))
                number += 1
            tokens += len(ids)
            if tokens >= window:
                yield give(False)
    yield give(True)


def pack(documents: DataFrame, path: str, size: int = 1024, end: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024, window: int = 1 << 21, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text), tokenised with the vocabulary at path and ended by `end`.

    with_ids adds the ids of each piece (little-endian unsigned 32-bit), from which sequences can be written.
    """
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    call = runtime.shipped("quillmill.llm.packing:pack_batches", path=path, size=size, end=end, linear=linear, quadratic=quadratic, window=window, with_ids=with_ids)
    return rows.mapInArrow(call, SCHEMA + (", ids binary" if with_ids else ""))
