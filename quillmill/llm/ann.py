"""Largest inner products by collision-counting hashing.

Vectors of a block are lifted by one component to a common norm M, queries are scaled to it, so that
the nearest lifted vector has the largest inner product. Each of ``PROJECTIONS`` random directions
keeps the block's projections sorted. Around a query's own projections, windows of one half-width
are widened step by step (virtual rehashing: the wider window holds the narrower), and each
direction in whose window a vector falls counts as a collision. Each direction is cut by ``MARKS`` marks at equal
numbers of vectors, and its windows end at the next mark outside, so that they hold all of the width: the vectors
before each mark are a bitmap, a window is the difference of two, and collisions of 64 vectors are counted at once. A vector within d of the query
collides in a direction with probability P(|N(0, 1)| < width / d); vectors with enough collisions for
most of those within width / REACH (90 % of those just there) are verified by their inner product in double precision. A query
ends when its k-th best verified vector is within width / REACH.

Vectors are divided into blocks of bounded size by a hash of their id. The index of a block is built once, by
the one task that gets its vectors, and written to the shared folder; tasks then take a block and a
part of the queries, and read both from there. So each vector is shuffled once, whatever the number of queries,
and otherwise only results travel; the best of a query's blocks are merged. Every vector is indexed. Reading
and searching grow with queries times vectors, as the queries are a share of the vectors.

Defined cases: vectors that are null, zero, or hold a null or non-finite component, and rows without an id, take
no part; vectors meet those of their own length only; rows that repeat an id are one vector (the least);
with fewer than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

PROJECTIONS = 128
#: Windows are REACH times the distance whose vectors they must hold; widths grow by GROWTH.
REACH = 0.9
GROWTH = 1.3
#: Parts of a direction; at most 255.
MARKS = 128
BLOCK_ROWS = 1 << 16
#: Queries of a task at most; and of all tasks' files of queries, the rows read at once.
QUERY_ROWS, READ_ROWS = 1 << 16, 1 << 12
#: Standard deviations below the expected collisions at which a vector is still verified.
SAFETY = 1.28
SCHEMA = "query_id long, vec_id long, score double, verified long"


def bit_counts(rows: np.ndarray) -> list[np.ndarray]:
    """Of each bit the number of rows that have it, as planes of binary digits, the lowest first (full adders on whole words)."""
    planes = []
    while len(rows):
        carried = []
        while len(rows) > 1:
            k = len(rows) // 3
            if k:
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                half = a ^ b
                carried.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * k :]])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        planes.append(rows[0])
        rows = np.concatenate(carried) if carried else rows[:0]
    return planes


def at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """The bits whose number is at least this."""
    above, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    if least >> len(planes) > 0:
        return above
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    return above | equal


class Index:
    """Projections of one block, in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 20):
        by_id = np.argsort(ids)
        self.ids, self.vectors, self.seed = ids[by_id], vectors[by_id], seed
        projected = self._projected()
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.uint16 if len(ids) <= 1 << 16 else np.int32)
        self.start = self._first_width()
        places = self._places()[:-1]
        self.values = np.take_along_axis(projected, self.order[:, places].astype(np.int64), 1)
        self._arrange()

    def _first_width(self) -> float:
        """Half the window of the usual distance to a nearest vector, that of the vectors at 32 fixed places."""
        n = len(self.ids)
        some = np.unique(np.linspace(0, n - 1, 32).astype(np.int64))
        score = self.vectors[some] @ self.vectors.T
        score[np.arange(len(some)), some] = -np.inf
        best = score.max(1) / (np.sqrt((self.vectors[some] ** 2).sum(1)) * self.norm)
        usual = np.median(np.sqrt(np.maximum(2 - 2 * best, 0))) if n > 1 else 0.0
        return max(0.1, 0.5 * float(usual)) * REACH

    def _projected(self) -> np.ndarray:
        squares = (self.vectors**2).sum(1)
        self._direct(squares)
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(self.norm**2 - squares, 0))]) / self.norm
        return np.ascontiguousarray((lifted @ self.directions).T)

    def _direct(self, squares: np.ndarray) -> None:
        self.norm = math.sqrt(float(squares.max()))
        self.directions = np.random.default_rng(self.seed).standard_normal((self.vectors.shape[1] + 1, PROJECTIONS))

    def _places(self) -> np.ndarray:
        """Of each mark the number of vectors before it."""
        marks = min(MARKS, len(self.ids))
        return np.arange(marks + 1) * len(self.ids) // marks

    def _arrange(self) -> None:
        """before[j, c]: bitmap of the vectors before mark c in direction j."""
        n, places = len(self.ids), self._places()
        part = np.repeat(np.arange(len(places) - 1, dtype=np.uint8), np.diff(places))
        marks = np.arange(len(places), dtype=np.uint8)[:, None]
        self.before = np.zeros((PROJECTIONS, len(places), -(-n // 64) * 8), dtype=np.uint8)
        of = np.empty(n, dtype=np.uint8)
        for order, bits in zip(self.order, self.before, strict=True):
            of[order] = part
            bits[:, : -(-n // 8)] = np.packbits(of < marks, axis=1, bitorder="little")
        self.before = self.before.view(np.uint64)
        inside = math.erf(REACH / math.sqrt(2))
        self.enough = math.floor(PROJECTIONS * inside - SAFETY * math.sqrt(PROJECTIONS * inside * (1 - inside)))

    def dump(self) -> bytes:
        """The vectors and, of each direction, their order and the projections at the marks; bitmaps are made again."""
        short = self.vectors.astype(np.float32)
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=short if np.array_equal(short, self.vectors) else self.vectors, order=self.order, values=self.values, seed=self.seed, start=self.start)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Index:
        self, parts = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.ids, self.vectors, self.order, self.seed = parts["ids"], parts["vectors"].astype(np.float64), parts["order"], int(parts["seed"])
        self.start, self.values = float(parts["start"]), parts["values"]
        self._direct((self.vectors**2).sum(1))
        self._arrange()
        return self

    def window(self, centre: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each direction the last mark before the window and the first behind it."""
        low = (self.values < (centre - width)[:, None]).sum(1) - 1
        return np.maximum(low, 0), (self.values <= (centre + width)[:, None]).sum(1)

    def colliding(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The vectors with enough collisions, as flags."""
        each = np.arange(PROJECTIONS)
        often = at_least(bit_counts(self.before[each, high] ^ self.before[each, low]), self.enough)
        return np.unpackbits(often.view(np.uint8), bitorder="little", count=len(self.ids)).view(bool)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k nearest found, and the number of vectors verified."""
        n = len(self.ids)
        own = np.searchsorted(self.ids, query_id)
        has_own = own < n and self.ids[own] == query_id
        wanted = min(k, n - has_own)
        if wanted <= 0:
            return self.ids[:0], np.zeros(0), 0
        unit = np.append(query / math.sqrt(float((query**2).sum())), 0.0)
        centre = unit @ self.directions
        known = np.zeros(n, dtype=bool)
        if has_own:
            known[own] = True
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        length = math.sqrt(float((query**2).sum()))
        width = self.start
        while True:
            low, high = self.window(centre, width)
            whole = bool((low == 0).all() and (high == self.values.shape[1]).all())
            fresh = np.flatnonzero(~known if whole else self.colliding(low, high) & ~known)
            if len(fresh):
                known[fresh] = True
                rows = np.concatenate([rows, fresh])
                scores = np.concatenate([scores, np.einsum("ij,j->i", self.vectors[fresh], query)])
            if whole:
                break
            if len(rows) >= wanted:
                kth = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
                distance = math.sqrt(max(0.0, 2 - 2 * kth / (length * self.norm)))
                if distance <= width / REACH:
                    break
                width = min(width * GROWTH, max(distance * REACH, width * 1.02)) if distance < width * GROWTH / REACH else width * GROWTH
            else:
                width *= GROWTH * (1.5 if len(rows) == 0 and width < 0.5 else 1)
        best = np.lexsort((self.ids[rows], -scores))[:wanted]
        return self.ids[rows[best]], scores[best], len(rows)


def write_index(key, table: pa.Table, folder: str) -> pa.Table:
    """The index of one block, as a file of the shared folder; a task that is run again writes the same."""
    from pyarrow import fs as arrow_fs

    files, at = arrow_fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    block, n = key[0].as_py(), table.num_rows
    vectors = np.asarray(table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
    made = f"{at}/.{block}-{uuid.uuid4().hex}"
    with files.open_output_stream(made) as f:
        f.write(Index(table.column("vec_id").to_numpy(), vectors).dump())
    files.move(made, f"{at}/{block}.npz")
    return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64())})


def search_batches(batches, folder: str, queries: str, parts: int, k: int):
    """Rows (id): block id // parts is searched for part id % parts of the queries."""
    import pyarrow.dataset as ds
    from pyarrow import fs as arrow_fs

    files, at = arrow_fs.FileSystem.from_uri(folder)
    asked_files, asked_at = arrow_fs.FileSystem.from_uri(queries)
    held, index = -1, None
    for batch in batches:
        for task in batch.column("id").to_pylist():
            block, part = divmod(task, parts)
            where = f"{asked_at}/part={part}"
            if arrow_fs.FileType.NotFound in (asked_files.get_file_info(where).type, files.get_file_info(f"{at}/{block}.npz").type):
                continue  # no vector has a hash of this part, or of this block
            if block != held:
                with files.open_input_stream(f"{at}/{block}.npz") as f:
                    held, index = block, Index.load(f.read())
            for some in ds.dataset(where, filesystem=asked_files, format="parquet").to_batches(columns=["vec_id", "embedding"], batch_size=READ_ROWS):
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                for i, v in zip(some.column("vec_id").to_pylist(), some.column("embedding"), strict=True):
                    query = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if len(query) == index.vectors.shape[1]:
                        found, scores, verified = index.search(i, query, k)
                        out.append((np.full(len(found), i), found, scores, np.full(len(found), verified)))
                if out:
                    q, found, scores, verified = (np.concatenate(x) for x in zip(*out, strict=True))
                    columns = [pa.array(q.astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(scores), pa.array(verified.astype(np.int64))]
                    yield pa.record_batch(columns, names=["query_id", "vec_id", "score", "verified"])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score, verified: the k nearest found of every vector for which is_query holds."""
    spark = vectors.sparkSession
    rows = runtime.written(valid(vectors).withColumn("length", F.size("embedding")), "vectors")
    lengths = [(r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()]  # one row a length
    blocks, first = 0, []
    for length, n in lengths:
        first.append((length, blocks, -(-n // BLOCK_ROWS)))
        blocks += first[-1][2]
    asked = rows.where(is_query)
    n_asked = asked.count()
    # Few blocks: their queries are divided over the cores. Many: a task has QUERY_ROWS queries at most.
    parts = max(-(-spark.sparkContext.defaultParallelism // max(blocks, 1)), -(-n_asked // QUERY_ROWS), 1)
    folder, queries = (f"{runtime.shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("index", "asked"))
    hashed = lambda count: F.pmod(F.xxhash64("vec_id"), count)
    asked.select("vec_id", "embedding", hashed(F.lit(parts)).alias("part")).repartition(min(parts, 1 << 14), "part").write.partitionBy("part").parquet(queries)
    placed = rows.join(F.broadcast(spark.createDataFrame(first, "length int, first long, own long")), "length")
    placed = placed.select((F.col("first") + hashed(F.col("own"))).alias("block"), "vec_id", "embedding")
    call = runtime.shipped_table("quillmill.llm.ann:write_index", folder=folder)
    placed.groupBy("block").applyInArrow(call, "block long, n long").agg(F.sum("n")).collect()
    tasks = spark.range(0, blocks * parts, 1, max(1, min(blocks * parts, 1 << 16)))
    found = tasks.mapInArrow(runtime.shipped("quillmill.llm.ann:search_batches", folder=folder, queries=queries, parts=parts, k=k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    runtime.discard(rows)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
