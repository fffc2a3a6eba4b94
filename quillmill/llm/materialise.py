"""Training-order materialisation: fixed-stride token shards in a keyed pseudo-random order.

1. Tasks tokenise their rows, end each document with `end`, and cut the stream into sequences of
   `stride` tokens (the last of a task is padded). A keyed hash gives each sequence one of `waves` waves;
   sequences go to the spool of their wave in the shared folder.
2. The sequences of a wave are numbered without gaps: a task's base is the sum of the counts of
   the tasks before it.
3. A keyed Feistel network over the smallest even number of bits that holds the wave's count, with
   cycle-walking, maps the number to its slot: a permutation that needs no state. The slots of a wave
   follow those of the waves before it, so that all sequences have global slots without gaps.
4. Shard = slot in the wave div rows_per_shard, after the shards of the waves before it. Rows go straight to
   the partition of their range of shards, are sorted there, and each shard is written as one file of fixed
   stride: the row of a slot begins at its row in the shard * stride * 2 bytes, and the manifest holds the first
   slot and shard of each wave, so a reader resumes anywhere without an index.

Waves are shuffled one after another, compressed; each reads its own spool, once, which is deleted when its shards are
written. So shuffle files take 1 / `waves` of their disk, and the last shards replace their spool. A wave has at most
``LANES`` partitions, of neighbouring shards. Shard files are written under a name of their own and moved
into place; a task that is run again writes the same bytes. The manifest comes last.

Defined cases: a null or empty text gives its end id alone; an empty table gives a manifest of no
sequences and an empty index; other columns are ignored; doc_ids of a sequence may repeat or be null.
"""

from __future__ import annotations

import gc
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, runtime

SPOOL = "task int, number long, n_tokens int, doc_ids array<long>, ids binary, wave int"
#: Partitions of a wave at most.
LANES = 1 << 14
INDEX = "slot long, shard int, row long, byte_offset long, n_tokens int, ids_crc32 long, doc_ids array<long>, path string"


def spool_batches(batches, path: str, stride: int, end: int, key: int, waves: int):
    from pyspark import TaskContext

    context = TaskContext.get()
    task = context.partitionId() if context else 0
    made = 0  # sequences so far; numbers count within their waves
    numbers = [0] * waves
    lot = np.uint64((key ^ (task + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    rest, rest_docs = np.zeros(0, dtype="<u2"), []  # ids not yet cut; (documents, position after it) in them

    def rows(ids: np.ndarray, docs: list[tuple[int | None, int]], n: int):
        nonlocal made
        told, at = [], 0
        drawn = (_mix(_mix(np.arange(made, made + n, dtype=np.uint64) ^ lot) + lot) % np.uint64(waves)).tolist()
        made += n
        for k in range(n):
            lo, hi = k * stride, min((k + 1) * stride, len(ids))
            here = []
            while at < len(docs):
                here.append(docs[at][0])
                if docs[at][1] > hi:
                    break
                at += 1
                if docs[at - 1][1] == hi:
                    break
            wave = drawn[k]
            told.append((task, numbers[wave], hi - lo, here, ids[lo:hi].tobytes(), wave))
            numbers[wave] += 1
        columns = list(zip(*told, strict=True)) or [[]] * 6
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["task", "number", "n_tokens", "doc_ids", "ids", "wave"])

    for batch in batches:
        keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts):
            ids, offset = bpe.encode(texts[a:b], path)
            ids = np.insert(ids, offset[1:], end)
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("an id needs more than 16 bits")
            base = len(rest)
            docs = rest_docs + [(keys[a + i], int(base + offset[i + 1] + i + 1)) for i in range(b - a)]
            rest = np.concatenate([rest, ids.astype("<u2")])
            n = len(rest) // stride
            if n:
                yield rows(rest, docs, n)
                rest, rest_docs = rest[n * stride :].copy(), [(d, p - n * stride) for d, p in docs if p > n * stride]
            else:
                rest_docs = docs
    if len(rest):
        yield rows(rest, rest_docs, 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """The global slot of each sequence number below count: a permutation of 0 to count - 1."""
    half = max(1, ((max(count - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    round_keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for k in round_keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        x = left << shift | right
        out[walking] = x
        walking = walking[x >= count]
    return out.astype(np.int64)


def slot_batches(batches, count: int, key: int, rows_per_shard: int, lanes: int):
    """Rows of one wave with their slot in it, and the lane of their shard."""
    import zstandard

    squeeze, shards = zstandard.ZstdCompressor(level=3), -(-count // rows_per_shard)
    for batch in batches:
        slot = slots(batch.column("sequence").to_numpy(zero_copy_only=False), count, key)
        blobs = [squeeze.compress(x.as_buffer()) for x in batch.column("ids")]
        yield pa.record_batch([pa.array(slot), pa.array(slot // rows_per_shard * lanes // shards, pa.int32()), batch.column("n_tokens"), batch.column("doc_ids"), pa.array(blobs, pa.binary())], names=["slot", "lane", "n_tokens", "doc_ids", "blob"])


def shard_batches(batches, folder: str, stride: int, rows_per_shard: int, first_slot: int, first_shard: int):
    """Write each run of one shard's rows (sorted by their slot in the wave, whole) as its file; give the index rows."""
    import zstandard
    from pyarrow import fs as arrow_fs

    expand = zstandard.ZstdDecompressor()
    files, at = arrow_fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    shard, sink, made, expected = -1, None, "", 0

    def close() -> None:
        if sink is not None:
            sink.close()
            files.move(made, f"{at}/shard-{first_shard + shard:08d}.bin")

    for batch in batches:
        told = []
        for slot, n, docs, blob in zip(*(batch.column(c).to_pylist() for c in ("slot", "n_tokens", "doc_ids", "blob")), strict=True):
            if slot // rows_per_shard != shard:
                close()
                shard = slot // rows_per_shard
                made, expected = f"{at}/.{shard:08d}-{uuid.uuid4().hex}", shard * rows_per_shard
                sink = files.open_output_stream(made)
            if slot != expected:
                raise ValueError(f"slot {slot} where {expected} was expected")
            expected += 1
            raw = expand.decompress(blob)
            sink.write(raw + b"\0" * (2 * stride - len(raw)))
            row = slot - shard * rows_per_shard
            told.append((first_slot + slot, first_shard + shard, row, row * stride * 2, n, zlib.crc32(raw), docs, f"{folder}/shard-{first_shard + shard:08d}.bin"))
        columns = list(zip(*told, strict=True)) or [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slot", "shard", "row", "byte_offset", "n_tokens", "ids_crc32", "doc_ids", "path"])
    close()


def materialise(documents: DataFrame, path: str, folder: str | None = None, stride: int = 2048, end: int = 50256, key: int = 0x5EED, rows_per_shard: int = 1 << 14, waves: int = 2) -> tuple[DataFrame, str]:
    """Write all documents (doc_id, text) as token shards. Returns the index by slot and the folder, which holds manifest.json."""
    from pyarrow import fs as arrow_fs

    spark = documents.sparkSession
    folder = folder or f"{runtime.shared_dir(spark)}/order-{uuid.uuid4().hex}"
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    spool = f"{runtime.shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    made = rows.mapInArrow(runtime.shipped("quillmill.llm.materialise:spool_batches", path=path, stride=stride, end=end, key=key, waves=waves), SPOOL)
    name = "spark.sql.maxConcurrentOutputFileWriters"  # a file open for each wave, where Spark would sort a task's rows by wave
    before_ = spark.conf.get(name, None)
    spark.conf.set(name, str(waves))
    try:
        made.write.option("compression", "zstd").partitionBy("wave").parquet(spool)
    finally:
        spark.conf.unset(name) if before_ is None else spark.conf.set(name, before_)
    per_task = spark.read.schema(SPOOL).parquet(spool).groupBy("wave", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("wave").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    bases = runtime.written(per_task.select("wave", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    counts = {r["wave"]: r["n"] for r in bases.groupBy("wave").agg(F.sum("n").alias("n")).collect()}
    index, told, count, n_shards = None, [], 0, 0
    for wave in range(waves):
        n = counts.get(wave, 0)
        told.append({"first_slot": count, "sequences": n, "first_shard": n_shards})
        if not n:
            continue
        own = spark.read.schema(SPOOL.rsplit(",", 1)[0]).parquet(f"{spool}/wave={wave}")
        own._written_to = f"{spool}/wave={wave}"
        shards = -(-n // rows_per_shard)
        lanes = min(shards, LANES)
        numbered = own.join(bases.where(F.col("wave") == wave).drop("wave", "n"), "task").select((F.col("base") + F.col("number")).alias("sequence"), "n_tokens", "doc_ids", "ids")
        laid = numbered.mapInArrow(runtime.shipped("quillmill.llm.materialise:slot_batches", count=n, key=key + wave, rows_per_shard=rows_per_shard, lanes=lanes), "slot long, lane int, n_tokens int, doc_ids array<long>, blob binary")
        there = laid.repartitionById(lanes, F.col("lane")).sortWithinPartitions("slot")
        call = runtime.shipped("quillmill.llm.materialise:shard_batches", folder=folder, stride=stride, rows_per_shard=rows_per_shard, first_slot=count, first_shard=n_shards)
        part = runtime.written(there.mapInArrow(call, INDEX), "index")
        index = part if index is None else index.unionByName(part)
        count, n_shards = count + n, n_shards + shards
        runtime.discard(own)
        del numbered, laid, there, part, own
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets go of the shuffle files of this wave
    runtime.discard(bases)
    files, at = arrow_fs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    manifest = {"sequences": count, "stride": stride, "bytes_per_id": 2, "rows_per_shard": rows_per_shard, "shards": n_shards, "waves": told, "end": end, "key": key, "vocabulary_sha256": _sha256(path)}
    with files.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return spark.createDataFrame([], INDEX) if index is None else index, folder


def _sha256(path: str) -> str:
    import hashlib

    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read(folder: str, slot: int = 0):
    """The sequences from a slot on, in training order, each an array of `stride` ids (padded with 0)."""
    from pyarrow import fs as arrow_fs

    files, at = arrow_fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    size = manifest["stride"] * 2
    for wave in manifest["waves"]:
        while wave["first_slot"] <= slot < wave["first_slot"] + wave["sequences"]:
            shard, row = divmod(slot - wave["first_slot"], manifest["rows_per_shard"])
            with files.open_input_file(f"{at}/shard-{wave['first_shard'] + shard:08d}.bin") as f:
                f.seek(row * size)
                while raw := f.read(size):
                    yield np.frombuffer(raw, dtype="<u2")
                    slot += 1
