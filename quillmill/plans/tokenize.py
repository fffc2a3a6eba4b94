"""Parquet shards to one 16-bit token file a split, published whole with a manifest and a profile.

Documents are cleaned by column expressions and range-partitioned by (shard_pos, row_index); each
ordered partition is tokenised and written as a part on the file system of the output folder, which all executors
must share; the driver appends the parts in order, checks sizes and sources, and moves the result into place,
the manifest last. Filtered documents travel along without their text, so that one pass also counts
what each shard gave. Folders may be local paths or URIs that Arrow knows.

Defined cases: null and empty texts are not seen; a text that the encoder fails on stops the run, or is left out with
skip_errors; a document without tokens is its end id alone; columns beside the text are ignored.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..sources import corpus as S
from ..sources.shared import written
from . import manifest as M


@dataclass(frozen=True)
class Tokenizer:
    """A model file of sentencepiece (.model) or tokenizers (.json), loaded once a process."""

    path: str
    eos: int

    def loaded(self):
        if self.path not in _LOADED:
            if self.path.endswith(".model"):
                import sentencepiece

                model = sentencepiece.SentencePieceProcessor(model_file=self.path)
                _LOADED[self.path] = model.encode, model.decode, model.vocab_size()
            else:
                import tokenizers

                model = tokenizers.Tokenizer.from_file(self.path)
                _LOADED[self.path] = lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)], model.decode, model.get_vocab_size()
        return _LOADED[self.path]

    def special_ids(self) -> dict[str, int]:
        """pad, bos, eos, unk where the model has them (-1 where not); eos is the one of this tokenizer."""
        self.loaded()
        if self.path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return {"pad": model.pad_id(), "bos": model.bos_id(), "unk": model.unk_id(), "eos": self.eos}
        import tokenizers

        model = tokenizers.Tokenizer.from_file(self.path)
        return {k: next((i for t in names if (i := model.token_to_id(t)) is not None), -1) for k, names in (("pad", ("<pad>",)), ("bos", ("<s>", "<bos>")), ("unk", ("<unk>",)))} | {"eos": self.eos}

    def __len__(self) -> int:
        return self.loaded()[2]

    def facts(self) -> dict:
        return {"type": "sentencepiece" if self.path.endswith(".model") else "hf", "sha256": M.sha256_file(self.path), "vocab_size": self.loaded()[2], "eos": self.eos}


_LOADED: dict = {}


def encoded_texts(encode, texts: list[str | None], eos: int, skip_errors: bool) -> list[list[int] | None]:
    def each(some: list[str]) -> list[list[int] | None]:
        try:
            return encode(some)
        except Exception:
            if not skip_errors:
                raise
            return [None] if len(some) == 1 else [i for t in some for i in each([t])]

    made = iter(each([t for t in texts if t is not None]))
    return [None if t is None or (i := next(made)) is None else [*i, eos] for t in texts]


def encoded(df: DataFrame, tokenizer: Tokenizer, column: str, keep: list[str], skip_errors: bool = False) -> DataFrame:
    """keep and ids, ended by the end id; null where the text is. A vocabulary that needs more than 16 bits is a ValueError.

    skip_errors: a text that the encoder fails on has null ids.
    """
    if tokenizer.loaded()[2] > 65536:
        raise ValueError("ids of this vocabulary don't fit 16 bits")

    def run(batches):
        encode = tokenizer.loaded()[0]
        for b in batches:
            ids = encoded_texts(encode, b.column(column).to_pylist(), tokenizer.eos, skip_errors)
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    kinds = dict(df.dtypes)
    return df.select(*keep, column).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", ids array<int>")


def decoded(df: DataFrame, tokenizer: Tokenizer, keep: list[str], skip_special: bool = True) -> DataFrame:
    """keep and text of rows with ids; the special ids of the tokenizer are left out unless skip_special is False."""
    special = {i for i in tokenizer.special_ids().values() if i >= 0} if skip_special else set()

    def run(batches):
        decode = tokenizer.loaded()[1]
        for b in batches:
            texts = [None if i is None else decode([x for x in i if x not in special]) for i in b.column("ids").to_pylist()]
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = dict(df.dtypes)
    return df.select(*keep, "ids").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", text string")


def _fs(folder: str):
    """The Arrow file system of a folder, and the folder's path there."""
    from pyarrow import fs as arrow_fs

    return arrow_fs.FileSystem.from_uri(folder) if "://" in folder else (arrow_fs.LocalFileSystem(), folder)


PART = "part long, shard_pos int, seen long, kept long, tokens long, bytes long, seconds double"


def _parts(folder: str, buffer: int):
    """Write the ids of an ordered partition as one part; give what each shard has in it. buffer: tokens that are held before they are written."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, at = _fs(folder)
        made, told, held, n_held, size = f"{at}/.{uuid.uuid4().hex}", {}, [], 0, 0
        began = time.perf_counter()
        with files.open_output_stream(made) as f:
            for b in batches:
                ids, shards = b.column("ids"), b.column("shard_pos").to_numpy(zero_copy_only=False)
                flat = np.asarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<u2")
                lengths = np.array([len(x) if x.is_valid else -1 for x in ids], dtype=np.int64)
                for shard in np.unique(shards).tolist():
                    own = lengths[shards == shard]
                    old = told.setdefault(shard, [0, 0, 0, 0.0])
                    for k, v in enumerate((len(own), int((own >= 0).sum()), int(own[own > 0].sum()), (time.perf_counter() - began) * len(own) / len(shards))):
                        old[k] += v
                held.append(flat.tobytes())
                n_held, size = n_held + len(flat), size + 2 * len(flat)
                if n_held >= buffer:
                    f.write(b"".join(held))
                    held, n_held = [], 0
                began = time.perf_counter()
            f.write(b"".join(held))
        files.move(made, f"{at}/part-{part:06d}")
        rows = [(part, s, *v[:3], size, v[3]) for s, v in told.items()] or [(part, -1, 0, 0, 0, size, 0.0)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PART.split(", ")])

    return run


def profile_row(name: str, seen: int, kept: int, tokens: int, seconds: float) -> dict:
    """Counts and rates of a shard, a split or a run; no rate is divided by less than a nanosecond."""
    s = max(seconds, 1e-9)
    return {
        "name": name, "documents_seen": seen, "documents_kept": kept, "documents_filtered": seen - kept, "tokens_written": tokens, "output_bytes": 2 * tokens, "seconds": seconds,
        "documents_per_second": seen / s, "tokens_per_second": tokens / s, "output_mib_per_second": 2 * tokens / s / 2**20, "tokens_per_kept_document": tokens / kept if kept else 0.0,
    }


def tokenize_corpus(
    spark: SparkSession, root: str, out: str, tokenizer: Tokenizer, options: T.CleanOptions = T.CleanOptions(), text_column: str = "text", val_split: float = 0.05, seed: int = 42,
    max_docs_per_file: int | None = None, max_tokens: int | None = None, partitions: int = 8, buffer: int = 1 << 20, skip_errors: bool = False, profile: list | None = None,
) -> dict:
    """Write out/{train,validation}.bin. Returns documents seen, kept, filtered and tokens of each split.

    Limited runs (one limit at most, and never into the corpus folder) publish no manifest. profile gets a profile_row of each
    shard, each split and the run (seconds of tasks, added up).
    """
    limits = [x for x in (max_docs_per_file, max_tokens) if x is not None]
    if len(limits) > 1 or any(x <= 0 for x in limits):
        raise ValueError("give one positive limit at most")
    if limits and os.path.realpath(out) == os.path.realpath(root):
        raise ValueError("a limited run may not write into the corpus folder")
    found = S.discover(root)
    splits = C.split_names(found, val_split, seed)
    before = {s: M.source_records(f, root) for s, f in splits.items()}
    files, at = _fs(out)
    files.create_dir(at, recursive=True)
    if files.get_file_info(f"{at}/{M.NAME}").is_file:
        files.delete_file(f"{at}/{M.NAME}")
    staged = f".staged-{uuid.uuid4().hex}"
    told: dict[str, dict] = {}
    rows_of_profile: list[dict] = []
    try:
        for split, names in splits.items():
            place = spark.createDataFrame([(f"file://{os.path.realpath(f)}", i) for i, f in enumerate(names)], "shard string, shard_pos int")
            rows = S.read_corpus(spark, names, text_column).withColumn("shard", F.regexp_replace("shard", "^file:/+", "file:///")).join(F.broadcast(place) if len(names) <= C.BROADCAST_SHARDS else place, "shard")
            rows = C.seen(rows).withColumnRenamed("row_index", "doc_id")
            if max_docs_per_file:
                rows = C.first_per_shard(rows, max_docs_per_file)
            cleaned = T.clean(rows, "text", options).withColumn("split", F.lit(split))
            tokens = encoded(cleaned, tokenizer, "clean", ["split", "shard_pos", "doc_id"], skip_errors)
            if max_tokens:
                tokens = written(tokens.withColumn("n_tokens", F.greatest(F.size("ids"), F.lit(0)).cast("long")), "tokens")
                tokens = C.within_budget(tokens, max_tokens)
            folder = f"{out}/{staged}/{split}"
            files.create_dir(f"{at}/{staged}/{split}", recursive=True)
            ordered = tokens.select("shard_pos", "doc_id", "ids").repartitionByRange(partitions, "shard_pos", "doc_id").sortWithinPartitions("shard_pos", "doc_id")
            parts = ordered.mapInArrow(_parts(folder, buffer), PART).collect()  # one row a shard and part
            with files.open_output_stream(f"{at}/{staged}/{split}.bin") as whole:
                for part, size in sorted({(r["part"], r["bytes"]) for r in parts}):
                    name = f"{at}/{staged}/{split}/part-{part:06d}"
                    if files.get_file_info(name).size != size:
                        raise OSError(f"{name} has not {size} bytes")
                    with files.open_input_stream(name) as f:
                        shutil.copyfileobj(f, whole, 1 << 22)
                    files.delete_file(name)
            total = lambda rows: [sum(r[k] for r in rows) for k in ("seen", "kept", "tokens", "seconds")]
            for i, name in enumerate(names):
                rows_of_profile.append(profile_row(os.path.basename(name), *total([r for r in parts if r["shard_pos"] == i])))
            n_seen, n_kept, n_tokens, seconds = total(parts)
            rows_of_profile.append(profile_row(split, n_seen, n_kept, n_tokens, seconds))
            told[split] = {"seen": n_seen, "kept": n_kept, "filtered": n_seen - n_kept, "tokens": n_tokens}
        if {s: M.source_records(f, root) for s, f in splits.items()} != before:
            raise RuntimeError("the sources changed meanwhile")
        for split in splits:
            files.move(f"{at}/{staged}/{split}.bin", f"{at}/{split}.bin")
        if not limits:
            settings = {"val_split": val_split, "seed": seed, "min_length": options.min_length, "max_length": options.max_length, "text_column": text_column}
            M.write_json(f"{out}/{M.NAME}", M.manifest(tokenizer.facts(), settings, splits, root, {s: t["tokens"] for s, t in told.items()}))
    finally:
        if files.get_file_info(f"{at}/{staged}").type.name == "Directory":
            files.delete_dir(f"{at}/{staged}")
    if profile is not None:
        own = [r for r in rows_of_profile if r["name"] in splits]
        profile += [*rows_of_profile, profile_row("all", *(sum(r[k] for r in own) for k in ("documents_seen", "documents_kept", "tokens_written", "seconds")))]
    return told


class Blocks:
    """Blocks of a token file by number: input ids and labels, read through a memory map."""

    def __init__(self, path: str, size: int):
        self.ids, self.size = np.memmap(path, dtype="<u2", mode="r"), size

    def __len__(self) -> int:
        return (len(self.ids) - 1) // self.size

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        block = np.asarray(self.ids[i * self.size : (i + 1) * self.size + 1], dtype=np.int64)
        return block[:-1], block[1:]
