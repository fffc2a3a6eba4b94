"""Blocks for training: from the published token files where their manifest holds, else from the Parquet shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..sources import corpus as S
from ..sources.shared import written
from . import manifest as M
from .tokenize import Blocks, Tokenizer, encoded


@dataclass(frozen=True)
class Loaded:
    """kind is binary (blocks by number, exact coverage) or stream (a frame of block_id, input_ids, labels)."""

    kind: str
    train: Blocks | DataFrame
    validation: Blocks | DataFrame


def streamed(spark: SparkSession, files: list[str], tokenizer: Tokenizer, context: int, options: T.CleanOptions, text_column: str = "text", skip_errors: bool = True) -> DataFrame:
    """block_id, input_ids, labels of the shards in the given order; a document that can't be encoded, or has no tokens, is left out."""
    place = spark.createDataFrame([(S.uri(f), i) for i, f in enumerate(files)], "shard string, shard_pos int")
    rows = S.read_corpus(spark, files, text_column).withColumn("shard", F.regexp_replace("shard", "^file:/+", "file:///")).join(place, "shard")
    rows = T.clean(C.seen(rows).withColumnRenamed("row_index", "doc_id"), "text", options).where("clean is not null")
    tokens = encoded(rows, tokenizer, "clean", ["shard_pos", "doc_id"], skip_errors).where(F.size("ids") > 1)
    return C.examples(C.blocks(written(tokens, "stream"), context))


def load(spark: SparkSession, root: str, out: str, tokenizer: Tokenizer, context: int, options: T.CleanOptions = T.CleanOptions(), text_column: str = "text", val_split: float = 0.05, seed: int = 42, workers: int = 0) -> Loaded:
    """The binaries in `out` if they are whole and belong to these settings and shards, else the shards themselves.

    Binaries need workers=0: what workers fetch ahead would run past what was trained on (ValueError).
    """
    splits = C.split_names(S.discover(root), val_split, seed)
    settings = {"val_split": val_split, "seed": seed, "min_length": options.min_length, "max_length": options.max_length, "text_column": text_column}
    if M.valid(out, tokenizer.facts(), settings, splits, root, context):
        if workers:
            raise ValueError("exact coverage needs workers=0")
        return Loaded("binary", Blocks(f"{out}/train.bin", context), Blocks(f"{out}/validation.bin", context))
    made = {k: streamed(spark, v, tokenizer, context, options, text_column) for k, v in splits.items()}
    return Loaded("stream", made["train"], made["validation"])
