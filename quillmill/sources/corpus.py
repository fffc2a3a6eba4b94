"""A corpus of Parquet files: found, read in order, counted from footers."""

from __future__ import annotations

import os
import random
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_COLUMNS = {"text": "string", "id": "string", "url": "string", "language": "string", "language_score": "double", "token_count": "bigint", "score": "double", "int_score": "bigint"}


def discover(folder: str) -> list[str]:
    """All Parquet files below a folder, sorted. FileNotFoundError where there is none."""
    found = sorted(str(p) for p in Path(folder).rglob("*.parquet") if p.is_file())
    if not found:
        raise FileNotFoundError(f"no Parquet files below {folder}")
    return found


def read_corpus(spark: SparkSession, files: list[str], text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """text and other columns, with shard (the file's path) and row_index (its place there)."""
    df = spark.read.parquet(*files)
    more = [F.col(c) for c in (columns or []) if c != text]
    return df.select(F.col(text).alias("text"), *more, F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def passes(files: list[str], seed: int = 42, shuffled: bool = True) -> Iterator[list[str]]:
    """The files in the order of one pass after another: one generator shuffles them anew for each."""
    order, draw = sorted(files), random.Random(seed)
    while True:
        if shuffled:
            draw.shuffle(order)
        yield list(order)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a file of one row group is one task otherwise.

    Inputs that already have enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_audit_columns(df: DataFrame) -> DataFrame:
    """The optional columns of an audit, null where the files lack them. The text column must be there."""
    if "text" not in df.columns:
        raise ValueError("the files have no text column")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in AUDIT_COLUMNS.items()], *[c for c in ("shard", "row_index") if c in df.columns])


FOOTER = "path string, bytes long, rows long, row_groups long, columns array<string>, group_rows array<long>, nulls map<string, long>"


def footers(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row a file, read from the footers alone, on the executors: rows, columns, rows of each row group, and nulls by column.

    nulls lacks a column if a row group has no statistics of it.
    """

    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as arrow_fs

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                files, at = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
                with files.open_input_file(at) as f:
                    m = pq.ParquetFile(f)
                    groups = [m.metadata.row_group(i) for i in range(m.num_row_groups)]
                    nulls = {}
                    for k, name in enumerate(m.schema.names):
                        told = [g.column(k).statistics for g in groups]
                        if all(x is not None and x.has_null_count for x in told):
                            nulls[name] = sum(x.null_count for x in told)
                    rows.append((path, files.get_file_info(at).size, m.metadata.num_rows, len(groups), m.schema_arrow.names, [g.num_rows for g in groups], nulls))
            yield pd.DataFrame(rows, columns=["path", "bytes", "rows", "row_groups", "columns", "group_rows", "nulls"])

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 256))).mapInPandas(read, FOOTER)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty paragraphs of a text file, stripped, in order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n\n")).alias("position", "text"))
    return rows.select("position", F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "").alias("text")).where("text <> ''")


def uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.realpath(path)}"
