"""The corpus pipeline: documents to packed training sequences.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

1. quality: the quadratic discriminant, fitted on the labelled documents among docs; score below 0.5 goes.
2. rules: the rule ledger under policy web-1; documents that fail it go.
3. near_duplicates: of each class of near copies the row of the least doc_id stays.
4. packing: sequences of at most 1024 tokens, a row for each piece.

Nulls, empty texts, repeated rows and empty tables: as the operators' docstrings define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import neardup, packing, quality, rules, runtime
from quillmill.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, runtime.table(spark, sf_dir, "labels")))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs, "web-1")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.survivors(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("rules", keep_by_rules),
    ("near_duplicates", keep_one_of_near_copies),
    ("packing", pack_sequences),
]
#: The stages hold a fitted classifier, hashing of shingles and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
