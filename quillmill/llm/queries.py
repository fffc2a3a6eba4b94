"""The queries of the llm operators, and the SQL that some of them equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, html_text, labelled, materialise, neardup, packing, quality, rules, sharding, toxicity
from .runtime import shipped, table


def tokenizer_path(name: str) -> str:
    """A public vocabulary: from the folder in QUILLMILL_TOKENIZERS, else from the installed package."""
    if folder := os.environ.get("QUILLMILL_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return documents.mapInArrow(shipped("quillmill.llm.bpe:digest_batches", path=tokenizer_path("byte_bpe_50k.tiktoken")), bpe.DIGEST)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (labelled.fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))[0]


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", *rules.MEASURES, "base_failed", "kept", "fail_bits")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_sharding": op3_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_packing": op6_packing,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_training_order": op8_training_order,
        "op9_nearest_vectors": op9_nearest_vectors,
        "op10_rules": op10_rules,
    }


#: Words, lines and five-word windows as lists; windows keyed by their words joined by a space.
_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT row, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
repeated AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(text, '[^A-ZÀ-Þ]|×', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters FROM w LEFT JOIN covered USING (row)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
  + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT + 32 * (n_letters > 50 AND 2 * n_upper > n_letters)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the rule ledger. The others hold checksums, hashing, parsing, tokenizers or fitted models, which SQL lacks; tests meet them with brute force."""
    return {"op10_rules": _RULES_SQL}
