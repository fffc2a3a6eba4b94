"""Shared plumbing of the llm operators: shipping functions to workers, cutting lineage, per-process caches."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, written  # noqa: F401

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shipped(target: str, **params) -> Callable:
    """A function of Arrow batches for ``mapInArrow`` that imports ``module:name`` on the worker.

    It travels by value, so that it needs no import of this package to unpickle, and the
    module's own caches live as long as the worker process.
    """
    module, name = target.split(":")
    root = _ROOT

    def call(batches):
        import importlib
        import sys as worker_sys

        if root not in worker_sys.path:
            worker_sys.path.append(root)
        return getattr(importlib.import_module(module), name)(batches, **params)

    return call


def shipped_table(target: str, **params) -> Callable:
    """As ``shipped``, for ``applyInArrow`` over one group (key, table)."""
    module, name = target.split(":")
    root = _ROOT

    def call(key, table):
        import importlib
        import sys as worker_sys

        if root not in worker_sys.path:
            worker_sys.path.append(root)
        return getattr(importlib.import_module(module), name)(key, table, **params)

    return call


#: Parts that the rows of heavy keys are spread over, and the rows below which a key is never heavy.
SPREAD, LEAST_HEAVY = 1024, 200_000


def salted_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner", spread: int | None = None, least: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key; rows of left with a heavy key are spread over several tasks.

    A key is heavy with more than 1 / `spread` of the rows (and more than `least`), so that there are fewer
    than `spread` of them, whatever the data: only these keys reach the driver and are broadcast, and right
    is repeated fewer than 2 * `spread` times in all. counts (key, n) saves counting. Keys of left aren't null.
    """
    spread, least = spread or SPREAD, LEAST_HEAVY if least is None else least
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.select(key, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(total // spread, least)
    if total <= limit:
        return left.join(right, key, how)
    heavy = counts.where(F.col("n") > limit).collect()
    if not heavy:
        return left.join(right, key, how)
    kind = counts.schema[key].dataType.simpleString()
    salts = left.sparkSession.createDataFrame([(r[key], -(-r["n"] // limit)) for r in heavy], f"{key} {kind}, salts_ long")
    many = F.coalesce("salts_", F.lit(1))
    salted = left.join(F.broadcast(salts), key, "left").withColumn("salt_", F.monotonically_increasing_id() % many).drop("salts_")
    repeated = right.join(F.broadcast(salts), key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts_")
    return salted.join(repeated, [key, "salt_"], how).drop("salt_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
