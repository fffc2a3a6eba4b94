"""Audit of a corpus: inventory, lengths, histograms, duplicates across splits, provenance.

Defined cases: null values are no values; groups without values have null statistics; an empty table gives
empty tables, or one row of zeros and nulls where one row is told; equal rows count as often as they are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .corpus import running

EDGES = (0, 100, 500, 1000, 5000, 10_000, 50_000, 100_000)


def percentiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by, and of each share the value at index min(n - 1, int(share * n)) of the sorted values: no interpolation.

    For groups of any size: values are counted first, and ranks found by running sums over distinct values.
    """
    n, upto, whole = T.fresh(df, "_n", "_upto", "_all")
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias(n))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn(upto, F.sum(n).over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))).withColumn(whole, F.sum(n).over(w))
    at = lambda s: F.least(F.col(whole) - 1, F.floor(F.lit(s) * F.col(whole)))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col(upto) > at(s), F.col(column))).alias(name) for name, s in shares.items()])


def modal(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, and the most frequent value (ties: the least)."""
    counts = df.groupBy(by, column).count()
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v")))["v"].alias(column))


def value_counts_json(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, and counts of each value as a JSON object with sorted keys."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).count()
    entries = F.array_sort(F.collect_list(F.struct(column, "count")))
    return counts.groupBy(by).agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """low, high (null: no end), n: half-open bins, empty ones with 0."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(EDGES, [*EDGES[1:], None], strict=True))], "bin int, low long, high long")
    where = sum((F.when(F.col(column) >= e, 1).otherwise(0) for e in EDGES[1:]), F.lit(0))
    counts = df.where(F.col(column).isNotNull()).groupBy(where.alias("bin")).count()
    return bins.join(counts, "bin", "left").select("low", "high", F.coalesce("count", F.lit(0)).alias("n"))


def across_splits(df: DataFrame, key: Column) -> DataFrame:
    """key, its number of rows, and the shards of either split, for keys found in both; null and empty keys don't count."""
    rows = df.select(key.cast("string").alias("key"), "shard", "split").where("key is not null and key <> ''")
    of = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == s, F.col("shard")))), ", ")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), of("train").alias("train_shards"), of("validation").alias("validation_shards"))
    return groups.where("train_shards <> '' and validation_shards <> ''")


def lengths(df: DataFrame, least: int, most: int, byte_limit: int) -> DataFrame:
    """One row over a cleaned corpus (text, clean, scrubbed_length)."""
    n = F.length("text")
    stats = df.agg(
        F.count("text").alias("texts"),
        F.count_if(n < least).alias("below_min"),
        F.count_if(F.col("clean").isNull()).alias("filtered"),
        F.count_if(F.col("scrubbed_length") > most).alias("would_truncate"),
        F.count_if(T.over_bytes(F.col("text"), byte_limit)).alias("over_byte_limit"),
        F.median(n).alias("median_chars"),
    )
    return stats.crossJoin(F.broadcast(percentiles(df.select(F.lit(0).alias("_one"), n.alias("_chars")), ["_one"], "_chars", {"p95_chars": 0.95}).drop("_one")))


def provenance(corpus: DataFrame, shards: DataFrame, options: T.CleanOptions, limit: int, byte_limit: int) -> DataFrame:
    """Of each shard (shard, split, shard_pos) the accepted documents among the first `limit`, and those longer than `byte_limit`.

    Order: that of the shuffled shards, of which those of validation are the first. Shards are counted whole; documents are numbered in the one shard alone
    in which the limit falls, if it does.
    """
    place = shards.withColumn("shard_pos", F.col("shard_pos") + F.when(F.col("split") == "train", 1_000_000_000).otherwise(0))
    kept = T.clean(corpus.select("shard", "doc_id", "text"), options=options).where("clean is not null")
    kept = kept.select("shard", "doc_id", T.over_bytes(F.col("clean"), byte_limit).cast("long").alias("over"))
    counts = written(kept.groupBy("shard").agg(F.count("*").alias("n"), F.sum("over").alias("over")), "accepted")
    above = Window.orderBy("shard_pos").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = place.join(counts, "shard", "left").na.fill(0, ["n", "over"]).withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    some = F.greatest(F.least(F.col("n"), F.lit(limit) - F.col("before")), F.lit(0))
    placed = placed.select("shard", "split", "n", "over", "before", some.alias("accepted"))
    cut = placed.where("accepted > 0 and accepted < n").first()
    if cut is None:
        return placed.select("shard", "split", "accepted", F.when(F.col("accepted") > 0, F.col("over")).otherwise(0).alias("over_limit"))
    own = running(written(kept.where(F.col("shard") == cut["shard"]), "cut"), ["shard"], "doc_id", None, "rank").where(F.col("rank") < cut["accepted"])
    part = own.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("part"))  # one row
    over = F.when(F.col("accepted") == 0, 0).when(F.col("accepted") < F.col("n"), F.col("part")).otherwise(F.col("over"))
    return placed.crossJoin(F.broadcast(part)).select("shard", "split", "accepted", over.alias("over_limit"))


def throughput(steps: DataFrame, every: int) -> DataFrame:
    """interval, documents, tokens, seconds since the interval before began, documents_per_second of steps (event_id, ts, value).

    The first interval has no seconds; an interval that took none has no rate.
    """
    each = steps.groupBy(F.floor(F.col("event_id") / every).alias("interval")).agg(F.count("*").alias("documents"), F.sum("value").alias("tokens"), F.min("ts").alias("began"))
    before = F.lag("began").over(Window.orderBy("interval"))  # one row an interval
    timed = each.withColumn("seconds", (F.unix_micros(F.col("began").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6)
    rate = F.when(F.col("seconds") > 0, F.round(F.col("documents") / F.col("seconds"), 6))
    return timed.select("interval", "documents", F.round("tokens", 6).alias("tokens"), "seconds", rate.alias("documents_per_second"))
