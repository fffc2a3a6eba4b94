"""Operators over a corpus in its total order: split, limits, samples, token streams, blocks, epochs.

A corpus frame has `shard`, `doc_id` (the order inside a shard) and `text`. Whatever depends on the
order carries it as columns (shard_pos, doc_id); nothing relies on the order of partitions.

Defined cases, of all operators here: rows that tie in the order follow a hash of their other columns, so that
only equal rows can change places; null ids come first; an empty table gives an empty table, except that a
split needs two shards at least (ValueError); helper columns take names that the table does not have.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fresh

#: Ranges of ids, within which running sums are made by one task.
RANGES = 4096
#: Rows of a shard table (about 100 bytes each) that are broadcast at most.
BROADCAST_SHARDS = 100_000


def split_names(shards: list[str], val_share: float = 0.05, seed: int = 42) -> dict[str, list[str]]:
    """Whole shards, sorted and shuffled with the seed: the first go to validation, at least one.

    Raises ValueError for a share outside [0, 1) and where no training shard is left.
    """
    if not 0 <= val_share < 1:
        raise ValueError("the validation share must lie in [0, 1)")
    order = sorted(shards)
    random.Random(seed).shuffle(order)
    n = max(1, int(len(order) * val_share))
    if len(order) <= n:
        raise ValueError("no training shard is left")
    return {"validation": order[:n], "train": order[n:]}


def split_frame(spark: SparkSession, shards: list[str], val_share: float = 0.05, seed: int = 42) -> DataFrame:
    """shard, split, shard_pos (the order inside its split): one row a shard."""
    parts = split_names(shards, val_share, seed)
    rows = [(name, split, i) for split, names in parts.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "shard string, split string, shard_pos int")


def shard_names(corpus: DataFrame) -> list[str]:
    return [r[0] for r in corpus.select("shard").distinct().orderBy("shard").collect()]


def with_split(corpus: DataFrame, val_share: float = 0.05, seed: int = 42) -> DataFrame:
    """The corpus with split and shard_pos. The table of shards is broadcast up to BROADCAST_SHARDS rows, else joined by shuffle."""
    names = shard_names(corpus)
    place = split_frame(corpus.sparkSession, names, val_share, seed)
    return corpus.join(F.broadcast(place) if len(names) <= BROADCAST_SHARDS else place, "shard")


def seen(corpus: DataFrame) -> DataFrame:
    """Documents that count as seen: null and empty texts never do."""
    return corpus.where("text is not null and text <> ''")


def tie(df: DataFrame, *but: str) -> Column:
    """A hash of a row's other columns, for an order among rows that tie."""
    plain = [c for c, kind in df.dtypes if c not in but and "map<" not in kind and kind != "variant"]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)


def first_per_shard(corpus: DataFrame, most: int) -> DataFrame:
    """The first documents seen of each shard; WindowGroupLimit cuts before the shuffle."""
    order = Window.partitionBy("shard").orderBy("doc_id", tie(corpus, "shard", "doc_id"))
    return corpus.withColumn("rank_in_shard", F.row_number().over(order)).where(F.col("rank_in_shard") <= most)


def running(df: DataFrame, by: list[str], order: str, value: str | None, into: str, least: bool = False) -> DataFrame:
    """`into`: sum (or least) of `value` over the rows before, by `order` within `by`; the number of rows before if value is None.

    Two levels: RANGES equal ranges between the least and the greatest value of `order` (whole numbers), whose totals
    are added up first, and a window within each range, so that no group is sorted by one task. Sums
    begin at 0, the least at null. df is read twice: pass a table that is cheap to read.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = ((high - low) // RANGES + 1) if high is not None else 1
    part, base, one, inside = fresh(df, "_range", "_base", "_one", "_inside")
    df = df.withColumn(part, F.coalesce(F.floor((F.col(order) - F.lit(low)) / F.lit(width)), F.lit(-1)))
    rows = df.withColumn(one, F.lit(1)) if value is None else df
    total, nothing = (F.min, F.lit(None)) if least else (F.sum, F.lit(0))
    value = value or one
    above = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*by, part).agg(total(value).alias(base)).withColumn(base, total(base).over(above))
    before = Window.partitionBy(*by, part).orderBy(order, tie(df, order, part, *by)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(inside, total(value).over(before)).join(bases, [*by, part])
    both = F.least(inside, base) if least else F.coalesce(inside, nothing) + F.coalesce(base, nothing)
    return out.withColumn(into, both).drop(part, base, one, inside)


def before_in_order(df: DataFrame, value: str, within: list[str], into: str) -> DataFrame:
    """Sum of `value` over the rows before, in order (shard_pos, doc_id), inside `within`: prefix sums in three levels.

    Ranges of a shard come from running(); shard totals (one row a shard) give the bases.
    """
    keys = [*within, "shard_pos"]
    inside, base = fresh(df, "_in_shard", "_shards")
    above = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("shard_pos").rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(*keys).agg(F.sum(value).alias(base)).withColumn(base, F.sum(base).over(above))
    summed = running(df, keys, "doc_id", value, inside)
    return summed.join(bases, keys).withColumn(into, F.col(inside) + F.coalesce(base, F.lit(0))).drop(inside, base)


def within_budget(tokens: DataFrame, budget: int) -> DataFrame:
    """Documents up to and with the one that takes a split's tokens to the budget (rows have n_tokens)."""
    return before_in_order(tokens, "n_tokens", ["split"], "tokens_before").where(F.col("tokens_before") < budget)


def shard_seed(name: Column, seed: int) -> Column:
    return F.lit(seed) + F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def cluster_sample(corpus: DataFrame, wanted: int, clusters: int, rows_per_cluster: int, seed: int) -> DataFrame:
    """Two-stage sample of each shard: clusters by hash order, then rows by hash order inside them.

    The first `wanted mod clusters` chosen clusters give one row more; a corpus frame has row_index.
    """
    hashed = lambda *c: F.sha2(F.concat_ws("|", *[x.cast("string") for x in c]), 256)
    df = corpus.withColumn("cluster", F.floor(F.col("row_index") / rows_per_cluster).cast("long")).withColumn("shard_seed", shard_seed(F.col("shard"), seed))
    picked = df.select("shard", "shard_seed", "cluster").distinct()
    order = Window.partitionBy("shard").orderBy(hashed(F.col("shard_seed"), F.col("cluster")))
    picked = picked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= clusters)
    each, more = divmod(wanted, clusters)
    quota = F.lit(each) + F.when(F.col("pick") <= more, 1).otherwise(0)
    rows = df.join(picked.select("shard", "cluster", "pick"), ["shard", "cluster"])
    order = Window.partitionBy("shard", "cluster").orderBy(hashed(F.col("shard_seed"), F.col("cluster"), F.col("row_index")))
    return rows.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= quota)


def stand_in_ids(text: Column) -> Column:
    """Ids of white-space words by hash: a stand-in for a tokenizer that SQL can repeat."""
    words = F.filter(F.split(text, r"[ \n\t\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 31997) + 3)


def with_specials(ids: Column, bos: int | None = None, eos: int | None = None, most: int | None = None) -> Column:
    """Cut to `most` ids, then ends added."""
    if most is not None:
        ids = F.slice(ids, 1, most)
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [ids] + ([F.array(F.lit(eos))] if eos is not None else [])
    return F.concat(*parts)


def ids_in_range(ids: Column, least: int = 0, most: int = 65535) -> Column:
    """The ids; an error where one does not fit 16 bits."""
    return F.when(F.forall(ids, lambda i: (i >= least) & (i <= most)), ids).otherwise(F.raise_error(F.lit("an id does not fit 16 bits")))


def encoded_or_skipped(df: DataFrame, ids: Column, into: str = "ids") -> DataFrame:
    """The rows whose tokens were made: null (an encoder that failed) and empty ids are left out, as a stream does; binaries keep a lone end id instead."""
    return df.withColumn(into, ids).where(F.col(into).isNotNull() & (F.size(into) > 0))


def windows(ids: Column, size: int, step: int) -> Column:
    """Windows of up to size + 1 ids at every `step`, of two ids at least."""
    n = F.size(ids)
    starts = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(ids, s + 1, size + 1))


def blocks(tokens: DataFrame, size: int) -> DataFrame:
    """block_id and size + 1 ids: the stream of all ids (rows: shard_pos, doc_id, ids) cut at every `size`, neighbours sharing one id.

    Only slices are shuffled: a document is sliced for the blocks it touches. The tail is dropped.
    """
    placed = before_in_order(tokens.withColumn("n_tokens", F.size("ids").cast("long")), "n_tokens", [], "begin").where("n_tokens > 0")
    last = F.col("begin") + F.col("n_tokens") - 1
    first_block = F.greatest(F.floor((F.col("begin") - 1) / size), F.lit(0))
    parts = placed.withColumn("block_id", F.explode(F.sequence(first_block, F.floor(last / size))))
    low = F.greatest(F.col("block_id") * size - F.col("begin"), F.lit(0))
    high = F.least((F.col("block_id") + 1) * size - F.col("begin"), F.col("n_tokens") - 1)
    parts = parts.select("block_id", "begin", F.slice("ids", (low + 1).cast("int"), (high - low + 1).cast("int")).alias("part"))
    joined = parts.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("parts"))
    return joined.select("block_id", F.flatten("parts.part").alias("ids")).where(F.size("ids") == size + 1)


def examples(block_frame: DataFrame) -> DataFrame:
    """block_id, input_ids, labels: labels are the inputs moved by one."""
    n = F.size("ids")
    return block_frame.select("block_id", F.slice("ids", F.lit(1), n - 1).alias("input_ids"), F.slice("ids", F.lit(2), n - 1).alias("labels"))


def block_count(n: Column, size: int) -> Column:
    return F.floor((n - 1) / size).cast("long")


def hash_order(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def buffer_shuffled(items: DataFrame, key: str, buffer: int, seed: int) -> DataFrame:
    """Rows with `position`: shuffled inside consecutive groups of `buffer` keys (0 to 1: as they are)."""
    if buffer <= 1:
        return items.withColumn("position", F.col(key))
    group = F.floor(F.col(key) / buffer)
    order = Window.partitionBy(group).orderBy(hash_order(F.lit(seed), F.col(key)), tie(items, key))
    return items.withColumn("position", group * buffer + F.row_number().over(order) - 1)


def batches(items: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Rows with `batch` by position; drop_last leaves out a batch that isn't full."""
    out = items.withColumn("batch", F.floor(F.col("position") / size))
    if drop_last:
        full = out.groupBy("batch").agg(F.count("*").alias("rows_")).where(F.col("rows_") == size).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out
