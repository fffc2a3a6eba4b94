"""Sampling of blocks without replacement, epoch after epoch, with a cursor that resumes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import hash_order


def epoch_orders(blocks: DataFrame, epochs: int, seed: int) -> DataFrame:
    """epoch, offset, block_id: in each epoch every block once, in hash order.

    Offsets come from two-level prefix sums over 4096 ranges of the hash, not from one global sort.
    """
    if epochs < 1:
        return blocks.select(F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("offset"), "block_id").limit(0)
    rows = blocks.select("block_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_order", hash_order(F.lit(seed), F.col("epoch"), F.col("block_id"))).withColumn("_range", F.substring("_order", 1, 3))
    above = Window.partitionBy("epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("epoch", "_range").count().select("epoch", "_range", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("epoch", "_range").orderBy("_order", "block_id")
    return rows.withColumn("_rank", F.row_number().over(inside) - 1).join(bases, ["epoch", "_range"]).select("epoch", (F.col("_base") + F.col("_rank")).alias("offset"), "block_id")


def at_positions(orders: DataFrame, positions: DataFrame, n_blocks: int) -> DataFrame:
    """position, epoch, offset, block_id: positions run on from epoch to epoch."""
    found = positions.withColumn("epoch", F.floor(F.col("position") / n_blocks).cast("int")).withColumn("offset", F.col("position") % n_blocks)
    return found.join(orders, ["epoch", "offset"])


@dataclass
class Cursor:
    """What was issued and what was committed; its state names the data it belongs to."""

    n_blocks: int
    seed: int
    identity: str
    committed: int = 0
    issued: int = 0
    context: int = 0

    def issue(self, n: int) -> range:
        start, self.issued = self.issued, self.issued + n
        return range(start, self.issued)

    def commit(self, expected: int) -> None:
        if self.issued - self.committed != expected:
            raise RuntimeError(f"{self.issued - self.committed} blocks are pending, not {expected}")
        self.committed = self.issued

    def progress(self) -> dict:
        epoch, offset = divmod(self.committed, self.n_blocks)
        return {"epoch": epoch, "offset": offset, "n_blocks": self.n_blocks, "percent": 100.0 * offset / self.n_blocks}

    def state(self) -> dict:
        if self.issued != self.committed:
            raise RuntimeError("blocks are in flight")
        epoch, offset = divmod(self.committed, self.n_blocks)
        facts = {"version": 1, "n_blocks": self.n_blocks, "seed": self.seed, "identity": self.identity, "context": self.context}
        return facts | {"position": self.committed, "epoch": epoch, "offset": offset, "order": self.order(epoch)}

    def order(self, epoch: int) -> str:
        """Hash of what fixes an epoch's order: hash_order of the seed, the epoch and each block."""
        return identity(kind="sha256(seed|epoch|block)", seed=self.seed, epoch=epoch, n_blocks=self.n_blocks)

    def load(self, state: dict) -> None:
        if self.issued != self.committed:
            raise RuntimeError("blocks are in flight")
        for name, own in (("version", 1), ("n_blocks", self.n_blocks), ("seed", self.seed), ("identity", self.identity), ("context", self.context)):
            if state.get(name) != own:
                raise ValueError(f"the state has another {name}")
        if not isinstance(state.get("position"), int) or state["position"] < 0:
            raise ValueError("the state has no valid position")
        epoch, offset = divmod(state["position"], self.n_blocks)
        if (state.get("epoch"), state.get("offset")) != (epoch, offset):
            raise ValueError("the state's epoch and offset are not those of its position")
        if state.get("order") != self.order(epoch):
            raise ValueError("the state has another order")
        self.committed = self.issued = state["position"]


def identity(**facts) -> str:
    """Hash of what the blocks were made from."""
    return hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
