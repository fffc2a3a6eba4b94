"""Evaluation of any next-token model over paragraphs: token-weighted loss, and perplexity over overlapping windows.

A model is a function of a list of windows (lists of ids) that gives, for each, the losses of its targets, that is,
of every id but the first. It is called on the executors, a batch of windows at a time.

Defined cases: paragraphs of fewer than two ids have no targets; without any target there is nothing to tell (ValueError).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C

Losses = Callable[[list[list[int]]], list[list[float]]]
SCHEMA = "paragraph long, window int, nll double, targets long"


def window_losses(paragraphs: DataFrame, model: Losses, size: int, step: int) -> DataFrame:
    """paragraph, window, nll, targets of all windows of paragraphs (paragraph, ids); windows share no context."""
    bound = T.once(paragraphs.select("paragraph", "ids"), F.col("ids"), "own")
    windows = bound.select(F.col("paragraph").cast("long").alias("paragraph"), F.posexplode(C.windows(F.col("own"), size, step)).alias("window", "ids"))

    def run(batches):
        for b in batches:
            ids = b.column("ids").to_pylist()
            losses = model(ids) if ids else []
            if [len(x) for x in losses] != [len(x) - 1 for x in ids]:
                raise ValueError("a model must give one loss for each target")
            yield pa.record_batch([b.column("paragraph"), b.column("window"), pa.array([math.fsum(x) for x in losses], pa.float64()), pa.array([len(x) for x in losses], pa.int64())], names=["paragraph", "window", "nll", "targets"])

    return windows.mapInArrow(run, SCHEMA)


def evaluate(paragraphs: DataFrame, model: Losses, context: int) -> dict:
    """loss (by tokens), perplexity and targets, over windows of `context` targets that don't overlap."""
    told = window_losses(paragraphs, model, context, context).agg(F.sum("nll").alias("nll"), F.sum("targets").alias("n")).first()
    if not told["n"]:
        raise ValueError("there is no token to evaluate")
    loss = told["nll"] / told["n"]
    return {"loss": loss, "perplexity": math.exp(min(loss, 20.0)), "targets": told["n"]}


def perplexity(paragraphs: DataFrame, model: Losses, context: int) -> float:
    """exp of the mean loss of windows that overlap by half, each window counting the same, at most exp(20)."""
    told = window_losses(paragraphs, model, context, max(context // 2, 1)).agg(F.avg(F.col("nll") / F.col("targets")).alias("mean")).first()
    if told["mean"] is None:
        raise ValueError("there is no token to evaluate")
    return math.exp(min(told["mean"], 20.0))
