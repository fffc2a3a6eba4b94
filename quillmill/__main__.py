"""python -m quillmill {queries,query,tokenize,audit,sampler}: the plans from the command line."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from . import queries as Q
from .functions.text import CleanOptions
from .operators import coverage as V
from .plans import audit as A
from .plans import config as G
from .plans import report as R
from .plans import tokenize as K

DEFAULTS = {
    "data": {"text_column": "text", "val_split": 0.05, "shuffle_seed": 42, "min_text_length": 100, "max_text_length": 100_000},
    "tokenizer": {"model_path": "", "eos": 2, "train_on_n_docs": 2_000_000, "max_sentence_length": 4192},
    "tokenization": {"partitions": 8, "buffer_tokens": 1 << 20, "max_docs_per_file": None, "max_tokens": None, "skip_errors": False},
    "audit": {"sample_per_shard": 1000, "groups_per_shard": 10},
}


def settings(args: argparse.Namespace) -> G.Config:
    """Defaults, then the YAML file, then the overrides."""
    given = [G.load(args.config)] if args.config else []
    return G.resolved(G.overridden(G.merged(G.Config(DEFAULTS), *given), args.set or []))


def options(c: G.Config) -> CleanOptions:
    return CleanOptions(min_length=c.data.min_text_length, max_length=c.data.max_text_length)


def tokenize(spark: SparkSession, args: argparse.Namespace, c: G.Config) -> dict:
    profile: list[dict] = []
    t = c.tokenization
    told = K.tokenize_corpus(
        spark, args.folder, args.out, K.Tokenizer(c.tokenizer.model_path, c.tokenizer.eos), options(c), c.data.text_column, c.data.val_split, c.data.shuffle_seed,
        t.max_docs_per_file, t.max_tokens, t.partitions, t.buffer_tokens, t.skip_errors, profile,
    )
    R.write_csv(f"{args.out}/profile.csv", profile, list(profile[0]))
    return told


def audit(spark: SparkSession, args: argparse.Namespace, c: G.Config) -> dict:
    own = A.Settings(c.data.text_column, c.data.val_split, c.data.shuffle_seed, options(c), c.tokenizer.max_sentence_length, c.tokenizer.train_on_n_docs, c.tokenizer.model_path, c.audit.sample_per_shard, c.audit.groups_per_shard)
    return A.audit(spark, args.folder, args.out, own)


def sampler(spark: SparkSession, args: argparse.Namespace, c: G.Config) -> dict:
    """Seconds until the first batch and for all batches of one epoch's order; tokens a second of a context of 512."""
    began = time.perf_counter()
    orders = V.epoch_orders(spark.range(args.blocks).withColumnRenamed("id", "block_id"), 1, c.data.shuffle_seed).where(f"offset < {args.batches * args.size}").orderBy("offset")
    rows, first = 0, 0.0
    for _ in orders.toLocalIterator():
        rows += 1
        if rows == min(args.size, args.blocks):
            first = time.perf_counter() - began
    took = max(time.perf_counter() - began, 1e-9)
    return {"blocks": rows, "first_batch_seconds": first, "seconds": took, "tokens_per_second": rows * 512 / took}


def query(spark: SparkSession, args: argparse.Namespace, c: G.Config) -> dict:
    made = Q.queries()[args.name](spark, args.folder)
    if args.out:
        made.write.mode("overwrite").parquet(args.out)
        return {"written": args.out, "columns": made.columns}
    made.show(args.rows, truncate=60)
    return {"columns": made.columns}


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="quillmill", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for x in more:
            sub.add_argument(x)
        sub.add_argument("--config")
        sub.add_argument("--set", action="append", metavar="name=value")
        return sub

    command("queries")
    q = command("query", "name", "folder")
    q.add_argument("--out")
    q.add_argument("--rows", type=int, default=20)
    command("tokenize", "folder", "out")
    command("audit", "folder", "out")
    s = command("sampler")
    for name, value in (("--blocks", 1_000_000), ("--batches", 1000), ("--size", 16)):
        s.add_argument(name, type=int, default=value)
    args = p.parse_args(given)
    if args.command == "queries":
        told: dict = {"queries": sorted(Q.queries())}
    else:
        told = {"query": query, "tokenize": tokenize, "audit": audit, "sampler": sampler}[args.command](spark or SparkSession.builder.appName("quillmill").getOrCreate(), args, settings(args))
    print(json.dumps(told, default=str))
    return told


if __name__ == "__main__":
    main()
