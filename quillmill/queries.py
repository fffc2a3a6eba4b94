"""Queries over the tables of a folder; each has its SQL in oracle.py where SQL can express it.

The virtual shard of a document is its source; the order inside a shard is doc_id. Defined cases are those of
the operators; a query over an empty table is empty, or tells one row of zeros and nulls where it tells one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lm
from .functions import text as T
from .operators import audit as A
from .operators import corpus as C
from .operators import coverage as V
from .sources import corpus as S
from .sources.shared import written

OPTIONS = T.CleanOptions(min_length=100, max_length=100_000)
SIZE = 512
#: Accepted documents that a tokenizer is trained on at most.
TRAIN_DOCUMENTS = 2_000_000


#: The columns that queries read; whatever else a table has is left in its file.
COLUMNS = {
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic"), "pages": ("page_id", "url", "html"), "conversations": ("conv_id", "turn", "role", "text"),
    "embeddings": ("vec_id", "embedding", "label"), "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return rows.select(*[c for c in COLUMNS[name] if c in rows.columns])


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents by shard; those without a source are in the shard of the empty name."""
    return S.spread(_table(spark, d, "documents")).withColumn("source", F.coalesce("source", F.lit(""))).withColumnRenamed("source", "shard")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return C.with_split(_corpus(spark, d))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return T.clean(_split(spark, d), options=OPTIONS, keep_length="scrubbed_length")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """split, shard_pos, shard, doc_id, ids (ended by 2) of the documents that cleaning keeps."""
    kept = T.clean(C.seen(_split(spark, d)), options=OPTIONS).where("clean is not null")
    kept = T.once(kept.select("split", "shard_pos", "shard", "doc_id", "clean"), C.with_specials(C.stand_in_ids(F.col("clean")), eos=2), "made")
    return kept.select("split", "shard_pos", "shard", "doc_id", C.ids_in_range(F.col("made")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


def _token_table(spark: SparkSession, d: str) -> DataFrame:
    """The same, made once and written, for queries that read it more than once."""
    return written(_tokens(spark, d), "tokens")


def _text(ids):
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def clean_profile(spark, d):
    rows = T.clean(C.seen(_split(spark, d)), options=OPTIONS)
    kept = F.col("clean").isNotNull()
    return rows.groupBy("split", "shard").agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"), F.coalesce(F.sum(F.length("clean")), F.lit(0)).alias("chars_kept"))


def clean_text(spark, d):
    return T.clean(_table(spark, d, "documents"), options=OPTIONS).select("doc_id", "clean")


def clean_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", T.scrub(F.col("html")).alias("clean"))


def length_filter_reasons(spark, d):
    reason = F.when(F.length("text") < 100, "raw").when(F.col("clean").isNull(), "cleaned").otherwise("kept")
    return T.clean(_table(spark, d, "documents"), options=OPTIONS).groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))


def _conversations(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


def truncate_paragraph(spark, d):
    return _conversations(spark, d).select("conv_id", T.truncate(F.col("text"), 600).alias("text"))


def chunk_paragraphs(spark, d):
    return _conversations(spark, d).select("conv_id", F.posexplode(T.chunks(F.col("text"), 400, 0, 20)).alias("chunk", "text"))


def chunk_overlap(spark, d):
    return _conversations(spark, d).select("conv_id", F.posexplode(T.chunks(F.col("text"), 400, 250, 20)).alias("chunk", "text"))


def conversation_paragraphs(spark, d):
    parts = _conversations(spark, d).select("conv_id", F.posexplode(F.split("text", "\n\n")).alias("position", "text"))
    return parts.select("conv_id", "position", T.strip(F.col("text")).alias("text")).where("text <> ''")


def shard_split(spark, d):
    return C.split_frame(spark, C.shard_names(_corpus(spark, d)))


def _estimate(corpus, most_per_shard=None):
    per = corpus.groupBy("shard").agg(F.count("*").alias("n"))
    n = F.col("n") if most_per_shard is None else F.least("n", F.lit(most_per_shard))
    return per.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("estimate"))


def estimated_documents(spark, d):
    return _estimate(_corpus(spark, d))


def worker_files(spark, d):
    return _split(spark, d).groupBy(F.pmod("shard_pos", F.lit(4)).alias("worker"), "split").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("documents"))


def shard_inventory(spark, d):
    rows = _split(spark, d).join(_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    base = rows.groupBy("split", "shard").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("token_sum"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(F.col("quality").isNull()).alias("null_scores"), F.median("n_chars").alias("median_chars"))
    p = A.percentiles(rows, ["shard"], "n_chars", {"p05_chars": 0.05, "p95_chars": 0.95})
    return base.join(p, "shard").join(A.modal(rows, "shard", "lang"), "shard")


def language_counts(spark, d):
    return A.value_counts_json(_corpus(spark, d), "shard", "lang")


def cluster_sample(spark, d):
    rows = C.running(_corpus(spark, d).select("shard", "doc_id"), ["shard"], "doc_id", None, "row_index")
    return C.cluster_sample(rows, 7, 3, 10, 42).select("shard", "cluster", "pick", "draw", "doc_id")


def shard_seeds(spark, d):
    return _corpus(spark, d).select("shard").distinct().select("shard", C.shard_seed(F.col("shard"), 42).alias("seed"))


def length_stats(spark, d):
    return A.lengths(_cleaned(spark, d), OPTIONS.min_length, OPTIONS.max_length, 4192)


def histogram_chars(spark, d):
    return A.histogram(_table(spark, d, "documents").select(F.length("text").alias("x")), "x").na.fill(-1, ["high"])


def histogram_tokens(spark, d):
    return A.histogram(_tokens(spark, d).select(F.col("n_tokens").alias("x")), "x").na.fill(-1, ["high"])


def histogram_bytes(spark, d):
    return A.histogram(_table(spark, d, "documents").select(F.octet_length("text").alias("x")), "x").na.fill(-1, ["high"])


def split_summary(spark, d):
    return _split(spark, d).groupBy("split").agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("documents"), F.sum("n_chars").alias("token_sum"), F.median("n_chars").alias("median_chars"))


def cross_split_duplicates(spark, d):
    return A.across_splits(_cleaned(spark, d), T.fingerprint(F.col("clean")))


def cross_split_ids(spark, d):
    return A.across_splits(_split(spark, d), F.col("doc_id"))


def cross_split_languages(spark, d):
    return A.across_splits(_split(spark, d), F.col("lang"))


def _pages(spark, d):
    """Pages with the virtual shard of their number modulo 8, and its split."""
    rows = _table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("p"), F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(8)).cast("string")).alias("shard"))
    return C.with_split(rows)


def cross_split_urls(spark, d):
    return A.across_splits(_pages(spark, d), F.col("url"))


def cross_split_hosts(spark, d):
    return A.across_splits(_pages(spark, d), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))


def audit_summary(spark, d):
    rows = _cleaned(spark, d)
    return rows.agg(F.count("*").alias("documents"), F.count_distinct("shard").alias("shards"), F.sum("n_chars").alias("token_sum"), F.count("clean").alias("kept"), F.count_distinct(T.fingerprint(F.col("clean"))).alias("distinct_texts"))


def tokenizer_provenance(spark, d):
    corpus = _corpus(spark, d)
    return A.provenance(corpus, C.split_frame(spark, C.shard_names(corpus)), OPTIONS, TRAIN_DOCUMENTS, 4192)


def doc_limit(spark, d):
    return C.first_per_shard(C.seen(_corpus(spark, d)), 5).select("shard", "doc_id", "rank_in_shard")


def token_budget(spark, d):
    return C.within_budget(_token_table(spark, d), 20_000).select("split", "shard", "doc_id", "n_tokens", "tokens_before")


def token_rollup(spark, d):
    return _tokens(spark, d).rollup("split", "shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), (2 * F.sum("n_tokens")).alias("bytes"), F.round(F.sum("n_tokens") / F.count("*"), 6).alias("tokens_per_document"))


def token_ids(spark, d):
    return _tokens(spark, d).select("doc_id", _text(F.col("ids")).alias("ids"))


def encode_specials(spark, d):
    ids = C.with_specials(C.stand_in_ids(F.col("text")), bos=1, eos=2)
    return _table(spark, d, "documents").select("doc_id", _text(ids).alias("ids"))


def document_chunks(spark, d):
    rows = C.seen(_corpus(spark, d)).select("shard", "doc_id", F.length("text").alias("n"))
    rows = C.running(rows, ["shard"], "doc_id", None, "before")
    return rows.groupBy("shard", F.floor(F.col("before") / 16).alias("chunk")).agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))


def pack_blocks(spark, d):
    made = C.examples(C.blocks(written(_tokens(spark, d).where("split = 'train'"), "tokens"), SIZE))
    return made.select("block_id", F.size("input_ids").alias("size"), F.md5(_text(F.col("input_ids"))).alias("inputs_md5"), F.md5(_text(F.col("labels"))).alias("labels_md5"))


def block_counts(spark, d):
    return _tokens(spark, d).groupBy("split").agg(F.sum("n_tokens").alias("tokens")).select("split", "tokens", C.block_count(F.col("tokens"), SIZE).alias("blocks"))


def _block_ids(spark, d):
    """Numbers of the training split's blocks of 64: the tokens are counted once."""
    n = _tokens(spark, d).where("split = 'train'").agg(C.block_count(F.sum("n_tokens"), 64).alias("n")).first()["n"]
    return spark.range(max(n or 0, 0)).withColumnRenamed("id", "block_id")


def buffer_shuffle(spark, d):
    return C.buffer_shuffled(_block_ids(spark, d), "block_id", 256, 42).select("block_id", "position")


def batches_drop_last(spark, d):
    placed = C.buffer_shuffled(_block_ids(spark, d), "block_id", 256, 42)
    return C.batches(placed, 16, True).groupBy("batch").agg(F.count("*").alias("n"), F.min("block_id").alias("least"), F.sum("block_id").alias("total"))


def coverage_order(spark, d):
    return V.epoch_orders(_block_ids(spark, d), 2, 42)


def coverage_cursor(spark, d):
    blocks = _block_ids(spark, d)
    positions = spark.range(0, 200).select((F.col("id") * 37).alias("position"))
    n = blocks.count()
    epochs = min(8, 199 * 37 // max(n, 1) + 1)  # those that a position falls in
    return V.at_positions(V.epoch_orders(blocks, epochs, 42), positions, max(n, 1)).select("position", "epoch", "offset", "block_id", F.round(100.0 * F.col("offset") / n, 6).alias("percent"))


def _exploded_windows(spark, d, size, step):
    made = T.once(_corpus(spark, d).select("doc_id", "text"), C.stand_in_ids(F.col("text")), "made")
    rows = made.select("doc_id", F.posexplode(C.windows(F.col("made"), size, step)).alias("window", "ids"))
    return rows.select("doc_id", "window", F.size("ids").alias("n"), F.md5(_text(F.col("ids"))).alias("ids_md5"))


def eval_chunks(spark, d):
    return _exploded_windows(spark, d, 128, 128)


def ppl_windows(spark, d):
    return _exploded_windows(spark, d, 128, 64)


def _rates(name):
    def query(spark, d):
        steps = spark.range(0, 1201).select(F.col("id").alias("step"))
        return steps.select("step", F.round(lm.schedule(name, F.col("step"), 3e-4, 3e-5, 100, 1000), 10).alias("rate"))

    return query


def _events(spark, d):
    return _table(spark, d, "events").select("event_id", "event_type", "value")


def interval_metrics(spark, d):
    loss = F.avg("value")
    return _events(spark, d).groupBy(F.floor(F.col("event_id") / 100).alias("interval")).agg(F.count("*").alias("steps"), F.round(loss, 6).alias("loss"), F.round(lm.perplexity(loss / 10), 6).alias("perplexity"))


def interval_throughput(spark, d):
    return A.throughput(_table(spark, d, "events").select("event_id", "ts", "value"), 100)


def eval_mean(spark, d):
    batches = _events(spark, d).where("event_id < 800").groupBy(F.floor(F.col("event_id") / 16).alias("batch")).agg(F.avg("value").alias("loss"))
    return batches.where("batch < 50").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("batches"))


def best_so_far(spark, d):
    rows = C.running(_events(spark, d), ["event_type"], "event_id", "value", "best_before", least=True)
    return rows.where(F.col("best_before").isNull() | (F.col("value") < F.col("best_before"))).select("event_type", "event_id", F.round("value", 6).alias("value"))


def keep_last_n(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("event_id"), F.desc("value"))
    return _events(spark, d).withColumn("age", F.row_number().over(w)).where("age <= 5").select("event_type", "event_id", "age")


def latest_complete(spark, d):
    return _events(spark, d).where("value is not null").groupBy("event_type").agg(F.max_by("event_id", "event_id").alias("latest"))


def _logits(spark, d):
    """vec_id, logits: arrays throughout, so that nothing is shuffled by vec_id."""
    return T.once(_table(spark, d, "embeddings").select("vec_id", "embedding"), F.transform("embedding", lambda x: F.round(x.cast("double") * 10, 4)), "logits").select("vec_id", "logits")


def _each(column, value, digits=9):
    return F.posexplode(F.transform(column, lambda v: F.round(v, digits))).alias("token", value)


def softmax(spark, d):
    return _logits(spark, d).select("vec_id", _each(lm.softmax_of(F.transform("logits", lambda v: lm.tempered(v, 0.8))), "p"))


def top_k(spark, d):
    return _logits(spark, d).select("vec_id", F.inline(lm.top_k_of(F.col("logits"), 5)))


def top_p(spark, d):
    return _logits(spark, d).select("vec_id", F.inline(lm.top_p_of(lm.softmax_of(F.col("logits")), 0.9))).select("vec_id", "token", F.round("p", 9).alias("p"))


def multinomial_draw(spark, d):
    uniform = (F.pmod(F.col("vec_id") * 7919, F.lit(10007)) + 0.5) / 10007
    return _logits(spark, d).select("vec_id", lm.drawn(lm.softmax_of(F.col("logits")), uniform).alias("token"))


def repetition_penalty(spark, d):
    seen = lambda i: F.pmod(i, F.lit(9)) == F.pmod(F.col("vec_id"), F.lit(9))
    return _logits(spark, d).select("vec_id", F.posexplode(F.transform("logits", lambda v, i: F.round(lm.penalized(v, seen(i), 1.2), 9))).alias("token", "logit"))


def beam_step(spark, d):
    score = lambda lp: F.round((lp - F.col("vec_id") % 4) / F.pow(F.lit(6.0), 0.7), 9)
    ranked = F.array_sort(F.transform(lm.log_softmax_of(F.col("logits")), lambda v, i: F.struct((-score(v)).alias("minus"), F.col("vec_id").alias("vec_id"), i.alias("token"))))
    # Of each vector only the candidates that may win are shuffled.
    best = _logits(spark, d).select(F.floor(F.col("vec_id") / 4).alias("group"), F.explode(F.slice(ranked, 1, 4)).alias("c"))
    w = Window.partitionBy("group").orderBy("c")
    return best.withColumn("beam", F.row_number().over(w)).where("beam <= 4").select("group", "beam", "c.vec_id", "c.token", (-F.col("c.minus")).alias("score"))


def _vectors(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")


def _listed(column):
    return F.posexplode(F.transform(column, lambda v: F.round(v, 8) + 0.0)).alias("i", "v")


def rms_norm(spark, d):
    return _vectors(spark, d).select("vec_id", _listed(lm.rms_norm(F.col("x"), 1e-5)))


def rope(spark, d):
    return _vectors(spark, d).select("vec_id", _listed(lm.rotated(F.col("x"), F.col("vec_id"), 64)))


def swiglu(spark, d):
    return _vectors(spark, d).select("vec_id", _listed(lm.swiglu(F.slice("x", 1, 32), F.slice("x", 33, 32))))


def cross_entropy(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(lm.cross_entropy(F.col("x"), F.col("label")), 8).alias("loss"))


def token_weighted_nll(spark, d):
    rows = _vectors(spark, d).select((F.col("vec_id") % 10).alias("chunk"), lm.cross_entropy(F.col("x"), F.col("label")).alias("loss"))
    chunks = rows.groupBy("chunk").agg(F.sum("loss").alias("nll"), F.count("loss").alias("n"))
    mean = F.sum("nll") / F.sum("n")
    return chunks.agg(F.round(mean, 8).alias("loss"), F.round(lm.perplexity(mean), 6).alias("perplexity"), F.sum("n").alias("tokens"))


PRESETS = [("nano", 4, 4, 256, 1024), ("small", 12, 12, 768, 3072), ("medium", 24, 16, 1024, 4096), ("large", 36, 20, 1280, 5120), ("xl", 48, 25, 1600, 6400)]


def param_counts(spark, d):
    rows = spark.createDataFrame(PRESETS, "preset string, layers long, heads long, d long, ff long")
    return rows.select("preset", lm.parameters(F.lit(32000), F.col("layers"), F.col("d"), F.col("ff"), F.col("heads"), F.col("heads")).alias("parameters"))


def bpe_word_counts(spark, d):
    words = F.filter(F.split(F.col("text"), r"[ \n\t\r]+"), lambda w: w != "")
    return _table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        clean_profile, clean_text, clean_pages, length_filter_reasons, truncate_paragraph, chunk_paragraphs, chunk_overlap, conversation_paragraphs, shard_split, estimated_documents,
        worker_files, shard_inventory, language_counts, cluster_sample, shard_seeds, length_stats, histogram_chars, histogram_bytes, split_summary, cross_split_duplicates, cross_split_ids, cross_split_languages, cross_split_urls, cross_split_hosts, histogram_tokens, multinomial_draw,
        audit_summary, tokenizer_provenance, doc_limit, token_budget, token_rollup, token_ids, encode_specials, document_chunks, pack_blocks, block_counts, buffer_shuffle, batches_drop_last,
        coverage_order, coverage_cursor, eval_chunks, ppl_windows, interval_metrics, interval_throughput, eval_mean, best_so_far, keep_last_n, latest_complete, softmax, top_k, top_p, repetition_penalty, beam_step,
        rms_norm, rope, swiglu, cross_entropy, token_weighted_nll, param_counts, bpe_word_counts,
    )
    return {f.__name__: f for f in plain} | {f"lr_{n}": _rates(f"{n}_with_warmup") for n in ("cosine", "linear", "constant")}
