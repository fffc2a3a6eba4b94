"""The corpus engine against small cases worked out by hand."""

import json
import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmill.functions import lm
from quillmill.functions import text as T
from quillmill.operators import audit as A
from quillmill.operators import corpus as C
from quillmill.operators import coverage as V
from quillmill.plans import config as G
from quillmill.plans import manifest as M
from quillmill.plans import report as R
from quillmill.plans import tokenize as K
from quillmill.sources import corpus as S
from quillmill.streaming import ingest


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a\x00b\x0bc\x7f", "abc"),
        (r"see \cite{a} and \ref{b} or \textbf{x} end", "see [REF] and or end"),
        ("cost $5 or $6 more", "cost [MATH] 6 more"),
        ("go HTTPS://x.y) now", "go [URL]) now"),
        ("mail a+b@c-d.org.", "mail [EMAIL]."),
        ("a\tb\r\nc\rd", "a b\nc\nd"),
        ("a\n \n \nb", "a\n\n\nb"),
        ("  x \ny  ", "x\ny"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_scrub(spark, raw, want):
    assert one(spark, T.scrub(F.col("text")), raw) == want


def test_nfkc_and_casefold(spark):
    assert one(spark, T.nfkc(F.col("text")), "ﬁＡ") == "fiA"
    assert one(spark, T.casefolded(F.col("text")), "Straße") == "strasse"
    assert one(spark, T.nfkc(F.col("text")), None) is None


def test_truncate(spark):
    cut = lambda t: one(spark, T.truncate(F.col("text"), 10), t)
    assert cut("abcdefgh\n\nxyz") == "abcdefgh"
    assert cut("abcd\n\nefghijk") == "abcd\n\nefgh"
    assert cut("short") == "short"
    assert cut(None) is None


def test_chunks(spark):
    text = "aaaa\n\nbbbb\n\ncccc\n\ndd"
    assert one(spark, T.chunks(F.col("text"), 8), text) == ["aaaa\n\nbbbb", "cccc\n\ndd"]
    assert one(spark, T.chunks(F.col("text"), 8, 5), text) == ["aaaa\n\nbbbb", "bbbb\n\ncccc", "cccc\n\ndd"]
    assert one(spark, T.chunks(F.col("text"), 100, 5, 99), text) == [text]


def test_clean_lengths(spark):
    rows = spark.createDataFrame([(1, "x" * 12), (2, "short"), (3, None), (4, "y  " + " " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.clean for r in T.clean(rows, options=T.CleanOptions(min_length=10, max_length=11)).collect()}
    assert got == {1: "x" * 11, 2: None, 3: None, 4: None}


def test_split_names():
    with pytest.raises(ValueError):
        C.split_names(["a"])
    with pytest.raises(ValueError):
        C.split_names(["a", "b"], 1.0)
    assert [len(v) for v in C.split_names([f"src{i}" for i in range(20)]).values()] == [1, 19]
    assert C.split_names([f"src{i}" for i in range(20)])["validation"] == ["src9"]


def test_blocks_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    docs = [(s, i, rng.integers(0, 99, rng.integers(0, 40)).tolist()) for s in range(4) for i in range(15)]
    stream = [x for _, _, ids in docs for x in ids]
    frame = spark.createDataFrame(docs, "shard_pos int, doc_id long, ids array<int>")
    for size in (1, 7, 16):
        got = {r.block_id: r.ids for r in C.blocks(frame, size).collect()}
        assert got == {b: stream[b * size : b * size + size + 1] for b in range((len(stream) - 1) // size)}


def test_budget_and_percentiles(spark):
    rows = spark.createDataFrame([("train", s, i, 2) for s in range(3) for i in range(4)], "split string, shard_pos int, doc_id long, n_tokens long")
    assert C.within_budget(rows, 9).count() == 5
    values = spark.createDataFrame([("a", x) for x in (1, 2, 3, 10)] + [("b", 5)], "k string, x long")
    got = {r.k: (r.p, r.q) for r in A.percentiles(values, ["k"], "x", {"p": 0.5, "q": 0.95}).collect()}
    assert got == {"a": (3, 10), "b": (5, 5)}


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (99, 100, 499, 500, 999, 1000, 100000)], "x long")
    assert {r.low: r.n for r in A.histogram(rows, "x").collect()} == {0: 1, 100: 2, 500: 2, 1000: 1, 5000: 0, 10000: 0, 50000: 0, 100000: 1}


def test_coverage(spark):
    blocks = spark.range(10).withColumnRenamed("id", "block_id")
    orders = V.epoch_orders(blocks, 2, 42)
    got = {(r.epoch, r.offset): r.block_id for r in orders.collect()}
    for e in (0, 1):
        assert sorted(got[e, o] for o in range(10)) == list(range(10))
    cursor = V.Cursor(10, 42, "x")
    cursor.issue(12)
    with pytest.raises(RuntimeError):
        cursor.state()
    with pytest.raises(RuntimeError):
        cursor.commit(11)
    cursor.commit(12)
    assert cursor.progress()["epoch"] == 1 and cursor.progress()["offset"] == 2
    other = V.Cursor(10, 42, "x")
    other.load(cursor.state())
    assert other.committed == 12
    with pytest.raises(ValueError):
        V.Cursor(10, 42, "y").load(cursor.state())


def test_schedules(spark):
    rate = lambda name, s: spark.range(1).select(lm.schedule(name, F.lit(s), 1.0, 0.1, 10, 100).alias("x")).first()[0]
    assert rate("cosine_with_warmup", 5) == 0.5 and rate("cosine_with_warmup", 101) == 0.1 and math.isclose(rate("cosine_with_warmup", 55), 0.55)
    assert rate("linear_with_warmup", 100) == 0.1 and rate("constant_with_warmup", 99) == 1.0
    with pytest.raises(ValueError):
        lm.schedule("cosine", F.lit(1), 1, 0, 1, 1)


def test_top_k_keeps_ties(spark):
    rows = spark.createDataFrame([(0, t, x) for t, x in enumerate((3.0, 2.0, 2.0, 1.0))], "v int, token int, logit double")
    assert rows.withColumn("k", lm.in_top_k(F.col("logit"), "v", 2)).where("k").count() == 3


def test_config(tmp_path):
    c = G.Config({"a": {"b": 1}, "model": {"preset": "nano", "d_ff": None}})
    assert c.a.b == 1 and c["a"]["b"] == 1 and "a" in c and c.get("z", 5) == 5
    assert G.merged(c, G.Config({"a": {"d": 2}})).a.to_dict() == {"b": 1, "d": 2}
    assert G.overridden(c, ["a.b=true", "a.e=1.5", "x.y=null", "a.s=hi"]).to_dict()["a"] == {"b": True, "e": 1.5, "s": "hi"}
    assert G.resolved(c).model.d_ff == 1024
    with pytest.raises(ValueError):
        G.overridden(c, ["a.b"])


def shards(folder, n=4):
    for i in range(n):
        texts = [f"Shard {i}: a line that is long enough" + str(k) * 5 for k in range(5)] + ["", None, "tiny"]
        pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), f"{folder}/{i:03d}.parquet", row_group_size=2)


def test_tokenize_publishes_whole(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    shards(root)
    tokenizer = K.Tokenizer(tokenizers.path("piece_bpe_32k.model"), 2)
    options = T.CleanOptions(min_length=10, max_length=100)
    told = K.tokenize_corpus(spark, str(root), str(out), tokenizer, options, val_split=0.25)
    assert told["train"]["seen"] == 18 and told["train"]["kept"] == 15 and told["validation"]["kept"] == 5
    ids = np.fromfile(out / "train.bin", dtype="<u2")
    assert len(ids) == told["train"]["tokens"] and (ids == 2).sum() == 15
    splits = C.split_names(S.discover(str(root)), 0.25)
    encode = tokenizer.loaded()[0]
    first = pq.read_table(splits["train"][0]).column("text")[0].as_py()
    assert ids[: len(encode(first)) + 1].tolist() == [*encode(first), 2]
    settings = {"val_split": 0.25, "seed": 42, "min_length": 10, "max_length": 100, "text_column": "text"}
    check = lambda **x: M.valid(str(out), tokenizer.facts(), settings | x, splits, str(root), 8)
    assert check() and not check(min_length=11)
    blocks = K.Blocks(str(out / "train.bin"), 8)
    x, y = blocks[1]
    assert len(blocks) == (len(ids) - 1) // 8 and x[1:].tolist() == y[:-1].tolist()
    limited = K.tokenize_corpus(spark, str(root), str(tmp_path / "few"), tokenizer, options, val_split=0.25, max_docs_per_file=2)
    assert limited["train"]["seen"] == 6 and not os.path.exists(tmp_path / "few" / M.NAME)
    with pytest.raises(ValueError):
        K.tokenize_corpus(spark, str(root), str(out), tokenizer, options, max_docs_per_file=1, max_tokens=1)
    with open(out / "train.bin", "ab") as f:
        f.write(b"\0\0")
    assert not check()


def test_sources_and_stream(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.discover(str(tmp_path))
    root = tmp_path / "in"
    root.mkdir()
    shards(root, 2)
    assert [r["rows"] for r in S.footers(spark, S.discover(str(root))).collect()] == [8, 8]
    (tmp_path / "t.txt").write_text(" one \n\n\n\ntwo\n\n three")
    assert [r.text for r in S.paragraphs(spark, str(tmp_path / "t.txt")).orderBy("position").collect()] == ["one", "two", "three"]
    stream = ingest.cleaned_stream(spark, str(root), "text string", T.CleanOptions(min_length=10))
    ingest.publish(stream, str(tmp_path / "pub"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "pub")).count() == 10


def test_report(tmp_path):
    R.write_csv(str(tmp_path / "x.csv"), [{"a": 1, "b": 2}], ["a"])
    assert (tmp_path / "x.csv").read_text().split() == ["a", "1"]
    assert "&lt;b&gt;" in R.table([{"a": "<b>"}], ["a"]) and "<svg" in R.bars("t", [("x", 1)])


def test_entry_lists(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert json.dumps(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
