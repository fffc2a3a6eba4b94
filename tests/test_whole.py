"""Registered queries over whole tables and whole texts, on small tables of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill import queries as Q
from quillmill.functions import text as T
from quillmill.operators import corpus as C

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def put_documents(spark, folder, texts):
    """One document a text, on two shards in turn."""
    put(spark, folder, "documents", [(i, t, "en", f"src{i % 2}", len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def test_texts_beyond_5000_characters_stay_whole(spark, folder):
    same = "word " * 1200
    put_documents(spark, folder, [same + "one", same + "two"])
    assert {r.doc_id: r.clean for r in Q.clean_text(spark, folder).collect()} == {0: same + "one", 1: same + "two"}
    assert sorted(len(r.ids.split()) for r in Q.token_ids(spark, folder).collect()) == [1202, 1202]
    assert Q.cross_split_duplicates(spark, folder).count() == 0
    assert Q.length_stats(spark, folder).first().would_truncate == 0


def test_truncation_at_the_length_of_the_reference(spark, folder):
    assert (Q.OPTIONS.min_length, Q.OPTIONS.max_length) == (100, 100_000)
    put_documents(spark, folder, ["x" * 100_001, "x" * 100_000])
    assert [r.n for r in Q.clean_text(spark, folder).select(F.length("clean").alias("n")).collect()] == [100_000, 100_000]
    assert Q.length_stats(spark, folder).first().would_truncate == 1
    rows = spark.createDataFrame([("abcdefgh\n\nxyz",)], "text string")
    assert T.clean(rows, options=T.CleanOptions(min_length=1, max_length=10)).first().clean == "abcdefgh"


def test_vectors_and_events_of_every_id(spark, folder):
    x = np.random.default_rng(7).standard_normal((3, 64)).astype(np.float32).astype(float)
    ids = [5, 203, 4001]
    put(spark, folder, "embeddings", [(i, v.tolist(), k) for k, (i, v) in enumerate(zip(ids, x, strict=True))], "vec_id long, embedding array<float>, label int")
    logits = np.round(x * 10, 4)
    near = lambda query, of, want: np.testing.assert_allclose(np.array([[r[2] for r in query(spark, folder).where(F.col("vec_id") == i).orderBy(of).collect()] for i in ids]), want, atol=2e-7)
    p = np.exp(logits / 0.8)
    near(Q.softmax, "token", p / p.sum(1, keepdims=True))
    near(Q.top_k, F.desc("logit"), -np.sort(-logits, 1)[:, :5])
    seen = np.arange(64)[None, :] % 9 == np.array(ids)[:, None] % 9
    near(Q.repetition_penalty, "token", np.where(seen, logits / 1.2, logits))
    near(Q.rms_norm, "i", x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-5))
    near(Q.swiglu, "i", x[:, :32] / (1 + np.exp(-x[:, :32])) * x[:, 32:])
    angle = np.array(ids)[:, None] * 10000.0 ** (-2.0 * (np.arange(64) % 32) / 64)
    near(Q.rope, "i", x * np.cos(angle) + np.concatenate([-x[:, 32:], x[:, :32]], 1) * np.sin(angle))
    loss = {i: math.log(np.exp(v).sum()) - v[k] for k, (i, v) in enumerate(zip(ids, x, strict=True))}
    assert {r.vec_id: r.loss for r in Q.cross_entropy(spark, folder).collect()} == pytest.approx(loss, abs=1e-7)
    told = Q.token_weighted_nll(spark, folder).first()
    assert told.tokens == 3 and told.loss == pytest.approx(sum(loss.values()) / 3, abs=1e-7)
    assert {r[0] for r in Q.top_p(spark, folder).select("vec_id").collect()} == set(ids)
    assert {r.group for r in Q.beam_step(spark, folder).collect()} == {1, 50, 1000}
    put(spark, folder, "events", [(9, "a", 1.0), (10, "a", 1.0), (11, "a", None)], "event_id long, event_type string, value double")
    assert [tuple(r) for r in Q.latest_complete(spark, folder).collect()] == [("a", 10)]


def test_no_small_limits(spark, folder, monkeypatch):
    texts = [f"{i} " + "word " * 30 for i in range(310)]
    put_documents(spark, folder, texts)
    assert {len(r.ids.split()) for r in Q.encode_specials(spark, folder).collect()} == {33}
    assert Q.estimated_documents(spark, folder).first().estimate == 310
    assert Q.TRAIN_DOCUMENTS == 2_000_000
    assert sorted(r.accepted for r in Q.tokenizer_provenance(spark, folder).collect()) == [155, 155]
    assert Q._estimate(Q._corpus(spark, folder), 40).first().estimate == 80
    monkeypatch.setattr(Q, "TRAIN_DOCUMENTS", 160)
    assert {r.split: r.accepted for r in Q.tokenizer_provenance(spark, folder).collect()} == {"validation": 155, "train": 5}
    ids = spark.range(1).select(C.with_specials(F.sequence(F.lit(10), F.lit(40)), bos=1, eos=2, most=16).alias("x")).first().x
    assert ids == [1, *range(10, 26), 2]


def test_texts_are_nfkc_by_default(spark, folder):
    put_documents(spark, folder, ["ﬁne Ａ² a b " + "word " * 30, "fine A2 a b " + "word " * 30])
    assert {r.clean for r in Q.clean_text(spark, folder).collect()} == {("fine A2 a b " + "word " * 30).strip()}
    assert [r.n for r in Q.cross_split_duplicates(spark, folder).collect()] == [2]
    put(spark, folder, "pages", [(1, "<p>ﬁ</p>")], "page_id long, html string")
    assert Q.clean_pages(spark, folder).first().clean == "<p>fi</p>"
