"""Whole runs on small folders: audit, profile, choice of the loader, evaluation, checkpoints, command line."""

import csv
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmill.__main__ import main
from quillmill.functions import lm
from quillmill.functions import text as T
from quillmill.operators import corpus as C
from quillmill.operators import coverage as V
from quillmill.plans import audit as A
from quillmill.plans import checkpoints, evaluate, loader
from quillmill.plans import tokenize as K
from quillmill.sources import corpus as S


def model():
    return K.Tokenizer(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"), 2)


@pytest.fixture
def audited(tmp_path):
    """Two shards of two documents; one sentence is in both."""
    root = tmp_path / "in"
    root.mkdir()
    for i, (ids, counts, own) in enumerate((("ab", (3, 5), "Only the first shard has it."), ("cd", (7, 11), "The second one has this line."))):
        columns = {
            "text": ["A sentence that both of the shards hold.", own], "id": list(ids), "url": [f"https://example.com/{x}" for x in ids], "language": ["en", "en"],
            "language_score": [0.9, 0.9], "token_count": list(counts), "score": [3.0, 3.0], "int_score": [3, 3],
        }
        pq.write_table(pa.table(columns), root / f"00{i}_00000.parquet", row_group_size=2)
    return root


def test_audit_run(spark, audited, tmp_path):
    out = tmp_path / "report"
    s = A.Settings(val_split=0.5, options=T.CleanOptions(min_length=10, max_length=100), byte_limit=16, train_documents=2, sample_per_shard=2, groups_per_shard=1)
    summary = A.audit(spark, str(audited), str(out), s)
    assert (summary["total_rows_exact"], summary["sample_count"], summary["tokenizer_candidates_scanned"]) == (4, 4, 2)
    assert [summary[f"cross_split_{k}_groups"] for k in ("text", "id", "url")] == [1, 0, 0]
    assert summary["length_sample"]["above_sentence_byte_limit"] == 4 and not summary["tokenizer"]["exists"]
    read = lambda name: list(csv.DictReader((out / f"{name}.csv").open()))
    splits = read("split_summary")
    assert [int(x["rows_exact"]) for x in splits] == [2, 2] and sum(int(x["token_count_sum_exact"]) for x in splits) == 26
    inventory = read("shard_inventory")
    assert len(inventory[0]) == 14 and [x["sampled_language_counts"] for x in inventory] == ['{"en": 2}'] * 2
    assert len(read("document_sample")) == 4 and len(read("document_sample")[0]) == 18 and [x["kind"] for x in read("cross_split_duplicates")] == ["text"]
    assert sorted(int(x["accepted"]) for x in read("tokenizer_provenance")) == [0, 2]
    assert json.loads((out / "summary.json").read_text()) == json.loads(json.dumps(summary)) and "Tokenizer-training provenance" in (out / "report.html").read_text()
    with pytest.raises(ValueError):
        A.audit(spark, str(audited), str(out), A.Settings(text_column="body", val_split=0.5))


def test_sample_takes_groups_then_rows(spark):
    groups = spark.createDataFrame([("s", g, 100 * g, 100) for g in range(9)] + [("t", 0, 0, 3)], "shard string, row_group int, first long, n long")
    rows = A.sampled_rows(groups, 10, 3, 1).collect()
    own = [r for r in rows if r["shard"] == "s"]
    assert len(own) == 10 and len({r["row_group"] for r in own}) == 3 and len({r["row_index"] for r in own}) == 10
    assert sum(r["shard"] == "t" for r in rows) == 3


def test_provenance_cuts_inside_a_shard(spark):
    from quillmill.operators import audit

    rows = spark.createDataFrame([(s, i, "word " * 10 + s) for s in "abc" for i in range(6)], "shard string, doc_id long, text string")
    shards = spark.createDataFrame([("a", "validation", 0), ("b", "train", 0), ("c", "train", 1)], "shard string, split string, shard_pos int")
    for limit in (0, 4, 6, 8, 12, 99):
        got = {r["shard"]: (r["accepted"], r["over_limit"]) for r in audit.provenance(rows, shards, T.CleanOptions(min_length=10), limit, 20).collect()}
        assert got == {s: ((n := max(0, min(6, limit - 6 * i))), n) for i, s in enumerate("abc")}


@pytest.fixture
def shards(tmp_path):
    root = tmp_path / "shards"
    root.mkdir()
    for i in range(4):
        texts = [f"Shard {i}: line number {k} is long enough to be kept" for k in range(5)] + ["tiny", "short one", "", None]
        pq.write_table(pa.table({"text": pa.array(texts, pa.string())}), root / f"{i:03d}.parquet", row_group_size=2)
    return str(root)


OPTIONS = T.CleanOptions(min_length=20, max_length=100)


def test_profile_and_choice_of_loader(spark, shards, tmp_path):
    out, profile = str(tmp_path / "out"), []
    told = K.tokenize_corpus(spark, shards, out, model(), OPTIONS, val_split=0.25, profile=profile, buffer=3)
    assert told["train"] == {"seen": 21, "kept": 15, "filtered": 6, "tokens": told["train"]["tokens"]} and told["validation"]["seen"] == 7
    assert [r["name"] for r in profile][-1] == "all" and profile[-1]["documents_seen"] == 28 and profile[-1]["output_bytes"] == 2 * sum(t["tokens"] for t in told.values())
    assert sorted((r["documents_seen"], r["documents_kept"]) for r in profile if r["name"].endswith(".parquet")) == [(7, 5)] * 4
    assert sum(r["tokens_written"] for r in profile if r["name"].endswith(".parquet")) == profile[-1]["tokens_written"]
    load = lambda options=OPTIONS, **x: loader.load(spark, shards, out, model(), 8, options, val_split=0.25, **x)
    binary = load()
    assert binary.kind == "binary" and len(binary.train) == (told["train"]["tokens"] - 1) // 8
    with pytest.raises(ValueError):
        load(workers=2)
    assert load(T.CleanOptions(min_length=21, max_length=100)).kind == "stream"
    os.remove(f"{out}/manifest.json")
    stream = load()
    rows = stream.train.orderBy("block_id").collect()
    assert stream.kind == "stream" and len(rows) == len(binary.train)
    for r, (x, y) in zip(rows, (binary.train[i] for i in range(len(rows))), strict=True):
        assert r["input_ids"] == x.tolist() and r["labels"] == y.tolist()


def test_encode_errors_and_decoding(spark):
    tokenizer = model()
    rows = spark.createDataFrame([(1, "good text"), (2, None), (3, "more of it")], "doc_id long, clean string")
    ids = K.encoded(rows, tokenizer, "clean", ["doc_id"])
    assert {r["doc_id"]: r["text"] for r in K.decoded(ids, tokenizer, ["doc_id"]).collect()} == {1: "good text", 2: None, 3: "more of it"}
    assert len(tokenizer) == tokenizer.loaded()[2] and tokenizer.special_ids()["eos"] == 2

    def fail(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("bad")
        return [[len(t)] for t in texts]

    assert K.encoded_texts(fail, ["ok", "a bad one", None], 9, True) == [[2, 9], None, None]
    with pytest.raises(RuntimeError):
        K.encoded_texts(fail, ["ok", "a bad one"], 9, False)


def test_evaluation(spark):
    ones = lambda windows: [[1.0] * (len(w) - 1) for w in windows]
    paragraphs = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "paragraph long, ids array<int>")
    assert evaluate.evaluate(paragraphs([1, 2, 3]), ones, 4) == {"loss": 1.0, "perplexity": pytest.approx(np.e), "targets": 2}
    assert evaluate.evaluate(paragraphs(list(range(7))), ones, 4)["targets"] == 6
    assert evaluate.evaluate(paragraphs(list(range(12)), [1], []), ones, 4)["targets"] == 11
    by_length = lambda windows: [[float(len(w))] * (len(w) - 1) for w in windows]
    assert evaluate.evaluate(paragraphs(list(range(7))), by_length, 4)["loss"] == pytest.approx((4 * 5 + 2 * 3) / 6)
    assert evaluate.perplexity(paragraphs(list(range(7))), by_length, 4) == pytest.approx(np.exp((5 + 5 + 3) / 3))
    assert evaluate.perplexity(paragraphs([1, 2]), lambda w: [[99.0]] * len(w), 4) == pytest.approx(np.exp(20))
    for empty in (paragraphs(), paragraphs([]), paragraphs([5])):
        for told in (evaluate.evaluate, evaluate.perplexity):
            with pytest.raises(ValueError):
                told(empty, ones, 4)


def test_checkpoints(tmp_path):
    folder = str(tmp_path / "c")
    assert checkpoints.latest(folder) is None

    def write(value):
        def files(path):
            for name in checkpoints.REQUIRED:
                with open(f"{path}/{name}", "w") as f:
                    f.write(value)

        return files

    checkpoints.save(folder, 100, write("a"))
    os.makedirs(f"{folder}/step-101")
    (tmp_path / "c" / "step-101" / "model.bin").write_text("x")
    assert checkpoints.latest(folder) == f"{folder}/step-100"

    def stopped(path):
        write("b")(path)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        checkpoints.save(folder, 102, stopped)
    with pytest.raises(ValueError):
        checkpoints.save(folder, 103, lambda path: None)
    assert sorted(os.listdir(folder)) == ["step-100", "step-101"]
    checkpoints.save(folder, 100, write("c"))
    assert open(f"{folder}/step-100/model.bin").read() == "c"
    for step in (9, 200, 1000):
        checkpoints.save(folder, step, write("d"), keep=2)
    assert [s for s, _ in checkpoints.complete(folder)] == [200, 1000]
    log = checkpoints.MetricsLog(str(tmp_path / "m.jsonl"))
    assert log.log(3, {"train/lr": 3e-4, "loss": 1.5, "n": 2}) == "step 3 | train/lr 3.000e-04 | loss 1.5000 | n 2"
    assert len((tmp_path / "m.jsonl").read_text().splitlines()) == 3


def test_command_line(spark, audited, shards, tmp_path):
    assert "softmax" in main(["queries"])["queries"]
    told = main(["audit", str(audited), str(tmp_path / "a"), "--set", "data.val_split=0.5", "--set", "data.min_text_length=10"], spark)
    assert told["sample_count"] == 4
    (tmp_path / "c.yaml").write_text(f"data: {{val_split: 0.25, min_text_length: 20}}\ntokenizer: {{model_path: {model().path}}}\n")
    told = main(["tokenize", shards, str(tmp_path / "t"), "--config", str(tmp_path / "c.yaml")], spark)
    assert told["train"]["kept"] == 15 and (tmp_path / "t" / "profile.csv").exists() and (tmp_path / "t" / "manifest.json").exists()
    assert main(["sampler", "--blocks", "500", "--batches", "3", "--size", "16"], spark)["blocks"] == 48
    assert main(["query", "param_counts", "/nowhere", "--out", str(tmp_path / "q")], spark)["columns"] == ["preset", "parameters"]


def test_cursor_state_is_checked():
    cursor = V.Cursor(10, 42, "x", context=4)
    cursor.issue(14)
    cursor.commit(14)
    state = cursor.state()
    V.Cursor(10, 42, "x", context=4).load(state)
    for changed in ({"context": 5}, {"order": "other"}, {"epoch": 2}, {"offset": 3}, {"position": -1}, {"position": 15}):
        with pytest.raises(ValueError):
            V.Cursor(10, 42, "x", context=4).load(state | changed)


def test_passes_are_shuffled_anew():
    files = [f"f{i}" for i in range(30)]
    first, second = (lambda p: (next(p), next(p)))(S.passes(files, 1))
    again = S.passes(files, 1)
    assert sorted(first) == sorted(second) == sorted(files) and first != second and (first, second) == (next(again), next(again))
    assert next(S.passes(files, 1, shuffled=False)) == sorted(files)


def test_running_sums_of_any_order(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGES", 5)
    rng = np.random.default_rng(2)
    rows = [(k, int(i), int(v)) for k in "ab" for i, v in zip(rng.permutation(200) * 7 - 300, rng.integers(0, 9, 200), strict=True)]
    frame = spark.createDataFrame(rows, "k string, _range long, v long")
    got = {(r["k"], r["_range"]): r["s"] for r in C.running(frame, ["k"], "_range", "v", "s").collect()}
    least = {(r["k"], r["_range"]): r["s"] for r in C.running(frame, ["k"], "_range", "v", "s", least=True).collect()}
    for k, i, _ in rows:
        before = [v for g, j, v in rows if g == k and j < i]
        assert got[k, i] == sum(before) and least[k, i] == min(before, default=None)
    ties = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", None, 2), ("a", 1, 7)], "k string, i long, v long")
    assert sorted(r["n"] for r in C.running(ties, ["k"], "i", None, "n").collect()) == [0, 1, 2, 3]
    assert C.running(ties.limit(0), ["k"], "i", "v", "n").count() == 0


def test_array_forms_equal_loops(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 30)).round(1)
    frame = spark.createDataFrame([(i, v.tolist(), float(u)) for i, (v, u) in enumerate(zip(x, rng.random(20), strict=True))], "i int, x array<double>, u double")
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    out = frame.select("i", "u", lm.softmax_of(F.col("x")).alias("p"), lm.log_softmax_of(F.col("x")).alias("l"), lm.top_k_of(F.col("x"), 4).alias("k"), lm.top_p_of(lm.softmax_of(F.col("x")), 0.6).alias("t"), lm.drawn(lm.softmax_of(F.col("x")), F.col("u")).alias("d")).collect()
    for r in out:
        own = p[r["i"]]
        assert np.allclose(r["p"], own) and np.allclose(r["l"], np.log(own))
        assert {t["token"] for t in r["k"]} == set(np.flatnonzero(x[r["i"]] >= np.sort(x[r["i"]])[-4]).tolist())
        order = np.lexsort((np.arange(30), -own))
        before = np.cumsum(own[order]) - own[order]
        assert {t["token"] for t in r["t"]} == set(order[before <= 0.6].tolist())
        assert r["d"] == min(29, int((np.cumsum(own) <= r["u"]).sum()))
