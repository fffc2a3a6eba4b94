"""Exactness on texts made to break hashing, cutting and merging, and on special-token strings."""

import base64
import random

import numpy as np
import pytest

from quillmill.llm import bpe, queries, rules

RANKS, MODEL = queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.tokenizer_path("byte_bpe_50k.json")


def encoder():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODER = encoder()


def same_ids(texts):
    ids, offset = bpe.encode(texts, RANKS)
    assert all(ids[offset[i] : offset[i + 1]].tolist() == ENCODER.encode_ordinary(t) for i, t in enumerate(texts))


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_thue_morse_slices_and_lines():
    pairs = [thue_morse(n, *x) for n in (32, 64, 1024, 2048) for x in ("ab", "ba")]
    same_ids(pairs)
    for t in pairs:  # in batches of their own, so that the memo answers
        same_ids([t])
    lines = "\n".join(pairs[4:6])
    assert rules.measure([lines])["n_dup_lines"].tolist() == [0] and rules.measure([lines + "\n" + pairs[4]])["n_dup_lines"].tolist() == [1]


def test_equal_hashes_of_different_slices(monkeypatch):
    true, texts = bpe.slice_hashes, [f"word{i} " + "x" * (i % 90) + f" tail{i % 7}" for i in range(300)]
    monkeypatch.setattr(bpe, "slice_hashes", lambda d, s, e: true(d, s, e) % np.uint64(13))
    bpe.vocabulary.cache_clear()
    for k in range(0, 300, 50):
        same_ids(texts[k : k + 50])
    bpe.vocabulary.cache_clear()


@pytest.mark.parametrize("alphabet", ["abcXYZ0189+/", "中文字，。", "a1'sré-", "'ll12 \n"])
def test_cuts_without_white_space(monkeypatch, alphabet):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(alphabet, k=n)) for n in (5, 400, 3000)]
    monkeypatch.setattr(bpe, "MAX_CHARS", 50)
    assert len(bpe.cut_points(texts[2])) > 10
    same_ids(texts)


def test_long_texts_without_white_space():
    rnd = random.Random(5)
    text = "".join(rnd.choices("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/", k=6_000_000))
    assert max(np.diff([*bpe.cut_points(text), len(text)])) < bpe.MAX_CHARS + 1000
    same_ids([text])
    one_slice = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FA0, 1_000_000).tolist()))
    same_ids([one_slice[:50_000]])
    assert bpe.vocabulary(RANKS).decode(bpe.encode([one_slice], RANKS)[0]).decode() == one_slice


def test_added_tokens_as_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|", "", None, "plain", "a<|endoftext|>"]
    for some in (texts, texts[::-1]):
        ids, offset = bpe.encode(some, MODEL)
        for i, t in enumerate(some):
            assert ids[offset[i] : offset[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
            assert bpe.vocabulary(MODEL).decode(ids[offset[i] : offset[i + 1]]) == (t or "").encode()


def near(words, rnd, n):
    words = list(words)
    for k in rnd.sample(range(len(words)), n):
        words[k] = f"x{rnd.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture
def salted(monkeypatch):
    """Thresholds so low that small tables take the paths of heavy keys and large buckets."""
    from quillmill.llm import neardup, runtime

    monkeypatch.setattr(runtime, "LEAST_HEAVY", 5)
    monkeypatch.setattr(runtime, "SPREAD", 16)
    monkeypatch.setattr(neardup, "LARGE", 8)
    monkeypatch.setattr(neardup, "BLOCK", 4)


def classes_of(spark, rows):
    from quillmill.llm import neardup

    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    return {r.doc_id: r.class_id for r in found}


def test_near_duplicates_with_heavy_keys(spark, salted):
    from tests.llm.test_operators import brute_classes

    rnd = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, near(base, rnd, rnd.randrange(0, 12))) for i in range(120)]  # one large bucket of several classes
    rows += [(200 + i, "the same text of every copy") for i in range(60)] + [(300 + i, "") for i in range(30)]
    rows += [(400 + i, " ".join(f"v{rnd.randrange(10**9)}" for _ in range(50))) for i in range(30)]
    assert classes_of(spark, rows) == brute_classes(rows)


def one_band_pair():
    """Near copies (Jaccard similarity 0.81) that share one band only, and other texts of that band."""
    from quillmill.llm import neardup

    def signature(texts):
        hashes, text, _ = neardup.shingles(texts)
        return neardup.probminhash(hashes, text, np.ones(len(hashes)), len(texts))

    rnd = random.Random(15900)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(132)]
    a, b = " ".join(words[:120]), " ".join(words[12:])
    signed = signature([a, b])
    keys = neardup.band_keys(signed)
    (band,) = np.flatnonzero(keys[0] == keys[1])
    windows = [" ".join(words[i : i + 5]) for i in range(128)]
    owner = dict(zip(neardup.shingles(windows)[0].tolist(), windows, strict=True))
    parts = [owner[h] for h in dict.fromkeys(signed[0].reshape(neardup.BANDS, neardup.ROWS)[band].tolist())]
    tried = [" ".join(f"{p} f{rnd.randrange(10**6)}" for p in rnd.sample(parts, len(parts))) for _ in range(2000)]
    return a, b, [t for t, k in zip(tried, neardup.band_keys(signature(tried)), strict=True) if k[band] == keys[0][band]][:40]


def test_large_buckets_lose_no_pair(spark, salted):
    a, b, others = one_band_pair()
    assert len(others) == 40
    rows = [(1, a), (2, b), *enumerate(others, 10)]
    got = classes_of(spark, rows)
    assert got[1] == got[2] == 1 and 10 <= min(got[d] for d, _ in rows[2:])


def test_pipeline_keeps_one_of_a_pair_of_a_large_bucket(spark, salted):
    import corpus_pipeline

    a, b, others = one_band_pair()
    rows = [(1, a), (2, b), *enumerate(others, 10)]
    left = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    kept = {r.doc_id for r in left}
    assert len(left) == len(kept) and 1 in kept and 2 not in kept


def test_ids_with_several_texts(spark):
    from quillmill.llm import neardup

    rnd = random.Random(7)
    a, b = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    for order in (1, -1):
        rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b, rnd, 2)), (3, near(b, rnd, 2)), (4, "something else"), (5, None), (5, None)][::order]
        assert classes_of(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
        left = neardup.survivors(spark.createDataFrame(rows, "doc_id long, text string").withColumn("own_id_", rnd_column())).collect()
        assert sorted((r.doc_id, r.text or "") for r in left) == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, "something else"), (5, "")])


def rnd_column():
    from pyspark.sql import functions as F

    return F.lit(1)


@pytest.mark.parametrize("times", [5, 60])
def test_recall_with_repeated_shingles(spark, times):
    """Pairs at a plain Jaccard similarity of 0.8 to 0.83 whose unshared shingles are repeated."""
    rnd = random.Random(times)
    rows, pairs = [], 100
    for k in range(pairs):
        shared = [f"s{k}-{i}" for i in range(404)]
        for side in (0, 1):
            own = [f"o{k}-{side}-{i}" for i in range(42 if k % 2 else 36)]
            rows.append((2 * k + side, " ".join(shared + own * times)))
    found = classes_of(spark, rows)
    from tests.llm.test_operators import brute_classes

    want = brute_classes(rows)
    missed = [d for d in want if want[d] != found[d]]
    assert sum(want[d] != d for d in want) >= 0.9 * pairs and len(missed) <= 0.01 * pairs
    assert rnd


def test_vectors_of_several_lengths_and_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillmill.llm import ann

    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(12)
    x = {i: rng.standard_normal(8 if i % 3 else 5) for i in range(1200)}
    frame = spark.createDataFrame([(i, v.tolist(), "p") for i, v in x.items()], "vec_id long, embedding array<double>, part string")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1200, 20):
        near = sorted(((-float((x[i] * x[q]).sum()), i) for i in x if i != q and len(x[i]) == len(x[q])))[:5]
        assert all(len(x[i]) == len(x[q]) and abs(s - float((x[i] * x[q]).sum())) < 1e-12 for i, s in got[q])
        hits += len({i for _, i in near} & {i for i, _ in got[q]})
    assert hits >= 0.9 * 5 * 60


def test_index_survives_its_file():
    from quillmill.llm import ann

    x = np.random.default_rng(3).standard_normal((500, 16)).astype(np.float32).astype(np.float64)
    one = ann.Index(np.arange(500), x)
    two = ann.Index.load(one.dump())
    for q in range(0, 500, 50):
        assert all(np.array_equal(a, b) for a, b in zip(one.search(q, x[q], 20), two.search(q, x[q], 20), strict=True))


def test_toxicity_recall_and_ranking_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    from quillmill.llm import labelled, toxicity

    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").where((labelled.fold(5) == 0) & F.col("toxic").isNotNull()).select("score", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    wins = (score[toxic][:, None] > score[~toxic]).mean() + 0.5 * (score[toxic][:, None] == score[~toxic]).mean()
    assert toxic.sum() > 50 and (score[toxic] >= 0.5).mean() > 0.88 and (score[~toxic] < 0.5).mean() > 0.98 and wins > 0.95


def test_log_odds_keep_their_sign_and_prior():
    from quillmill.llm import toxicity

    w = toxicity.log_odds(np.array([50.0, 1, 20, 0, 0]), np.array([0.0, 400, 180, 0, 30]), 1.0, 2.0)
    assert w[0] > 2 and w[1] < -1 and w[3] == pytest.approx(0) and w[4] < 0


def test_extreme_value_law_is_found_again():
    from quillmill.llm import toxicity

    rng = np.random.default_rng(3)
    n = rng.integers(50, 2000, 20000)
    draws = (np.log(0.01 * n) - np.log(-np.log(rng.random(20000)))) / 1.7
    rate, log_k = toxicity.extreme_value_law(np.maximum(draws, 0), n)
    assert rate == pytest.approx(1.7, rel=0.03) and log_k == pytest.approx(np.log(0.01), abs=0.1)


def test_letters_are_those_of_unicode():
    import unicodedata

    texts = ["ab—“Ç”·ÀÞ×", "中文。😀x", "русский, ЯЗЫК", "ÅŽ ñ", "", "plain"]
    m = rules.measure(texts)
    assert m["n_letters"].tolist() == [sum(unicodedata.category(c)[0] == "L" for c in t) for t in texts]
    assert m["n_upper"].tolist() == [sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in t) for t in texts]


def draws(key, root):
    """The shard of a key, by the hashes of the xxhash library."""
    import math

    import xxhash

    node = root
    while node.children:
        best = None
        for c in node.children:
            h = xxhash.xxh64_intdigest(c.name.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
            best = min(best or (math.inf, None), (-math.log(((h >> 11) + 0.5) / 2**53) / c.weight, c), key=lambda x: x[0])
        node = best[1]
    return node.shard


def weighted(changed=1.0):
    from quillmill.llm.sharding import Node

    n, regions = 0, []
    for r in range(2):
        racks = []
        for k in range(2):
            shards = []
            for s in range(3):
                shards.append(Node(f"{r}/{k}/{s}", shard=n, own_weight=(changed if (r, k, s) == (0, 1, 2) else 1.0 + s)))
                n += 1
            racks.append(Node(f"{r}/{k}", tuple(shards)))
        regions.append(Node(str(r), tuple(racks)))
    return Node("", tuple(regions))


def test_sharding_by_independent_draws_and_changed_weights(spark):
    from quillmill.llm import sharding

    root, other = weighted(3.0), weighted(6.0)
    keys = spark.range(-100, 6000).withColumnRenamed("id", "doc_id")
    rows = sharding.with_shard(sharding.with_shard(keys, "doc_id", root, "shard"), "doc_id", other, "after").collect()
    for r in rows[:800]:
        assert r["shard"] == draws(r.doc_id, root) and r["after"] == draws(r.doc_id, other)
    size = np.bincount([r["shard"] for r in rows], minlength=12) / len(rows)
    assert np.abs(size - np.tile([1, 2, 3], 4) / 24).max() < 0.02
    moved = [(r["shard"], r["after"]) for r in rows if r["shard"] != r["after"]]
    region = lambda x: x // 6
    assert moved and all(region(b) == 0 for a, b in moved if region(a) != region(b))  # only into the region that grew
    assert all(b == 5 for a, b in moved if a // 3 == b // 3) and all(b // 3 == 1 for a, b in moved if region(a) == region(b) == 0)


def test_slots_of_a_row_repeated_often(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillmill.llm import sharding

    monkeypatch.setattr(sharding, "RUN", 7)
    monkeypatch.setattr(sharding, "BROADCAST_BASES", 1)
    rows = sharding.place(spark.range(100).select(F.lit(5).alias("doc_id"), F.lit("x").alias("text"))).collect()
    assert sorted(r.slot for r in rows) == list(range(100)) and len({r.shard for r in rows}) == 1


def test_quality_scores_are_gaussian_densities():
    from quillmill.llm import quality

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((200, 3)) @ rng.standard_normal((3, 3)), rng.standard_normal((100, 3)) * 0.5 + 1])
    y = np.repeat([0, 1], [200, 100])
    model = quality.Discriminant(x, y, pooled=0.2, ridge=0.1)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    both = (200 * own[0] + 100 * own[1]) / 300
    density = []
    for k in (0, 1):
        c = 0.8 * own[k] + 0.2 * both
        c = 0.9 * c + 0.1 * np.trace(c) / 3 * np.eye(3) + 1e-6 * np.eye(3)
        d = z - z[y == k].mean(0)
        density.append(np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(c)) * (y == k).mean())
    assert np.allclose(model.score(x), density[1] / (density[0] + density[1]))


def test_shrinkage_of_a_singular_class():
    from quillmill.llm import quality

    x = np.random.default_rng(6).standard_normal((50, 4))
    x[:25, 1:] = 0.0  # the first class has no spread in three of four directions
    score = quality.Discriminant(x, np.repeat([1, 0], 25)).score(x)
    assert np.isfinite(score).all() and (score[:25] > 0.5).all() and (score[25:] < 0.5).mean() > 0.8


GOOD, BAD = "some words of a quiet text about the sea and the boats in it", "WIN WIN WIN $$$ NOW NOW !!! 777 *** WIN WIN ### BUY BUY"


def test_pipeline_quality_learns_from_all_labels(spark, tmp_path):
    """More training rows than the sample had at most; those it left out are the only ones of label 0."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from quillmill.llm import labelled

    ids = spark.range(1, 32_001).withColumnRenamed("id", "doc_id").where(labelled.fold(3) != 1).orderBy(F.xxhash64("doc_id")).toPandas().doc_id.tolist()
    assert len(ids) > labelled.SAMPLE_ROWS
    rows = [(d, f"{GOOD} {d % 97}" if i < labelled.SAMPLE_ROWS else f"{BAD} {d % 97}", int(i < labelled.SAMPLE_ROWS)) for i, d in enumerate(ids)]
    spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    documents = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, documents, str(tmp_path)).select("doc_id").collect()}
    assert kept == {d for d, _, y in rows if y}


def test_pipeline_quality_is_not_changed_by_labels_without_documents(spark, tmp_path):
    import corpus_pipeline

    documents = spark.createDataFrame([(d, f"{BAD if d % 4 == 0 else GOOD} {d % 7}") for d in range(60)], "doc_id long, text string")
    labels = documents.selectExpr("doc_id", "cast(doc_id % 4 <> 0 as int) quality")
    labels.unionByName(spark.range(10**6, 2 * 10**6).selectExpr("id doc_id", "1 quality")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, documents, str(tmp_path)).collect()}
    assert kept == {d for d in range(60) if d % 4}


def test_quality_scores_to_the_last_bit(spark):
    """The model doesn't depend on the order or the partitions of rows, nor a score on the texts beside it."""
    from quillmill.llm import quality

    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet").where("doc_id % 8 = 0") for t in ("documents", "labels"))
    one, two = (quality.fit(d, labels) for d in (documents.coalesce(1), documents.repartition(7)))
    x = quality.statistics([r.text for r in documents.select("text").collect()])
    whole = one.score(x)
    assert (two.score(x) == whole).all()
    assert (np.concatenate([one.score(x[i : i + 1]) for i in range(len(x))]) == whole).all()


def test_quality_sums_are_those_of_all_rows():
    from quillmill.llm import quality

    x = np.round(np.random.default_rng(7).standard_normal((3000, 4)) * 3 * 2**20) / 2**20
    y = np.random.default_rng(8).integers(0, 2, 3000)
    by_sums = quality.Discriminant.of_sums([quality.sums(x[y == k][:500]) + quality.sums(x[y == k][500:]) for k in (0, 1)])
    assert np.allclose(by_sums.score(x), quality.Discriminant(x, y).score(x), rtol=1e-9)


def test_quality_with_one_label_of_a_class():
    from quillmill.llm import quality

    x = np.random.default_rng(9).standard_normal((30, 3)) * 0.1
    x[0] += 5
    score = quality.Discriminant(x, np.arange(30) > 0).score(x)
    assert score[0] < 0.5 and (score[1:] > 0.5).all()


def greedy(lengths, size, linear, quadratic):
    """Whole pieces in descending length, each to the cheapest sequence with room; as many sequences as the tokens fill."""
    cost = lambda n: linear * n + quadratic * n * n
    rest = sorted([(n % size, d) for d, n in lengths if n % size], key=lambda x: -x[0])
    open_ = [[size, 0.0] for _ in range(sum(n for n, _ in rest) // size)]
    out = {}
    for n, d in rest:
        fits = [(s[1], i) for i, s in enumerate(open_) if s[0] >= n]
        if fits:
            i = min(fits)[1]
            out[d] = i
            open_[i][0] -= n
            open_[i][1] += cost(n)
    return out


def test_packing_is_the_greedy_one():
    from quillmill.llm import packing

    rnd = random.Random(9)
    lengths = [(i, rnd.choice([rnd.randrange(1, 40), rnd.randrange(1, 400)])) for i in range(300)]
    pieces = packing.Packer(100, 1.0, 0.01).pack(lengths, False)
    first = sum(n // 100 for _, n in lengths)
    want = greedy(lengths, 100, 1.0, 0.01)
    whole = {d: s - first for d, start, n, s, _, _ in pieces if start == dict(lengths)[d] // 100 * 100 and n == dict(lengths)[d] % 100 and n}
    assert want and all(whole[d] == i for d, i in want.items())


def test_shards_of_few_lanes(spark, monkeypatch):
    from quillmill.llm import materialise

    monkeypatch.setattr(materialise, "LANES", 3)
    documents = spark.createDataFrame([(i, f"text number {i} " * (i % 30)) for i in range(300)], "doc_id long, text string").repartition(5)
    index, folder = materialise.materialise(documents, RANKS, stride=16, rows_per_shard=20)
    rows = index.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and len({r.shard for r in rows}) > 20
    assert len(list(materialise.read(folder))) == len(rows)
