"""The llm operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import base64
import hashlib
import html
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import ann, bpe, html_text, labelled, materialise, neardup, packing, quality, queries, rules, sharding, toxicity

SF = "/root/testdata/sf0.001"
RANKS, MODEL = queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.tokenizer_path("byte_bpe_50k.json")
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven", "a"), (2, None, "b"), (3, "", "c"), (4, " \t\n ", None), (None, "no id here at all", "d"), (None, None, None), (5, "word " * 30000, "e"),
    (6, "tie", "f"), (6, "tie", "f"), (7, "don't we'll 've 'S    x 12² \U0001f600<|endoftext|>\x00", "g"), (8, "x" * 3000, "h"), (9, "one two three four five six seven eight nine ten eleven", "i"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(*r, 1.0, 2, "slot") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label int, slot string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


def encoder():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODER = encoder()
LIBRARY = tokenizers.Tokenizer.from_file(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'strevlmd a1\n\t!é中  "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_bpe_equals_library(texts):
    ids, offset = bpe.encode(texts, RANKS)
    for i, t in enumerate(texts):
        own = ids[offset[i] : offset[i + 1]]
        assert own.tolist() == ENCODER.encode_ordinary(t)
        assert bpe.vocabulary(RANKS).decode(own) == t.encode()


def test_bpe_long_slices_and_cuts(monkeypatch):
    texts = ["ab" * 2000, " " * 500 + "x", "'" * 99, "word and  word\n\n " * 500]
    monkeypatch.setattr(bpe, "MAX_CHARS", 100)
    ids, offset = bpe.encode(texts, RANKS)
    for i, t in enumerate(texts):
        assert ids[offset[i] : offset[i + 1]].tolist() == ENCODER.encode_ordinary(t)


def test_bpe_query_and_frames(spark, awkward, empty):
    from tokenizers import Tokenizer

    assert bpe.Vocabulary(MODEL).ranks == bpe.vocabulary(RANKS).ranks
    texts = [t or "" for _, t, _ in AWKWARD]
    t = Tokenizer.from_file(MODEL)
    ids, offset = bpe.encode(texts, MODEL)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[offset[i] : offset[i + 1]].tolist() == e.ids
    rows = awkward.mapInArrow(queries.shipped("quillmill.llm.bpe:digest_batches", path=RANKS), bpe.DIGEST).collect()
    want = Counter((d, len(e := ENCODER.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True) for d, t, _ in AWKWARD)
    assert Counter(map(tuple, rows)) == want
    back = bpe.decode_frame(bpe.encode_frame(awkward, RANKS), RANKS)
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, _ in AWKWARD)
    assert bpe.encode_frame(empty, RANKS).count() == 0


def check_packing(rows, texts, size):
    by, total = defaultdict(list), 0
    for r in rows:
        by[r.sequence_id].append(r)
        total += r.length
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0 and at < size
    assert total == sum(len(e.ids) + 1 for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False))


def test_packing(spark, awkward, empty):
    rows = packing.pack(awkward, MODEL, with_ids=True).collect()
    check_packing(rows, [t for _, t, _ in AWKWARD], 1024)
    doc = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start)
    want = np.array([*ENCODER.encode_ordinary("word " * 30000), 0], dtype="<u4")
    assert b"".join(r.ids for r in doc) == want.tobytes() and doc[0].doc_tokens == len(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(empty, MODEL).count() == 0
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(packing.pack(documents, MODEL, size=256, window=5000).collect(), [r.text for r in documents.select("text").collect()], 256)


def test_packing_balances_cost():
    lengths = [(i, n) for i, n in enumerate(random.Random(3).choices(range(10, 1024), k=800))]
    cost = defaultdict(float)
    for _, _, n, sequence, _, c in packing.Packer(1024, 1.0, 1 / 1024).pack(lengths, False):
        cost[sequence] += c
    assert np.std(list(cost.values())) < 0.25 * np.mean(list(cost.values()))


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(count):
    got = materialise.slots(np.arange(count), count, 7)
    assert sorted(got.tolist()) == list(range(count))
    if count > 100:
        assert got.tolist() != materialise.slots(np.arange(count), count, 8).tolist()
        assert abs(np.corrcoef(got, np.arange(count))[0, 1]) < 0.2


def test_materialise(spark, awkward, empty):
    index, folder = materialise.materialise(awkward, RANKS, stride=64, rows_per_shard=100)
    rows = index.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and len({r.shard for r in rows}) > 1
    read = list(materialise.read(folder))
    assert all(zlib.crc32(x[: r.n_tokens].tobytes()) == r.ids_crc32 for x, r in zip(read, rows, strict=True))
    assert [x.tolist() for x in materialise.read(folder, 150)] == [x.tolist() for x in read[150:]]
    ids = Counter(x for r, s in zip(rows, read, strict=True) for x in s[: r.n_tokens].tolist())
    want = Counter(x for _, t, _ in AWKWARD for x in [*ENCODER.encode_ordinary(t or ""), 50256])
    assert ids == want and {d for r in rows for d in r.doc_ids} == {d for d, _, _ in AWKWARD}
    index, folder = materialise.materialise(empty, RANKS)
    assert index.count() == 0 and list(materialise.read(folder)) == []


def test_sharding(spark, awkward, empty):
    rows = sharding.place(awkward).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, _ in AWKWARD)
    many = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.place(many).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert min(sizes) > 700 and max(sizes) < 960
    assert 600 < sum(r.grown_shard == 24 for r in rows) < 1000
    assert sharding.place(empty).count() == 0


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(wins)
    covered = {k for i, x in enumerate(wins) if count[x] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\t#é \x0b", max_size=60), max_size=5))
def test_rules_equal_brute_force(texts):
    m = rules.measure(texts)
    assert [tuple(int(m[k][i]) for k in rules.MEASURES) for i in range(len(texts))] == [brute_rules(t) for t in texts]


def test_rule_ledger(spark, awkward, empty):
    entries = rules.ledger(awkward)
    judged = rules.apply_policy(entries).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged) == Counter((d, *brute_rules(t)) for d, t, _ in AWKWARD)
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    told = {r.rule: (r.rejected, r.rejected_alone) for r in rules.ablation(entries).collect()}
    assert told["too_few_words"][0] == sum(brute_rules(t)[0] < 10 for _, t, _ in AWKWARD)
    kept = rules.keep(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in judged)
    assert rules.ledger(empty).count() == 0 and rules.ablation(rules.ledger(empty)).count() == 6


def accuracy(spark, scored, label, modulus, held):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.join(labels, "doc_id").where(labelled.fold(modulus) == held).select("score", label).collect()
    assert len(rows) > 300
    return sum((r[0] >= 0.5) == (r[1] == 1) for r in rows) / len(rows)


def test_classifiers_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert accuracy(spark, quality.score(documents, quality.fit(documents, labels)), "quality", 3, 1) > 0.98
    assert accuracy(spark, toxicity.score(documents, toxicity.fit(documents, labels)), "toxic", 5, 0) > 0.96


def test_classifiers_on_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (8, 0, 1), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for given_labels in (labels, none):
            model = module.fit(awkward, given_labels, label)
            rows = module.score(awkward, model).collect()
            assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
            assert module.score(empty, model).count() == 0
        assert module.score(empty, module.fit(empty, labels, label)).count() == 0
    kept = quality.keep(awkward, quality.fit(awkward, labels))
    assert kept.columns == awkward.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 6), max_size=25))
def test_segments_are_maximal(scores):
    """The classic definition: take the best segment, then the best of what is left on either side."""
    drift = 0.37  # no ties between segments
    value = [s if s > 0 else -drift for s in scores]

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += value[j]
                if total > 0 and (found is None or total > found[0] + 1e-9):
                    found = (total, i, j)
        return [] if found is None else [*best(lo, found[1]), found, *best(found[2] + 1, hi)]

    at = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.segments(at, [float(scores[i]) for i in at], drift)
    assert sum(x[0] for x in got) == pytest.approx(sum(x[0] for x in best(0, len(value))))
    assert max((x[0] for x in got), default=0) == pytest.approx(max((x[0] for x in best(0, len(value))), default=0))


def brute_classes(docs):
    parent = {d: d for d, _ in docs if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, first = {}, {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t is not None):
        if t in first:
            parent[max(find(d), find(first[t]))] = min(find(d), find(first[t]))
            continue
        first[t] = d
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for o, s in sets.items():
            if o != d and s and sets[d] and len(s & sets[d]) >= 0.8 * len(s | sets[d]):
                a, b = find(o), find(d)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def test_near_duplicates(spark, awkward, empty):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    for k in range(60):
        words = list(base)
        for _ in range(rnd.randrange(0, 9)):
            words[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        docs.append((1000 + k, " ".join(words)))
    docs += [(2000, "a b"), (2001, "a b"), (2002, "a c")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)
    rows = neardup.classes(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.doc_id: r.class_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 1}
    left = neardup.survivors(awkward)
    assert left.columns == awkward.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert neardup.classes(empty).count() == 0 and neardup.survivors(empty).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    keys, wa, wb = rng.integers(1, 2**63, 60).astype(np.uint64), rng.random(60) + 0.1, rng.random(60) + 0.1
    wa[:15], wb[45:] = 0, 0
    pick = [np.flatnonzero(w > 0) for w in (wa, wb)]
    sig = [neardup.probminhash(keys[p], np.zeros(len(p), dtype=np.int64), w[p], 1, 4096)[0] for p, w in zip(pick, (wa, wb), strict=True)]
    both = np.flatnonzero((wa > 0) & (wb > 0))
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_blocks_of_a_large_bucket(monkeypatch):
    import pyarrow as pa

    n, reg = 40, neardup.REGISTERS
    rng = np.random.default_rng(0)
    sketch = rng.integers(0, 255, (4, reg)).astype(np.uint8)[rng.integers(0, 4, n)]
    block = rng.integers(0, 3, n)
    rows = [(1, min(b, o), max(b, o), b, k, k % 2, sketch[k].tobytes()) for k, b in enumerate(block.tolist()) for o in range(3)]
    names = ["band", "i", "j", "block", "doc", "class_id", "sketch"]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: (r[1], r[2], r[4]))])
    got = {(a, b) for x in neardup.block_batches(table.to_batches(max_chunksize=7), 0.66) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)}
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if a % 2 != b % 2 and (sketch[a] == sketch[b]).mean() >= 0.66}


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24))
    x[:200] = x[0] + 0.05 * rng.standard_normal((200, 24))
    x[200:210] = x[200]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (5000, None, "x"), (5020, [0.0] * 24, "x"), (5040, [float("nan")] + [1.0] * 23, "x"), (None, [1.0] * 24, "x"), (40, x[40].tolist(), "x")], "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(3000), -score)).tolist() if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert found == sorted(found, key=lambda y: (-y[1], y[0])) and all(abs(s - score[i]) < 1e-9 for i, s in found)
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search(frame.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, you must know.</div><div class="ad-box">Buy now, a long advert text with many words.</div>
<%s><h1>Title &amp; more</h1><p>First <b>bold</b>   para&nbsp;graph with words, &lt;tag&gt; and more words to read here.<p>Second<br>line &am here, also of some length to be read.
<ul><li>Item one of the list<li>Item two</ul><form>Sign up <input name=x></form><blockquote>A quote of several words.</blockquote></%s>
<aside>Related things to read</aside><section class="comments"><p>Reader says a long thing about the article, with many words indeed.</p></section><footer>&copy; X</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_main_text(tag):
    want = ["Title & more", "First bold para graph with words, <tag> and more words to read here.", "Second line &am here, also of some length to be read.", "Item one of the list", "Item two", "A quote of several words."]
    assert html_text.extract(PAGE % (tag, tag)) == "\n\n".join(want)


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r, raw in zip(html_text.extract_pages(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)</article>", raw.html, re.S)[1].replace("<b>", "")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>unclosed <b>text"), (2, "u", "<" * 5000), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "plain & text"), (5, "u", "<a href='x>y")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in html_text.extract_pages(odd).collect())
    assert got[1, ""] == 2 and got[None, "unclosed text"] == 1 and got[3, "deep"] == 1 and got[4, "plain & text"] == 1
    assert html_text.extract_pages(odd.limit(0)).count() == 0


def test_pipeline(spark, awkward, tmp_path):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id"} <= set(rows[0].asDict())
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    clean = {r.doc_id for r in documents if not (m := brute_rules(r.text))[0] < 10 and 100 * m[4] <= 20 * m[0]}
    assert {r.doc_id for r in rows} <= clean
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF)
        assert out.columns == awkward.columns, name
        out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, awkward.limit(0), SF).count() == 0


def test_registry():
    found = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in found) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found) and json.dumps(queries.oracle_sql())
