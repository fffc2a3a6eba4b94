"""The llm operators where a shortcut would lose rows, links or text."""

import time

import numpy as np
import pyarrow as pa

from quillmill.llm import ann, bpe, html_text, neardup, queries


def test_near_copies_that_repeat_a_passage_unequally_often(spark):
    rnd = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rnd.integers(0, 10**9, 300)]
        texts += [" ".join(words), " ".join(words[:150] * 20 + words[150:])]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    sketch = [np.frombuffer(s, dtype=np.uint8) for x in neardup.signature_batches([batch]) for s in x.column("sketch").to_pylist()]
    assert all((a == b).mean() > 0.9 for a, b in zip(sketch[::2], sketch[1::2], strict=True))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_sections_named_by_their_titles_stay():
    page = """<body><nav>Menu</nav><article><h1 class="header">Title</h1><p>First words of the article, more of them.</p><h2 id="discussion">Discussion</h2><p>Talk.</p>
<section id="related-work"><h2><span id="comments">Related</span></h2><p>Others did this.</p></section><div id="search-methods"><p>We search.</p></div><div class="section level2" id="discussion"><p>More.</p></div>
<h3 id="copyright">Copyright</h3><p>Sum <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding="application/x-tex">x = 1</annotation></semantics></math> holds.</p>
<div class="ad">Buy this</div><div id="comments"><p>Reader says.</p></div><h2 hidden id="a">Gone</h2></article></body>"""
    want = ["Title", "First words of the article, more of them.", "Discussion", "Talk.", "Related", "Others did this.", "We search.", "More.", "Copyright", "Sum x=1 holds."]
    assert html_text.extract(page).split("\n\n") == want


def test_more_than_4_mib_of_distinct_slices():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 5 << 20).astype(np.uint8)
    length = np.resize(np.array([40, 64, 100, 7]), len(data) // 64)
    start = np.cumsum(length) - length
    vocabulary = bpe.vocabulary(queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    keep = start + length <= len(data)
    start, length = start[keep], length[keep]
    repeated = np.concatenate([start, start]), np.concatenate([length, length])
    flat, offset, count = vocabulary.merge_all(data, *repeated)
    for i in [0, 1, 2, 3, *rng.integers(0, len(offset), 500).tolist(), len(offset) - 1]:
        at, n = repeated[0][i], repeated[1][i]
        assert flat[offset[i] : offset[i] + count[i]].tolist() == vocabulary.merge_one(data[at : at + n].tobytes())


def test_recall_on_random_unit_vectors():
    x = np.random.default_rng(8).standard_normal((20000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index, hits = ann.Index(np.arange(20000), x), 0
    for q in range(0, 20000, 200):
        score = x @ x[q]
        score[q] = -9
        hits += len(set(index.search(q, x[q], 20)[0].tolist()) & set(np.argpartition(-score, 20)[:20].tolist()))
    assert hits >= 0.95 * 2000


def test_search_costs_about_one_count_of_its_last_windows():
    """Every vector in all windows of the width that a search ends with is a collision; counting them one by one is what took the time."""
    n, x = 50000, np.random.default_rng(5).standard_normal((50000, 64))
    index = ann.Index(np.arange(n), x)
    lifted = np.column_stack([x, np.sqrt(np.maximum(index.norm**2 - (x**2).sum(1), 0))]) / index.norm
    projected = np.ascontiguousarray((lifted @ index.directions).T)
    ascending = np.take_along_axis(projected, index.order.astype(np.int64), 1)
    took = plain = 0.0
    for q in range(0, n, 2500):
        began = time.process_time()
        _, scores, _ = index.search(q, x[q], 20)
        took += time.process_time() - began
        length = float(np.sqrt((x[q] ** 2).sum()))
        width = ann.REACH * float(np.sqrt(2 - 2 * scores[-1] / (length * index.norm)))
        centre = np.append(x[q] / length, 0.0) @ index.directions
        began = time.process_time()
        low, high = ([int(np.searchsorted(a, c + w)) for a, c in zip(ascending, centre, strict=True)] for w in (-width, width))
        count = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(index.order, low, high, strict=True)]), minlength=n)
        plain += time.process_time() - began
        if hasattr(index, "colliding"):  # no vector with enough collisions is left out
            assert index.colliding(*index.window(centre, width))[count >= index.enough].all()
    assert took < 1.25 * plain


def test_counts_of_bits():
    rng = np.random.default_rng(6)
    for m, n in ((1, 64), (2, 64), (3, 128), (7, 64), (128, 640)):
        bits = rng.random((m, n)) < rng.random(n)
        planes = ann.bit_counts(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        for least in range(m + 2):
            assert np.array_equal(np.unpackbits(ann.at_least(planes, least).view(np.uint8), bitorder="little").view(bool), bits.sum(0) >= least)
