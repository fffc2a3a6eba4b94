"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are runs of letters or numbers of the lower-cased text. A token's weight is its log-odds ratio
between toxic and other labelled documents (documents that hold it are counted, equal texts once) under a
Dirichlet prior of `prior` documents a token, divided between the classes by their size, so that a token
without evidence has weight 0. Weights keep their sign, and are drawn to 0 by z^2 / (z^2 + `doubt`^2), where
z is the ratio over its standard error; each token also costs `drift`, so that chance segments
end. A linear-time scan finds all maximal scoring segments of a whole text.

In texts of no toxic passage the best segment follows an extreme-value law, whose K and lambda are fitted by
maximum likelihood to the labelled documents with label 0; the evidence of a text is the negative log E-value of
its best segment plus those of all further significant ones, and a logistic curve gives the score. Law
and curve are fitted across two folds: each fold's documents are judged by weights of the other fold alone, so
that no document counts as evidence for the weights that judge it. The final weights come from both.

The fit uses a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``, 20,000); all their tokens are kept,
and four numbers a document reach the driver. Only the text is an input of a score.

Defined cases: null and empty texts have no tokens and score as a text without a segment; without
labels of both classes every score is the share of label 1 (0 without any label); repeated rows are
scored row by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, labelled, runtime

SCORED = "doc_id long, score double, passages array<struct<start:long,length:long,weight:double,e_value:double>>"


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Tokens:
    """Tokens of many texts: start and end code point in their text, hash, number of the text; first: of each text its first token."""

    def __init__(self, texts: list[str | None]):
        low = [_lower(t) if t else "" for t in texts]
        joined = "\n".join([*low, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in low]).astype(np.int64) - 1 if low else np.zeros(0, dtype=np.int64)
        kind = bpe.classes()[points]
        word = (kind == bpe.LETTER) | (kind == bpe.NUMBER) | (kind >= bpe.ONE)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        self.hash = bpe.slice_hashes(points, start, end)
        self.text = np.searchsorted(ends, start)
        begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.start, self.end = start - begin[self.text], end - begin[self.text]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))


def maximal(left: list[float], right: list[float], at: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (weight, first token, last token), in linear time.

    Of each token with a positive weight, in order: the sum of all weights before it, that sum with it, and its place.
    """
    found: list[tuple[float, float, int, int]] = []  # left sum, right sum, first, last
    for l, r, p in zip(left, right, at, strict=True):
        now = (l, r, p, p)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= now[0]:
                j -= 1
            if j < 0 or found[j][1] >= now[1]:
                found.append(now)
                break
            now = (found[j][0], now[1], found[j][2], now[3])
            del found[j:]
    return [(r - l, a, b) for l, r, a, b in found]


def segments(at: list[int], weight: list[float], drift: float) -> list[tuple[float, int, int]]:
    """The same where every token between those of positive weight costs `drift`."""
    inside = np.array([w + drift * (p - k) for k, (p, w) in enumerate(zip(at, weight, strict=True))])
    paid = np.cumsum([0.0, *weight])
    gaps = inside - np.array(weight)
    return maximal((paid[:-1] - gaps).tolist(), (paid[1:] - gaps).tolist(), at)


def log_odds(n1: np.ndarray, n0: np.ndarray, prior: float, doubt: float) -> np.ndarray:
    """Weight of each token found in n1 toxic and n0 other documents."""
    s1, s0 = float(n1.sum()), float(n0.sum())
    if not s1 or not s0:
        return np.zeros(len(n1))
    a1, a0 = n1 + prior * s1 / (s1 + s0), n0 + prior * s0 / (s1 + s0)
    odds = np.log(a1 / a1.sum()) - np.log(a0 / a0.sum())
    z2 = odds**2 / (1 / a1 + 1 / a0)
    return odds * z2 / (z2 + doubt**2)


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, drift: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.drift = hashes[order], weights[order], drift
        self.rate, self.log_k, self.slope, self.shift, self.constant = 1.0, 0.0, 1.0, 0.0, None

    def found(self, texts: list[str | None]) -> tuple[Tokens, list[list[tuple[float, int, int]]], np.ndarray]:
        """Tokens; of each text its segments and the number of tokens."""
        t = Tokens(texts)
        weight = np.zeros(len(t.hash))
        if len(self.hashes) and len(t.hash):
            place = np.minimum(np.searchsorted(self.hashes, t.hash), len(self.hashes) - 1)
            weight = np.where(self.hashes[place] == t.hash, self.weights[place], 0.0)
        weight -= self.drift
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        hot = np.flatnonzero(weight > 0)
        bounds = np.searchsorted(hot, t.first).tolist()
        at, left, right = hot.tolist(), upto[hot].tolist(), upto[hot + 1].tolist()
        out = [maximal(left[a:b], right[a:b], at[a:b]) if b > a else [] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return t, out, np.diff(t.first)

    def log_e(self, weight: float, n_tokens: int) -> float:
        """Logarithm of the number of segments of this weight expected by chance."""
        return self.log_k + math.log(max(n_tokens, 1)) - self.rate * weight

    def statistic(self, segs: list[tuple[float, int, int]], n_tokens: int) -> float:
        """Evidence of the best segment, and of each further significant one, in nats beyond chance."""
        logs = sorted(self.log_e(w, n_tokens) for w, _, _ in segs) or [self.log_e(0.0, n_tokens)]
        return -logs[0] + sum(-x for x in logs[1:] if x < 0)

    def score_of(self, statistic: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(statistic), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * statistic + self.shift, -500, 500)))


def count_batches(batches):
    """Documents of each fold and label that hold a token, counted within batches."""
    for batch in batches:
        texts, label, fold = batch.column("text").to_pylist(), batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
        for a, b in bpe.text_groups(texts):
            t = Tokens(texts[a:b])
            pair = np.unique(np.rec.fromarrays([t.text, t.hash], names="text,hash")) if len(t.hash) else np.rec.fromarrays([t.text, t.hash], names="text,hash")
            keys, inverse = np.unique(pair["hash"], return_inverse=True)
            kind = 2 * fold[a:b][pair["text"]] + (label[a:b][pair["text"]] == 1)
            n = np.bincount(inverse * 4 + kind, minlength=4 * len(keys)).reshape(-1, 4) if len(keys) else np.zeros((0, 4), dtype=np.int64)
            yield pa.record_batch([pa.array(keys.view(np.int64)), *(pa.array(n[:, k].astype(np.int64)) for k in range(4))], names=["token", *COUNTS])


#: Documents of label 0 and 1 in the first fold, then in the second.
COUNTS = ("a0", "a1", "b0", "b1")


def evidence_batches(batches, models: list[Model]):
    """label, n, best, statistic of each document, by the weights of the other fold."""
    for batch in batches:
        texts, fold = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
        for a, b in bpe.text_groups(texts):
            best, size, told = np.zeros(b - a), np.zeros(b - a, dtype=np.int64), np.zeros(b - a)
            for k, model in enumerate(models):
                own = [i for i in range(b - a) if fold[a + i] != k]
                _, segs, n = model.found([texts[a + i] for i in own])
                best[own] = [max((w for w, _, _ in s), default=0.0) for s in segs]
                size[own] = n
                told[own] = [model.statistic(s, m) for s, m in zip(segs, n.tolist(), strict=True)]
            yield pa.record_batch([batch.column("label").slice(a, b - a), pa.array(size), pa.array(best), pa.array(told)], names=["label", "n", "best", "statistic"])


def score_batches(batches, model: Model):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts):
            t, segs, n = model.found(texts[a:b])
            told = []
            for s, k in zip(segs, n.tolist(), strict=True):
                told.append([{"start": int(t.start[x]), "length": int(t.end[y] - t.start[x]), "weight": w, "e_value": math.exp(min(e, 700.0))} for w, x, y in s if (e := model.log_e(w, k)) < 0])
            value = model.score_of(np.array([model.statistic(s, k) for s, k in zip(segs, n.tolist(), strict=True)]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("weight", pa.float64()), ("e_value", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(value, pa.float64()), pa.array(told, kind)], names=["doc_id", "score", "passages"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, prior: float = 1.0, doubt: float = 6.0, drift: float = 0.2) -> Model:
    chosen = labelled.sample(documents, labels, label, modulus, held).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["text_hash", "label"])
    chosen = runtime.written(chosen.withColumn("fold", F.pmod("text_hash", F.lit(2)).cast("int")), "toxicity-sample")
    docs = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    d1, d = docs.get(1, 0), sum(docs.values())
    if not d1 or d1 == d:
        model = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), drift)
        model.constant = d1 / d if d else 0.0
        runtime.discard(chosen)
        return model
    counts = chosen.mapInArrow(runtime.shipped("quillmill.llm.toxicity:count_batches"), ", ".join(f"{c} long" for c in ("token", *COUNTS)))
    counts = counts.groupBy("token").agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()  # the tokens of the bounded sample
    token = counts.column("token").to_numpy().view(np.uint64)
    a0, a1, b0, b1 = (counts.column(c).to_numpy().astype(np.float64) for c in COUNTS)
    of = lambda n1, n0: Model(token, log_odds(n1, n0, prior, doubt), drift)
    model, halves = of(a1 + b1, a0 + b0), [of(a1, a0), of(b1, b0)]

    def evidence():
        told = chosen.mapInArrow(runtime.shipped("quillmill.llm.toxicity:evidence_batches", models=halves), "label int, n long, best double, statistic double").toArrow()
        return (told.column(c).to_numpy() for c in ("label", "n", "best", "statistic"))

    y, n, best, _ = evidence()
    model.rate, model.log_k = extreme_value_law(best[y == 0], n[y == 0])
    for half in halves:
        half.rate, half.log_k = model.rate, model.log_k
    y, _, _, statistic = evidence()
    model.slope, model.shift = logistic(statistic, y)
    runtime.discard(chosen)
    return model


def extreme_value_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and log K of P(best <= x) = exp(-K n exp(-lambda x)) by maximum likelihood; best is 0 where there is no segment."""
    n, some = np.maximum(n, 1).astype(np.float64), best > 0
    m = int(some.sum())
    if m < 2:
        return 1.0, math.log((m + 0.5) / n.sum()) if len(n) else 0.0

    def likelihood(rate: float) -> float:
        """With the K that is best for this lambda."""
        return m * math.log(m / (n * np.exp(-rate * best)).sum()) + m * math.log(rate) - rate * best.sum()

    rates = np.geomspace(0.01, 100, 200)
    k = int(np.argmax([likelihood(x) for x in rates]))
    fine = np.linspace(rates[max(k - 1, 0)], rates[min(k + 1, len(rates) - 1)], 200)
    rate = float(fine[int(np.argmax([likelihood(x) for x in fine]))])
    return rate, math.log(m / (n * np.exp(-rate * best)).sum())


def logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from statistics to the share of label 1, by Newton's method."""
    scale = float(s.std()) or 1.0
    s = s / scale
    a, b = 1.0, 0.0
    target = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        w = p * (1 - p) + 1e-12
        g = np.array([((p - target) * s).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        most = np.abs(step).max()
        step *= min(1.0, 1.0 / max(most, 1e-12))
        a, b = a - step[0], b - step[1]
        if most < 1e-9:
            break
    return max(float(a), 1e-6) / scale, float(b)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages (code points) of every document."""
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(runtime.shipped("quillmill.llm.toxicity:score_batches", model=model), SCORED)
