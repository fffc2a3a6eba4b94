"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text is measured once (by the measurements of the rule ledger and a few more); counts
become logarithms of smoothed ratios. Per class a mean and a covariance, shrunk towards the pooled
covariance and a multiple of the identity; the score is the logistic function of the difference of
Mahalanobis log-densities and log-priors. The inverse Cholesky factor of each class is computed once
and travels with the model.

The fit uses every labelled document of the training folds, whatever their number: a class is told by its count
and by the sums and the sums of products of its statistics. These are sums of integers (statistics in units of
2 ** -BITS), so that the model doesn't depend on the order of rows; nothing else reaches the driver. A score
depends on the text and the model alone, to the last bit, and not on the texts that are scored beside it.
Only the text is an input of a score.

Defined cases: null and empty texts have the statistics of no words and are scored like any text;
without labels of both classes every score is the share of label 1 (0.5 without any label); labels other
than 0 and 1, and labels without a document, don't count; repeated rows are scored row by row and weigh
once per doc_id in the fit; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, labelled, rules, runtime, words

SCORED = "doc_id long, score double"
#: Words (letters, lines) of usual text that each ratio is mixed with.
STRENGTH = 10.0
#: Statistics are rounded to units of 2 ** -BITS. Below 64 in size (logarithms of ratios of counts), SUMMED of them have products whose sum fits a long.
BITS, SUMMED = 20, 1024
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics for each text, in whole multiples of 2 ** -BITS."""
    m = rules.measure(texts)
    w = words.Words(texts)
    n = m["n_words"].astype(float)
    begin = np.concatenate([[0], w.text_end[:-1] + 1]) if len(texts) else w.text_end

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[w.text_end] - sums[begin]).astype(float)

    key = w.hashes()
    order = np.lexsort((key, w.text))
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (w.text[order[1:]] == w.text[order[:-1]])
    distinct = np.bincount(w.text[order[~same]], minlength=len(texts)).astype(float)
    next_same = np.zeros(len(key), dtype=bool)
    next_same[1:] = (key[1:] == key[:-1]) & (w.text[1:] == w.text[:-1])
    echoed = np.bincount(w.text, weights=next_same, minlength=len(texts))

    def share(a, b, usual):
        """Log of a ratio, drawn to its usual value in short texts, which tell little."""
        return np.log((a + STRENGTH * usual) / (b + STRENGTH) + 1e-3)

    x = np.column_stack([
        share(m["n_upper"], m["n_letters"], 0.04),
        share(m["n_symbols"], n, 0.0),
        share(inside(_PUNCT[w.data]), n, 0.0),
        share(distinct, n, 0.8),
        share(echoed, n, 0.0),
        share(m["n_repeat_words"], n, 0.0),
        share(m["n_dup_lines"], m["n_lines"], 0.0),
        share(m["word_chars"], n, 5.0),
        share(inside(_DIGIT[w.data]), m["word_chars"], 0.0),
    ])
    return np.rint(x * (1 << BITS)) / (1 << BITS)


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float = 0.1, ridge: float = 0.02):
        own = [x[y == k] for k in (0, 1)]
        self._shrink([(len(r), r.mean(0), np.atleast_2d(np.cov(r.T, bias=True))) if len(r) else (0, None, None) for r in own], pooled, ridge)

    @classmethod
    def of_sums(cls, totals: list[np.ndarray], pooled: float = 0.1, ridge: float = 0.02) -> Discriminant:
        """From the ``sums`` of class 0 and of class 1; means and covariances are exact before they are rounded."""
        model, moments = cls.__new__(cls), []
        for t in totals:
            n, unit = int(t[0, 0]), 1 << BITS
            spread = n * t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:])
            mean, cov = ([float(Fraction(int(v), d)) for v in a.ravel()] if n else None for a, d in ((t[0, 1:], n * unit), (spread, (n * unit) ** 2)))
            moments.append((n, np.array(mean), np.array(cov).reshape(len(mean), -1)) if n else (0, None, None))
        model._shrink(moments, pooled, ridge)
        return model

    def _shrink(self, moments: list[tuple], pooled: float, ridge: float) -> None:
        """moments: of each class its count, mean and covariance."""
        (n0, mean0, cov0), (n1, mean1, cov1) = moments
        self.constant = None
        if min(n0, n1) == 0:
            self.constant = n1 / (n0 + n1) if n0 + n1 else 0.5
            return
        share = n1 / (n0 + n1)
        self.centre = (1 - share) * mean0 + share * mean1
        within = (1 - share) * np.diag(cov0) + share * np.diag(cov1)
        self.scale = np.sqrt(within + share * (1 - share) * (mean1 - mean0) ** 2) + 1e-9
        own = [c / np.outer(self.scale, self.scale) for c in (cov0, cov1)]
        both = (1 - share) * own[0] + share * own[1]
        self.parts = []
        for k, (n, mean, _) in enumerate(moments):
            c = (1 - pooled) * own[k] + pooled * both
            c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
            lower = np.linalg.cholesky(c)
            self.parts.append(((mean - self.centre) / self.scale, np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum(), np.log(n)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Products are summed in one order, statistic after statistic: a product of matrices would round by the number of rows."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.ascontiguousarray(((x - self.centre) / self.scale).T)
        density = []
        for mean, inverse, volume, prior in self.parts:
            apart, distance = z - mean[:, None], np.zeros(len(x))
            for i in range(len(inverse)):
                distance += sum(inverse[i, j] * apart[j] for j in range(i + 1)) ** 2  # inverse is lower triangular
            density.append(prior - 0.5 * distance - 0.5 * volume)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def sums(x: np.ndarray) -> np.ndarray:
    """Count, sums, and sums of products of rows of statistics, in units of 2 ** -BITS, as one matrix of Python integers."""
    rows = np.column_stack([np.ones(len(x), dtype=np.int64), np.rint(x * (1 << BITS)).astype(np.int64)])
    out = np.zeros((rows.shape[1], rows.shape[1]), dtype=object)
    for lo in range(0, len(rows), SUMMED):
        some = rows[lo : lo + SUMMED]
        out += (some.T @ some).astype(object)
    return out


def statistics_batches(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts):
            x = statistics(texts[a:b])
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def sum_batches(batches):
    """Rows (label, x) to label, place, total: the entries of the ``sums`` of each label, for each batch."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        x = batch.column("x").flatten().to_numpy().reshape(len(label), -1 if len(label) else 0)
        for k in np.unique(label).tolist():
            entries = sums(x[label == k]).ravel().tolist()
            total = pa.array([Decimal(v) for v in entries], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array([k] * len(entries), pa.int32()), pa.array(range(len(entries)), pa.int32()), total], names=["label", "place", "total"])


def score_batches(batches, model: Discriminant):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts):
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(model.score(statistics(texts[a:b])))], names=["doc_id", "score"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1) -> Discriminant:
    """The training folds are measured in place; statistics, not texts, are shuffled to their labels."""
    told = labelled.training(labels, label, modulus, held).where("label in (0, 1)").distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (labelled.fold(modulus) != held))
    measured = rows.mapInArrow(runtime.shipped("quillmill.llm.quality:statistics_batches"), "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    entries = measured.join(told, "doc_id").select("label", "x").mapInArrow(runtime.shipped("quillmill.llm.quality:sum_batches"), "label int, place int, total decimal(38,0)")
    found = entries.groupBy("label", "place").agg(F.sum("total").alias("total")).collect()  # one row an entry of a matrix
    side = statistics([]).shape[1] + 1
    totals = [np.zeros((side, side), dtype=object) for _ in range(2)]
    for r in found:
        totals[r.label].flat[r.place] = int(r.total)
    return Discriminant.of_sums(totals)


def score(documents: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every document."""
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(runtime.shipped("quillmill.llm.quality:score_batches", model=model), SCORED)


def keep_batches(batches, model: Discriminant, least: float):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        groups = [model.score(statistics(texts[a:b])) >= least for a, b in bpe.text_groups(texts)]
        yield batch.filter(pa.array(np.concatenate(groups))) if groups else batch


def keep(documents: DataFrame, model: Discriminant, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is at least `least`."""
    return documents.mapInArrow(runtime.shipped("quillmill.llm.quality:keep_batches", model=model, least=least), documents.schema)
