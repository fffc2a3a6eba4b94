"""Arithmetic around language models: schedules, logits, norms, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import bound


def _warm(step: Column, top: float, warmup: int) -> Column:
    return top * step / max(warmup, 1)


def cosine_rate(step: Column, top: float, least: float, warmup: int, decay: int) -> Column:
    part = (step - warmup) / max(decay - warmup, 1)
    fall = least + 0.5 * (1 + F.cos(F.lit(math.pi) * part)) * (top - least)
    return F.when(step < warmup, _warm(step, top, warmup)).when(step > decay, F.lit(least)).otherwise(fall)


def linear_rate(step: Column, top: float, least: float, warmup: int, decay: int) -> Column:
    part = (step - warmup) / max(decay - warmup, 1)
    return F.when(step < warmup, _warm(step, top, warmup)).when(step >= decay, F.lit(least)).otherwise(top + part * (least - top))


def constant_rate(step: Column, top: float, warmup: int) -> Column:
    return F.when(step < warmup, _warm(step, top, warmup)).otherwise(F.lit(top))


def schedule(name: str, step: Column, top: float, least: float, warmup: int, steps: int, decay: int | None = None) -> Column:
    """By name; decay defaults to all steps; an unknown name is a ValueError."""
    decay = steps if decay is None else decay
    made = {
        "cosine_with_warmup": lambda: cosine_rate(step, top, least, warmup, decay),
        "linear_with_warmup": lambda: linear_rate(step, top, least, warmup, decay),
        "constant_with_warmup": lambda: constant_rate(step, top, warmup),
    }
    if name not in made:
        raise ValueError(f"unknown schedule {name!r}")
    return made[name]()


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def tempered(logit: Column, temperature: float) -> Column:
    return logit / max(temperature, 1e-8)


def penalized(logit: Column, seen: Column, penalty: float) -> Column:
    """Divided for tokens seen before, whatever its sign."""
    return F.when(seen, logit / penalty).otherwise(logit)


def softmax(logit: Column, by: str) -> Column:
    w = Window.partitionBy(by)
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def log_softmax(logit: Column, by: str) -> Column:
    w = Window.partitionBy(by)
    shifted = logit - F.max(logit).over(w)
    return shifted - F.log(F.sum(F.exp(shifted)).over(w))


def in_top_k(logit: Column, by: str, k: int) -> Column:
    """Whether a logit is at least the k-th largest: ties stay."""
    return F.rank().over(Window.partitionBy(by).orderBy(F.desc(logit))) <= k


def in_top_p(probability: Column, by: str, tie: str, p: float) -> Column:
    """Whether what comes before, in descending order, sums to at most p."""
    w = Window.partitionBy(by).orderBy(F.desc(probability), tie).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(probability).over(w) - probability <= p


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def softmax_of(logits: Column) -> Column:
    """Of an array, without a shuffle."""
    shifted = bound(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return bound(shifted, lambda e: bound(_sum(e), lambda s: F.transform(e, lambda v: v / s)))


def log_softmax_of(logits: Column) -> Column:
    top = F.array_max(logits)
    return bound(F.log(_sum(F.transform(logits, lambda v: F.exp(v - top)))) + top, lambda norm: F.transform(logits, lambda v: v - norm))


def top_k_of(logits: Column, k: int) -> Column:
    """(token, logit) of the logits that are at least the k-th largest: ties stay."""
    least = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    all_ = F.transform(logits, lambda v, i: F.struct(i.alias("token"), v.alias("logit")))
    return bound(least, lambda t: F.filter(all_, lambda x: x["logit"] >= t))


def top_p_of(probabilities: Column, p: float) -> Column:
    """(token, p) of those before which, in descending order, at most p is summed."""
    ranked = F.array_sort(F.transform(probabilities, lambda v, i: F.struct((-v).alias("minus"), i.alias("token"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    count = lambda r: F.aggregate(r, start, lambda s, x: F.when(s["sum"] <= p, F.struct((s["sum"] - x["minus"]).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    return bound(ranked, lambda r: F.transform(F.slice(r, F.lit(1), count(r)), lambda x: F.struct(x["token"].alias("token"), (-x["minus"]).alias("p"))))


def drawn(probabilities: Column, uniform: Column) -> Column:
    """The token that a uniform number in [0, 1) draws by the inverse cumulative distribution; the last one where rounding leaves none."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + F.when(s["sum"] + v <= uniform, 1).otherwise(0)).alias("n"))
    return F.aggregate(probabilities, start, step, lambda s: F.least(s["n"], F.size(probabilities) - 1))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def rms_norm(x: Column, eps: float = 1e-6, weight: Column | None = None) -> Column:
    scale = 1 / F.sqrt(_dot(x, x) / F.size(x) + eps)
    out = F.transform(x, lambda v: v * scale)
    return out if weight is None else F.zip_with(out, weight, lambda a, b: a * b)


def rotated(x: Column, position: Column, dim: int, base: float = 10000.0) -> Column:
    """Rotary embedding of a vector of `dim` at a position: halves rotated by position * base ** (-2i / dim)."""
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position * F.pow(F.lit(base), -2.0 * i / dim))
    turn = F.concat(angles, angles)
    other = F.concat(F.transform(F.slice(x, half + 1, half), lambda v: -v), F.slice(x, 1, half))
    return F.zip_with(F.zip_with(x, turn, lambda v, a: v * F.cos(a)), F.zip_with(other, turn, lambda v, a: v * F.sin(a)), lambda a, b: a + b)


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: g / (1 + F.exp(-g)) * u)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-softmax at a 0-based label; null where the label is -1 (ignored)."""
    top = F.array_max(logits)
    norm = F.log(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top
    return F.when(label != -1, norm - F.get(logits, label))


def parameters(vocab: Column, layers: Column, d: Column, ff: Column, heads: Column, kv: Column) -> Column:
    """Parameters by the reported formula, which leaves output projections out; embeddings tied."""
    attention = d * d + 2 * d * (d / heads * kv)
    return (vocab * d + layers * (attention + 3 * d * ff + 2 * d) + d).cast("long")
