"""Rule bitmask ledger: measure once, keep failure bits, apply versioned policies to the bits.

``ledger`` measures each whole text once and sets one bit for each rule that fails. A policy is a
named, versioned mask: a document is kept when no bit of the mask is set, so policies are applied,
and compared, without another pass over the texts. ``ablation`` counts, for each rule of a policy, the
documents that it rejects, and those that it alone rejects, by bitwise sums over the ledger.

Words are runs of anything but space and the ASCII controls 9 to 13; lines are split at line feeds.
Measurements are exact up to collisions of 64-bit hashes of words and windows. Letters are those of Unicode,
capitals those of ASCII and Latin-1.

Defined cases: a null or empty text has no words, measures 0 throughout, and fails the base; repeated
rows and null ids are measured row by row; other columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, runtime, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEDGER = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, fail_bits long"
WINDOW = 5
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: Rules in bit order: name, and whether a text fails by its measurements.
RULES = (
    ("too_few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    ("word_length", lambda m: (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]))),
    ("shouting", lambda m: (m["n_letters"] > 50) & (2 * m["n_upper"] > m["n_letters"])),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: Policies by version; later versions never change earlier ones.
POLICIES = {"base-1": BASE, "web-1": BASE | BITS["symbols"] | BITS["duplicate_lines"] | BITS["word_length"] | BITS["shouting"]}


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The measurements of each text, as arrays."""
    n = len(texts)
    w = words.Words(texts)
    count = np.diff(w.first)
    lead = (w.data & 0xC0) != 0x80  # one byte a code point
    points = np.concatenate([[0], np.cumsum(lead)])
    total = np.concatenate([[0], np.cumsum(points[w.end] - points[w.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[w.data])])
    begin = np.concatenate([[0], w.text_end[:-1] + 1]) if n else w.text_end
    out = {"n_words": count, "word_chars": total[w.first[1:]] - total[w.first[:-1]], "n_symbols": symbols[w.text_end] - symbols[begin]}

    hashes = w.hashes()
    found, at = words.windows(hashes, w.text, WINDOW)
    covered = np.zeros(len(hashes) + WINDOW, dtype=np.int32)
    if len(found):
        key = bpe.mix64(found + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        twice = at[_repeated(key)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: len(hashes)] > 0)])
    out["n_repeat_words"] = inside[w.first[1:]] - inside[w.first[:-1]]

    breaks = np.flatnonzero(w.data == 0x0A)
    line_start = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    full = np.searchsorted(w.start, breaks) > np.searchsorted(w.start, line_start)  # lines with a word
    line_start, line_end = line_start[full], breaks[full]
    text = np.searchsorted(w.text_end, line_start)
    dup = np.zeros(len(line_start), dtype=bool)
    if len(line_start):
        key = bpe.mix64(bpe.slice_hashes(w.data, line_start, line_end) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(text, weights=dup, minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(text, minlength=n)
    capital = (w.data >= 0x41) & (w.data <= 0x5A)
    capital[1:] |= (w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E) & (w.data[1:] != 0x97)
    letter = _LETTER[w.data]
    if (w.data >= 0x80).any():
        at = np.flatnonzero(lead & (w.data >= 0x80))  # letters of other scripts, by their code points
        letter[at] = bpe.classes()[_code_points(w.data, at)] == bpe.LETTER
    for name, flags in (("n_upper", capital), ("n_letters", letter)):
        sums = np.concatenate([[0], np.cumsum(flags)])
        out[name] = sums[w.text_end] - sums[begin]
    return {k: v.astype(np.int64) for k, v in out.items()}


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of two to four bytes that begin at these places."""
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    lead = data[at]
    two, three = (b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
    return np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def ledger_batches(batches, most: int = bpe.MAX_CHARS):
    names = [f.split()[0] for f in LEDGER.split(", ")]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in bpe.text_groups(texts, most):
            m, bits = fail_bits(texts[a:b])
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *(pa.array(m[k]) for k in names[1:-1]), pa.array(bits)], names=names)


def ledger(documents: DataFrame) -> DataFrame:
    """One row a document: its measurements and fail_bits."""
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(runtime.shipped("quillmill.llm.rules:ledger_batches"), LEDGER)


def fail_bits(texts: list[str | None]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Measurements, and a bit for each rule that fails."""
    m = measure(texts)
    bits = np.zeros(len(texts), dtype=np.int64)
    for i, (_, fails) in enumerate(RULES):
        bits |= fails(m).astype(np.int64) << i
    return m, bits


def keep_batches(batches, mask: int):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        groups = [(fail_bits(texts[a:b])[1] & mask) == 0 for a, b in bpe.text_groups(texts)]
        yield batch.filter(pa.array(np.concatenate(groups))) if groups else batch


def keep(documents: DataFrame, policy: str = "web-1") -> DataFrame:
    """The documents, with all their columns, that a policy keeps."""
    mask = POLICIES[policy] | BASE
    return documents.mapInArrow(runtime.shipped("quillmill.llm.rules:keep_batches", mask=mask), documents.schema)


def apply_policy(entries: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    mask = POLICIES[policy] | BASE
    return entries.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0, "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0})


def ablation(entries: DataFrame, policy: str = "web-1") -> DataFrame:
    """For each rule of a policy: rejected, and rejected by this rule alone; one row a rule."""
    mask = POLICIES[policy] | BASE
    under = F.col("fail_bits").bitwiseAND(F.lit(mask))
    by_bits = entries.groupBy(under.alias("bits")).count()  # at most 2 ** rules rows
    rules = [(name, bit) for name, bit in BITS.items() if bit & mask]
    sums = []
    for name, bit in rules:
        hit = F.col("bits").bitwiseAND(F.lit(bit)) != 0
        sums.append(F.struct(F.lit(name).alias("rule"), F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("rejected"), F.sum(F.when(F.col("bits") == bit, F.col("count")).otherwise(0)).alias("rejected_alone")))
    return by_bits.agg(F.array(*sums).alias("all")).selectExpr("inline(all)").na.fill(0)
