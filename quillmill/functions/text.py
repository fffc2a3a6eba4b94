"""Cleaning and measuring of text as column expressions; two Python functions where Spark has none."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python strips it, written out because engines disagree on \s.
WS = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_IN_LINE = WS.replace(r"\t-\r", r"\t\x0b-\r")
URL = r"""(?i)(https?://|www\.)[^\s)\]}"'<>]+"""
WWW = ["".join(x) + "." for x in product("wW", repeat=3)]
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}"


@dataclass(frozen=True)
class CleanOptions:
    """Which steps run, and the length bounds in code points."""

    min_length: int = 100
    max_length: int = 100_000
    nfkc: bool = True
    latex: bool = True
    urls: bool = True
    emails: bool = True
    whitespace: bool = True
    lowercase: bool = False


@F.udf(StringType(), useArrow=False)
def _nfkc(t: str | None) -> str | None:
    return None if t is None else unicodedata.normalize("NFKC", t)


@F.udf(StringType(), useArrow=False)
def _casefolded(t: str | None) -> str | None:
    return None if t is None else t.casefold()


def _in_python(use, c: Column, source: Column | None) -> Column:
    """use(c), null where `source` (c, or what c is made from) is ASCII: no text of ASCII alone is sent to Python, and 100 rows at a time (an Arrow batch has 10,000)."""
    source = c if source is None else source
    return use(F.when(F.octet_length(source) > F.length(source), c))


def nfkc(c: Column, source: Column | None = None) -> Column:
    """NFKC; texts of ASCII alone are passed on as they are."""
    return F.coalesce(_in_python(_nfkc, c, source), c)


def casefolded(c: Column, source: Column | None = None) -> Column:
    """Full case folding, which Spark's lower() is not, but for ASCII."""
    return F.coalesce(_in_python(_casefolded, c, source), F.lower(c))


def fresh(df, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bound(value: Column, use) -> Column:
    """use(value) with a costly value made once, within one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def once(df, value: Column, into: str):
    """df with a column whose costly value is made once a row, however often it is used: optimizer rules don't pass an explode."""
    return df.withColumn(into, F.explode(F.array(value)))


def where_it_holds(c: Column, *marks: str):
    """Replacement that runs its regular expressions only on texts with one of the marks.

    The one-element transform binds the text, so that a chain of steps stays linear in size.
    """

    def step(change) -> Column:
        holds = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in marks])
        return F.get(F.transform(F.array(c), lambda x: F.when(holds(x), change(x)).otherwise(x)), F.lit(0))

    return step


def scrub(c: Column, o: CleanOptions = CleanOptions()) -> Column:
    """The replacement steps, in their fixed order."""
    raw, c = c, F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", "")
    if o.nfkc:
        c = nfkc(c, raw)
    if o.latex:
        c = where_it_holds(c, "\\")(lambda x: F.regexp_replace(F.regexp_replace(x, r"\\cite\w*\{[^}]*\}", "[REF]"), r"\\(ref|label|eqref)\{[^}]*\}", ""))
        c = where_it_holds(c, "$")(lambda x: F.regexp_replace(x, r"\$+[^$]*\$+", " [MATH] "))
        c = where_it_holds(c, "\\")(lambda x: F.regexp_replace(x, r"\\[a-zA-Z]+\*?\{[^}]*\}", ""))
    if o.urls:
        c = where_it_holds(c, "://", *WWW)(lambda x: F.regexp_replace(x, URL, "[URL]"))
    if o.emails:
        c = where_it_holds(c, "@")(lambda x: F.regexp_replace(x, EMAIL, "[EMAIL]"))
    if o.whitespace:
        c = F.replace(c, F.lit("\t"), F.lit(" "))
        c = where_it_holds(c, "\r")(lambda x: F.regexp_replace(x, r"\r\n?", "\n"))
        c = where_it_holds(c, "\n\n\n")(lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
        c = where_it_holds(c, "  ")(lambda x: F.regexp_replace(x, r" {2,}", " "))
        c = F.regexp_replace(c, rf"[{WS_IN_LINE}]+(\n|\z)", "$1")
        c = strip(c)
    return F.lower(c) if o.lowercase else c


def truncate(c: Column, most: int) -> Column:
    """At most `most` code points: cut at the last paragraph break in the second half, else hard; stripped."""
    cut = F.substring(c, 1, most)
    found = F.instr(F.reverse(cut), "\n\n")
    at = F.when(found > 0, F.length(cut) - found - 1).otherwise(-1)
    return F.when(F.length(c) <= most, c).otherwise(strip(F.when(at > most // 2, F.substr(cut, F.lit(1), at)).otherwise(cut)))


def clean(df, column: str = "text", options: CleanOptions = CleanOptions(), into: str = "clean", keep_length: str | None = None):
    """df with the cleaned text, null where the text is null or too short before or after cleaning.

    The scrubbed text is made once. A column that is named `into` already is replaced; others stay, whatever their names.
    """
    whole = df.drop(into) if into != column else df
    scrubbed, = fresh(whole, "_scrubbed")
    raw = F.when(F.length(column) >= options.min_length, scrub(F.col(column), options))
    out = once(whole, raw, scrubbed)
    kept = F.length(scrubbed) >= options.min_length
    out = once(out, F.when(kept, truncate(F.col(scrubbed), options.max_length)), into)
    if keep_length:
        out = out.withColumn(keep_length, F.length(scrubbed))
    return out.drop(scrubbed)


def chunks(c: Column, size: int, overlap: int = 0, least: int = 1) -> Column:
    """An array of chunks of whole paragraphs, a fold over them.

    A chunk is full when the next paragraph would take its paragraphs beyond `size`; the trailing
    paragraphs of less than `overlap` characters in all open the next chunk as well.
    """
    paragraphs = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, p: s + F.length(p))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("now"))

    def carried(now: Column) -> Column:
        if not overlap:
            return none
        n = F.aggregate(F.sequence(F.lit(1), F.size(now)), F.lit(0), lambda k, i: F.when(total(F.slice(now, F.size(now) - i + 1, i)) < overlap, i).otherwise(k))
        return F.when(n > 0, F.slice(now, F.size(now) - n + 1, n)).otherwise(none)

    def step(state: Column, p: Column) -> Column:
        now = state["now"]
        full = (F.size(now) > 0) & (total(now) + F.length(p) > size)
        done = F.when(full, F.concat(state["done"], F.array(F.array_join(now, "\n\n")))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, carried(now)).otherwise(now), F.array(p)).alias("now"))

    def finish(state: Column) -> Column:
        return F.when(F.size(state["now"]) > 0, F.concat(state["done"], F.array(F.array_join(state["now"], "\n\n")))).otherwise(state["done"])

    many = F.filter(F.aggregate(paragraphs, start, step, finish), lambda x: F.length(x) >= least)
    return F.when(F.length(c) <= size, F.array(c)).otherwise(many)


def normalized(c: Column) -> Column:
    """White space runs to one space, stripped, case folded."""
    return casefolded(F.btrim(F.regexp_replace(c, f"[{WS}]+", " ")), c)


def fingerprint(c: Column) -> Column:
    return F.sha2(normalized(c), 256)


def over_bytes(c: Column, limit: int) -> Column:
    """Whether the text, with line feeds as spaces, is longer than `limit` UTF-8 bytes."""
    return F.octet_length(F.replace(c, F.lit("\n"), F.lit(" "))) > limit
