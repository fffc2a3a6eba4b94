"""Near-duplicate classes by ProbMinHash, banding and exact verification.

1. One pass over the texts: a 128-bit hash of the whole text (each distinct text is one vertex, numbered
   when it is written), and a ProbMinHash signature of the distinct five-word shingles, all of weight 1,
   so that registers estimate the plain Jaccard similarity that links are verified by. 28 bands of 5
   registers: a pair at 0.8 shares a band with probability 1 - 1.5e-5. A sketch keeps 8 bits of each register.
2. Star round: in each band bucket every member meets the bucket's least vertex. Pairs whose sketches agree
   on enough registers are verified on their whole texts (exact Jaccard of the shingle sets).
3. Verified links are joined to classes.
4. Cross round: buckets that still hold members of several classes are compared in full, sketch
   against sketch, in blocks of bounded size; only pairs of different classes are verified. Members of one
   class are never paired with each other, so groups of thousands of copies cost their number of links,
   not its square. Buckets of all sizes are compared by the same rule, none is capped or divided by
   other bands: the size only tells into how many blocks a bucket is cut, and every two blocks meet.

Joins on keys that may be shared by many rows (a bucket, a star's centre, a text with many copies, a class)
are salted (``runtime.salted_join``). All tables between the steps are written to the shared folder and
deleted when they are used up; ids and links never reach the driver.

Defined cases: words are runs without ASCII white space; a text of one to four words is one shingle;
equal texts share a class, the empty text included; a null text is a class of its own (class_id is then the
doc_id); a null doc_id has the class of its text, null if no row of the class has an id; rows repeated under
one doc_id are one document; ids that stand for several texts join their classes, but each of the
texts stays in ``survivors`` unless it has a near copy of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, runtime, words

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Pairs whose sketches agree on a smaller share are taken to be below THRESHOLD: more than four standard deviations.
LEAST_ESTIMATE = 0.66
#: A mixed bucket is cut into blocks of BLOCK members; one of more than LARGE members into LARGE / BLOCK blocks, or more, so that none holds more than 16 * LARGE.
BLOCK = 512
LARGE = 4096
#: Pairs of sketches that are compared at once.
PAIRS = 1 << 15


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text: hash, number of the text (ascending), count.

    A text of one to four words is one shingle of all its words.
    """
    w = words.Words(texts)
    hashes = w.hashes()
    found, at = words.windows(hashes, w.text, SIZE)
    text = w.text[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < SIZE))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(bpe.mix64(hashes[w.first[i] : w.first[i + 1]] + np.arange(n[i], dtype=np.uint64))) for i in short], dtype=np.uint64)
        found, text = np.concatenate([found, bpe.mix64(whole + np.uint64(SIZE))]), np.concatenate([text, short])
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return found[first], text[first], np.diff(np.append(first, len(found)))


def probminhash(hashes: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, size: int = REGISTERS) -> np.ndarray:
    """Of each text and register the hash of the element whose arrival there is the earliest.

    Every element sends arrivals of a Poisson process of rate `weight`, each to a random register. An
    element ends as soon as its next arrival can't come before the latest register of its text.
    All texts advance together; an element's arrivals depend on its hash alone.
    """
    best = np.full(n_texts * size, np.inf)
    owner = np.zeros(n_texts * size, dtype=np.uint64)
    live, clock, turn = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(live):
        steps = max(1, min(512, (1 << 16) // len(live)))
        turns = (np.arange(turn + 1, turn + steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        h = hashes[live]
        r = bpe.mix64(h[None, :] + turns)
        wait = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))) / weight[live]
        when = clock[live] + np.cumsum(wait, axis=0)
        place = text[live] * size + (bpe.mix64(r ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(size)).astype(np.int64)
        flat_when, flat_place = when.ravel(), place.ravel()
        sooner = np.flatnonzero(flat_when < best[flat_place])
        order = sooner[np.argsort(-flat_when[sooner], kind="stable")]  # the earliest is written last
        best[flat_place[order]] = flat_when[order]
        owner[flat_place[order]] = np.broadcast_to(h, when.shape).ravel()[order]
        clock[live] = when[-1]
        latest = best.reshape(n_texts, size).max(1)
        live = live[clock[live] < latest[text[live]]]
        turn += steps
    return owner.reshape(n_texts, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the number of the band is part of it."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for j in range(ROWS):
        key = bpe.mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return key


def signature_batches(batches):
    """doc_id, text_hash, band keys, sketch; texts without a word have no bands."""
    for batch in batches:
        for a, b, (own,) in bpe.column_groups(batch.column("text")):
            hashes, text, _ = shingles(own)
            signature = probminhash(hashes, text, np.ones(len(hashes)), b - a)
            keys = band_keys(signature).view(np.int64)
            sketch = (bpe.mix64(signature) & np.uint64(0xFF)).astype(np.uint8)
            some = np.bincount(text, minlength=b - a) > 0
            digest = [None if t is None else hashlib.sha256(t.encode()).digest()[:16] for t in own]
            bands = [k if ok else [] for k, ok in zip(keys, some, strict=True)]
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "text_hash", "bands", "sketch"])


def similar_batches(batches, threshold: float):
    """Pairs (a, b) whose shingle sets have at least this Jaccard similarity."""
    for batch in batches:
        for lo, hi, pair in bpe.column_groups(batch.column("text_a"), batch.column("text_b")):
            sides = []
            for texts in pair:
                hashes, text, _ = shingles(texts)
                sides.append((bpe.mix64(hashes ^ bpe.mix64(text.astype(np.uint64) + np.uint64(1))), text))
            (ka, ta), (kb, tb) = sides
            both = np.bincount(ta[np.isin(ka, kb)], minlength=hi - lo)
            union = np.bincount(ta, minlength=hi - lo) + np.bincount(tb, minlength=hi - lo) - both
            jaccard = both / np.maximum(union, 1)
            keep = pa.array(np.flatnonzero(jaccard >= threshold))
            part = batch.slice(lo, hi - lo).take(keep)
            yield pa.record_batch([part.column("a"), part.column("b"), pa.array(jaccard[keep.to_numpy()])], names=["a", "b", "jaccard"])


def agreeing_batches(batches, least: float):
    """Pairs (a, b) whose sketches agree on at least this share of registers."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        keep = pa.array(np.flatnonzero((x == y).mean(1) >= least)) if len(x) else pa.array([], pa.int64())
        part = batch.take(keep)
        yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"])


def block_batches(batches, least: float):
    """Rows sorted by (band, i, j), one block pair a group: pairs of different classes whose sketches agree."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
        edge = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1 if table.num_rows > 1 else np.zeros(0, dtype=np.int64)
        last = int(edge[-1]) if len(edge) else 0
        held = table.slice(last)
        if last:
            yield _compare(table.slice(0, last), np.concatenate([[0], edge]), least)
    if held is not None and held.num_rows:
        yield _compare(held, np.array([0, held.num_rows]), least)


def _compare(table: pa.Table, edge: np.ndarray, least: float) -> pa.RecordBatch:
    doc, cls, block = (table.column(c).to_numpy() for c in ("doc", "class_id", "block"))
    i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        order = lo + np.argsort(cls[lo:hi], kind="stable")
        crossed = i[lo] != j[lo]
        one, two = (order[block[order] == side[lo]] for side in (i, j)) if crossed else (order, order)
        for x, y in _near(cls[one], cls[two], sketch[one].T, sketch[two].T, crossed, least * REGISTERS):
            left.append(doc[one[x]])
            right.append(doc[two[y]])
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _near(own: np.ndarray, other: np.ndarray, sketch: np.ndarray, facing: np.ndarray, crossed: bool, least: float):
    """Places of members of two sides, each sorted by class, that differ in class and agree on `least` registers; each pair once if both sides are one (not crossed)."""
    sketch, facing, at = np.ascontiguousarray(sketch), np.ascontiguousarray(facing), 0
    while at < len(own):
        # A class is met by those after its own; by those before, too, if the sides differ.
        begin, end = np.searchsorted(other, own[at], "left"), np.searchsorted(other, own[at], "right")
        run = np.searchsorted(own, own[at], "right") - at
        spans = [(0, begin), (end, len(other))] if crossed else [(end, len(other))]
        if run < 64:  # several small classes at once
            run, spans = min(64, len(own) - at), [(0, len(other))] if crossed else [(end, len(other))]
        for lo, hi in spans:
            for y in range(lo, hi, PAIRS >> 6):
                theirs = slice(y, min(y + (PAIRS >> 6), hi))
                step = max(1, PAIRS // (theirs.stop - y))
                for x in range(at, at + run, step):
                    mine = slice(x, min(x + step, at + run))
                    agree = np.add.reduce((sketch[:, mine, None] == facing[:, None, theirs]).view(np.uint8), axis=0, dtype=np.uint8)
                    apart = own[mine, None] != other[theirs] if crossed else own[mine, None] < other[theirs]
                    p, q = np.nonzero((agree >= least) & apart)
                    if len(p):
                        yield x + p, y + q
        at += run


def components(links: DataFrame) -> DataFrame:
    """vertex, class_id (the least vertex) of every vertex of links (a, b): least neighbours and pointer jumping, to the fixed point."""
    both = runtime.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "links")
    degrees = runtime.written(both.groupBy("v").agg(F.count("*").alias("n")), "degrees")
    now = runtime.written(both.groupBy("u").agg(F.min("v").alias("c")).select("u", F.least("u", "c").alias("c")), "classes")
    while True:
        heard = runtime.salted_join(both, now.select(F.col("u").alias("v"), F.col("c").alias("d")), "v", degrees).groupBy("u").agg(F.min("d").alias("d"))
        nearer = runtime.written(now.join(heard, "u").select("u", "c", F.least("c", "d").alias("d")), "nearer")
        jump = nearer.select(F.col("u").alias("d"), F.col("d").alias("e"))
        then = runtime.written(runtime.salted_join(nearer, jump, "d").select("u", "c", F.least("d", "e").alias("e")), "classes")
        moved = then.where("c <> e").limit(1).count()
        runtime.discard(now, nearer)
        now = then.select("u", F.col("e").alias("c"))
        now._written_to = then._written_to
        if not moved:
            runtime.discard(both, degrees)
            return now.select(F.col("u").alias("vertex"), F.col("c").alias("class_id"))


def _verified(pairs: DataFrame, need: DataFrame, name: str) -> DataFrame:
    """Links among the written pairs (a, b), by their whole texts (doc, text); a may be the same in many pairs."""
    centres = runtime.written(pairs.groupBy("a").agg(F.count("*").alias("n")), "centres")
    with_b = pairs.join(need.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = runtime.salted_join(with_b, need.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a", centres).select("a", "b", "text_a", "text_b")
    call = runtime.shipped("quillmill.llm.neardup:similar_batches", threshold=THRESHOLD)
    out = runtime.written(with_both.mapInArrow(call, "a long, b long, jaccard double"), name)
    runtime.discard(centres)
    return out


def _crossing(met: DataFrame, sketches: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes that share a bucket (counts: band, n) and whose sketches agree, written."""
    own: Column = F.coalesce("class_id", "doc")
    placed = met.select("band", F.col("b").alias("doc")).join(found.withColumnRenamed("vertex", "doc"), "doc", "left").select("band", "doc", own.alias("class_id"))
    placed = runtime.written(placed, "placed")
    sides = placed.groupBy("band").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count("*").alias("n"))
    mixed = runtime.written(sides.where("lo < hi").select("band", "n"), "mixed")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(-(-LARGE // BLOCK))), F.ceil(F.col("n") / (16 * LARGE))).cast("int")
    rows = runtime.salted_join(placed, mixed, "band", counts).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "class_id").join(sketches, "doc")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "doc")
    crossing = rows.mapInArrow(runtime.shipped("quillmill.llm.neardup:block_batches", least=LEAST_ESTIMATE), "a long, b long").distinct()
    out = runtime.written(crossing, "crossing")
    runtime.discard(placed, mixed)
    return out


def _text_hash(text: str) -> Column:
    """As in signature_batches; empty for a null text."""
    return F.coalesce(F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16), F.lit(b""))


def _text_classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, root (the least vertex of its class, null for a null text) of every row, written."""
    texts = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    signed = runtime.written(texts.mapInArrow(runtime.shipped("quillmill.llm.neardup:signature_batches"), "doc_id long, text_hash binary, bands array<long>, sketch binary"), "signatures")
    named = signed.where("text_hash is not null")
    each = named.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "bands", "sketch")).alias("s"), F.count("*").alias("n"))
    standing = runtime.written(each.select(F.monotonically_increasing_id().alias("doc"), "text_hash", "s.doc_id", "s.bands", "s.sketch", "n"), "standing")
    banded = standing.select("doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count("*").alias("n")).where("a < z")
    shared = runtime.written(shared.select("band", "a", "n"), "shared")
    met = runtime.written(runtime.salted_join(banded, shared.select("band", "a"), "band", shared).select("a", F.col("doc").alias("b"), "band"), "met")
    ids = met.select(F.col("b").alias("doc")).distinct()
    wanted = runtime.written(standing.join(ids.hint("shuffle_hash"), "doc", "left_semi").select("doc", "doc_id", "text_hash", "sketch"), "wanted")
    sketches = wanted.select("doc", "sketch")
    # The ids have no bound: never broadcast them, whatever their number, and shuffle the texts once.
    asked = wanted.select(F.col("doc_id").alias("id"), "doc", "text_hash").hint("shuffle_hash")
    need = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("id"))).where(_text_hash("text") == F.col("text_hash"))
    need = runtime.written(need.groupBy("doc_id", "doc").agg(F.min("text").alias("text")).select("doc", "text"), "texts")
    star = runtime.written(met.where("a <> b").select("a", "b").distinct(), "star-pairs")
    side = lambda name: sketches.select(F.col("doc").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    agreeing = runtime.shipped("quillmill.llm.neardup:agreeing_batches", least=LEAST_ESTIMATE)
    near = runtime.salted_join(star, side("a"), "a").join(side("b"), "b").mapInArrow(agreeing, "a long, b long")
    near = runtime.written(near, "star")
    runtime.discard(star)
    links = _verified(near, need, "star-links")
    found = components(links)
    crossing = _crossing(met, sketches, found, shared)
    more = _verified(crossing, need, "cross-links")
    runtime.discard(near, crossing, need, wanted, met, shared)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    of_text = standing.join(found.withColumnRenamed("vertex", "doc"), "doc", "left").select("text_hash", F.coalesce("class_id", "doc").alias("root"))
    told = runtime.salted_join(named.select("doc_id", "text_hash"), of_text, "text_hash", standing).select("doc_id", "text_hash", "root")
    nothing = signed.where("text_hash is null").select("doc_id", F.lit(b"").alias("text_hash"), F.lit(None).cast("long").alias("root"))
    told = runtime.written(told.unionByName(nothing), "told")
    runtime.discard(signed, standing, links, more)
    return told


def classes(documents: DataFrame) -> DataFrame:
    """doc_id and class_id of every document (doc_id, text)."""
    told = _text_classes(documents)
    named = told.where("root is not null")
    torn = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("doc_id", "a")
    torn = runtime.written(torn, "torn")
    if torn.limit(1).count():
        joined = components(named.join(torn, "doc_id").where("a <> root").select("a", F.col("root").alias("b")).distinct())
        named = runtime.salted_join(named, joined.withColumnRenamed("vertex", "root"), "root", how="left").select("doc_id", F.coalesce("class_id", "root").alias("root"))
        named = runtime.written(named, "joined")
    least = runtime.written(named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "least")
    out = runtime.salted_join(named.select("doc_id", "root"), least.select("root", "class_id"), "root", least).select("doc_id", "class_id")
    return out.unionByName(told.where("root is null").select("doc_id", F.col("doc_id").alias("class_id")))


def survivors(documents: DataFrame) -> DataFrame:
    """The documents without their near copies: of each class the row of the least doc_id (then of the least text hash), once; every column stays.

    Rows without a text count as equal where their doc_id is; rows without a doc_id can't be told apart and stay.
    """
    told = _text_classes(documents).where("doc_id is not null")
    first = told.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("s.*")
    keys = first.unionByName(told.where("root is null").select("doc_id", "text_hash").distinct())
    again = told.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash")
    names = dict(zip(("doc_id", "text_hash"), ("own_id_", "own_hash_"), strict=True))
    while set(names.values()) & set(documents.columns):
        names = {k: v + "_" for k, v in names.items()}
    keys, again = (runtime.written(x.withColumnsRenamed(names), n) for x, n in ((keys, "first-rows"), (again, "repeated")))
    on = list(names.values())
    rows = documents.where("doc_id is not null").withColumns({on[0]: F.col("doc_id").cast("long"), on[1]: _text_hash("text")})
    kept = rows.join(keys.hint("shuffle_hash"), on, "left_semi")
    if again.limit(1).count():
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(on))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns]).unionByName(documents.where("doc_id is null"))
