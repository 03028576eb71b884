"""MinHash near-duplicates by ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its shingles (five words in a row; weight: how often it occurs; a document of
fewer words is one shingle). Similarity is the probability Jaccard index
``sum over shared d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d])``, which is the plain Jaccard index
when no shingle repeats. ProbMinHash lets every shingle throw points of a Poisson process whose rate is its weight; a
point lands in one of ``slots`` registers, which keep the earliest point; a shingle stops as soon as its next
point is later than all registers (early termination).

Texts with the same words are one node from the start, so copies are never paired. Registers are read in bands; in
each bucket the members are first held against one pivot. Buckets that are then still in several components hold the
members of the smaller ones against all others: small buckets by pairs, large ones in blocks, without making the pairs; both
compare the same members. Every link is verified exactly. Nodes are numbered rows, not doc_ids, so a doc_id may repeat.

Defined results: every row gets a class. A null or empty text is in a class of its own, whose id is its doc_id; texts without words are in
one class if equal; a very long text is one set like any other; rows that repeat a doc_id are documents of their own, each in the class of its
text; a row without doc_id is in the class of its copies, or in one without an id; an empty table gives no rows; extra columns are
ignored by ``classes`` and kept by ``keep_first``. Of a class one row stays: that of the smallest doc_id (rows without one come last), among equal ids that of
the smallest hash of the text, among equal rows any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, has_rows, slices, small_batches, text_column
from ._text import Words, mix, words

WORDS, SIMILARITY = 5, 0.8
#: At 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
SALTS = 64
#: Buckets up to this size pair their members; larger ones are compared in blocks of so many rows or bytes of shingles, about.
SMALL_BUCKET, BLOCK_ROWS, BLOCK_BYTES = 48, 1024, 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xD6E8FEB86659FD93)


def shingles(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of each distinct shingle, by document, then hash."""
    count = w.counts()
    docs = np.flatnonzero(count > 0)
    if not len(docs):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z
    h, total = w.hash, len(w.hash)
    run = np.zeros(total, np.uint64)
    size = np.minimum(np.repeat(count, count), n)
    for k in range(n):
        part = np.zeros(total, np.uint64)
        part[: total - k] = h[k:]
        run = np.where(size > k, run * _MULT + part, run)
    run = mix(run + size.astype(np.uint64))
    number = np.maximum(count - n + 1, np.minimum(count, 1))
    doc, key, weight = [], [], []
    for d in docs:
        own = np.sort(run[w.first[d] : w.first[d] + number[d]])
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        key.append(own[new])
        weight.append(np.diff(np.r_[new, len(own)]))
        doc.append(np.full(len(new), d))
    return np.concatenate(doc), np.concatenate(key), np.concatenate(weight)


def signatures(n_docs: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """ProbMinHash registers: for each document and slot the shingle of the earliest point (0: no shingles)."""
    time = np.full(n_docs * slots, np.inf)
    kept = np.zeros(n_docs * slots, np.uint64)
    rate = weight.astype(np.float64)
    t = np.zeros(len(key))
    seed = key.copy()
    while len(key):
        seed = seed + _STEP
        r = mix(seed)
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = doc * slots + (mix(r ^ _MULT) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(time, slot, t)
        won = time[slot] == t
        kept[slot[won]] = key[won]
        live = t < time.reshape(n_docs, slots).max(1)[doc]
        doc, key, rate, t, seed = doc[live], key[live], rate[live], t[live], seed[live]
    return kept.reshape(n_docs, slots)


def similarity(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets; keys ascend."""
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    shared = kb[at] == ka
    n = int(shared.sum())
    if not n:
        return 0.0
    a, b = wa[shared].astype(np.float64), wb[at[shared]].astype(np.float64)
    only_a, only_b = float(wa.sum()) - a.sum(), float(wb.sum()) - b.sum()
    if (a == a[0]).all() and (b == b[0]).all():
        return n / (only_a / a[0] + only_b / b[0] + n)
    pairs, times = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
    return float(sum(k / (only_a / x + only_b / y + (times * np.maximum(pairs[:, 0] / x, pairs[:, 1] / y)).sum()) for (x, y), k in zip(pairs, times)))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text): ``own`` names the text among those of one doc_id."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")


def sketch(docs: DataFrame, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, own, digest of the words, band keys): one row for each of ``docs``; no digest for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = text_column(part)
                w = words(text)
                sig = signatures(len(text), *shingles(w, n), bands * rows).reshape(len(text), bands, rows)
                band = np.full((len(text), bands), np.arange(bands, dtype=np.uint64))
                for k in range(rows):
                    band = mix(band * _MULT + sig[:, :, k])
                band = band.astype(np.int64)
                digests = []
                for d in range(len(text)):
                    own = w.hash[w.first[d] : w.first[d + 1]]
                    raw = own.tobytes() if len(own) else b"\0" + text[d].as_py().encode()
                    digests.append(hashlib.blake2b(raw, digest_size=16).digest() if len(raw) > 1 else None)
                some = w.counts() > 0
                offsets = np.r_[0, np.cumsum(np.where(some, bands, 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), lists], names=["doc_id", "own", "digest", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, own long, digest binary, bands array<long>")


def shingle_sets(texts: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, keys, weights): the weighted shingle set of each text (id, text) as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, key, weight = shingles(words(text_column(part)), n)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keys = [key[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                weights = [b"" if (weight[a:b] == 1).all() else weight[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(weights, pa.binary())], names=["id", "keys", "weights"])

    return texts.select("id", "text").mapInArrow(run, "id long, keys binary, weights binary")


def _unpack(k: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(k, np.uint64)
    return key, np.frombuffer(w, np.uint32) if w else np.ones(len(key), np.uint32)


def verify(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("keys").alias(f"k{c}"), F.col("weights").alias(f"w{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "wa", "kb", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in range(2, 6)]
            keep = []
            for row in zip(*cols):
                ka, wa, kb, wb = (x.as_py() for x in row)
                a, b = _unpack(ka, wa), _unpack(kb, wb)
                keep.append(similarity(*a, *b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return small_batches(full).mapInArrow(run, "a long, b long")


def ids_are_plain(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return not has_rows(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null"))


def classes(docs: DataFrame, least: float = SIMILARITY, n: int = WORDS, bands: int = BANDS, rows: int = ROWS, plain: bool | None = None) -> DataFrame:
    """(doc_id, own, class_id, kept), one row for each of ``docs``: class_id is the smallest doc_id that links of similarity ``least`` reach, ``kept`` holds for one row of a class.

    ``plain``: that every row has a doc_id of its own, if that is known.
    """
    plain = ids_are_plain(docs) if plain is None else plain
    sketched = cut(sketch(docs, n, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    nodes = sketched.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"))
    own = sketched.join(nodes.select(F.col("rep").alias("row")), "row")
    banded = own.select(F.col("row").alias("rep"), F.explode("bands").alias("band")).dropDuplicates(["band", "rep"])
    buckets = banded.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top")).filter("pivot <> top").drop("top")
    members = cut(banded.join(buckets, "band").select("band", "rep", "pivot"))
    wanted = members.select(F.col("rep").alias("row")).distinct().join(sketched.select("row", "doc_id", "own"), "row")
    wanted = wanted.select(F.col("row").alias("id"), F.col("doc_id").alias("__id"), F.col("own").alias("__own"))
    sets = shingle_sets(_texts(docs).join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__own"))), n)
    sets = cut(sets if plain else sets.groupBy("id").agg(F.max(F.struct("keys", "weights")).alias("s")).select("id", "s.*"))

    star = members.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = star.groupBy("rep").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    comp = _join_up(None, verify(best.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), sets, least))
    open_ = _open(members, comp)
    pairs = _apart(star.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), comp).unionByName(_pairs(open_))
    links = verify(pairs.distinct(), sets, least)
    large = open_.filter(f"n > {SMALL_BUCKET}")
    if has_rows(large):
        links = links.unionByName(_in_blocks(large, sets, least))
    comp = _join_up(comp, links)
    if comp is None:
        found = nodes.select("digest", F.col("rep").alias("class"), F.col("low").alias("class_id"))
    else:
        linked = nodes.join(comp, F.col("rep") == F.col("id"), "left").select("digest", "rep", "low", "component")
        lows = linked.filter("component is not null").groupBy("component").agg(F.min("low").alias("least_id"))
        found = linked.join(lows, "component", "left").select("digest", F.coalesce("component", "rep").alias("class"), F.coalesce("least_id", "low").alias("class_id"))
    out = sketched.select("row", "doc_id", "own", "digest").join(found, "digest", "left")
    out = out.withColumn("class_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))
    if plain:
        return out.select("doc_id", "own", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    first = out.filter("digest is not null and doc_id <=> class_id").groupBy("class").agg(F.min(F.struct("own", "row")).alias("first"))
    out = out.join(first.select(F.col("first.row").alias("first")), F.col("row") == F.col("first"), "left")
    return out.select("doc_id", "own", "class_id", (F.col("digest").isNull() | F.col("first").isNotNull()).alias("kept"))


def _join_up(comp: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components so far, with more links."""
    links = cut(links)
    if not has_rows(links):
        return comp
    if comp is not None:
        links = links.unionByName(comp.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    return components(links)


def _with_component(members: DataFrame, comp: DataFrame | None, col: str) -> DataFrame:
    if comp is None:
        return members.withColumn(f"{col}_comp", F.col(col))
    c = comp.select(F.col("id").alias(col), F.col("component").alias("__c"))
    return members.join(c, col, "left").withColumn(f"{col}_comp", F.coalesce("__c", col)).drop("__c")


def _apart(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs of different components."""
    both = _with_component(_with_component(pairs, comp, "a"), comp, "b")
    return both.filter("a_comp <> b_comp").select("a", "b")


def _open(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(band, rep, rep_comp, main, n) of the buckets that are still in several components; ``main`` is the largest of these, n the bucket's size.

    The pivot has met all members, so it is left out.
    """
    known = _with_component(members, comp, "rep")
    size = known.groupBy("band", "rep_comp").agg(F.count(F.lit(1)).alias("n"))
    main = size.groupBy("band").agg(F.max_by("rep_comp", F.struct("n", "rep_comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"))
    return cut(known.join(main.filter("comps > 1"), "band").select("band", "rep", "pivot", "rep_comp", "main", "n")).filter("rep <> pivot")


def _pairs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in small buckets; members of the main component meet only others."""
    small = open_.filter(f"n <= {SMALL_BUCKET}")
    left = small.filter("rep_comp <> main").select("band", F.col("rep").alias("a"), F.col("rep_comp").alias("a_comp"))
    right = small.select("band", F.col("rep").alias("b"), F.col("rep_comp").alias("b_comp"), "main")
    pairs = left.join(right, "band").filter("a_comp <> b_comp and (b_comp = main or a < b)")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _in_blocks(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join all components which links within large buckets join.

    Members outside the main component (the left side) meet all members (the right side). Each side is dealt into blocks of bounded size;
    a left and a right block are one task, which counts shared shingles by an inverted index and returns a spanning forest. So neither
    the pairs nor a bucket ever stand in one place, and a bucket whose left side is one block sends its right side once. Buckets of equal members are one.
    """
    key = open_.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("rep"), 40)).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"))
    once = key.groupBy("n", "s", "x").agg(F.min("band").alias("band")).select("band")
    here = open_.join(once, "band").join(sets.select("id", "keys", "weights"), F.col("rep") == F.col("id")).drop("id")
    both = here.select("*", F.explode(F.when(F.col("rep_comp") == F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("left"))
    sized = lambda left: F.greatest(F.lit(1), F.ceil(F.count_if(left) / BLOCK_ROWS), F.ceil(F.sum(F.when(left, F.length("keys"))) / BLOCK_BYTES)).cast("int")
    blocks = both.groupBy("band").agg(sized(F.col("left")).alias("nl"), sized(~F.col("left")).alias("nr"))
    # a bucket's rows are in one task nowhere
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = both.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(SALTS)).cast("int")).join(salted, ["band", "salt"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("left"), F.col("nl")).otherwise(F.col("nr"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("nr")).otherwise(F.col("nl")) - 1)))
    i, j = F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(F.col("own"))
    dealt = dealt.select("band", i.alias("i"), j.alias("j"), "left", "rep", "rep_comp", "keys", "weights")

    def one(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        rep, tag = table.column("rep").to_numpy(), table.column("rep_comp").to_numpy()
        held = [_unpack(k.as_py(), w.as_py()) for k, w in zip(table.column("keys"), table.column("weights"))]
        links = _forest(np.flatnonzero(left), np.flatnonzero(~left), rep, tag, held, least)
        return pa.table({"a": pa.array([int(rep[x]) for x, _ in links], pa.int64()), "b": pa.array([int(rep[y]) for _, y in links], pa.int64())})

    return dealt.groupBy("band", "i", "j").applyInArrow(one, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, rep: np.ndarray, tag: np.ndarray, held: list, least: float) -> list[tuple[int, int]]:
    """Links between rows of a and rows of b that join components (tags) not joined yet."""
    links: list[tuple[int, int]] = []
    if not len(a) or not len(b):
        return links
    _, part = np.unique(tag, return_inverse=True)
    part = part.copy()
    key = np.concatenate([held[y][0] for y in b])
    weight = np.concatenate([held[y][1] / held[y][1].sum() if len(held[y][1]) else held[y][1] for y in b])
    owner = np.repeat(np.arange(len(b)), [len(held[y][0]) for y in b])
    order = np.argsort(key, kind="stable")
    key, weight, owner = key[order], weight[order], owner[order]
    size = np.array([len(held[y][0]) for y in b])
    unit = np.array([(held[y][1] == 1).all() for y in b])
    for x in a:
        if (part[b] == part[x]).all():
            continue
        kx, wx = held[x]
        lo, hi = np.searchsorted(key, kx, "left"), np.searchsorted(key, kx, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        who = owner[at]
        if (wx == 1).all():
            shared = np.bincount(who, minlength=len(b))
            value = np.where(unit, shared / np.maximum(len(kx) + size - shared, 1), 2.0)
        else:
            value = np.full(len(b), 2.0)
        mixed = np.flatnonzero(value > 1.5)
        if len(mixed):  # the overlap of the normalised weights bounds the index from above
            bound = np.bincount(who, np.minimum(np.repeat(wx / wx.sum(), n), weight[at]), len(b))
            value[mixed] = 0.0
            for k in mixed[bound[mixed] >= least - 1e-9]:
                value[k] = similarity(kx, wx, *held[b[k]])
        for k in np.flatnonzero(value >= least):
            if part[b[k]] != part[x]:
                links.append((x, b[k]))
                part[part == part[b[k]]] = part[x]
    return links


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are their class's first, all columns."""
    plain = ids_are_plain(docs)
    found = classes(docs, least, plain=plain)
    if plain:
        drop = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__copy"))
        return docs.join(drop.hint("shuffle_hash"), F.col("doc_id") == F.col("__copy"), "left_anti")
    # rows are told apart by id and text; of equal rows one stays
    found = cut(found)
    names = [F.col("doc_id").alias("__id"), F.col("own").alias("__own")]
    some = found.groupBy("doc_id", "own").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n"))
    gone = some.filter("k = 0").select(*names)
    twice = some.filter("k > 0 and n > k").select(*names)
    rows = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__own"))
    single = rows.join(gone.unionByName(twice).hint("shuffle_hash"), same, "left_anti")
    first = rows.join(twice.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "__text"])
    return single.unionByName(first).drop("__text")
