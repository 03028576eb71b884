"""Embedding near-duplicates by product quantisation: coarse lists, residual codes, table-lookup distances, exact rerank.

Vectors of one label whose cosine is at least ``least`` (double precision) are linked. Vectors are scaled to length one,
where that cosine is a distance of ``radius = sqrt(2 - 2 * least)``. Each vector is kept in the list of its nearest coarse
centroid, as the product-quantised code of its residual together with the length of what the code misses. A vector looks into
its own list and into every list whose boundary is nearer than ``margin``: with ``margin = radius`` no link can be missed;
the default is ``radius * min(1, 4 / sqrt(dim))``, four times what a random displacement of that length moves towards one
boundary. Distances to codes come from per-query tables; a candidate is dropped only if its distance less the code's error
is above the radius, and the rest are compared exactly. Recall is measured against brute force in the tests.

Equal vectors of a label are one vector with a multiplicity, named by a row's number, so that a vec_id may repeat. Lists are dealt into blocks of bounded size, so that a hot
label, list or group of copies is spread over tasks; a task returns counts and a spanning forest, never the pairs.

Defined results: every row has a result. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label or
a vec_id, link with nothing (without a vec_id component_id and kept are null); vectors of different lengths are never linked; labels are
compared as text; a vec_id that comes again with the same vector and label counts once, and all its rows have that result; with another vector it is another
vector of that id; ties go to the smallest vec_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, has_rows, small_batches

LEAST = 0.98
#: Vectors that centroids and codebooks are fitted on, about; every vector is indexed.
SAMPLE = 20_000
SUBSPACES, CODES = 8, 128
MAX_LISTS = 4096
BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = ((c**2).sum(1) - 2 * x[a : a + 8192] @ c.T).argmin(1)
    return out


class Index:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, least: float, margin: float | None = None):
        self.least, self.radius = least, float(np.sqrt(max(0.0, 2 - 2 * least)))
        self.dim = sample.shape[1]
        self.margin = self.radius * min(1.0, 4.0 / np.sqrt(self.dim)) if margin is None else margin
        self.coarse = kmeans(sample, lists, 8, 1)
        self.between = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(-1), 1e-18)) if len(self.coarse) <= 256 else None
        parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.cuts = [(int(p[0]), int(p[-1]) + 1) for p in parts]
        small = sample[:: max(1, len(sample) // 8192)]
        residual = small - self.coarse[nearest(small, self.coarse)]
        self.books = [kmeans(residual[:, a:b], CODES, 6, 2 + k) for k, (a, b) in enumerate(self.cuts)]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home list, lists to look into as a boolean matrix)."""
        d = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        home = d.argmin(1)
        if self.between is not None:
            gap = self.between[home]
        else:
            sq = (self.coarse**2).sum(1)
            gap = np.sqrt(np.maximum(sq[home][:, None] + sq - 2 * self.coarse[home] @ self.coarse.T, 1e-18))
        probe = (d - d[np.arange(len(x)), home][:, None]) / (2 * gap) <= self.margin
        probe[np.arange(len(x)), home] = True
        return home, probe

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what the codes miss)."""
        r = x - self.coarse[home]
        codes = np.stack([nearest(r[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((r - back) ** 2).sum(1))

    def distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of one list, by table lookup."""
        r = queries - self.coarse[home]
        out = np.zeros((len(queries), len(codes)))
        for k, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            part = r[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def _vectors(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, blob) of each row: key and blob null for vectors that link with nothing; key: digest of label and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, keys, dims = [], [], []
            for vec, v, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v is not None else np.zeros(0)
                ok = vec is not None and label is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                blob = (x + 0.0).tobytes() if ok else None
                blobs.append(blob)
                dims.append(len(x))
                keys.append(hashlib.blake2b(label.encode() + b"\0" + blob, digest_size=16).digest() if ok else None)
            cols = [batch.column(0), batch.column(2), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "label", "dim", "key", "blob"])

    source = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return source.mapInArrow(run, "vec_id long, label string, dim int, key binary, blob binary")


def build(reps: DataFrame, dim: int, n: int, labels: int, least: float, sample: int, margin: float | None) -> Index:
    """Fit on about ``sample`` vectors chosen by a hash of themselves; lists grow with the root of a label's vectors."""
    rate = min(1.0, sample / max(n, 1))
    draw = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = reps.filter((F.col("dim") == dim) & (draw < rate)).select("key", "blob").collect() or reps.filter(F.col("dim") == dim).orderBy("key").select("key", "blob").take(1)
    x = _units(_vectors([bytes(r["blob"]) for r in sorted(rows, key=lambda r: r["key"])]))
    lists = int(np.clip(round(np.sqrt(n / max(labels, 1))), 8, MAX_LISTS))
    return Index(x, lists, least, margin)


ROW = "label string, dim int, list int, query boolean, rep long, times long, home int, blob binary, code binary, err double"


def indexed(reps: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """One row for each vector in its list, and one for each list that it looks into."""
    shared = reps.sparkSession.sparkContext.broadcast(indexes)
    names = [x.split(" ")[0] for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    index: Index = shared.value[int(dim)]
                    blob = part.column(4)
                    x = _units(_vectors(blob.to_pylist()))
                    home, probe = index.homes(x)
                    codes, err = index.encode(x, home)
                    row, list_ = np.nonzero(probe)
                    n, at = len(home), pa.array(np.r_[np.arange(len(home)), row])
                    is_query = np.r_[np.zeros(n, bool), np.ones(len(row), bool)]
                    where = np.r_[home, list_]
                    code = [c.tobytes() for c in codes] + [None] * len(row)
                    cols = [
                        part.column(1).take(at), part.column(2).take(at), pa.array(where.astype(np.int32)), pa.array(is_query), part.column(0).take(at),
                        part.column(3).take(at), pa.array(home.astype(np.int32)).take(at), blob.take(at), pa.array(code, pa.binary()), pa.array(np.r_[err, np.zeros(len(row))]),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return reps.select("rep", "label", "dim", "times", "blob").mapInArrow(run, ROW)


def search(rows: DataFrame, indexes: dict[int, Index], block: int = BLOCK) -> DataFrame:
    """(a, b, n): n links found for vector a (b null), or a link a-b of the spanning forest (n null)."""
    shared = rows.sparkSession.sparkContext.broadcast(indexes)
    keys = ["label", "dim", "list"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count_if(~F.col("query")) / block).cast("int").alias("nd"), F.ceil(F.count_if("query") / block).cast("int").alias("nq"))
    dealt = rows.join(sizes.filter("nd > 0 and nq > 0"), keys)
    other = F.when(F.col("query"), F.col("nd")).otherwise(F.col("nq"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nd"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    dealt = dealt.withColumn("db", F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))).withColumn("qb", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")))

    def one(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy(zero_copy_only=False)
        index: Index = shared.value[table.column("dim")[0].as_py()]
        q, d = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and d.num_rows:
            _compare(index, q, d, table.column("list")[0].as_py(), out)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int64())})

    return dealt.groupBy(*keys, "db", "qb").applyInArrow(one, "a long, b long, n long")


def _compare(index: Index, q: pa.Table, d: pa.Table, home: int, out: tuple[list, list, list]) -> None:
    qx, dx = _vectors(q.column("blob").to_pylist()), _vectors(d.column("blob").to_pylist())
    qu, du = _units(qx), _units(dx)
    codes = np.frombuffer(b"".join(d.column("code").to_pylist()), np.uint8).reshape(d.num_rows, -1)
    qid, did = q.column("rep").to_numpy(), d.column("rep").to_numpy()
    qn, dn = q.column("times").to_numpy(), d.column("times").to_numpy()
    near = index.distances(qu, home, codes) <= index.radius + d.column("err").to_numpy() + 1e-6
    near &= qid[:, None] != did
    i, j = np.nonzero(near)
    if not len(i):
        return
    dot = np.einsum("ij,ij->i", qx[i], dx[j])
    cosine = dot / (np.linalg.norm(qx, axis=1)[i] * np.linalg.norm(dx, axis=1)[j])
    odd = ~np.isfinite(cosine)
    cosine[odd] = np.einsum("ij,ij->i", qu[i[odd]], du[j[odd]])
    linked = cosine >= index.least
    i, j = i[linked], j[linked]
    if not len(i):
        return
    found = np.bincount(i, dn[j], len(qid)).astype(np.int64)
    # where the other vector doesn't look into this one's list, its link is counted here
    back = ~index.homes(du)[1][j, q.column("home").to_numpy()[i]]
    also = np.bincount(j[back], qn[i[back]], len(did)).astype(np.int64)
    for ids, n in ((qid, found), (did, also)):
        some = np.flatnonzero(n)
        out[0].extend(ids[some].tolist())
        out[1].extend([None] * len(some))
        out[2].extend(n[some].tolist())
    _, part = np.unique(np.r_[qid, did], return_inverse=True)
    head, tail = part[: len(qid)].copy(), part[len(qid) :].copy()
    first = np.r_[np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)]
    for a, b in zip(first[:-1], first[1:]):
        x, ys = i[a], j[a:b]
        for y in ys[tail[ys] != head[x]]:
            if tail[y] != head[x]:
                out[0].append(int(qid[x]))
                out[1].append(int(did[y]))
                out[2].append(None)
                old, new = tail[y], head[x]
                head[head == old] = new
                tail[tail == old] = new


def link(vectors: DataFrame, least: float = LEAST, sample: int = SAMPLE, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    own = cut(packed(vectors))
    once = own.filter("key is not null").dropDuplicates(["vec_id", "key"])
    reps = once.groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("times"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("blob").alias("blob"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    shape = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).collect()
    if not shape:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    indexes = {r["dim"]: build(reps, r["dim"], r["n"], r["labels"], least, sample, margin) for r in shape}
    rows = cut(indexed(reps, indexes))
    found = cut(search(rows, indexes))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    edges = found.filter("b is not null").select("a", "b")
    whole = reps.select("key", "rep", "low", "times").join(counts, F.col("rep") == F.col("a"), "left").drop("a")
    if has_rows(edges):
        whole = whole.join(components(edges), F.col("rep") == F.col("id"), "left").drop("id")
        lows = whole.filter("component is not null").groupBy("component").agg(F.min("low").alias("first"))
        whole = whole.join(lows, "component", "left").withColumn("component", F.coalesce("first", "low"))
    else:
        whole = whole.withColumn("component", F.col("low"))
    whole = whole.select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component")
    out = own.select("vec_id", "key").join(whole, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
