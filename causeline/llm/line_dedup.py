"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

Every line of at least ``min_chars`` code points (stripped of ASCII white space, A-Z folded) has a
16-byte key. The *postings* hold each (key, document) once, the *counts* hold per key the exact number of
documents and the largest document id (the keeper). Keys are dealt over hash shards; each shard has a
cuckoo filter of the keys whose count reached ``min_docs``. A scan probes the filter of a line's shard, so
only lines that are (nearly surely) common travel to the exact tables, which alone decide. Filters that are small in all are sent to
every task; beyond that each shard's lines are brought to its filter.

Deleting documents removes their postings, lowers the counts and deletes the keys that fell below the
bound from the filters, so what an insertion caused can be undone (``LineIndex``).

Defined results: a null or empty text is one empty line and loses nothing; repeated rows of one doc_id
count as one document, whose texts all lose what one of them would; columns other than ``doc_id`` and ``text`` pass through untouched
in ``dedup``. A null doc_id is no document: its row is kept, unchanged, and counts nowhere. Of documents that tie for a line the largest
doc_id keeps it, in all its places. A very long text is split whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import children, cut, ids_repeat, small_batches, written

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
KEYS_PER_SHARD = 100_000
MIN_SHARDS = 64
#: Filters are sent to every executor only up to this size in all; beyond it lines are brought to their shard's filter.
FILTER_BROADCAST_BYTES = 32 << 20
#: Tasks that one shard's lines are dealt to there.
SALTS = 64


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of a line, None if it is too short to count."""
    k = line.strip(BLANKS)
    if len(k) < min_chars or (not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(k.lower(), digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's two buckets differ by a hash of its fingerprint."""

    SLOTS, LOAD = 4, 0.85

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        n = 1
        while n * self.SLOTS * self.LOAD < max(capacity, 4):
            n *= 2
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1
        self.spill: Counter[tuple[int, int]] = Counter()  # with multiplicity, as the slots

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        n, extra = np.frombuffer(blob[:16], np.int64)
        table = np.frombuffer(blob[16 : 16 + n * cls.SLOTS * 2], np.uint16).reshape(n, cls.SLOTS).copy()
        out = cls(0, table)
        rest = np.frombuffer(blob[16 + n * cls.SLOTS * 2 :], np.int64).reshape(extra, 2)
        out.spill = Counter((int(a), int(b)) for a, b in rest)
        return out

    def dump(self) -> bytes:
        rest = np.array(sorted(self.spill.elements()), np.int64).reshape(-1, 2)
        return np.array([len(self.table), len(rest)], np.int64).tobytes() + self.table.tobytes() + rest.tobytes()

    def place(self, key: bytes) -> tuple[int, int, int]:
        a = int.from_bytes(key[:8], "little")
        f = (int.from_bytes(key[8:10], "little") or 1) & 0xFFFF
        i = (a >> 8) & self.mask
        return f, i, self.other(i, f)

    def other(self, i: int, f: int) -> int:
        return (i ^ ((f * 0x5BD1E995) >> 7)) & self.mask

    def add(self, key: bytes) -> None:
        f, i, j = self.place(key)
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return
        b = i
        for kick in range(500):
            slot = (kick + f) % self.SLOTS
            f, self.table[b, slot] = int(self.table[b, slot]), f
            b = self.other(b, f)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = f
                return
        self.spill[min(b, self.other(b, f)), f] += 1

    def __contains__(self, key: bytes) -> bool:
        f, i, j = self.place(key)
        t = self.table
        return f in t[i] or f in t[j] or (bool(self.spill) and (min(i, j), f) in self.spill)

    def remove(self, key: bytes) -> bool:
        f, i, j = self.place(key)
        for b in (i, j):
            at = np.flatnonzero(self.table[b] == f)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        if (min(i, j), f) in self.spill:
            self.spill[min(i, j), f] -= 1
            if not self.spill[min(i, j), f]:
                del self.spill[min(i, j), f]
            return True
        return False

    def hits(self, keys: list[bytes]) -> np.ndarray:
        """Vectorised membership of many keys."""
        if not keys:
            return np.zeros(0, bool)
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
        a = raw[:, :8].copy().view("<u8")[:, 0]
        f = raw[:, 8:10].copy().view("<u2")[:, 0].astype(np.int64)
        f[f == 0] = 1
        i = ((a >> np.uint64(8)) & np.uint64(self.mask)).astype(np.int64)
        j = (i ^ ((f * 0x5BD1E995) >> 7)) & self.mask
        found = (self.table[i] == f[:, None]).any(1) | (self.table[j] == f[:, None]).any(1)
        for k in np.flatnonzero(~found) if self.spill else ():
            found[k] = (int(min(i[k], j[k])), int(f[k])) in self.spill
        return found


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[10:14], "little") % shards


def postings(docs: DataFrame, min_chars: int = MIN_CHARS, filters=None, shards: int = MIN_SHARDS) -> DataFrame:
    """(key, doc_id), each once per document row. With ``filters`` (a broadcast of shard -> bytes) only keys they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.load(b) for s, b in filters.value.items()} if filters is not None else None
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = text.as_py()
                if doc is None or not raw:
                    continue
                own = {k for line in raw.split(b"\n") if len(line) >= min_chars and (k := line_key(line, min_chars))}
                keys.extend(own)
                ids.extend([doc] * len(own))
            if held is not None and keys:
                own_shard = np.array([shard_of(k, shards) for k in keys])
                keep = np.zeros(len(keys), bool)
                for s in np.unique(own_shard):
                    if s in held:
                        at = np.flatnonzero(own_shard == s)
                        keep[at] = held[s].hits([keys[k] for k in at])
                at = np.flatnonzero(keep)
                ids, keys = [ids[k] for k in at], [keys[k] for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key binary, doc_id long")


def reference_counts(posted: DataFrame) -> DataFrame:
    """Exact table: key, refs (documents that hold it), keeper (largest of them)."""
    return posted.groupBy("key").agg(F.count("doc_id").alias("refs"), F.max("doc_id").alias("keeper"))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """One cuckoo filter a shard: (shard, blob, keys)."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter(len(group))
        for k in group["key"]:
            f.add(bytes(k))
        k0 = bytes(group["key"].iloc[0])
        return pd.DataFrame({"shard": [shard_of(k0, shards)], "blob": [f.dump()], "keys": [len(group)]})

    return keys.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(one, "shard int, blob binary, keys long")


def _shard(shards: int):
    b = [F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("long") for i in (11, 12, 13, 14)]
    return ((b[0] + b[1] * 256 + b[2] * 65536 + b[3] * 16777216) % shards).cast("int")


def probe(posted: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The postings that the filter of their shard may hold, without sending all filters anywhere.

    Each filter goes ahead of its shard's postings in a sorted stream, so a task holds one filter at a time.
    """
    ahead = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("blob").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    behind = posted.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edge = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1 if len(group) else []
            for a, b in zip([0, *edge], [*edge, len(group)]):
                if a == b:
                    continue
                shard, salt, kind = group[a]
                if kind == 0:
                    held, of = CuckooFilter.load(batch.column(3)[int(a)].as_py()), (shard, salt)
                elif of == (shard, salt):
                    own = batch.slice(a, b - a).select(["key", "doc_id"])
                    yield own.filter(pa.array(held.hits(own.column(0).to_pylist())))

    both = ahead.unionByName(behind).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, "key binary, doc_id long")


def probed(docs: DataFrame, filters: DataFrame, size: int, min_chars: int, shards: int) -> DataFrame:
    """Postings of ``docs`` that the filters, ``size`` bytes in all, may hold."""
    if size > FILTER_BROADCAST_BYTES:
        return probe(postings(docs, min_chars), filters, shards)
    blobs = filters.collect()  # at most FILTER_BROADCAST_BYTES, and one job builds all shards side by side
    held = docs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in blobs})
    return postings(docs, min_chars, held, shards)


def shard_count(n_keys: int) -> int:
    return max(MIN_SHARDS, -(-n_keys // KEYS_PER_SHARD))


def _one_row_each(docs: DataFrame) -> DataFrame:
    return docs.groupBy("key", "doc_id").agg(F.lit(1).alias("x")).drop("x")


def find_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, keys): the line keys that each document loses."""
    posted = postings(docs, min_chars)
    if ids_repeat(docs):
        posted = _one_row_each(posted)
    common = cut(reference_counts(posted).filter(F.col("refs") >= min_docs))
    n = common.count()
    shards = shard_count(n)
    again = probed(docs, build_filters(common, shards), n * 6, min_chars, shards)  # 16 bits a slot, at most half of the slots free, and headers
    lost = again.join(common.drop("refs"), "key").filter(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("__drop_keys"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten; with ``counts`` also ``n_lines`` and ``n_dropped`` (long), in place of columns so named."""
    lost = find_drops(docs, min_chars, min_docs).withColumnRenamed("doc_id", "__lost_id")
    both = docs.join(lost.hint("shuffle_hash"), F.col("doc_id") == F.col("__lost_id"), "left").drop("__lost_id")
    return rewrite(both, min_chars, counts)


def rewrite(both: DataFrame, min_chars: int, counts: bool = True) -> DataFrame:
    """Drop from each text the lines whose key is in ``__drop_keys``."""
    more = ["n_lines", "n_dropped"] if counts else []
    both = both.drop(*more)
    names = [c for c in both.columns if c != "__drop_keys"]
    schema = T.StructType([*both.select(*names).schema.fields, *(T.StructField(c, T.LongType()) for c in more)])
    order = both.columns
    at = order.index("text")
    key_at = both.columns.index("__drop_keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            out, total, gone = [], [], []
            for raw, keys in zip(text.cast(pa.binary()).to_pylist(), batch.column(key_at).to_pylist()):
                total.append(1 if not raw else raw.count(b"\n") + 1)
                n = 0
                if keys and raw:
                    bad = set(keys)
                    kept = []
                    for line in raw.split(b"\n"):
                        if len(line) >= min_chars and line_key(line, min_chars) in bad:
                            n += 1
                        else:
                            kept.append(line)
                    raw = b"\n".join(kept)
                out.append(raw)
                gone.append(n)
            cols = [batch.column(k) for k, c in enumerate(order) if c != "__drop_keys"]
            cols[names.index("text")] = pa.array(out, pa.binary()).cast(text.type)
            cols += [pa.array(total, pa.int64()), pa.array(gone, pa.int64())][: len(more)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *more])

    return small_batches(both).mapInArrow(run, schema)


class LineIndex:
    """The index kept between batches and sessions, as Parquet under ``path`` (a shared folder): postings, counts and filters.

    ``insert`` and ``delete`` write a new generation and read only the last one, so an interrupted call leaves
    the old generation whole; a generation counts once its ``state``, written last, is there. Opening a path again goes on
    from its last generation, and only with the settings it was made with. One writer at a time. Inserting a document again replaces its postings.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = MIN_SHARDS):
        self.spark, self.path, self.min_chars, self.min_docs, self.shards = spark, path, min_chars, min_docs, shards
        if self.generation:
            made = tuple(self.table("state").first())
            if made != (min_chars, min_docs, shards):
                raise ValueError(f"the index at {path} was made with min_chars, min_docs, shards = {made}")

    @property
    def generation(self) -> int:
        """Number of the last generation that was written in full, 0 if there is none."""
        for n in sorted((int(n) for n in children(self.spark, self.path) if n.isdigit()), reverse=True):
            if written(self.spark, f"{self.path}/{n}/state"):
                return n
        return 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.generation}/{name}")

    def _write(self, posted: DataFrame) -> None:
        old = self.generation
        new = f"{self.path}/{old + 1}"
        posted.write.mode("overwrite").parquet(f"{new}/postings")
        posted = self.spark.read.parquet(f"{new}/postings")
        reference_counts(posted).write.mode("overwrite").parquet(f"{new}/counts")
        now = self.spark.read.parquet(f"{new}/counts").filter(F.col("refs") >= self.min_docs).select("key")
        if old:
            before = self.table("counts").filter(F.col("refs") >= self.min_docs).select("key")
            change = now.join(before, "key", "left_anti").withColumn("sign", F.lit(1)).unionByName(before.join(now, "key", "left_anti").withColumn("sign", F.lit(-1)))
            filters = self._patched(self.table("filters"), change, now)
        else:
            filters = build_filters(now, self.shards)
        filters.write.mode("overwrite").parquet(f"{new}/filters")
        state = self.spark.createDataFrame([(self.min_chars, self.min_docs, self.shards)], "min_chars int, min_docs int, shards int")
        state.coalesce(1).write.mode("overwrite").parquet(f"{new}/state")

    def _patched(self, filters: DataFrame, change: DataFrame, now: DataFrame) -> DataFrame:
        """Add and delete the changed keys in each shard's filter; a filter that would get more keys than it has room for is made anew from its keys ``now``."""
        shards = self.shards
        change = change.withColumn("shard", _shard(shards))
        more = change.groupBy("shard").agg(F.sum("sign").alias("more"))
        sizes = filters.join(more, "shard", "left").select("shard", (F.col("keys") + F.coalesce("more", F.lit(0))).alias("keys"), F.substring("blob", 1, 8).alias("head")).collect()
        full = [r["shard"] for r in sizes if r["keys"] > int.from_bytes(r["head"], "little") * CuckooFilter.SLOTS * CuckooFilter.LOAD]

        def one(key, held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            keys = int(held["keys"].iloc[0]) if len(held) else 0
            f = CuckooFilter.load(bytes(held["blob"].iloc[0])) if len(held) else CuckooFilter(len(moved))
            for k, sign in sorted(zip(moved["key"], moved["sign"]), key=lambda x: x[1]):
                f.add(bytes(k)) if sign > 0 else f.remove(bytes(k))
                keys += sign
            return pd.DataFrame({"shard": [key[0]], "blob": [f.dump()], "keys": [keys]})

        kept, moved = (df.filter(~F.col("shard").isin(full)) for df in (filters, change))
        out = kept.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(one, "shard int, blob binary, keys long")
        return out.unionByName(build_filters(now.filter(_shard(shards).isin(full)), shards)) if full else out

    def insert(self, docs: DataFrame) -> None:
        new = _one_row_each(postings(docs, self.min_chars))
        if self.generation:
            new = self.table("postings").join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti").select("key", "doc_id").unionByName(new)
        self._write(new)

    def delete(self, doc_ids: DataFrame) -> None:
        self._write(self.table("postings").join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti").select("key", "doc_id"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """``docs`` (documents of the index) as they stand now, by the index's filters and counts."""
        common = self.table("counts").filter(F.col("refs") >= self.min_docs).select("key", "keeper")
        filters = self.table("filters")
        size = filters.agg(F.sum(F.length("blob"))).first()[0] or 0
        lost = probed(docs, filters, size, self.min_chars, self.shards).join(common, "key").filter(F.col("doc_id") < F.col("keeper"))
        lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("__drop_keys")).withColumnRenamed("doc_id", "__lost_id")
        both = docs.join(lost.hint("shuffle_hash"), F.col("doc_id") == F.col("__lost_id"), "left").drop("__lost_id")
        return rewrite(both, self.min_chars)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
