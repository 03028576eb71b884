"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily with the largest unpacked piece that still fits. When nothing fits into what is
left, the bin's smallest piece is replaced by two unpacked pieces that fit its expanded gap (the gap plus
that piece) more tightly, and the greedy fill goes on.

Only lengths matter, so the plan is made on the histogram of lengths (at most ``size`` entries, whatever
the input): a bin's *pattern* is repeated as often as the histogram bears it. Pieces of one length are
interchangeable; each gets a rank among its length from per-partition counts, and ranks map to bins and
offsets by arithmetic on the plan. No text and no list of documents ever comes to the driver, and no task
holds more than its own pieces.

Defined results: a null or empty text is the end token alone; equal lengths are dealt by partition order; a very long text, or one very long
word, is tokenised whole; repeated rows are packed each; an empty table gives no rows; a row without doc_id is
packed under a null one; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SLICE_BYTES, cut, slices, small_batches, text_column

SIZE, END_ID = 4096, 1
#: Words and bytes in the newer of two caches, about; as many may be in the older one. Longer words than ``CACHE_LONGEST`` characters are not kept.
CACHE_WORDS, CACHE_BYTES, CACHE_LONGEST = 200_000, 32 << 20, 256
#: Words of printable Latin-1 letters.
_PLAIN = "^[!-~\u00a1-\u00ff]+$"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts as the tokenizer gives them, one word at a time from bounded caches.

    Holds for BPE tokenizers that lower-case, split by a pattern that never matches white space and map
    bytes to characters: a text's ids are then those of its words. Words of printable Latin-1 letters
    (lower-casing and NFC are context-free there) are split here and only their unseen pre-tokens go to the BPE
    model; any other word, and texts that hold a special token's string, go through the tokenizer whole.
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(json_text)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        spec = json.loads(json_text)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        ours = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.pattern = regex.compile(f"(?:{steps[0]['pattern']['Regex']})| ") if ours else None
        self.byte_char = {b: chr(c) for b, c in _byte_chars().items()}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, bytes] = {"": b""}
        self.pre: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pre: dict[str, bytes] = {}
        self.word_bytes = self.pre_bytes = 0

    def turn(self) -> None:
        """Full caches become the old ones, from which words that come again are taken back."""
        if len(self.words) > CACHE_WORDS or self.word_bytes > CACHE_BYTES:
            self.old_words, self.words, self.word_bytes = self.words, {"": b""}, 0
        if len(self.pre) > CACHE_WORDS or self.pre_bytes > CACHE_BYTES:
            self.old_pre, self.pre, self.pre_bytes = self.pre, {}, 0

    def pre_token(self, p: str) -> bytes:
        ids = self.old_pre.get(p)
        if ids is None:
            own = p if p.isascii() else "".join([self.byte_char[b] for b in p.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(own)]).tobytes()
        if len(p) <= CACHE_LONGEST:
            self.pre[p] = ids
            self.pre_bytes += 100 + 5 * len(p)
        return ids

    def learn(self, new: list[str]) -> None:
        """Ids of words that aren't in the newer cache. Plain words are split as one text, in which a space ends each."""
        words, old = self.words, self.old_words.get
        unseen = []
        for w in new:
            if (ids := old(w)) is not None:
                words[w] = ids
            else:
                unseen.append(w)
        odd = unseen
        if self.pattern and unseen:
            plain = pc.match_substring_regex(pa.array(unseen, pa.string()), _PLAIN).to_pylist()
            odd = [w for w, ok in zip(unseen, plain) if not ok]
            self.split([w for w, ok in zip(unseen, plain) if ok])
        for k in range(0, len(odd), 20_000):
            part = odd[k : k + 20_000]
            for w, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False)):
                words[w] = np.array(e.ids, np.uint32).tobytes()

    def split(self, plain: list[str]) -> None:
        words, pre, unseen = self.words, self.pre.get, self.pre_token
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            each, ids = iter(part), b""
            for p in self.pattern.findall(" ".join([*part, ""]).lower()):
                if p == " ":
                    words[next(each)] = ids
                    ids = b""
                else:
                    own = pre(p) or unseen(p)
                    ids = ids + own if ids else own

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Words are told apart by Arrow, so that Python meets each once, and ids are gathered as arrays."""
        self.turn()
        lists = pc.split_pattern(pc.replace_substring(col, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        found = list(map(self.words.get, own))
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            fresh = [own[k] for k in new]
            self.learn(fresh)
            for k, w in zip(new, fresh):
                found[k] = self.words[w]
            kept = [n for n in map(len, fresh) if n <= CACHE_LONGEST]
            self.word_bytes += 100 * len(kept) + 5 * sum(kept)
            if len(kept) < len(fresh):
                for w in fresh:
                    if len(w) > CACHE_LONGEST:
                        del self.words[w]
        pool = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        n = size[codes]
        upto = np.r_[0, np.cumsum(n)]
        kind = np.int32 if upto[-1] < 1 << 31 else np.int64
        ids = pool[np.repeat((start[codes] - upto[:-1]).astype(kind), n) + np.arange(upto[-1], dtype=kind)]
        edge = lists.offsets.to_numpy()
        edge = upto[edge - edge[0]]
        out = [ids[i:j] for i, j in zip(edge[:-1], edge[1:])]
        for special in self.special:
            for k in np.flatnonzero(pc.match_substring(col, special).to_numpy(zero_copy_only=False)):
                out[k] = np.array(self.whole.encode(col[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def _byte_chars() -> dict[int, int]:
    """Byte-level BPE's characters: printable Latin-1 bytes stand for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


_kept: dict[int, WordTokenizer] = {}


def tokenizer_for(json_text: str) -> WordTokenizer:
    """One tokenizer a Python worker, so that its caches outlive a task."""
    k = zlib.crc32(json_text.encode())
    if k not in _kept:
        _kept.clear()
        _kept[k] = WordTokenizer(json_text)
    return _kept[k]


def pieces(docs: DataFrame, tokenizer_json: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(spec.value)
        for batch in batches:
            for part in slices(batch, limit=4 * SLICE_BYTES):
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(text_column(part))):
                    ids = ids.tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths of one bin): best-two-fit on a histogram of lengths; every length is used up exactly."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    while count.any():
        live = np.flatnonzero(count)
        largest = np.zeros(size + 1, np.int64)  # largest live length at most i
        largest[live] = live
        largest = np.maximum.accumulate(largest)
        use: dict[int, int] = {}

        def left(length: int) -> int:
            return int(count[length]) - use.get(length, 0)

        def fitting(gap: int) -> int:
            length = int(largest[gap]) if gap > 0 else 0
            while length and left(length) <= 0:
                length = int(largest[length - 1])
            return length

        gap, own = size, []
        while True:
            while length := fitting(gap):
                own.append(length)
                use[length] = use.get(length, 0) + 1
                gap -= length
            if not gap or len(own) < 2:
                break
            small = min(own)
            best = _two(live, left, fitting, small, small + gap)
            if best is None:
                break
            own.remove(small)
            use[small] -= 1
            for length in best:
                own.append(length)
                use[length] = use.get(length, 0) + 1
            gap += small - sum(best)
        times = min(int(count[k]) // n for k, n in use.items() if n)
        for k, n in use.items():
            count[k] -= n * times
        out.append((times, tuple(sorted(own, reverse=True))))
    return out


def _two(live: np.ndarray, left, fitting, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is above ``small`` and as near to ``room`` as can be."""
    best, top = None, small
    for a in live[(live <= room - 1) & (live * 2 >= small)][::-1]:
        a = int(a)
        if a + min(a, room - a) <= top:
            break
        if left(a) <= 0:
            continue
        b = fitting(min(a, room - a))
        if b == a and left(a) < 2:
            b = fitting(b - 1)
        if b and a + b > top:
            best, top = (a, b), a + b
            if top == room:
                break
    return best


def place(plan_: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """Runs of ranks: pieces of ``length`` ranked from..to go to bins first, first+1, ... at ``offset``."""
    rows, used, first = [], {}, 0
    for times, lengths in plan_:
        at = 0
        for length in lengths:
            r = used.get(length, 0)
            rows.append((length, r, r + times, first, at))
            used[length] = r + times
            at += length
        first += times
    return pd.DataFrame(rows, columns=["length", "from", "to", "first", "offset"])


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (with column length).

    A piece's rank among its length is its place in its partition plus the pieces of that length in the partitions before.
    Only the histogram of lengths, at most ``size`` numbers, comes to the driver.
    """
    spark = cut_pieces.sparkSession
    held = cut(cut_pieces.withColumn("__part", F.spark_partition_id()))
    per_part = held.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part")
    base = per_part.select("__part", "length", (F.sum("__n").over(before) - F.col("__n")).alias("__base"))
    hist = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = place(plan(hist, size)).sort_values(["length", "from"])
    shared = spark.sparkContext.broadcast({int(k): g[["from", "first", "offset"]].to_numpy(np.int64) for k, g in runs.groupby("length")})
    names = [c for c in cut_pieces.columns]
    at_length = names.index("length")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            own = length[order]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(own)])
            place_ = np.empty(len(own), np.int64)
            place_[order] = np.arange(len(own)) - np.repeat(first, n) + seen[own]
            seen[own[first]] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place_)], names=[*names, "__part", "__place"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, order = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at_length, len(names)))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                table = shared.value[int(n)]
                at = np.searchsorted(table[:, 0], order[own], side="right") - 1
                seq[own] = table[at, 1] + order[own] - table[at, 0]
                off[own] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    more = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    ranked = held.mapInArrow(rank, T.StructType([*held.schema.fields, T.StructField("__place", T.LongType())]))
    ranked = ranked.join(base, ["__part", "length"]).select(*names, (F.col("__base") + F.col("__place")).alias("__rank"))
    return ranked.mapInArrow(put, T.StructType([*cut_pieces.schema.fields, *more]))


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, read_tokenizer(tokenizer_path), size, end_id), size)


def brute(lengths: list[int], size: int) -> int:
    """Bins that first-fit decreasing needs: a yardstick for tests."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        for k, g in enumerate(gaps):
            if g >= n:
                gaps[k] -= n
                break
        else:
            gaps.append(size - n)
    return len(gaps)
