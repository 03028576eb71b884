"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised to words: A-Z lower-cased, runs of digits, letters a-z and code points from U+0080
on. An item's windows are its runs of ``window`` words (one shorter window for a shorter item). The automaton
reads sequences of word numbers, so a document is scanned once, and a match ends at a word whose byte
offsets in the original text are known. Stretches that hold a word of no item are skipped: no window spans them.

The items are read in blocks whose automaton has a bounded number of nodes; one block is the rule, more
blocks mean more scans, whose hits are united by row before anything is counted; rows are numbered by a
checkpoint before the scans, so results don't depend on the number of blocks, nor on doc_ids that repeat or are null.

Defined results: null and empty texts have no words, no hits and are clean; items without words are never
found; items with equal texts are all found; equal item_ids count once, and items without an id not at all. Rows are judged one by one, whether
their doc_id repeats, ties or is null; a very long text is scanned whole; an empty table gives no rows, and without items
every row is clean. Extra columns are ignored by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, slices, small_batches, text_column
from ._text import words

WINDOW = 13
#: Words of the items in one automaton: at about 13 nodes of 50 bytes a word, 130 MB at most.
BLOCK_WORDS = 200_000
#: Number of a row while blocks are united.
ROW = "__row"
SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,last:long,from_byte:long,to_byte:long>>, items array<string>"


class ItemAutomaton:
    """Windows of one block of items as sequences of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        text = pa.array([t for _, t in items], pa.string())
        w = words(text)
        self.vocabulary = np.unique(w.hash)
        number = np.searchsorted(self.vocabulary, w.hash) + 1
        owners: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = number[w.first[k] : w.first[k + 1]].tolist()
            if own:
                n = min(window, len(own))
                for i in range(len(own) - n + 1):
                    owners.setdefault(tuple(own[i : i + n]), set()).add(item)
        self.shortest = min(map(len, owners), default=window)
        self.owners = list(owners.values())
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(owners):
            self.tree.add_word(key, (len(key), k))
        if owners:
            self.tree.make_automaton()

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1, 0 for words of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def find(self, number: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [first, last] and the items found in one document."""
        spans: list[list[int]] = []
        items: set[str] = set()
        known = np.r_[False, number > 0, False]
        turn = np.flatnonzero(known[1:] != known[:-1])
        for lo, hi in zip(turn[::2], turn[1::2]):
            if hi - lo < self.shortest:
                continue
            for end, (n, k) in self.tree.iter(tuple(number[lo:hi].tolist())):
                a, b = int(lo) + end - n + 1, int(lo) + end
                items |= self.owners[k]
                while spans and spans[-1][1] >= a - 1 and spans[-1][0] >= a:
                    spans.pop()
                if spans and spans[-1][1] >= a - 1:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
        return [(a, b) for a, b in spans], items


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: n_words, merged spans of hit words (word numbers and byte offsets), sorted item ids."""
    blocks = _blocks(benchmark, block_words)
    first = list(itertools.islice(blocks, 2))
    if len(first) < 2:
        return _scan_block(docs, first[0] if first else [], window)
    return _scan_blocks(_numbered(docs.select("doc_id", "text")), itertools.chain(first, blocks), window).drop(ROW)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, fixed by a checkpoint."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _scan_blocks(docs: DataFrame, blocks: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """The scans of all blocks over numbered rows, united by row."""
    both = None
    for block in blocks:
        part = _scan_block(docs, block, window, (ROW,))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(ROW).agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size, drawn one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        n = len(r["text"].encode()) // 2 + 1  # as many words at most
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], r["text"]))
        size += n
    if block:
        yield block


def _scan_block(docs: DataFrame, items: list[tuple[str, str]], window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The scan of one block; ``keys`` are long columns passed on behind the others."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value, window)
        for batch in batches:
            for part in slices(batch):
                w = words(text_column(part))
                number = automaton.number(w.hash)
                spans, items = [], []
                for d in range(part.num_rows):
                    lo, hi = w.first[d], w.first[d + 1]
                    found, own = automaton.find(number[lo:hi]) if hi - lo >= automaton.shortest else ([], set())
                    spans.append([{"first": a, "last": b, "from_byte": int(w.start[lo + a] - w.base[d]), "to_byte": int(w.end[lo + b] - w.base[d])} for a, b in found])
                    items.append(sorted(own))
                kind = pa.struct([(n, pa.int64()) for n in ("first", "last", "from_byte", "to_byte")])
                cols = [part.column(0), pa.array(w.counts(), pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(items, pa.list_(pa.string()))]
                cols += [part.column(2 + k) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "spans", "items", *keys])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(run, ", ".join([SCHEMA, *(f"{k} long" for k in keys)]))


_kept: dict[str, ItemAutomaton] = {}


def _automaton(items: list[tuple[str, str]], window: int) -> ItemAutomaton:
    """One automaton a Python worker, kept between tasks."""
    h = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    if h not in _kept:
        _kept.clear()
        _kept[h] = ItemAutomaton(items, window)
    return _kept[h]


def verdicts(scanned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans; behind them ``keys`` as passed on by the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, digest, n = [], [], []
            for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                total, last = 0, -1
                for s in sorted(spans, key=lambda s: s["first"]):
                    total += max(0, s["last"] - max(s["first"], last + 1) + 1)
                    last = max(last, s["last"])
                hit.append(total)
                n.append(len(items))
                digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
            total = batch.column(1).to_numpy()
            bad = (np.array(hit, np.int64) > 0) & (20 * np.array(hit, np.int64) >= total)
            cols = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(bad), batch.column(2), *(batch.column(4 + k) for k in range(len(keys)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *keys])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,last:long,from_byte:long,to_byte:long>>"
    return scanned.mapInArrow(run, ", ".join([schema, *(f"{k} long" for k in keys)]))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated ones, all columns; rows without a doc_id are judged by their text too.

    With one block of items (the rule) rows are judged and passed on in the same scan; with more, the hits of all
    blocks are united by row first.
    """
    more = _blocks(benchmark, block_words)
    blocks = list(itertools.islice(more, 2))
    if len(blocks) > 1:
        rows = _numbered(docs)
        scanned = _scan_blocks(rows, itertools.chain(blocks, more), window)
        bad = verdicts(scanned.select("doc_id", "n_words", "spans", "items", ROW), (ROW,)).filter("contaminated").select(F.col(ROW).alias("__bad"))
        return rows.join(bad.hint("shuffle_hash"), F.col(ROW) == F.col("__bad"), "left_anti").drop(ROW)
    shared = docs.sparkSession.sparkContext.broadcast(blocks[0] if blocks else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value, window)
        for batch in batches:
            for part in slices(batch):
                w = words(text_column(part))
                number = automaton.number(w.hash)
                keep = []
                for lo, hi in zip(w.first[:-1], w.first[1:]):
                    found = automaton.find(number[lo:hi])[0] if hi - lo >= automaton.shortest else []
                    hit = sum(b - a + 1 for a, b in found)
                    keep.append(not (hit and 20 * hit >= hi - lo))
                yield part.filter(pa.array(keep, pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
