"""Token counts by rank-synchronous array merging.

Pre-tokens not seen before are held as ragged arrays of symbols, many at once. In each round every sequence
finds its lowest-ranked pair and merges all places of that pair at the same time (from the left where they
overlap); a sequence without a ranked pair is done, and its surviving symbols are its tokens. In long sequences the same is done
with a list of places for each rank, so that a round touches only the pairs it merges and their neighbours. Pre-tokens repeat, so
their counts are kept, per stretch between blanks, in a cache of bounded bytes that lives as long as the Python worker.

Splitting before a blank that follows a non-blank never cuts a pre-token, so such stretches are counted apart;
texts with other white space than space, tab and line ends are split by the full pattern instead. A special
token's string is one token, as the library has it by default.

Defined results: null and empty texts have 0 tokens; repeated rows and rows without doc_id are counted each; a very long text, or one very
long word, is counted whole; ties between pairs go to the lower rank, and of overlapping places to the left one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import slices, small_batches, text_column

LIMIT = 512
#: Bytes of the cache, about; longer stretches than ``CACHE_LONGEST`` characters are not kept.
CACHE_BYTES, CACHE_LONGEST = 48 << 20, 256
#: Sequences from this many bytes on are merged with lists of places.
LONG = 512
#: Symbols merged in one go.
BATCH_SYMBOLS = 1 << 20
#: The byte-level pattern of the published vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STRETCH = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_ODD_BLANK = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_NONE = np.iinfo(np.int64).max


class Merges:
    """A byte-level BPE's merge ranks as arrays: pair -> rank and merged symbol."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab = model["vocab"]
        self.width = max(vocab.values()) + 1
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.byte = np.array([vocab[char[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        size = np.array([len(t) for t in tokens], np.int64)
        long = np.flatnonzero(size >= LONG)
        if len(long):
            out = np.zeros(len(tokens), np.int64)
            at = 0
            while at < len(long):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(size[long[at:]]), BATCH_SYMBOLS)) + at)
                out[long[at:stop]] = self._merge_long([tokens[k] for k in long[at:stop]])
                at = stop
            short = np.flatnonzero(size < LONG)
            out[short] = self.counts([tokens[k] for k in short])
            return out
        out = np.zeros(len(tokens), np.int64)
        at = 0
        while at < len(tokens):
            stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_SYMBOLS)) + at)
            out[at:stop] = self._merge(tokens[at:stop], size[at:stop])
            at = stop
        return out

    def _merge(self, tokens: list[bytes], size: np.ndarray) -> np.ndarray:
        out = size.copy()
        symbol = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), size)
        while len(symbol) > 1:
            joined = seq[1:] == seq[:-1]
            rank = np.full(len(symbol), _NONE, np.int64)
            rank[:-1][joined] = self.ranks(symbol[:-1][joined], symbol[1:][joined])
            first = np.flatnonzero(np.r_[True, ~joined])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(seq)])
            alive = low != _NONE
            out[seq[first[~alive]]] = length[~alive]
            lowest = np.repeat(low, length)
            hit = (rank == lowest) & (rank != _NONE)
            # of overlapping places (a run of one symbol) every second one from the run's start
            follow = hit & np.r_[False, hit[:-1]]
            if follow.any():
                pos = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~follow, pos, 0))
                hit &= (pos - start) % 2 == 0
            symbol[hit] = self.merged[rank[hit]]
            keep = np.repeat(alive, length)
            keep[1:] &= ~hit[:-1]
            symbol, seq = symbol[keep], seq[keep]
        out[seq] = 1 if len(symbol) == 1 else out[seq]
        return out

    def _merge_long(self, tokens: list[bytes]) -> np.ndarray:
        """The same for long sequences, all at once: a pair's places are merged when its rank is the lowest left.

        A merged symbol occurs only in pairs of higher ranks than its own, and sequences don't touch, so
        going up the ranks of all sequences merges in each what is lowest there.
        """
        size = np.array([len(t) for t in tokens], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(symbol)
        seq = np.repeat(np.arange(len(tokens)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(size) - 1
        after[last] = n
        before[np.r_[0, last[:-1] + 1]] = -1
        alive = np.ones(n + 1, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(pos: np.ndarray) -> None:
            """Note the pairs that begin at ``pos``."""
            pos = pos[after[pos] < n]
            rank = self.ranks(symbol[pos], symbol[after[pos]])
            some = rank != _NONE
            pos, rank = pos[some], rank[some]
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for a, b in zip(first, [*first[1:], len(rank)]):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(pos[a:b])

        file(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            pos = np.unique(np.concatenate(places.pop(r)))
            pos = pos[alive[pos] & (after[pos] < n)]
            pos = pos[self.ranks(symbol[pos], symbol[after[pos]]) == r]  # what other merges left of them
            if not len(pos):
                continue
            follow = np.r_[False, after[pos[:-1]] == pos[1:]]
            if follow.any():  # of overlapping places every second one from the run's start
                at = np.arange(len(pos))
                pos = pos[(at - np.maximum.accumulate(np.where(follow, 0, at))) % 2 == 0]
            gone = after[pos]
            symbol[pos] = self.merged[r]
            alive[gone] = False
            after[pos] = after[gone]
            inner = after[pos] < n
            before[after[pos[inner]]] = pos[inner]
            left = before[pos]
            file(np.unique(np.r_[pos, left[left >= 0]]))
        return np.bincount(seq[alive[:n]], minlength=len(tokens))


class TokenCounter:
    def __init__(self, json_text: str):
        spec = json.loads(json_text)
        self.merges = Merges(spec)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}
        self.held = 0

    def learn(self, stretches: list[str]) -> None:
        """Count the tokens of stretches: their pre-tokens, once each, in one batch of arrays."""
        parts = [self.find(s) for s in stretches]
        own = list({p for ps in parts for p in ps})
        count = dict(zip(own, self.merges.counts([p.encode() for p in own]).tolist()))
        for s, ps in zip(stretches, parts):
            self.known[s] = count[ps[0]] if len(ps) == 1 else sum([count[p] for p in ps])

    def count(self, texts: list[str]) -> list[int]:
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        base = [0] * len(texts)
        pieces: list[list[str]] = []
        for k, t in enumerate(texts):
            parts = [t]
            if self.split_special and any(s in t for s in self.special):
                parts = self.split_special.split(t)
                base[k] = len(parts) - 1
            pieces.append([x for p in parts for x in (self.find(p) if _ODD_BLANK.search(p) else _STRETCH.findall(p))])
        known = self.known
        new = set()
        for own in pieces:
            new.update(own)
        new = [s for s in new if s not in known]
        for k in range(0, len(new), 50_000):
            self.learn(new[k : k + 50_000])
        out = [b + sum([known[x] for x in own]) for b, own in zip(base, pieces)]
        for x in new:
            if len(x) > CACHE_LONGEST:
                del known[x]
            else:
                self.held += 100 + 2 * len(x)
        return out


_kept: dict[int, TokenCounter] = {}


def counter_for(json_text: str) -> TokenCounter:
    k = zlib.crc32(json_text.encode())
    if k not in _kept:
        _kept.clear()
        _kept[k] = TokenCounter(json_text)
    return _kept[k]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(spec.value)
        for batch in batches:
            for part in slices(batch):
                text = text_column(part)
                n = np.array(counter.count(text.to_pylist()), np.int64)
                n_bytes = text.cast(pa.binary())
                sizes = np.diff(np.frombuffer(n_bytes.buffers()[1], np.int32)[n_bytes.offset : n_bytes.offset + len(n_bytes) + 1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
