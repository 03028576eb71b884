"""Language-model scores by Brown's class-based bigrams.

Tokens are the words between ASCII white space, A-Z folded, and an end token for each text. A token's probability is that of
its class after the token before it (a text begins after an end token) times that of the word in its class:

    P(w | v) = (n(Hv, Cw) + A * p(Cw)) / (n(Hv) + A) * (c(w) + 1) / (n(Cw) + V(Cw) + 1)

with n, c counted over all training texts, V(C) the distinct training words of a class and p(C) the share of its tokens;
the 1 in the last denominator is what words of that class never seen share.

Every training word gets its class C by exchange, in two steps. First the ``CORE`` commonest words, one by one, and the endings of
all other words are moved between classes on the driver as long as the likelihood of their bigrams grows (``exchange``); these
classes H are what a word is *after*. Then all words, whatever their number, are moved at once, round by round and distributed,
each to the class in which its own counts after every H are likeliest (``cluster``). To these counts ``PRIOR`` more are added, dealt as those
of all words of its ending, so that a word met once or twice doesn't go by chance. A round never lowers the likelihood of these counts, and
rounds end when the gain is below ``GAIN`` of it. A word never seen is in the class that holds most training words of its ending.

Counts of words are exact and stay distributed; words are named by 64-bit hashes. The commonest ones, at most ``TABLE`` of them, are
sent to every task; tokens of all others find their counts and classes by a join. Units, classes and their bigrams have a fixed size.

Defined results: a null or empty text is the end token alone; a very long text is one row like any other; repeated rows are scored each
and taught each; a row without doc_id is scored but teaches nothing, and its held_out is null; without
training rows (or with an empty table) counts are 0 and all probabilities uniform over what is left; among words of equal counts hashes
decide which are in the core and the table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, slices, small_batches, text_column
from ._text import BLANK, Words, mix, words

CORE, ENDINGS, CLASSES = 768, 255, 64
UNITS = CORE + ENDINGS + 1
END_UNIT = UNITS - 1
TABLE = 200_000
PULL = 8.0
#: Rounds of ``cluster`` go on while they gain this share of the log-likelihood.
GAIN = 1e-4
#: Counts that a word is given from its ending.
PRIOR = 20.0
END_HASH = np.int64(0x454E44)
#: Distinct entries that a task holds before it hands them on, and words that are classed at once.
_STEP, _WORDS = 1_000_000, 16_384
_PAIR = np.dtype([("prev", "u1"), ("n", "<i8")])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bucket(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def endings(w: Words) -> np.ndarray:
    """Ending unit of each word: its last two bytes, hashed."""
    last = w.data[w.end - 1].astype(np.uint32)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint32)
    fold = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)
    h = (fold(last) * np.uint32(2654435761)) ^ (fold(before) * np.uint32(2246822519))
    return CORE + ((h ^ (h >> np.uint32(15))) % np.uint32(ENDINGS)).astype(np.int64)


class Tally:
    """Times of keys with payloads, merged now and then, so that its memory is bounded."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: np.ndarray, *payload: np.ndarray) -> bool:
        """Counts keys with what belongs to each; whether so many are distinct that they should be taken out."""
        k, first, n = np.unique(key, return_index=True, return_counts=True)
        self.parts.append((k, n, *(x[first] for x in payload)))
        self.size += len(k)
        if self.size > _STEP:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size > _STEP // 2 and len(self.parts) == 1

    def merged(self) -> tuple[np.ndarray, ...]:
        """(key, times, payload...), keys ascending."""
        if len(self.parts) == 1:
            return self.parts[0]
        cols = [np.concatenate(x) for x in zip(*self.parts)]
        order = np.argsort(cols[0], kind="stable")
        key = cols[0][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(cols[1][order], first), *(x[order[first]] for x in cols[2:])


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c): each distinct token's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, docs = Tally(), 0
        row = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])
        for batch in batches:
            for part in slices(batch):
                docs += part.num_rows
                w = words(text_column(part), BLANK)
                if len(w.hash) and tally.add(w.hash):
                    yield row(*tally.merged())
                    tally.clear()
        if tally.parts:
            yield row(*tally.merged())
        if docs:
            yield row(np.array([END_HASH]).view(np.uint64), np.array([docs]))

    return small_batches(texts).select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Table:
    """The commonest words: hashes (ascending), counts, units, and their classes once they are known."""

    h: np.ndarray
    c: np.ndarray
    unit: np.ndarray
    g: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it isn't held."""
        if not len(self.h):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.h, hashes)
        at[at == len(self.h)] = 0
        return np.where(self.h[at] == hashes, at, -1)


def commonest(counts: DataFrame, most: int) -> Column:
    """Condition on (h, c) that the ``most`` words of the largest counts fulfil; of equal counts those of small hashes, in whole ranges of hashes."""
    top = counts.agg(F.max("c")).first()[0] or 0
    low, high, held = 0, top + 1, 0  # ``held`` words have a count of ``high`` or more
    while high - low > 1:
        width = -(-(high - low) // 1024)
        at = F.floor((F.col("c") - low) / F.lit(width)).cast("long").alias("at")
        sizes = {r["at"]: r["count"] for r in counts.filter((F.col("c") >= low) & (F.col("c") < high)).groupBy(at).count().collect()}
        edge = -1
        for k in range((high - low - 1) // width, -1, -1):
            if held + sizes.get(k, 0) > most:
                edge = k
                break
            held += sizes.get(k, 0)
        if edge < 0:  # all of them
            return F.col("c") >= low
        low, high = low + edge * width, min(high, low + (edge + 1) * width)
    slot = F.shiftrightunsigned("h", 48)
    sizes = {r["slot"]: r["count"] for r in counts.filter(F.col("c") == low).groupBy(slot.alias("slot")).count().collect()}
    upto = 0
    while upto < 1 << 16 and held + sizes.get(upto, 0) <= most:
        held += sizes.get(upto, 0)
        upto += 1
    return (F.col("c") >= high) | ((F.col("c") == low) & (slot < upto))


def common_words(counts: DataFrame, most: int = CORE) -> Table:
    """The core: its words are their own units; the end token is always held."""
    rows = counts.filter(commonest(counts, most) | (F.col("h") == int(END_HASH))).toArrow()
    h, c = (rows.column(k).to_numpy().astype(np.int64) for k in ("h", "c"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    unit = np.full(len(h), END_UNIT)
    inner = np.flatnonzero(h != np.uint64(END_HASH))
    unit[inner[np.lexsort((h[inner], -c[inner]))]] = np.arange(len(inner))
    return Table(h, c, unit)


def unit_stream(w: Words, table: Table, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the tokens of all texts with each text's end token; (units, place of each word, place of each end)."""
    n = w.counts()
    doc = w.doc()
    place = np.arange(len(w.hash)) + doc
    end = np.cumsum(n + 1) - 1
    units = np.full(len(w.hash) + len(n), END_UNIT)
    own = endings(w) if len(w.hash) else np.zeros(0, np.int64)
    held = row >= 0
    if held.any():
        own[held] = table.unit[row[held]]
    units[place] = own
    return units, place, end


def count_bigrams(texts: DataFrame, table: Table) -> np.ndarray:
    """Unit bigrams over all texts, as a matrix of fixed size."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                w = words(text_column(part), BLANK)
                units, _, _ = unit_stream(w, shared.value, shared.value.find(w.hash))
                before = np.r_[END_UNIT, units[:-1]]
                pair, n = np.unique(before * UNITS + units, return_counts=True)
                total[pair] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    out = np.zeros(UNITS * UNITS, np.int64)
    rows = texts.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """Class of each unit by exchange clustering: units by falling count, each to the class of highest likelihood, until none moves (or for ``rounds``).

    The likelihood of class bigrams is, up to terms that don't change, the sum of n log n over class pairs less those
    over first and second classes.
    """
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    own = np.empty(len(order), np.int64)
    own[order] = np.arange(len(order)) % classes
    hot = np.zeros((len(order), classes))
    hot[np.arange(len(order)), own] = 1.0
    big = bigrams.astype(np.float64)
    n = hot.T @ big @ hot
    least = 1e-12 * float(_xlogx(big.sum()))  # above what sums are rounded by, so that every move is a gain and moves end
    for _ in range(rounds) if rounds is not None else itertools.count():
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a = own[u]
            right, left, self_ = np.bincount(own, big[u], classes), np.bincount(own, big[:, u], classes), big[u, u]
            # without u
            right[a] -= self_
            left[a] -= self_
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= self_
            rows, cols = n.sum(1) + left, n.sum(0) + right  # wherever u goes, the words beside it keep their counts
            # what adding u to each class changes: its row, its column, the corner
            gain = (_xlogx(n + right) - _xlogx(n)).sum(1) + (_xlogx(n + left[:, None]) - _xlogx(n)).sum(0)
            corner = np.diag(n)
            gain += _xlogx(corner + right + left + self_) - _xlogx(corner + right) - _xlogx(corner + left) + _xlogx(corner)
            r, c = right.sum() + self_, left.sum() + self_
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + least:
                b = a
            own[u] = b
            moved += b != a
            n[b] += right
            n[:, b] += left
            n[b, b] += self_
        if not moved:
            break
    return own


def contexts(texts: DataFrame, core: Table, classes: np.ndarray) -> DataFrame:
    """(h, unit, c, pairs) of every training word: the unit of its ending, its count, and how often it stands after each class.

    Tasks count in arrays and hand on one row a word, so a word's rows are as many as the tasks that met it; they are
    merged as a sorted stream, whose memory doesn't depend on them.
    """
    shared = texts.sparkSession.sparkContext.broadcast((core, classes))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, classes = shared.value
        tally = Tally()
        for batch in batches:
            for part in slices(batch):
                w = words(text_column(part), BLANK)
                units, place, end = unit_stream(w, core, core.find(w.hash))
                token = np.full(len(units), np.uint64(END_HASH))
                token[place] = w.hash
                own = np.full(len(units), END_UNIT)
                own[place] = endings(w) if len(w.hash) else own[place]
                prev = np.r_[classes[END_UNIT], classes[units[:-1]]].astype(np.uint8)
                if len(units) and tally.add(mix(token + (prev.astype(np.uint64) + np.uint64(1)) * _ODD), token, prev, own.astype(np.int32)):
                    yield _paired(*tally.merged()[1:])
                    tally.clear()
        if tally.parts:
            yield _paired(*tally.merged()[1:])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pairs, size = _pairs(batch.column(2))
            own = (np.repeat(h, size), np.repeat(unit, size), pairs["prev"], pairs["n"])
            if held is not None:
                own = tuple(np.concatenate(x) for x in zip(held, own))
            last = own[0] == own[0][-1]  # more of the last word may follow
            if not last.all():
                yield _words(*(x[~last] for x in own))
            h, unit, prev, n = (x[last] for x in own)
            kinds, at = np.unique(prev, return_inverse=True)
            times = np.zeros(len(kinds), np.int64)
            np.add.at(times, at, n)
            held = (h[: len(kinds)], unit[: len(kinds)], kinds, times)
        if held is not None:
            yield _words(*held)

    rows = small_batches(texts).select("text").mapInArrow(met, "h long, unit int, pairs binary")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(merge, "h long, unit int, c long, pairs binary")


def _binary(first: np.ndarray, prev: np.ndarray, n: np.ndarray) -> pa.Array:
    """One binary of pairs from each of ``first`` on."""
    pairs = np.empty(len(prev), _PAIR)
    pairs["prev"], pairs["n"] = prev, n
    offsets = (np.r_[first, len(prev)] * _PAIR.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all pairs, how many of them each row has)."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(_PAIR), np.diff(off) // _PAIR.itemsize


def _paired(n: np.ndarray, token: np.ndarray, prev: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((prev, token))
    token, prev, n, unit = token[order], prev[order], n[order], unit[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(token[first].view(np.int64)), pa.array(unit[first]), _binary(first, prev, n)], names=["h", "unit", "pairs"])


def _words(h: np.ndarray, unit: np.ndarray, prev: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((prev, h))
    h, unit, prev, n = h[order], unit[order], prev[order], n[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (prev[1:] != prev[:-1])])
    h, unit, prev, n = h[first], unit[first], prev[first], np.add.reduceat(n, first)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    cols = [pa.array(h[first]), pa.array(unit[first].astype(np.int32)), pa.array(np.add.reduceat(n, first)), _binary(first, prev, n)]
    return pa.RecordBatch.from_arrays(cols, names=["h", "unit", "c", "pairs"])


@dataclass
class Rule:
    """Where words go: by the core's classes at first (``likely`` is None), then to the class in which their pairs are likeliest."""

    core: Table
    classes: np.ndarray  # of units
    likely: np.ndarray | None = None  # log of each class before (rows) in each class (columns)
    lean: np.ndarray | None = None  # of units: what their counts add to each class's log-likelihood

    def own(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class of each word of a batch of ``contexts``; and of each pair its word, class before and times."""
        pairs, size = _pairs(batch.column(3))
        word = np.repeat(np.arange(batch.num_rows), size)
        if self.likely is None:
            at = self.core.find(batch.column(0).to_numpy().view(np.uint64))
            unit = np.where(at >= 0, self.core.unit[at] if len(self.core.h) else 0, batch.column(1).to_numpy())
            return self.classes[unit], word, pairs["prev"], pairs["n"]
        after = np.bincount(word * CLASSES + pairs["prev"], pairs["n"], batch.num_rows * CLASSES).reshape(-1, CLASSES)
        return (after @ self.likely + self.lean[batch.column(1).to_numpy()]).argmax(1), word, pairs["prev"], pairs["n"]


def place(found: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words where ``rule`` puts them: tokens by (class before, class), distinct words by (unit of the ending, class), tokens by (unit of the ending, class before)."""
    shared = found.sparkSession.sparkContext.broadcast(rule)
    shapes = ((CLASSES, CLASSES), (UNITS, CLASSES), (UNITS, CLASSES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(a * b, np.int64) for a, b in shapes]
        for whole in batches:
            for at in range(0, whole.num_rows, _WORDS):
                batch = whole.slice(at, _WORDS)
                own, word, prev, times = shared.value.own(batch)
                unit, prev = batch.column(1).to_numpy().astype(np.int64), prev.astype(np.int64)
                np.add.at(out[0], prev * CLASSES + own[word], times)
                out[1] += np.bincount(unit * CLASSES + own, minlength=len(out[1]))
                np.add.at(out[2], unit[word] * CLASSES + prev, times)
        for what, x in enumerate(out):
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), what, np.int32)), pa.array(some.astype(np.int32)), pa.array(x[some])], names=["what", "at", "n"])

    rows = found.mapInArrow(run, "what int, at int, n long").groupBy("what", "at").agg(F.sum("n").alias("n")).toArrow()  # of fixed size
    what, at, n = (rows.column(k).to_numpy() for k in range(3))
    out = [np.zeros(a * b, np.int64) for a, b in shapes]
    for k, x in enumerate(out):
        x[at[what == k]] = n[what == k]
    return tuple(x.reshape(shape) for x, shape in zip(out, shapes))


def likelihood(n: np.ndarray) -> float:
    """Of counts by (class before, class), up to what no move changes."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(0)).sum())


def cluster(found: DataFrame, core: Table, classes: np.ndarray, prior: float = PRIOR, gain: float = GAIN) -> tuple[Rule, np.ndarray, np.ndarray]:
    """Rounds of moves of all words until they bring too little: the rule that places them, and the counts of ``place``."""
    rule = Rule(core, classes)
    n, kinds, after = place(found, rule)
    given = prior * after / np.maximum(after.sum(1, keepdims=True), 1)  # to each word of an ending
    full = n + given.T @ kinds
    while n.any():
        likely = np.log((full + 0.01) / (full.sum(0) + 0.01 * CLASSES))
        next_ = Rule(core, classes, likely, given @ likely)
        n2, kinds2, _ = place(found, next_)
        full2 = n2 + given.T @ kinds2
        if likelihood(full2) - likelihood(full) <= gain * abs(likelihood(full)):
            break
        rule, n, kinds, full = next_, n2, kinds2, full2
    return rule, n, kinds


def placed(found: DataFrame, rule: Rule) -> DataFrame:
    """(h, unit, c, g): every training word with its class."""
    shared = found.sparkSession.sparkContext.broadcast(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _WORDS):
                batch = whole.slice(at, _WORDS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shared.value.own(batch)[0].astype(np.int32))], names=["h", "unit", "c", "g"])

    return found.mapInArrow(run, "h long, unit int, c long, g int")


@dataclass
class Model:
    table: Table  # the commonest words
    classes: np.ndarray  # of units: what a word is after
    unseen: np.ndarray  # of units: class of words never seen
    step: np.ndarray  # log10 of a class after a class
    bottom: np.ndarray  # log10 of each class's emission denominator
    tokens: int
    kinds: int


def fit(texts: DataFrame, most: int = TABLE, first: int = CORE) -> tuple[Model, DataFrame]:
    """The model, and (h, unit, c, g) of all training words. ``first``: words of the core, all of which the table holds."""
    counts = cut(count_words(texts))
    core = common_words(counts, first)
    classes = exchange(count_bigrams(texts, core))
    found = cut(contexts(texts, core, classes))
    rule, n, kinds = cluster(found, core, classes)
    every = placed(found, rule)
    rows = every.filter(commonest(counts, max(most, first)) | (F.col("h") == int(END_HASH))).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    unit, c, g = (rows.column(k).to_numpy().astype(np.int64)[order] for k in ("unit", "c", "g"))
    table = Table(h[order], c, unit, g)
    at = core.find(table.h)
    table.unit = np.where(at >= 0, core.unit[at] if len(core.h) else 0, unit)
    size, per_class = n.sum(0), kinds.sum(0)
    unseen = np.where(kinds.any(1), kinds.argmax(1), classes)
    share = (size + 1) / (size.sum() + CLASSES)
    step = np.log10((n + PULL * share) / (n.sum(1, keepdims=True) + PULL))
    return Model(table, classes, unseen, step, np.log10(size + per_class + 1), int(size.sum()), int(per_class.sum())), every


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<h:long,prev:int>>"


def score_common(docs: DataFrame, model: Model) -> DataFrame:
    """Per text all but what the words that the table doesn't hold bring if they are known; these are returned as ``rare``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_c = np.log10(m.table.c + 1.0)
        end_row = int(m.table.find(np.array([END_HASH]).view(np.uint64))[0])
        floor = np.log10(m.tokens + m.kinds + 1.0)
        for batch in batches:
            for part in slices(batch):
                w = words(text_column(part), BLANK)
                row = m.table.find(w.hash)
                units, place_, end = unit_stream(w, m.table, row)
                held = row >= 0
                g, own, known = m.unseen[units], np.zeros(len(units)), np.zeros(len(units), np.int64)
                g[place_[held]], own[place_[held]], known[place_[held]] = (m.table.g[row[held]], log_c[row[held]], 1) if held.any() else (0, 0, 0)
                if end_row >= 0:
                    g[end], own[end], known[end] = m.table.g[end_row], log_c[end_row], 1
                prev = np.r_[m.classes[END_UNIT], m.classes[units[:-1]]]
                first = np.r_[0, end[:-1] + 1]
                n = np.diff(np.r_[first, len(units)])
                base = np.add.reduceat(own, first) - n * floor
                score = np.add.reduceat(m.step[prev, g] - m.bottom[g] + own, first)
                rare = pa.StructArray.from_arrays([pa.array(w.hash[~held].view(np.int64)), pa.array(prev[place_[~held]].astype(np.int32))], names=["h", "prev"])
                offsets = np.r_[0, np.cumsum(np.bincount(w.doc()[~held], minlength=part.num_rows))].astype(np.int32)
                cols = [part.column(0), pa.array(n), pa.array(np.add.reduceat(known, first)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), rare)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def score_rare(scored: DataFrame, model: Model, every: DataFrame) -> DataFrame:
    """(row, known, log, more) of texts with rare known words: how many, and what they add to the base score and to the score."""
    shared = scored.sparkSession.sparkContext.broadcast((model.unseen, model.step, model.bottom))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen, step, bottom = shared.value
        for batch in batches:
            prev, n, unit, c, g = (batch.column(k).to_numpy() for k in range(1, 6))
            log, u = n * np.log10(c + 1.0), unseen[unit]
            more = log + n * (step[prev, g] - bottom[g] - step[prev, u] + bottom[u])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(log), pa.array(more)], names=["row", "known", "log", "more"])

    rare = scored.select("row", F.explode("rare").alias("r")).groupBy("row", "r.h", "r.prev").agg(F.count(F.lit(1)).alias("n"))
    found = rare.join(every, "h").select("row", "prev", "n", "unit", "c", "g").mapInArrow(run, "row long, known long, log double, more double")
    return found.groupBy("row").agg(F.sum("known").alias("known"), F.sum("log").alias("log"), F.sum("more").alias("more"))


def report(docs: DataFrame, most: int = TABLE, first: int = CORE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the perplexity."""
    held_out = bucket(F.col("doc_id"), 7) == 2
    model, every = fit(docs.filter(F.coalesce(~held_out, F.lit(False))), most, first)
    scored = cut(score_common(docs, model).withColumn("row", F.monotonically_increasing_id()))
    out = scored.drop("rare").join(score_rare(scored, model, every), "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = out.select("doc_id", held_out.alias("held_out"), "n_tokens", plus("n_known", "known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base", "log").alias("base_score"), plus("score", "more").alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
