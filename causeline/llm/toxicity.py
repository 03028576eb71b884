"""Toxicity by a learned lexicon, matched with Levenshtein automata intersected with the lexicon's trie.

The lexicon holds words, and open stems (a stem stands for every word that begins with it), that labelled toxic
texts hold far more often than others. The automaton of all strings within a term's allowed edits is the
intersection of the trie with the terms' Levenshtein automata, made deterministic; the words of many texts walk through it
together, one character of every live word a step, and most words die within a few steps.

A match counts by its context window: inside quotation marks, with an opening one before and a closing one after within
``WINDOW`` words, it counts little (somebody is quoted), elsewhere fully. Misspelled words that labelled clean
texts use themselves are no misspellings. A logistic model over exact and misspelled counts gives the score.

Lexicon and weights are fitted on a sample of about ``sample`` labelled documents, chosen by a hash of the document id; scoring reads
all rows and whole texts. A term needs three toxic texts of the sample, which bounds the lexicon; its terms are cut into blocks with an automaton
of bounded size each, and a word's match is the best of all blocks. Nothing depends on the order or partitioning of rows.

Defined results: null and empty texts get the model's score for no match; equal texts have equal scores; without
labelled rows of both kinds every score is 0; an empty table gives no rows; rows without doc_id are scored and
teach nothing; a doc_id that is labelled twice is toxic if either says so, and all its rows teach; a very long text is scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, slices, small_batches, text_column
from ._text import mix, words
from .near_dup import shingles

#: Labelled documents that lexicon and weights are fitted on, about.
SAMPLE = 20_000
#: Terms in one automaton: at most about 100 states a term.
BLOCK_TERMS = 256
RATIO = 8.0
WINDOW = 12
QUOTED = 0.2
#: Shortest and longest stem.
STEM = (4, 8)
_TOP = 0x3000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-casing and word characters for code points below U+3000; beyond them, letters are themselves."""
    low = np.arange(_TOP + 1, dtype=np.uint32)
    word = np.zeros(_TOP + 1, bool)
    for c in range(_TOP):
        ch = chr(c)
        word[c] = ch.isalnum()
        if len(ch.lower()) == 1:
            low[c] = ord(ch.lower())
    word[_TOP] = True
    return low, word


_LOW, _WORD = _tables()
#: Quotation marks.
_QUOTES = np.array([ord(c) for c in "\"“”„«»‹›「」"], np.uint32)


@dataclass
class Text:
    """Words of a slice of texts over code points."""

    code: np.ndarray  # folded
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    quoted: np.ndarray


def read(texts: list[str]) -> Text:
    joined = "\n\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, _TOP)
    inside = _WORD[small]
    code = np.where(code < _TOP, _LOW[small], code)
    length = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(length + 2)[:-1]]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(first, start, side="right") - 1
    return Text(code, start, end - start, doc, _quoted(code, start, doc))


def _quoted(code: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words between an opening and a closing quotation mark of their line, both at most WINDOW words away."""
    out = np.zeros(len(start), bool)
    marks = np.flatnonzero(np.isin(code, _QUOTES))
    if not len(marks) or not len(start):
        return out
    line = np.cumsum(code == 10)
    before = np.searchsorted(marks, start)  # marks before the word
    at_line = np.searchsorted(marks, np.searchsorted(line, line[start], side="left"))  # marks before its line
    odd = (before - at_line) % 2 == 1
    has = np.flatnonzero(odd & (before > 0) & (before < len(marks)))
    for k in has:
        a, b = marks[before[k] - 1], marks[before[k]]
        i, j = np.searchsorted(start, a), np.searchsorted(start, b)
        out[k] = line[a] == line[start[k]] == line[b] and k - i <= WINDOW and j - 1 - k <= WINDOW
    return out


@dataclass(frozen=True)
class Term:
    text: str
    open: bool = False

    @property
    def edits(self) -> int:
        """Edits that a match may have: short terms none, stems one at most."""
        n = len(self.text)
        return 0 if n < 5 or (self.open and n < 6) else 1 if n < 9 or self.open else 2


@dataclass
class LexiconAutomaton:
    """Deterministic product of the lexicon's trie and its Levenshtein automata. State 0 is dead, state 1 the start."""

    terms: list[Term]
    alphabet: np.ndarray = field(init=False)
    step: np.ndarray = field(init=False)
    accept: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        nodes: list[dict[str, int]] = [{}]
        allowed, closed, opened = [0], [False], [False]
        for t in self.terms:
            at = 0
            for ch in t.text:
                allowed[at] = max(allowed[at], t.edits)
                if ch not in nodes[at]:
                    nodes[at][ch] = len(nodes)
                    nodes.append({})
                    allowed.append(0), closed.append(False), opened.append(False)
                at = nodes[at][ch]
            allowed[at] = max(allowed[at], t.edits)
            closed[at] |= not t.open
            opened[at] |= t.open
        best: list[dict[bool, int]] = [{} for _ in nodes]  # edits allowed for terms that end at a node
        for t in self.terms:
            at = 0
            for ch in t.text:
                at = nodes[at][ch]
            best[at][t.open] = t.edits
        letters = sorted({ch for n in nodes for ch in n})
        self.alphabet = np.array([ord(c) for c in letters], np.uint32)

        def reach(items: dict[int, int]) -> tuple[tuple[int, int], ...]:
            """Close under missing characters; keep the fewest edits of each node."""
            todo = sorted(items.items(), key=lambda x: x[1])
            out = dict(items)
            while todo:
                node, e = todo.pop()
                if out.get(node, 9) < e:
                    continue
                for child in nodes[node].values():
                    if e + 1 <= allowed[child] and e + 1 < out.get(child, 9):
                        out[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(out.items()))

        def verdict(items: tuple[tuple[int, int], ...]) -> int:
            """0: no match; 1: exact; 2: misspelled."""
            found = 0
            for node, e in items:
                for kind in (False, True):
                    if e <= best[node].get(kind, -1):
                        found = 1 if e == 0 else found or 2
            return found

        done: dict[tuple, int] = {}
        todo: list[tuple] = []

        def number(flag: int, items: tuple[tuple[int, int], ...]) -> int:
            """State of the live trie nodes; flag 2: a misspelled stem was read, so the word matches whatever follows."""
            stems = [e for node, e in items if e <= best[node].get(True, -1)]
            if stems and not min(stems):  # the stem itself: the rest of the word is free
                flag, items = 1, ()
            elif stems or flag == 2:
                flag, items = 2, tuple(x for x in items if x[1] == 0)
            if not flag and not items:
                return 0
            if (flag, items) not in done:
                done[flag, items] = len(done) + 1
                todo.append((flag, items))
            return done[flag, items]

        number(0, reach({0: 0}))
        rows: dict[int, list[int]] = {}
        accept = {0: 0}
        while todo:
            flag, items = todo.pop()
            own = done[flag, items]
            accept[own] = flag if flag == 1 else verdict(items) or flag
            row = []
            spare: dict[int, int] = {}
            for node, e in items:  # a character too many, or another one
                if e + 1 <= allowed[node]:
                    spare[node] = min(spare.get(node, 9), e + 1)
                for child in nodes[node].values():
                    if e + 1 <= allowed[child]:
                        spare[child] = min(spare.get(child, 9), e + 1)
            for ch in [*letters, None]:
                new = dict(spare)
                for node, e in items:
                    child = nodes[node].get(ch)
                    if child is not None and e <= allowed[child]:
                        new[child] = min(new.get(child, 9), e)
                row.append(number(flag, reach(new) if new else ()))
            rows[own] = row
        self.step = np.zeros((len(done) + 1, len(letters) + 1), np.int32)
        for k, row in rows.items():
            self.step[k] = row
        self.accept = np.array([accept.get(k, 0) for k in range(len(done) + 1)], np.int8)

    def match(self, text: Text) -> np.ndarray:
        """For each word 0, 1 (exact) or 2 (misspelled)."""
        out = np.zeros(len(text.start), np.int8)
        if not len(self.alphabet) or not len(text.start):
            return out
        column = np.full(_TOP + 1, len(self.alphabet), np.int32)
        near = self.alphabet < _TOP
        column[self.alphabet[near]] = np.flatnonzero(near)
        at, left, state, word = text.start, text.size, np.ones(len(text.start), np.int32), np.arange(len(text.start))
        far = {int(c): k for k, c in enumerate(self.alphabet) if c >= _TOP}
        while len(word):
            code = text.code[at]
            col = column[np.minimum(code, _TOP)]
            for c, k in far.items():
                col[code == c] = k
            state = self.step[state, col]
            left = left - 1
            ended = (left == 0) & (state != 0)
            out[word[ended]] = self.accept[state[ended]]
            live = (left > 0) & (state != 0)
            at, left, state, word = at[live] + 1, left[live], state[live], word[live]
        return out


class Lexicon:
    """Any number of terms, in blocks of one automaton each."""

    def __init__(self, terms: list[Term]):
        terms = sorted(terms, key=lambda t: (t.text, t.open))
        self.blocks = [LexiconAutomaton(terms[k : k + BLOCK_TERMS]) for k in range(0, len(terms), BLOCK_TERMS)]

    def match(self, text: Text) -> np.ndarray:
        """For each word 0, 1 (exact) or 2 (misspelled): exact where any block has it exactly."""
        out = np.zeros(len(text.start), np.int8)
        for block in self.blocks:
            own = block.match(text)
            out = np.where((own == 0) | (out == 1), out, own)
        return out


@dataclass
class Model:
    automaton: Lexicon
    harmless: frozenset[str]
    weight: np.ndarray
    known: bool = True
    twice: frozenset[str] = frozenset()

    def features(self, texts: list[str], alone: np.ndarray | None = None) -> np.ndarray:
        """Per text: 1, log1p of weighted exact matches, whether there is one, the same for misspelled ones.

        ``alone``: texts that words were learned from; what only that text shows to be harmless doesn't count as known.
        """
        text = read(texts)
        kind = self.automaton.match(text)
        hit = np.flatnonzero(kind)
        value = np.where(text.quoted[hit], QUOTED, 1.0)
        for k, i in enumerate(hit):
            known = self.twice if alone is not None and alone[text.doc[i]] else self.harmless
            if kind[i] == 2 and word_at(text, i) in known:
                value[k] = 0.0
        exact = np.bincount(text.doc[hit], value * (kind[hit] == 1), len(texts))
        fuzzy = np.bincount(text.doc[hit], value * (kind[hit] == 2), len(texts))
        return np.stack([np.ones(len(texts)), np.log1p(exact), np.minimum(exact, 1), np.log1p(fuzzy), np.minimum(fuzzy, 1)], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weight, -30, 30)))


def word_at(text: Text, i: int) -> str:
    a = text.start[i]
    return text.code[a : a + text.size[i]].tobytes().decode("utf-32-le", "replace")


def bucket(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def train_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of about ``sample`` labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    The ids of the sample are few, so they, not the texts, are sent around.
    """
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chosen = own.filter(draw < (sample / n if n > sample else 1.0)).withColumnRenamed("doc_id", "label_id")
    return small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def unlike(rows: DataFrame, keys: int = 4) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id: rows that share one of a few minima over their shingles' hashes.

    A text that was copied often would else lend its rare words the weight of many texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, key, _ = shingles(words(text_column(part)))
                low = np.zeros((keys, part.num_rows), np.int64)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
                for k in range(keys if len(doc) else 0):
                    low[k, doc[first]] = np.minimum.reduceat(mix(key + np.uint64(k * 0x1851F42D4C957F2D)), first).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x) for x in low)], names=names)

    names = ["doc_id", "own", "toxic", *(f"k{k}" for k in range(keys))]
    rows = rows.withColumn("own", F.xxhash64("text"))
    out = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "own", "toxic", "text").mapInArrow(run, "doc_id long, own long, toxic int, " + ", ".join(f"k{k} long" for k in range(keys)))
    for k in range(keys):
        out = out.groupBy(f"k{k}", "toxic").agg(F.min(F.struct("doc_id", "own", *(f"k{j}" for j in range(keys) if j != k))).alias("s")).select(f"k{k}", "toxic", "s.*")
    # the sample's ids are few, so they, not the texts, are sent around
    kept = out.select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"))
    return rows.join(F.broadcast(kept), (F.col("doc_id") == F.col("__id")) & (F.col("own") == F.col("__own"))).dropDuplicates(["doc_id", "own"]).select("text", "toxic")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many toxic and clean texts each word occurs, and each stem, written with a ``*``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for part in slices(batch):
                for t, toxic in zip(text_column(part).to_pylist(), part.column(1).to_pylist()):
                    text = read([t])
                    full = text.code.tobytes().decode("utf-32-le", "replace")
                    own = {full[a : a + n] for a, n in zip(text.start.tolist(), text.size.tolist())}
                    seen[toxic].update(own)
                    seen[toxic].update({w[:n] + "*" for w in own if len(w) >= STEM[0] for n in range(STEM[0], min(STEM[1], len(w)) + 1)})
        own = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([seen[1][w] for w in own], pa.int64()), pa.array([seen[0][w] for w in own], pa.int64())], names=["word", "toxic", "clean"])

    return rows.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> list[Term]:
    """Words and open stems far commoner in toxic texts."""
    # evidence: log-likelihood ratio of a term's own toxic rate against the overall one; ln(words) leaves about one false term
    base = n_toxic / (n_toxic + n_clean)
    all_ = F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") / all_ / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / all_ / (1 - base))).otherwise(0.0)
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    whole, stem = counts.filter(~F.col("word").endswith("*")), counts.filter(F.col("word").endswith("*"))
    bound = float(np.log(max(whole.count(), 2)))
    strong = (F.col("toxic") >= 3) & (ratio >= RATIO) & (evidence >= bound)
    single = whole.filter(strong & (F.length("word") >= 3)).collect()
    kinds = whole.filter((F.length("word") >= STEM[0]) & (F.col("toxic") > 0)).select("word", "toxic", F.explode(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word")))).alias("n"))
    kinds = kinds.groupBy(F.expr("concat(substring(word, 1, n), '*')").alias("word")).agg(F.count(F.lit(1)).alias("kinds"), F.max("toxic").alias("most"))
    stems = stem.filter(strong).join(kinds, "word").filter("kinds >= 4 and 2 * most <= toxic")
    stems = stems.withColumn("word", F.expr("substring(word, 1, length(word) - 1)")).collect()
    size = {r["word"]: r["toxic"] for r in stems}
    starts = lambda w: [w[:n] for n in range(STEM[0], min(len(w), STEM[1]) + 1)]
    shorter = {v for w, n in size.items() for v in starts(w)[:-1] if n >= 0.95 * size.get(v, n + n)}  # a longer stem says as much
    longest = size.keys() - shorter
    opened = {w for w in longest if not any(v in longest for v in starts(w)[:-1])}
    closed = [r["word"] for r in single if not any(v in opened for v in starts(r["word"]))]
    return [Term(w, True) for w in sorted(opened)] + [Term(w) for w in sorted(closed)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    rows = cut(unlike(train_rows(docs, labels, sample)))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    empty = Model(Lexicon([]), frozenset(), np.zeros(5), False)
    if not n.get(0) or not n.get(1):
        return empty
    counts = word_counts(rows).persist()
    automaton = Lexicon(learn_terms(counts, n[1], n[0]))
    shared = spark.sparkContext.broadcast(automaton)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            kind = np.zeros(len(own), np.int8)
            if own:
                text = read(own)
                kind[text.doc] = shared.value.match(text)
            yield batch.filter(pa.array(kind == 2))

    # words one edit away that clean texts use as well are words of their own
    clean = counts.filter(~F.col("word").endswith("*")).filter(f"clean > 0 and (clean + 0.5) / {n[0] + 1} * {RATIO} > (toxic + 0.5) / {n[1] + 1}")
    found = clean.select("word", "clean").mapInArrow(near, "word string, clean long").collect()
    counts.unpersist()
    model = Model(automaton, frozenset(r["word"] for r in found), np.zeros(5), twice=frozenset(r["word"] for r in found if r["clean"] > 1))
    held = spark.sparkContext.broadcast(model)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = held.value.features(text_column(part).to_pylist(), part.column(1).to_numpy() == 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(1, 5)] + [part.column(1)], names=["a", "b", "c", "d", "toxic"])

    seen = rows.mapInArrow(shape, "a double, b double, c double, d double, toxic int").groupBy("a", "b", "c", "d", "toxic").count().orderBy("a", "b", "c", "d", "toxic").collect()
    x = np.array([[1, r["a"], r["b"], r["c"], r["d"]] for r in seen], float)
    model.weight = logistic(x, np.array([r["toxic"] for r in seen], float), np.array([r["count"] for r in seen], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton steps, with a ridge on all but the constant towards matches that speak for toxicity."""
    prior = np.array([0.0, 0.5, 1.0, 0.5, 1.0])
    pull = np.array([1e-6, ridge, ridge, ridge, ridge])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (w - prior)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        d = np.linalg.solve(hess, grad)
        w = w - d * min(1.0, 4.0 / max(1e-9, float(np.abs(d).max())))
        if np.abs(d).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = shared.value.scores(text_column(part).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels, sample))
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
