"""Language identification by multilingual mixtures.

A language is a distribution of hashed byte trigrams around letters (A-Z folded), learned from labelled texts. In a
document every word has a likelihood under each language, the product of its trigrams'. Expectation-maximisation
estimates the document's language proportions from the words' likelihoods; the set of languages is the one
with the best likelihood less a penalty for every language in it, over the nested sets of the largest proportions. No set is likelier than
the free mixture of all languages, so larger sets are tried only while that could pay for them.

The models are fitted on a sample of about ``sample`` labelled documents a language, chosen by a hash of the
document id; everything else reads all rows and whole texts. They are sent to every task: a table of ``FEATURES`` numbers a language, at
most ``MAX_LANGS`` languages (128 MB); more distinct values of lang are an error, none is left out.

Defined results: a null text or one without any letter is ``und`` with score 0; equal texts have equal results; rows with
null lang or doc_id teach nothing, repeated rows teach each; without any labelled row every text is ``und``; an empty table gives no rows. Ties go to
the language that sorts first. A very long text is one mixture over all its words. ``identify`` replaces columns of its own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import SLICE_BYTES, raw, slices, small_batches, text_column

FEATURES = 1 << 16
#: Labelled documents a language that the models are fitted on, about.
SAMPLE = 3000
ROUNDS = 12
#: Log-likelihood that one more language has to bring: this times the log of the document's words, and at least PENALTY_LEAST.
PENALTY, PENALTY_LEAST = 3.0, 12.0
MAX_LANGS = 512
UND = "und"

_rng = np.random.default_rng(7)
_MIX = _rng.integers(0, FEATURES, size=(3, 256), dtype=np.uint32)


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _letters()


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each letter byte, index of each word's first letter byte, document of each word)."""
    data, off = raw(col)
    lo, hi = int(off[0]), int(off[-1])
    off = off - lo
    n = hi - lo
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z
    low = _FOLD[data[lo:hi]]
    before, after = np.full(n, 32, np.uint8), np.full(n, 32, np.uint8)
    before[1:], after[:-1] = low[:-1], low[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge], after[edge - 1] = 32, 32
    letter = np.flatnonzero(low != 32)
    if not len(letter):
        return z, z, z
    feature = (_MIX[0][before[letter]] + _MIX[1][low[letter]] + _MIX[2][after[letter]]) & (FEATURES - 1)
    start = np.flatnonzero(before[letter] == 32)
    doc = np.searchsorted(off, letter[start], side="right") - 1
    return feature, start, doc


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Models:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: features x languages."""
        self.langs = langs
        smooth = 0.5
        self.log = np.log((counts + smooth) / (counts.sum(0) + smooth * FEATURES)).astype(np.float32) if langs else np.zeros((FEATURES, 0), np.float32)

    def word_scores(self, feature: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.log[feature], start, axis=0, dtype=np.float32).astype(np.float64)


def _segments(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])


def mixture(score: np.ndarray, seg: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions (documents x languages) and log-likelihoods.

    score: log-likelihood of each word under each language; seg: each document's first word.
    """
    n_words = np.diff(np.r_[seg, len(score)])
    top = score.max(1)
    like = np.exp(score - top[:, None])
    base = np.add.reduceat(top, seg)
    share = np.full((len(seg), score.shape[1]), 1.0 / score.shape[1])
    live = np.arange(len(seg))
    begin, size = seg, n_words
    part = like
    for _ in range(rounds):
        own = np.repeat(np.arange(len(live)), size)
        r = part * share[live][own]
        r /= r.sum(1, keepdims=True)
        inner = np.r_[0, np.cumsum(size)[:-1]]
        new = np.add.reduceat(r, inner, axis=0) / size[:, None]
        moving = np.abs(new - share[live]).max(1) > 1e-3
        share[live] = new
        if not moving.any():
            break
        if not moving.all():
            part = part[np.repeat(moving, size)]
            live, size = live[moving], size[moving]
    total = np.log((like * np.repeat(share, n_words, axis=0)).sum(1))
    return share, base + np.add.reduceat(total, seg)


def predict(models: Models, col: pa.Array) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Predicted language, its proportion, and the chosen set's proportions, for each text."""
    n = len(col)
    pred, score, sets = [UND] * n, np.zeros(n), [{} for _ in range(n)]
    feature, start, doc = trigrams(col)
    if not len(start) or not models.langs:
        return pred, score, sets
    words = models.word_scores(feature, start)
    seg = _segments(doc)
    docs, n_words = doc[seg], np.diff(np.r_[seg, len(doc)])
    share, full = mixture(words, seg)
    alone = np.add.reduceat(words, seg, axis=0)
    best = alone.argmax(1)
    cost = np.maximum(PENALTY * np.log(n_words + 1), PENALTY_LEAST)
    chosen: list[tuple[np.ndarray, np.ndarray]] = [(np.array([b]), np.ones(1)) for b in best]
    # the full mixture bounds what any larger set can reach
    for k in np.flatnonzero(full - alone.max(1) > cost):
        own = words[seg[k] : seg[k] + n_words[k]]
        order = np.argsort(-share[k], kind="stable")
        top, value = chosen[k], alone[k].max() - cost[k]
        for size in range(2, len(models.langs) + 1):
            if full[k] - size * cost[k] <= value:
                break
            at = order[:size]
            p, ll = mixture(own[:, at], np.zeros(1, np.int64), 30)
            if ll[0] - size * cost[k] > value:
                top, value = (at, p[0]), ll[0] - size * cost[k]
        chosen[k] = top
    # confidence of a single language: its share in the free mixture
    for k, d in enumerate(docs):
        at, p = chosen[k]
        if len(at) == 1:
            lang, value = int(at[0]), float(share[k, at[0]])
        else:
            j = int(p.argmax())
            lang, value = int(at[j]), float(p[j])
        pred[d], score[d] = models.langs[lang], min(max(value, 0.0), 1.0)
        sets[d] = {models.langs[int(a)]: float(x) for a, x in zip(at, p)}
    ascii_letter = np.zeros(n, bool)
    ascii_letter[doc[np.flatnonzero(_ascii_word(col, start, doc))]] = True
    for d in docs[~ascii_letter[docs]]:
        if not has_letter(col[int(d)].as_py()):
            pred[d], score[d], sets[d] = UND, 0.0, {}
    return pred, score, sets


def _ascii_word(col: pa.Array, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words begin with an ASCII letter (any other word's text is looked at as a whole)."""
    data, off = raw(col)
    low = _FOLD[data[int(off[0]) : int(off[-1])]]
    letter = np.flatnonzero(low != 32)
    return low[letter[start]] < 128


def bucket(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Models:
    """Models from rows (doc_id, text, lang), lang not null."""
    sizes = {r["lang"]: r["count"] for r in small_batches(labelled).groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} distinct values of lang; models are made for {MAX_LANGS} at most")
    if not langs:
        return Models([], np.zeros((FEATURES, 0)))
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(draw < rate[F.col("lang")]).select("lang", "text")
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), FEATURES), np.int64)
        for batch in batches:
            for part in slices(batch):
                col = text_column(part)
                own = np.array([number[x] for x in part.column(0).to_pylist()])
                feature, start, doc = trigrams(col)
                if len(start):
                    size = np.diff(np.r_[start, len(feature)])
                    total += np.bincount(np.repeat(own[doc], size) * FEATURES + feature, minlength=total.size).reshape(total.shape)
        lang, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(feature, pa.int32()), pa.array(total[lang, feature])], names=["lang", "feature", "n"])

    counts = np.zeros((FEATURES, len(langs)))
    rows = chosen.mapInArrow(run, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[rows.column("feature").to_numpy(), rows.column("lang").to_numpy()] = rows.column("n").to_numpy()  # at most FEATURES x languages
    return Models(langs, counts)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, lang_score and languages (map of the chosen set's proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    clash = [c for c in ("lang_pred", "lang_score", "languages") if c in docs.columns]
    docs = docs.drop(*clash)
    names = docs.columns
    limit = max(1 << 16, SLICE_BYTES * 8 // max(4, len(models.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                pred, score, sets = predict(shared.value, text_column(part))
                cols = [*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "lang_score", "languages"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def known_only(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` whose language is found, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    limit = max(1 << 16, SLICE_BYTES * 8 // max(4, len(models.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield part.filter(pa.array([p != UND for p in predict(shared.value, text_column(part))[0]], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def train_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may teach: lang not null, crc32(doc_id as text) mod 4 not 2."""
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id"), 4) != 2))


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The query's columns: doc_id, held_out, lang_pred, score, and languages."""
    out = identify(docs.select("doc_id", "text"), fit(train_rows(docs), sample))
    return out.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "languages")
