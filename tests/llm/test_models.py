"""Language ID, class-based scores and toxicity: exact parts against brute force, models by held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from causeline.llm import brown_lm, lang_id, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# --- languages ---


def test_held_out_languages(spark):
    docs = table(spark, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = lang_id.report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_mixtures_find_both_languages():
    rnd = random.Random(3)
    a = ["anda", "tion", "there", "other"]
    b = ["schul", "zeit", "unge", "lich"]
    say = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    counts = np.stack([np.bincount(lang_id.trigrams(pa.array([say(ws, 500)]))[0], minlength=lang_id.FEATURES) for ws in (a, b)], 1)
    m = lang_id.Models(["aa", "bb"], counts)
    pred, score, sets = lang_id.predict(m, pa.array([say(a, 80), say(a, 60) + " " + say(b, 20), "", "12 !", "😀", say(b, 1)]))
    assert pred[0] == "aa" and set(sets[0]) == {"aa"}
    assert pred[1] == "aa" and set(sets[1]) == {"aa", "bb"} and abs(sets[1]["bb"] - 0.25) < 0.05
    assert pred[2:5] == ["und"] * 3 and list(score[2:5]) == [0, 0, 0] and pred[5] == "bb"


def test_em_is_maximum_likelihood():
    rng = np.random.default_rng(0)
    score = np.log(rng.random((40, 2)))
    share, ll = lang_id.mixture(score, np.zeros(1, np.int64), 500)
    grid = [np.log(np.exp(score) @ [p, 1 - p]).sum() for p in np.linspace(0, 1, 1001)]
    assert abs(ll[0] - max(grid)) < 0.01


def test_sets_of_any_size(spark, monkeypatch):
    """A text in six languages has six; too many languages are an error."""
    rnd = random.Random(5)
    vocabulary = [["".join(rnd.choice(letters) for _ in range(6)) for _ in range(8)] for letters in ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx")]
    say = lambda ws, n: " ".join(rnd.choice(ws) for _ in range(n))
    counts = np.stack([np.bincount(lang_id.trigrams(pa.array([say(ws, 800)]))[0], minlength=lang_id.FEATURES) for ws in vocabulary], 1)
    m = lang_id.Models(list("abcdef"), counts)
    _, _, sets = lang_id.predict(m, pa.array([" ".join(say(ws, 60) for ws in vocabulary), " ".join(say(ws, 60) for ws in vocabulary[:3])]))
    assert [set(x) for x in sets] == [set("abcdef"), set("abc")] and all(abs(v - 1 / 6) < 0.03 for v in sets[0].values())
    monkeypatch.setattr(lang_id, "MAX_LANGS", 2)
    with pytest.raises(ValueError):
        lang_id.fit(spark.createDataFrame([(k, "text", f"l{k}") for k in range(3)], "doc_id long, text string, lang string"))


def test_language_odd_rows(odd_docs, no_docs):
    out = lang_id.report(odd_docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == odd_docs.count()
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (0, 1, 2, 3))
    assert lang_id.report(no_docs).count() == 0
    full = lang_id.identify(odd_docs, lang_id.fit(lang_id.train_rows(odd_docs)))
    assert set(odd_docs.columns) <= set(full.columns)
    unlabelled = odd_docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in lang_id.report(unlabelled).collect()} == {"und"}


# --- class-based scores ---


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]


def check_base(tokens, out, held):
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (out[d].held_out, out[d].n_tokens, out[d].n_known, out[d].train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(out[d].base_score - base) < 1e-6 * abs(base)
    return c


def test_base_scores_and_known_words(spark):
    docs = table(spark, "documents").filter("doc_id < 300")
    tokens = {r.doc_id: split(r.text) for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    out = {r.doc_id: r for r in brown_lm.report(docs, 2000, 100).collect()}  # most words go through the join
    check_base(tokens, out, held)
    assert sum(held[d] and out[d].score > out[d].base_score for d in tokens) > 0.8 * sum(held.values())


def test_few_long_documents(spark):
    """The end token is rarer than the words of the table, and known all the same; words of equal counts are in the table or not."""
    texts = [" ".join(f"w{(k + d) % 50}" for k in range(500)) for d in range(4)]
    tokens = {d: split(t) for d, t in enumerate(texts)}
    for most in (0, 20, 1000):
        out = {r.doc_id: r for r in brown_lm.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most, min(most, 10)).collect()}
        c = check_base(tokens, out, {d: out[d].held_out for d in tokens})
        assert all(out[d].n_known == 501 for d in tokens) and c[None] < min(n for w, n in c.items() if w)


def test_commonest_is_exact(spark):
    rnd = random.Random(4)
    for counts in ([rnd.choice([1, 2, 3, 9, 10**12, 5 * 10**6 + rnd.randint(0, 9)]) for _ in range(300)], [7] * 300, [10**6 + k for k in range(300)]):
        df = spark.createDataFrame([(rnd.randint(-(2**63), 2**63 - 1), c) for c in counts], "h long, c long")
        for most in (0, 1, 37, 150, 300, 1000):
            got = sorted((r.c for r in df.filter(brown_lm.commonest(df, most)).collect()), reverse=True)
            assert got == sorted(counts, reverse=True)[:most]


def test_score_against_brute_force(spark):
    """Classes, transitions and emissions counted word by word; probabilities after any class sum to one."""
    rnd = random.Random(9)
    kinds = [["the", "a", "one"], [f"n{k}x" for k in range(40)], [f"v{k}ed" for k in range(40)]]
    texts = [" ".join(rnd.choice(kinds[k % 3]) for k in range(rnd.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (500, "the unseenx nevered"), (501, None)], "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r.text for r in docs.collect()}
    train = {d: split(t) for d, t in rows.items() if zlib.crc32(str(d).encode()) % 7 != 2}
    m, every = brown_lm.fit(docs.filter(brown_lm.bucket(docs.doc_id, 7) != 2), 10, 5)
    placed = {r.h: r for r in every.collect()}
    name = lambda w: brown_lm.END_HASH if w is None else np.uint64(brown_lm.words(pa.array([w]), brown_lm.BLANK).hash[0]).view(np.int64)
    ending = lambda w: brown_lm.END_UNIT if w is None else int(brown_lm.endings(brown_lm.words(pa.array([w]), brown_lm.BLANK))[0])
    core = brown_lm.common_words(brown_lm.count_words(docs.filter(brown_lm.bucket(docs.doc_id, 7) != 2)), 5)
    core_unit = {int(h): int(u) for h, u in zip(core.h.view(np.int64), core.unit)}
    before = lambda w: int(m.classes[core_unit.get(int(name(w)), ending(w))])
    c = Counter(w for ws in train.values() for w in ws)
    assert {h: r.c for h, r in placed.items()} == {int(name(w)): n for w, n in c.items()}
    cls = {w: placed[int(name(w))].g for w in c}
    k = brown_lm.CLASSES
    n = np.zeros((k, k))
    after = {w: np.zeros(k) for w in c}
    for ws in train.values():
        for v, w in zip([None, *ws], ws):
            n[before(v), cls[w]] += 1
            after[w][before(v)] += 1
    size, distinct = n.sum(0), np.bincount(list(cls.values()), minlength=k)
    p = (n + brown_lm.PULL * (size + 1) / (size.sum() + k)) / (n.sum(1, keepdims=True) + brown_lm.PULL)
    assert np.allclose(p, 10**m.step) and np.allclose(p.sum(1), 1)
    assert (m.tokens, m.kinds) == (sum(c.values()), len(c))
    emit = lambda w, g: (c[w] + 1) / (size[g] + distinct[g] + 1)
    for g in range(k):
        assert abs(sum(emit(w, g) for w in c if cls[w] == g) + 1 / (size[g] + distinct[g] + 1) - 1) < 1e-9
    for r in brown_lm.report(docs, 10, 5).collect():
        ws = split(rows[r.doc_id])
        want = sum(math.log10(p[before(v), g] * emit(w, g)) for v, w in zip([None, *ws], ws) for g in [cls[w] if w in cls else int(m.unseen[ending(w)])])
        assert abs(r.score - want) < 1e-6 * abs(want), r
    # with what their endings give them, words would hardly be likelier in other classes
    pool = np.zeros((brown_lm.UNITS, k))
    for w in c:
        pool[ending(w)] += after[w]
    full = {w: after[w] + brown_lm.PRIOR * pool[ending(w)] / pool[ending(w)].sum() for w in c}
    sums = np.zeros((k, k))
    for w in c:
        sums[:, cls[w]] += full[w]
    q = np.log((sums + 0.01) / (sums.sum(0) + 0.01 * k))
    own = sum(full[w] @ q[:, cls[w]] for w in c)
    assert 0 <= sum((full[w] @ q).max() for w in c) - own <= 0.02 * abs(own)


def test_rounds_never_lose(spark):
    docs = table(spark, "documents").filter("doc_id < 400")
    core = brown_lm.common_words(brown_lm.count_words(docs))
    classes = brown_lm.exchange(brown_lm.count_bigrams(docs, core))
    found = brown_lm.contexts(docs, core, classes).persist()
    n, kinds, after = brown_lm.place(found, brown_lm.Rule(core, classes))
    _, last, kinds2 = brown_lm.cluster(found, core, classes, 0.0)
    assert after.sum() == n.sum()
    assert brown_lm.likelihood(last) > brown_lm.likelihood(n) and n.sum() == last.sum() and (n.sum(1) == last.sum(1)).all()
    assert kinds.sum() == kinds2.sum() == found.count() == brown_lm.count_words(docs).count()
    assert (kinds.sum(1) == kinds2.sum(1)).all() and found.select("h").distinct().count() == found.count()
    found.unpersist()


def test_exchange_improves_likelihood():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 4, 60)
    step = rng.dirichlet(np.ones(4) * 0.3, 4)
    big = rng.poisson(3 * step[kind][:, kind])

    def likelihood(own, k):
        n = np.zeros((k, k))
        np.add.at(n, (np.repeat(own, 60), np.tile(own, 60)), big.ravel())
        f = brown_lm._xlogx
        return f(n).sum() - f(n.sum(0)).sum() - f(n.sum(1)).sum()

    own = brown_lm.exchange(big, 4, 20)
    total = big.sum(0) + big.sum(1)
    start = np.empty(60, int)
    start[np.argsort(-total, kind="stable")] = np.arange(60) % 4
    assert likelihood(own, 4) > likelihood(start, 4)
    best = likelihood(own, 4)
    for u in range(60):  # no single move is better
        for b in range(4):
            other = own.copy()
            other[u] = b
            assert likelihood(other, 4) <= best + 1e-6


def test_exchange_goes_on_until_no_move_is_better():
    def likelihood(big, own, k):
        hot = np.eye(k)[own]
        n, f = hot.T @ big @ hot, brown_lm._xlogx
        return f(n).sum() - f(n.sum(0)).sum() - f(n.sum(1)).sum()

    rng = np.random.default_rng(3)
    for _ in range(20):
        big = rng.poisson(rng.gamma(0.1, 20, (24, 24)))
        own = brown_lm.exchange(big, 4)
        best = likelihood(big, own, 4)
        for u in range(24):
            for b in range(4):
                other = own.copy()
                other[u] = b
                assert likelihood(big, other, 4) <= best + 1e-6
    big = rng.poisson(rng.gamma(0.2, 5, (300, 300)))
    assert likelihood(big, brown_lm.exchange(big, 16), 16) > likelihood(big, brown_lm.exchange(big, 16, 6), 16)
    assert (brown_lm.exchange(np.zeros((5, 5), np.int64), 2) == np.arange(5) % 2).all()


def test_brown_odd_rows(odd_docs, no_docs):
    out = brown_lm.report(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out}
    assert by[0].n_tokens == 1 and by[1].n_tokens == 1 and by[2].n_tokens == 1
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert brown_lm.report(no_docs).count() == 0


# --- toxicity ---


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_against_distances(monkeypatch):
    terms = [toxicity.Term(w) for w in ("idiot", "scum", "worthless", "disgusting")] + [toxicity.Term("lowei", True), toxicity.Term("lostra", True)]
    auto = toxicity.LexiconAutomaton(terms)
    rnd = random.Random(3)
    words = []
    for _ in range(4000):
        w = list(rnd.choice(terms).text + rnd.choice(["", "", "xy", "aé"]))
        for _ in range(rnd.randint(0, 3)):
            k, o = rnd.randint(0, len(w)), rnd.randint(0, 2)
            if o == 0:
                w.insert(k, rnd.choice("abcdeostré"))
            elif k < len(w):
                w[k : k + 1] = [] if o == 1 else [rnd.choice("abcdeostré")]
        if w:
            words.append("".join(w))

    def truth(w):
        best = 9
        for t in terms:
            d = min(distance(w[:k], t.text) for k in range(len(w) + 1)) if t.open else distance(w, t.text)
            if d <= t.edits:
                best = min(best, d)
        return 0 if best == 9 else 1 if best == 0 else 2

    want = [truth(w) for w in words]
    assert auto.match(toxicity.read(words)).tolist() == want
    monkeypatch.setattr(toxicity, "BLOCK_TERMS", 2)
    assert toxicity.Lexicon(terms).match(toxicity.read(words)).tolist() == want


def toxic_table(spark, n=600):
    rnd = random.Random(12)
    plain = ["river", "stone", "window", "paper", "garden", "silver", "table", "cloud", "idiom", "slow"]
    bad = ["idiot", "worthless", "scumbag"]
    rows, labels = [], []
    for d in range(n):
        ws = [rnd.choice(plain) + rnd.choice(["", str(rnd.randint(0, 50))]) for _ in range(rnd.randint(8, 30))]
        toxic = rnd.random() < 0.3
        if toxic:
            ws[rnd.randint(0, len(ws) - 1)] = rnd.choice([*bad, "idoit", "wortless"])
        elif rnd.random() < 0.03:
            ws[2:3] = ['"you', rnd.choice(bad) + '"', "they", "said"]
        rows.append((d, " ".join(ws)))
        labels.append((d, 1, int(toxic)))
    rows += [(3, "the window of an idiot"), (5, rows[5][1]), (n, ""), (n + 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = toxic_table(spark)
    score = lambda n: sorted((r.doc_id, r.score) for r in toxicity.report(docs.repartition(n), labels.repartition(n)).collect())
    one = score(1)
    assert one == score(7) and len({s for _, s in one}) > 1


def test_toxicity_score_against_brute_force(spark):
    """Matches by plain edit distance, quotation by plain scanning of the line, and the logistic model's weights."""
    docs, labels = toxic_table(spark)
    m = toxicity.fit(docs, labels)
    terms = [t for b in m.automaton.blocks for t in b.terms]
    assert {t.text for t in terms} >= {"idiot", "scumbag"} and m.weight[1:].min() >= 0

    def kind(w):
        best = 9
        for t in terms:
            d = min(distance(w[:k], t.text) for k in range(len(w) + 1)) if t.open else distance(w, t.text)
            if d <= t.edits:
                best = min(best, d)
        return 0 if best == 9 else 1 if best == 0 else 2

    got = {(r.doc_id, r.score) for r in toxicity.score(docs, m).collect()}
    for r in docs.collect():
        exact = fuzzy = 0.0
        text = r.text or ""
        for w in re.finditer(r"\w+", text):
            k = kind(w.group().lower())
            if not k or (k == 2 and w.group().lower() in m.harmless):
                continue
            before, after = text[: w.start()], text[w.end() :]
            inside = before.count('"') % 2 == 1 and '"' in after
            near = inside and len(re.findall(r"\w+", before[before.rindex('"') :])) <= 12 and len(re.findall(r"\w+", after[: after.index('"')])) <= 12
            value = toxicity.QUOTED if near else 1.0
            exact, fuzzy = exact + value * (k == 1), fuzzy + value * (k == 2)
        x = [1, math.log1p(exact), min(exact, 1), math.log1p(fuzzy), min(fuzzy, 1)]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, m.weight))))
        assert any(d == r.doc_id and abs(s - want) < 1e-9 for d, s in got), (r, want)


def test_quotation_counts_less():
    m = toxicity.Model(toxicity.Lexicon([toxicity.Term("idiot")]), frozenset(), np.array([-2.0, 2.0, 2.0, 1.0, 1.0]))
    quoted, abuse, typo, none = m.scores(['they wrote "you idiot" in the letter', "you idiot", "you idoit idiott", ""])
    assert none < quoted < abuse and none < typo
    assert m.features(['he said "it\nyou idiot" there'])[0][2] == 1.0  # a quotation ends with its line


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.report(docs, labels).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    caught = np.mean([r.predicted for r in held if truth[r.doc_id] == 1])
    wrong = np.mean([r.predicted for r in held if truth[r.doc_id] == 0])
    assert caught > 0.85 and wrong < 0.02


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 0, 0), (None, 1, 1), (8, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.report(odd_docs, labels)
    assert out.count() == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.report(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.report(odd_docs, labels.limit(0)).collect()} == {0.0}
