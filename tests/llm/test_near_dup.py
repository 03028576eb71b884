import random

import numpy as np
import pyarrow as pa

from causeline.llm import near_dup as nd
from causeline.llm._graph import components
from causeline.llm._text import words


def sets(texts, n=5):
    doc, key, weight = nd.shingles(words(pa.array(texts, pa.string())), n)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(key[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:])]


def plain(a, b):
    u = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in u) for d in set(a) & set(b))


def test_similarity_and_signatures():
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(300)] + ["x y z q r s"] * 8
    other = [w if rnd.random() > 0.04 else "zz" for w in base]
    s = sets([" ".join(base), " ".join(other)])
    exact = nd.similarity(*s[0], *s[1])
    assert abs(exact - plain(*[dict(zip(k.tolist(), w.tolist())) for k, w in s])) < 1e-9
    doc = np.repeat([0, 1], [len(s[0][0]), len(s[1][0])])
    sig = nd.signatures(2, doc, np.concatenate([s[0][0], s[1][0]]), np.concatenate([s[0][1], s[1][1]]), 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def brute(rows, least=0.8):
    own = sets([t or "" for _, t in rows])
    ids = [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] and rows[a][1] == rows[b][1]
            if same or nd.similarity(*own[a], *own[b]) >= least:
                x, y = find(a), find(b)
                root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return {ids[k]: ids[find(k)] for k in range(len(rows))}


def corpus(n=150, seed=3, copies=40):
    rnd = random.Random(seed)
    text = lambda k: [f"t{rnd.randint(0, 4000)}" for _ in range(k)]
    rows = [text(rnd.randint(3, 120)) for _ in range(n - copies)]
    hot = text(150)
    for _ in range(copies):  # copies with more and fewer changes: not all of them are links
        rows.append([w if rnd.random() > rnd.choice([0.0, 0.01, 0.03, 0.08]) else f"n{rnd.randint(0, 9)}" for w in hot])
    rows += [list(rows[0]), list(rows[0]), rows[5] + ["more"]]
    return [(i * 3, " ".join(r)) for i, r in enumerate(rows)]


def test_classes_against_brute_force(spark, monkeypatch):
    rows = corpus() + [(9001, ""), (9002, ""), (9003, None), (9004, "!!!"), (9005, "!!!"), (9006, "a b"), (9007, "A, b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in nd.classes(df).collect()} == want
    # the same with every bucket in blocks
    monkeypatch.setattr(nd, "SMALL_BUCKET", 1)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 7)
    assert {r.doc_id: r.class_id for r in nd.classes(df).collect()} == want


def test_repeated_ids(spark, monkeypatch):
    """Rows, not ids, are compared: no text that has no copy is lost, and no link."""
    rnd = random.Random(5)
    x, y, z = (" ".join(f"{c}{rnd.randint(0, 999)}" for _ in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (3, y), (7, z + " a"), (7, x + " b"), (8, z + " tail"), (9, x + " tail"), (None, y + " c"), (None, "alone here"), (None, "alone here"), (11, ""), (11, ""), (None, None), (4, y), (4, y)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, nr long").repartition(3)
    want = {x: 5, y: 3, z + " a": 7, x + " b": 5, z + " tail": 7, x + " tail": 5, y + " c": 3, "alone here": None}
    got = nd.classes(df.withColumn("text", df.text)).collect()
    assert len(got) == len(rows)
    own = {(r.doc_id, r.h): want.get(r.text, r.doc_id) for r in df.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    assert all(r.class_id == own[r.doc_id, r.own] for r in got)
    kept = nd.keep_first(df)
    assert kept.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert texts == sorted([(5, x), (3, y), (7, z + " a"), (None, "alone here"), (11, ""), (11, ""), (None, None)], key=str)
    assert sum(r.kept for r in got) == len(texts)


def test_hot_bucket_of_unlike_texts(spark, monkeypatch):
    """A bucket that falls into many components, in many blocks, has the links it has by pairs."""
    rows = corpus(120, 8, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda: {r.doc_id: r.class_id for r in nd.classes(df, 0.95, bands=2, rows=1).collect()}
    pairs = by()
    monkeypatch.setattr(nd, "SMALL_BUCKET", 1)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 3)
    assert by() == pairs


def test_odd_rows(odd_docs, no_docs):
    got = {}
    for r in nd.classes(odd_docs).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[7] == {6} and got[8] == {6} and got[0] == {0} and got[1] == {1} and len(got) == 21 and got[None] == {6, None}
    kept = nd.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 0, 1, 6} and not kept.filter("doc_id = 7").count()
    assert nd.classes(no_docs).count() == 0 and nd.keep_first(no_docs).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {v: v for p in pairs for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {v: find(v) for p in pairs if p[0] != p[1] for v in p}
    assert got == want
