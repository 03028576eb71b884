import numpy as np
import pytest

from causeline.llm import embed_dup

SCHEMA = "vec_id long, embedding array<float>, label int, key string, blob string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", "y", 1) for i, e, label in rows], SCHEMA).repartition(3)


def brute(rows, least=0.98):
    ok = {}
    for i, e, label in rows:
        x = None if e is None else np.array([np.nan if c is None else c for c in e], np.float32).astype(float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = (label, x)
    links = {i: set() for i, _, _ in rows}
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = ok[a], ok[b]
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a].add(b)
                links[b].add(a)
    low = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            v = todo.pop()
            if v not in low:
                low[v] = i
                todo += links[v]
    return {i: (len(links[i]), low[i], low[i] == i) for i in links}


def vectors(n=400, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=dim)
    for i in range(n):
        x = rng.normal(size=dim) if i % 3 else centre + rng.normal(size=dim) * 0.11
        rows.append((i * 2, [float(np.float32(c)) for c in x], int(i % 4 == 0)))
    rows += [(5001, rows[3][1], rows[3][2]), (5003, rows[3][1], 1 - rows[3][2]), (5005, [2 * c for c in rows[3][1]], rows[3][2])]
    rows += [(6001, None, 0), (6003, [0.0] * dim, 0), (6005, [float("nan")] * dim, 0), (6007, [None] * dim, 0), (6009, rows[3][1], None), (6011, [], 0), (6013, [1.0, 0.0], 0), (6015, [1.0, 0.001], 0)]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dup, "BLOCK", block)
    monkeypatch.setattr(embed_dup.search, "__defaults__", (block,))
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dup.link(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in embed_dup.link(df).collect()}
    found, there = sum(got.values()), sum(n for n, _, _ in want.values())
    assert there == 0 or found / there >= 0.99
    assert all(got[i] <= want[i][0] for i in got)


def test_codes_bound_distances():
    rng = np.random.default_rng(1)
    x = embed_dup._units(rng.normal(size=(500, 32)))
    index = embed_dup.Index(x, 16, 0.98)
    home, probe = index.homes(x)
    codes, err = index.encode(x, home)
    k = int(home[0])
    own = np.flatnonzero(home == k)
    d = index.distances(x[:20], k, codes[own])
    real = np.sqrt(((x[:20, None] - x[own][None]) ** 2).sum(-1))
    assert (d - err[own] <= real + 1e-9).all() and (d + err[own] >= real - 1e-9).all()
    assert probe[np.arange(500), home].all()


def test_odd_tables(spark):
    assert embed_dup.link(frame(spark, []).limit(0)).count() == 0
    only = [(1, None, 0), (2, [0.0], 1)]
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dup.link(frame(spark, only)).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
    twice = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)]
    assert sorted(map(str, (tuple(r) for r in embed_dup.link(frame(spark, twice)).collect()))) == sorted(map(str, [(1, 0, 1, True), (1, 0, 1, True), (None, 0, None, None)]))


def test_repeated_ids_and_labels_of_text(spark):
    rows = [(4, [1.0, 0.0], "a"), (4, [0.0, 1.0], "a"), (7, [0.0, 1.001], "a"), (3, [1.0, 0.001], "a"), (9, [1.0, 0.0], "b"), (8, [5.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(tuple(r) for r in embed_dup.link(df).collect())
    assert got == [(3, 1, 3, True), (4, 1, 3, False), (4, 1, 4, True), (7, 1, 4, False), (8, 1, 8, True), (9, 1, 8, False)]
