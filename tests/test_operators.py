import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeline.operators import causal, changepoint, events as ev, graph, labels, periodic, stats, templates as tp

TOP = dt.datetime(2112, 7, 16)


def log_of(spark, times, host="h", gid=0):
    rows = [(k, gid, str(t), host) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "lid long, gid int, dt string, host string").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


TIMES = [TOP + dt.timedelta(minutes=m) for m in (0, 1, 59, 60, 61, 89, 90, 91, 150, 299, 300, 301, 600, 601, 720, 1000, 1001, 1439, 1440, 1500, 1501, 2000, 2879)]


def test_tumbling_and_hopping(spark):
    end = TOP + dt.timedelta(days=2)
    log = log_of(spark, TIMES)
    got = {r.bin: r.cnt for r in ev.binned(log, TOP, end, 5400).collect()}
    want = {}
    for t in TIMES:
        k = int((t - TOP).total_seconds() // 5400)
        want[k] = want.get(k, 0) + 1
    assert got == want and sum(got.values()) == len(TIMES)
    for compat, width in ((True, 3600), (False, 5400)):
        got = {r.bin: r.cnt for r in ev.sliding(log, TOP, end, 5400, 3600, compat=compat).collect()}
        want = {}
        for i in range(48):
            a = TOP + dt.timedelta(seconds=3600 * i)
            n = sum(a <= t < a + dt.timedelta(seconds=width) for t in TIMES)
            if n:
                want[i] = n
        assert got == want
    assert ev.n_bins(TOP, TOP + dt.timedelta(seconds=10), 4) == 3


def test_terms_overrun(spark):
    end = TOP + dt.timedelta(days=2)
    rows = ev.in_terms(log_of(spark, TIMES), TOP, end, 30 * 3600, 24 * 3600)
    got = sorted((r.term, r.lid) for r in rows.collect())
    want = sorted((k, i) for i, t in enumerate(TIMES) for k in range(2) if TOP + dt.timedelta(days=k) <= t < TOP + dt.timedelta(days=k, hours=30))
    assert got == want


def test_regular_events(spark):
    log = log_of(spark, [TOP + dt.timedelta(seconds=600 * k) for k in range(100)]).unionByName(log_of(spark, TIMES, "other"))
    r = {x.host: x.interval_s for x in stats.intervals(log, 0.1).collect()}
    assert r == {"h": 600, "other": None}
    end = TOP + dt.timedelta(hours=17)
    lin = {x.host: x.val for x in stats.linearity(log, TOP, end, 600).collect()}
    c = np.cumsum([1] * 100 + [0] * 2)
    assert abs(lin["h"] - ((c - np.arange(1, 103) * 100 / 102) ** 2).sum() / (102 * 100)) < 1e-9
    assert [x.host for x in stats.linear_events(log, TOP, end, 600).select("host").collect()] == ["h"] or lin["other"] < 0.5


def test_spectrum(spark):
    x = np.zeros(720)
    x[::24] = 3
    assert periodic.interval_of(x, 3600) == 86400
    assert periodic.interval_of(np.random.default_rng(0).poisson(1, 720).astype(float), 3600) is None
    y = x.copy()
    y[100] += 5
    rest = periodic.remainder(y, periodic.periodic_part(y))
    assert rest[100] > 0 and rest[::24].max() == 0
    end = TOP + dt.timedelta(days=30)
    times = [TOP + dt.timedelta(hours=24 * k) for k in range(30)]
    cells = ev.binned(log_of(spark, times + [TOP + dt.timedelta(hours=100)]).unionByName(log_of(spark, TIMES, "o")), TOP, end, 3600)
    gone = {r.host: r.periodic for r in periodic.spectrum_filter(cells, 720, 3600).collect()}
    assert gone == {"h": True, "o": False}
    kept = [(r.bin, r.cnt) for r in periodic.spectrum_filter(cells, 720, 3600, "replace").filter("host = 'h'").collect()]
    assert kept == [(100, 1.0)]


def test_windows_before_the_end(spark):
    end = TOP + dt.timedelta(days=30)
    daily = [TOP + dt.timedelta(days=k) for k in range(30)]
    often = [end - dt.timedelta(minutes=10 * k + 5) for k in range(144)]
    log = log_of(spark, daily, "daily").unionByName(log_of(spark, often, "often")).unionByName(log_of(spark, TIMES, "o"))
    got = {r.host: (r.window_s, r.interval_s) for r in periodic.periodic_in_windows(log, end, ((86400, 60), (30 * 86400, 3600))).collect()}
    assert got == {"often": (86400, 600), "daily": (30 * 86400, 86400)}


def test_peeling():
    base = [100 * k for k in range(10)]
    found, rest = periodic.peel(base + [33, 457, 812], 100, 0.01)
    assert found == [base] and rest == [33, 457, 812]


def test_peeling_against_all_pairs():
    def brute(seconds, dur, err, least=2):
        slack, rest, found, start = int(dur * err), sorted(seconds), [], 0
        while start < len(rest):
            chain = [start]
            while near := [(abs(rest[k] - rest[chain[-1]] - dur), k) for k in range(chain[-1] + 1, len(rest)) if abs(rest[k] - rest[chain[-1]] - dur) <= slack]:
                chain.append(min(near)[1])
            if len(chain) >= least:
                found.append([rest[k] for k in chain])
                rest = [t for k, t in enumerate(rest) if k not in chain]
            else:
                start += 1
        return found, rest

    rng = np.random.default_rng(5)
    for _ in range(300):
        seconds = rng.integers(0, int(rng.integers(1, 400)), int(rng.integers(0, 60))).tolist()
        dur, err = int(rng.integers(0, 40)), float(rng.choice([0, 0.1, 0.5, 2]))
        assert periodic.peel(seconds, dur, err) == brute(seconds, dur, err)
        assert periodic.peel(seconds, dur, err, 3) == brute(seconds, dur, err, 3)
    found, rest = periodic.peel(rng.integers(0, 30 * 86400, 100_000).tolist(), 3600, 0.1)
    assert sum(map(len, found)) + len(rest) == 100_000


def test_peeling_with_equal_times_against_all_pairs():
    def brute(seconds, dur, err):
        slack, rest, found, start = int(dur * err), sorted(seconds), [], 0
        while start < len(rest):
            own, at, steps = [], start, 0
            while True:
                near = [k for k in range(at + 1, len(rest)) if abs(rest[k] - rest[at] - dur) <= slack]
                own += [at, *(k for k in range(at + 1, near[0] if near else len(rest)) if rest[k] < rest[at] + slack)]
                if not near:
                    break
                at, steps = near[0], steps + 1
            if steps:
                found.append([rest[k] for k in own])
                rest = [t for k, t in enumerate(rest) if k not in own]
            else:
                start += 1
        return found, rest

    rng = np.random.default_rng(6)
    for _ in range(300):
        seconds = rng.integers(0, int(rng.integers(1, 400)), int(rng.integers(0, 60))).tolist()
        dur, err = int(rng.integers(1, 40)), float(rng.choice([0, 0.1, 0.5]))
        assert periodic.peel(seconds, dur, err, dup=True) == brute(seconds, dur, err)
    found, rest = periodic.peel([0, 2, 100, 101, 200, 350], 100, 0.05, dup=True)
    assert found == [[0, 2, 100, 101, 200]] and rest == [350]
    found, rest = periodic.peel(rng.integers(0, 30 * 86400, 100_000).tolist(), 3600, 0.1, dup=True)
    assert sum(map(len, found)) + len(rest) == 100_000


def test_separate_periodic_takes_the_whole_log(spark):
    from causeline.plans import queries as q, views as v

    d = "/root/testdata/sf0.001"
    for name in ("separate_periodic", "separate_periodic_dup"):
        assert q.QUERIES[name](spark, d).agg(F.sum("n")).first()[0] == v.log(spark, d, v.TOP, v.END).count()


def test_fisher_and_chi_square():
    assert math.isclose(causal.chi2_sf(causal.CRITICAL[0.01], 1), 0.01, rel_tol=1e-6)
    assert math.isclose(causal.chi2_sf(5.991464547, 2), 0.05, rel_tol=1e-6)
    assert math.isclose(causal.chi2_sf(9.487729037, 4), 0.05, rel_tol=1e-6)
    rng = np.random.default_rng(1)
    x = rng.normal(size=2000)
    y = x + rng.normal(size=2000)
    z = y + rng.normal(size=2000)
    t = causal.tester(np.stack([x, y, z], 1), "fisherz")
    assert t(0, 2, ()) < 1e-6 < t(0, 2, (1,))


@pytest.mark.parametrize("method", ["default", "stable"])
def test_pc_on_known_graphs(spark, method):
    rng = np.random.default_rng(5)
    n = 4000
    flip = lambda b, p: b ^ (rng.random(n) < p)
    a = rng.random(n) < 0.5
    b = flip(a, 0.1)
    c = flip(b, 0.1)
    x, y = rng.random(n) < 0.5, rng.random(n) < 0.5
    z = flip(x | y, 0.05)
    chain, collider = np.stack([a, b, c], 1), np.stack([x, y, z], 1)
    rows = [(term, v, int(k), 1) for term, m in ((0, chain), (1, collider)) for v in range(3) for k in np.flatnonzero(m[:, v])]
    cells = spark.createDataFrame(rows, "term int, eid int, bin long, cnt long")
    got = {}
    for r in causal.pc(cells, n, "term", method=method).collect():
        got.setdefault(r.term, set()).add((r.src_eid, r.dst_eid))
    assert got[0] == {(0, 1), (1, 0), (1, 2), (2, 1)}
    assert got[1] == {(0, 2), (1, 2)}


def test_g_square_counts_pairs_that_never_meet(spark):
    cells = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("c", 0)], "e string, bin long")
    got = {(r.e1, r.e2): r for r in causal.g_square_pairs(cells, 4).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"].n11 == 0
    data = np.zeros((4, 2), int)
    data[[0, 1], 0] = 1
    data[2, 1] = 1
    assert math.isclose(causal.chi2_sf(got["a", "b"].g2, 1), causal.gsq_test(data, 0, 1, ()), rel_tol=1e-9)


def test_word_distances():
    assert tp.edit_distance("a b c".split(), "a x c d".split()) == 2
    assert tp.edit_distance("a ** c".split(), "a x c".split()) == 0
    assert tp.edit_distance([], ["a"]) == 1
    v = tp.WordVectors()
    assert tp.seq_ratio(["a"], ["a", "b"], v) == 0 and tp.seq_ratio([], [], v) == 1
    assert math.isclose(tp.seq_ratio(["aa", "b"], ["aa", "c"], v), 0.5)
    assert tp.seq_ratio(["**", "b"], ["x", "b"], v) == 1


def test_shiso_modes(spark):
    lines = ["interface eth0 down", "interface eth1 down", "login of bob", "login of amy from far", "interface eth2 down"]
    log = spark.createDataFrame([(k, x.split()) for k, x in enumerate(lines)], "lid long, words array<string>")
    for mode in ("exact", "by_length", "sharded"):
        ids, tpl = tp.numbered(tp.shiso(log, 0.9, 4, mode))
        t = {r.tid: " ".join(r.tpl) for r in tpl.collect()}
        assert sorted(t.values()) == ["interface ** down", "login of amy from far", "login of bob"]
        assert {r.lid for r in ids.collect()} == set(range(5))


def test_trie_and_relational_match(spark):
    tpls = ["a ** c", "a b **", "a b c", "** ** **", "x **"]
    trie = tp.TemplateTrie()
    for k, t in enumerate(tpls):
        trie.add(t.split(), k)
    lines = ["a b c", "a b d", "a z c", "q r s", "x y", "x", "a ** c"]
    log = spark.createDataFrame([(k, x.split()) for k, x in enumerate(lines)], "lid long, words array<string>")
    given = spark.createDataFrame([(k, t.split()) for k, t in enumerate(tpls)], "tid int, tpl array<string>")
    got = {r.lid: r.tid for r in tp.match_templates(log, given).collect()}
    assert [got.get(k) for k in range(7)] == [trie.search(x.split()) for x in lines] == [2, 1, 0, 3, 4, None, 0]
    assert tp.unmatched(log, given).select("lid").collect()[0][0] == 5
    assert trie.remove("a b c".split()) == 2 and trie.search("a b c".split()) == 1


def test_graph_measures(spark):
    def e(term, pairs):
        return [(term, (0, a), (0, b)) for a, b in pairs] + [(term, (0, b), (0, a)) for a, b in pairs]

    rows = e(0, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")]) + [(1, (0, "a"), (0, "b"))]
    edges = spark.createDataFrame(rows, "term long, src struct<gid:int,host:string>, dst struct<gid:int,host:string>")
    assert {(r.size, r.n) for r in graph.component_sizes(edges).filter("term = 0").collect()} == {(4, 1), (2, 1)}
    assert {r.term: r.size for r in graph.max_clique(edges).collect()} == {0: 3, 1: 2}
    c = {r.term: r.coefficient for r in graph.clustering(edges).collect()}
    assert math.isclose(c[0], (1 + 1 + 1 / 3) / 6) and c[1] == 0
    d = {(r.t1, r.t2): r for r in graph.similar_graphs(edges).collect()}
    assert d[0, 1].ged == d[1, 0].ged == 8 and d[0, 0].ged == 0
    one = edges.filter("term = 0")
    o = graph.overlap(one, edges.filter("term = 1").withColumn("term", F.lit(0).cast("long"))).first()
    assert o.n_common == 1 and o.jaccard <= o.dice <= o.simpson == 1


def test_labels(spark):
    lt = spark.createDataFrame([(0, ["Link", "down"]), (1, ["link", "up"]), (2, ["other"])], "ltid int, ltw array<string>")
    rules = [("down", ["(?i)LINK", "down"]), ("any", ["link"])]
    assert {r.ltid: r.label for r in labels.lt_labels(lt, rules).collect()} == {0: "down", 1: "any", 2: None}


def test_change_point_peaks_at_the_change(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.poisson(2, 300), rng.poisson(20, 300)]
    rows = [(0, "h", k, int(v)) for k, v in enumerate(x) if v]
    cells = spark.createDataFrame(rows, "gid int, host string, bin long, cnt long")
    scores = changepoint.change_points(cells, 600, rate=0.02)
    assert scores.count() == 599  # the open bin is left out
    top = changepoint.strongest(scores.filter("bin > 50"), 1).first()
    assert 295 <= top.bin <= 330


def _random_match(spark):
    """Templates whose first literals stand at 12 places, lines, and what the trie finds of them."""
    rng = np.random.default_rng(3)
    draw = lambda p: [str(w) for w in rng.choice(["a", "b", "c", "", "**"], int(rng.integers(1, 13)), p=p)]
    tpls = {tuple(draw([0.15, 0.1, 0.1, 0.05, 0.6])) for _ in range(150)} | {("**",) * p + ("a",) + ("**",) * (11 - p) for p in range(12)} | {()}
    tpls = [list(t) for t in sorted(tpls)]
    lines = [draw([0.4, 0.2, 0.2, 0.1, 0.1]) for _ in range(400)] + [[], ["only"]]
    trie = tp.TemplateTrie()
    for k, t in enumerate(tpls):
        trie.add(t, k)
    log = spark.createDataFrame([*enumerate(lines), (len(lines), None)], "lid long, words array<string>")
    given = spark.createDataFrame([*enumerate(tpls), (900, None)], "tid int, tpl array<string>")
    return log, given, tpls, lines, {k: trie.search(x) for k, x in enumerate(lines)}


@pytest.mark.parametrize("most_chars", [2_000_000, 0])
def test_matching_as_the_trie_does(spark, monkeypatch, most_chars):
    monkeypatch.setattr(tp, "MOST_CHARS", most_chars)
    log, given, _, _, want = _random_match(spark)
    assert {r.lid: r.tid for r in tp.match_templates(log, given).collect()} == {k: v for k, v in want.items() if v is not None}


def test_matching_shuffles_no_words(spark):
    """Lines are neither taken apart by word nor shuffled or sorted with their words, which took the memory on larger tables."""
    log = spark.range(1000).select(F.col("id").alias("lid"), F.split(F.concat(F.lit("login of "), F.col("id").cast("string")), " ").alias("words"))
    given = spark.createDataFrame([(0, ["login", "of", "**"]), (1, ["login", "**", "1"])], "tid int, tpl array<string>")
    plan = tp.match_templates(log, given)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    assert [r.tid for r in tp.match_templates(log, given).collect()] == [0] * 1000


@pytest.mark.parametrize("most_chars", [2_000_000, 0])
def test_unmatched_as_the_trie_does(spark, monkeypatch, most_chars):
    monkeypatch.setattr(tp, "MOST_CHARS", most_chars)
    log, given, tpls, lines, want = _random_match(spark)
    assert {r.lid for r in tp.unmatched(log, given).collect()} == {k for k, v in want.items() if v is None} | {len(lines)}
    for some in (given.filter("false"), given.filter("forall(tpl, x -> x = '**')")):
        lengths = {len(tpls[r.tid]) for r in some.filter("tid < 900").collect()}
        assert {r.lid for r in tp.unmatched(log, some).collect()} == {k for k, x in enumerate(lines) if len(x) not in lengths} | {len(lines)}


def test_unmatched_looks_at_each_line(spark):
    """Lines of one number, or of none, are looked at by themselves, and no line is shuffled for it."""
    log = spark.createDataFrame([(1, ["a", "b"]), (1, ["x"]), (None, ["a", "c"]), (2, ["y"])], "lid long, words array<string>")
    out = tp.unmatched(log, spark.createDataFrame([(0, ["a", "**"])], "tid int, tpl array<string>"))
    assert sorted((r.lid, r.words) for r in out.collect()) == [(1, ["x"]), (2, ["y"])]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
