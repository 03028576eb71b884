"""Independence tests and the PC algorithm (C11-C17, J8). Order 0 is plain DataFrame work; higher orders are one task a graph."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Critical values of chi square with one degree of freedom.
CRITICAL = {0.05: 3.841458820694124, 0.01: 6.634896601021214, 0.001: 10.827566170662733}

LIMIT = 0.9999999999


# --- order 0 ---


def g_square_pairs(cells: DataFrame, bins: int, *by: str) -> DataFrame:
    """(by, e1, e2, n1, n2, n11, g2) for all pairs e1 < e2 of events with occupied cells (by, e, bin).

    Pairs that never meet count as well: they come from the events' counts, not from the join on bins.
    """
    on = cells.select(*by, "e", "bin").distinct()
    n = on.groupBy(*by, "e").agg(F.count(F.lit(1)).alias("n"))
    x, y = n.select(*by, F.col("e").alias("e1"), F.col("n").alias("n1")), n.select(*by, F.col("e").alias("e2"), F.col("n").alias("n2"))
    pairs = (x.join(y, list(by)) if by else x.crossJoin(y)).filter("e1 < e2")
    a, b = on.withColumnRenamed("e", "e1"), on.withColumnRenamed("e", "e2")
    both = a.join(b, [*by, "bin"]).filter("e1 < e2").groupBy(*by, "e1", "e2").agg(F.count(F.lit(1)).alias("n11"))
    out = pairs.join(both, [*by, "e1", "e2"], "left").withColumn("n11", F.coalesce("n11", F.lit(0)))
    t, n1, n2, o = F.lit(float(bins)), F.col("n1"), F.col("n2"), F.col("n11")

    def term(obs, r, c):
        return F.when(obs > 0, obs * F.log(obs * t / (r * c))).otherwise(0.0)

    g2 = 2 * (term(o, n1, n2) + term(n1 - o, n1, t - n2) + term(n2 - o, t - n1, n2) + term(t - n1 - n2 + o, t - n1, t - n2))
    return out.withColumn("g2", g2)


def fisher_pairs(cells: DataFrame, bins: int, *by: str) -> DataFrame:
    """(by, e1, e2, r, z): correlation of counts over all bins, and Fisher's z at order 0 (C14). From sums over occupied bins."""
    s = cells.groupBy(*by, "e").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q"))
    x = s.select(*by, F.col("e").alias("e1"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    y = s.select(*by, F.col("e").alias("e2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    pairs = (x.join(y, list(by)) if by else x.crossJoin(y)).filter("e1 < e2")
    a = cells.select(*by, F.col("e").alias("e1"), "bin", F.col("cnt").alias("c1"))
    b = cells.select(*by, F.col("e").alias("e2"), "bin", F.col("cnt").alias("c2"))
    both = a.join(b, [*by, "bin"]).filter("e1 < e2").groupBy(*by, "e1", "e2").agg(F.sum(F.col("c1") * F.col("c2")).alias("p"))
    out = pairs.join(both, [*by, "e1", "e2"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    n = float(bins)
    cov = n * F.col("p") - F.col("s1") * F.col("s2")
    var = (n * F.col("q1") - F.col("s1") * F.col("s1")) * (n * F.col("q2") - F.col("s2") * F.col("s2"))
    r = F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0)
    # a perfect correlation is taken a little below one, so that z stays finite
    out = out.withColumn("r", F.least(F.greatest(r, F.lit(-LIMIT)), F.lit(LIMIT)))
    return out.withColumn("z", F.sqrt(F.lit(n - 3)) * 0.5 * F.log1p(2 * F.col("r") / (1 - F.col("r")))).select(*by, "e1", "e2", "r", "z")


# --- tests on a matrix of bins x variables ---


def chi2_sf(x: float, dof: int) -> float:
    """Tail of chi square, closed for one and for even degrees of freedom."""
    if x <= 0:
        return 1.0
    if dof == 1:
        return math.erfc(math.sqrt(x / 2))
    if dof % 2 == 0:
        term = total = math.exp(-x / 2) if x < 1400 else 0.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    raise ValueError("odd degrees of freedom above one")


def gsq_test(data: np.ndarray, x: int, y: int, s: tuple[int, ...], small: int | None = None) -> float:
    """p of the binary G-square test given s; ``small``: with fewer samples than so many a degree of freedom p is 1."""
    dof = 2 ** len(s)
    if small and len(data) < small * dof:
        return 1.0
    code = np.zeros(len(data), np.int64)
    for v in (*s, x, y):
        code = code * 2 + data[:, v]
    o = np.bincount(code, minlength=4 * dof).reshape(dof, 2, 2).astype(float)
    total, rx, ry = o.sum((1, 2)), o.sum(2), o.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = o * np.log(o * total[:, None, None] / (rx[:, :, None] * ry[:, None, :]))
    return chi2_sf(2 * float(np.nansum(np.where(o > 0, part, 0.0))), dof)


def fisherz_test(corr: np.ndarray, n: int, x: int, y: int, s: tuple[int, ...]) -> float:
    """p of Fisher's z test of the partial correlation given s."""
    at = [x, y, *s]
    inv = np.linalg.pinv(corr[np.ix_(at, at)])
    scale = math.sqrt(abs(inv[0, 0] * inv[1, 1]))
    r = -inv[0, 1] / scale if scale > 0 else 0.0
    r = min(max(r, -LIMIT), LIMIT)
    z = math.sqrt(max(n - len(s) - 3, 0)) * 0.5 * math.log1p(2 * r / (1 - r))
    return math.erfc(abs(0.0 if math.isnan(z) else z) / math.sqrt(2))


def tester(data: np.ndarray, ci: str) -> Callable[[int, int, tuple[int, ...]], float]:
    """Independence test by name: gsq (also under ``gsq_rlib``), fisherz, fisherz_bin."""
    if ci in ("gsq", "gsq_rlib"):
        bits = (data > 0).astype(np.int64)
        return lambda x, y, s: gsq_test(bits, x, y, s)
    if ci not in ("fisherz", "fisherz_bin"):
        raise ValueError(f"unknown test {ci!r}")
    own = (data > 0).astype(float) if ci == "fisherz_bin" else data.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(np.atleast_2d(np.corrcoef(own, rowvar=False)))
    np.fill_diagonal(corr, 1.0)
    return lambda x, y, s: fisherz_test(corr, len(own), x, y, s)


# --- PC ---


def skeleton(n: int, test: Callable[[int, int, tuple[int, ...]], float], alpha: float = 0.01, method: str = "default", depth: int = -1) -> tuple[set[frozenset[int]], dict[frozenset[int], set[int]]]:
    """Adjacent pairs and separating sets (C16). ``stable`` looks at the neighbours as they were when the level began."""
    if method not in ("default", "stable"):
        raise ValueError(f"unknown method {method!r}")
    near = {v: set(range(n)) - {v} for v in range(n)}
    apart: dict[frozenset[int], set[int]] = {}
    level = 0
    while depth < 0 or level <= depth:
        seen = {v: sorted(near[v]) for v in near} if method == "stable" else None
        tested = False
        for x, y in itertools.permutations(range(n), 2):
            if y not in near[x]:
                continue
            others = [v for v in (seen[x] if seen else sorted(near[x])) if v != y]
            if len(others) < level:
                continue
            tested = True
            for s in itertools.combinations(others, level):
                if test(x, y, s) > alpha:
                    near[x].discard(y)
                    near[y].discard(x)
                    apart[frozenset((x, y))] = set(s)
                    break
        if not tested:
            break
        level += 1
    return {frozenset((a, b)) for a in near for b in near[a]}, apart


def orient(n: int, pairs: set[frozenset[int]], apart: dict[frozenset[int], set[int]]) -> set[tuple[int, int]]:
    """Directed edges of the pattern, undirected ones both ways: colliders, then three rules until nothing moves (C17)."""
    adj = {v: set() for v in range(n)}
    for p in pairs:
        a, b = sorted(p)
        adj[a].add(b)
        adj[b].add(a)
    arcs = {(a, b) for a in adj for b in adj[a]}
    for z in range(n):
        for x, y in itertools.combinations(sorted(adj[z]), 2):
            if y not in adj[x] and z not in apart.get(frozenset((x, y)), set()):
                if (x, z) in arcs and (y, z) in arcs:
                    arcs.discard((z, x))
                    arcs.discard((z, y))

    def one_way(a: int, b: int) -> bool:
        return (a, b) in arcs and (b, a) not in arcs

    def both_ways(a: int, b: int) -> bool:
        return (a, b) in arcs and (b, a) in arcs

    moved = True
    while moved:
        moved = False
        for b, c in sorted(arcs):
            if not both_ways(b, c):
                continue
            chain = any(one_way(a, b) and a not in adj[c] and a != c for a in adj[b])
            cycle = any(one_way(b, m) and one_way(m, c) for m in adj[b] & adj[c])
            mid = [m for m in adj[b] & adj[c] if both_ways(b, m) and one_way(m, c)]
            kite = any(d not in adj[e] for e, d in itertools.combinations(mid, 2))
            if chain or cycle or kite:
                arcs.discard((c, b))
                moved = True
    return arcs


def pc(cells: DataFrame, bins: int, *by: str, ci: str = "gsq", alpha: float = 0.01, method: str = "default", depth: int = -1, least_events: int = 3, max_events: int = 2000) -> DataFrame:
    """(by, src_eid, dst_eid): the causal graph of each group of sparse cells (by, eid, bin, cnt) (C11).

    Groups of fewer than ``least_events`` events have no edges. A group's events and occupied bins go to one task; a group of over
    ``max_events`` events is refused there rather than cut.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema) + ", src_eid int, dst_eid int"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        eids = np.sort(g["eid"].unique())
        empty = pd.DataFrame({**{c: [] for c in by}, "src_eid": [], "dst_eid": []})
        if len(eids) < least_events:
            return empty
        if len(eids) > max_events:
            raise ValueError(f"{len(eids)} events; max_events is {max_events}")
        data = np.zeros((bins, len(eids)))
        data[g["bin"].to_numpy(), np.searchsorted(eids, g["eid"].to_numpy())] = g["cnt"].to_numpy()
        own = data if ci == "fisherz" else data > 0
        varied = [v for v in range(len(eids)) if (own[:, v] != own[0, v]).any()]
        pairs, apart = skeleton(len(varied), tester(data[:, varied], ci), alpha, method, depth)
        arcs = sorted(orient(len(varied), pairs, apart))
        if not arcs:
            return empty
        out = {c: [g[c].iloc[0]] * len(arcs) for c in by}
        return pd.DataFrame({**out, "src_eid": [eids[varied[a]] for a, _ in arcs], "dst_eid": [eids[varied[b]] for _, b in arcs]})

    return cells.groupBy(*by).applyInPandas(run, schema)


def significant(pairs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Pairs that order 0 keeps."""
    return pairs.filter(F.col("g2") > CRITICAL[alpha])


def numbered_events(cells: DataFrame, *by: str) -> DataFrame:
    """(by, e, eid): dense numbers of the events of each group."""
    return cells.select(*by, "e").distinct().withColumn("eid", (F.row_number().over(Window.partitionBy(*by).orderBy("e")) - 1).cast("int"))
