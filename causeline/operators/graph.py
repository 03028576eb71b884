"""Causal graphs as edge tables.

``edge(term, src, dst)`` holds a directed edge once and an undirected one both ways round; src and dst are event keys:
structs of (gid, host), so that graphs of different terms compare. ``adjacency`` gives each adjacent pair once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key(gid: str = "gid", host: str = "host"):
    return F.struct(F.col(gid).alias("gid"), F.col(host).alias("host"))


def share(part, whole):
    """The quotient as a double; not a number for nothing of nothing, as in the SQL."""
    return F.when(whole != 0, part / whole).otherwise(float("nan"))


def adjacency(edges: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, directed, forward): unordered pairs, a < b (P15). forward: the edge a -> b is there."""
    by = by or ("term",)
    rows = edges.select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") <= F.col("dst")).alias("f")).distinct()
    out = rows.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.bool_or("f").alias("forward"))
    return out.withColumn("directed", F.col("n") == 1).drop("n")


def named(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(term, src_eid, dst_eid) with event keys."""
    s = events.select("term", F.col("eid").alias("src_eid"), key().alias("src"))
    d = events.select("term", F.col("eid").alias("dst_eid"), key().alias("dst"))
    return edges.join(s, ["term", "src_eid"]).join(d, ["term", "dst_eid"]).select("term", "src", "dst")


def nodes(edges: DataFrame) -> DataFrame:
    """Nodes that have an edge."""
    return edges.select("term", F.explode(F.array("src", "dst")).alias("node")).distinct()


def number_of_edges(edges: DataFrame) -> DataFrame:
    """Adjacent pairs of each graph."""
    return adjacency(edges).groupBy("term").agg(F.count(F.lit(1)).alias("n_edges"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, directed ones and ones across hosts of each graph."""
    n = nodes(edges).groupBy("term").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = adjacency(edges).groupBy("term").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("directed").alias("n_directed"), F.count_if(F.col("a.host") != F.col("b.host")).alias("n_across"))
    return n.join(e, "term")


def totals(edges: DataFrame) -> DataFrame:
    """Sums over all graphs with shares (A15); zeros, and a share that is not a number, if there are no edges."""
    n = graph_summary(edges).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_nodes", "n_edges", "n_directed", "n_across")])
    return n.withColumn("directed_share", share(F.col("n_directed"), F.col("n_edges")))


def touching(edges: DataFrame, gid: int) -> DataFrame:
    """Edges with an end in a group."""
    return edges.filter((F.col("src.gid") == gid) | (F.col("dst.gid") == gid))


def groups_on_edges(edges: DataFrame) -> DataFrame:
    """(gid, n_terms): groups on edges, and in how many graphs."""
    return edges.select("term", F.explode(F.array("src.gid", "dst.gid")).alias("gid")).distinct().groupBy("gid").agg(F.count(F.lit(1)).alias("n_terms"))


def type_changes(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges whose ends differ in event type or aren't normal (P17). ``types(term, node, type)``."""
    s = types.select("term", F.col("node").alias("src"), F.col("type").alias("src_type"))
    d = types.select("term", F.col("node").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(s, ["term", "src"]).join(d, ["term", "dst"]).withColumn("differs", F.col("src_type") != F.col("dst_type")).withColumn("filtered", (F.col("src_type") != 0) | (F.col("dst_type") != 0))


def complete_graph(n: int, spark) -> DataFrame:
    """All pairs i < j of n nodes."""
    return spark.range(n).select(F.col("id").alias("i")).withColumn("j", F.explode(F.when(F.col("i") < n - 1, F.sequence(F.col("i") + 1, F.lit(n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))))


# --- components, clustering, cliques ---


def connected(nodes_: DataFrame, links: DataFrame, *by: str) -> DataFrame:
    """(by, node, component): the smallest node reached (C19). ``nodes_(by, node)``, ``links(by, src, dst)``.

    Minimum labels spread over edges and jump to the label's label; each round is checkpointed, so that plans stay short.
    """
    from ..plans.checkpoint import cut

    both = cut(links.select(*by, F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(links.select(*by, F.col("dst").alias("x"), F.col("src").alias("y"))).distinct())
    label = nodes_.select(*by, "node").distinct().withColumn("component", F.col("node"))
    while True:
        seen = both.join(label.withColumnRenamed("node", "y"), [*by, "y"]).groupBy(*by, F.col("x").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(seen, [*by, "node"], "left").select(*by, "node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = new.select(*by, F.col("node").alias("low"), F.col("low").alias("lower"))
        new = cut(new.join(jump, [*by, "low"]).select(*by, "node", F.col("lower").alias("component"), (F.col("lower") != F.col("component")).alias("moved")))
        label = new.drop("moved")
        if not new.filter("moved").take(1):
            return label


def component_sizes(edges: DataFrame) -> DataFrame:
    """(term, size, n): how many components of each size a graph has."""
    sizes = connected(nodes(edges), edges, "term").groupBy("term", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("term", "size").agg(F.count(F.lit(1)).alias("n"))


def clustering(edges: DataFrame) -> DataFrame:
    """(term, coefficient): mean over nodes of triangles / possible ones; nodes of degree below 2 count 0 (C20)."""
    adj = adjacency(edges).select("term", "a", "b")
    both = adj.unionByName(adj.select("term", F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy("term", "a").agg(F.count(F.lit(1)).alias("deg"))
    # triangles a < b < c, found from their ordered edges
    tri = adj.alias("x").join(adj.alias("y"), (F.col("x.term") == F.col("y.term")) & (F.col("x.b") == F.col("y.a")))
    tri = tri.select(F.col("x.term").alias("term"), F.col("x.a").alias("a"), F.col("x.b").alias("m"), F.col("y.b").alias("b")).join(adj, ["term", "a", "b"])
    each = tri.select("term", F.explode(F.array("a", "m", "b")).alias("a")).groupBy("term", "a").agg(F.count(F.lit(1)).alias("tri"))
    one = F.when(F.col("deg") < 2, 0.0).otherwise(2.0 * F.coalesce("tri", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1)))
    return deg.join(each, ["term", "a"], "left").groupBy("term").agg(F.avg(one).alias("coefficient"))


def max_clique(edges: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """(term, size): the largest clique of each graph, by Bron and Kerbosch with pivots (C21). A graph is one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in zip(g["a"], g["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        if len(near) > max_nodes:
            raise ValueError(f"{len(near)} nodes; max_nodes is {max_nodes}")
        best, stack = 0, [(0, set(near), set())]
        while stack:
            size, p, x = stack.pop()
            if not p:
                best = max(best, size) if not x else best
                continue
            if size + len(p) <= best:
                continue
            pivot = max(p | x, key=lambda v: len(near[v] & p))
            for v in list(p - near[pivot]):
                stack.append((size + 1, p & near[v], x & near[v]))
                p = p - {v}
                x = x | {v}
        return pd.DataFrame({"term": [g["term"].iloc[0]], "size": [best]})

    flat = adjacency(edges)
    number = nodes(edges).withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy("node")))
    flat = flat.join(number.select("term", F.col("node").alias("a"), F.col("i").alias("ia")), ["term", "a"]).join(number.select("term", F.col("node").alias("b"), F.col("i").alias("ib")), ["term", "b"])
    return flat.select("term", F.col("ia").alias("a"), F.col("ib").alias("b")).groupBy("term").applyInPandas(run, "term long, size int")


# --- comparing graphs ---


def owned(edges: DataFrame, ignore_direction: bool) -> DataFrame:
    """Edges that a graph counts as its own: with the reverse ones, if direction is ignored."""
    own = edges.select("term", "src", "dst")
    return own.unionByName(edges.select("term", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if ignore_direction else own


def edge_idf(edges: DataFrame) -> DataFrame:
    """(a, b, df, idf): log2 of graphs over graphs with the pair."""
    n = edges.select("term").distinct().agg(F.count(F.lit(1)).alias("graphs"))
    df = adjacency(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("a", "b", "df", F.log2(F.col("graphs") / F.col("df")).alias("idf"))


def _weights(edges: DataFrame, weighted: bool) -> DataFrame:
    own = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    if not weighted:
        return own.withColumn("w", F.lit(1.0))
    return own.join(edge_idf(edges).select("a", "b", F.col("idf").alias("w")), ["a", "b"])


def similar_graphs(edges: DataFrame, ignore_direction: bool = True, weighted: bool = False) -> DataFrame:
    """(t1, t2, size1, size2, common1, common2, ged, mcs_ratio) for all ordered pairs of graphs.

    Graph edit distance: weight of edges of one graph that the other doesn't own. Ratio: mean size over the common part's,
    null if nothing is common; with ignored direction a common pair counts twice there. Graphs meet on shared edges; pairs that
    share none are filled in from the few graphs' sizes.
    """
    w = _weights(edges, weighted)
    size = w.groupBy("term").agg(F.sum("w").alias("size"))
    have = owned(edges, ignore_direction).select(F.col("term").alias("t2"), "src", "dst")
    common = w.join(have, ["src", "dst"]).groupBy(F.col("term").alias("t1"), "t2").agg(F.sum("w").alias("common"))
    adj = w.groupBy("term", "a", "b").agg(F.max("w").alias("w"))
    if ignore_direction:
        mine, theirs = adj.withColumnRenamed("term", "t1"), adj.select(F.col("term").alias("t2"), "a", "b")
        mcs = mine.join(theirs, ["a", "b"]).groupBy("t1", "t2").agg((2 * F.sum("w")).alias("mcs"))
    else:
        mcs = common.withColumnRenamed("common", "mcs")
    pairs = size.select(F.col("term").alias("t1"), F.col("size").alias("size1")).crossJoin(F.broadcast(size.select(F.col("term").alias("t2"), F.col("size").alias("size2"))))
    out = pairs.join(common.withColumnRenamed("common", "common1"), ["t1", "t2"], "left")
    out = out.join(common.select(F.col("t1").alias("t2"), F.col("t2").alias("t1"), F.col("common").alias("common2")), ["t1", "t2"], "left").join(mcs, ["t1", "t2"], "left")
    c1, c2 = F.coalesce("common1", F.lit(0.0)), F.coalesce("common2", F.lit(0.0))
    return out.select("t1", "t2", "size1", "size2", c1.alias("common1"), c2.alias("common2"), (F.col("size1") - c1 + F.col("size2") - c2).alias("ged"), F.when(F.col("mcs") > 0, (F.col("size1") + F.col("size2")) / (2 * F.col("mcs"))).alias("mcs_ratio"))


def nearest_graphs(edges: DataFrame, term: int, k: int = 20, by: str = "ged", ignore_direction: bool = True, weighted: bool = False) -> DataFrame:
    """The k graphs most like one (O3, C28); by ``ged`` or ``mcs_ratio``."""
    return similar_graphs(edges, ignore_direction, weighted).filter((F.col("t1") == term) & (F.col("t2") != term)).orderBy(F.col(by).asc_nulls_last(), "t2").limit(k)


def overlap(one: DataFrame, two: DataFrame, directed: bool | None = None, across_host: bool = False) -> DataFrame:
    """Common and all edges of two sets of graphs, with Jaccard, Dice and Simpson indices.

    directed: True only directed edges, False only undirected ones, None all as adjacent pairs. Indices of sets without edges aren't numbers.
    """

    def pick(e: DataFrame) -> DataFrame:
        adj = adjacency(e)
        if directed is not None:
            adj = adj.filter(F.col("directed") == directed)
        if across_host:
            adj = adj.filter(F.col("a.host") != F.col("b.host"))
        return adj.select("term", "a", "b", F.col("forward") if directed else F.lit(True).alias("forward")).distinct()

    both = pick(one).withColumn("x", F.lit(1)).join(pick(two).withColumn("y", F.lit(1)), ["term", "a", "b", "forward"], "full")
    n = both.agg(F.count("x").alias("n1"), F.count("y").alias("n2"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_common"), F.count(F.lit(1)).alias("n_all"))
    c = F.col("n_common")
    return n.select("*", share(c, F.col("n_all")).alias("jaccard"), share(2 * c, F.col("n1") + F.col("n2")).alias("dice"), share(c, F.least("n1", "n2")).alias("simpson"))


def common_edges(edges: DataFrame, t1: int, t2: int) -> DataFrame:
    """Edges of the first graph that the second has."""
    return _pick(edges, t1).join(_pick(edges, t2), ["src", "dst"], "left_semi")


def diff_edges(edges: DataFrame, t1: int, t2: int) -> DataFrame:
    return _pick(edges, t1).join(_pick(edges, t2), ["src", "dst"], "left_anti")


def common_subgraph(edges: DataFrame, t1: int, t2: int, ignore_direction: bool = True) -> DataFrame:
    """Adjacent pairs, or edges, of both graphs (T5)."""
    if not ignore_direction:
        return common_edges(edges, t1, t2)
    adj = adjacency(edges)
    return adj.filter(F.col("term") == t1).select("a", "b").intersect(adj.filter(F.col("term") == t2).select("a", "b"))


def _pick(edges: DataFrame, term: int) -> DataFrame:
    return edges.filter(F.col("term") == term).select("src", "dst")


def edges_on(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges that touch any of the events (T7). ``events(term, node)``."""
    out = [edges.join(events.select("term", F.col("node").alias(c)), ["term", c], "left_semi") for c in ("src", "dst")]
    return out[0].select("term", "src", "dst").unionByName(out[1].select("term", "src", "dst")).distinct()


# --- filters on edges ---


def edge_counts(edges: DataFrame, ignore_host: bool = False) -> DataFrame:
    """(k1, k2, n): in how many graphs a pair occurs (A21); with ``ignore_host`` pairs of groups, each pair of events counted."""
    adj = adjacency(edges)
    if ignore_host:
        adj = adj.withColumn("k1", F.least("a.gid", "b.gid")).withColumn("k2", F.greatest("a.gid", "b.gid"))
    else:
        adj = adj.withColumnsRenamed({"a": "k1", "b": "k2"})
    return adj.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))


def common_filter(counts: DataFrame, share: float) -> DataFrame:
    """Adds ``filtered``: at least as common as the pair at rank ``int(n * share)`` (W15). The rank is read from counts of counts."""
    by = counts.groupBy(F.col("n").alias("value")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("value"))
    ranks = by.withColumn("upto", F.sum("m").over(w)).withColumn("total", F.sum("m").over(Window.partitionBy(F.lit(0))))
    bound = ranks.filter(F.col("upto") > F.floor(F.col("total") * share)).agg(F.max("value").alias("bound"))
    most = by.agg((F.max("value") + 1).alias("above"))
    return counts.join(F.broadcast(bound.join(most).select(F.coalesce("bound", "above").alias("bound")))).withColumn("filtered", F.col("n") >= F.col("bound")).drop("bound")


def edge_runs(edges: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, first_term, length): runs of consecutive graphs that have a pair (W13), by gaps and islands."""
    adj = adjacency(edges, *by, "term")
    w = Window.partitionBy(*by, "a", "b").orderBy("term")
    runs = adj.withColumn("island", F.col("term") - F.row_number().over(w))
    return runs.groupBy(*by, "a", "b", "island").agg(F.min("term").alias("first_term"), F.count(F.lit(1)).alias("length")).drop("island")


def listing(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(term, line): ``src -> dst`` or ``a <-> b`` with labels if given."""
    adj = adjacency(edges)
    name = lambda c: F.concat(F.lit("[gid="), F.col(f"{c}.gid").cast("string"), F.lit(", host="), F.col(f"{c}.host"), F.lit("]"))
    x, y = name("a"), name("b")
    if labels is not None:
        for c in ("a", "b"):
            adj = adj.join(labels.select(F.col("ltgid").alias(f"{c}_gid"), F.coalesce("label", F.lit("none")).alias(f"{c}_label")), F.col(f"{c}.gid") == F.col(f"{c}_gid"), "left")
        x, y = F.concat(x, F.lit(" ("), "a_label", F.lit(")")), F.concat(y, F.lit(" ("), "b_label", F.lit(")"))
    line = F.when(~F.col("directed"), F.concat(x, F.lit(" <-> "), y)).when(F.col("forward"), F.concat(x, F.lit(" -> "), y)).otherwise(F.concat(y, F.lit(" -> "), x))
    return adj.select("term", line.alias("line"))


def run_lengths(edges: DataFrame, *by: str, ignore_host: bool = False) -> DataFrame:
    """(by, term, a, b, run): for how many graphs in a row, up to this one, a pair occurs.

    ``ignore_host``: a and b are groups, and a pair of groups goes on while any of its pairs of events occurs.
    """
    adj = adjacency(edges, *by, "term").select(*by, "term", "a", "b")
    if ignore_host:
        adj = adj.select(*by, "term", F.least("a.gid", "b.gid").alias("a"), F.greatest("a.gid", "b.gid").alias("b")).distinct()
    pair = Window.partitionBy(*by, "a", "b").orderBy("term")
    runs = adj.withColumn("__g", F.col("term") - F.row_number().over(pair))
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(*by, "a", "b", "__g").orderBy("term"))).drop("__g")


def run_filter(edges: DataFrame, threshold: int, *by: str, ignore_host: bool = False) -> DataFrame:
    """Run lengths with ``filtered``: at least so many graphs in a row."""
    return run_lengths(edges, *by, ignore_host=ignore_host).withColumn("filtered", F.col("run") >= threshold)


#: Methods by name (C26): (edges, threshold) -> counts or runs with ``filtered``.
EDGE_FILTERS = {
    "count": lambda e, th: common_filter(edge_counts(e), th),
    "count_ighost": lambda e, th: common_filter(edge_counts(e, ignore_host=True), th),
    "cont": lambda e, th: run_filter(e, int(th)),
    "cont_ighost": lambda e, th: run_filter(e, int(th), ignore_host=True),
}


def whole_component_sizes(edges: DataFrame) -> DataFrame:
    """(size, n) over all graphs."""
    return component_sizes(edges).groupBy("size").agg(F.sum("n").alias("n"))


def distance_matrix(distances: DataFrame, by: str = "ged") -> DataFrame:
    """(t1, t2, value) with the largest value where there is none: what a heat map shows."""
    most = distances.agg(F.max(by).alias("__most"))
    return distances.join(F.broadcast(most)).select("t1", "t2", F.coalesce(by, "__most").alias("value"))
