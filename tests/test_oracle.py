"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from causeline.operators import graph
from causeline.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def flat(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    cur = con.execute(q.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    theirs = sorted(repr([flat(dict(zip(cols, r))[c]) for c in order]) for r in cur.fetchall())
    ours = sorted(repr([flat(r[c]) for c in order]) for r in got.collect())
    assert ours == theirs


#: No event of the given tables is periodic by minutes in a day or by hours in a week; tests of the operator have some.
EMPTY = {"fourier_windows"}


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_others_give_the_same_rows_again(spark, name):
    """Rows, no nulls in their keys, and the same ones however the table is dealt."""
    rows = lambda: sorted(repr([flat(r[c]) for c in sorted(r.asDict())]) for r in q.QUERIES[name](spark, SF).collect())
    once = rows()
    assert bool(once) != (name in EMPTY)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["edge_overlap_stats", "graph_totals", "edge_label_total"])
def test_same_rows_without_edges(spark, tmp_path, name):
    """One event has no partner, so that the graphs are empty, as they are where all events happen in every hour."""
    spark.read.parquet(f"{SF}/events.parquet").limit(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(q.SQL[name])
    cols = [x[0] for x in cur.description]
    assert [repr([abs(r[x]) if isinstance(r[x], float) else r[x] for x in cols]) for r in q.QUERIES[name](spark, str(tmp_path)).collect()] == [repr([abs(x) if isinstance(x, float) else x for x in r]) for r in cur.fetchall()]


def test_overlap_of_one_empty_set(spark):
    edges = spark.createDataFrame([(0, (0, "a"), (0, "b"))], "term long, src struct<gid:int,host:string>, dst struct<gid:int,host:string>")
    o = graph.overlap(edges, edges.filter("false")).first()
    assert (o.n1, o.n2, o.n_common, o.n_all, o.jaccard, o.dice) == (1, 0, 0, 1, 0, 0) and math.isnan(o.simpson)


def test_overlap_reads_events_once(spark):
    """Both sides come from edges that were made before, not from the events each."""
    assert "parquet" not in q.QUERIES["edge_overlap_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
