"""The log model over the test tables: ``events`` seen as log lines, with templates, groups, areas, labels and graphs.

Each view is a DataFrame here and a DuckDB common table expression of the same rows in ``CTES``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import epoch, from_epoch
from ..operators import causal, events as ev

TOP, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
HOUR, DAY = 3600, 86400
TYPES = ("click", "error", "purchase", "signup", "view")
TERM_DAYS = 6
N_TERMS = 5

#: Ordered label rules: each regex has to match the start of some word.
RULES = [("trouble", ["error"]), ("again", ["retry", "1"]), ("money", ["(?i)PURCH"]), ("visit", ["click|view"])]
LABEL_GROUPS = {"trouble": "alarm", "again": "alarm", "money": "business"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, top: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """(lid, ltid, gid, dt, host, words). A range is also put on the raw time, where the scan can use it."""
    return log_of(table(spark, sf_dir, "events"), top, end)


def log_of(e: DataFrame, top: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """The same of a table or stream of events."""
    stamp = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    if top is not None:
        e = e.filter(F.col("ts") >= stamp(top))
    if end is not None:
        e = e.filter(F.col("ts") < stamp(end))
    gid = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(k)) for k, t in enumerate(TYPES[:-1])], F.lit(len(TYPES) - 1))
    host = F.concat(F.lit("host"), (F.col("user_id") % 10).cast("string"))
    text = F.concat(
        F.col("event_type"), F.lit(" user "), (F.col("user_id") % 7).cast("string"), F.lit(" value "), F.floor("value").cast("string"), F.lit(" from "), host,
        F.when(F.col("event_id") % 2 == 0, " ok").otherwise(" retry 1"),
    )
    return e.select(F.col("event_id").alias("lid"), (gid * 2 + F.col("event_id") % 2).cast("int").alias("ltid"), gid.cast("int").alias("gid"), from_epoch(epoch(F.col("ts"))).alias("dt"), host.alias("host"), F.split(text, " ").alias("words"))


def template_rows() -> list[tuple[int, list[str]]]:
    tail = (["ok"], ["retry", "1"])
    return [(2 * g + k, [t, "user", "**", "value", "**", "from", "**", *tail[k]]) for g, t in enumerate(TYPES) for k in (0, 1)]


def lt(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "ltid int, ltw array<string>")


def ltg(spark: SparkSession) -> DataFrame:
    return spark.range(2 * len(TYPES)).select(F.col("id").cast("int").alias("ltid"), F.floor(F.col("id") / 2).cast("int").alias("ltgid"))


def area(spark: SparkSession) -> DataFrame:
    h = spark.range(10).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("host"), F.concat(F.lit("area"), (F.col("id") % 3).cast("string")).alias("area"))
    return h.unionByName(spark.createDataFrame([("host0", "area1")], "host string, area string"))


def labels(spark: SparkSession) -> DataFrame:
    """(ltgid, label): a fixed labelling of groups."""
    return spark.createDataFrame([(0, "visit"), (1, "trouble"), (2, "money"), (4, "visit")], "ltgid int, label string")


def term_of(log_: DataFrame) -> DataFrame:
    """Log rows with their six-day term."""
    return log_.withColumn("term", F.floor((epoch(F.col("dt")) - ev.sec(TOP)) / (TERM_DAYS * DAY)).cast("long"))


def term_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, e, bin, cnt): hourly cells of events within terms; e is the struct of gid and host."""
    rows = term_of(log(spark, sf_dir, TOP, END)).withColumn("bin", F.floor((epoch(F.col("dt")) - ev.sec(TOP)) / HOUR) - F.col("term") * TERM_DAYS * 24)
    return rows.groupBy("term", F.struct("gid", "host").alias("e"), F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, src, dst): pairs that order 0 keeps; directed from the smaller if the groups' sum is odd, else undirected."""
    kept = causal.significant(causal.g_square_pairs(term_cells(spark, sf_dir), TERM_DAYS * 24, "term"))
    one, two = F.struct(F.col("e1").alias("src"), F.col("e2").alias("dst")), F.struct(F.col("e2").alias("src"), F.col("e1").alias("dst"))
    both = F.when((F.col("e1.gid") + F.col("e2.gid")) % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    return kept.select("term", F.explode(both).alias("x")).select("term", "x.*")


def name(c: str):
    """Display of an event key, as the SQL has it."""
    return F.concat(F.col(f"{c}.gid").cast("string"), F.lit(":"), F.col(f"{c}.host"))


_CASE = " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TYPES[:-1]))
_LT = ", ".join(f"({i}, {w})" for i, w in template_rows())

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "log": (
        f"""SELECT event_id AS lid, CAST(g * 2 + event_id % 2 AS INTEGER) AS ltid, CAST(g AS INTEGER) AS gid, date_trunc('second', ts) AS dt, 'host' || (user_id % 10) AS host,
        string_split(event_type || ' user ' || (user_id % 7) || ' value ' || CAST(floor(value) AS BIGINT) || ' from host' || (user_id % 10) || CASE WHEN event_id % 2 = 0 THEN ' ok' ELSE ' retry 1' END, ' ') AS words
        FROM (SELECT *, CASE event_type {_CASE} ELSE {len(TYPES) - 1} END AS g FROM events)""",
        (),
    ),
    "lt": (f"SELECT CAST(ltid AS INTEGER) AS ltid, ltw FROM (VALUES {_LT}) AS t(ltid, ltw)", ()),
    "ltg": ("SELECT CAST(i AS INTEGER) AS ltid, CAST(i // 2 AS INTEGER) AS ltgid FROM range(10) AS t(i)", ()),
    "area": ("SELECT 'host' || i AS host, 'area' || (i % 3) AS area FROM range(10) AS t(i) UNION ALL SELECT 'host0', 'area1'", ()),
    "labels": ("SELECT CAST(ltgid AS INTEGER) AS ltgid, label FROM (VALUES (0, 'visit'), (1, 'trouble'), (2, 'money'), (4, 'visit')) AS t(ltgid, label)", ()),
    "cells": ("SELECT gid, host, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 3600 AS bin, count(*) AS cnt FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31' GROUP BY ALL", ("log",)),
    "dense": ("SELECT k.gid, k.host, i AS bin, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM (SELECT DISTINCT gid, host FROM cells) k CROSS JOIN range(720) AS t(i) LEFT JOIN cells c ON c.gid = k.gid AND c.host = k.host AND c.bin = i", ("cells",)),
    "tcells": (
        "SELECT term, gid || ':' || host AS e, s // 3600 - term * 144 AS bin, count(*) AS cnt FROM (SELECT *, CAST(epoch(dt) AS BIGINT) - 1704067200 AS s, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 518400 AS term FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31') GROUP BY ALL",
        ("log",),
    ),
    "gsq": (
        """SELECT term, e1, e2, n1, n2, o, 2 * (
          CASE WHEN o > 0 THEN o * ln(o * t / (n1 * n2)) ELSE 0 END + CASE WHEN n1 - o > 0 THEN (n1 - o) * ln((n1 - o) * t / (n1 * (t - n2))) ELSE 0 END
          + CASE WHEN n2 - o > 0 THEN (n2 - o) * ln((n2 - o) * t / ((t - n1) * n2)) ELSE 0 END + CASE WHEN t - n1 - n2 + o > 0 THEN (t - n1 - n2 + o) * ln((t - n1 - n2 + o) * t / ((t - n1) * (t - n2))) ELSE 0 END) AS g2
        FROM (SELECT x.term, x.e AS e1, y.e AS e2, x.n AS n1, y.n AS n2, coalesce(b.o, 0) AS o, 144.0::DOUBLE AS t
          FROM (SELECT term, e, count(*) AS n FROM tcells GROUP BY ALL) x JOIN (SELECT term, e, count(*) AS n FROM tcells GROUP BY ALL) y ON x.term = y.term AND x.e < y.e
          LEFT JOIN (SELECT a.term, a.e AS e1, b.e AS e2, count(*) AS o FROM tcells a JOIN tcells b ON a.term = b.term AND a.bin = b.bin AND a.e < b.e GROUP BY ALL) b ON b.term = x.term AND b.e1 = x.e AND b.e2 = y.e)""",
        ("tcells",),
    ),
    "pairs": ("SELECT term, e1 AS a, e2 AS b, (CAST(e1[1] AS INTEGER) + CAST(e2[1] AS INTEGER)) % 2 = 1 AS directed FROM gsq WHERE g2 > 6.634896601021214", ("gsq",)),
    "edges": ("SELECT term, a AS src, b AS dst FROM pairs UNION ALL SELECT term, b, a FROM pairs WHERE NOT directed", ("pairs",)),
    "nodes": ("SELECT DISTINCT term, src AS node FROM edges UNION SELECT DISTINCT term, dst FROM edges", ("edges",)),
}


def sql(body: str, *needs: str) -> str:
    """The body with the views it needs in front."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in CTES[n][1]:
            add(m)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE ') :]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[len('WITH ') :]}"
    return f"WITH {head}\n{body}"
