"""Blocks of events: TF-IDF and cosine search, event-set differences, filter effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import KEY


def tfidf(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, gid, host, w): share of an event in its block times log2 of blocks over blocks that have it."""
    n = blocks.select(*by).distinct().agg(F.count(F.lit(1)).alias("blocks"))
    df = blocks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("df"))
    total = blocks.groupBy(*by).agg(F.sum("n").alias("total"))
    out = blocks.join(total, list(by)).join(df, list(KEY)).join(F.broadcast(n))
    return out.select(*by, *KEY, (F.col("n") / F.col("total") * F.log2(F.col("blocks") / F.col("df"))).alias("w"))


def cosine(weights: DataFrame, by: str, block=None) -> DataFrame:
    """(a, b, cosine) of ordered pairs of blocks that share an event, over the first one's events.

    Pairs that share none have cosine 0 and no row. ``block``: only pairs whose first block is this one.
    """
    source = weights if block is None else weights.filter(F.col(by) == block)
    a = source.select(F.col(by).alias("a"), *KEY, F.col("w").alias("wa"))
    b = weights.select(F.col(by).alias("b"), *KEY, F.col("w").alias("wb"))
    norm = a.groupBy("a").agg(F.sqrt(F.sum(F.col("wa") * F.col("wa"))).alias("na"))
    dots = a.join(b, list(KEY)).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sqrt(F.sum(F.col("wb") * F.col("wb"))).alias("nb"))
    value = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0)
    return dots.join(norm, "a").select("a", "b", value.alias("cosine"))


def nearest_blocks(weights: DataFrame, block, k: int = 20, by: str = "term", spans: DataFrame | None = None) -> DataFrame:
    """The k blocks most like one (C28). With ``spans(by, top_dt, end_dt)`` blocks that overlap it in time are left out (P20)."""
    out = cosine(weights, by, block).filter(F.col("b") != block)
    if spans is not None:
        own = spans.filter(F.col(by) == block).select(F.col("top_dt").alias("t0"), F.col("end_dt").alias("e0"))
        other = spans.select(F.col(by).alias("b"), "top_dt", "end_dt")
        out = out.join(other, "b").join(F.broadcast(own)).filter(~((F.col("end_dt") > F.col("t0")) & (F.col("top_dt") < F.col("e0")))).drop("top_dt", "end_dt", "t0", "e0")
    return out.orderBy(F.desc(F.round("cosine", 9)), "b").limit(k)


def only_in_first(one: DataFrame, two: DataFrame, *by: str) -> DataFrame:
    """(gid, host, n): in how many blocks an event is in the first set only."""
    left = one.select(*by, *KEY).distinct().join(two.select(*by, *KEY).distinct(), [*by, *KEY], "left_anti")
    return left.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def filter_effect(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """Per block: events before, left as they were, replaced (type 3) and removed."""
    a = before.select(*by, *KEY).distinct()
    b = after.groupBy(*by, *KEY).agg(F.max((F.col("type") == 3).cast("int")).alias("rep"))
    both = a.join(b, [*by, *KEY], "left")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(F.col("rep") == 0).alias("n_left"), F.count_if(F.col("rep") == 1).alias("n_replaced"), F.count_if(F.col("rep").isNull()).alias("n_removed"))


def head_and_foot(log: DataFrame, head: int, foot: int, *by: str) -> DataFrame:
    """First and last lines of each group by time; all of them if they are no more than both together.

    Both ends are row-number limits, which Spark applies before its shuffle, so that no group is sorted in one place.
    """
    first = Window.partitionBy(*by).orderBy("dt", "lid")
    last = Window.partitionBy(*by).orderBy(F.desc("dt"), F.desc("lid"))
    rows = log.select(*by, "lid", "dt")
    ends = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= head).drop("r")
    ends = ends.union(rows.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= foot).drop("r")).distinct()
    return ends.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), list(by))


def nulls_last(df: DataFrame, column: str, descending: bool = False, none_last: bool = True) -> DataFrame:
    """Sorted with nulls last, or first (O2)."""
    c = F.col(column)
    order = (c.desc_nulls_last() if none_last else c.desc_nulls_first()) if descending else (c.asc_nulls_last() if none_last else c.asc_nulls_first())
    return df.orderBy(order)


def replaced_events(events: DataFrame) -> DataFrame:
    """Events that stand for the remainder of a periodic one."""
    return events.filter(F.col("type") == 3)


def search_event(events: DataFrame, gid: int, host: str) -> DataFrame:
    """Definitions of one event."""
    return events.filter((F.col("gid") == gid) & (F.col("host") == host))


def aligned(one: DataFrame, two: DataFrame, *by: str) -> DataFrame:
    """(by, state): whether a result is in both sets, or only in the first or second."""
    a, b = one.select(*by).distinct().withColumn("__a", F.lit(1)), two.select(*by).distinct().withColumn("__b", F.lit(1))
    state = F.when(F.col("__b").isNull(), "first").when(F.col("__a").isNull(), "second").otherwise("both")
    return a.join(b, list(by), "full").withColumn("state", state).drop("__a", "__b")


def labelled_difference(one: DataFrame, two: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """(label, n_events, n): events of the first set only, by label."""
    own = labels.select(F.col("ltgid").alias("gid"), "label")
    return only_in_first(one, two, *by).join(own, "gid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n").alias("n"))
