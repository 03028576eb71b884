"""Likeness of events by the values of their variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import variables


def variable_counts(log: DataFrame, lt: DataFrame) -> DataFrame:
    """(gid, host, ltid, vid, value, n) (A23). ``log`` has gid."""
    each = log.join(lt.select("ltid", "ltw"), "ltid").select("gid", "host", "ltid", F.posexplode(variables(F.col("words"), F.col("ltw"))).alias("vid", "value"))
    return each.groupBy("gid", "host", "ltid", "vid", "value").agg(F.count(F.lit(1)).alias("n"))


def similarity(counts: DataFrame) -> DataFrame:
    """Best pair of variables for each pair of events that share a value.

    tf: mean of the shares that the value has in both variables; idf: log2 of events over events with the value;
    similarity: sum of tf * idf over common values / size of the values' union. The join is on values, never on all pairs.
    """
    var = ["gid", "host", "ltid", "vid"]
    whole = Window.partitionBy(*var)
    own = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("size", F.count(F.lit(1)).over(whole))
    events = counts.select("gid", "host").distinct().agg(F.count(F.lit(1)).alias("events"))
    df = counts.select("gid", "host", "value").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(events)).select("value", F.log2(F.col("events") / F.col("df")).alias("idf"))
    own = own.join(idf, "value").filter("idf > 0")  # a value of all events adds nothing
    side = lambda p: own.select("value", *[F.col(c).alias(p + c) for c in (*var, "share", "size")], *(["idf"] if p == "a_" else []))
    a, b = side("a_"), side("b_")
    before = F.struct("a_gid", "a_host") < F.struct("b_gid", "b_host")
    keys = [p + c for p in ("a_", "b_") for c in var]
    pairs = a.join(b, "value").filter(before).groupBy(*keys).agg(
        F.sum((F.col("a_share") + F.col("b_share")) / 2 * F.col("idf")).alias("score"), F.count(F.lit(1)).alias("common"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size")
    )
    # the union is over all values; those of all events, which would pair everything, are met only in pairs that share another one
    every = counts.join(idf.filter("idf <= 0").select("value"), "value").groupBy(*var).agg(F.collect_set("value").alias("all"))
    for p in ("a_", "b_"):
        pairs = pairs.join(every.select(*[F.col(c).alias(p + c) for c in var], F.col("all").alias(p + "all")), [p + c for c in var], "left")
    more = F.coalesce(F.size(F.array_intersect("a_all", "b_all")), F.lit(0))
    pairs = pairs.withColumn("common", F.col("common") + F.greatest(more, F.lit(0))).withColumn("sim", F.col("score") / (F.col("a_size") + F.col("b_size") - F.col("common")))
    best = Window.partitionBy("a_gid", "a_host", "b_gid", "b_host").orderBy(F.desc(F.round("sim", 9)), "a_ltid", "a_vid", "b_ltid", "b_vid")
    return pairs.withColumn("r", F.row_number().over(best)).filter("r = 1").select(*keys, "sim", "common")


def value_sets(counts: DataFrame, a: tuple[int, str], b: tuple[int, str], limit: int | None = 5) -> DataFrame:
    """Common values, and values of one event alone (T6, O5). Bounded by the two events' values."""
    sets = counts.filter(((F.col("gid") == a[0]) & (F.col("host") == a[1])) | ((F.col("gid") == b[0]) & (F.col("host") == b[1])))
    both = sets.agg(
        F.array_sort(F.collect_set(F.when((F.col("gid") == a[0]) & (F.col("host") == a[1]), F.col("value")))).alias("va"),
        F.array_sort(F.collect_set(F.when((F.col("gid") == b[0]) & (F.col("host") == b[1]), F.col("value")))).alias("vb"),
    )
    cut = (lambda c: F.slice(c, 1, limit)) if limit else (lambda c: c)
    return both.select(
        cut(F.array_sort(F.array_intersect("va", "vb"))).alias("common"), cut(F.array_sort(F.array_except("va", "vb"))).alias("only_a"), cut(F.array_sort(F.array_except("vb", "va"))).alias("only_b"), F.size(F.array_union("va", "vb")).alias("n_union")
    )
