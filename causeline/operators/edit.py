"""Template editing as rewrites of ``log.ltid`` and ``lt``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import WILDCARD, merge_template, variables
from .templates import fold_templates


def breakdown(log: DataFrame, lt: DataFrame, ltid: int | None = None, limit: int | None = None) -> DataFrame:
    """(ltid, vid, value, n, kinds): values of each variable, commonest first (A10)."""
    rows = log if ltid is None else log.filter(F.col("ltid") == ltid)
    each = rows.join(lt.select("ltid", "ltw"), "ltid").select("ltid", F.posexplode(variables(F.col("words"), F.col("ltw"))).alias("vid", "value"))
    n = each.groupBy("ltid", "vid", "value").agg(F.count(F.lit(1)).alias("n"))
    kinds = n.groupBy("ltid", "vid").agg(F.count(F.lit(1)).alias("kinds"))
    out = n.join(kinds, ["ltid", "vid"])
    if limit is not None:
        w = Window.partitionBy("ltid", "vid").orderBy(F.desc("n"), "value")
        out = out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
    return out


def stable_variables(log: DataFrame, lt: DataFrame, most: int) -> DataFrame:
    """(ltid, vid, kinds): variables with at most so many values."""
    each = log.join(lt.select("ltid", "ltw"), "ltid").select("ltid", F.posexplode(variables(F.col("words"), F.col("ltw"))).alias("vid", "value"))
    return each.distinct().groupBy("ltid", "vid").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") <= most)


def _recount(log: DataFrame, lt: DataFrame) -> DataFrame:
    n = log.groupBy("ltid").agg(F.count(F.lit(1)).alias("cnt"))
    return lt.drop("cnt").join(n, "ltid", "left").select("ltid", "ltw", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def merge(log: DataFrame, lt: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    """Lines of b go to a, whose template becomes both's merger; both are of one length."""
    one, two = (lt.filter(F.col("ltid") == k).select(F.col("ltw").alias(n)) for k, n in ((a, "one"), (b, "two")))
    both = one.join(two, F.size("one") == F.size("two")).select(F.lit(a).cast("int").alias("ltid"), merge_template(F.col("one"), F.col("two")).alias("ltw"))
    rows = log.withColumn("ltid", F.when(F.col("ltid") == b, F.lit(a)).otherwise(F.col("ltid")).cast("int"))
    return rows, _recount(rows, lt.filter(~F.col("ltid").isin(a, b)).select("ltid", "ltw").unionByName(both))


def separate(log: DataFrame, lt: DataFrame, ltid: int, vid: int, value: str, new: int) -> tuple[DataFrame, DataFrame]:
    """Lines whose variable has the value go to a new template; both templates are folded anew."""
    tpl = lt.filter(F.col("ltid") == ltid).select("ltid", "ltw")
    marked = log.join(F.broadcast(tpl), "ltid", "left")
    hit = (F.col("ltid") == ltid) & (F.try_element_at(variables(F.col("words"), F.col("ltw")), F.lit(vid + 1)) == value)
    rows = marked.withColumn("ltid", F.when(hit, F.lit(new)).otherwise(F.col("ltid")).cast("int")).drop("ltw")
    return rows, _refold(rows, lt, [ltid, new])


def split(log: DataFrame, lt: DataFrame, ltid: int, vid: int, first_new: int) -> tuple[DataFrame, DataFrame]:
    """A template for each value of a variable, numbered by value from ``first_new``; the old one goes."""
    tpl = lt.filter(F.col("ltid") == ltid).select("ltid", "ltw")
    marked = log.join(F.broadcast(tpl), "ltid", "left").withColumn("__v", F.when(F.col("ltid") == ltid, F.try_element_at(variables(F.col("words"), F.col("ltw")), F.lit(vid + 1))))
    values = marked.filter("__v is not null").select("__v").distinct()
    values = values.withColumn("__new", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__v")) - 1 + first_new).cast("int"))
    rows = marked.join(values, "__v", "left").withColumn("ltid", F.coalesce("__new", "ltid")).drop("__v", "__new", "ltw")
    own = rows.join(values.select(F.col("__new").alias("ltid")), "ltid", "left_semi")
    kept = lt.filter(F.col("ltid") != ltid).select("ltid", "ltw")
    return rows, _recount(rows, kept.unionByName(fold_templates(own, "ltid")))


def _refold(rows: DataFrame, lt: DataFrame, ltids: list[int]) -> DataFrame:
    kept = lt.filter(~F.col("ltid").isin(ltids)).select("ltid", "ltw")
    return _recount(rows, kept.unionByName(fold_templates(rows.filter(F.col("ltid").isin(ltids)), "ltid")))


def fix(log: DataFrame, lt: DataFrame, ltid: int, vids: list[int]) -> DataFrame:
    """Variables of one value become that word."""
    values = breakdown(log, lt, ltid).filter((F.col("kinds") == 1) & F.col("vid").isin(vids)).select("vid", "value")
    spots = lt.filter(F.col("ltid") == ltid).select("ltid", F.posexplode("ltw").alias("pos", "w"))
    number = F.sum(F.when(F.col("w") == WILDCARD, 1).otherwise(0)).over(Window.partitionBy("ltid").orderBy("pos")) - 1
    spots = spots.withColumn("vid", F.when(F.col("w") == WILDCARD, number)).join(F.broadcast(values), "vid", "left")
    new = spots.groupBy("ltid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", "w").alias("w")))).alias("ws")).select("ltid", F.transform("ws", lambda x: x["w"]).alias("ltw"))
    return _recount(log, lt.filter(F.col("ltid") != ltid).select("ltid", "ltw").unionByName(new))


def free(log: DataFrame, lt: DataFrame, ltid: int, positions: list[int]) -> DataFrame:
    """Words at the positions become variables."""
    at = F.array(*map(F.lit, positions))
    new = F.transform("ltw", lambda w, i: F.when(F.array_contains(at, i), WILDCARD).otherwise(w))
    return _recount(log, lt.select("ltid", F.when(F.col("ltid") == ltid, new).otherwise(F.col("ltw")).alias("ltw")))
