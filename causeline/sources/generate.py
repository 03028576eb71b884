"""Synthetic logs from a definition (S17, S18), seeded and distributed: occurrences are columns, not loops."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import from_epoch
from ..operators.events import sec

MODES = ("each", "delay_rand", "drop_rand", "other_host_rand")


def poisson(spark: SparkSession, top: dt.datetime, end: dt.datetime, rate_per_day: float, seed: int = 0, series: int = 1) -> DataFrame:
    """(series, dt): exponential gaps until the end. A few more gaps than any run is likely to need are drawn, then cut at the end."""
    days = (sec(end) - sec(top)) / 86400
    mean = rate_per_day * days
    n = int(mean + 8 * mean**0.5 + 10)
    rows = spark.range(series).select(F.col("id").alias("series"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    gap = -F.log(1 - F.rand(seed)) * 86400 / rate_per_day
    w = Window.partitionBy("series").orderBy("k")
    return rows.withColumn("gap", gap).withColumn("s", F.sum("gap").over(w) + sec(top)).filter(F.col("s") < sec(end)).select("series", from_epoch(F.floor("s")).alias("dt"))


def uniform(spark: SparkSession, top: dt.datetime, end: dt.datetime, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(from_epoch(F.floor(F.rand(seed) * (sec(end) - sec(top)) + sec(top))).alias("dt"))


def regular(spark: SparkSession, top: dt.datetime, end: dt.datetime, every: int) -> DataFrame:
    """Hourly, daily or other fixed steps."""
    return spark.range(-(-(sec(end) - sec(top)) // every)).select(from_epoch(F.lit(sec(top)) + F.col("id") * every).alias("dt"))


def recurring(occurrences: DataFrame, probability: float, gap: int, most: int = 10, seed: int = 0) -> DataFrame:
    """Every occurrence may be followed by another after ``gap`` seconds, and so on with the same probability."""
    tries = F.array(*[F.rand(seed + k) for k in range(most)])
    n = F.aggregate(tries, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x < probability), 1).otherwise(0)).alias("n"), (a["on"] & (x < probability)).alias("on")), lambda a: a["n"])
    return occurrences.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k")).withColumn("dt", F.timestamp_add("SECOND", F.col("k") * gap, F.col("dt"))).drop("n", "k")


def messages(occurrences: DataFrame, hosts: list[str], formats: list[str], mode: str = "each", seed: int = 0, users: tuple[str, ...] = ("root", "admin"), interfaces: tuple[str, ...] = ("eth0", "eth1"), delay: int = 60, drop: float = 0.1) -> DataFrame:
    """(dt, host, message): each occurrence on a host, in every format, with $pid$ $host$ $ifname$ $user$ filled in."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.rand(seed + k) * len(xs)) + 1).cast("int"))
    out = occurrences.withColumn("host", pick(hosts, 1)).withColumn("fmt", F.explode(F.array(*map(F.lit, formats))))
    if mode == "delay_rand":
        out = out.withColumn("dt", F.timestamp_add("SECOND", F.floor(F.rand(seed + 2) * delay), F.col("dt")))
    elif mode == "drop_rand":
        out = out.filter(F.rand(seed + 3) >= drop)
    elif mode == "other_host_rand":
        out = out.withColumn("host", pick(hosts, 4))
    fill: dict[str, Column] = {"$pid$": F.floor(F.rand(seed + 5) * 30000 + 1).cast("string"), "$host$": F.col("host"), "$ifname$": pick(interfaces, 6), "$user$": pick(users, 7)}
    text = F.col("fmt")
    for k, v in fill.items():
        text = F.replace(text, F.lit(k), v)
    return out.select("dt", "host", text.alias("message"))
