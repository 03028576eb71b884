"""Periodicity and trend statistics of events (W9-W12, C2, C10, P12). Windows run within one event."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch
from .events import KEY, bin_of, dense, in_range, n_bins


def intervals(log: DataFrame, threshold: float) -> DataFrame:
    """Regular events: gaps with std / mean below the threshold; ``interval_s`` is their truncated median.

    Only events with more than two lines are tested; mean 0 is not regular.
    """
    out = gaps(log).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    regular = (F.col("mean_gap") != 0) & (F.col("std_gap") / F.col("mean_gap") < threshold)
    return out.filter("n > 2").withColumn("interval_s", F.when(regular, F.col("median_gap").cast("long")))


def gaps(log: DataFrame, chunk: int = 3600) -> DataFrame:
    """(gid, host, gap): seconds since the event's line before, null for its first.

    Lines are ordered within hours only; an hour's first line looks at the last time of the event's hour before, so that a very
    frequent event is spread over tasks.
    """
    rows = log.select(*KEY, "lid", epoch(F.col("dt")).alias("s")).withColumn("c", F.floor(F.col("s") / chunk))
    last = rows.groupBy(*KEY, "c").agg(F.max("s").alias("last"))
    last = last.withColumn("prev", F.lag("last").over(Window.partitionBy(*KEY).orderBy("c"))).drop("last")
    own = rows.withColumn("near", F.lag("s").over(Window.partitionBy(*KEY, "c").orderBy("s", "lid")))
    first = own.filter("near is null").join(last, [*KEY, "c"]).select(*KEY, (F.col("s") - F.col("prev")).alias("gap"))
    return own.filter("near is not null").select(*KEY, (F.col("s") - F.col("near")).alias("gap")).unionByName(first)


def linearity(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int) -> DataFrame:
    """How far the cumulative count is from a straight line: sum((C_k - (k+1) n / B)^2) / (B n).

    Closed form over the steps of C: between occupied bins C is constant, and sums of k and k^2 have formulas, so
    the cost follows the lines, not the bins.
    """
    b = n_bins(top, end, size)
    rows = log.filter(in_range(F.col("dt"), top, end)).withColumn("bin", bin_of(F.col("dt"), top, size))
    cells = rows.groupBy(*KEY, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    by = Window.partitionBy(*KEY).orderBy("bin")
    whole = Window.partitionBy(*KEY)
    steps = cells.select(*KEY, "bin", F.sum("cnt").over(by).alias("c"), F.lead("bin", 1, b).over(by).alias("next"), F.sum("cnt").over(whole).alias("n"), F.row_number().over(by).alias("r"))
    # sums over j = bin + 1 .. next (that is k + 1) of 1, j and j^2
    s1 = lambda x: x * (x + 1) / 2
    s2 = lambda x: x * (x + 1) * (2 * x + 1) / 6
    lo, hi = F.col("bin").cast("double"), F.col("next").cast("double")
    slope = F.col("n") / F.lit(float(b))
    part = F.col("c") * F.col("c") * (hi - lo) - 2 * F.col("c") * slope * (s1(hi) - s1(lo)) + slope * slope * (s2(hi) - s2(lo))
    before = F.when(F.col("r") == 1, slope * slope * s2(lo)).otherwise(0.0)
    return steps.groupBy(*KEY).agg(F.max("n").alias("n"), (F.sum(part + before) / (F.lit(float(b)) * F.max("n"))).alias("val"))


def linear_events(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int = 10, least: int = 10, threshold: float = 0.5) -> DataFrame:
    """Events that the linear filter removes."""
    return linearity(log, top, end, size).filter((F.col("n") >= least) & (F.col("val") < threshold))


def without(log: DataFrame, events: DataFrame) -> DataFrame:
    """Lines of all other events."""
    return log.join(events.select(*KEY), list(KEY), "left_anti")


def self_correlation(cells: DataFrame, top: dt.datetime, end: dt.datetime, size: int, lag: int) -> DataFrame:
    """Correlation of each event's dense series with itself ``lag`` seconds later; 0 where the series is too short."""
    k, b = lag // size, n_bins(top, end, size)
    full = dense(cells, top, end, size)
    if b <= 2 * k:
        return full.select(*KEY).distinct().withColumn("corr", F.lit(0.0))
    w = Window.partitionBy(*KEY).orderBy("bin")
    pairs = full.withColumn("later", F.lead("cnt", k).over(w)).filter("later is not null")
    # a constant series has no correlation
    return pairs.groupBy(*KEY).agg(F.corr("cnt", "later").alias("corr"))


def correlated_events(cells: DataFrame, top: dt.datetime, end: dt.datetime, size: int, lags: list[int], threshold: float) -> DataFrame:
    """The best lag of each event, and whether it makes the event periodic."""
    out = None
    for lag in lags:
        one = self_correlation(cells, top, end, size, lag).withColumn("lag_s", F.lit(lag).cast("long"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(*KEY).agg(F.max("corr").alias("best_corr"), F.max_by("lag_s", F.struct("corr", -F.col("lag_s"))).alias("best_lag"))
    return best.withColumn("periodic", F.coalesce(F.col("best_corr") >= threshold, F.lit(False)))


def periodic_events(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int, gap_threshold: float, corr_threshold: float, least: int, term: int) -> DataFrame:
    """Legacy detector: regular gaps confirmed by the correlation at that gap (C10). Returns gid, host, interval_s, corr."""
    from .events import binned, long_enough_times

    regular = intervals(log.filter(in_range(F.col("dt"), top, end)), gap_threshold).filter("interval_s is not null")
    regular = regular.join(long_enough_times(log, least, term).select(*KEY), list(KEY), "left_semi").select(*KEY, "interval_s")
    full = dense(binned(log, top, end, size), top, end, size).join(regular, list(KEY))
    k = F.greatest(F.floor(F.col("interval_s") / size), F.lit(1))
    a = full.select(*KEY, "interval_s", "bin", "cnt", (F.col("bin") + k).alias("to"))
    b = full.select(*KEY, F.col("bin").alias("to"), F.col("cnt").alias("later"))
    return a.join(b, [*KEY, "to"]).groupBy(*KEY, "interval_s").agg(F.corr("cnt", "later").alias("corr")).filter(F.col("corr") >= corr_threshold)
