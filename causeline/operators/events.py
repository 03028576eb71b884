"""Events and their time bins (A8, A9, A18, A24, C31, P8-P12, W1-W8). Everything is sparse and long; only rows that occur exist."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch, from_epoch
from .ids import dense_ids

ORIGIN = dt.datetime(1970, 1, 1)
KEY = ("gid", "host")


def sec(t: dt.datetime) -> int:
    return int((t - ORIGIN).total_seconds())


def n_bins(top: dt.datetime, end: dt.datetime, size: int) -> int:
    """Bins of a range; the last may be short."""
    return -(-(sec(end) - sec(top)) // size)


def bin_of(ts: Column, top: dt.datetime, size: int) -> Column:
    return F.floor((epoch(ts) - sec(top)) / size).cast("long")


def in_range(ts: Column, top: dt.datetime, end: dt.datetime) -> Column:
    """Half open."""
    return (ts >= F.lit(str(top)).cast("timestamp_ntz")) & (ts < F.lit(str(end)).cast("timestamp_ntz"))


def terms(top: dt.datetime, end: dt.datetime, length: int, diff: int, spark) -> DataFrame:
    """(term, top_dt, end_dt): a term from every ``diff`` seconds while it starts before the end; the last may overrun."""
    n = -(-(sec(end) - sec(top)) // diff)
    start = F.lit(sec(top)) + F.col("id") * diff
    return spark.range(n).select(F.col("id").alias("term"), from_epoch(start).alias("top_dt"), from_epoch(start + length).alias("end_dt"))


def in_terms(log: DataFrame, top: dt.datetime, end: dt.datetime, length: int, diff: int) -> DataFrame:
    """Each row once for every term that holds it, by arithmetic on its time: no range join."""
    s = epoch(F.col("dt")) - sec(top)
    last = F.least(F.floor(s / diff), F.lit(-(-(sec(end) - sec(top)) // diff) - 1))
    first = F.greatest(F.floor((s - length) / diff) + 1, F.lit(0))
    return log.withColumn("term", F.explode(F.when((s >= 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def term_areas(log: DataFrame, areas: DataFrame | None, top: dt.datetime, end: dt.datetime, length: int, diff: int, mode: str = "all") -> DataFrame:
    """(term, area): jobs of the analysis; ``all``, ``each`` (host_X for the hosts of a term) or the named areas."""
    rows = in_terms(log, top, end, length, diff)
    if mode == "all":
        return rows.select("term", F.lit("all").alias("area")).distinct()
    if mode == "each":
        return rows.select("term", F.concat(F.lit("host_"), F.col("host")).alias("area")).distinct()
    return rows.select("term", "host").distinct().join(areas, "host").select("term", "area").distinct()


def event_groups(log: DataFrame, *by: str) -> DataFrame:
    """Lines of each event (gid, host), within ``by``."""
    return log.groupBy(*by, *KEY).agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def event_map(log: DataFrame, *by: str) -> DataFrame:
    """Dense event numbers from 0 by (gid, host) within ``by``."""
    events = log.select(*by, *KEY).distinct()
    if not by:
        return dense_ids(events, list(KEY), "eid")
    return events.withColumn("eid", (F.row_number().over(Window.partitionBy(*by).orderBy(*KEY)) - 1).cast("int"))


def remap(events: DataFrame, *by: str) -> DataFrame:
    """Surviving events numbered anew in their old order."""
    if not by:
        return dense_ids(events, ["eid"], "new_eid")
    return events.withColumn("new_eid", (F.row_number().over(Window.partitionBy(*by).orderBy("eid")) - 1).cast("int"))


def known_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """Lines of existing events only."""
    return log.join(events.select(*KEY).distinct(), list(KEY), "left_semi")


def binned(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int, method: str = "count", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Tumbling bins from the range's top (W2, W3): ``count``, ``binary`` or ``datetime`` (the sorted times)."""
    rows = log.filter(in_range(F.col("dt"), top, end)).withColumn("bin", bin_of(F.col("dt"), top, size))
    value = {"count": F.count(F.lit(1)), "binary": F.lit(1).cast("long"), "datetime": F.array_sort(F.collect_list("dt"))}[method]
    name = "times" if method == "datetime" else "cnt"
    if method == "binary":
        return rows.select(*keys, "bin").distinct().withColumn("cnt", value)
    return rows.groupBy(*keys, "bin").agg(value.alias(name))


def bin_labels(spark, top: dt.datetime, end: dt.datetime, size: int) -> DataFrame:
    """(bin, bin_dt)."""
    return spark.range(n_bins(top, end, size)).select(F.col("id").alias("bin"), from_epoch(F.lit(sec(top)) + F.col("id") * size).alias("bin_dt"))


def dense(cells: DataFrame, top: dt.datetime, end: dt.datetime, size: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Every bin of every event that occurs, zeros filled in."""
    n = n_bins(top, end, size)
    grid = cells.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return grid.join(cells, [*keys, "bin"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))


def sliding(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int, slide: int, binary: bool = False, keys: tuple[str, ...] = KEY, compat: bool = True) -> DataFrame:
    """Hop windows (W4): window i starts at top + i * slide and holds ``max(size // slide, 1)`` slide cells.

    Sparse: each cell is added to the windows that hold it. compat=False: a window holds exactly ``size`` seconds.
    """
    last = n_bins(top, end, slide) - 1
    if compat:
        w = max(size // slide, 1)
        cells = binned(log, top, end, slide, keys=keys)
        spread = cells.withColumn("win", F.explode(F.sequence(F.greatest(F.col("bin") - (w - 1), F.lit(0).cast("long")), F.col("bin"))))
    else:
        s = epoch(F.col("dt")) - sec(top)
        rows = log.filter(in_range(F.col("dt"), top, end)).withColumn("cnt", F.lit(1).cast("long"))
        spread = rows.withColumn("win", F.explode(F.sequence(F.greatest(F.floor((s - size) / slide) + 1, F.lit(0)), F.least(F.floor(s / slide), F.lit(last)))))
    out = spread.groupBy(*keys, F.col("win").alias("bin")).agg(F.sum("cnt").alias("cnt"))
    return out.withColumn("cnt", F.least("cnt", F.lit(1)).cast("long")) if binary else out


def event_stat(log: DataFrame, top: dt.datetime, end: dt.datetime, size: int, overlap: int = 0, binary: bool = False) -> DataFrame:
    """Tumbling bins, or hop windows that overlap."""
    if not overlap:
        return binned(log, top, end, size, "binary" if binary else "count")
    return sliding(log, top, end, size, size - overlap, binary)


def rebinned(cells: DataFrame, old: int, new: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Sums over runs of ``new // old`` bins."""
    return cells.groupBy(*keys, F.floor(F.col("bin") / (new // old)).cast("long").alias("bin")).agg(F.sum("cnt").alias("cnt"))


def long_enough(cells: DataFrame, least: int, term: int, size: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Events with enough lines over enough time between first and last occupied bin (P10)."""
    out = cells.filter("cnt > 0").groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))
    return out.filter((F.col("n") >= least) & ((F.col("last_bin") - F.col("first_bin")) * size >= term))


def long_enough_times(log: DataFrame, least: int, term: int) -> DataFrame:
    """The same on times."""
    out = event_groups(log).withColumn("span", epoch(F.col("last_dt")) - epoch(F.col("first_dt")))
    return out.filter((F.col("n") >= least) & (F.col("span") >= term))


def full_events(parts: DataFrame) -> DataFrame:
    """Times of each event over all terms; terms that overlap bring a line more than once."""
    return parts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dt").alias("n_times"))


def auto_binned(log: DataFrame, size: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Bins from the floor of the log's first time to the ceiling of its last, as sizes since midnight.

    The range is one row that the plan joins, so nothing is fetched first. Any size is a plain bin, one second too.
    """
    from ..functions.scalar import floor_time

    top = log.agg(epoch(floor_time(F.min("dt"), size)).alias("__top"))
    rows = log.join(F.broadcast(top)).withColumn("bin", F.floor((epoch(F.col("dt")) - F.col("__top")) / size).cast("long"))
    return rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
