"""The log store: four tables (log, lt, ltg, area) as Parquet or any DataFrames.

``log(lid, ltid, dt, host, words)`` is large and partitioned by day; ``lt(ltid, ltw, lts, cnt)``, ``ltg(ltid, ltgid)`` and
``area(host, area)`` are dimensions. Filters and column choice stay in the plan, so that scans prune.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_time, from_epoch, restore_message

SCHEMAS = {
    "log": "lid long, ltid int, dt timestamp_ntz, host string, words array<string>",
    "lt": "ltid int, ltw array<string>, lts array<string>, cnt long",
    "ltg": "ltid int, ltgid int",
    "area": "host string, area string",
}
ALL = "all"


@dataclass
class LogStore:
    log: DataFrame
    lt: DataFrame
    ltg: DataFrame
    area: DataFrame
    path: str | None = None

    # --- Parquet ---

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> LogStore:
        """Empty tables (K1)."""
        for name, schema in SCHEMAS.items():
            empty = spark.createDataFrame([], schema)
            w = (empty.withColumn("day", F.to_date("dt")).write.partitionBy("day") if name == "log" else empty.write).mode("overwrite")
            w.parquet(f"{path}/{name}")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LogStore:
        for n in SCHEMAS:
            _finish(spark, f"{path}/{n}")
        read = lambda n: spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}")
        return cls(read("log"), read("lt"), read("ltg"), read("area"), path)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: dict[str, str], separator: str = "@@") -> LogStore:
        """Tables of a database that Spark has a driver for; words and separators are joined texts there."""
        t = {n: spark.read.jdbc(url, n, properties=properties) for n in SCHEMAS}
        log = t["log"].withColumn("words", F.split("words", separator)).withColumn("dt", F.col("dt").cast("timestamp_ntz"))
        lt = t["lt"].select("ltid", F.split("ltw", separator).alias("ltw"), F.split("lts", separator).alias("lts"), F.col("count").cast("long").alias("cnt"))
        return cls(log, lt, t["ltg"], t["area"].select("host", "area"))

    def append(self, rows: DataFrame) -> None:
        """Add log rows, files for each day, of which a large day gets several (K2)."""
        rows.select(*[c.split(" ")[0] for c in SCHEMAS["log"].split(", ")]).withColumn("day", F.to_date("dt")).hint("rebalance", "day").sortWithinPartitions("ltid", "host").write.mode("append").partitionBy("day").parquet(f"{self.path}/log")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put rows in a table's place (K4, K5); they may come from the table itself. The old table goes when the new one is whole."""
        rows = rows.withColumn("day", F.to_date("dt")) if name == "log" else rows
        at = f"{self.path}/{name}"
        (rows.write.partitionBy("day") if name == "log" else rows.write).mode("overwrite").parquet(f"{at}{_NEW}")
        _finish(rows.sparkSession, at)

    def anonymise(self) -> None:
        """Take the words out of the stored log (K6)."""
        self.replace("log", anonymise(self.log))

    # --- scans ---

    def lines(self, lid=None, ltid=None, ltgid=None, top: dt.datetime | None = None, end: dt.datetime | None = None, host: str | None = None, area: str | None = None) -> DataFrame:
        """Log rows under all given conditions (S7, P1-P4, J2, J3). At least one is needed; area ``host_X`` means host X, ``all`` none."""
        given = {"lid": lid, "ltid": ltid, "ltgid": ltgid, "top": top, "end": end, "host": host, "area": area}
        if all(v is None for v in given.values()):
            raise ValueError("no condition")
        if area == ALL:
            area = None
        elif area is not None and area.startswith("host_"):
            host, area = host or area[len("host_") :], None
        return select(self.log, self.ltg, self.area, lid=lid, ltid=ltid, ltgid=ltgid, top=top, end=end, host=host, area=area)

    def words(self, **conditions) -> DataFrame:
        """Word lists only."""
        if not any(v is not None for v in conditions.values()):
            raise ValueError("no condition")
        return select(self.log, self.ltg, self.area, **conditions).select("words")

    def templates(self) -> DataFrame:
        """Templates with their groups."""
        return self.lt.join(self.ltg, "ltid", "left")

    def messages(self) -> DataFrame:
        """Log rows with template, group and restored message."""
        return self.log.join(self.templates(), "ltid").withColumn("message", restore_message(F.col("words"), F.col("lts")))

    # --- dimensions ---

    def group_rows(self) -> DataFrame:
        """Each group: templates, lines, members."""
        return self.lt.join(self.ltg, "ltid").groupBy("ltgid").agg(F.count(F.lit(1)).alias("n_templates"), F.sum("cnt").alias("n_lines"), F.array_sort(F.collect_list("ltid")).alias("members"))

    def with_counts(self) -> LogStore:
        """Template counts as the log has them."""
        n = self.log.groupBy("ltid").agg(F.count(F.lit(1)).alias("n"))
        lt = self.lt.drop("cnt").join(n, "ltid", "left").select("ltid", "ltw", "lts", F.coalesce("n", F.lit(0)).alias("cnt"))
        return LogStore(self.log, lt, self.ltg, self.area, self.path)


_NEW = "__new"


def _finish(spark: SparkSession, at: str) -> None:
    """If a new form of the table was written in full beside it, put it in its place."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = path(at + _NEW), path(at)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(new) and not fs.exists(path(f"{at}{_NEW}/_temporary")):
        fs.delete(old, True)
        fs.rename(new, old)


def select(log: DataFrame, ltg: DataFrame | None = None, areas: DataFrame | None = None, lid=None, ltid=None, ltgid=None, top=None, end=None, host=None, area=None) -> DataFrame:
    out = log
    for name, value in (("lid", lid), ("ltid", ltid), ("host", host)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    stamp = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    if top is not None:
        out = out.filter(F.col("dt") >= stamp(top))
    if end is not None:
        out = out.filter(F.col("dt") < stamp(end))
    if ltgid is not None:
        out = out.join(ltg.filter(F.col("ltgid") == ltgid).select("ltid"), "ltid", "left_semi")
    if area is not None:
        out = out.join(areas.filter(F.col("area") == area).select("host"), "host", "left_semi")
    return out


def update(log: DataFrame, condition, values: dict) -> DataFrame:
    """Rows under the condition with new values (K3)."""
    return log.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(log: DataFrame, condition) -> DataFrame:
    """Rows that the condition isn't true of (K4)."""
    return log.filter(~F.coalesce(condition, F.lit(False)))


def anonymise(log: DataFrame) -> DataFrame:
    """No words (K6)."""
    return log.withColumn("words", F.array().cast("array<string>"))


def newer(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows not older than the log's latest (P6); all of them if the log is empty."""
    last = log.agg(F.max("dt").alias("__last"))
    return rows.join(F.broadcast(last), F.col("__last").isNull() | (rows["dt"] >= F.col("__last"))).drop("__last")


# --- aggregates ---


def count_lines(log: DataFrame) -> DataFrame:
    """The true count and the largest lid (A1)."""
    return log.agg(F.count(F.lit(1)).alias("n_lines"), F.max("lid").alias("max_lid"))


def time_term(log: DataFrame) -> DataFrame:
    """First and last time (A2); nulls for an empty log."""
    return log.agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))


def whole_term(log: DataFrame) -> DataFrame:
    """First day's start and the day after the last (A3)."""
    t = time_term(log)
    return t.select(floor_time(F.col("first_dt"), 86400).alias("top_dt"), F.timestamp_add("DAY", F.lit(1), floor_time(F.col("last_dt"), 86400)).alias("end_dt"))


def whole_host(log: DataFrame, *keys: str, top=None, end=None) -> DataFrame:
    """Distinct (host, keys) in a half-open range (A4); keys ltid or, with a joined log, ltgid."""
    return select(log, top=top, end=end).select("host", *keys).distinct()


def with_group(log: DataFrame, ltg: DataFrame) -> DataFrame:
    """Log rows with their group."""
    return log.join(ltg, "ltid")


def info(log: DataFrame, ltg: DataFrame, top=None, end=None) -> DataFrame:
    """Lines, templates, groups, hosts."""
    rows = select(log, top=top, end=end).join(ltg, "ltid", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("ltid").alias("n_lt"), F.countDistinct("ltgid").alias("n_ltg"), F.countDistinct("host").alias("n_host"))


def seconds_range(top: dt.datetime, end: dt.datetime, step: int, include_end: bool = False):
    """Column of times from top by step (W7 base, ``dtrange``)."""
    a, b = (int((t - dt.datetime(1970, 1, 1)).total_seconds()) for t in (top, end))
    return F.transform(F.sequence(F.lit(a), F.lit(b if include_end else b - 1), F.lit(step)), from_epoch)
