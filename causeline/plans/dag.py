"""Causal graphs of all terms and areas (section 3.2, C11, K7, K13, S12): events, bins, filters, PC, results as Parquet."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scalar import epoch, from_epoch
from ..operators import causal, events as ev
from ..operators.periodic import spectrum_filter
from ..sources import store
from .checkpoint import cut


@dataclass
class DagJob:
    top: dt.datetime
    end: dt.datetime
    length: int = 30 * 3600
    diff: int = 24 * 3600
    size: int = 10
    area: str = "all"  # all, each, or named areas of the store
    gid: str = "ltgid"
    ci: str = "gsq"
    method: str = "default"
    depth: int = -1
    alpha: float = 0.01
    periodic: str | None = None  # remove or replace

    @classmethod
    def of(cls, conf: Settings, top: dt.datetime, end: dt.datetime) -> DagJob:
        d = lambda n: conf.get("dag", n)
        action = conf.get("filter", "action").split("+")[0] if conf.bool("dag", "usefilter") else None
        return cls(top, end, conf.dur("dag", "unit_term"), conf.dur("dag", "unit_diff"), conf.dur("dag", "stat_bin"), d("area"), d("event_gid"), d("ci_func"), d("skeleton_method"), conf.int("dag", "skeleton_depth"), conf.float("dag", "threshold"), action if action in ("remove", "replace") else None)

    def rows(self, s: store.LogStore) -> DataFrame:
        """(term, area, gid, host, dt): only the columns that events need are read."""
        log = store.select(s.log, top=self.top).select("ltid", "dt", "host")
        log = log.withColumn("gid", F.col("ltid")) if self.gid == "ltid" else log.join(s.ltg.withColumnRenamed("ltgid", "gid"), "ltid")
        rows = ev.in_terms(log, self.top, self.end, self.length, self.diff)
        if self.area == "all":
            return rows.withColumn("area", F.lit("all"))
        if self.area == "each":
            return rows.withColumn("area", F.concat(F.lit("host_"), F.col("host")))
        return rows.join(s.area, "host")

    def cells(self, s: store.LogStore) -> DataFrame:
        """(term, area, gid, host, bin, cnt), bins from each term's top."""
        start = F.lit(ev.sec(self.top)) + F.col("term") * self.diff
        rows = self.rows(s).withColumn("bin", F.floor((epoch(F.col("dt")) - start) / self.size).cast("long"))
        cells = rows.groupBy("term", "area", "gid", "host", "bin").agg(F.count(F.lit(1)).alias("cnt"))
        if self.periodic is None:
            return cells.withColumn("type", F.lit(0)).withColumn("note", F.lit(None).cast("long"))
        out = spectrum_filter(cells, self.bins, self.size, self.periodic, keys=("term", "area", "gid", "host")).filter("bin is not null")
        return out.select("term", "area", "gid", "host", "bin", "cnt", F.when(F.col("periodic"), 3).otherwise(0).alias("type"), F.col("interval_s").alias("note"))

    @property
    def bins(self) -> int:
        return -(-self.length // self.size)

    def run(self, s: store.LogStore) -> dict[str, DataFrame]:
        """Tables dag, evdef and edge."""
        cells = cut(self.cells(s))
        by = ("term", "area")
        key = ("gid", "host", "type", "note")
        w = Window.partitionBy(*by).orderBy("gid", "host")
        evdef = cut(cells.select(*by, *key).distinct().withColumn("eid", (F.row_number().over(w) - 1).cast("int")))
        small = cells.join(evdef.select(*by, "gid", "host", "eid"), [*by, "gid", "host"]).select(*by, "eid", "bin", "cnt")
        edge = causal.pc(small, self.bins, *by, ci=self.ci, alpha=self.alpha, method=self.method, depth=self.depth)
        start = F.lit(ev.sec(self.top)) + F.col("term") * self.diff
        dag = evdef.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events")).select(*by, from_epoch(start).alias("top_dt"), from_epoch(start + self.length).alias("end_dt"), F.lit(self.size).alias("bin_seconds"), F.lit(self.alpha).alias("alpha"), "n_events")
        return {"dag": dag, "evdef": evdef, "edge": edge}

    def write(self, s: store.LogStore, path: str) -> None:
        for name, df in self.run(s).items():
            df.write.mode("overwrite").partitionBy("area").parquet(f"{path}/{name}")

    def summary(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Per term and area: events before the filter, after it, and replaced ones."""
        a = before.groupBy("term", "area").agg(F.countDistinct("gid", "host").alias("all_events"))
        b = after.groupBy("term", "area").agg(F.countDistinct("gid", "host").alias("events"), F.countDistinct(F.when(F.col("type") == 3, F.struct("gid", "host"))).alias("replaced"))
        return a.join(b, ["term", "area"], "left").na.fill(0)


def load(spark: SparkSession, path: str, area: str | None = None) -> dict[str, DataFrame]:
    """Results of a run, or of one area."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in ("dag", "evdef", "edge")}
    return {n: df.filter(F.col("area") == area) for n, df in out.items()} if area else out


def result_ids(dag: DataFrame) -> DataFrame:
    """Ordinals of results by area, then term."""
    return dag.withColumn("rid", F.row_number().over(Window.orderBy("area", "term")) - 1)


def named_edges(results: dict[str, DataFrame]) -> DataFrame:
    """(term, area, src, dst) by event keys, comparable between graphs."""
    node = F.struct("gid", "host")
    s = results["evdef"].select("term", "area", F.col("eid").alias("src_eid"), node.alias("src"))
    d = results["evdef"].select("term", "area", F.col("eid").alias("dst_eid"), node.alias("dst"))
    return results["edge"].join(s, ["term", "area", "src_eid"]).join(d, ["term", "area", "dst_eid"]).select("term", "area", "src", "dst")
