"""From raw lines to the store (section 3.1): parse, tokenise, resolve hosts, mine templates, group, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scalar import epoch, header, removed
from ..functions.tokenise import words_and_separators
from ..operators import templates as tp
from ..sources import hosts, store
from .checkpoint import cut


@dataclass
class Ingest:
    default_year: int
    blacklist: list[str] = field(default_factory=list)
    aliases: DataFrame | None = None
    drop_unknown: bool = False
    miner: str = "shiso"
    grouper: str = "shiso"
    mode: str = "sharded"
    threshold: float = 0.9
    max_child: int = 4
    templates: DataFrame | None = None  # (tid, tpl) for the import miner
    word_groups: DataFrame | None = None  # (word, grp) for variable labels

    @classmethod
    def of(cls, conf: Settings, default_year: int, **more) -> Ingest:
        return cls(default_year, miner=conf.get("log_template", "lt_alg"), grouper=conf.get("log_template", "ltgroup_alg"), threshold=conf.float("log_template_shiso", "ltgen_threshold"), max_child=conf.int("log_template_shiso", "ltgen_max_child"), **more)

    def parsed(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lid, dt, host, words, seps) of readable lines, numbered by time, and the lines that were rejected."""
        rows = lines.withColumn("h", header(F.col("line"), self.default_year))
        bad = rows.filter("h is null").select("line")
        rows = rows.filter("h is not null").select("h.*")
        if self.blacklist:
            rows = rows.filter(~removed(F.col("message"), self.blacklist))
        if self.aliases is not None:
            rows = hosts.accept(rows, self.aliases, self.drop_unknown)
        rows = rows.withColumn("t", words_and_separators(F.col("message"))).select("dt", "host", "message", "t.words", "t.seps")
        return numbered(rows), bad

    def mined(self, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lid, tid) and (tid, tpl, cnt)."""
        if self.miner == "import":
            lines = tp.match_templates(log, self.templates)
            return lines, self.templates.join(lines.groupBy("tid").agg(F.count(F.lit(1)).alias("cnt")), "tid", "left").na.fill(0, ["cnt"])
        if self.miner == "shiso":
            out = tp.shiso(log, self.threshold, self.max_child, self.mode)
        else:
            out = tp.MINERS[self.miner](log)
        return tp.numbered(cut(out))

    def tables(self, lines: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """log, lt and ltg of raw lines, and the rejected lines."""
        log, bad = self.parsed(lines)
        log = cut(log)
        tids, tpl = self.mined(log)
        ltids, lt = tp.vary(tids, tpl, log, self.word_groups)
        full = cut(log.join(ltids, "lid"))
        seps = full.groupBy("ltid").agg(F.min_by("seps", "lid").alias("lts"))
        lt = cut(lt.join(seps, "ltid", "left").select("ltid", "ltw", "lts", "cnt"))
        ltg = tp.GROUPERS[self.grouper](lt).select("ltid", "ltgid")
        return {"log": full.select("lid", "ltid", "dt", "host", "words"), "lt": lt, "ltg": ltg}, bad

    def make(self, spark: SparkSession, lines: DataFrame, path: str, areas: DataFrame | None = None) -> store.LogStore:
        """A new store from raw lines (M2: all templates first, then the lines)."""
        s = store.LogStore.create(spark, path)
        tables, bad = self.tables(lines)
        s.append(tables["log"])
        for name in ("lt", "ltg"):
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        if areas is not None:
            areas.select("host", "area").write.mode("overwrite").parquet(f"{path}/area")
        bad.write.mode("overwrite").text(f"{path}/rejected")
        return store.LogStore.open(spark, path)

    def add(self, spark: SparkSession, lines: DataFrame, s: store.LogStore, only_newer: bool = False) -> store.LogStore:
        """Append lines: by the store's templates where one matches, by new templates elsewhere; ``only_newer`` drops lines older than the log."""
        log, bad = self.parsed(lines)
        if only_newer:
            log = store.newer(s.log, log)
        last = s.log.agg(F.coalesce(F.max("lid"), F.lit(-1)).alias("m")).first()["m"]
        log = cut(log.withColumn("lid", F.col("lid") + last + 1))
        known = tp.match_templates(log, s.lt.select(F.col("ltid").alias("tid"), F.col("ltw").alias("tpl"))).withColumnRenamed("tid", "ltid")
        rest = cut(log.join(known, "lid", "left_anti"))
        tids, tpl = self.mined(rest)
        base = s.lt.agg(F.coalesce(F.max("ltid"), F.lit(-1)).alias("m")).first()["m"]
        ltids, lt = tp.vary(tids, tpl, rest, self.word_groups)
        shift = (F.col("ltid") + base + 1).cast("int")
        rows = log.join(known.unionByName(ltids.withColumn("ltid", shift)), "lid")
        fresh = lt.withColumn("ltid", shift).withColumn("lts", F.lit(None).cast("array<string>")).select("ltid", "ltw", "lts", "cnt")
        lt_all = cut(s.lt.unionByName(fresh))
        rows = cut(rows.select("lid", "ltid", "dt", "host", "words"))
        store.LogStore(s.log, lt_all, s.ltg, s.area, s.path).append(rows)
        full = store.LogStore.open(spark, s.path)
        counts = cut(store.LogStore(full.log, lt_all, s.ltg, s.area, s.path).with_counts().lt)
        s.replace("lt", counts)
        s.replace("ltg", tp.GROUPERS[self.grouper](counts).select("ltid", "ltgid"))
        bad.write.mode("append").text(f"{s.path}/rejected")
        return store.LogStore.open(spark, s.path)


def numbered(rows: DataFrame) -> DataFrame:
    """Line numbers from 0 in order of (dt, host, message): minutes are numbered side by side, then shifted by the lines before them.

    The shift is a running sum over hours, and over the minutes of each hour.
    """
    sec = epoch(F.col("dt"))
    own = rows.withColumn("__minute", F.floor(sec / 60)).withColumn("__n", F.row_number().over(Window.partitionBy("__minute").orderBy("dt", "host", "message")) - 1)
    sizes = rows.groupBy(F.floor(sec / 60).alias("__minute")).agg(F.count(F.lit(1)).alias("__size")).withColumn("__hour", F.floor(F.col("__minute") / 60))
    inner = F.sum("__size").over(Window.partitionBy("__hour").orderBy("__minute")) - F.col("__size")
    hours = sizes.groupBy("__hour").agg(F.sum("__size").alias("__all"))
    hours = hours.select("__hour", (F.sum("__all").over(Window.orderBy("__hour")) - F.col("__all")).alias("__before"))
    before = sizes.withColumn("__inner", inner).join(hours, "__hour").select("__minute", (F.col("__before") + F.col("__inner")).alias("__before"))
    return own.join(before, "__minute").withColumn("lid", (F.col("__before") + F.col("__n")).cast("long")).drop("__minute", "__n", "__before")


def regrouped(s: store.LogStore, grouper: str = "shiso") -> DataFrame:
    """Groups of all templates anew."""
    return tp.GROUPERS[grouper](s.lt).select("ltid", "ltgid")


