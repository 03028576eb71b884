"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob named by its SHA-256. The ledger lists the (blob, rule, version) triples
that were scanned and keeps their findings; a scan takes the distinct blobs it has not seen under a rule's
version, reads each of those texts once, however many paths hold it, runs on it the rules it lacks and no others, and joins
findings back to all paths.

Positions are code points. Matches of a rule are leftmost and do not overlap: ``\\G(.*?)(rule)`` yields
the gap before each match in one pass, so starts are running sums of lengths, taken over rows of matches: a text of many matches
costs in proportion.

Defined results: a null text is the empty text; equal texts have equal findings on every row, repeated rows included; a row without
doc_id is scanned and returned like any other; a very long text is searched whole; of equal starts the rule listed first comes first; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import shared_folder, written


@dataclass(frozen=True)
class Rule:
    """A rule finds ``pattern``; matches whose last group is shorter than ``least`` code points are dropped.

    ``hints``: lower-case strings of which a matching text holds at least one, in any case.
    """

    kind: str
    version: int
    pattern: str
    least: int
    hints: tuple[str, ...] = ()
    quick: str | None = None


#: Fixed values of the contract, and one rule more; their order is the order of equal starts.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 16, ("akia",)),
    Rule("hex", 1, r"([0-9a-f]{32,})", 32, (), "[0-9a-f]{32}"),
    Rule("pem", 1, r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)", 1, ("private key",)),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
MATCH = "array<struct<gap:int,hit:int,ok:boolean>>"


def _matches(text: Column, rule: Rule) -> Column:
    """A rule's matches in a text: lengths of the gap before and of the match, and whether it counts."""
    whole = rf"\G(?s:(.*?))({rule.pattern})"
    part = lambda k: F.regexp_extract_all(text, F.lit(whole), F.lit(k))
    steps = F.arrays_zip(part(1).alias("gap"), part(2).alias("hit"), part(3).alias("value"))
    found = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("ok")))
    may = F.lit(True)
    if rule.hints:
        may = F.lit(False)
        for h in rule.hints:
            may = may | F.contains(F.lower(text), F.lit(h))
    if rule.quick:
        may = may & text.rlike(rule.quick)
    return F.when(may, found).otherwise(F.array().cast(MATCH))


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, version, rank, matches) for each rule in the ``todo`` of a (blob, text, todo); no other rule runs on it."""
    def lacks(r: Rule) -> Column:
        return F.exists("todo", lambda p: (p["rule"] == r.kind) & (p["version"] == r.version))

    cols = []
    for k, r in enumerate(rules):
        one = F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(k).alias("rank"), _matches(F.col("text"), r).alias("matches"))
        cols.append(F.when(lacks(r), one))
    each = texts.select("blob", F.explode(F.array(*cols)).alias("f")).filter("f is not null")
    return each.select("blob", "f.*")


def positions(found: DataFrame) -> DataFrame:
    """(blob, rule, version, spans) of those that have spans."""
    once = found.filter(F.size("matches") > 0).dropDuplicates(["blob", "rule", "version"])
    rows = once.select("blob", "rule", "version", "rank", F.posexplode("matches").alias("at", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.hit")).over(Window.partitionBy("blob", "rule", "version").orderBy("at")).cast("int")
    rows = rows.withColumn("end", upto).filter("m.ok")
    span = F.struct((F.col("end") - F.col("m.hit")).alias("start"), "rank", F.col("rule").alias("kind"), "end")
    return rows.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))


def addresses(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """(path, blob): every row with the content address of its text."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))


class BlobLedger:
    """Ledger as Parquet under ``path``, a folder that driver and executors share.

    ``ledger``: blob, rule, version. ``findings``: blob, rule, version, spans, for blobs that have any. Findings are written before the ledger,
    so an interrupted scan is repeated and its rows, if twice there, count once. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if written(self.spark, f"{self.path}/{name}") else None

    def unseen(self, docs: DataFrame) -> DataFrame:
        """(blob, text, todo): each blob that lacks a rule's version, with one of its texts and the rules it lacks."""
        blobs = addresses(docs).groupBy("blob").agg(F.min("path").alias("carrier"))
        ledger = self._read("ledger")
        pairs = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in self.rules])
        if ledger is None:
            todo = blobs.withColumn("todo", pairs)
        else:
            lacking = blobs.select("blob", "carrier", F.explode(pairs).alias("pair")).select("blob", "carrier", "pair.*")
            lacking = lacking.join(ledger, ["blob", "rule", "version"], "left_anti")
            todo = lacking.groupBy("blob", "carrier").agg(F.collect_list(F.struct("rule", "version")).alias("todo"))
        texts = docs.select(F.col("doc_id").alias("carrier"), F.coalesce("text", F.lit("")).alias("text"))
        own = texts.filter("carrier is not null").join(todo.hint("shuffle_hash"), "carrier")
        # a path may have had several versions: the address decides which text is meant
        own = own.filter(F.sha2(F.col("text").cast("binary"), 256) == F.col("blob"))
        lost = texts.filter("carrier is null").withColumn("blob", F.sha2(F.col("text").cast("binary"), 256)).join(todo.filter("carrier is null").select("blob", "todo"), "blob")
        return own.select("blob", "text", "todo").unionByName(lost.select("blob", "text", "todo"))

    def scan(self, docs: DataFrame) -> DataFrame:
        """Scan what is unseen; returns the findings (blob, rule, version, spans) of the ledger's rules."""
        find(self.unseen(docs), self.rules).write.mode("overwrite").parquet(f"{self.path}/pending")
        pending = self.spark.read.parquet(f"{self.path}/pending")
        positions(pending).write.mode("append").parquet(f"{self.path}/findings")
        pending.select("blob", "rule", "version").distinct().write.mode("append").parquet(f"{self.path}/ledger")
        rules = self.spark.createDataFrame([(r.kind, r.version) for r in self.rules], "rule string, version int")
        return self._read("findings").join(F.broadcast(rules), ["rule", "version"]).dropDuplicates(["blob", "rule", "version"])

    def by_path(self, docs: DataFrame) -> DataFrame:
        """(path, spans): every path with all findings of its blob, by start, then rule."""
        found = self.scan(docs).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        out = addresses(docs).join(found, "blob", "left")
        return out.select("path", F.coalesce(F.array_sort("spans"), F.array().cast(SPAN)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans; by a new ledger in the shared folder."""
    spark = docs.sparkSession
    rows = BlobLedger(spark, f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}").by_path(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("path").alias("doc_id"), *[n(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
