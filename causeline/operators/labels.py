"""Labels of templates and groups by ordered regex rules, and counts by label."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_GROUP = "default"


def rules_from(path: str) -> tuple[list[tuple[str, list[str]]], dict[str, str]]:
    """Ordered (label, regexes) and label -> group of a definition file. Rule options are named ``i...`` to ignore case, else ``c...``."""
    ini = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        ini.read_file(f)
    rules, group = [], {}
    for s in ini.sections():
        if s.startswith("group_"):
            for label in ini.get(s, "members").split(","):
                group.setdefault(label.strip(), s[len("group_") :])
        elif s.startswith("label_"):
            for name in [x.strip() for x in ini.get(s, "rules").split(",")]:
                words = [w.strip() for w in ini.get(s, name).split(",")]
                rules.append((s[len("label_") :], [("(?i)" if name.startswith("i") else "") + w for w in words]))
    return rules, group


def lt_matches(lt: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(ltid, rule, label) for every rule all of whose regexes match the start of some word."""
    hits = []
    for k, (label, regexes) in enumerate(rules):
        ok = F.lit(True)
        for r in regexes:
            flag, body = ("(?i)", r[4:]) if r.startswith("(?i)") else ("", r)
            ok = ok & F.expr("exists(ltw, w -> w rlike r'" + f"{flag}^(?:{body})".replace("'", "\\'") + "')")
        hits.append(F.when(ok, F.struct(F.lit(k).alias("rule"), F.lit(label).alias("label"))))
    return lt.select("ltid", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("m")).select("ltid", "m.*")


def lt_labels(lt: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(ltid, label) by the first rule that matches, null if none."""
    best = lt_matches(lt, rules).groupBy("ltid").agg(F.min_by("label", "rule").alias("label"))
    return lt.select("ltid").join(best, "ltid", "left")


def ltg_labels(lt: DataFrame, ltg: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(ltgid, label, votes) by the rule that most templates of the group match, the earliest of equal ones."""
    votes = lt_matches(lt, rules).join(ltg, "ltid").groupBy("ltgid", "rule", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("ltgid").orderBy(F.desc("votes"), "rule")
    best = votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("ltgid", "label", "votes")
    return ltg.select("ltgid").distinct().join(best, "ltgid", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))


def group_of(label, groups: dict[str, str], default: str = DEFAULT_GROUP):
    """Group of a label column: the default for no label, null for one in no group."""
    table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))]) if groups else F.lit(None).cast("map<string,string>")
    return F.when(label.isNull(), F.lit(default)).otherwise(table[label])


def label_counts(lt: DataFrame, labels: DataFrame) -> DataFrame:
    """Templates and lines of each label (A12). ``lt(ltid, cnt)``, ``labels(ltid, label)``."""
    return lt.join(labels, "ltid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_lt"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_lines"))


def event_label_counts(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events and lines of each label's events (A13). ``events(gid, host, n)``, ``labels(ltgid, label)``."""
    own = labels.select(F.col("ltgid").alias("gid"), "label")
    return events.join(own, "gid", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_events"), F.sum("n").alias("n_lines"))


def edge_label_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Endpoints of each label: all, directed, within the label; and their total, also of no edges.

    ``edges``: unordered (term, a_gid, a_host, b_gid, b_host, directed).
    """
    la = labels.select(F.col("ltgid").alias("a_gid"), F.col("label").alias("a_label"))
    lb = labels.select(F.col("ltgid").alias("b_gid"), F.col("label").alias("b_label"))
    both = edges.join(la, "a_gid", "left").join(lb, "b_gid", "left")
    ends = both.select(F.explode(F.array("a_label", "b_label")).alias("label"), "directed", F.col("a_label").eqNullSafe(F.col("b_label")).alias("within"))
    ends = ends.select(F.coalesce("label", F.lit("none")).alias("label"), "directed", "within", F.lit(True).alias("__end"))
    # a row that counts nowhere: of no rows at all a rollup would have no total
    ends = ends.unionByName(edges.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ends.schema]))
    out = ends.rollup("label").agg(F.count("__end").alias("n_all"), F.count_if("directed").alias("n_directed"), F.count_if("within").alias("n_within"), F.grouping("label").alias("__total"))
    out = out.filter((F.col("__total") == 1) | F.col("label").isNotNull()).drop("__total")
    return out.withColumn("label", F.coalesce("label", F.lit("total")))


def edge_label_matrix(edges: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Edges between labels, both ways round."""
    la = labels.select(F.col("ltgid").alias("a_gid"), F.coalesce("label", F.lit("none")).alias("a_label"))
    lb = labels.select(F.col("ltgid").alias("b_gid"), F.coalesce("label", F.lit("none")).alias("b_label"))
    both = edges.join(la, "a_gid").join(lb, "b_gid").select(F.explode(F.array(F.struct(F.col("a_label").alias("x"), F.col("b_label").alias("y")), F.struct(F.col("b_label").alias("x"), F.col("a_label").alias("y")))).alias("e"))
    return both.select("e.x", "e.y").groupBy(F.col("x").alias("label")).pivot("y", names).count().na.fill(0)


def edges_between(edges: DataFrame, labels: DataFrame, one: str, two: str) -> DataFrame:
    """Edges from one label to the other, either way round."""
    la = labels.select(F.col("ltgid").alias("a_gid"), F.col("label").alias("a_label"))
    lb = labels.select(F.col("ltgid").alias("b_gid"), F.col("label").alias("b_label"))
    both = edges.join(la, "a_gid").join(lb, "b_gid")
    return both.filter(((F.col("a_label") == one) & (F.col("b_label") == two)) | ((F.col("a_label") == two) & (F.col("b_label") == one)))


def across(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``across_host`` and, with labels, ``across_label``."""
    out = edges.withColumn("across_host", F.col("a_host") != F.col("b_host"))
    if labels is None:
        return out
    la = labels.select(F.col("ltgid").alias("a_gid"), F.col("label").alias("a_label"))
    lb = labels.select(F.col("ltgid").alias("b_gid"), F.col("label").alias("b_label"))
    out = out.join(la, "a_gid", "left").join(lb, "b_gid", "left")
    return out.withColumn("across_label", ~F.col("a_label").eqNullSafe(F.col("b_label"))).drop("a_label", "b_label")
