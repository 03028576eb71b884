"""Command line over a store: ``python -m causeline.cli COMMAND ...`` (section 2.13)."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, seconds
from .operators import edit, graph, labels, search, templates as tp
from .plans import dag, ingest
from .session import session
from .sources import files, store


def table_text(rows: list[list[object]], align: str = "left", fill: str = " ", gap: str = " ") -> str:
    """Fixed-width text."""
    cells = [[str(c) for c in r] for r in rows]
    width = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))] if cells else []
    just = str.ljust if align == "left" else str.rjust
    return "\n".join(gap.join(just(c, w, fill) for c, w in zip(r, width)) for r in cells)


def show(df: DataFrame, limit: int) -> None:
    rows = df.limit(limit).collect()
    print(table_text([df.columns, *[[("" if v is None else v) for v in r] for r in rows]]))


def _time(text: str) -> dt.datetime:
    for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, f)
        except ValueError:
            continue
    raise argparse.ArgumentTypeError(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="causeline")
    p.add_argument("--store", default="warehouse/log")
    p.add_argument("--config")
    p.add_argument("--limit", type=int, default=1000, help="rows printed")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("make", "add", "update"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.add_argument("--year", type=int, default=dt.date.today().year)
        c.add_argument("--areas")
        c.add_argument("--recursive", action="store_true")
    for name in ("info", "show-lt", "show-group", "show-lt-import", "all-host", "remake-ltgroup", "anonym", "show-sort"):
        sub.add_parser(name)
    c = sub.add_parser("info-term")
    c.add_argument("top", type=_time), c.add_argument("end", type=_time)
    c = sub.add_parser("remake-area")
    c.add_argument("file")
    c = sub.add_parser("show-log-repr")
    c.add_argument("--head", type=int, default=5), c.add_argument("--foot", type=int, default=5)
    c = sub.add_parser("view")
    for o in ("area", "host"):
        c.add_argument(f"--{o}")
    c.add_argument("--ltid", type=int), c.add_argument("--ltgid", type=int), c.add_argument("--top", type=_time), c.add_argument("--end", type=_time)
    c = sub.add_parser("breakdown")
    c.add_argument("ltid", type=int)
    c = sub.add_parser("search-stable")
    c.add_argument("most", type=int)
    c = sub.add_parser("label")
    c.add_argument("file")
    c = sub.add_parser("unmatched")
    c.add_argument("file"), c.add_argument("--mode", default="plain")
    c = sub.add_parser("dag")
    c.add_argument("out"), c.add_argument("--top", type=_time), c.add_argument("--end", type=_time), c.add_argument("--area"), c.add_argument("--bin", type=seconds)
    for name in ("results", "netsize", "cluster-coef", "max-clique", "edges", "common-filter", "gids"):
        c = sub.add_parser(name)
        c.add_argument("out"), c.add_argument("--area", default="all")
    for name in ("common", "diff"):
        c = sub.add_parser(name)
        c.add_argument("out"), c.add_argument("one", type=int), c.add_argument("two", type=int), c.add_argument("--area", default="all")
    c = sub.add_parser("similar")
    c.add_argument("out"), c.add_argument("term", type=int), c.add_argument("--by", choices=["ged", "mcs_ratio"], default="ged"), c.add_argument("--weighted", action="store_true"), c.add_argument("--area", default="all")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    spark = spark or session()
    conf = Settings(a.config)
    out = _store_command(a, spark, conf) if not hasattr(a, "out") else _result_command(a, spark, conf)
    if out is not None:
        show(out, a.limit)
    return out


def _store_command(a, spark: SparkSession, conf: Settings) -> DataFrame | None:
    if a.command in ("make", "add", "update"):
        lines = files.lines(spark, a.paths, a.recursive)
        plan = ingest.Ingest.of(conf, a.year)
        areas = files.groups(spark, a.areas).select(F.col("value").alias("host"), F.col("grp").alias("area")) if a.areas else None
        s = plan.make(spark, lines, a.store, areas) if a.command == "make" else plan.add(spark, lines, store.LogStore.open(spark, a.store), a.command == "update")
        return store.info(s.log, s.ltg)
    s = store.LogStore.open(spark, a.store)
    match a.command:
        case "info":
            return store.info(s.log, s.ltg)
        case "info-term":
            return store.info(s.log, s.ltg, a.top, a.end)
        case "show-lt":
            return s.templates().select("ltid", "ltgid", F.array_join("ltw", " ").alias("template"), "cnt").orderBy("ltid")
        case "show-sort" | "show-lt-import":
            return s.lt.select(F.array_join("ltw", " ").alias("template")).orderBy("template")
        case "show-group":
            return s.group_rows().orderBy("ltgid")
        case "all-host":
            return s.log.select("host").distinct().orderBy("host")
        case "remake-ltgroup":
            s.replace("ltg", ingest.regrouped(s, conf.get("log_template", "ltgroup_alg")))
            return store.LogStore.open(spark, a.store).group_rows()
        case "remake-area":
            s.replace("area", files.groups(spark, a.file).select(F.col("value").alias("host"), F.col("grp").alias("area")))
            return None
        case "anonym":
            s.anonymise()
            return None
        case "show-log-repr":
            ends = search.head_and_foot(s.log, a.head, a.foot, "ltid")
            return ends.join(s.log.select("lid", "host", "words"), "lid").select("ltid", "total", "dt", "host", F.array_join("words", " ").alias("message")).orderBy("ltid", "dt")
        case "view":
            rows = s.lines(ltid=a.ltid, ltgid=a.ltgid, host=a.host, area=a.area, top=a.top, end=a.end)
            return rows.select("lid", "ltid", "dt", "host", F.array_join("words", " ").alias("message")).orderBy("dt", "lid")
        case "breakdown":
            return edit.breakdown(s.log, s.lt, a.ltid).orderBy("vid", F.desc("n"), "value")
        case "search-stable":
            return edit.stable_variables(s.log, s.lt, a.most).orderBy("ltid", "vid")
        case "label":
            rules, _ = labels.rules_from(a.file)
            return labels.label_counts(s.lt, labels.lt_labels(s.lt, rules)).orderBy("label")
        case "unmatched":
            given = files.template_definitions(spark, a.file, a.mode).select(F.monotonically_increasing_id().alias("tid"), F.split("template", " ").alias("tpl"))
            return tp.unmatched(s.log, given).select("lid", F.array_join("words", " ").alias("message"))
    raise ValueError(a.command)


def _result_command(a, spark: SparkSession, conf: Settings) -> DataFrame | None:
    if a.command == "dag":
        s = store.LogStore.open(spark, a.store)
        t = store.whole_term(s.log).first()
        job = dag.DagJob.of(conf, a.top or t["top_dt"], a.end or t["end_dt"])
        job.area, job.size = a.area or job.area, a.bin or job.size
        job.write(s, a.out)
        return dag.load(spark, a.out)["dag"].orderBy("area", "term")
    results = dag.load(spark, a.out, a.area)
    edges = dag.named_edges(results).select("term", "src", "dst")
    match a.command:
        case "results":
            return graph.graph_summary(edges).orderBy("term")
        case "netsize":
            return graph.component_sizes(edges).orderBy("term", F.desc("size"))
        case "cluster-coef":
            return graph.clustering(edges).orderBy("term")
        case "max-clique":
            return graph.max_clique(edges).orderBy("term")
        case "edges":
            return graph.listing(edges).orderBy("term", "line")
        case "common-filter":
            counts = graph.edge_counts(edges, conf.get("visual", "edge_filter_method").endswith("ighost"))
            return graph.common_filter(counts, conf.float("visual", "edge_filter_th")).orderBy(F.desc("n"))
        case "gids":
            return graph.groups_on_edges(edges).orderBy("gid")
        case "common":
            return graph.common_edges(edges, a.one, a.two)
        case "diff":
            return graph.diff_edges(edges, a.one, a.two)
        case "similar":
            return graph.nearest_graphs(edges, a.term, by=a.by, weighted=a.weighted)
    raise ValueError(a.command)



if __name__ == "__main__":
    main()
