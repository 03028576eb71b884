"""Registered queries of the log operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions.tokenise import words_and_separators
from ..operators import causal, changepoint, edit, events as ev, graph, labels as lab, periodic, search, stats, templates as tp, variables as vr
from ..sources import files, generate, hosts, store
from ..streaming import streams
from . import dag, ingest, views as v
from .checkpoint import cut, shared_folder
from .views import END, HOUR, TOP, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *needs: str, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if text is not None:
            SQL[name or f.__name__] = sql(text, *needs)
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return v.log(spark, d, TOP, END)


def _store(spark: SparkSession, d: str) -> store.LogStore:
    return store.LogStore(v.log(spark, d), v.lt(spark), v.ltg(spark), v.area(spark))


# --- store: scans, joins, aggregates ---

A, B = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7)


@query("SELECT gid, host, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 3600 AS bin, count(*) AS cnt FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-02 06:00:00' GROUP BY ALL ORDER BY gid, host, bin", "log")
def term_event_bins(spark, d):
    """Flagship: occurrences of each event per hour in one 30-hour term."""
    end = TOP + dt.timedelta(hours=30)
    return ev.binned(v.log(spark, d, TOP, end), TOP, end, HOUR).orderBy("gid", "host", "bin")


@query("SELECT lid, ltid, dt, host, array_to_string(words, ' ') AS message FROM log WHERE host = 'host3' AND dt >= TIMESTAMP '2024-01-05' AND dt < TIMESTAMP '2024-01-07'", "log")
def log_scan_filter(spark, d):
    rows = store.select(v.log(spark, d, A, B), host="host3", top=A, end=B)
    return rows.select("lid", "ltid", "dt", "host", F.array_join("words", " ").alias("message"))


@query("SELECT host, count(*) AS n FROM log WHERE host IN (SELECT host FROM area WHERE area = 'area1') AND dt >= TIMESTAMP '2024-01-05' GROUP BY host", "log", "area")
def log_area_semi(spark, d):
    rows = store.select(v.log(spark, d, A), areas=v.area(spark), area="area1", top=A)
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ltid, count(*) AS n, min(lid) AS first_lid FROM log WHERE ltid IN (SELECT ltid FROM ltg WHERE ltgid = 2) GROUP BY ltid", "log", "ltg")
def log_ltg_semi(spark, d):
    rows = store.select(v.log(spark, d), ltg=v.ltg(spark), ltgid=2)
    return rows.groupBy("ltid").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("first_lid"))


@query("SELECT lt.ltid, ltgid, array_to_string(ltw, ' ') AS template FROM lt LEFT JOIN (SELECT * FROM ltg WHERE ltgid < 4) g ON lt.ltid = g.ltid", "lt", "ltg")
def lt_left_join(spark, d):
    s = store.LogStore(v.log(spark, d), v.lt(spark), v.ltg(spark).filter("ltgid < 4"), v.area(spark))
    return s.templates().select("ltid", "ltgid", F.array_join("ltw", " ").alias("template"))


@query("SELECT array_to_string(words, ' ') AS words FROM log WHERE ltid = 3 AND host = 'host1'", "log")
def iter_words(spark, d):
    return _store(spark, d).words(ltid=3, host="host1").select(F.array_join("words", " ").alias("words"))


@query("SELECT count(*) AS n_lines, max(lid) AS max_lid FROM log", "log")
def count_lines(spark, d):
    return store.count_lines(v.log(spark, d))


@query("SELECT min(dt) AS first_dt, max(dt) AS last_dt FROM log", "log")
def dt_term(spark, d):
    return store.time_term(v.log(spark, d))


@query("SELECT date_trunc('day', min(dt))::TIMESTAMP AS top_dt, date_trunc('day', max(dt))::TIMESTAMP + INTERVAL 1 DAY AS end_dt FROM log", "log")
def whole_term(spark, d):
    return store.whole_term(v.log(spark, d))


@query("SELECT DISTINCT host, ltid FROM log WHERE dt >= TIMESTAMP '2024-01-05' AND dt < TIMESTAMP '2024-01-07'", "log")
def whole_host_lt(spark, d):
    return store.whole_host(v.log(spark, d, A, B), "ltid", top=A, end=B)


@query("SELECT DISTINCT host, ltgid FROM log JOIN ltg ON log.ltid = ltg.ltid", "log", "ltg")
def whole_host_ltg(spark, d):
    return store.whole_host(store.with_group(v.log(spark, d), v.ltg(spark)), "ltgid")


@query("SELECT count(*) AS n_lines, count(DISTINCT log.ltid) AS n_lt, count(DISTINCT ltgid) AS n_ltg, count(DISTINCT host) AS n_host FROM log LEFT JOIN ltg ON log.ltid = ltg.ltid WHERE dt >= TIMESTAMP '2024-01-05' AND dt < TIMESTAMP '2024-01-07'", "log", "ltg")
def info_term(spark, d):
    return store.info(v.log(spark, d, A, B), v.ltg(spark), A, B)


@query("SELECT ltid, cnt FROM (SELECT lt.ltid, count(lid) AS cnt FROM lt LEFT JOIN log ON lt.ltid = log.ltid GROUP BY lt.ltid)", "log", "lt")
def template_counts(spark, d):
    s = store.LogStore(v.log(spark, d), v.lt(spark).withColumn("lts", F.lit(None).cast("array<string>")).withColumn("cnt", F.lit(0)), v.ltg(spark), v.area(spark))
    return s.with_counts().lt.select("ltid", "cnt")


@query("SELECT ltgid, count(*) AS n_templates, CAST(sum(cnt) AS BIGINT) AS n_lines, array_to_string(list_sort(list(ltid)), ',') AS members FROM (SELECT ltid, count(*) AS cnt FROM log GROUP BY ltid) JOIN ltg USING (ltid) GROUP BY ltgid", "log", "ltg")
def template_groups(spark, d):
    lt = v.log(spark, d).groupBy("ltid").agg(F.count(F.lit(1)).alias("cnt"))
    s = store.LogStore(v.log(spark, d), lt, v.ltg(spark), v.area(spark))
    return s.group_rows().withColumn("members", F.array_join("members", ","))


@query("SELECT lid, CASE WHEN host = 'host1' THEN 99 ELSE ltid END AS ltid FROM log WHERE NOT (gid = 0)", "log")
def update_delete(spark, d):
    rows = store.update(v.log(spark, d), F.col("host") == "host1", {"ltid": F.lit(99)})
    return store.delete(rows, F.col("gid") == 0).select("lid", "ltid")


@query("SELECT count(*) AS n FROM log WHERE dt >= (SELECT max(dt) FROM log WHERE dt < TIMESTAMP '2024-01-05')", "log")
def newer_lines(spark, d):
    return store.newer(v.log(spark, d, None, A), v.log(spark, d)).agg(F.count(F.lit(1)).alias("n"))


# --- events and bins ---


@query("SELECT gid, host, count(*) AS n, min(dt) AS first_dt, max(dt) AS last_dt FROM log GROUP BY gid, host", "log")
def event_groups(spark, d):
    return ev.event_groups(v.log(spark, d))


@query("SELECT gid, host, CAST(row_number() OVER (ORDER BY gid, host) - 1 AS INTEGER) AS eid FROM (SELECT DISTINCT gid, host FROM log)", "log")
def event_map(spark, d):
    return ev.event_map(v.log(spark, d))


@query("SELECT gid, host, eid, CAST(row_number() OVER (ORDER BY eid) - 1 AS INTEGER) AS new_eid FROM (SELECT gid, host, row_number() OVER (ORDER BY gid, host) - 1 AS eid FROM (SELECT DISTINCT gid, host FROM log)) WHERE gid <> 2", "log")
def remap_events(spark, d):
    return ev.remap(ev.event_map(v.log(spark, d)).filter("gid <> 2")).withColumn("eid", F.col("eid").cast("long"))


@query("SELECT count(*) AS n FROM log WHERE (gid, host) IN (SELECT DISTINCT gid, host FROM log WHERE dt < TIMESTAMP '2024-01-01 06:00:00')", "log")
def known_event_lines(spark, d):
    first = v.log(spark, d, None, dt.datetime(2024, 1, 1, 6))
    return ev.known_events(v.log(spark, d), first).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT gid, host, bin, cnt FROM cells", "cells")
def bin_tumble_count(spark, d):
    return ev.binned(_log(spark, d), TOP, END, HOUR)


@query("SELECT gid, host, bin, CAST(1 AS BIGINT) AS cnt FROM cells", "cells")
def bin_tumble_binary(spark, d):
    return ev.binned(_log(spark, d), TOP, END, HOUR, "binary")


@query("SELECT gid, host, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 86400 AS bin, array_to_string(list_transform(list_sort(list(dt)), lambda x: strftime(x, '%H:%M:%S')), ',') AS times FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31' GROUP BY ALL", "log")
def bin_times(spark, d):
    return ev.binned(_log(spark, d), TOP, END, v.DAY, "datetime").withColumn("times", F.array_join(F.transform("times", lambda t: F.date_format(t, "HH:mm:ss")), ","))


@query("SELECT gid, host, w AS bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT gid, host, cnt, unnest(range(greatest(bin - 2, 0), bin + 1)) AS w FROM cells) GROUP BY ALL", "cells")
def bin_slide_count(spark, d):
    """Three-hour windows from every hour."""
    return ev.sliding(_log(spark, d), TOP, END, 3 * HOUR, HOUR)


@query("SELECT gid, host, w AS bin, CAST(1 AS BIGINT) AS cnt FROM (SELECT DISTINCT gid, host, unnest(range(greatest(bin - 1, 0), bin + 1)) AS w FROM cells)", "cells")
def event_stat_overlap(spark, d):
    """Binary statistics in two-hour bins that overlap by one hour."""
    return ev.event_stat(_log(spark, d), TOP, END, 2 * HOUR, HOUR, True)


@query("SELECT gid, host, bin // 6 AS bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM cells GROUP BY gid, host, bin // 6", "cells")
def rebin(spark, d):
    return ev.rebinned(ev.binned(_log(spark, d), TOP, END, HOUR), HOUR, 6 * HOUR)


@query("SELECT i AS bin, TIMESTAMP '2024-01-01' + to_seconds(i * 6000) AS bin_dt FROM range(432) AS t(i)")
def bin_labels(spark, d):
    """Bins that don't divide the range: the last is short."""
    return ev.bin_labels(spark, TOP, END, 6000)


@query("SELECT DISTINCT t.i AS term, 'host_' || host AS area FROM log JOIN range(30) AS t(i) ON dt >= TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) AND dt < TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) + INTERVAL 30 HOUR", "log")
def term_area_grid(spark, d):
    return ev.term_areas(v.log(spark, d), None, TOP, END, 30 * HOUR, 24 * HOUR, "each")


@query("SELECT t.i AS term, area, gid, log.host, count(*) AS n FROM log JOIN area ON log.host = area.host JOIN range(30) AS t(i) ON dt >= TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) AND dt < TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) + INTERVAL 30 HOUR GROUP BY ALL", "log", "area")
def term_area_events(spark, d):
    """Events of overlapping 30-hour terms in each area: the input of the graph jobs."""
    rows = ev.in_terms(v.log(spark, d), TOP, END, 30 * HOUR, 24 * HOUR).join(v.area(spark), "host")
    return rows.groupBy("term", "area", "gid", "host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i AS term, TIMESTAMP '2024-01-01' + to_hours(CAST(24 * i AS INTEGER)) AS top_dt, TIMESTAMP '2024-01-01' + to_hours(CAST(24 * i + 30 AS INTEGER)) AS end_dt FROM range(30) AS t(i)")
def term_table(spark, d):
    return ev.terms(TOP, END, 30 * HOUR, 24 * HOUR, spark)


@query("SELECT lid, date_trunc('day', dt)::TIMESTAMP + to_seconds((CAST(epoch(dt) AS BIGINT) % 86400) // 5400 * 5400) AS floor_dt, date_trunc('day', dt)::TIMESTAMP + to_seconds((CAST(epoch(dt) AS BIGINT) % 86400 + 5399) // 5400 * 5400) AS ceil_dt, CAST(epoch(dt) AS BIGINT) % 5400 = 0 AS is_sep FROM log", "log")
def date_floor_ceil(spark, d):
    return v.log(spark, d).select("lid", fn.floor_time(F.col("dt"), 5400).alias("floor_dt"), fn.ceil_time(F.col("dt"), 5400).alias("ceil_dt"), fn.is_separator(F.col("dt"), 5400).alias("is_sep"))


@query("SELECT DISTINCT 'all_' || strftime(date_trunc('day', dt), '%Y%m%d') AS day_name, 'all_' || strftime(date_trunc('hour', dt), '%Y%m%d') || CASE WHEN hour(dt) = 0 THEN '' ELSE strftime(date_trunc('hour', dt), '_%H%M%S') END AS hour_name FROM log", "log")
def thread_names(spark, d):
    t = v.log(spark, d)
    return t.select(fn.thread_name(F.lit("all"), fn.floor_time(F.col("dt"), v.DAY)).alias("day_name"), fn.thread_name(F.lit("all"), fn.floor_time(F.col("dt"), HOUR)).alias("hour_name")).distinct()


@query("SELECT gid, host, count(*) AS n, count(DISTINCT dt) AS n_times FROM log JOIN range(30) AS t(i) ON dt >= TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) AND dt < TIMESTAMP '2024-01-01' + to_days(CAST(t.i AS INTEGER)) + INTERVAL 30 HOUR GROUP BY gid, host", "log")
def full_events(spark, d):
    return ev.full_events(ev.in_terms(v.log(spark, d), TOP, END, 30 * HOUR, 24 * HOUR))


# --- statistics ---


@query("""SELECT gid, host, n, round(m, 6) AS mean_gap, round(s, 6) AS std_gap, CASE WHEN m <> 0 AND s / m < 1.0 THEN CAST(trunc(med) AS BIGINT) END AS interval_s FROM (
  SELECT gid, host, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s, median(gap) AS med FROM (
    SELECT *, CAST(epoch(dt) AS BIGINT) - lag(CAST(epoch(dt) AS BIGINT)) OVER (PARTITION BY gid, host ORDER BY dt, lid) AS gap FROM log) GROUP BY gid, host) WHERE n > 2""", "log")
def interval_test(spark, d):
    return stats.intervals(v.log(spark, d), 1.0).select("gid", "host", "n", F.round("mean_gap", 6).alias("mean_gap"), F.round("std_gap", 6).alias("std_gap"), "interval_s")


_LINEAR = """SELECT gid, host, n, round(sum(pow(c - (bin + 1) * n / 720.0, 2)) / (720.0 * n), 6) AS val FROM (
  SELECT gid, host, bin, sum(cnt) OVER (PARTITION BY gid, host ORDER BY bin)::DOUBLE AS c, CAST(sum(cnt) OVER (PARTITION BY gid, host) AS BIGINT) AS n FROM dense) GROUP BY gid, host, n"""


@query(_LINEAR, "dense")
def linearity(spark, d):
    return stats.linearity(_log(spark, d), TOP, END, HOUR).select("gid", "host", "n", F.round("val", 6).alias("val"))


@query(f"SELECT gid, host, n FROM ({_LINEAR}) WHERE n >= 10 AND val < 0.5", "dense")
def linear_filter(spark, d):
    return stats.linear_events(_log(spark, d), TOP, END, HOUR).select("gid", "host", "n")


_CORR = "SELECT gid, host, corr(cnt, later) AS corr FROM (SELECT *, lead(cnt, {k}) OVER (PARTITION BY gid, host ORDER BY bin) AS later FROM dense) WHERE later IS NOT NULL GROUP BY gid, host"


@query(f"SELECT gid, host, round(corr, 6) AS corr FROM ({_CORR.format(k=24)})", "dense")
def self_corr(spark, d):
    cells = ev.binned(_log(spark, d), TOP, END, HOUR)
    return stats.self_correlation(cells, TOP, END, HOUR, 24 * HOUR).select("gid", "host", F.round("corr", 6).alias("corr"))


@query(f"SELECT gid, host, round(max(corr), 6) AS best_corr, coalesce(max(corr) >= 0.05, false) AS periodic FROM ({_CORR.format(k=1)} UNION ALL {_CORR.format(k=24)}) GROUP BY gid, host", "dense")
def remove_corr(spark, d):
    cells = ev.binned(_log(spark, d), TOP, END, HOUR)
    return stats.correlated_events(cells, TOP, END, HOUR, [HOUR, 24 * HOUR], 0.05).select("gid", "host", F.round("best_corr", 6).alias("best_corr"), "periodic")


@query("SELECT gid, host, CAST(sum(cnt) AS BIGINT) AS n, min(bin) AS first_bin, max(bin) AS last_bin FROM cells GROUP BY gid, host HAVING sum(cnt) >= 5 AND (max(bin) - min(bin)) * 3600 >= 2000000", "cells")
def periodic_pretest(spark, d):
    return ev.long_enough(ev.binned(_log(spark, d), TOP, END, HOUR), 5, 2_000_000, HOUR)


@query("SELECT gid, host, count(*) AS n, CAST(epoch(max(dt)) - epoch(min(dt)) AS BIGINT) AS span FROM log GROUP BY gid, host HAVING count(*) >= 5 AND epoch(max(dt)) - epoch(min(dt)) >= 2000000", "log")
def periodic_pretest_times(spark, d):
    return ev.long_enough_times(v.log(spark, d), 5, 2_000_000).select("gid", "host", "n", "span")


@query("""WITH g AS (SELECT gid, host, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s, CAST(trunc(median(gap)) AS BIGINT) AS interval_s FROM (
    SELECT *, CAST(epoch(dt) AS BIGINT) - lag(CAST(epoch(dt) AS BIGINT)) OVER (PARTITION BY gid, host ORDER BY dt, lid) AS gap FROM log) GROUP BY gid, host HAVING count(*) > 2),
  r AS (SELECT gid, host, interval_s, greatest(interval_s // 3600, 1) AS k FROM g WHERE m <> 0 AND s / m < 1.1)
  SELECT gid, host, interval_s, round(c, 6) AS corr FROM (SELECT a.gid, a.host, r.interval_s, corr(a.cnt, b.cnt) AS c FROM dense a JOIN r ON a.gid = r.gid AND a.host = r.host JOIN dense b ON b.gid = a.gid AND b.host = a.host AND b.bin = a.bin + r.k GROUP BY ALL) WHERE c >= -0.02""", "log", "dense")
def periodic_legacy(spark, d):
    out = stats.periodic_events(_log(spark, d), TOP, END, HOUR, 1.1, -0.02, 0, 0)
    return out.select("gid", "host", "interval_s", F.round("corr", 6).alias("corr"))


@query("""SELECT gid, lid, dt, total FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY dt, lid) AS r, row_number() OVER (PARTITION BY gid ORDER BY dt DESC, lid DESC) AS q, count(*) OVER (PARTITION BY gid) AS total FROM log) WHERE r <= 3 OR q <= 2""", "log")
def head_foot(spark, d):
    return search.head_and_foot(v.log(spark, d), 3, 2, "gid").select("gid", "lid", "dt", "total")


@query("SELECT lid, v FROM (SELECT lid, CASE WHEN gid = 1 THEN NULL ELSE ltid END AS v FROM log) ORDER BY v DESC NULLS LAST, lid LIMIT 50", "log")
def topk_nulls_last(spark, d):
    rows = v.log(spark, d).select("lid", F.when(F.col("gid") != 1, F.col("ltid")).alias("v"))
    return rows.orderBy(F.col("v").desc_nulls_last(), "lid").limit(50)


# --- sets of events, blocks ---

_BLOCKS = "SELECT term, gid, host, count(*) AS n FROM (SELECT *, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 518400 AS term FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31' AND lid % 7 <> 0 AND (gid + CAST(host[5:] AS INTEGER) + term) % 4 <> 0) GROUP BY ALL"


def _blocks(spark, d):
    rows = v.term_of(_log(spark, d)).filter("lid % 7 <> 0 and (gid + cast(substring(host, 5) as int) + term) % 4 <> 0")
    return rows.groupBy("term", "gid", "host").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT gid, host, count(*) AS n FROM (SELECT DISTINCT term, gid, host FROM (SELECT *, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 518400 AS term FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31') EXCEPT SELECT term, gid, host FROM ({_BLOCKS})) GROUP BY gid, host", "log")
def event_set_diff(spark, d):
    return search.only_in_first(v.term_of(_log(spark, d)), _blocks(spark, d), "term")


@query(f"""WITH a AS (SELECT DISTINCT (CAST(epoch(dt) AS BIGINT) - 1704067200) // 518400 AS term, gid, host FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31'),
  b AS (SELECT term, gid, host, CASE WHEN gid = 1 THEN 3 ELSE 0 END AS type FROM ({_BLOCKS}))
  SELECT a.term, count(*) AS n_before, count(*) FILTER (WHERE type = 0) AS n_left, count(*) FILTER (WHERE type = 3) AS n_replaced, count(*) FILTER (WHERE type IS NULL) AS n_removed FROM a LEFT JOIN b ON a.term = b.term AND a.gid = b.gid AND a.host = b.host GROUP BY a.term""", "log")
def filter_compare(spark, d):
    after = _blocks(spark, d).withColumn("type", F.when(F.col("gid") == 1, 3).otherwise(0))
    return search.filter_effect(v.term_of(_log(spark, d)), after, "term")


_SPANS = "SELECT term, gid, host, count(*) AS n FROM (SELECT *, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 10800 AS term FROM log) GROUP BY term, gid, host"


def _spans(spark, d):
    """Events in blocks of three hours."""
    rows = v.log(spark, d).withColumn("term", F.floor((fn.epoch(F.col("dt")) - 1704067200) / 10800))
    return rows.groupBy("term", "gid", "host").agg(F.count(F.lit(1)).alias("n"))


_TFIDF = f"""WITH blk AS ({_SPANS}), w AS (SELECT term, gid, host, n / sum(n) OVER (PARTITION BY term) * log2((SELECT count(DISTINCT term) FROM blk) / count(*) OVER (PARTITION BY gid, host)) AS w FROM blk)"""


@query(_TFIDF + " SELECT term, gid, host, round(w, 9) AS w FROM w", "log")
def event_tfidf(spark, d):
    return search.tfidf(_spans(spark, d), "term").withColumn("w", F.round("w", 9))


@query(_TFIDF + " SELECT a, b, round(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) ELSE 0 END, 6) AS cosine FROM (SELECT x.term AS a, y.term AS b, sum(x.w * y.w) AS dot, sqrt(sum(y.w * y.w)) AS nb, any_value(n.na) AS na FROM w x JOIN w y ON x.gid = y.gid AND x.host = y.host JOIN (SELECT term, sqrt(sum(w * w)) AS na FROM w GROUP BY term) n ON n.term = x.term GROUP BY ALL)", "log")
def event_tfidf_cosine(spark, d):
    return search.cosine(search.tfidf(_spans(spark, d), "term"), "term").withColumn("cosine", F.round("cosine", 6))


@query(f"WITH b AS ({_BLOCKS}) SELECT label, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n FROM (SELECT gid, host, count(*) AS n FROM (SELECT DISTINCT term, gid, host FROM (SELECT *, (CAST(epoch(dt) AS BIGINT) - 1704067200) // 518400 AS term FROM log WHERE dt >= TIMESTAMP '2024-01-01' AND dt < TIMESTAMP '2024-01-31') EXCEPT SELECT term, gid, host FROM b) GROUP BY gid, host) x LEFT JOIN labels l ON l.ltgid = x.gid GROUP BY label", "log", "labels")
def event_diff_labels(spark, d):
    return search.labelled_difference(v.term_of(_log(spark, d)), _blocks(spark, d), v.labels(spark), "term")


@query(f"SELECT coalesce(a.term, b.term) AS term, CASE WHEN b.term IS NULL THEN 'first' WHEN a.term IS NULL THEN 'second' ELSE 'both' END AS state FROM (SELECT DISTINCT term FROM ({_BLOCKS}) WHERE term < 4) a FULL JOIN (SELECT DISTINCT term FROM ({_BLOCKS}) WHERE term > 1) b ON a.term = b.term", "log")
def aligned_results(spark, d):
    b = _blocks(spark, d)
    return search.aligned(b.filter("term < 4"), b.filter("term > 1"), "term")


@query("SELECT gid, host, n FROM (SELECT gid, host, count(*) AS n FROM log GROUP BY gid, host) WHERE gid = 1 AND host = 'host4'", "log")
def search_event(spark, d):
    return search.search_event(ev.event_groups(v.log(spark, d)), 1, "host4").select("gid", "host", "n")


@query("WITH t AS (SELECT min(CAST(epoch(dt) AS BIGINT)) // 7200 * 7200 AS top FROM log) SELECT gid, host, (CAST(epoch(dt) AS BIGINT) - top) // 7200 AS bin, count(*) AS cnt FROM log, t GROUP BY ALL", "log")
def bin_auto_range(spark, d):
    """Bins over the log's own range."""
    return ev.auto_binned(v.log(spark, d), 7200)


@query("SELECT gid, span, CASE WHEN span <= 86400 THEN 21600 WHEN span <= 604800 THEN 86400 WHEN span <= 1209600 THEN 172800 WHEN span <= 5184000 THEN 604800 ELSE 1728000 END AS step FROM (SELECT gid, CAST(epoch(max(dt)) - epoch(min(dt)) AS BIGINT) AS span FROM log GROUP BY gid)", "log")
def axis_steps(spark, d):
    g = v.log(spark, d).groupBy("gid").agg((F.max(fn.epoch(F.col("dt"))) - F.min(fn.epoch(F.col("dt")))).alias("span"))
    return g.withColumn("step", fn.tick_step(F.col("span")))


@query("SELECT tpl, cnt FROM (SELECT array_to_string(ltw, ' ') AS tpl, CAST(2 * count(*) AS BIGINT) AS cnt FROM log JOIN lt ON log.ltid = lt.ltid GROUP BY tpl)", "log", "lt")
def distinct_templates(spark, d):
    n = v.log(spark, d).groupBy("ltid").agg(F.count(F.lit(1)).alias("cnt")).join(v.lt(spark), "ltid").select(F.col("ltw").alias("tpl"), "cnt")
    return tp.distinct_templates(n, n).withColumn("tpl", F.array_join("tpl", " "))


# --- graphs ---


def _names(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: v.name(c) for c in cols})


@query("SELECT term, src, dst FROM edges", "edges")
def edge_table(spark, d):
    return _names(v.edges(spark, d), "src", "dst")


@query("SELECT term, a, b, directed FROM pairs", "pairs")
def separate_edges(spark, d):
    return _names(graph.adjacency(v.edges(spark, d)), "a", "b").select("term", "a", "b", "directed")


@query("SELECT term, node FROM nodes", "nodes")
def no_orphans(spark, d):
    return _names(graph.nodes(v.edges(spark, d)), "node")


@query("SELECT p.term, n_nodes, count(*) AS n_edges, count(*) FILTER (WHERE directed) AS n_directed, count(*) FILTER (WHERE a[3:] <> b[3:]) AS n_across FROM pairs p JOIN (SELECT term, count(*) AS n_nodes FROM nodes GROUP BY term) n ON n.term = p.term GROUP BY p.term, n_nodes", "pairs", "nodes")
def graph_summary(spark, d):
    return graph.graph_summary(v.edges(spark, d))


@query("SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS n_nodes, count(*) AS n_edges, count(*) FILTER (WHERE directed) AS n_directed, count(*) FILTER (WHERE a[3:] <> b[3:]) AS n_across, round(count(*) FILTER (WHERE directed) / count(*), 6) AS directed_share FROM pairs", "pairs", "nodes")
def graph_totals(spark, d):
    return graph.totals(v.edges(spark, d)).withColumn("directed_share", F.round("directed_share", 6))


@query("SELECT term, src, dst FROM edges WHERE src[1] = '2' OR dst[1] = '2'", "edges")
def search_gid(spark, d):
    return _names(graph.touching(v.edges(spark, d), 2), "src", "dst")


@query("SELECT CAST(node[1] AS INTEGER) AS gid, count(DISTINCT term) AS n_terms FROM nodes GROUP BY ALL", "nodes")
def list_all_gid(spark, d):
    return graph.groups_on_edges(v.edges(spark, d))


@query("SELECT term, src, dst, (src[1] = '1') <> (dst[1] = '1') AS differs, src[1] = '1' OR dst[1] = '1' AS filtered FROM edges", "edges")
def related_filtered(spark, d):
    e = v.edges(spark, d)
    types = graph.nodes(e).withColumn("type", F.when(F.col("node.gid") == 1, 3).otherwise(0))
    return _names(graph.type_changes(e, types), "src", "dst").select("term", "src", "dst", "differs", "filtered")


@query("SELECT i, j FROM range(30) AS a(i), range(30) AS b(j) WHERE i < j")
def complete_graph(spark, d):
    return graph.complete_graph(30, spark)


@query("""WITH RECURSIVE r AS (SELECT term, node, node AS root FROM nodes UNION SELECT r.term, CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.root FROM r JOIN pairs p ON p.term = r.term AND (p.a = r.node OR p.b = r.node))
  SELECT term, node, min(root) AS component FROM r GROUP BY term, node""", "pairs", "nodes")
def components(spark, d):
    e = v.edges(spark, d)
    return _names(graph.connected(graph.nodes(e), e, "term"), "node", "component")


@query("""WITH RECURSIVE r AS (SELECT term, node, node AS root FROM nodes UNION SELECT r.term, CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.root FROM r JOIN pairs p ON p.term = r.term AND (p.a = r.node OR p.b = r.node)),
  c AS (SELECT term, node, min(root) AS component FROM r GROUP BY term, node)
  SELECT term, size, count(*) AS n FROM (SELECT term, component, count(*) AS size FROM c GROUP BY ALL) GROUP BY term, size""", "pairs", "nodes")
def list_netsize(spark, d):
    return graph.component_sizes(v.edges(spark, d))


@query("""WITH adj AS (SELECT term, a, b FROM pairs UNION ALL SELECT term, b, a FROM pairs), deg AS (SELECT term, a, count(*) AS deg FROM adj GROUP BY ALL),
  tri AS (SELECT x.term, x.a, count(*) AS t FROM adj x JOIN adj y ON x.term = y.term AND x.b = y.a JOIN adj z ON z.term = y.term AND z.a = y.b AND z.b = x.a GROUP BY ALL)
  SELECT deg.term, round(avg(CASE WHEN deg < 2 THEN 0 ELSE coalesce(t, 0) / (deg * (deg - 1)) END), 6) AS coefficient FROM deg LEFT JOIN tri ON deg.term = tri.term AND deg.a = tri.a GROUP BY deg.term""", "pairs")
def clustering_coef(spark, d):
    return graph.clustering(v.edges(spark, d)).withColumn("coefficient", F.round("coefficient", 6))


@query()
def max_clique(spark, d):
    return graph.max_clique(v.edges(spark, d))


@query("SELECT a, b, count(*) AS df, round(log2((SELECT count(DISTINCT term) FROM pairs) / count(*)), 6) AS idf FROM pairs GROUP BY a, b", "pairs")
def edge_tfidf(spark, d):
    return _names(graph.edge_idf(v.edges(spark, d)), "a", "b").withColumn("idf", F.round("idf", 6))


_GED = """WITH t AS (SELECT DISTINCT term FROM edges), own AS (SELECT term, src, dst FROM edges UNION SELECT term, dst, src FROM edges),
  s AS (SELECT term, count(*) AS size FROM edges GROUP BY term),
  c AS (SELECT e.term AS t1, o.term AS t2, count(*) AS c FROM edges e JOIN own o ON e.src = o.src AND e.dst = o.dst GROUP BY ALL),
  m AS (SELECT p.term AS t1, q.term AS t2, 2 * count(*) AS m FROM pairs p JOIN pairs q ON p.a = q.a AND p.b = q.b GROUP BY ALL)
  SELECT x.term AS t1, y.term AS t2, CAST(x.size - coalesce(c1.c, 0) + y.size - coalesce(c2.c, 0) AS DOUBLE) AS ged, round((x.size + y.size) / (2 * m.m), 6) AS mcs_ratio
  FROM s x CROSS JOIN s y LEFT JOIN c c1 ON c1.t1 = x.term AND c1.t2 = y.term LEFT JOIN c c2 ON c2.t1 = y.term AND c2.t2 = x.term LEFT JOIN m ON m.t1 = x.term AND m.t2 = y.term"""


@query(_GED, "edges")
def graph_distances(spark, d):
    return graph.similar_graphs(v.edges(spark, d)).select("t1", "t2", "ged", F.round("mcs_ratio", 6).alias("mcs_ratio"))


@query(f"SELECT t2, ged FROM ({_GED}) WHERE t1 = 0 AND t2 <> 0 ORDER BY ged, t2 LIMIT 3", "edges")
def similar_graph_ed(spark, d):
    return graph.nearest_graphs(v.edges(spark, d), 0, 3).select("t2", "ged")


@query("""WITH idf AS (SELECT a, b, log2((SELECT count(DISTINCT term) FROM pairs) / count(*)) AS w FROM pairs GROUP BY a, b),
  e AS (SELECT edges.*, w FROM edges JOIN idf ON idf.a = least(src, dst) AND idf.b = greatest(src, dst)), s AS (SELECT term, sum(w) AS size FROM e GROUP BY term),
  c AS (SELECT e.term AS t1, o.term AS t2, sum(w) AS c FROM e JOIN edges o ON e.src = o.src AND e.dst = o.dst GROUP BY ALL)
  SELECT x.term AS t1, y.term AS t2, round(x.size - coalesce(c1.c, 0) + y.size - coalesce(c2.c, 0), 6) + 0.0 AS ged, round(CASE WHEN c1.c > 0 THEN (x.size + y.size) / (2 * c1.c) END, 6) AS mcs_ratio
  FROM s x CROSS JOIN s y LEFT JOIN c c1 ON c1.t1 = x.term AND c1.t2 = y.term LEFT JOIN c c2 ON c2.t1 = y.term AND c2.t2 = x.term WHERE x.term <> y.term""", "edges", "pairs")
def graph_distances_weighted(spark, d):
    out = graph.similar_graphs(v.edges(spark, d), ignore_direction=False, weighted=True).filter("t1 <> t2")
    return out.select("t1", "t2", (F.round("ged", 6) + 0.0).alias("ged"), F.round("mcs_ratio", 6).alias("mcs_ratio"))


@query("""WITH x AS (SELECT term % 2 AS side, term // 2 AS term, a, b FROM pairs WHERE term < 4), n AS (SELECT term, a, b, max(CASE WHEN side = 0 THEN 1 END) AS p, max(CASE WHEN side = 1 THEN 1 END) AS q FROM x GROUP BY term, a, b),
  c AS (SELECT count(p) AS n1, count(q) AS n2, count(*) FILTER (WHERE p = 1 AND q = 1) AS n_common, count(*) AS n_all FROM n)
  SELECT *, round(n_common / n_all, 6) AS jaccard, round(2 * n_common / (n1 + n2), 6) AS dice, round(n_common / least(n1, n2), 6) AS simpson FROM c""", "pairs")
def edge_overlap_stats(spark, d):
    e = cut(v.edges(spark, d).filter("term < 4"))  # else each side reads and tests the events again
    side = lambda k: e.filter(F.col("term") % 2 == k).withColumn("term", F.floor(F.col("term") / 2))
    out = graph.overlap(side(0), side(1))
    return out.withColumns({c: F.round(c, 6) for c in ("jaccard", "dice", "simpson")})


@query("SELECT src, dst FROM edges WHERE term = 0 INTERSECT SELECT src, dst FROM edges WHERE term = 1", "edges")
def common_edges(spark, d):
    return _names(graph.common_edges(v.edges(spark, d), 0, 1), "src", "dst")


@query("SELECT src, dst FROM edges WHERE term = 0 EXCEPT SELECT src, dst FROM edges WHERE term = 1", "edges")
def diff_edges(spark, d):
    return _names(graph.diff_edges(v.edges(spark, d), 0, 1), "src", "dst")


@query("SELECT a, b FROM pairs WHERE term = 0 INTERSECT SELECT a, b FROM pairs WHERE term = 2", "pairs")
def max_common_subgraph(spark, d):
    return _names(graph.common_subgraph(v.edges(spark, d), 0, 2), "a", "b")


@query("SELECT term, src, dst FROM edges WHERE (term, src) IN (SELECT term, node FROM nodes WHERE node LIKE '%host5') OR (term, dst) IN (SELECT term, node FROM nodes WHERE node LIKE '%host5')", "edges", "nodes")
def diff_evset_edge(spark, d):
    e = v.edges(spark, d)
    return _names(graph.edges_on(e, graph.nodes(e).filter("node.host = 'host5'")), "src", "dst")


_ECOUNT = "SELECT least(a[1], b[1]) AS k1, greatest(a[1], b[1]) AS k2, count(*) AS n FROM pairs GROUP BY ALL"


@query(f"WITH c AS ({_ECOUNT}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC) - 1 AS r, count(*) OVER () AS total FROM c), b AS (SELECT coalesce((SELECT n FROM r WHERE r = CAST(floor(total * 0.2) AS BIGINT)), (SELECT max(n) + 1 FROM r)) AS bound) SELECT CAST(k1 AS INTEGER) AS k1, CAST(k2 AS INTEGER) AS k2, n, n >= bound AS filtered FROM c, b", "pairs")
def edge_count_filter(spark, d):
    return graph.common_filter(graph.edge_counts(v.edges(spark, d), ignore_host=True), 0.2)


@query("SELECT a AS k1, b AS k2, count(*) AS n FROM pairs GROUP BY a, b", "pairs")
def edge_counts(spark, d):
    return _names(graph.edge_counts(v.edges(spark, d)), "k1", "k2")


@query("SELECT a, b, min(term) AS first_term, count(*) AS length FROM (SELECT *, term - row_number() OVER (PARTITION BY a, b ORDER BY term) AS g FROM pairs) GROUP BY a, b, g", "pairs")
def edge_runs(spark, d):
    return _names(graph.edge_runs(v.edges(spark, d)), "a", "b")


@query("SELECT term, CASE WHEN directed THEN x || ' -> ' || y ELSE x || ' <-> ' || y END AS line FROM (SELECT *, '[gid=' || a[1] || ', host=' || a[3:] || ']' AS x, '[gid=' || b[1] || ', host=' || b[3:] || ']' AS y FROM pairs)", "pairs")
def edge_listing(spark, d):
    return graph.listing(v.edges(spark, d))


@query("SELECT term, a, b, run, run >= 2 AS filtered FROM (SELECT *, row_number() OVER (PARTITION BY a, b, g ORDER BY term) AS run FROM (SELECT *, term - row_number() OVER (PARTITION BY a, b ORDER BY term) AS g FROM pairs))", "pairs")
def edge_run_filter(spark, d):
    return _names(graph.run_filter(v.edges(spark, d), 2), "a", "b").withColumn("run", F.col("run").cast("long"))


@query("SELECT term, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, run, run >= 2 AS filtered FROM (SELECT *, row_number() OVER (PARTITION BY a, b, g ORDER BY term) AS run FROM (SELECT *, term - row_number() OVER (PARTITION BY a, b ORDER BY term) AS g FROM (SELECT DISTINCT term, least(a[1], b[1]) AS a, greatest(a[1], b[1]) AS b FROM pairs)))", "pairs")
def edge_run_filter_ighost(spark, d):
    return graph.EDGE_FILTERS["cont_ighost"](v.edges(spark, d), 2).withColumn("run", F.col("run").cast("long"))


@query("""WITH RECURSIVE r AS (SELECT term, node, node AS root FROM nodes UNION SELECT r.term, CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.root FROM r JOIN pairs p ON p.term = r.term AND (p.a = r.node OR p.b = r.node)),
  c AS (SELECT term, node, min(root) AS component FROM r GROUP BY term, node)
  SELECT size, count(*) AS n FROM (SELECT term, component, count(*) AS size FROM c GROUP BY ALL) GROUP BY size""", "pairs", "nodes")
def whole_netsize(spark, d):
    return graph.whole_component_sizes(v.edges(spark, d))


@query(f"WITH g AS ({_GED}) SELECT t1, t2, coalesce(mcs_ratio, (SELECT max(mcs_ratio) FROM g)) AS value FROM g", "edges")
def heatmap(spark, d):
    out = graph.similar_graphs(v.edges(spark, d)).withColumn("mcs_ratio", F.round("mcs_ratio", 6))
    return graph.distance_matrix(out, "mcs_ratio")


# --- labels ---


def _adj(spark, d):
    p = graph.adjacency(v.edges(spark, d))
    return p.select("term", F.col("a.gid").alias("a_gid"), F.col("a.host").alias("a_host"), F.col("b.gid").alias("b_gid"), F.col("b.host").alias("b_host"), "directed")


def _match_sql() -> str:
    tests = []
    for k, (label, regexes) in enumerate(v.RULES):
        cond = " AND ".join("len(list_filter(ltw, lambda w: regexp_matches(w, '" + ("(?i)^(?:" + r[4:] if r.startswith("(?i)") else "^(?:" + r) + ")'))) > 0" for r in regexes)
        tests.append(f"SELECT ltid, {k} AS rule, '{label}' AS label FROM lt WHERE {cond}")
    return " UNION ALL ".join(tests)


@query(f"WITH m AS ({_match_sql()}) SELECT lt.ltid, (SELECT min_by(label, rule) FROM m WHERE m.ltid = lt.ltid) AS label FROM lt", "lt")
def lt_labels(spark, d):
    return lab.lt_labels(v.lt(spark), v.RULES)


@query(f"WITH m AS ({_match_sql()}), c AS (SELECT ltgid, rule, label, count(*) AS votes FROM m JOIN ltg ON m.ltid = ltg.ltid GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY ltgid ORDER BY votes DESC, rule) AS r FROM c) SELECT g.ltgid, label, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT ltgid FROM ltg) g LEFT JOIN b ON b.ltgid = g.ltgid AND r = 1", "lt", "ltg")
def ltg_label_vote(spark, d):
    return lab.ltg_labels(v.lt(spark), v.ltg(spark), v.RULES)


@query(f"WITH m AS ({_match_sql()}), l AS (SELECT ltid, min_by(label, rule) AS label FROM m GROUP BY ltid), c AS (SELECT ltid, count(*) AS cnt FROM log GROUP BY ltid) SELECT label, CASE WHEN label IS NULL THEN 'default' WHEN label IN ('trouble', 'again') THEN 'alarm' WHEN label = 'money' THEN 'business' END AS grp, count(*) AS n_lt, CAST(sum(cnt) AS BIGINT) AS n_lines FROM c LEFT JOIN l USING (ltid) GROUP BY label", "log", "lt")
def label_counts(spark, d):
    counts = v.log(spark, d).groupBy("ltid").agg(F.count(F.lit(1)).alias("cnt"))
    out = lab.label_counts(counts, lab.lt_labels(v.lt(spark), v.RULES))
    return out.withColumn("grp", lab.group_of(F.col("label"), v.LABEL_GROUPS))


@query("SELECT label, count(*) AS n_events, CAST(sum(n) AS BIGINT) AS n_lines FROM (SELECT gid, host, count(*) AS n FROM log GROUP BY gid, host) e LEFT JOIN labels l ON l.ltgid = e.gid GROUP BY label", "log", "labels")
def event_label_counts(spark, d):
    return lab.event_label_counts(ev.event_groups(v.log(spark, d)), v.labels(spark))


_LP = "SELECT p.*, la.label AS x, lb.label AS y FROM pairs p LEFT JOIN labels la ON la.ltgid = CAST(a[1] AS INTEGER) LEFT JOIN labels lb ON lb.ltgid = CAST(b[1] AS INTEGER)"


@query(f"WITH p AS ({_LP}), e AS (SELECT coalesce(x, 'none') AS label, directed, x IS NOT DISTINCT FROM y AS w FROM p UNION ALL SELECT coalesce(y, 'none'), directed, x IS NOT DISTINCT FROM y FROM p) SELECT coalesce(label, 'total') AS label, count(*) AS n_all, count(*) FILTER (WHERE directed) AS n_directed, count(*) FILTER (WHERE w) AS n_within FROM e GROUP BY ROLLUP (label)", "pairs", "labels")
def edge_label_total(spark, d):
    return lab.edge_label_counts(_adj(spark, d), v.labels(spark))


@query(f"""WITH p AS ({_LP}), e AS (SELECT x AS label, y AS o FROM p WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT y, x FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT label, count(*) FILTER (WHERE o = 'money') AS money, count(*) FILTER (WHERE o = 'trouble') AS trouble, count(*) FILTER (WHERE o = 'visit') AS visit FROM e GROUP BY label""", "pairs", "labels")
def group_matrix(spark, d):
    return lab.edge_label_matrix(_adj(spark, d), v.labels(spark), ["money", "trouble", "visit"])


@query(f"SELECT term, a[1]::INTEGER AS a_gid, b[1]::INTEGER AS b_gid, a[3:] AS a_host, b[3:] AS b_host FROM ({_LP}) WHERE (x = 'visit' AND y = 'money') OR (x = 'money' AND y = 'visit')", "pairs", "labels")
def edge_search_label(spark, d):
    return lab.edges_between(_adj(spark, d), v.labels(spark), "visit", "money").select("term", "a_gid", "b_gid", "a_host", "b_host")


@query(f"SELECT a[3:] <> b[3:] AS across_host, x IS DISTINCT FROM y AS across_label, count(*) AS n FROM ({_LP}) GROUP BY ALL", "pairs", "labels")
def edges_across(spark, d):
    return lab.across(_adj(spark, d), v.labels(spark)).groupBy("across_host", "across_label").agg(F.count(F.lit(1)).alias("n"))


# --- variables, templates, edits ---

_VAR = "SELECT l.*, lt.ltw, unnest([0, 1, 2]) AS vid, unnest([words[3], words[5], words[7]]) AS value FROM log l JOIN lt ON l.ltid = lt.ltid"


@query(f"WITH x AS (SELECT ltid, CAST(vid AS INTEGER) AS vid, value, count(*) AS n FROM ({_VAR}) GROUP BY ALL) SELECT ltid, vid, value, n, kinds FROM (SELECT *, count(*) OVER (PARTITION BY ltid, vid) AS kinds, row_number() OVER (PARTITION BY ltid, vid ORDER BY n DESC, value) AS r FROM x) WHERE r <= 5", "log", "lt")
def var_breakdown(spark, d):
    return edit.breakdown(v.log(spark, d), v.lt(spark), limit=5)


@query(f"SELECT ltid, CAST(vid AS INTEGER) AS vid, count(DISTINCT value) AS kinds FROM ({_VAR}) GROUP BY ltid, vid HAVING count(DISTINCT value) <= 8", "log", "lt")
def stable_vars(spark, d):
    return edit.stable_variables(v.log(spark, d), v.lt(spark), 8)


_VSIM = f"""WITH c AS (SELECT gid, host, ltid, vid, value, count(*) AS n FROM ({_VAR}) GROUP BY ALL),
  o AS (SELECT c.*, n / sum(n) OVER (PARTITION BY gid, host, ltid, vid) AS share, count(*) OVER (PARTITION BY gid, host, ltid, vid) AS size FROM c),
  i AS (SELECT value, log2((SELECT count(*) FROM (SELECT DISTINCT gid, host FROM c)) / count(DISTINCT (gid, host))) AS idf FROM c GROUP BY value),
  p AS (SELECT a.gid AS a_gid, a.host AS a_host, a.ltid AS a_ltid, a.vid AS a_vid, b.gid AS b_gid, b.host AS b_host, b.ltid AS b_ltid, b.vid AS b_vid, sum((a.share + b.share) / 2 * idf) AS score, count(*) AS common, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) FILTER (WHERE idf > 0) AS k
    FROM o a JOIN o b ON a.value = b.value AND (a.gid, a.host) < (b.gid, b.host) JOIN i ON i.value = a.value GROUP BY ALL),
  q AS (SELECT *, score / (sa + sb - common) AS sim FROM p WHERE k > 0)
  SELECT a_gid, a_host, b_gid, b_host, round(max(sim), 6) AS sim FROM q GROUP BY ALL"""


@query(_VSIM, "log", "lt")
def var_similarity(spark, d):
    counts = vr.variable_counts(v.log(spark, d), v.lt(spark))
    return vr.similarity(counts).select("a_gid", "a_host", "b_gid", "b_host", F.round("sim", 6).alias("sim"))


@query(f"WITH c AS (SELECT DISTINCT gid, host, value FROM ({_VAR})), a AS (SELECT list(value) AS v FROM c WHERE gid = 0 AND host = 'host1'), b AS (SELECT list(value) AS v FROM c WHERE gid = 1 AND host = 'host2') SELECT array_to_string(list_sort(list_intersect(a.v, b.v)), ',') AS common, array_to_string(list_sort(list_filter(a.v, lambda x: NOT list_contains(b.v, x))), ',') AS only_a, array_to_string(list_sort(list_filter(b.v, lambda x: NOT list_contains(a.v, x))), ',') AS only_b, CAST(len(list_distinct(list_concat(a.v, b.v))) AS INTEGER) AS n_union FROM a, b", "log", "lt")
def var_value_sets(spark, d):
    out = vr.value_sets(vr.variable_counts(v.log(spark, d), v.lt(spark)), (0, "host1"), (1, "host2"), None)
    return out.withColumns({c: F.array_join(c, ",") for c in ("common", "only_a", "only_b")})


def _head_lines(spark, d):
    rows = v.log(spark, d)
    style = F.when(F.col("lid") % 3 == 0, F.concat(F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "host", F.lit(" "), F.array_join("words", " "))).when(
        F.col("lid") % 3 == 1, F.concat(F.date_format("dt", "yyyy MMM d HH:mm:ss"), F.lit(" "), "host", F.lit(" "), F.array_join("words", " "))
    )
    return rows.select("lid", F.coalesce(style, F.lit("no head at all")).alias("line"))


@query("SELECT lid, CASE WHEN lid % 3 < 2 THEN dt END AS dt, CASE WHEN lid % 3 < 2 THEN host END AS host, CASE WHEN lid % 3 < 2 THEN array_to_string(words, ' ') END AS message FROM log", "log")
def header_parse(spark, d):
    h = fn.header(F.col("line"), 2024)
    return _head_lines(spark, d).withColumn("h", h).select("lid", "h.dt", "h.host", "h.message")


@query(r"""WITH t AS (SELECT doc_id, text || '\*@' AS s FROM documents) SELECT doc_id, replace(replace(replace(s, '\', '\\'), '*', '\*'), '@', '\@') AS escaped, true AS same FROM t""")
def escape_roundtrip(spark, d):
    """Each text, with characters that need escapes put behind it."""
    rows = v.table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\\*@")).alias("s"))
    return rows.select("doc_id", fn.add_esc(F.col("s")).alias("escaped"), (fn.restore_esc(fn.add_esc(F.col("s"))) == F.col("s")).alias("same"))


@query("""WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM log) GROUP BY w), e AS (SELECT lid, unnest(words) AS w, unnest(range(len(words))) AS pos, len(words) AS k FROM log),
  x AS (SELECT lid, pos, e.w, n, list(n) OVER (PARTITION BY lid) AS ns, k FROM e JOIN f ON e.w = f.w)
  SELECT lid, string_agg(CASE WHEN n >= list_reverse_sort(ns)[CAST(ceil(k * 0.6) AS INTEGER)] THEN w ELSE '**' END, ' ' ORDER BY pos) AS template FROM x GROUP BY lid""", "log")
def va_templates(spark, d):
    return tp.frequent_words(v.log(spark, d), 0.6).select("lid", F.array_join("tpl", " ").alias("template"))


@query("SELECT lid, min(lt.ltid) AS tid FROM log JOIN lt ON len(words) = len(ltw) AND len(list_filter(range(1, len(words) + 1), lambda i: NOT (ltw[i] = '**' OR ltw[i] = words[i]))) = 0 GROUP BY lid", "log", "lt")
def import_match(spark, d):
    return tp.match_templates(v.log(spark, d), v.lt(spark).select(F.col("ltid").alias("tid"), F.col("ltw").alias("tpl")))


@query("SELECT lid FROM log WHERE gid = 3", "log")
def search_exception(spark, d):
    some = v.lt(spark).filter("ltid not in (6, 7)").select(F.col("ltid").alias("tid"), F.col("ltw").alias("tpl"))
    return tp.unmatched(v.log(spark, d), some).select("lid")


@query("SELECT a.ltid AS x, b.ltid AS y, len(a.ltw) = len(b.ltw) AND len(list_filter(range(1, len(a.ltw) + 1), lambda i: NOT (a.ltw[i] = b.ltw[i] OR a.ltw[i] = '**' OR b.ltw[i] = '**'))) = 0 AS same FROM lt a JOIN lt b ON a.ltid <= b.ltid", "lt")
def wildcard_equal(spark, d):
    a, b = v.lt(spark), v.lt(spark)
    pairs = a.select(F.col("ltid").alias("x"), F.col("ltw").alias("p")).join(b.select(F.col("ltid").alias("y"), F.col("ltw").alias("q")), F.col("x") <= F.col("y"))
    return pairs.select("x", "y", fn.wildcard_equal(F.col("p"), F.col("q")).alias("same"))


@query("SELECT ltid, array_to_string(ltw[i : i + 2], ' ') AS gram FROM (SELECT ltid, ltw, unnest(range(1, len(ltw) - 1)) AS i FROM lt)", "lt")
def ngrams(spark, d):
    return v.lt(spark).select("ltid", F.explode(fn.ngrams(F.col("ltw"), 3)).alias("g")).select("ltid", F.array_join("g", " ").alias("gram"))


@query("SELECT a.ltid AS x, b.ltid AS y, array_to_string(list_transform(range(1, least(len(a.ltw), len(b.ltw)) + 1), lambda i: CASE WHEN a.ltw[i] = b.ltw[i] THEN a.ltw[i] ELSE '**' END), ' ') AS merged FROM lt a JOIN lt b ON a.ltid < b.ltid", "lt")
def merge_template(spark, d):
    a, b = v.lt(spark), v.lt(spark)
    pairs = a.select(F.col("ltid").alias("x"), F.col("ltw").alias("p")).join(b.select(F.col("ltid").alias("y"), F.col("ltw").alias("q")), F.col("x") < F.col("y"))
    return pairs.select("x", "y", F.array_join(fn.merge_template(F.col("p"), F.col("q")), " ").alias("merged"))


@query("SELECT l.lid, words[3] || ',' || words[5] || ',' || words[7] AS vars, '2,4,6' AS places FROM log l JOIN lt ON l.ltid = lt.ltid", "log", "lt")
def template_variables(spark, d):
    rows = v.log(spark, d).join(v.lt(spark), "ltid")
    return rows.select("lid", F.array_join(fn.variables(F.col("words"), F.col("ltw")), ",").alias("vars"), F.array_join(fn.variable_locations(F.col("ltw")), ",").alias("places"))


@query("SELECT lid, array_to_string(words, ' ') AS message FROM log", "log")
def restore_message(spark, d):
    """Tokens and separators put together again are the message."""
    rows = v.log(spark, d).withColumn("t", words_and_separators(F.array_join("words", " ")))
    return rows.select("lid", fn.restore_message(F.col("t.words"), F.col("t.seps")).alias("message"))


@query("SELECT ltid, array_to_string(ltw, ' ') AS template, cnt FROM (SELECT ltid, CASE WHEN ltid = 0 THEN ['**', 'user', '**', 'value', '**', 'from', '**', 'ok'] ELSE ltw END AS ltw, (SELECT count(*) FROM log WHERE log.ltid = lt.ltid OR (lt.ltid = 0 AND log.ltid = 2)) AS cnt FROM lt WHERE ltid <> 2)", "log", "lt")
def edit_merge(spark, d):
    _, lt = edit.merge(v.log(spark, d), v.lt(spark), 0, 2)
    return lt.select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("""WITH r AS (SELECT words, CASE WHEN ltid = 4 AND words[3] = '2' THEN 50 ELSE ltid END AS ltid FROM log), f AS (SELECT ltid, pos, CASE WHEN min(w) = max(w) THEN min(w) ELSE '**' END AS w FROM (SELECT ltid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM r WHERE ltid IN (4, 50)) GROUP BY ltid, pos),
  t AS (SELECT ltid, ltw FROM lt WHERE ltid <> 4 UNION ALL SELECT ltid, list(w ORDER BY pos) FROM f GROUP BY ltid) SELECT CAST(t.ltid AS INTEGER) AS ltid, array_to_string(ltw, ' ') AS template, (SELECT count(*) FROM r WHERE r.ltid = t.ltid) AS cnt FROM t""", "log", "lt")
def edit_separate(spark, d):
    _, lt = edit.separate(v.log(spark, d), v.lt(spark), 4, 0, "2", 50)
    return lt.select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("""WITH n AS (SELECT value, 100 + row_number() OVER (ORDER BY value) - 1 AS new FROM (SELECT DISTINCT words[3] AS value FROM log WHERE ltid = 6)), r AS (SELECT words, coalesce(new, ltid) AS ltid FROM log LEFT JOIN n ON log.ltid = 6 AND words[3] = value),
  f AS (SELECT ltid, pos, CASE WHEN min(w) = max(w) THEN min(w) ELSE '**' END AS w FROM (SELECT ltid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM r WHERE ltid >= 100) GROUP BY ltid, pos),
  t AS (SELECT ltid, ltw FROM lt WHERE ltid <> 6 UNION ALL SELECT ltid, list(w ORDER BY pos) FROM f GROUP BY ltid) SELECT CAST(t.ltid AS INTEGER) AS ltid, array_to_string(ltw, ' ') AS template, (SELECT count(*) FROM r WHERE r.ltid = t.ltid) AS cnt FROM t""", "log", "lt")
def edit_split(spark, d):
    _, lt = edit.split(v.log(spark, d), v.lt(spark), 6, 0, 100)
    return lt.select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("SELECT ltid, array_to_string(CASE WHEN ltid = 8 THEN ['view', 'user', '**', 'value', '**', 'from', 'host4', 'ok'] ELSE ltw END, ' ') AS template, (SELECT count(*) FROM log WHERE log.ltid = lt.ltid AND (log.ltid <> 8 OR host = 'host4')) AS cnt FROM lt", "log", "lt")
def edit_fix(spark, d):
    rows = v.log(spark, d).filter("ltid <> 8 or host = 'host4'")
    return edit.fix(rows, v.lt(spark), 8, [2]).select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("SELECT ltid, array_to_string(CASE WHEN ltid = 1 THEN ['**', 'user', '**', '**', '**', 'from', '**', 'retry', '1'] ELSE ltw END, ' ') AS template, (SELECT count(*) FROM log WHERE log.ltid = lt.ltid) AS cnt FROM lt", "log", "lt")
def edit_free(spark, d):
    return edit.free(v.log(spark, d), v.lt(spark), 1, [0, 3]).select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("SELECT ltid, pos, w || ' ' || l || ' ' || l AS line FROM (SELECT x.ltid, unnest(range(len(ltw)))::INTEGER AS pos, unnest(x.words) AS w, unnest(list_transform(ltw, lambda t: CASE WHEN t = '**' THEN 'V' ELSE 'D' END)) AS l FROM (SELECT ltid, min_by(words, lid) AS words FROM log GROUP BY ltid) x JOIN lt ON x.ltid = lt.ltid)", "log", "lt")
def train_source(spark, d):
    return tp.training_lines(v.log(spark, d), v.lt(spark))


@query("""WITH g AS (SELECT ltid, array_to_string(ltw[i : i + 2], ' ') AS gram FROM (SELECT ltid, ltw, unnest(range(1, len(ltw) - 1)) AS i FROM lt)) SELECT a.ltid, b.ltid AS older, count(*) AS shared FROM g a JOIN (SELECT DISTINCT * FROM g) b ON a.gram = b.gram AND b.ltid < a.ltid GROUP BY ALL""", "lt")
def shared_ngrams(spark, d):
    return tp.shared_ngrams(v.lt(spark), 3)


@query("SELECT lid, CASE WHEN host IN ('host1', 'host2') THEN 'edge' WHEN host IN ('host3') THEN 'core' END AS host_group, CASE WHEN host IN ('host1', 'host2') THEN 'gw' WHEN host = 'host3' THEN 'host3' ELSE host END AS host FROM log", "log")
def host_alias(spark, d):
    aliases = spark.createDataFrame([("host1", "gw", "edge", None, None), ("host2", "gw", "edge", None, None), ("host3", "host3", "core", None, None)], "name string, host string, grp string, lo long, hi long")
    rows = hosts.resolve(v.log(spark, d), aliases)
    return rows.select("lid", "host_group", F.coalesce("known_host", "host").alias("host"))


@query("""SELECT w AS word, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'DIGIT' ELSE 'OTHER' END AS label, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM log) GROUP BY w)""", "log")
def word_labels(spark, d):
    each = v.log(spark, d).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("label", fn.word_label(F.col("word")))


@query("SELECT gid, host, '[gid=' || gid || ', host=' || host || ']' AS plain, 'remain[gid=' || gid || ', host=' || host || '](60sec)' AS rest FROM (SELECT DISTINCT gid, host FROM log)", "log")
def event_names(spark, d):
    e = ev.event_map(v.log(spark, d))
    one = lambda k: fn.event_name(F.col("gid"), F.col("host"), F.lit(k), F.lit(60))
    return e.select("gid", "host", one(0).alias("plain"), one(3).alias("rest"))


@query("SELECT lid, array_to_string(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN ltw[i] <> '**' THEN ltw[i] WHEN words[i] LIKE 'host%' THEN '*server*' ELSE '**' END), ' ') AS tpl FROM log JOIN lt ON log.ltid = lt.ltid", "log", "lt")
def replace_variables(spark, d):
    names = F.create_map(*[x for i in range(10) for x in (F.lit(f"host{i}"), F.lit("server"))])
    rows = v.log(spark, d).join(v.lt(spark), "ltid")
    return rows.select("lid", F.array_join(fn.replace_variables(F.col("words"), F.col("ltw"), names), " ").alias("tpl"))


# --- causal tests ---


@query("SELECT term, e1, e2, n1, n2, o AS n11, round(g2, 6) + 0.0 AS g2 FROM gsq", "gsq")
def ci_gsq_order0(spark, d):
    out = causal.g_square_pairs(v.term_cells(spark, d), v.TERM_DAYS * 24, "term")
    return _names(out, "e1", "e2").withColumn("g2", F.round("g2", 6) + 0.0)


@query("""WITH s AS (SELECT term, e, sum(cnt)::DOUBLE AS s, sum(cnt * cnt)::DOUBLE AS q FROM tcells GROUP BY ALL), p AS (SELECT a.term, a.e AS e1, b.e AS e2, sum(a.cnt * b.cnt)::DOUBLE AS p FROM tcells a JOIN tcells b ON a.term = b.term AND a.bin = b.bin AND a.e < b.e GROUP BY ALL),
  r AS (SELECT x.term, x.e AS e1, y.e AS e2, CASE WHEN (144.0 * x.q - x.s * x.s) * (144.0 * y.q - y.s * y.s) > 0 THEN (144.0 * coalesce(p, 0) - x.s * y.s) / sqrt((144.0 * x.q - x.s * x.s) * (144.0 * y.q - y.s * y.s)) ELSE 0 END AS r FROM s x JOIN s y ON x.term = y.term AND x.e < y.e LEFT JOIN p ON p.term = x.term AND p.e1 = x.e AND p.e2 = y.e),
  c AS (SELECT term, e1, e2, least(greatest(r, -0.9999999999), 0.9999999999) AS r FROM r)
  SELECT term, e1, e2, round(r, 6) + 0.0 AS r, round(sqrt(141.0) * 0.5 * ln(1 + 2 * r / (1 - r)), 6) + 0.0 AS z FROM c""", "tcells")
def ci_fisherz_order0(spark, d):
    out = causal.fisher_pairs(v.term_cells(spark, d), v.TERM_DAYS * 24, "term")
    return _names(out, "e1", "e2").withColumns({c: F.round(c, 6) + 0.0 for c in ("r", "z")})


def _numbered(spark, d):
    cells = v.term_cells(spark, d)
    return cells.join(causal.numbered_events(cells, "term"), ["term", "e"]).select("term", "eid", "bin", "cnt")


@query(name="pc_graph")
def pc_graph(spark, d):
    return causal.pc(_numbered(spark, d), v.TERM_DAYS * 24, "term", method="stable")


@query(name="pc_graph_fisherz")
def pc_graph_fisherz(spark, d):
    return causal.pc(_numbered(spark, d), v.TERM_DAYS * 24, "term", ci="fisherz", method="default", depth=2)


# --- custom operators without SQL ---


@query()
def tokenise(spark, d):
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", words_and_separators(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.size("t.words").alias("n_words"), F.size("t.seps").alias("n_seps"))


@query()
def shiso_templates(spark, d):
    _, tpl = tp.numbered(tp.shiso(v.log(spark, d)))
    return tpl.select("tid", F.array_join("tpl", " ").alias("template"), "cnt")


@query()
def shiso_groups(spark, d):
    return tp.group_shiso(v.lt(spark))


@query()
def jaccard_groups(spark, d):
    return tp.group_jaccard(v.lt(spark))


@query()
def fourier_remove(spark, d):
    cells = ev.binned(_log(spark, d), TOP, END, HOUR)
    return periodic.spectrum_filter(cells, 720, HOUR, "remove").groupBy("gid", "host").agg(F.max("periodic").alias("periodic"), F.max("interval_s").alias("interval_s"))


@query()
def fourier_replace(spark, d):
    cells = ev.binned(_log(spark, d), TOP, END, HOUR)
    return periodic.spectrum_filter(cells, 720, HOUR, "replace").groupBy("gid", "host").agg(F.max("periodic").alias("periodic"), F.round(F.sum("cnt"), 6).alias("rest"))


@query()
def fourier_windows(spark, d):
    """Periodic events in the last day by minutes and in the last week by hours."""
    return periodic.periodic_in_windows(_log(spark, d), END, ((v.DAY, 60), (7 * v.DAY, HOUR)))


@query()
def filter_events(spark, d):
    return periodic.filter_events(_log(spark, d), TOP, END, HOUR, "replace")


@query()
def separate_periodic(spark, d):
    return periodic.separate_periodic(_log(spark, d), HOUR, 0.1)


@query()
def separate_periodic_dup(spark, d):
    return periodic.separate_periodic(_log(spark, d), HOUR, 0.1, dup=True)


@query()
def change_points(spark, d):
    scores = changepoint.change_points(ev.binned(_log(spark, d), TOP, END, HOUR), 720, rate=0.01)
    return changepoint.strongest(scores, 3).select("gid", "host", "bin", "value", F.round("score", 6).alias("score"))


# --- streams: what is closed when the table has been read ---


def _stream(spark, d):
    return v.log_of(streams.table_stream(spark, f"{d}/events.parquet")).select("gid", "host", F.col("dt").cast("timestamp").alias("dt"))


_WATERMARK = "(SELECT max(dt) FROM log)"


@query(f"SELECT gid, host, bin_dt, count(*) AS cnt FROM (SELECT gid, host, time_bucket(INTERVAL 1 HOUR, dt) AS bin_dt FROM log) GROUP BY gid, host, bin_dt HAVING bin_dt + INTERVAL 1 HOUR <= {_WATERMARK}", "log")
def stream_bins(spark, d):
    out = streams.run_once(streams.binned(_stream(spark, d), "1 hour"))
    return out.withColumn("bin_dt", F.col("bin_dt").cast("timestamp_ntz"))


@query(f"SELECT gid, host, bin_dt, count(*) AS cnt FROM (SELECT gid, host, unnest([time_bucket(INTERVAL 1 HOUR, dt) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, dt)]) AS bin_dt FROM log) GROUP BY ALL HAVING bin_dt + INTERVAL 2 HOUR <= {_WATERMARK}", "log")
def stream_hops(spark, d):
    out = streams.run_once(streams.binned(_stream(spark, d), "2 hours", "1 hour"))
    return out.withColumn("bin_dt", F.col("bin_dt").cast("timestamp_ntz"))


@query(f"""WITH g AS (SELECT gid, host, dt, CASE WHEN dt - lag(dt) OVER (PARTITION BY gid, host ORDER BY dt, lid) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM log),
  s AS (SELECT gid, host, dt, sum(fresh) OVER (PARTITION BY gid, host ORDER BY dt ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM g ORDER BY dt))
  SELECT gid, host, min(dt) AS first_dt, max(dt) + INTERVAL 3 HOUR AS end_dt, count(*) AS cnt FROM s GROUP BY gid, host, k HAVING max(dt) + INTERVAL 3 HOUR <= {_WATERMARK}""", "log")
def stream_sessions(spark, d):
    out = streams.run_once(streams.sessions(_stream(spark, d), "3 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_dt", "end_dt")})


@query()
def stream_change_points(spark, d):
    rows = _stream(spark, d).withColumn("bin", F.floor((F.unix_timestamp("dt") - ev.sec(TOP)) / HOUR).cast("long"))
    out = streams.run_once(streams.change_points(rows.select("gid", "host", "bin", F.lit(1).alias("cnt")), 0.01, 1, 5))
    return out.withColumn("score", F.round("score", 6))


# --- files, stores and ingest: what is written to the shared folder and read back ---


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _written_lines(spark: SparkSession, d: str) -> str:
    at = _folder(spark, "lines")
    files.write_log(v.log(spark, d).select("dt", "host", F.array_join("words", " ").alias("message")), at)
    return at


def _written_store(spark: SparkSession, d: str) -> store.LogStore:
    s = store.LogStore.create(spark, _folder(spark, "store"))
    s.append(v.log(spark, d))
    s.replace("lt", v.lt(spark).withColumn("lts", F.lit(None).cast("array<string>")).withColumn("cnt", F.lit(0).cast("long")))
    s.replace("ltg", v.ltg(spark))
    s.replace("area", v.area(spark))
    return store.LogStore.open(spark, s.path)


@query("SELECT host, CAST(dt AS DATE) AS day, count(*) AS n, count(DISTINCT array_to_string(words, ' ')) AS kinds FROM log GROUP BY ALL", "log")
def written_lines(spark, d):
    """The log as text files, found recursively and read again."""
    rows = files.lines(spark, _written_lines(spark, d), True).withColumn("h", fn.header(F.col("line"), 2024)).select("h.*")
    return rows.groupBy("host", F.to_date("dt").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message").alias("kinds"))


@query("SELECT lid, ltid, dt, host, array_to_string(words, ' ') AS message FROM log WHERE ltid IN (SELECT ltid FROM ltg WHERE ltgid = 3) AND host IN (SELECT host FROM area WHERE area = 'area2') AND dt >= TIMESTAMP '2024-01-05'", "log", "ltg", "area")
def stored_lines(spark, d):
    rows = _written_store(spark, d).lines(ltgid=3, area="area2", top=A)
    return rows.select("lid", "ltid", "dt", "host", F.array_join("words", " ").alias("message"))


@query("SELECT ltid, array_to_string(ltw, ' ') AS template, coalesce(n, 0) AS cnt FROM lt LEFT JOIN (SELECT ltid AS id, count(*) AS n FROM log GROUP BY ltid) ON id = ltid", "log", "lt")
def stored_template_counts(spark, d):
    """Templates put in place of themselves with the counts of the stored log."""
    s = _written_store(spark, d)
    s.replace("lt", s.with_counts().lt)
    return store.LogStore.open(spark, s.path).lt.select("ltid", F.array_join("ltw", " ").alias("template"), "cnt")


@query("SELECT host, count(*) AS n, CAST(0 AS BIGINT) AS n_words FROM log GROUP BY host", "log")
def stored_anonymous(spark, d):
    s = _written_store(spark, d)
    s.anonymise()
    rows = store.LogStore.open(spark, s.path).log
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).cast("long").alias("n_words"))


@query("SELECT 'site' || area[5:] AS area, host FROM area WHERE host <> 'host0'", "area")
def stored_areas(spark, d):
    """The areas made anew from the stored ones."""
    s = _written_store(spark, d)
    s.replace("area", s.area.filter("host <> 'host0'").select("host", F.concat(F.lit("site"), F.substring("area", 5, 9)).alias("area")))
    return store.LogStore.open(spark, s.path).area.select("area", "host")


@query("SELECT ltgid, list_aggregate(list_sort(list(CAST(ltid AS VARCHAR))), 'string_agg', ',') AS members FROM (SELECT ltid, ltid AS ltgid FROM lt) GROUP BY ltgid", "lt")
def regroup_none(spark, d):
    s = store.LogStore(v.log(spark, d), v.lt(spark), v.ltg(spark), v.area(spark))
    groups = ingest.regrouped(s, "none")
    return groups.groupBy("ltgid").agg(F.array_join(F.array_sort(F.collect_list(F.col("ltid").cast("string"))), ",").alias("members"))


@query("SELECT array_to_string(ltw, ' ') AS template, count(*) AS cnt, min(dt) AS first_dt FROM log JOIN lt ON log.ltid = lt.ltid GROUP BY ALL", "log", "lt")
def ingested(spark, d):
    """Raw lines parsed, numbered, tokenised and matched to given templates; templates with their lines."""
    given = v.lt(spark).select(F.col("ltid").alias("tid"), F.col("ltw").alias("tpl"))
    tables, _ = ingest.Ingest(2024, miner="import", grouper="none", templates=given).tables(files.lines(spark, _written_lines(spark, d), True))
    rows = tables["log"].join(tables["lt"].select("ltid", F.array_join("ltw", " ").alias("template")), "ltid")
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("cnt"), F.min("dt").alias("first_dt"))


@query("SELECT lid, row_number() OVER (ORDER BY dt, host, message, lid) - 1 AS nr FROM (SELECT *, array_to_string(words, ' ') AS message FROM log QUALIFY count(*) OVER (PARTITION BY dt, host, array_to_string(words, ' ')) = 1)", "log")
def line_numbers(spark, d):
    """Lines numbered by time, host and message; lines that are equal in all of them are left out, as their order is free."""
    rows = v.log(spark, d).select(F.col("lid").alias("old"), "dt", "host", F.array_join("words", " ").alias("message"))
    alone = rows.groupBy("dt", "host", "message").agg(F.min("old").alias("old"), F.count(F.lit(1)).alias("k")).filter("k = 1")
    return ingest.numbered(alone.select("old", "dt", "host", "message")).select(F.col("old").alias("lid"), F.col("lid").alias("nr"))


@query("SELECT host, count(*) AS n, count(DISTINCT array_to_string(words, ' ')) AS kinds FROM log GROUP BY host", "log")
def streamed_lines(spark, d):
    """Lines of text files as a stream, parsed and written as they come."""
    rows = streams.run_once(streams.parsed(streams.text_stream(spark, _written_lines(spark, d)), 2024).select("dt", "host", "words"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.array_join("words", " ")).alias("kinds"))


@query("SELECT lid, array_to_string(words, ' ') AS message FROM log WHERE NOT (array_to_string(words, ' ') LIKE '%retry 1%' OR array_to_string(words, ' ') LIKE 'purchase%')", "log")
def removed_lines(spark, d):
    """What a list of substrings leaves."""
    rows = v.log(spark, d).select("lid", F.array_join("words", " ").alias("message"))
    return rows.filter(~fn.removed(F.col("message"), ["retry 1", "purchase user"]))


_ALIASES = [("host1", "core1", "core", None, None), ("host2", "core2", "core", None, None), ("core2", "core2", "core", None, None), ("host7", "edge", "edge", None, None)]


@query("SELECT lid, CASE host WHEN 'host1' THEN 'core1' WHEN 'host2' THEN 'core2' ELSE 'edge' END AS host FROM log WHERE host IN ('host1', 'host2', 'host7')", "log")
def known_hosts(spark, d):
    """Lines of known hosts only, under their canonical names."""
    aliases = spark.createDataFrame(_ALIASES, "name string, host string, grp string, lo long, hi long")
    return hosts.accept(v.log(spark, d), aliases, True).select("lid", "host")


@query("SELECT lid, array_to_string(words[4:], ' ') AS rest FROM log", "log")
def message_from_word(spark, d):
    return v.log(spark, d).select("lid", fn.message_from_word(F.concat(F.lit("  "), F.array_join("words", "  ")), 3).alias("rest"))


@query(r"SELECT lid, len(words) AS n, words[1] || '\@@x' AS first FROM log", "log")
def split_escaped(spark, d):
    """Words joined by a separator, which stands escaped in the first of them, split again."""
    joined = F.concat(F.element_at("words", 1), F.lit("\\@@x"), F.lit("@@"), F.array_join(F.slice("words", 2, 99), "@@"))
    parts = fn.split_unescaped(joined)
    return v.log(spark, d).select("lid", F.size(parts).cast("long").alias("n"), F.element_at(parts, 1).alias("first"))


@query("SELECT CAST(t AS TIMESTAMP) AS dt FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:59:59', INTERVAL 90 MINUTE) AS g(t)")
def regular_times(spark, d):
    return generate.regular(spark, TOP, END, 5400).select("dt")


@query("SELECT term, src, dst FROM edges", "edges")
def named_edges(spark, d):
    """Edges between numbered events, by the events' names."""
    e = v.edges(spark, d).withColumn("area", F.lit("all"))
    number = lambda c: (F.col(f"{c}.gid") * 100 + F.substring(f"{c}.host", 5, 9).cast("int")).alias(f"{c}_eid")
    defs = e.select("term", "area", F.col("src").alias("x")).unionByName(e.select("term", "area", F.col("dst").alias("x"))).distinct()
    defs = defs.select("term", "area", number("x").alias("eid"), "x.*")
    named = dag.named_edges({"evdef": defs, "edge": e.select("term", "area", number("src"), number("dst"))})
    return named.select("term", v.name("src").alias("src"), v.name("dst").alias("dst"))


@query(_TFIDF + """, c AS (SELECT y.term AS b, sum(x.w * y.w) AS dot, sqrt(sum(y.w * y.w)) AS nb FROM w x JOIN w y ON x.gid = y.gid AND x.host = y.host WHERE x.term = 10 GROUP BY y.term),
  r AS (SELECT b, CASE WHEN nb > 0 AND na > 0 THEN round(dot / (na * nb), 6) ELSE 0 END AS cosine FROM c, (SELECT sqrt(sum(w * w)) AS na FROM w WHERE term = 10) WHERE abs(b - 10) >= 2)
  SELECT count(*) AS blocks, max(cosine) AS best FROM (SELECT * FROM r ORDER BY cosine DESC, b LIMIT 20)""", "log")
def nearest_apart(spark, d):
    """The twenty blocks of three hours most like one, each taken as six hours long, without those that overlap it."""
    weights = search.tfidf(_spans(spark, d), "term")
    start = lambda k: F.timestamp_add("HOUR", F.col("term") * 3 + k, F.lit(str(TOP)).cast("timestamp_ntz"))
    spans = weights.select("term").distinct().select("term", start(0).alias("top_dt"), start(6).alias("end_dt"))
    near = search.nearest_blocks(weights, 10, 20, "term", spans)
    return near.agg(F.count(F.lit(1)).alias("blocks"), F.round(F.max("cosine"), 6).alias("best"))


# --- one-pass queries over the large fact table ---


@query("""SELECT gid, host, bin, count(*) AS cnt, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS marked FROM (SELECT l_returnflag || l_linestatus AS gid, 'host' || (l_suppkey % 10) AS host, l_discount, (CAST(epoch(l_shipdate) AS BIGINT) - 694224000) // 604800 AS bin FROM lineitem WHERE l_shipdate >= TIMESTAMP '1992-01-01') GROUP BY gid, host, bin""")
def fact_week_bins(spark, d):
    """Weekly bins of line items as events, the scale stand-in of binning."""
    rows = v.table(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit("1992-01-01").cast("timestamp_ntz"))
    rows = rows.select(F.concat("l_returnflag", "l_linestatus").alias("gid"), F.concat(F.lit("host"), (F.col("l_suppkey") % 10).cast("string")).alias("host"), "l_discount", F.col("l_shipdate").alias("dt"))
    rows = rows.withColumn("bin", ev.bin_of(F.col("dt"), dt.datetime(1992, 1, 1), 7 * v.DAY))
    return rows.groupBy("gid", "host", "bin").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("marked"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_event_bins(spark, sf_dir)
