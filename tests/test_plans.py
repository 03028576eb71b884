import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from causeline import cli
from causeline.config import Settings
from causeline.operators import events as ev
from causeline.plans import dag, ingest, views
from causeline.sources import files, generate, hosts, store
from causeline.streaming import streams

TOP = dt.datetime(2112, 9, 1)
END = TOP + dt.timedelta(days=3)
FORMATS = ["CRON[$pid$]: ($user$) CMD (cd / && run-parts)", "Interface $ifname$ went down"]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Synthetic lines as text files."""
    path = str(tmp_path_factory.mktemp("raw") / "log")
    occ = generate.poisson(spark, TOP, END, 120, seed=3).select("dt")
    rows = generate.messages(occ, ["rt0", "sw0", "sv0"], FORMATS, "each", seed=5)
    files.write_log(rows, path)
    spark.createDataFrame([("broken line",)], "v string").write.mode("append").text(path)
    return path


def test_generators(spark):
    a = generate.poisson(spark, TOP, END, 100, seed=1, series=20)
    n = [r.n for r in a.groupBy("series").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 20 and 250 < sum(n) / 20 < 350
    assert a.filter((F.col("dt") < F.lit(str(TOP)).cast("timestamp_ntz")) | (F.col("dt") >= F.lit(str(END)).cast("timestamp_ntz"))).count() == 0
    assert generate.regular(spark, TOP, END, 3600).count() == 72 and generate.uniform(spark, TOP, END, 50).count() == 50
    assert generate.recurring(generate.regular(spark, TOP, END, 3600), 1.0, 60, most=2).count() == 216
    for mode in generate.MODES:
        assert generate.messages(generate.regular(spark, TOP, END, 3600), ["a", "b"], FORMATS, mode).filter("message like '%$%'").count() == 0


def test_make_add_and_graphs(spark, raw, tmp_path):
    path, out = str(tmp_path / "store"), str(tmp_path / "dag")
    areas = tmp_path / "areas"
    areas.write_text("[core]\nrt0\nsw0 # both\n[edge]\nsw0\nsv0\n")
    cli.main(["--store", path, "make", raw, "--year", "2112", "--recursive", "--areas", str(areas)], spark)
    s = store.LogStore.open(spark, path)
    n = s.log.count()
    assert n > 400 and spark.read.text(f"{path}/rejected").count() == 1
    assert s.lt.agg(F.sum("cnt")).first()[0] == n
    back = s.messages().filter(F.col("message").startswith("CRON")).first()
    assert back.message.startswith("CRON[") and back.message.endswith("run-parts)")
    assert s.lines(area="core").filter("host = 'sv0'").count() == 0 and s.lines(area="host_sv0").select("host").distinct().count() == 1
    with pytest.raises(ValueError):
        s.lines()
    # again: all lines match known templates; with update only the newest second is not older
    cli.main(["--store", path, "add", raw, "--year", "2112", "--recursive"], spark)
    s = store.LogStore.open(spark, path)
    assert s.log.count() == 2 * n and s.log.select("lid").distinct().count() == 2 * n
    cli.main(["--store", path, "update", raw, "--year", "2112", "--recursive"], spark)
    assert store.LogStore.open(spark, path).log.count() < 2 * n + 10
    conf = Settings(dag={"stat_bin": "10m", "area": "all"})
    job = dag.DagJob.of(conf, TOP, END)
    job.write(store.LogStore.open(spark, path), out)
    res = dag.load(spark, out, "all")
    assert res["dag"].count() == 3 and res["evdef"].count() >= 3
    assert dag.named_edges(res).count() == res["edge"].count()
    job.area, job.periodic = "core", "replace"
    assert {r.area for r in job.run(store.LogStore.open(spark, path))["dag"].collect()} == {"core", "edge"}
    for cmd in (["info"], ["show-lt"], ["show-group"], ["all-host"], ["show-log-repr"], ["view", "--host", "rt0"], ["breakdown", "0"], ["search-stable", "3"], ["remake-ltgroup"], ["info-term", "2112-09-01", "2112-09-02"]):
        cli.main(["--store", path, "--limit", "3", *cmd], spark)
    for cmd in (["results", out], ["netsize", out], ["cluster-coef", out], ["max-clique", out], ["edges", out], ["common-filter", out], ["gids", out], ["common", out, "0", "1"], ["diff", out, "0", "1"], ["similar", out, "0"]):
        cli.main(["--store", path, "--limit", "3", *cmd], spark)


def test_numbered_lines_are_dense_and_ordered(spark):
    rows = views.log(spark, "/root/testdata/sf0.001").select("dt", "host", F.array_join("words", " ").alias("message"))
    out = ingest.numbered(rows.repartition(7)).orderBy("lid").collect()
    assert [r.lid for r in out] == list(range(len(out)))
    assert [r.dt for r in out] == sorted(r.dt for r in out)


def test_hosts(spark, tmp_path):
    f = tmp_path / "alias"
    f.write_text("[net]\n<www> www.test.localdomain 192.168.0.1\nLocalhost\n10.100.0.0/16\n8.8.0.0/16 # wide\n[mail]\n<mx> 8.8.6.0/24\n")
    aliases = files.host_aliases(spark, str(f))
    names = ["192.168.0.1", "www.TEST.localdomain", "localhost", "www", "www3", "hoge", "10.100.1.254", "8.8.6.0", "8.8.7.1", None]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    got = {r.host: (r.known_host, r.host_group) for r in hosts.resolve(df, aliases).collect()}
    assert got["192.168.0.1"] == got["www.TEST.localdomain"] == got["www"] == ("www", "net")
    assert got["localhost"] == ("Localhost", "net") and got["www3"] == got["hoge"] == got[None] == (None, None)
    assert got["10.100.1.254"] == ("10.100.1.254", "net") and got["8.8.6.0"][1] == "mail" and got["8.8.7.1"][1] == "net"
    assert hosts.accept(df, aliases, True).count() == 7 and hosts.accept(df, aliases, False).count() == 10


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("b.txt", "a.txt", "sub/c.txt"):
        (tmp_path / n).write_text("1 a **\n2 b\n\n")
    assert [p.rsplit("/", 1)[1] for p in files.listed([str(tmp_path)])] == ["a.txt", "b.txt"]
    assert len(files.listed([str(tmp_path)], True)) == 3
    with pytest.warns(UserWarning):
        assert files.lines(spark, [str(tmp_path)]).count() == 0
    assert files.lines(spark, str(tmp_path), True).count() == 9
    assert {r[0] for r in files.template_definitions(spark, str(tmp_path / "a.txt"), "ids").collect()} == {"a **", "b"}
    assert cli.table_text([["a", 1], ["bcd", 22]], "right") == "  a  1\nbcd 22"


def test_streams(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    lines = [f"2112-09-01 {h:02d}:{m:02d}:00 host{m % 2} job {m} done" for h in range(4) for m in range(0, 60, 5)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    rows = streams.parsed(streams.text_stream(spark, src), 2112)
    streams.append(rows, out, cp).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == len(lines)
    events = streams.parsed(streams.text_stream(spark, src), 2112).select("dt", "host", F.lit(1).alias("gid"))
    for name, df in (("tumble", streams.binned(events, "1 hour")), ("hop", streams.binned(events, "1 hour", "30 minutes")), ("session", streams.sessions(events, "20 minutes"))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = {(r.bin_dt.hour, r.host): r.cnt for r in spark.table("tumble").collect()}
    assert closed and all(v == 6 for v in closed.values()) and (3, "host0") not in closed  # the last bin is open


def test_streamed_change_points_equal_the_batch(spark, tmp_path):
    from causeline.operators.changepoint import change_points

    cells = ev.binned(views.log(spark, "/root/testdata/sf0.001", views.TOP, views.END), views.TOP, views.END, views.HOUR).filter("gid = 0").select("gid", "host", F.col("bin"), "cnt")
    last = {r.host: r.m for r in cells.groupBy("host").agg(F.max("bin").alias("m")).collect()}
    first = {r.host: r.m for r in cells.groupBy("host").agg(F.min("bin").alias("m")).collect()}
    src = str(tmp_path / "bins")
    for part in (cells.filter("bin < 300"), cells.filter("bin >= 300")):
        part.coalesce(1).write.mode("append").parquet(src)
    bins = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 10).parquet(src)
    q = streams.change_points(bins, 0.01, 1, 5).writeStream.format("memory").queryName("cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.host, r.bin): r.score for r in spark.table("cp").collect()}
    host = sorted(last)[0]
    own = cells.filter(F.col("host") == host).withColumn("bin", F.col("bin") - first[host])
    want = {r.bin + first[host]: r.score for r in change_points(own, int(last[host] - first[host] + 1), 0.01, 1, 5).collect()}
    assert {b for h, b in got if h == host} == set(want)
    assert all(abs(got[host, b] - x) < 1e-9 for b, x in want.items())


def test_streamed_change_points_in_two_batches(spark, tmp_path):
    """A bin whose rows come in two batches has them all; the open bin isn't scored."""
    from causeline.operators.changepoint import ChangeFinder

    src = str(tmp_path / "bins")
    schema = "gid int, host string, bin long, cnt long"
    for rows in ([(0, "a", 1, 4), (0, "a", 0, 2), (0, "b", 3, 1)], [(0, "a", 1, 5), (0, "a", 4, 1), (0, "a", 0, 9)], [(0, "a", 5, 3), (0, "b", 4, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted((r.host, r.bin, r.value, round(r.score, 9)) for r in streams.run_once(streams.change_points(stream, 0.01, 1, 5)).collect())
    want = []
    for host, values in (("a", {0: 2, 1: 9, 2: 0, 3: 0, 4: 1}), ("b", {3: 1})):
        finder = ChangeFinder(0.01, 1, 5)
        want += [(host, b, float(x), round(finder.update(float(x)), 9)) for b, x in values.items()]
    assert got == sorted(want)


def test_words_are_taken_out_of_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    s = store.LogStore.create(spark, path)
    rows = spark.createDataFrame([(k, 0, f"2112-09-0{1 + k % 3} 10:00:0{k % 10}", "h", ["secretword", str(k)]) for k in range(20)], "lid long, ltid int, dt string, host string, words array<string>")
    s.append(rows.withColumn("dt", F.col("dt").cast("timestamp_ntz")))
    cli.main(["--store", path, "anonym"], spark)
    left = store.LogStore.open(spark, path).log
    assert left.count() == 20 and left.agg(F.max(F.size("words"))).first()[0] == 0
    files_ = [os.path.join(at, f) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert files_ and not any(b"secretword" in open(f, "rb").read() for f in files_) and not spark.read.parquet(f"{path}/log").filter("size(words) > 0").count()


def test_interrupted_replacement(spark, tmp_path):
    path = str(tmp_path / "store")
    store.LogStore.create(spark, path)
    new = spark.createDataFrame([("h", "core")], "host string, area string")
    new.write.parquet(f"{path}/area__new")  # written in full, not yet put in place
    assert [tuple(r) for r in store.LogStore.open(spark, path).area.collect()] == [("h", "core")]
    s = store.LogStore.open(spark, path)
    s.replace("area", s.area.unionByName(new.selectExpr("host", "'edge' as area")))
    assert store.LogStore.open(spark, path).area.count() == 2
