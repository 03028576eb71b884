import random

import pytest
from pyspark.sql import functions as F

from causeline.config import Settings, seconds
from causeline.functions import scalar as fn
from causeline.functions.tokenise import definition, is_variable, symbols_as_words, tokenise, words_and_separators


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(col.alias("x")).first().x


def test_header(spark):
    rows = [
        ("2112-09-01 10:00:00 hostname messages here", ("2112-09-01 10:00:00", "hostname", "messages here")),
        ("2112 Sep 01 10:00:00 host m", ("2112-09-01 10:00:00", "host", "m")),
        ("Sep  1 1:02:03 host  m n\n", ("2024-09-01 01:02:03", "host", "m n")),
        ("2112-09-01 10:00:00.5 host m", None), ("no head", None), ("2112-13-01 10:00:00 host m", None), ("Foo 01 10:00:00 host m", None), ("2112-09-01 10:00:00 host", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, line string")
    for r in df.select("k", fn.header(F.col("line"), 2024).alias("h")).collect():
        want = rows[r.k][1]
        assert (None if r.h is None else (str(r.h.dt), r.h.host, r.h.message)) == want, rows[r.k]


def test_message_from_word(spark):
    assert one(spark, fn.message_from_word(F.lit("  a b  c d "), 2)) == "c d"
    assert one(spark, fn.message_from_word(F.lit("a"), 2)) == ""


@pytest.mark.parametrize(
    "text,words",
    [
        ("CRON[12]: (root) CMD (cd / && run)", ["CRON", "12", "root", "CMD", "cd", "/", "&&", "run"]),
        ("at 10:20:30 from 192.168.0.1:80", ["at", "10:20:30", "from", "192.168.0.1", "80"]),
        ("::1 fe80::1 00:11:22:33:44:55", ["::1", "fe80::1", "00:11:22:33:44:55"]),
        ("a:b:c:", ["a", "b", "c"]),
        ("10.0.0.0/8: up", ["10.0.0.0/8", "up"]),
        ("", []),
    ],
)
def test_tokenise(text, words):
    got, seps = tokenise(text)
    assert got == words and len(seps) == len(got) + 1
    assert "".join(s + w for s, w in zip(seps, [*got, ""])) == text


def test_tokenise_round_trip(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab1:.,[]() =\"'<>;`|/x") for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "m string").withColumn("t", words_and_separators(F.col("m")))
    back = df.select("m", fn.restore_message(F.col("t.words"), F.col("t.seps")).alias("b"))
    assert back.filter("m is not null and m <> b").count() == 0
    assert one(spark, symbols_as_words(F.lit("a [b]:"))) == ["a", " [", "b", "]:"]
    assert tokenise("x**y **", wildcard="**")[0] == ["x", "**", "y", "**"]
    assert definition([" 0(0)\n", ":\n"]) == (" ()", ":")
    assert is_variable("12:34:56.7") and not is_variable("12:34")


def test_escapes(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("\\*@ab") for _ in range(rnd.randint(0, 8))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert df.filter(fn.restore_esc(fn.add_esc(F.col("s"))) != F.col("s")).count() == 0
    assert one(spark, fn.split_unescaped(F.lit("a@@b\\@\\@c@@d"))) == ["a", "b\\@\\@c", "d"]


def test_word_labels(spark):
    words = ["hoge", "1234", "[345]", "123.4.5.67", "8.8.8.8", "::2", "2024-01-02", "10:11:12", "300.1.1.1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.l for r in df.select("w", fn.word_label(F.col("w")).alias("l")).collect()}
    assert [got[w] for w in words] == ["OTHER", "DIGIT", "OTHER", "IPv4ADDR", "IPv4ADDR", "IPv6ADDR", "DATE", "TIME", "OTHER"]


def test_templates(spark):
    w, t = ["a", "b", "c"], ["a", "**", "c"]
    assert one(spark, fn.variables(F.col("w"), F.col("t")), w=w, t=t) == ["b"]
    assert one(spark, fn.variable_locations(F.col("t")), t=t) == [1]
    assert one(spark, fn.merge_template(F.col("w"), F.col("t")), w=w, t=["a", "x"]) == ["a", "**"]
    assert one(spark, fn.matches_template(F.col("w"), F.col("t")), w=w, t=t) is True
    assert one(spark, fn.matches_template(F.col("w"), F.col("t")), w=["a", "**", "c"], t=["a", "x", "c"]) is False
    assert one(spark, fn.ngrams(F.col("w"), 2, compat=True), w=w) == [["a", "b"]]
    assert one(spark, fn.ngrams(F.col("w"), 5), w=w) == []


def test_times(spark):
    ts = F.lit("2024-01-01 23:59:30").cast("timestamp_ntz")
    assert str(one(spark, fn.floor_time(ts, 5400))) == "2024-01-01 22:30:00"
    assert str(one(spark, fn.ceil_time(ts, 5400))) == "2024-01-02 00:00:00"
    assert one(spark, fn.short_time(ts)) == "20240101_235930"
    assert one(spark, fn.power2ceil(F.lit(9))) == 16 and one(spark, fn.power2ceil(F.lit(8))) == 8


def test_settings(tmp_path):
    assert [seconds(x) for x in ("10s", "5m", "6h", "1d", "2w")] == [10, 300, 21600, 86400, 1209600]
    with pytest.raises(ValueError):
        seconds("7")
    f = tmp_path / "c.conf"
    f.write_text("[dag]\nunit_term = 12h\nnew = 1\n")
    with pytest.warns(UserWarning):
        c = Settings(str(f), filter={"action": "linear"})
    assert c.dur("dag", "unit_term") == 43200 and c.get("filter", "action") == "linear" and c.list("filter", "dt_cond") == ["1d_1s", "7d_1m"]
    c.merge({"dag": {"unit_term": "1h", "other": "x"}})
    assert c.dur("dag", "unit_term") == 43200 and c.get("dag", "other") == "x" and c.bool("dag", "usefilter") is False
