import hashlib
import random

from pyspark.sql import functions as F

import pytest

from causeline.llm import line_dedup
from causeline.llm.line_dedup import CuckooFilter, LineIndex, dedup, digest, line_key

BLANKS = " \t\n\x0b\x0c\r"


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=40, docs=5):
    held = {}
    keys = {}
    for i, t in rows:
        keys[i] = [fold(x.strip(BLANKS)) for x in (t or "").split("\n")]
        for k in set(keys[i]):
            if len(k) >= least:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys[i]) if not (len(held.get(k, ())) >= docs and i < max(held[k]))]
        out[i] = (len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest())
    return out


@pytest.mark.parametrize("sent", [32 << 20, 0])  # filters sent to all tasks, or lines brought to them
def test_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "FILTER_BROADCAST_BYTES", sent)
    rnd = random.Random(4)
    pool = ["Common line number %d that is certainly longer than forty" % k for k in range(12)] + ["é" * 39, "é" * 40, "short"]
    rows = [(i, "\n".join(rnd.choice(["", " ", "\t", "\r"]) + rnd.choice([x, x.upper()]) for x in rnd.choices(pool, k=rnd.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in digest(df).collect()}
    assert got == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    out = dedup(odd_docs)
    assert set(odd_docs.columns) <= set(out.columns)
    assert out.count() == odd_docs.count()
    by = {r.doc_id: r for r in out.filter("doc_id between 10 and 14").collect()}
    assert [by[k].n_dropped for k in range(10, 15)] == [3, 1, 1, 1, 0]
    assert by[10].text == ""
    assert out.filter("doc_id = 0").first().n_lines == 1
    assert digest(no_docs).count() == 0


def test_cuckoo_filter():
    keys = [hashlib.blake2b(b"%d" % k, digest_size=16).digest() for k in range(5000)]
    f = CuckooFilter(4000)
    for k in keys[:4000]:
        f.add(k)
    assert f.hits(keys[:4000]).all() and all(k in f for k in keys[:4000])
    assert f.hits(keys[4000:]).mean() < 0.01
    for k in keys[:2000]:
        assert f.remove(k)
    again = CuckooFilter.load(f.dump())
    assert again.hits(keys[2000:4000]).all()
    assert again.hits(keys[:2000]).mean() < 0.01


def test_index_is_reversible(spark, tmp_path):
    line = "A sentence that every one of these documents holds, word for word."
    docs = spark.createDataFrame([(k, line + "\nown %d" % k) for k in range(6)], "doc_id long, text string")
    index = LineIndex(spark, str(tmp_path / "index"), shards=4)
    index.insert(docs.filter("doc_id < 4"))
    assert index.dedup(docs.filter("doc_id < 4")).agg(F.sum("n_dropped")).first()[0] == 0
    index.insert(docs.filter("doc_id >= 4"))
    assert index.dedup(docs).agg(F.sum("n_dropped")).first()[0] == 5
    index.delete(docs.filter("doc_id in (4, 5)").select("doc_id"))
    left = docs.filter("doc_id < 4")
    assert index.dedup(left).agg(F.sum("n_dropped")).first()[0] == 0
    assert index.table("filters").agg(F.sum("keys")).first()[0] == 0
    index.insert(docs.filter("doc_id = 5"))
    assert index.dedup(docs.filter("doc_id <> 4")).agg(F.sum("n_dropped")).first()[0] == 4
    assert line_key(b"  " + line.encode() + b"\r") == line_key(line.upper().encode())


def test_spilled_entries_are_counted():
    f = CuckooFilter(4)
    key = b"\x00" * 8 + b"\x07\x00" + b"\x00" * 6
    for _ in range(12):  # its two buckets hold eight
        f.add(key)
    f = CuckooFilter.load(f.dump())
    for _ in range(11):
        assert f.remove(key) and key in f
    assert f.remove(key) and key not in f and not f.remove(key)


def test_index_grown_beyond_its_filters(spark, tmp_path):
    line = lambda k: f"{k} is a line that is long enough to be counted as a key"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex(spark, str(tmp_path / "index"), shards=1)
    index.insert(docs([(k, line("first")) for k in range(5)]))
    grown = [(10 + k, "\n".join(map(line, range(3000)))) for k in range(5)] + [(15, "\n".join(map(line, range(1, 3000, 2))))]
    index.insert(docs(grown))
    index.delete(docs(grown[:1]).select("doc_id"))
    held = CuckooFilter.load(bytes(index.table("filters").first().blob))
    common = [bytes(r.key) for r in index.table("counts").filter("refs >= 5").collect()]
    assert len(common) == 1501 and held.hits(common).all()
    left = docs(grown[1:])
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert rows(index.dedup(left)) == rows(dedup(left))


def test_index_opened_again(spark, tmp_path):
    """A second object goes on where the first one ended; what was not written in full doesn't count."""
    rnd = random.Random(6)
    line = lambda k: f"{k} is a line that is long enough to be counted as a key"
    rows = {d: "\n".join(line(rnd.randint(0, 30)) for _ in range(8)) for d in range(30)}
    docs = lambda ids: spark.createDataFrame([(d, rows[d]) for d in ids], "doc_id long, text string")
    path = str(tmp_path / "index")
    LineIndex(spark, path, shards=2).insert(docs(range(15)))
    LineIndex(spark, path, shards=2).insert(docs(range(15, 30)))
    second = LineIndex(spark, path, shards=2)
    second.delete(docs(range(0, 30, 4)).select("doc_id"))
    second.table("postings").limit(1).write.parquet(f"{path}/{second.generation + 1}/postings")  # an interrupted call
    left = [d for d in rows if d % 4]
    third = LineIndex(spark, path, shards=2)
    assert third.generation == second.generation == 3
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in third.dedup(docs(left)).collect()}
    assert got == brute([(d, rows[d]) for d in left])
    third.insert(docs([0, 4]))
    left = sorted([*left, 0, 4])
    got = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in LineIndex(spark, path, shards=2).dedup(docs(left)).collect()}
    assert got == brute([(d, rows[d]) for d in left])
    with pytest.raises(ValueError):
        LineIndex(spark, path, min_docs=3, shards=2)


def test_repeated_ids(spark):
    """Rows of one doc_id are one document: they count once and lose the same lines."""
    line = "A sentence that every one of these documents holds, word for word."
    rows = [(k, line) for k in range(4)] + [(2, line + "\nother"), (4, line), (4, "more\n" + line), (None, line)]
    out = dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(0, ""), (1, ""), (2, ""), (3, ""), (2, "other"), (4, line), (4, "more\n" + line), (None, line)], key=str)
