import hashlib
import random
import re

from causeline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, n=13):
    out = {}
    windows = {}
    for i, t in items:
        w = tokens(t)
        if w:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    for d, t in docs:
        w, hit, own = tokens(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    own |= windows[tuple(w[a : a + k])]
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def data():
    rnd = random.Random(8)
    text = lambda k: " ".join(rnd.choice(["alpha", "Beta", "gamma", "ünder", "42", "x"]) for _ in range(k))
    items = [(k, text(rnd.choice([5, 13, 14, 30]))) for k in range(12)] + [(50, "only"), (51, ""), (52, None), (53, "!!")]
    docs = [(k, text(rnd.randint(0, 80)) + rnd.choice(["", "; " + items[k % 12][1].upper() + "."])) for k in range(60)]
    return docs + [(900, None), (901, ""), (902, "only")], items


def test_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = lambda block: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.verdicts(decontam.scan(d, b, block_words=block)).collect()}
    assert got(decontam.BLOCK_WORDS) == want
    assert got(60) == want  # several blocks of items
    clean = {k for k, x in want.items() if not x[4]}
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == clean
    assert {r.doc_id for r in decontam.clean(d, b, block_words=60).collect()} == clean


def test_spans_are_offsets_into_the_text(spark):
    words = [f"w{k}" for k in range(13)]
    text = "Über, then: " + " - ".join(words).upper() + " end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    span = decontam.scan(d, b).first().spans[0]
    assert text.encode()[span.from_byte : span.to_byte].decode() == " - ".join(words).upper()


def test_odd_rows(spark, odd_docs, no_docs):
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    out = decontam.verdicts(decontam.scan(odd_docs, b))
    assert out.count() == odd_docs.count()
    assert {r.doc_id for r in out.filter("contaminated").collect()} == {6, 7, 8, None}
    kept = decontam.clean(odd_docs, b)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id in (6, 7, 8)").count() == 0
    assert decontam.clean(no_docs, b).count() == 0 and decontam.scan(no_docs, b).count() == 0
    assert decontam.clean(odd_docs, b.limit(0)).count() == odd_docs.count()


def test_blocks_are_united_by_row(spark, odd_docs):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    b = spark.createDataFrame([(1, passage), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (3, "other words")], "item_id long, text string")
    more = [(7, "clean"), (None, "clean too"), (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu, " + passage), (70, passage), (70, "clean")]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert len(list(decontam._blocks(b, 1))) == 3
    rows = lambda df: sorted(map(repr, df.collect()))
    judged = lambda n: rows(decontam.verdicts(decontam.scan(docs, b, block_words=n)).drop("spans"))
    assert judged(1) == judged(decontam.BLOCK_WORDS) and len(judged(1)) == docs.count()
    kept = decontam.clean(docs, b, block_words=1)
    assert kept.columns == docs.columns and rows(kept) == rows(decontam.clean(docs, b))
    left = kept.select("doc_id", "text").collect()
    assert {r.text for r in left if r.doc_id is None} == {None, "clean too"}
    assert [r.text for r in left if r.doc_id in (7, 70)].count("clean") == 2
