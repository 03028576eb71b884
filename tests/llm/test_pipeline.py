import zlib

import numpy as np
import pytest
from test_decontam import brute as contamination
from test_line_dedup import BLANKS, fold
from test_near_dup import brute as near_classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_on_given_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    ids = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        own = {r.doc_id for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
            assert ids is None or own <= ids
            ids = own
        else:
            assert own == ids
    run = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(run) == key(docs)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for rows in (odd_docs, no_docs):
        docs = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            n = out.count()
            if k < 4:
                assert out.columns == rows.columns
                docs = out.checkpoint()
            assert rows is odd_docs or n == 0


def test_stages_against_brute_force(spark):
    """Every stage's rows, worked out plainly from the rows of the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = " ".join(items[0][1].split()[:40])
    line = "This line stands in enough of the documents to be common to them."
    added = {10_000 + k: f"{line}\nand {k} is the number of this one" for k in range(6)} | {10_100: passage, 10_101: "12 !", 10_102: "", 10_103: rows[min(rows)], 10_104: f"{line}\n{line}"}
    rows |= added
    more = spark.createDataFrame([(d, t, None, None, len(t)) for d, t in added.items()], docs.schema)
    now = docs.unionByName(more).repartition(3)

    want = {d: t for d, t in rows.items() if any(c.isalpha() for c in t)}
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    now = stages["language_id"](spark, now, SF).checkpoint()
    assert texts(now) == want and not {10_101, 10_102} & want.keys()

    held = {}
    key = lambda x: fold(x.strip(BLANKS))
    for d, t in want.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(d)
    gone = {(d, k) for k, ds in held.items() if len(ds) >= 5 for d in ds if d < max(ds)}
    want = {d: "\n".join(x for x in t.split("\n") if (d, key(x)) not in gone) for d, t in want.items()}
    now = stages["line_dedup"](spark, now, SF).checkpoint()
    assert texts(now) == want and line not in want[10_000] and want[10_104].count(line) == 2
    assert {r.doc_id: r.n_chars for r in now.collect()} == {d: len(t) for d, t in want.items()}

    first = near_classes(list(want.items()))
    want = {d: t for d, t in want.items() if first[d] == d or not t}
    now = stages["near_dedup"](spark, now, SF).checkpoint()
    assert texts(now) == want and 10_103 not in want

    judged = contamination(list(want.items()), items)
    want = {d: t for d, t in want.items() if not judged[d][4]}
    now = stages["decontamination"](spark, now, SF).checkpoint()
    assert texts(now) == want and 10_100 not in want

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set()
    for d, t in want.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        pieces |= {(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], np.uint32).tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    out = stages["packing"](spark, now, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == pieces and len(out) == len(pieces)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
