import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from causeline.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_length_once(seed):
    rnd = random.Random(seed)
    lengths = [min(512, max(1, int(rnd.lognormvariate(4, 1.2)))) for _ in range(400)]
    plan = packing.plan(dict(Counter(lengths)), 512)
    used = Counter()
    for times, own in plan:
        assert sum(own) <= 512
        for n in own:
            used[n] += times
    assert used == Counter(lengths)
    bins = sum(t for t, _ in plan)
    assert -(-sum(lengths) // 512) <= bins <= packing.brute(lengths, 512)


def test_two_replace_the_smallest():
    # greedy: 60 + 30 leaves 10; 30 makes room for 21 + 19, which fill the bin
    assert packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == (1, (60, 21, 19))


def test_against_the_library(spark, odd_docs, no_docs):
    out = packing.pack_documents(odd_docs, PATH, size=64).toPandas()
    tok = Tokenizer.from_file(PATH)
    want = []
    for r in odd_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[at : at + 64], np.uint32)
            want.append((r.doc_id, k, at, len(own), zlib.crc32(own.tobytes())))
    key = lambda x: tuple(-1 if v is None or v != v else int(v) for v in x)
    got = [key(x) for x in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got) == sorted(map(key, want))
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_long_words_are_not_kept():
    tok = packing.WordTokenizer(open(PATH).read())
    lib = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcdefgh", k=n)) + " end" for n in (200, 300, 20_000)]
    import pyarrow as pa

    for _ in range(2):
        assert [x.tolist() for x in tok.encode(pa.array(texts))] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(map(len, tok.words)) <= 256 and max(map(len, tok.pre)) <= 256
