import random
import time

import public_tokenizers as P
from tokenizers import Tokenizer

from causeline.llm import token_count
from causeline.llm.token_count import TokenCounter, count_tokens

PATH = P.path("byte_bpe_50k.json")


def test_against_the_library():
    tok = Tokenizer.from_file(PATH)
    counter = TokenCounter(open(PATH).read())
    rnd = random.Random(1)
    parts = list("a bcé中😀1²Ⅷ'.,=!\n\t\r ") + ["  ", "\x0b", "\x1c", "\xa0", "　", "\x85", "'s", "'ve", "the", " of", "<|endoftext|>", "aaaa", "ß"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "ab" * 2000, "= " * 50, ""]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert counter.count(texts) == want  # from the cache


def test_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    out = count_tokens(odd_docs, PATH).collect()
    assert len(out) == odd_docs.count()
    text = {r.doc_id: r.text or "" for r in odd_docs.filter("doc_id is not null").collect()}
    for r in out:
        if r.doc_id is not None:
            n = len(tok.encode(text[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 512)
    assert count_tokens(no_docs, PATH).count() == 0


def test_long_words_against_the_library():
    """Sequences merged by lists of places; none of them is kept."""
    tok = Tokenizer.from_file(PATH)
    counter = TokenCounter(open(PATH).read())
    rnd = random.Random(7)
    say = lambda letters, n: "".join(rnd.choices(letters, k=n))
    texts = [say("abcdefghijklmnopqrstuvwxyz", n) for n in (511, 512, 513, 3000, 100_000)] + [say("etaoins", 20_000), say("éü中a", 5000), "a" * 70_001, "=-" * 3000 + "=" * 777, say("0123456789", 4000)]
    texts += [" ".join(texts), say("the of and ", 2000)]
    start = time.time()
    assert counter.count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert time.time() - start < 60 and max(map(len, counter.known)) <= 256


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_BYTES", 10_000)
    counter = TokenCounter(open(PATH).read())
    for k in range(20):
        counter.count([" ".join(f"word{k}x{i}" for i in range(50))])
        assert len(counter.known) <= 150
