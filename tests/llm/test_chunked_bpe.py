import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from test_token_files import ODD

from regrowth.llm import chunked_bpe as c

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return c.codec(RANKS, PATTERN)


def chunks_of(own, text, step, overlap):
    cuts = c.cut(text, step, overlap)
    return [(a, t, *c.encode_chunk(own, a, t, i == len(cuts) - 1)) for i, (a, t) in enumerate(cuts)]


def test_chunks_give_the_ids_of_the_whole_text(own):
    rnd = random.Random(1)
    alphabet = ["a", "b", "word", " ", " ", "  ", "\n", "\t", "'ll", "'", "s", "12", "é", "!", "日本", "   \n", "😀"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400))) for _ in range(300)]
    texts += ["x" * 700, " " * 500, "a" + " " * 300 + "b", "x" * 300 + " y " + "z" * 300 + " end", "'" * 200, "'ll" * 100] + [t or "" for t in ODD]
    for t in texts:
        for step, overlap in ((40, 16), (17, 9), (100, 40)):
            assert c.encode_chunks(own, chunks_of(own, t, step, overlap)) == own.encode(t), (step, repr(t[:80]))


def test_neighbouring_chunks_take_over(own):
    text = " ".join(f"word{i} it's" for i in range(400))
    rows = chunks_of(own, text, 300, 60)
    parts = c.stitch([r[:3] for r in rows], lambda a, k: pytest.fail("no need to cut again"))
    assert [p[0] for p in parts] == list(range(len(rows)))
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and parts[-1][2] == len(text)


def test_encode_decode(spark, own):
    rnd = random.Random(2)
    texts = [*ODD, "same", "same", " ".join(f"w{rnd.randrange(999)}" for _ in range(2000)), "y" * 3000, None]
    rows = [(i if t != "same" else 7, t, 1) for i, t in enumerate(texts)] + [(None, "z " * 900, 2), (None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = c.encode_decode(docs, RANKS, PATTERN, step=500, overlap=64)
    want = []
    for i, t, _ in rows:
        ids = own.encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == sorted(want)
    with_ids = c.encode_decode(docs, RANKS, PATTERN, step=500, overlap=64, with_ids=True).collect()
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in with_ids)
    assert c.encode_decode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_cut_covers():
    assert c.cut("", 5, 2) == [(0, "")] and np.all([t for _, t in c.cut("abcdefghijk", 5, 2)] == ["abcdefg", "fghijk", "k"])
