import random

import numpy as np
import public_tokenizers
import pytest

from regrowth.llm import separator_scan as s
from regrowth.llm.tokens import PieceEncoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(ids, end):
    out, n = [], 0
    for i in ids:
        if i == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


def test_block_documents():
    sizes, rest = s.block_documents(np.array([1, 2, 9, 9, 3, 9, 4]), 9)
    assert sizes.tolist() == [2, 0, 1] and rest == 1
    sizes, rest = s.block_documents(np.array([1, 2]), 9)
    assert sizes.tolist() == [] and rest == 2


@pytest.mark.parametrize("width", [2, 4])
def test_scan_matches_brute_force(spark, tmp_path, width):
    rnd = random.Random(width)
    files = {"a.ids": [], "b.ids": [7], "c.ids": [9], "d.ids": [9, 9, 1, 9], "e.ids": [1] * 70, "f.ids": [1] * 30 + [9], "g.ids": [rnd.choice([9, 1, 2, 3, 4]) for _ in range(400)], "h.ids": [rnd.choice([9] + [1] * 60) for _ in range(700)]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    for block in (1, 7, 64, 4096):
        got = {}
        for r in s.count_tokens(spark, f"file://{tmp_path}", width, 9, block).collect():
            got.setdefault(r.file, {})[r.ordinal] = r.n_tokens
        for name, ids in files.items():
            assert got.get(name, {}) == dict(enumerate(brute(ids, 9))), (name, block)
    (tmp_path / "z.ids").write_bytes(b"123")
    with pytest.raises(ValueError):
        s.count_tokens(spark, f"file://{tmp_path}", width, 9)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 50)
    texts = [None, "", "one two", "one two", " ".join(f"w{i}" for i in range(500)), "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 4) for i, t in enumerate(texts)] + [(2, "one two", 5), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    out = sorted((str(r.doc_id), r.n_tokens) for r in s.document_counts(docs, VOCABULARY, 50256).collect())
    enc = PieceEncoder(VOCABULARY)
    want = sorted((str(r.doc_id), len(enc.encode([r.text or ""])[0]) // enc.dtype.itemsize) for r in docs.collect())
    assert out == want
    assert s.document_counts(docs.limit(0), VOCABULARY, 50256).count() == 0
