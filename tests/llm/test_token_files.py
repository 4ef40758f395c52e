import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from regrowth.llm import token_files
from regrowth.llm.tokens import PieceEncoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \tb", "it's  they'll\n\n x", "  x y", "a\x1c b", "<|endoftext|> x", "日本語 テキスト", "x" * 5000,
    "a\n b", "\n", " \n ", "don't 's", "1234 5,6  7.8", "é" * 50 + "   " + "ß", "tail   ", "é́   z", None,
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_pieces_give_the_library_ids(plain, monkeypatch):
    texts = [t or "" for t in ODD] + [" ".join(f"w{i * j % 37}" for i in range(50)) for j in range(40)]
    for kept in (300_000, 10):
        monkeypatch.setattr("regrowth.llm.tokens.KEPT_PIECES", kept)
        enc = PieceEncoder(VOCABULARY)
        for _ in range(2):
            assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_random_access(tmp_path, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**rng.integers(1, 31, n), n, dtype=np.int64).astype(np.uint32)
    cut = sorted(rng.integers(0, n + 1, 3).tolist())
    docs = np.split(ids, cut)
    (tmp_path / "x.dac").write_bytes(b"".join(token_files.pack([3, None, 5, 9], docs)))
    f = token_files.TokenFile(f"file://{tmp_path}/x.dac")
    assert f.tokens(0, n).tolist() == ids.tolist()
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert f.token(i) == ids[i]
        j = int(rng.integers(i, n)) + 1
        assert f.tokens(i, j).tolist() == ids[i:j].tolist()
    assert f.documents()[1].tolist() == [0, *np.cumsum([len(d) for d in docs]).tolist()]


def test_round_trip(spark, plain):
    rows = [(i, t, 1) for i, t in zip([50, 3, 9, 9, *range(100, 100 + len(ODD))], ["a b", "a b", "same", "same", *ODD])] + [(None, "no key", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = sorted(token_files.round_trip(docs, VOCABULARY).collect(), key=lambda r: r.start)
    wanted, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t) + [0]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in out] == wanted
    assert token_files.round_trip(docs.limit(0), VOCABULARY).count() == 0
