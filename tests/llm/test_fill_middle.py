import hashlib
import random
import re

import numpy as np

from regrowth.llm import fill_middle as f

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_way(doc_id, text):
    """The contract, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def texts():
    rnd = random.Random(3)
    bits = ["a", "word", " ", "  ", "\n", "\t\x0b", "é", "日本", "😀", "\xa0", " ", "<", ">", "<S", "P>", "x" * 90, "\x85", "\x1c"]
    out = ["", None, " ", "\n \t", "a", " a", "a ", "<P>x", "x<M>y", "a <S> b", "x" * 9000, " " * 9000, "ab " * 4000, "　 　", "end<"]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 900))) for _ in range(150)]
    shared = " ".join(f"w{rnd.randrange(500)}" for _ in range(3000))
    return out + [shared, f"{shared} tail", f"head {shared}", shared]


def test_contract(spark):
    rows = [(i * 37 % 1009, t, "x", 1) for i, t in enumerate(texts())] + [(5, "same text here", "y", 2)] * 2 + [(None, "no id at all", "z", 3), (-7, "minus " * 30, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    out = f.digests(f.fill_in_middle(docs))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = sorted((str(x) for x in (plain_way(r[0], r[1]) for r in rows)))
    got = out.collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert f.fill_in_middle(docs.limit(0)).count() == 0


def test_chunks_follow_content_and_counts_add_up():
    rnd = random.Random(5)
    body = " ".join(f"w{rnd.randrange(9000)}" for _ in range(5000)).encode()
    ends = lambda t: f.chunk_ends(np.frombuffer(t, np.uint8))
    a, b = ends(body), ends(b"some other beginning " + body) - 21
    assert len(np.intersect1d(a, b)) >= len(a) - 2  # a shifted copy is cut at the same places
    assert a[-1] == len(body) and (np.diff(a) > 0).all() and np.diff(a, prepend=0).max() <= f.LONGEST
    memory = f.Memory()
    for t in (body, b"some other beginning " + body):
        counted = f.Counted(t, memory)
        tokens = TOKEN.findall(t.decode())
        assert counted.tokens == len(tokens)
        for k in [0, 1, 2, len(tokens) - 1, len(tokens), *rnd.sample(range(len(tokens)), 50)]:
            assert counted.cut_after(k) == (len("".join(tokens[:k]).encode()), len("".join(tokens[:k])))
    assert memory.hits >= len(a) - 3


def test_a_checksum_alone_is_not_believed(monkeypatch):
    monkeypatch.setattr(f.zlib, "crc32", lambda piece: 1)
    memory = f.Memory()
    assert memory(b"a b c") == (2, True, True, 5) and memory(b"abcde") == (0, True, True, 5) and memory(b"a b c") == (2, True, True, 5)
    small = f.Memory(limit=4000)
    for i in range(1000):
        small(b"piece %d" % i)
    assert len(small.new) + len(small.old) < 40
