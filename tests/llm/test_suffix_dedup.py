import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from regrowth.llm import suffix_dedup as s


def plain_way(rows, length):
    """Count every window of the input, then cover."""
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in bodies:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def word_text(rnd, n, pool=3000):
    return " ".join(f"w{rnd.randrange(pool)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(pool)}" for _ in range(n))


def corpus(rnd):
    passage, line = word_text(rnd, 150), "The quick licence line of this corpus, " * 4
    base = word_text(rnd, 400)
    texts = ["", None, "short", "-" * 900, "-" * 450, "=" * 399, "ab" * 700, "x" + "ab" * 700, passage, base, base, base]
    for i in range(40):
        kind = i % 5
        t = word_text(rnd, rnd.randint(1, 250))
        if kind == 0:
            t += " " + passage[rnd.randint(0, 300) :] + " " + word_text(rnd, 30)
        if kind == 1:
            t = f"{t} {line} {word_text(rnd, 40)}"
        if kind == 2:
            w = base.split()
            for _ in range(rnd.randint(1, 8)):
                w[rnd.randrange(len(w))] = "edited"
            t = " ".join(w)
        if kind == 3:
            t = t + " " + t
        texts.append(t)
    return [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, "twice " * 200, "y", 2)] * 2 + [(None, "no id " + passage, "z", 3)]


def test_order_and_marks_of_a_bucket():
    rnd = random.Random(1)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abcdefgh "
        unit = "".join(rnd.choice(letters) for _ in range(60))
        contents = []
        for _ in range(rnd.randint(1, 12)):
            a = rnd.randint(0, 40)
            contents.append(("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) + unit[a:] + rnd.choice(["", "-" * 50, "a" * 45, unit])).encode())
        length = rnd.choice([9, 16, 21])
        contents = [c for c in contents if len(c) >= length] or [b"a" * length]
        count = Counter(c[i : i + length] for c in contents for i in range(len(c) - length + 1))
        for c, marked in zip(contents, s.repeated_windows(contents, length), strict=True):
            assert marked.tolist() == [count[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]
        raw = b"".join(c + b"\xff" for c in contents) + b"\xff" * length
        first = np.cumsum([0] + [len(c) + 1 for c in contents[:-1]])
        last = first + [len(c) - length for c in contents]
        order = s.two_stage_order(np.frombuffer(raw, np.uint8), raw, first, last, length)
        assert sorted(order.tolist()) == [i for a, b in zip(first, last) for i in range(a, b + 1)]
        keys = [raw[i : i + length] for i in order]
        assert keys == sorted(keys)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    passage = word_text(rnd, 200).encode()
    a, b = b"first " * 40 + passage, word_text(rnd, 77).encode() + passage + b" end" * 90
    found = []
    for t in (a, b):
        h, at, start, n = s.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]), 400)
        assert n.sum() == len(t) - 399 and (start[1:] == start[:-1] + n[:-1]).all() and ((at >= start + n - 1) & (at + 128 <= start + 400)).all()
        off = t.index(passage)
        found.append({(int(w) - off, int(x), int(p) - off) for x, p, q, k in zip(h, at, start, n) for w in range(q, q + k) if off <= w <= off + len(passage) - 400})
    assert found[0] == found[1]


@pytest.mark.parametrize("anchor_bytes, length", [(1 << 19, 400), (3000, 400), (500, 150)])
def test_contract(spark, monkeypatch, anchor_bytes, length):
    monkeypatch.setattr(s, "STRETCH", 5000)
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string, n int").repartition(3)
    out = s.digests(s.remove_repeats(docs, length=length, bucket_bytes=20_000, anchor_bytes=anchor_bytes))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in out.collect()) == plain_way(rows, length)


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert s.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 1
