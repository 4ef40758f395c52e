import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from regrowth.llm import periodic_runs as r


def plain_runs(w, shortest=24, least=3):
    """Every maximal run by comparing words, period by period."""
    out, n = {}, len(w)
    for p in range(1, n // least + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(shortest, least * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def found(texts, **how):
    t, s, n, p = r.find_runs([np.array(x, dtype=np.int64) for x in texts], **how)
    return [sorted((int(b), int(c), int(d)) for a, b, c, d in zip(t, s, n, p) if a == k) for k in range(len(texts))]


def random_text(rnd):
    w = []
    while len(w) < rnd.randint(0, 300):
        kind = rnd.random()
        base = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 12))]
        w += base * rnd.randint(1, 9) + base[: rnd.randint(0, len(base))] if kind < 0.6 else base
    return w


def test_cover_reaches_every_pair():
    for a in range(r.MODULUS):
        for b in range(r.MODULUS):
            assert {(a + r.SHIFT[a, b]) % r.MODULUS, (b + r.SHIFT[a, b]) % r.MODULUS} <= set(r.COVER.tolist())


def test_runs_against_comparison():
    rnd = random.Random(1)
    for _ in range(60):
        texts = [random_text(rnd) for _ in range(rnd.randint(1, 8))]
        assert found(texts) == [plain_runs(x) for x in texts]
        assert found(texts, shortest=4, least=2) == [plain_runs(x, 4, 2) for x in texts]
    assert found([[1] * 500, [], [1] * 23, [1] * 24, list(range(9)) * 40, [1] * 500]) == [[(0, 500, 1)], [], [], [(0, 24, 1)], [(0, 360, 9)], [(0, 500, 1)]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=4))
def test_runs_of_few_words(texts):
    assert found(texts, shortest=6, least=3) == [plain_runs(x, 6, 3) for x in texts]


def test_extensions():
    rnd = np.random.default_rng(2)
    w = np.append(np.tile(rnd.integers(0, 3, 40), 9), np.append(rnd.integers(0, 2, 200), 99))
    e = r.Extensions(w)
    i, j = rnd.integers(0, len(w), (2, 4000))
    i, j = i[i != j], j[i != j]
    for a, b, got in zip(i, j, e(i, j)):
        k = 0
        while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
            k += 1
        assert k == got


def test_grid_blocks(monkeypatch):
    rnd = random.Random(3)
    texts = [random_text(rnd) for _ in range(5)]
    monkeypatch.setattr(r, "GRID", 50)
    assert found(texts) == [plain_runs(x) for x in texts]


def plain_way(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"null" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{a},{q}\n" for s, a, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_contract(spark, monkeypatch):
    monkeypatch.setattr(r, "SLICE_WORDS", 400)
    rnd = random.Random(4)
    texts = ["", None, " \n", "one", "a " * 23, "a " * 24, "x y\tz\n" * 30, "é ü q " * 20, "la " * 9000 + "end", " ".join(map(str, range(5000)))]
    texts += [" ".join(f"w{x}" for x in random_text(rnd)) for _ in range(120)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(7, "a b " * 50, "d", 2)] * 2 + [(None, "q " * 40, "e", 3), (-5, "q r s " * 40, "e", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int").repartition(3)
    out = r.digests(r.periodic_runs(r.planted(docs)))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(str(tuple(x)) for x in out.collect()) == sorted(str(plain_way(x[0], x[1])) for x in rows)
    assert r.periodic_runs(docs.limit(0)).count() == 0
