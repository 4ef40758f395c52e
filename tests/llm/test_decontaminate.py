import itertools
import random

import numpy as np

from regrowth.llm import decontaminate as d


def text(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def test_token_hashes_depend_on_the_word_alone():
    words = [b"a", b"ab", b"ba", b"a", "é".encode(), b"ab" * 40]
    h = d.token_hashes(words)
    assert h[0] == h[3] and len({*h.tolist()}) == 5
    assert h[5] == d.token_hashes([b"x", b"ab" * 40])[1]
    assert len(d.token_hashes([])) == 0


def test_seeds_ignore_masked_positions():
    rnd = random.Random(1)
    for m, mask in enumerate(d.MASKS):
        words = [w.encode() for w in text(rnd, len(mask))]
        base = d.seed_hashes(d.token_hashes(words))[m]
        assert len(base) == 1
        for i, keep in enumerate(mask):
            other = words[:i] + [b"zzz"] + words[i + 1 :]
            assert (d.seed_hashes(d.token_hashes(other))[m] == base).all() == (keep == "0")


def test_a_seed_in_every_allowed_placement():
    """12 to 20 words with one in five changed, every placement; longer ones with every fifth or sixth changed."""
    bits = [sum(1 << i for i, c in enumerate(m) if c == "1") for m in d.MASKS]
    hit = lambda kept, n: any(kept >> o & b == b for m, b in zip(d.MASKS, bits) for o in range(n - len(m) + 1))
    for n in range(12, 21):
        for gone in itertools.combinations(range(n), n // 5):
            assert hit((1 << n) - 1 - sum(1 << x for x in gone), n), (n, gone)
    for n, every in ((200, 5), (200, 6)):
        for start in range(every):
            kept = (1 << n) - 1 - sum(1 << x for x in range(start, n, every))
            assert hit(kept, n)


def test_overlap_against_every_stretch():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        same = rnd.random(rnd.integers(0, 40)) < rnd.choice([0.5, 0.8, 0.95])
        best = (0, 0)
        for a, b in itertools.combinations(range(len(same) + 1), 2):
            bad = int((~same[a:b]).sum())
            if same[a] and same[b - 1] and 5 * bad <= b - a and (b - a, -bad) > (best[0], -best[1]):
                best = (b - a, bad)
        assert d._overlap(same) == best
    assert d._overlap(np.ones(5000, bool)) == (5000, 0)


def plain_overlaps(docs, items):
    """Every document against every item on every diagonal."""
    out = set()
    for i, t in docs:
        w = d.words_of((t or "").encode())
        for k, u in items:
            v = d.words_of((u or "").encode())
            best = (0, 0)
            for shift in range(-len(v) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(v), len(w) - shift)
                size, bad = d._overlap(np.array([v[x] == w[x + shift] for x in range(lo, hi)], dtype=bool))
                best = max(best, (size, -bad))
            if v and best[0] >= min(d.MIN_WORDS, len(v)) and len(v) >= 12:
                out.add((i, k, best[0], -best[1]))
    return out


def test_all_positions_against_comparison(spark):
    rnd = random.Random(11)
    items = [(k, " ".join(text(rnd, n))) for k, n in enumerate([12, 13, 15, 20, 30, 90, 200, 200])]
    docs = []
    for i in range(60):
        words = text(rnd, rnd.randint(5, 120))
        part = items[i % 8][1].split()
        if i % 3:
            part = [("x" if rnd.random() < rnd.choice([0.1, 0.18, 0.3]) else w) for w in part]
        if i % 5 == 0:
            part = [("x" if j % 5 == 4 else w) for j, w in enumerate(part)]
        a = rnd.randint(0, max(0, len(part) - 14))
        docs.append((i, " ".join(words[:9] + part[a if i % 4 else 0 :] + words[9:])))
    docs.append((99, items[6][1]))
    out = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {tuple(r) for r in out}, plain_overlaps(docs, items)
    assert got <= want and len(got) >= 0.97 * len(want)
    assert (99, 6, 200, 0) in got  # a whole copy of a long item comes back whole


def test_planted_passages(spark):
    rnd = random.Random(7)
    items = [text(rnd, rnd.randint(14, 60)) for _ in range(40)]
    rows, planted = [], set()
    for i in range(200):
        words = text(rnd, rnd.randint(20, 300))
        if i % 4 == 0:
            k = rnd.randrange(40)
            passage = list(items[k])
            if i % 8 == 0 and len(passage) >= 25:
                for at in range(9, len(passage), 9):  # one word in nine differs
                    passage[at] = "changed"
            at = rnd.randrange(len(words))
            words[at:at] = passage
            planted.add((i, k))
        elif i % 4 == 1:  # shorter than what counts
            k = rnd.randrange(40)
            words[3:3] = items[k][:11]
        rows.append((i, (" " if i % 3 else "\n").join(words).upper() if i % 5 == 0 else ", ".join(words), "q"))
    rows += [(500, None, ""), (501, "", ""), (None, " ".join(items[0]), ""), (502, " ".join(items[1]), ""), (502, " ".join(items[1]), "")]
    planted.add((502, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "short one"), (None, " ".join(items[0]))], "item_id long, text string")
    out = d.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == planted and len(out) == len(planted)
    assert all(r.n_words >= 13 and r.n_substituted <= 0.2 * r.n_words for r in out)
    left = d.drop_contaminated(docs, bench).collect()
    assert len(left) == len(rows) - len(planted) - 1
    assert d.overlaps(docs.limit(0), bench).count() == 0 and d.overlaps(docs, bench.limit(0)).count() == 0
