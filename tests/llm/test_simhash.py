import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from regrowth.llm import simhash
from regrowth.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    comp = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
        if not changed:
            return comp


def test_any_five_positions_hold_exactly_one_block():
    assert len(simhash.BLOCKS) == 14
    for five in itertools.combinations(range(8), 5):
        assert sum(set(b) <= set(five) for b in simhash.BLOCKS) == 1


def test_linked_pairs_match_all_pairs(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(8):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps |= {0, -1, 7}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = sorted(tuple(r) for r in simhash.linked_pairs(df).collect())
    want = sorted((a, b) for a, b in itertools.combinations(sorted(fps), 2) if 1 <= bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    assert got == want


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(4)
    if shape == "path":
        nodes = list(range(60))
        rnd.shuffle(nodes)
        edges = list(zip(nodes, nodes[1:]))
    elif shape == "star":
        edges = [(50, i) for i in range(40)] + [(99, i) for i in range(60, 80)]
    else:
        edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(5, 5), (-9, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "two words"), (6, "A b C"), (6, "A b C"), (None, "A b C"), (None, "lonely text")]
    at = 10
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(40, 120))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((at, rnd.choice([" ", "\n", "\t "]).join(copy)))
            at += 1
    rows.append((at, " ".join(word() for _ in range(40_000))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs).collect()
    fps = [(i, brute_fp(t)) for i, t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3]
    comp = brute_components(range(len(rows)), linked)
    least = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[k][0])
    want = sorted((str(rows[k][0]), f"{fps[k][1]:016x}", str(least.get(comp[k]))) for k in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == want
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs, with_hash=True)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([str(v) for v in set(least.values())] + ["None", "None"])
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_rows_that_share_an_id_stand_for_their_texts(spark):
    a, b = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(1, a, "x"), (9, a, "y"), (9, b, "z"), (9, b, "z"), (None, a, "n"), (None, b + " alone " * 30, "n"), (4, None, "e"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string").repartition(4)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs, with_hash=True)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([rows[0], rows[2], rows[4], rows[5], rows[6]], docs.schema).collect()))
    assert simhash.keep_one(docs.limit(0), simhash.near_duplicates(docs.limit(0), with_hash=True)).count() == 0
