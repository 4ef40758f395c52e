import itertools
import random

from test_simhash import LOWER, brute_components

from regrowth.llm import near_copies, simhash

SPACES = "[\x20\x09-\x0d]+"


def shingles(text):
    words = [w for w in __import__("re").split(SPACES, (text or "").translate(LOWER)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def word(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))


def changed(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = word(rnd)
    return out


def test_lines_cover_each_pair_of_positions_once():
    assert len(near_copies.SYSTEM) == 155 and len({frozenset(x) for x in near_copies.LINES}) == len(near_copies.LINES) < 256
    pairs = [p for line in near_copies.SYSTEM for p in itertools.combinations(line, 2)]
    assert len(pairs) == len(set(pairs)) == 31 * 30 // 2 and {p for x in near_copies.LINES for p in x} == set(range(1, 32))


def test_recall_of_the_lists():
    """Share of pairs that meet in a list and stay within the bits, by similarity."""
    rnd = random.Random(8)
    met = {0.80: [], 0.84: [], 0.88: []}
    for _ in range(1500):
        words = [word(rnd) for _ in range(rnd.choice([60, 150, 400]))]
        other = changed(rnd, words, max(1, round(len(words) * rnd.uniform(0.010, 0.024))))
        (_, a), (_, b) = (near_copies.shingle_set(" ".join(w).encode()) for w in (words, other))
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        level = max((x for x in met if x <= j), default=None)
        if level is None:
            continue
        fa, fb = (near_copies.wide_fingerprint(x).tobytes() for x in (a, b))
        same = {p for p in range(1, 32) if fa[p] == fb[p]}
        bits = sum(bin(x ^ y).count("1") for x, y in zip(fa, fb, strict=True))
        met[level].append(any(same.issuperset(line) for line in near_copies.LINES) and bits <= near_copies.MAX_BITS)
    shares = {k: sum(v) / len(v) for k, v in met.items()}
    assert all(len(v) > 100 for v in met.values()) and shares[0.80] >= 0.9 and shares[0.84] >= 0.93 and shares[0.88] >= 0.98


def test_components_match_all_verified_pairs_of_the_lists(spark):
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "two words"), (6, "a b c d e f"), (6, "A b C d e f"), (None, "a b c d e f"), (None, "alone here")]
    at = 10
    for k in range(10):
        base = [word(rnd) for _ in range(rnd.randint(60, 150))]
        family = [base]
        for _ in range(7):  # chains: copies of copies, so that not all members are similar to one leader
            family.append(changed(rnd, family[-1] if k % 2 else base, rnd.randint(1, 2)))
        for words in family:
            rows.append((at, rnd.choice([" ", "\n", "\t "]).join(words)))
            at += 1
    rows.append((at, " ".join(word(rnd) for _ in range(30_000))))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    sets = [shingles(t) for _, t in rows]
    fps = [near_copies.wide_fingerprint(near_copies.shingle_set((t or "").encode())[1]).tobytes() for _, t in rows]

    def meet(a, b):
        same = {p for p in range(1, 32) if fps[a][p] == fps[b][p]}
        bits = sum(bin(x ^ y).count("1") for x, y in zip(fps[a], fps[b], strict=True))
        return any(same.issuperset(line) for line in near_copies.LINES) and bits <= near_copies.MAX_BITS

    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(sets[a], sets[b]) >= 0.8 and meet(a, b)]
    similar = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    assert len(linked) >= 0.9 * len(similar)
    comp = brute_components(range(len(rows)), linked)
    least = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[k][0])
    found = near_copies.near_copies(docs)
    want = sorted((str(rows[k][0]), str(least.get(comp[k]))) for k in range(len(rows)))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found.collect()) == want
    kept = simhash.keep_one(docs, found).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([str(v) for v in set(least.values())] + ["None", "None"])


def test_a_large_group_and_an_empty_table(spark):
    rnd = random.Random(11)
    base = [word(rnd) for _ in range(300)]
    rows = [(i, " ".join(changed(rnd, base, 1 + i % 3))) for i in range(400)] + [(i, " ".join(word(rnd) for _ in range(200))) for i in range(400, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert sum(got[i] == 0 for i in range(400)) == 400 and all(got[i] == i for i in range(400, 800))
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_short_lists_write_near_pairs_only(spark):
    """Of the pairs that strangers make in a list few are written; the near pairs of a short list are all met, a long list keeps its members."""
    rnd = random.Random(3)
    fps = []
    for k in range(60):  # twenty lists of three strangers in the first line, of positions 1, 2 and 3
        fps.append([k // 3 << 8 | 7 << 16 | 9 << 24 | rnd.getrandbits(31) << 32, *[rnd.getrandbits(63) for _ in range(3)]])
    family = [rnd.getrandbits(63) for _ in range(4)]
    fps += [[family[0], family[1], family[2], family[3] ^ (1 << k)] for k in range(4)]  # four near ones
    crowd = [rnd.getrandbits(63) for _ in range(4)]
    fps += [[crowd[0], crowd[1], crowd[2], crowd[3] ^ (1 << k)] for k in range(near_copies.SHORT + 1)]
    nodes = spark.createDataFrame([(i, *f) for i, f in enumerate(fps)], "node long, f0 long, f1 long, f2 long, f3 long")
    rows = near_copies.met_lists(near_copies.postings(nodes)).collect()
    met = {(r.node, b) for r in rows for b in r.partners or [] if r.at >> 24 == 0}
    assert len([a for a, _ in met if a < 60]) <= 6  # 3 % of the 60 pairs are within the bits by chance
    assert {(a, b) for a, b in met if a >= 60} == set(itertools.combinations(range(60, 64), 2))
    assert sorted(r.node for r in rows if r.at >> 24 == 0 and r.partners is None) == list(range(64, 64 + near_copies.SHORT + 1))
    assert all(near_copies.free_word(x) not in {p // 8 for p in x} for x in near_copies.LINES)


def test_profiles_rule_out_strays_and_no_similar_pair(spark):
    """Strays of a group share most shingles with every member and are similar to none: none of these pairs is verified on whole sets."""
    rnd = random.Random(12)
    base = [word(rnd) for _ in range(150)]
    texts = [changed(rnd, base, 1) for _ in range(30)] + [changed(rnd, base, 5) for _ in range(30)]
    for n in (3, 40, 900, 6000):  # copies around the similarity, short and long
        own = [word(rnd) for _ in range(n)]
        texts += [changed(rnd, own, max(1, round(n * share))) for share in (0.01, 0.02, 0.03, 0.04)]
    sets = [near_copies.shingle_set(" ".join(t).encode())[1] for t in texts]
    rows = [(i, *near_copies.wide_fingerprint(s).tolist(), *near_copies.profile(s).tolist()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{c} long" for c in near_copies.PARTS + near_copies.BOUND))
    pairs = list(itertools.combinations(range(len(texts)), 2))
    kept = {(r.a, r.b) for r in near_copies._differing(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    own = [set(s.tolist()) for s in sets]
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(rows[a][1:5], rows[b][1:5], strict=True))
    similar = {(a, b) for a, b in pairs if jaccard(own[a], own[b]) >= 0.8 and bits(a, b) <= near_copies.MAX_BITS}
    assert len(similar) > 400 and similar <= kept
    strays = {(a, b) for a, b in pairs if b < 60 and b >= 30 and jaccard(own[a], own[b]) < 0.77}
    assert len(strays) > 800 and len(kept & strays) < 0.02 * len(strays)


def test_texts_that_nothing_asks_for_are_not_shuffled(spark):
    """The filter lets through what it holds and hardly anything else; what is kept does not depend on it."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "xxhash64(concat('word ', id)) AS text_hash")
    held = near_copies.hash_filter(rows.where("doc_id < 500").selectExpr("text_hash AS hash"))
    passed = {r.doc_id for r in rows.where(held("text_hash")).collect()}
    assert passed.issuperset(range(500)) and len(passed) < 520
    docs = rows.select("doc_id", "text").unionByName(rows.where("doc_id < 50").select("doc_id", "text"))
    found = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "if(doc_id BETWEEN 100 AND 299, 100, doc_id) AS component_id")
    kept = [r.doc_id for r in simhash.keep_one(docs, found).collect()]
    assert sorted(kept) == [*range(101), *range(300, 20_000)]
