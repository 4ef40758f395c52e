import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regrowth.llm import language_model as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def seatings(c, discount, others, base):
    """Probability of each number of tables, by all partitions of c customers."""
    weight = Counter()

    def go(i, sizes, w):
        if i == c:
            weight[len(sizes)] += w
            return
        for k in range(len(sizes)):
            go(i + 1, sizes[:k] + (sizes[k] + 1,) + sizes[k + 1 :], w * (sizes[k] - discount))
        go(i + 1, (*sizes, 1), w * (lm.STRENGTH + discount * (others + len(sizes))) * base)

    go(0, (), 1.0)
    total = sum(weight.values())
    return {t: w / total for t, w in weight.items()}


@pytest.mark.parametrize("c,others,base", [(2, 3, 0.1), (5, 0, 0.3), (6, 20, 0.02)])
def test_table_draws_follow_the_seating_law(c, others, base):
    n, d = 40_000, 0.6
    got = Counter(lm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, np.random.default_rng(1)).tolist())
    for t, p in seatings(c, d, others, base).items():
        assert got[t] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-4)


@pytest.mark.parametrize("c,others,base", [(400, 500.0, 0.2), (500, 40.0, 0.5), (300, 4000.0, 0.02)])
def test_many_customers_follow_the_exact_law(monkeypatch, c, others, base):
    args = (np.full(3000, c), np.full(3000, others), np.full(3000, base), 0.7)
    exact = lm.draw_tables(*args, np.random.default_rng(1))
    monkeypatch.setattr(lm, "EXACT_CUSTOMERS", 20)
    close = lm.draw_tables(*args, np.random.default_rng(2))
    assert close.mean() == pytest.approx(exact.mean(), rel=0.08, abs=0.5) and close.std() == pytest.approx(exact.std(), rel=0.25)


def test_extreme_counts():
    t = lm.draw_tables([50_000_000, 0, 1, 700], [10.0] * 4, [0.1] * 4, 0.7, np.random.default_rng(3))
    assert 1 <= t[0] < 50_000_000 and t[1] == 0 and t[2] == 1 and 1 <= t[3] <= 700


def test_rare_words_sum_to_one():
    spectrum = {1: 50, 2: 20, 3: 7, 40: 2}
    p = lm.sample_rare(spectrum)
    assert 10 ** p[0] + sum(m * 10 ** p[c] for c, m in spectrum.items()) == pytest.approx(1)
    assert p[0] < p[1] < p[2] < p[40]
    assert lm.sample_rare({}) == {0: 0.0}


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w] + [""]


@pytest.mark.parametrize("held", [131_072, 30])
def test_scores(spark, monkeypatch, held):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words, at = [], rnd.randrange(60)
        for _ in range(rnd.randint(1, 40)):
            at = (at * 7 + rnd.choice([1, 1, 1, 5])) % 60  # each word has few successors
            words.append(vocabulary[at] if rnd.random() < 0.95 else f"X{rnd.randrange(500)}")
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, "Ünknown W1 x  w2\n"), (None, "w1 w2"), (5, "w3"), (5, "w3")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    fold = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 10
    counts = Counter(x for i, t in rows if fold(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    model = lm.learn(docs.where(lm.crc_bucket("doc_id", 10) != 0), classes=20, held_words=held)
    assert np.allclose((10 ** model.log_pair.astype(float)).sum(axis=1), 1, atol=1e-4)
    out = lm.score(docs, model).collect()
    assert len(out) == len(rows)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        want.append((str(i), fold(i) == 0, len(own), sum(counts[x] > 0 for x in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
    # the model's own sum, token by token
    rank = {w.decode(): k for k, w in enumerate(model.words)}
    k = model.classes
    for r, (i, t) in itertools.product(out, rows[:40]):
        if r.doc_id == i and i != 5:
            total, before = 0.0, k + 1
            for x in tokens(t):
                c = rank.get(x, k) if rank.get(x, k) < k else k
                total += float(model.log_pair[before, c]) + (model.rare[counts[x]] if c == k else 0.0)
                before = c
            assert r.score == pytest.approx(total, abs=1e-6)
    by = {r.held_out: r for r in lm.perplexity(spark.createDataFrame(out)).collect()}
    assert by[True].model < 0.8 * by[True].base and by[False].model < by[False].base


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm.learn(docs.limit(0))
    out = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert out[1].n_tokens == 3 and out[1].n_known == 0 and out[1].base_score == 0 and out[2].n_tokens == 1
    assert lm.learn_and_score(docs.limit(0)).count() == 0


def test_words_beyond_the_most_frequent_are_contexts_too(spark):
    rnd = random.Random(8)
    n, rows = 6000, []
    for i in range(3000):
        at, words = rnd.randrange(n), []
        for _ in range(20):
            words.append(f"w{at}")
            at = (at * 7 + 1) % n  # each word has one successor
        rows.append((i, " ".join(words)))
    out = lm.learn_and_score(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.held_out: r for r in lm.perplexity(out).collect()}
    assert got[True].base > 2000 and got[True].model < 20


def test_probabilities_after_a_context_sum_to_one(spark):
    rnd = random.Random(4)
    vocabulary = ["a", "b", "c", "d"]
    train = [" ".join(rnd.choices(vocabulary, [8, 4, 2, 1], k=rnd.randint(0, 12))) for _ in range(40)]
    # each word, the end and a new word after each context; ``new`` is a context without customers
    held = [f"{x} {y}" for x in [*vocabulary, "new"] for y in [*vocabulary, "new"]] + [*vocabulary, "new", ""]
    rows = spark.createDataFrame([(True, t) for t in train] + [(False, t) for t in held], "train boolean, text string")
    pairs = lm.all_pairs(rows)
    count = Counter(p for t in train for p in zip(["^", *tokens(t)[:-1]], tokens(t)))
    assert sorted(r.c for r in pairs.where("c > 0").collect()) == sorted(count.values())
    values, n_train = lm.pair_values(pairs)
    assert n_train == sum(count.values())
    after = {}
    for r in values.collect():
        after.setdefault(r.u, []).append(10**r.value)
    assert len(after) == 6
    for own in after.values():
        assert len(own) == 6 and sum(own) == pytest.approx(1)


def test_all_word_scores_count_like_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "Ünknown A x  b\n"), (None, "a b"), (5, "c"), (5, "c")]
    fold = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % 10
    counts = Counter(x for i, t in rows if fold(i) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        want.append((str(i), fold(i) == 0, len(own), sum(counts[x] > 0 for x in own), n, round(base, 6)))
    out = lm.learn_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)


def test_only_dishes_whose_tables_can_change_are_seated(spark, monkeypatch):
    kept, real = [], lm.materialise

    def materialise(df, name, path=None):
        kept.append((name, real(df, name, path)))
        return kept[-1][1]

    monkeypatch.setattr(lm, "materialise", materialise)
    words = ["common", "pair", *(f"rare{i}" for i in range(30)), "new"]
    train = [(True, f"common pair rare{i}") for i in range(30)]
    held = [(False, f"pair {w}") for w in words] + [(False, "pair")]  # each word and the end after one context
    values, n_train = lm.pair_values(lm.all_pairs(spark.createDataFrame(train + held, "train boolean, text string")))
    assert n_train == 120
    assert [df for name, df in kept if name == "parent"][-1].count() == 3  # common, pair and the end; rare words have one table whatever is drawn
    pair = int(lm.token_hashes([b"pair"]).view("int64")[0])
    after = [10**r.value for r in values.where(F.col("u") == pair).collect()]
    assert len(after) == len(words) + 1 and sum(after) == pytest.approx(1)


def test_scoring_sorts_neither_pairs_nor_texts(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(60)], "doc_id long, text string")
    plan = lm.score_words(docs)._jdf.queryExecution().executedPlan().toString()
    on_pairs = [x for x in plan.splitlines() if "Join [u#" in x and ", v#" in x]
    assert on_pairs and all("ShuffledHashJoin" in x for x in on_pairs)


def test_counted_pairs_add_up():
    rnd = np.random.default_rng(2)
    u, v = (rnd.integers(0, 2**63, 40).astype(np.uint64)[rnd.integers(0, 40, 5000)] for _ in range(2))
    want = Counter(zip(u.tolist(), v.tolist()))
    got = Counter()
    for a, b, n in zip(*lm._counted(u, v), strict=True):
        got[int(a), int(b)] += int(n)
    assert got == want


@pytest.mark.parametrize("at_once", [3, 200_000])
def test_texts_split_over_output_batches_keep_their_tokens(spark, monkeypatch, at_once):
    monkeypatch.setattr(lm, "PAIRS_A_BATCH", at_once)
    texts = [" ".join("abcd"[j % 4] for j in range(i % 9)) for i in range(50)]
    out = lm.score_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(i, len(t.split()) + 1) for i, t in enumerate(texts)]
