import random
import re
from collections import Counter

from regrowth.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x\n\nx\n x\nx", "é ß 日本 語 #*$ 😀 | <>", "a " * 50, "ab\x0bcd\x0cef\rgh"]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) + "\n" + " ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(60)]
    texts += [" ".join(f"w{i % 4000}" for i in range(9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in q.text_statistics(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)


def corpus(spark, n=900):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(30, 80))]
        if bad:
            words = [w if rnd.random() < 0.6 else "#%$" + w for w in words]
        rows.append((i, " ".join(words), "z"))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_the_planted_rule_and_keeps_clean_documents(spark):
    docs, labels = corpus(spark)
    out, rules = q.judge(docs, labels)
    assert 1 <= len(rules) <= q.MAX_RULES
    got = {r.doc_id: r.kept for r in out.collect()}
    assert len(got) == 900
    assert sum(got[i] for i in range(900) if i % 3) >= 598
    assert sum(not got[i] for i in range(0, 900, 3)) >= 290


def test_no_labels_and_empty_tables(spark):
    docs, labels = corpus(spark, 30)
    out, rules = q.judge(docs, labels.limit(0))
    assert rules == [] and all(r.kept == (not r.base_failed) for r in out.collect())
    assert q.quality(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = q.quality(odd, spark.createDataFrame([(None, 0), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")).collect()
    assert len(rows) == 3 and not any(r.kept for r in rows)
