import os
import random
import zlib

import numpy as np
import pytest

from regrowth.llm import language_id as li

SF = "/root/testdata/sf0.01"


def gram_set(text):
    s = f" {li._GAPS.sub(' ', text.lower()).strip()} "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def test_grams_and_products_match_sets(monkeypatch):
    texts = ["Hello, world 12!", "é ß 日本語テキスト 😀 x", "a", "one two  three\n", "ab" * 300]
    for piece in (1 << 19, 7):
        monkeypatch.setattr(li, "PIECE", piece)
        assert [len(li.grams(t)) for t in texts] == [len(gram_set(t)) for t in texts]
    held = [li.grams(t) for t in texts[:3]]
    vocabulary = np.unique(np.concatenate(held))
    bits = np.zeros((len(vocabulary), 3))
    for j, g in enumerate(held):
        bits[np.searchsorted(vocabulary, g), j] = 1 / np.sqrt(len(g))
    got = li.Presence(vocabulary, bits)(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:3]):
            x, y = gram_set(a), gram_set(b)
            assert got[i, j] == pytest.approx(len(x & y) / np.sqrt(len(x) * len(y)))


def test_defined_cases(spark):
    rnd = random.Random(1)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(30))
    rows = [(i, make("abcdefg" if i % 2 else "nopqrst"), "aa" if i % 2 else "bb", 1.0) for i in range(120)]
    rows += [(900, None, "aa", 0.0), (901, "", None, 0.0), (902, "12 ... 34", "bb", 0.0), (903, make("abcdefg"), None, 0.0), (903, make("abcdefg"), None, 0.0), (None, make("nopqrst"), None, 0.0)]
    rows += [(904, make("abcdefg") * 400, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = li.identify(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "null").encode()) % 5 == 0)
        want = "und" if r.doc_id in (900, 901, 902) else "bb" if r.doc_id is None or (r.doc_id < 900 and r.doc_id % 2 == 0) else "aa"
        assert r.lang_pred == want
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert li.identify(docs.limit(0)).count() == 0
    unknown = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in li.identify(unknown).collect()] == ["und"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = li.identify(docs, keep=("lang", "text")).where("held_out and _k0 is not null").collect()
    right = sum(r.lang_pred == r._k0 for r in out)
    wrong = sorted((round(r.score, 2), len(r._k1), r._k0, r.lang_pred) for r in out if r.lang_pred != r._k0)
    print(len(out), right, wrong[:20], sorted(round(r.score, 3) for r in out)[:12])
    assert right >= 0.97 * len(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_texts_of_unlearned_languages_and_noise_go(spark):
    rnd = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    other = [
        "Ang lahat ng tao ay isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila ay pinagkalooban ng katwiran at budhi",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である", "Люди",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(rnd.randint(3, 9))) for _ in range(60)),
    ]
    short = ["only a short one", "the", "no", "All human beings are born free."]
    extra = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(other + short)], docs.schema)
    kept = {r.doc_id for r in li.keep_identified(docs.unionByName(extra)).select("doc_id").collect()}
    assert [i for i in range(len(other + short)) if 10**9 + i in kept] == list(range(len(other), len(other + short)))
    clean = [r.doc_id for r in docs.where("lang is not null").collect() if r.doc_id is not None]
    assert sum(i not in kept for i in clean) <= 0.002 * len(clean)


def test_a_language_of_long_texts_only_is_learned(spark):
    rnd = random.Random(4)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, make("abcdefg", 40), "aa") for i in range(60)] + [(i, make("nopqrst", 4500), "bb") for i in range(60, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(len(t) > li.SAMPLE_CHARS for _, t, lang in rows if lang == "bb")
    got = {r.doc_id: r.lang_pred for r in li.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
