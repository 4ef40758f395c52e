import hashlib
import itertools
import random
import re

import public_tokenizers
import pytest
from test_pii import brute as personal
from test_near_copies import changed, jaccard, shingles, word
from test_simhash import brute_components

import corpus_pipeline
from regrowth.llm import chunked_bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    alphabets = {"aa": "abcdefghij", "bb": "nopqrstuvw"}
    word = lambda lang: "".join(rnd.choice(alphabets[lang]) for _ in range(rnd.randint(3, 9)))
    items = [(k, " ".join(word("aa") for _ in range(rnd.randint(20, 40)))) for k in range(5)]
    rows = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        words = [word(lang) for _ in range(rnd.randint(60, 160))]
        if i % 10 == 3:
            words[20:20] = items[i % 5][1].split()
        if i % 7 == 0:
            words[5:5] = [f"x.{i}@mail.example.com", f"10.0.{i}.7"]
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "copy") for i in range(0, 40, 4)] + [(0, rows[0][1], "bb", "again")]
    rows += [(300, None, None, None), (301, "", None, "s"), (302, "12 34 ... !", "aa", "s"), (303, "only a short one", None, "s")]
    path = tmp_path_factory.mktemp("tables")
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        after = docs.collect()
        if name != "byte-level BPE":
            assert docs.columns == columns
        ids = [r.doc_id for r in after]
        if name == "language ID":
            assert sorted(ids) == sorted(r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text))
        elif name == "SimHash near-dedup":
            sets = {r.doc_id: shingles(r.text) for r in before}
            linked = [(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
            assert sorted(ids) == sorted(set(brute_components(sets, linked).values()))
        elif name == "benchmark decontamination":
            grams = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(len(w) - 12)}
            held = {r.doc_id for r in before if any(tuple(words(r.text)[i : i + 13]) in grams for i in range(len(words(r.text)) - 12))}
            assert held and sorted(ids) == sorted(r.doc_id for r in before if r.doc_id not in held)
        elif name == "PII":
            assert sorted(ids) == sorted(r.doc_id for r in before)
            for r in after:
                assert not personal(r.text) and r.n_chars == len(r.text)
                if not personal(rows[r.doc_id].text):
                    assert r.text == rows[r.doc_id].text
        else:
            own = chunked_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            texts = {r.doc_id: r.text for r in before}
            assert sorted(ids) == sorted(texts)
            for r in after:
                assert list(r.ids) == own.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_copies_are_caught_and_distinct_texts_stay(spark, folder):
    """Copies at a similarity of 0.8 to 0.95: at least nine in ten go, and nothing else does."""
    rnd = random.Random(21)
    bases = [[word(rnd) for _ in range(rnd.choice([50, 120, 300]))] for _ in range(300)]
    copies = [changed(rnd, w, max(1, round(len(w) * rnd.uniform(0.004, 0.022)))) for w in bases]
    far = [changed(rnd, w, len(w) // 10) for w in bases]
    texts = [" ".join(w) for w in bases + copies + far]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, folder).collect()}
    similar = {300 + i for i in range(300) if jaccard(shingles(texts[i]), shingles(texts[300 + i])) >= 0.8}
    assert len(similar) > 150 and len(similar - kept) >= 0.9 * len(similar)
    assert kept >= set(range(900)) - similar


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and set(out.columns) >= {"doc_id", "n_tokens", "ids"}
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
