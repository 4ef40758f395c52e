import zlib

import numpy as np

from regrowth.llm import sharding


def jump_one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_scalar_and_moves_only_into_new_shard():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    for n in (1, 2, 7, 40):
        assert [jump_one(int(k) % 2**64, n) for k in keys[:500]] == sharding.jump(keys[:500], n).tolist()
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert set(b[a != b]) == {40}
    assert abs((a != b).mean() - 1 / 41) < 0.015


def test_shards(spark):
    rows = [(i, f"text {i % 5} é", "x", None) for i in range(300)] + [(None, None, None, None), (7, "text 2 é", "x", None), (7, "text 2 é", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot string")
    out = sharding.shard_rows(docs, 8, buckets=3).collect()
    assert len(out) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in out:
        if r.doc_id is not None:
            text = f"text {r.doc_id % 5} é".encode()
            assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 8)
    assert [r.size for r in out if r.doc_id is None] == [16]
    assert sharding.shard_rows(docs.limit(0), 8).count() == 0


def test_a_hot_key_is_numbered_in_many_buckets(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "'same' AS text")
    seen = []
    kept = sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    out = sharding.shard_rows(docs, 4, buckets=16).collect()
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    hot = [sharding.F.pmod(sharding.F.xxhash64("_key", "_row"), sharding.F.lit(16))]
    largest = seen[0].where("doc_id = 5").groupBy(*hot).count().agg({"count": "max"}).first()[0]
    assert largest < 150
