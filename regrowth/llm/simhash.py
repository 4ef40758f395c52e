"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. At most 3 differing bits touch at most 3 bytes, so linked fingerprints share
at least ``GUARANTEED`` = 5 positional bytes. A posting list of one byte would hold 1/256 of all fingerprints, and its pairs
would grow with their square. Positions are therefore posted in fours: the 14 blocks of the Steiner system S(3, 4, 8) (four
positions whose numbers xor to 0). Any five positions contain exactly one block, so each pair that shares five meets, in lists
keyed by 32 bits. For each pair the shared positional bytes are tallied, pairs below the guaranteed count go, and the rest is
verified bit by bit. Equal fingerprints are one entry of the index: groups of copies never form pairs.

Defined cases: a null text or one without a word has fingerprint zero, linked like any other; a text of one or two words has
one shingle; repeated rows give one row each; a null id is kept, is never the name of a component while another id is there,
and an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from regrowth.llm.common import lower_words, raw_bytes
from regrowth.llm.components import components
from regrowth.llm.decontaminate import hash_filter
from regrowth.session import materialise

SEED = 42
MAX_BITS = 3
GUARANTEED = 8 - MAX_BITS
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bits set in over half of the shingles' hashes, repeats included; as a signed long."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(size, len(words))
    hashed = xxhash.xxh64_intdigest
    spots = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in spots], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (longs) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t) for t in raw_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(got, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``fp`` that differ in 1 to 3 bits."""
    postings = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), sum(F.shiftleft(_byte(p), 8 * k) for k, p in enumerate(block)).alias("bytes"))
        for i, block in enumerate(BLOCKS)
    ])).alias("at")).select(F.col("at.block").alias("block"), F.col("at.bytes").alias("bytes"), "fp")
    # unordered duplicates: a pair that shares more than five bytes meets in several lists
    left, right = postings.withColumnRenamed("fp", "a"), postings.withColumnRenamed("fp", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum(F.when(F.shiftrightunsigned(differing, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8))
    met = left.join(right, ["block", "bytes"]).where((F.col("a") < F.col("b")) & (shared >= GUARANTEED) & (F.bit_count(differing) <= MAX_BITS))
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links), and the
    ``text_hash`` if asked for."""
    rows = materialise(fingerprints(docs, key, text), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    pairs = materialise(linked_pairs(distinct.select("fp")), "linked-pairs")
    names = components(pairs)  # only fingerprints that have a link
    of = distinct.join(names, distinct["fp"] == names["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("_c"))
    least = of.groupBy("_c").agg(F.min("first").alias("component_id"))
    of = materialise(of.join(least, "_c").select("fp", "component_id"), "fingerprint-components")
    out = rows.join(of, "fp").withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    return out.select("doc_id", "fingerprint", "component_id", *["text_hash"] * with_hash)


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the least (id, text hash); of its repeated rows one stays. Rows without an id stay.

    ``found`` comes from ``near_duplicates`` with the text hash: a row is known by its id and its text, so rows that share an id
    but not the text stand for themselves. What goes, and what occurs more than once, is written first; a filter of bounded size holds
    it, so that other rows pass in place and only what may be of it is shuffled with its text.
    """
    at = ["_id", "_hash"]
    members = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    members = materialise(members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(*at)).alias("_first"))
    told = members.join(first, "component_id").withColumn("_stays", F.col("_first") == F.struct(*at))
    gone = materialise(told.where(~F.col("_stays")).select(*at), "gone")
    repeated = materialise(told.where(F.col("_stays") & (F.col("n") > 1)).select(*at), "repeated")
    keyed = docs.select("*", F.col(key).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_hash"))
    held = hash_filter(gone.unionByName(repeated).select(F.xxhash64(*at).alias("hash")))
    keyed = keyed.withColumn("_held", held(F.xxhash64(*at)))
    clear = keyed.where(~F.col("_held")).select(*docs.columns)
    kept = materialise(keyed.where("_held").drop("_held"), "held-rows").join(gone, at, "left_anti")
    once = kept.join(repeated, at, "left_anti").select(*docs.columns)
    many = kept.join(repeated, at, "left_semi").groupBy(*at).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return clear.unionByName(once).unionByName(many)
