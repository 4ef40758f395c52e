"""Benchmark decontamination by spaced seeds: overlaps that tolerate substituted tokens.

A seed is a window of ``SPAN`` tokens read through a mask: positions marked 0 are ignored, so a substituted token there leaves
the hash as it is. Every window of the benchmark is hashed through every mask; every window of every whole document likewise,
inside the scan, as array arithmetic over token hashes. A bitmap of fixed size, filled from the benchmark's hashes, lets
through the windows that may hit; neighbouring hits of a document are one stretch with its words. The stretches' hashes are
joined with the benchmark's, hits on one diagonal are one overlap, and each overlap is verified on the words themselves: around
the hit, the longest stretch in which at most one word in five differs must hold at least ``MIN_WORDS`` words (or the whole
item, if that is shorter than this but at least as long as a seed).

Defined cases: null or empty texts and texts shorter than a seed have no overlap; an item shorter than a seed matches nothing;
repeated rows of documents or items give one row for each (doc_id, item_id); a null doc_id or item_id is left out of overlaps;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regrowth.llm.common import lower_words, raw_bytes
from regrowth.session import materialise

#: Seed masks, 1 for a token that counts. Together they have a seed in every passage of 12 to 20 words with one word in five
#: changed, wherever the changes stand, and where every fifth or sixth word of a longer one is changed (tested exhaustively).
MASKS = ("11111", "110111")
SPAN = max(map(len, MASKS))
MIN_WORDS, MIN_SAME = 13, 0.8
#: Bits of the filter that goes to the tasks: 2 MB whatever the benchmark's size.
FILTER_BITS = 1 << 24
_R = np.uint64(0x9E3779B97F4A7C15)
_OFFSETS = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def token_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, for all words at once: the sum of its scrambled (byte, place) pairs."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    with np.errstate(over="ignore"):
        data = _mix(data + (place.astype(np.uint64) << np.uint64(8)))
        return np.add.reduceat(data, ends - lengths) if len(data) else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of a well-known generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_hashes(tokens: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of every window."""
    out = []
    with np.errstate(over="ignore"):
        for m, offsets in enumerate(_OFFSETS):
            n = max(0, len(tokens) - len(MASKS[m]) + 1)
            h = np.full(n, m + 1, dtype=np.uint64)
            for o in offsets:
                h = h * _R + tokens[o : o + n]
            out.append(_mix(h))
    return out


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without the punctuation around them; a word of punctuation alone stays as it is."""
    return [w.strip(_PUNCTUATION) or w for w in lower_words(text)]


def _index(benchmark: DataFrame) -> DataFrame:
    """item_id, pos, hash of every window of every item, through every mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, hashes = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), raw_bytes(batch, "text"), strict=True):
                words = words_of(text)
                for h in seed_hashes(token_hashes(words)):
                    ids += [item] * len(h)
                    pos += range(len(h))
                    hashes += h.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(hashes, pa.int64())], ["item_id", "pos", "hash"])

    return benchmark.mapInArrow(run, "item_id long, pos int, hash long")


def _filter(index: DataFrame) -> np.ndarray:
    """The bitmap of the benchmark's hashes, two bits for each; each task sends its set words, which Spark combines."""
    low = index.select(F.explode(F.array(F.shiftrightunsigned("hash", 40), F.shiftrightunsigned("hash", 12).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("bit"))
    words = low.groupBy(F.shiftrightunsigned("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    got = words.toArrow()  # at most FILTER_BITS / 64 rows
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def _is_set(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return ((bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)).astype(bool)


def hash_filter(hashes: DataFrame):
    """A test for a column of 64-bit hashes: true for all of ``hashes`` (its only column, ``hash``) and for some others.

    It is of bounded size, so where it is full more rows pass; what passes is still to be joined.
    """
    bitmap = hashes.sparkSession.sparkContext.broadcast(_filter(hashes))

    @F.arrow_udf("boolean")
    def held(column: pa.Array) -> pa.Array:
        h = column.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(_is_set(bitmap.value, h >> np.uint64(40)) & _is_set(bitmap.value, (h >> np.uint64(12)) & np.uint64(FILTER_BITS - 1)))

    return held


def stretches(docs: DataFrame, bitmap: np.ndarray, reach: int) -> DataFrame:
    """doc_id, at (first word kept), words, hits (hash, pos) of the windows that pass the filter.

    ``reach`` words are kept on either side of a hit, as many as the longest item has, so an overlap is never cut; hits whose
    words would overlap are one stretch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        kind = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_bytes(batch, "text"), strict=True):
                words = words_of(text) if doc is not None else []
                if not words:
                    continue
                tokens = token_hashes(words)
                found = []
                for h in seed_hashes(tokens):
                    ok = np.flatnonzero(_is_set(bits, h >> np.uint64(40)))
                    ok = ok[_is_set(bits, (h[ok] >> np.uint64(12)) & np.uint64(FILTER_BITS - 1))]
                    found.append((ok, h[ok].view(np.int64)))
                pos = np.concatenate([p for p, _ in found])
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, hashes = pos[order], np.concatenate([x for _, x in found])[order]
                for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > 2 * reach + SPAN) + 1):
                    a, b = max(0, int(pos[part[0]]) - reach), int(pos[part[-1]]) + SPAN + reach
                    out.append({
                        "doc_id": doc, "at": a, "words": [w.decode("utf-8", "replace") for w in words[a:b]],
                        "hits": [{"hash": int(h), "pos": int(p)} for h, p in zip(hashes[part], pos[part], strict=True)],
                    })
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return docs.mapInArrow(run, "doc_id long, at int, words array<string>, hits array<struct<hash:long,pos:int>>")


def _overlap(same: np.ndarray) -> tuple[int, int]:
    """(words, differing words) of the longest stretch of a diagonal with at most one word in five differing.

    It begins and ends with an equal word, so that chance neighbours add nothing. Ties go to fewer differing words.
    """
    wrong = np.concatenate([[0], np.cumsum(~same)])
    allowed = round(1 / (1 - MIN_SAME))
    level = np.arange(len(wrong)) - allowed * wrong  # a stretch [a, b) is good when level[b] >= level[a]
    first = np.flatnonzero(same)
    if not len(first):
        return 0, 0
    first = first[np.append(True, level[first[1:]] < np.minimum.accumulate(level[first])[:-1])]  # only a lower start can be of use later
    last = np.flatnonzero(same) + 1
    begin = first[np.searchsorted(-level[first], -level[last], side="left").clip(max=len(first) - 1)]
    size = np.where((level[last] >= level[begin]) & (last > begin), last - begin, 0)
    bad = np.where(size > 0, wrong[last] - wrong[begin], 0)
    best = np.lexsort((bad, -size))[0]
    return int(size[best]), int(bad[best])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_words and n_substituted of the longest verified overlap of each document and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    index = materialise(_index(items), "benchmark-seeds")
    reach = int(index.agg(F.max("pos")).first()[0] or 0) + SPAN  # words of the longest item
    runs = materialise(stretches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _filter(index), reach), "stretches")
    hits = runs.select("doc_id", "at", F.explode("hits").alias("h")).select("doc_id", "at", F.col("h.hash").alias("hash"), F.col("h.pos").alias("p"))
    found = hits.join(index, "hash").select("doc_id", "at", "item_id", (F.col("p") - F.col("pos")).alias("diagonal"))
    # a long overlap hits its diagonal many times and is verified once, over the whole of it
    found = found.select("doc_id", "at", "item_id", "diagonal").distinct()
    pairs = found.join(runs.select("doc_id", "at", "words"), ["doc_id", "at"]).join(items.withColumnRenamed("text", "item"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item = [w.decode("utf-8", "replace") for w in words_of((r["item"] or "").encode())]
                shift = r["diagonal"] - r["at"]  # place of the item's first word in the stretch's words
                lo, hi = max(0, -shift), min(len(item), len(r["words"]) - shift)
                same = np.array([item[i] == r["words"][i + shift] for i in range(lo, hi)], dtype=bool)
                best = _overlap(same)
                if best[0] >= min(MIN_WORDS, len(item)):
                    out.append({"doc_id": r["doc_id"], "item_id": r["item_id"], "n_words": best[0], "n_substituted": best[1]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("n_substituted", pa.int32())]))

    schema = "doc_id long, item_id long, n_words int, n_substituted int"
    checked = pairs.select("doc_id", "item_id", "at", "diagonal", "words", "item").mapInArrow(verify, schema)
    best = F.max(F.struct("n_words", (-F.col("n_substituted")).alias("s"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.s")).alias("n_substituted"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap; rows without an id stay.

    The ids that go are written first: where they are few, their size is known and the texts are filtered in place.
    """
    hit = materialise(overlaps(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].cast("long") == F.col("_hit"), "left_anti")
