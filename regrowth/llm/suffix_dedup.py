"""Removal of long byte strings that occur more than once, by suffix sorting in two stages.

Equal texts are one text first: each of them is a repeat from end to end. In every other text each string of ``length`` bytes
(a window) picks an anchor, the least hash of its 128-byte pieces, so equal windows pick equal anchors at the same place. A
stretch of windows with one anchor is a piece of text of a few hundred bytes; pieces whose anchor occurs once hold no repeat
and go. The others are counted by anchor hash and digest, so that equal pieces are one before they are shuffled. Where an anchor
has several distinct pieces, the text of one of each is fetched and dealt to buckets of bounded size whose suffixes are sorted in two stages. Suffixes smaller than their successor are sorted
directly; all others are induced from them by a scan of the first-byte buckets in order (a suffix larger than its successor
comes where its successor has been met). Neighbours in suffix order with a common prefix of ``length`` mark the windows that
occur again. An anchor with more distinct text than fits a bucket (a line that stands in very many texts) is dealt by narrower
stretches, of sixteen windows and then of one, keyed by all the bytes that these have in common.

Matches never cross texts. Defined cases: a null text is empty; texts under ``length`` bytes stay whole; repeated rows are
copies of each other and go whole; a null id is kept; an empty table gives an empty result; other columns are not read. The
result is judged on the input: what goes from one text does not save its twin elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from regrowth.session import materialise, new_work_path

#: Bytes of an anchor (a power of two), and of the text whose anchors are looked for at a time (under 2**20).
ANCHOR, STRETCH = 128, 1 << 18
#: Bytes of distinct pieces in a sorting task's bucket, about, and of one anchor before it is dealt by narrower stretches.
BUCKET_BYTES, ANCHOR_BYTES = 1 << 20, 1 << 19
#: Windows of a stretch when an anchor has too much text, level by level; the last holds one window and so one distinct text.
NARROWER = (16, 1)
_PLACE = np.uint64((1 << 20) - 1)
_BYTE = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_BASE, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes (a power of two), each from those of its two halves."""
    with np.errstate(over="ignore"):
        found, power = _BYTE[data], _BASE
        while width > 1:
            step = len(data) - len(found) + 1
            found = found[:-step] * power + found[step:] if len(found) > step else found[:0]
            power, width = power * power, width // 2
        found = (found ^ found >> np.uint64(32)) * _MIX
        return found ^ found >> np.uint64(29)


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, windows) of the anchors of texts laid out one after another, ``ends`` their ends.

    A window's anchor is the leftmost of its pieces with the least hash, which its own bytes decide.
    """
    hashes = rolling(data, ANCHOR)
    width = length - ANCHOR + 1
    if len(hashes) < width:
        return (np.zeros(0, dtype=np.int64),) * 4
    least, span = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    windows = np.arange(len(least))
    inside = windows + length <= ends[np.searchsorted(ends, windows, side="right")]
    windows, place = windows[inside], (least[inside] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(np.append(first, len(place)))
    return hashes[place[first]].view(np.int64), place[first], windows[first], count


def laid_out(bodies: list[bytes], length: int) -> Iterator[tuple[int, bytes, int, np.ndarray]]:
    """(first text, joined texts, offset, ends) of texts laid out together up to STRETCH bytes; a longer one comes in stretches
    that overlap by a window, each with its offset."""
    first, size = 0, 0
    for k, body in enumerate(bodies):
        if size + len(body) > STRETCH:
            if k > first:
                yield first, b"".join(bodies[first:k]), 0, np.cumsum([len(x) for x in bodies[first:k]])
            first, size = k, 0
        if len(body) > STRETCH:
            for at in range(0, len(body) - length + 1, STRETCH):
                part = body[at : at + STRETCH + length - 1]
                yield k, part, at, np.array([len(part)])
            first = k + 1
        else:
            size += len(body)
    if first < len(bodies):
        yield first, b"".join(bodies[first:]), 0, np.cumsum([len(x) for x in bodies[first:]])


def pieces(bodies: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, h, d, at, start, n): anchor hash, digest of the piece, and anchor, first window and windows in the text."""
    for first, joined, offset, ends in laid_out(bodies, length):
        h, at, start, n = anchors(np.frombuffer(joined, dtype=np.uint8), ends, length)
        cuts = zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)
        d = np.array([xxhash.xxh64_intdigest(joined[x:y]) for x, y in cuts], dtype=np.uint64).view(np.int64)
        text = np.searchsorted(ends, start, side="right")
        begin = np.append(0, ends[:-1])[text] - offset
        yield text + first, h, d, at - begin, start - begin, n


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for text, h, d, _, start, n in pieces(batch.column("body").to_pylist(), length):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(d), pa.array(rids[text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "d", "rid", "start", "n"])

    return run


CONTENTS = "g long, d long, lead int, content binary"
_CONTENTS = pa.schema([("g", pa.int64()), ("d", pa.int64()), ("lead", pa.int32()), ("content", pa.binary())])
NARROW = "over_g long, over_d long, base int, g long, lead int, content binary"
_NARROW = pa.schema([("over_g", pa.int64()), ("over_d", pa.int64()), ("base", pa.int32()), ("g", pa.int64()), ("lead", pa.int32()), ("content", pa.binary())])
SPANS = "g long, d long, a int, b int"
_SPANS = pa.schema([("g", pa.int64()), ("d", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
_ROWS = 4096


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _content_rows(length: int):
    """The pieces a text was chosen to stand for, found by their (anchor hash, digest); ``lead`` is the anchor's place in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            wanted = [{(x["h"], x["d"]) for x in found} for found in batch.column("found").to_pylist()]
            rows = []
            for text, h, d, at, start, n in pieces(bodies, length):
                for k, x, y, place, a, windows in zip(*(c.tolist() for c in (text, h, d, at, start, n)), strict=True):
                    if (x, y) in wanted[k]:
                        wanted[k].remove((x, y))
                        rows.append((x, y, place - a, bodies[k][a : a + windows + length - 1]))
                        if len(rows) >= _ROWS:
                            yield _batch(rows, _CONTENTS)
                            rows = []
            yield _batch(rows, _CONTENTS)

    return run


def _narrow_rows(length: int, width: int):
    """Distinct pieces cut into stretches of up to ``width`` windows, aligned by the anchor and keyed by their common bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, d, lead, content in zip(*(batch.column(c).to_pylist() for c in ("g", "d", "lead", "content")), strict=True):
                windows = len(content) - length + 1
                for block in range(-lead // width, (windows - 1 - lead) // width + 1):
                    origin = lead + block * width  # where the block's first window would start
                    a, b = max(0, origin), min(windows, origin + width)
                    common = xxhash.xxh64_intdigest(content[origin + width - 1 : origin + length], (g + block) & (1 << 64) - 1)
                    rows.append((g, d, a, common - (common >> 63 << 64), lead - a, content[a : b + length - 1]))
                    if len(rows) >= _ROWS:
                        yield _batch(rows, _NARROW)
                        rows = []
            yield _batch(rows, _NARROW)

    return run


def two_stage_order(text: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Places ``first`` to ``last`` of every piece (whose closing byte stands behind it) in the order of their next ``depth`` bytes.

    ``raw`` are the bytes of ``text``. Places behind ``last`` are ordered too where an induced one needs them, and left out.
    """
    n = len(text)
    rises = np.zeros(n, dtype=np.int8)  # 1: smaller than its successor, -1: larger
    rises[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rises[-1] = 1
    nonzero = np.flatnonzero(rises)
    small = rises[nonzero[np.searchsorted(nonzero, np.arange(n))]] > 0  # equal bytes: as the successor
    small_at = np.flatnonzero(small)
    reach = small_at[np.searchsorted(small_at, last)]  # an induced place needs its successors up to a directly sorted one
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, reach + 1, -1)
    wanted = np.cumsum(change[:-1]) > 0
    direct = np.flatnonzero(wanted & small)
    # stage one: direct sort of the suffixes smaller than their successors
    keys = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if len(keys) else direct
    del keys
    edges = np.searchsorted(text[direct], np.arange(257))
    # stage two: scan the buckets of the first byte in order; what stands before a place and is larger joins the end of its bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = waiting[c]
        layer = np.concatenate(bucket) if bucket else np.zeros(0, dtype=np.int64)
        bucket = [layer]
        while len(layer):
            layer = layer[layer > 0] - 1
            layer = layer[(text[layer] == c) & wanted[layer]]
            bucket.append(layer)
        bucket.append(direct[edges[c] : edges[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & wanted[before]]
        by = np.argsort(text[before], kind="stable")
        before = before[by]
        cuts = np.flatnonzero(np.diff(text[before])) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    piece = np.searchsorted(first, order, side="right") - 1
    return order[order <= last[piece]]


def common_prefixes(raw: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each place in suffix order with the next one: whole words of eight bytes, at most ``depth``."""
    words = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
    found = np.zeros(max(0, len(order) - 1), dtype=np.int64)
    going = np.arange(len(found))
    a, b = order[:-1], order[1:]
    for t in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        same = words[a + t] == words[b + t]
        going, a, b = going[same], a[same], b[same]
        found[going] = t + 8
    return found


def repeated_windows(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes occur elsewhere in the pieces."""
    raw = b"".join(c + b"\xff" for c in contents) + b"\xff" * length
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(raw, dtype=np.uint8)
    order = two_stage_order(text, raw, first, first + sizes - length, length)
    whole = common_prefixes(raw, order, length) >= length
    marked = np.zeros(len(raw), dtype=bool)
    marked[order[:-1][whole]] = True
    marked[order[1:][whole]] = True
    return [marked[a : a + s - length + 1] for a, s in zip(first.tolist(), sizes.tolist(), strict=True)]


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sort_bucket(length: int):
    def run(held: pa.Table) -> pa.Table:
        out = []
        for g, d, marked in zip(held.column("g").to_pylist(), held.column("d").to_pylist(), repeated_windows(held.column("content").to_pylist(), length), strict=True):
            for a, b in zip(*stretches(marked), strict=True):
                out.append((g, d, int(a), int(b) + length - 1))
        return pa.Table.from_batches([_batch(out, _SPANS)])

    return run


def repeated_spans(contents: DataFrame, length: int, bucket_bytes: int, anchor_bytes: int, narrower: tuple[int, ...] = NARROWER) -> DataFrame:
    """(g, d, a, b): stretches of distinct pieces that occur in another piece too. ``contents`` as in CONTENTS, all of a key distinct."""
    per_key = contents.groupBy("g").agg(F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("k"))
    per_key = materialise(per_key.where("k > 1"), "keys-with-several")
    few = F.col("bytes") <= anchor_bytes if narrower else F.lit(True)
    buckets = max(1, -(-int(per_key.where(few).agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))
    dealt = contents.join(per_key.where(few).select("g"), "g", "left_semi").select("g", "d", "content", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    found = dealt.groupBy("bucket").applyInArrow(_sort_bucket(length), SPANS)
    many = per_key.where(~few)
    if many.isEmpty():
        return found
    cut = contents.join(many.select("g"), "g", "left_semi").mapInArrow(_narrow_rows(length, narrower[0]), NARROW)
    cut = materialise(cut.withColumn("d", F.xxhash64("content")), "narrow-pieces")
    counted = materialise(cut.groupBy("g", "d", "lead", "content").agg(F.count(F.lit(1)).alias("c")), "distinct-narrow-pieces")
    whole = counted.where("c > 1").select("g", "d", F.lit(0).alias("a"), F.octet_length("content").alias("b"))
    inside = whole.unionByName(repeated_spans(counted.drop("c"), length, bucket_bytes, anchor_bytes, narrower[1:]))
    back = cut.select("over_g", "over_d", "base", "g", "d").join(inside, ["g", "d"])
    return found.unionByName(back.select(F.col("over_g").alias("g"), F.col("over_d").alias("d"), (F.col("base") + F.col("a")).alias("a"), (F.col("base") + F.col("b")).alias("b")))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut_rows():
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if a > end:
                        kept.append(body[at:a])
                        runs += 1
                    removed += max(0, b - max(a, at))
                    at = end = max(at, b)
                kept.append(body[at:])
                rows.append((len(body), removed, runs, b"".join(kept)))
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, bucket_bytes: int = BUCKET_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the bytes kept.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else goes. ``length`` is over ``ANCHOR``.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    size, none = F.octet_length("body").cast("long"), F.lit(0).cast("long")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"))
    brief = rows.where(size < length).select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("body").alias("kept"))
    long_rows = rows.where(size >= length).withColumn("digest", F.unhex(F.sha2("body", 256)))
    # each text once, dealt by its digest; later joins find it there and never shuffle texts again
    distinct = long_rows.groupBy("digest").agg(F.first("body").alias("body"), F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    texts = bucketed(distinct.withColumn("rid", F.monotonically_increasing_id()), "digest", "distinct_texts")
    copied = texts.where("copies > 1").select("digest")
    copies = long_rows.select("doc_id", "digest", size.alias("n_bytes")).join(copied, "digest", "left_semi").select(
        "doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    met = materialise(texts.select("rid", "body").mapInArrow(_anchor_rows(length), "h long, d long, rid long, start int, n int"), "anchors")
    counted = met.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("rid"), F.max("n").alias("n"))
    per_anchor = counted.groupBy("h").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("k")).where("all > 1")
    counted = materialise(counted.join(per_anchor, "h"), "shared-pieces")
    names = texts.select("rid", "digest")
    chosen = counted.where("k > 1").groupBy("rid").agg(F.collect_list(F.struct("h", "d")).alias("found")).join(names, "rid").select("digest", "found")
    contents = texts.select("digest", "body").join(chosen, "digest").select("body", "found").mapInArrow(_content_rows(length), CONTENTS)
    contents = materialise(contents, "distinct-pieces")
    # a piece that occurs as a whole again is a repeat from end to end
    found = counted.where("c > 1").select(F.col("h").alias("g"), "d", F.lit(0).alias("a"), (F.col("n") + (length - 1)).alias("b"))
    found = materialise(found.unionByName(repeated_spans(contents, length, bucket_bytes, anchor_bytes)).withColumnRenamed("g", "h"), "repeated-stretches")
    placed = met.join(found.hint("merge"), ["h", "d"])  # both grow with the texts
    spans = placed.groupBy("rid").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))
    cut = texts.where("copies = 1").select("digest", "doc_id", "body").join(spans.join(names, "rid").select("digest", "spans"), "digest", "left")
    return brief.unionByName(copies).unionByName(cut.select("doc_id", "body", "spans").mapInArrow(_cut_rows(), RESULT))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, as many as the session shuffles into, and read back as such."""
    spark = df.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(slots, key).option("path", new_work_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"drop table {table}")  # only the name: the files are ours and stay
    return back


def digests(found: DataFrame) -> DataFrame:
    """The result with the sha256 of the kept bytes in their place."""
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
