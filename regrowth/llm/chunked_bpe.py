"""Byte-level BPE over overlapping chunks, and decoding by joining raw bytes.

A long text is cut into chunks that overlap. Every chunk is pre-tokenised and its pre-tokens encoded in a task of its own,
without knowing where the true pre-tokens of the text begin. Then the chunks of a text are stitched: from the left, a chunk
hands over to the next at the first boundary in their overlap that both have found. From there on both would cut alike, because
the pattern looks at nothing to the left of a boundary. Where an overlap holds no common boundary, the text between the last
place that is certain and the next stretch that can be reached is cut again in one piece. Short texts are one chunk and are
encoded inside the scan.

Defined cases: a null text is empty; an empty text has no ids and the digests of nothing; repeated rows give one row each;
an empty table gives an empty result; other columns are not read. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Characters of a chunk's own part and of its overlap with the next; texts of up to ``STEP`` characters are one chunk.
STEP, OVERLAP = 32_768, 1_024
#: The pattern decides a pre-token by at most this many characters behind its end, white space aside.
GUARD = 4
#: Texts that a task encodes before it hands their rows on.
ROWS = 256
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def boundaries(self, text: str, start: int, last: bool) -> np.ndarray:
        """Ends of pre-tokens found from the chunk's first character, as places of the whole text.

        Unless the chunk is the last, ends that more text could move are left out: those near its end, and any in or before
        white space that reaches its end.
        """
        ends = np.fromiter((m.end() for m in self.pattern.finditer(text)), dtype=np.int64)
        if not last:
            ends = ends[ends <= min(len(text) - GUARD, len(text.rstrip()) - GUARD)]
        return ends + start


def codec(ranks_file: str, pattern: str) -> Codec:
    """One per worker process."""
    key = (ranks_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def cut(text: str, step: int, overlap: int) -> list[tuple[int, str]]:
    """(first character, chunk) of overlapping chunks that cover the text."""
    return [(a, text[a : a + step + overlap]) for a in range(0, max(1, len(text)), step)]


def stitch(chunks: list[tuple[int, str, np.ndarray]], find) -> list[tuple[int, int, int]]:
    """(chunk, from, to): which chunk's pre-tokens hold in which stretch of the text; chunk -1: cut that stretch again.

    ``chunks``: (start, text, boundaries) in order. ``find(a, b, from)``: pre-token ends of the text of chunks a to b from a
    true boundary on, used only where an overlap has no common boundary.
    """
    out, at, current, known, misses = [], 0, 0, chunks[0][2], 0
    for k in range(1, len(chunks)):
        start, _, ends = chunks[k]
        common = np.intersect1d(known[known >= start], ends, assume_unique=True)
        common = common[common > at]
        if len(common):
            out.append((current, at, int(common[0])))
            at, current, known, misses = int(common[0]), k, ends, 0
        else:  # carry on from the last true boundary; over a long stretch only at every doubling, so that the work stays small
            misses += 1
            current, known = -1, known[:0] if misses & (misses - 1) else find(at, k)
    last_start, last_text, _ = chunks[-1]
    out.append((current, at, last_start + len(last_text)))
    return out


def encode_chunks(own: Codec, rows: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]) -> list[int]:
    """ids of one text from its chunks: (start, text, boundaries, ids of all pre-tokens, number of ids before each boundary)."""
    def text_from(a: int, k: int) -> str:
        """The text from place a to the end of chunk k."""
        ends = [r[0] for r in rows[1 : k + 1]] + [rows[k][0] + len(rows[k][1])]
        return "".join(t[max(0, a - s) : e - s] for (s, t, *_), e in zip(rows, ends, strict=False) if e > a)

    ids: list[int] = []
    for k, a, b in stitch([r[:3] for r in rows], lambda a, k: own.boundaries(text_from(a, k), a, k == len(rows) - 1)):
        if k < 0:
            whole = text_from(a, len(rows) - 1)
            ends = own.boundaries(whole, a, True)
            ends = ends[ends <= b]
            ids += [i for x, y in zip(np.append(a, ends[:-1]).tolist(), ends.tolist(), strict=True) for i in own.encode(whole[x - a : y - a])]
        else:
            start, _, ends, found, before = rows[k]
            # the first chunk begins at a true boundary; later ones are entered at one of their own
            lo = 0 if a == start else int(before[np.searchsorted(ends, a)])
            hi = len(found) if k == len(rows) - 1 else int(before[np.searchsorted(ends, b)])
            ids += found[lo:hi].tolist()
    return ids


def encode_chunk(own: Codec, start: int, text: str, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundaries, ids, number of ids up to each boundary) of a chunk; each pre-token is encoded separately."""
    ends = own.boundaries(text, start, last)
    ids, before = [], []
    at = 0
    for e in (ends - start).tolist():
        ids += own.encode(text[at:e])
        before.append(len(ids))
        at = e
    return ends, np.array(ids, dtype=np.int64), np.array(before, dtype=np.int64)


def _digest(own: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, key: str = "doc_id", text: str = "text", step: int = STEP, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids``, if asked for)."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = RESULT + ", ids array<int>" * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_file, pattern)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(at, ROWS)
                digests, kept = [], []
                for t in part.column("text").to_pylist():
                    ids = own.encode(t or "")
                    digests.append(_digest(own, ids))
                    if with_ids:
                        kept.append(np.array(ids, dtype=np.int32))
                cols = list(zip(*digests, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(c, k) for c, k in zip([*cols, kept] if with_ids else cols, kinds[1:], strict=True)], names)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = cut(row["text"], step, overlap)
                for at in range(0, len(cuts), 64):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row["row"], "doc_id": row["doc_id"], "start": a, "chunk": t, "last": at + i == len(cuts) - 1} for i, (a, t) in enumerate(cuts[at : at + 64])],
                        schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("chunk", pa.string()), ("last", pa.bool_())]),
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_file, pattern)
        for batch in batches:
            rows = batch.to_pylist()
            got = [encode_chunk(own, r["start"], r["chunk"], r["last"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("row", "doc_id", "start", "chunk")]
                + [pa.array([g[i].astype("<i4" if i else "<i8").tobytes() for g in got], pa.binary()) for i in range(3)],
                ["row", "doc_id", "start", "chunk", "ends", "ids", "before"],
            )

    def stitched(pdf: pd.DataFrame) -> pd.DataFrame:
        own, pdf = codec(ranks_file, pattern), pdf.sort_values("start")
        rows = [
            (int(r.start), r.chunk, np.frombuffer(r.ends, "<i8"), np.frombuffer(r.ids, "<i4"), np.frombuffer(r.before, "<i4"))
            for r in pdf.itertuples()
        ]
        ids = encode_chunks(own, rows)
        doc_id = pdf["doc_id"].iloc[0]
        one = pd.DataFrame([(None if pd.isna(doc_id) else int(doc_id), *_digest(own, ids))], columns=names[:4])
        return one.assign(ids=[ids]) if with_ids else one

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long_text = F.coalesce(F.char_length("text"), F.lit(0)) > step
    brief = rows.where(~long_text).mapInArrow(short, schema)
    pieces = rows.where(long_text).withColumn("row", F.monotonically_increasing_id()).mapInArrow(chunked, "row long, doc_id long, start long, chunk string, last boolean")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = pieces.repartition(slots, "row", "start").mapInArrow(encoded, "row long, doc_id long, start long, chunk string, ends binary, ids binary, before binary")
    return brief.unionByName(done.groupBy("row").applyInPandas(stitched, schema))
