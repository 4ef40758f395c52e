"""Fill-in-the-middle rewriting over content-defined chunks whose token counts are remembered.

A text is cut into chunks where a rolling hash of the last ``REACH`` bytes has its low bits clear, so that equal passages of
different texts are cut alike wherever they stand. A chunk is a small summary: token ends inside it, whether it begins and
ends inside a token, and its code points. A worker remembers the summaries of the chunks it has met, under a checksum; a hit
counts only after the bytes themselves have been compared. Summaries add up (a token that crosses a border is one token), so
the sums along a text tell how many tokens it has and in which chunk the n-th one ends; only that chunk is looked at again.

Tokens are a run of non-spaces with the spaces before it, or the spaces at the end of a text. A document's draws come from the
sha256 of ``seed:`` and its decimal id, so a retry or another layout of the rows draws alike.

Defined cases: a null text is empty; an empty text and one that holds a mark stay plain; repeated rows give one row each; a
null id draws like the id ``null``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regrowth.llm.common import raw_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: The rolling hash sees this many bytes (a power of two); one place in ``EVERY`` (a power of two) ends a chunk.
REACH, EVERY = 32, 512
#: Two places that end a chunk are at least ``SHORTEST`` apart; a stretch without any is cut every ``LONGEST`` bytes.
SHORTEST, LONGEST = 64, 4096
#: Bytes of the chunks a worker remembers, in two generations of half of it each.
REMEMBERED = 64 << 20
#: 1 where a byte is one of the six space characters.
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: A 32-bit number for each byte, by a multiplicative rule.
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of a byte array; the last is its length."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rolling, width = _GEAR[data], 1
    while width < REACH:  # the hash of 2w bytes from those of its halves
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = wider, width * 2
    found = np.flatnonzero(rolling & np.uint32((EVERY - 1) << 16) == 0) + 1
    found = found[np.diff(found, prepend=-SHORTEST) >= SHORTEST]
    ends = np.append(found[found < n], n)
    starts = np.append(0, ends[:-1])
    extra = (ends - starts - 1) // LONGEST
    if extra.any():
        more = [np.arange(a + LONGEST, b, LONGEST) for a, b, e in zip(starts, ends, extra, strict=True) if e]
        ends = np.sort(np.concatenate([ends, *more]))
    return ends


def summary(piece: bytes) -> tuple[int, bool, bool, int]:
    """(token ends inside, begins inside a token, ends inside a token, code points) of a chunk."""
    data = np.frombuffer(piece, dtype=np.uint8)
    space = _IS_SPACE[data]
    inner = int(np.count_nonzero(space[1:] & ~space[:-1]))
    return inner, not space[0], not space[-1], int(np.count_nonzero((data & 0xC0) != 0x80))


class Memory:
    """Summaries of chunks by checksum, each kept with its bytes; the older half goes when the newer one is full."""

    def __init__(self, limit: int = REMEMBERED):
        self.new, self.old, self.size, self.limit = {}, {}, 0, limit // 2
        self.hits = 0

    def __call__(self, piece: bytes) -> tuple[int, bool, bool, int]:
        key = zlib.crc32(piece) << 16 ^ len(piece)
        kept = self.new.get(key) or self.old.get(key)
        if kept is not None and kept[0] == piece:
            self.hits += 1
            return kept[1]
        found = summary(piece)
        if self.size + len(piece) > self.limit:
            self.new, self.old, self.size = {}, self.new, 0
        self.new[key] = piece, found
        self.size += len(piece) + 200
        return found


class Counted:
    """A text's chunks with the running sums of their token ends and code points."""

    def __init__(self, text: bytes, memory: Memory):
        self.text, data = text, np.frombuffer(text, dtype=np.uint8)
        self.ends = chunk_ends(data)
        starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.starts = starts
        rows = [memory(text[a:b]) for a, b in zip(starts.tolist(), self.ends.tolist(), strict=True)]
        inner, first, last, points = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 4
        # a chunk that ends inside a token closes it there unless the next one begins inside a token, or has none after it
        goes_on = np.append(first[1:], False) if len(rows) else first
        self.inner = inner
        self.closed = np.cumsum(inner + (last.astype(bool) & ~goes_on.astype(bool)))
        self.points = np.cumsum(points)
        self.words = int(self.closed[-1]) if len(rows) else 0
        self.tokens = self.words + bool(rows and not last[-1])

    def cut_after(self, tokens: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``tokens`` tokens."""
        if tokens <= 0:
            return 0, 0
        if tokens >= self.tokens:
            return len(self.text), int(self.points[-1]) if len(self.points) else 0
        k = int(np.searchsorted(self.closed, tokens))
        start, end = int(self.starts[k]), int(self.ends[k])
        rank = tokens - (int(self.closed[k - 1]) if k else 0)
        data = np.frombuffer(self.text, dtype=np.uint8)[start:end]
        if rank <= self.inner[k]:
            space = _IS_SPACE[data]
            data = data[: int(np.flatnonzero(space[1:] & ~space[:-1])[rank - 1]) + 1]
        before = int(self.points[k - 1]) if k else 0
        return start + len(data), before + int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rewrite(text: bytes, doc_id: int | None, memory: Memory, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, prefix and middle code points, output) of one text."""
    counted = Counted(text, memory)
    n, (h1, h2, h3, h4) = counted.tokens, draws(seed, doc_id)
    if not text or h3 % 100 >= percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    (p, p_points), (m, m_points) = counted.cut_after(a), counted.cut_after(b)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < spm_percent:
        form, parts = "spm", (MARKS[1], suffix, MARKS[0], prefix, MARKS[2], middle)
    else:
        form, parts = "psm", (MARKS[0], prefix, MARKS[1], suffix, MARKS[2], middle)
    return n, form, p_points, m_points - p_points, b"".join(parts)


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and the rewritten ``output``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), raw_bytes(batch, "text")
            rows = [rewrite(t, i, memory, seed, percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from: its three parts in order. A marked text holds no mark of its own, so each is found once."""
    part = lambda s, mark, k: F.split_part(s, F.lit(mark), F.lit(k))
    inner = lambda s: F.substring(s, len(PREFIX) + 1, 2**31 - 1)
    out = F.col(output)
    psm_rest, spm_rest = part(out, SUFFIX, 2), part(out, PREFIX, 2)
    psm = F.concat(inner(part(out, SUFFIX, 1)), part(psm_rest, MIDDLE, 2), part(psm_rest, MIDDLE, 1))
    spm = F.concat(part(spm_rest, MIDDLE, 1), part(spm_rest, MIDDLE, 2), inner(part(out, PREFIX, 1)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def digests(found: DataFrame) -> DataFrame:
    """The result with its output replaced by the sha256 of the output and of the text restored from it."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
