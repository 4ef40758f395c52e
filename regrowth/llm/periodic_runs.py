"""Runs of words that repeat with a period, found by longest common extensions over a difference cover.

The words of many texts are numbered and laid out one text after another, each closed by a number of its own, so that nothing
matches across texts. Only the suffixes that start at places of a difference cover modulo 31 (6 of 31) are sorted: by their
first 31 words, then by doubling. For any two places some shift under 31 takes both to the cover; their longest common
extension is therefore a comparison of at most that many words and, where these agree, one range minimum over the common
prefixes of neighbouring sorted suffixes (a sparse table).

A run of period p whose length is at least ``max(shortest, least * p)`` holds that many less p consecutive places that equal
the place p further on, so a grid of that step meets it: for all p together a text of n words has O(n log n) grid places.
Places that differ from the one p further on go at once. A run is taken up at its first grid place; how far it reaches back is
bisected with the same extension queries. A run of period p shows up at multiples of p too, with the same ends; the smallest
stays, which is its smallest period.

Defined cases: a null text and one without a word have no run and an empty collapsed text; repeated rows give one row each; a
null id is kept; an empty table gives an empty result; other columns are not read. A text is never split: a worker holds the
texts of a slice of ``SLICE_WORDS`` words, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regrowth.llm.common import raw_bytes

#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
MODULUS, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
#: A run has at least this many words, and this many periods.
SHORTEST, PERIODS = 24, 3
#: Words of the texts that are looked at together, and grid places made at a time.
SLICE_WORDS, GRID = 1 << 17, 1 << 20


def shifts() -> np.ndarray:
    """shift[a, b]: the least number of places that takes residues a and b both into the cover."""
    inside = np.zeros(MODULUS, dtype=bool)
    inside[COVER] = True
    residues = np.arange(MODULUS)
    both = inside[(residues[:, None] + residues) % MODULUS]  # [residue, shift]
    return (both[:, None, :] & both[None, :, :]).argmax(axis=2)


SHIFT = shifts()


class Extensions:
    """Longest common extensions of places of a number sequence whose last number occurs once."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        blocks = -(-self.n // MODULUS)
        at = (np.arange(blocks)[:, None] * MODULUS + COVER).ravel()
        self.at = at[at < self.n]
        self.slot = np.full(MODULUS, -1)
        self.slot[COVER] = np.arange(len(COVER))
        padded = np.append(words, np.full(MODULUS, -1, dtype=words.dtype))
        first = padded[self.at[:, None] + np.arange(MODULUS)]
        order = np.lexsort(first.T[::-1])
        new = np.append(True, (first[order[1:]] != first[order[:-1]]).any(axis=1))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        levels, reach = [rank], len(COVER)
        while rank.max(initial=0) + 1 < len(rank):  # twice as many words each time
            after = np.append(rank[reach:], np.full(min(reach, len(rank)), -1))
            _, rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)
            levels.append(rank)
            reach *= 2
        self.rank = rank
        order = np.argsort(rank)
        self.minima = [self._neighbours(levels, order[:-1], order[1:])]
        half = 1
        while 2 * half <= len(self.minima[0]):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def _neighbours(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of sorted suffixes (as slots of the cover): whole levels from the longest down, then words."""
        a, b, m = a.copy(), b.copy(), len(self.at)
        length = np.zeros(len(a), dtype=np.int64)
        for t in range(len(levels) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = inside.copy()
            same[inside] = levels[t][a[inside]] == levels[t][b[inside]]
            step = len(COVER) << t
            length += same * (MODULUS << t)
            a, b = a + same * step, b + same * step
        # each is now a sampled place, or past the end
        inside = np.flatnonzero((a < m) & (b < m))
        length[inside] += self._words(self.at[a[inside]], self.at[b[inside]], np.full(len(inside), MODULUS))
        return length

    def _words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on, up to ``most`` (under or at the modulus)."""
        length = np.zeros(len(i), dtype=np.int64)
        going = np.flatnonzero(most > 0)
        for t in range(MODULUS):
            x, y = i[going] + t, j[going] + t
            inside = np.maximum(x, y) < self.n
            going = going[inside]
            going = going[self.words[x[inside]] == self.words[y[inside]]]
            length[going] = t + 1
            going = going[most[going] > t + 1]
            if not len(going):
                break
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at i and j (i != j), for arrays of places."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        length = self._words(i, j, shift)
        on = np.flatnonzero((length == shift) & (np.maximum(i, j) + shift < self.n))
        if len(on):
            x, y = i[on] + shift[on], j[on] + shift[on]
            a, b = (self.rank[p // MODULUS * len(COVER) + self.slot[p % MODULUS]] for p in (x, y))
            low, width = np.minimum(a, b), np.abs(a - b)
            level = np.frexp(width.astype(np.float64))[1] - 1
            found = np.empty(len(on), dtype=np.int64)
            for t in np.unique(level).tolist():
                pick = np.flatnonzero(level == t)
                table = self.minima[t]
                found[pick] = np.minimum(table[low[pick]], table[low[pick] + width[pick] - (1 << t)])
            length[on] += found
        return length


def grids(ends: np.ndarray, shortest: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, step) arrays of the harmonic grids of texts laid out by falling length; ``ends``: where each one ends.

    A grid of period p runs over the texts long enough for a run of p, which stand first.
    """
    lengths = np.diff(ends, prepend=-1) - 1  # without the closing number
    longest = int(lengths[0]) if len(lengths) else 0
    if longest < shortest:
        return
    periods = np.arange(1, longest // least + 1)
    steps = np.maximum(shortest - periods, (least - 1) * periods)
    long_enough = np.searchsorted(-lengths, -np.maximum(shortest, least * periods), side="right")
    reach = ends[long_enough - 1]
    counts = -(-reach // steps)
    first = 0
    while first < len(periods):
        upto = int(np.searchsorted(np.cumsum(counts[first:]), GRID)) + first + 1
        part = slice(first, upto)
        many = counts[part]
        which = np.repeat(np.arange(len(many)), many)
        within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        yield within * steps[part][which], periods[part][which], steps[part][which]
        first = upto


def find_runs(texts: list[np.ndarray], shortest: int = SHORTEST, least: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of the texts, given as arrays of word numbers below 2**30; by text, start, period."""
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= shortest), key=lambda k: -len(texts[k]))
    if not order:
        return (np.zeros(0, dtype=np.int64),) * 4
    laid = np.concatenate([x for at, k in enumerate(order) for x in (texts[k], [(1 << 30) + at])]).astype(np.int64)
    ends = np.cumsum([len(texts[k]) + 1 for k in order]) - 1
    extend, found = None, []
    for place, period, step in grids(ends, shortest, least):
        inside = place + period < len(laid)
        place, period, step = place[inside], period[inside], step[inside]
        met = laid[place] == laid[place + period]
        place, period, step = place[met], period[met], step[met]
        if not len(place):
            continue
        extend = extend or Extensions(laid)
        forward = extend(place, place + period)
        # only a run's first grid place goes on: the place one step before does not reach as far as this one
        same_grid = np.append(False, (period[1:] == period[:-1]) & (place[1:] - place[:-1] == step[1:]) & (forward[:-1] >= step[1:]))
        back_needed = np.maximum(step - forward, 0)  # a run covers a step's worth of places
        going = np.flatnonzero(~same_grid & (place >= back_needed))
        place, period, step, forward, low = place[going], period[going], step[going], forward[going], back_needed[going]
        reaches = extend(place - low, place - low + period) >= low
        place, period, step, forward, low = (x[reaches] for x in (place, period, step, forward, low))
        high = np.minimum(step - 1, place)  # back >= low holds; beyond ``high`` the place before would have met the run
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo] + 1) // 2
            holds = extend(place[todo] - middle, place[todo] - middle + period[todo]) >= middle
            low[todo] = np.where(holds, middle, low[todo])
            high[todo] = np.where(holds, high[todo], middle - 1)
        found.append((place - low, low + forward + period, period))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, dtype=bool)
    start, length, period = start[first], length[first], period[first]
    spot = np.searchsorted(ends, start)
    begins = np.append(0, ends[:-1] + 1)
    text = np.array(order)[spot]
    start = start - begins[spot]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def kept_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """False for words that a run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) == 0


RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about SLICE_WORDS words (six bytes each), a longer text alone."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > 6 * SLICE_WORDS:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = PERIODS) -> DataFrame:
    """One row per document: doc_id, its runs (word number, words, period) by start and period, and the text with each run's
    repetitions dropped (kept words joined by one space). ``least`` periods must be 2 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_bytes(batch, "text")
            for a, b in _sliced(texts):
                words = [t.split() for t in texts[a:b]]
                numbers: dict[bytes, int] = {}
                known = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], dtype=np.int64) for ws in words]
                text_of, start, length, period = find_runs(known, shortest, least)
                edge = np.searchsorted(text_of, np.arange(b - a + 1))
                collapsed = []
                for k, ws in enumerate(words):
                    lo, hi = edge[k], edge[k + 1]
                    if lo < hi:
                        keep = kept_words(len(ws), start[lo:hi], length[lo:hi], period[lo:hi])
                        ws = [w for w, x in zip(ws, keep.tolist(), strict=True) if x]
                    collapsed.append(b" ".join(ws))
                runs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period. Null without a run."""

    def better(best: Column, x: Column) -> Column:
        a, b = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (a > b), x).otherwise(best)  # runs come by start and period: the first of equals stays

    return F.aggregate(F.col(runs), F.lit(None).cast(_RUN_TYPE), better)


_RUN_TYPE = "struct<start:bigint,length:bigint,period:bigint>"


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = found.withColumn("_best", strongest())
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, in which one in ten texts (by the id's checksum) repeats a stretch of its words up to its end."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h = zlib.crc32(b"null" if i is None else str(i).encode())
                if h % 10 == 0 and t and (words := t.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    t = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")
