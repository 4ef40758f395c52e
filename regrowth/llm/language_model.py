"""A hierarchical Pitman-Yor language model over whole corpora, and texts scored by it.

A word is predicted in the restaurant of the word before it; all these context restaurants share one parent, the restaurant
without context, whose base is uniform. In ``learn_and_score`` every word (by its 64-bit hash) and the end of a text is a dish
and a context of its own; restaurants, their sums and the parent are tables (see ``pair_values``).

``learn`` and ``score`` are the model of bounded size: the ``CLASSES`` most frequent words (and the end of a text) are dishes and contexts of
their own. All other words are one class with a restaurant of its own below it, in which only their counts matter; so the
tables of the model are bounded by ``CLASSES`` squared, while every token of the corpus is counted and scored.

Gibbs sampling: a sweep draws anew the number of tables of every dish in every context restaurant, given the tables of the
restaurant's other dishes and the parent's probabilities after the last sweep; then the tables are the parent's customers and
the parent is drawn. Up to ``EXACT_CUSTOMERS`` customers the draw is from the exact conditional (generalised Stirling numbers,
seating summed out); above, from the normal law at its mode, found at the saddle point. All dishes are drawn at once, so a
sweep is one pass over the pair table without a shuffle. Probabilities are averaged over the sweeps that follow the burn-in.

Scoring keeps the most frequent words' counts in every task (a bounded table) and joins the rest by word.

Defined cases: a null or empty text is its end token alone; without training texts nothing is known, the base score is 0 and
the model is uniform; repeated rows give one row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regrowth.llm.common import crc_bucket, lower_words, raw_bytes
from regrowth.llm.decontaminate import token_hashes
from regrowth.session import discard, materialise, new_work_path

#: Words with a restaurant of their own, and words whose counts every scoring task holds, at most.
CLASSES, HELD_WORDS = 2_048, 131_072
SWEEPS, BURN_IN = 7, 3
EXACT_CUSTOMERS = 512
STRENGTH = 1.0
#: Tokens whose pairs a counting task adds up before it hands them on.
PAIRS_AT_ONCE = 2_000_000
#: Pairs of texts that leave a task together, and pairs with their values that a task holds while these pass by.
PAIRS_A_BATCH, PAIRS_A_TASK = 200_000, 1_000_000
#: The end of a text; no word is empty.
END = b""
#: Hashes of the end of a text and of its start, which is a context only.
END_HASH, START_HASH = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
HIGH = np.uint64(0xFFFFFFFF00000000)


def log_stirling(discount: float, n: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t), c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(1, n + 1)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - t * discount, 0)))
    return out


def draw_tables(customers, others, base, discount: float, rng, stirling: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish: ``customers`` of it, tables of ``others`` in its restaurant, parent's probability ``base``."""
    customers, others, base = np.asarray(customers, np.int64), np.asarray(others, np.float64), np.asarray(base, np.float64)
    stirling = log_stirling(discount, EXACT_CUSTOMERS) if stirling is None else stirling
    tables = np.minimum(customers, 1)
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT_CUSTOMERS)]).tolist():
        rows = np.flatnonzero(customers == c)
        k = np.arange(1, c + 1)
        for own in np.array_split(rows, -(-len(rows) * c // 1_000_000)):
            new = np.cumsum(np.log(STRENGTH + discount * (others[own, None] + k - 1)), axis=1)
            weight = stirling[c, 1 : c + 1] + k * np.log(base[own, None]) + new
            tables[own] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    rows = np.flatnonzero(customers > EXACT_CUSTOMERS)
    if len(rows):
        mode, spread = _mode(customers[rows].astype(float), others[rows], base[rows], discount)
        tables[rows] = np.clip(np.rint(rng.normal(mode, spread)), 1, customers[rows]).astype(np.int64)
    return tables


def _root(falling, steps: int = 60) -> np.ndarray:
    """Where a function that falls with y in (0, 1) is zero, by halving log y; ``falling`` takes log y."""
    size = falling(np.array([-1.0])).shape
    low, high = np.full(size, -600.0), np.full(size, -1e-12)
    for _ in range(steps):
        mid = (low + high) / 2
        up = falling(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def _mode(c: np.ndarray, others: np.ndarray, base: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Most probable number of tables of many customers, and the normal spread around it.

    By the saddle point of the Stirling numbers' generating function (1 - (1 - z)^d)^t, with y = 1 - z.
    """
    grown = lambda y: -np.expm1(d * y)  # noqa: E731  1 - y^d
    rest = lambda y: np.log(-np.expm1(y)) + (d - 1) * y  # noqa: E731  log of (1 - y) y^(d - 1)
    y = _root(lambda y: np.log(base) + np.log(STRENGTH + d * others) + rest(y) - np.log1p(-base * grown(y)) - np.log(c))
    mode = np.clip(base * grown(y) * (STRENGTH + d * others) / (d * (1 - base * grown(y))), 1, c)

    def slope(t):
        """Of the log probability."""
        y = _root(lambda y: np.log(t * d) + rest(y) - np.log(grown(y)) - np.log(c))
        return np.log(grown(y)) - np.log(t * d) + np.log(base) + np.log(STRENGTH + d * (others + t))

    bend = (slope(mode * 0.99) - slope(mode * 1.01)) / (0.02 * mode)
    return mode, np.sqrt(1 / np.maximum(bend, 0.1 / mode))


def discount_of(ones: float, twos: float) -> float:
    """From the numbers of dishes seen once and twice."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos > 0 else 0.5


def parent_probability(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    own = customers - discount * tables + (STRENGTH + discount * tables.sum()) / len(customers)
    return own / (STRENGTH + customers.sum())


@dataclass
class Model:
    n_train: int
    n_types: int
    words: list[bytes]
    counts: np.ndarray
    least: int  # words seen at most so often are not in ``words``
    classes: int
    log_pair: np.ndarray  # by context (classes, all others, start) and class (classes, all others)
    rare: dict[int, float]  # log probability inside the class of all others, by count
    totals: DataFrame  # w, c of every training word

    def base(self, c):
        return np.log10((c + 0.1) / (self.n_train + 0.1 * (self.n_types + 1)))


def word_counts(docs: DataFrame) -> DataFrame:
    """w, c over all texts, the end of each text counted as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for t in raw_bytes(batch, "text"):
                got.update(lower_words(t))
            got[END] = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()), pa.array(got.values(), pa.int64())], ["w", "n"])

    return docs.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c")).where("c > 0")


def _ranks(words: list[bytes], find) -> np.ndarray:
    return np.array([find(w, -1) for w in words], dtype=np.int64)


def pair_counts(docs: DataFrame, words: list[bytes], classes: int) -> DataFrame:
    """u, v, c: how often a class follows a context, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(words[:classes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = {w: i for i, w in enumerate(shared.value)}.get
        total = np.zeros((classes + 2) * (classes + 1), dtype=np.int64)
        for batch in batches:
            keys = []
            for t in raw_bytes(batch, "text"):
                own = _ranks([*lower_words(t), END], find)
                own[own < 0] = classes
                keys.append(np.concatenate([[classes + 1], own[:-1]]) * (classes + 1) + own)
            if keys:
                total += np.bincount(np.concatenate(keys), minlength=len(total))
        at = np.flatnonzero(total)
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part // (classes + 1), pa.int32()), pa.array(part % (classes + 1), pa.int32()), pa.array(total[part], pa.int64())], ["u", "v", "n"])

    return docs.select("text").mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("c"))


def _sums(state: DataFrame, classes: int) -> dict[str, np.ndarray]:
    """Sums of tables by context and by dish, of customers by context: at most two numbers a class."""
    rows = state.groupingSets([["u"], ["v"]], "u", "v").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    out = {"tu": np.zeros(classes + 2), "cu": np.zeros(classes + 2), "tv": np.zeros(classes + 1)}
    for r in rows:
        if r.u is not None:
            out["tu"][r.u], out["cu"][r.u] = r.t, r.c
        else:
            out["tv"][r.v] = r.t
    return out


def sample_pairs(pairs: DataFrame, classes: int, seed: int = 7, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> np.ndarray:
    """The averaged predictive probabilities of each class in each context, as logs."""
    spark = pairs.sparkSession
    seen = {r.c: r.m for r in pairs.where("c <= 2").groupBy("c").agg(F.count(F.lit(1)).alias("m")).collect()}
    discount = discount_of(seen.get(1, 0), seen.get(2, 0))
    state = materialise(pairs.select("u", "v", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("kept")), "seating")
    sums = _sums(state, classes)
    rng = np.random.default_rng(seed)
    parent_tables = np.minimum(sums["tv"], 1)
    kept = []

    def parent() -> np.ndarray:
        nonlocal parent_tables
        own = sums["tv"].astype(np.int64)
        d = discount_of((own == 1).sum(), (own == 2).sum())
        parent_tables = draw_tables(own, parent_tables.sum() - parent_tables, np.full(len(own), 1 / len(own)), d, rng)
        return parent_probability(own, parent_tables, d)

    probability = parent()
    for sweep in range(sweeps):
        shared = spark.sparkContext.broadcast((sums["tu"], probability))
        keep = sweep >= burn_in

        def run(batches: Iterator[pa.RecordBatch], shared=shared, sweep=sweep, keep=keep) -> Iterator[pa.RecordBatch]:
            tables, base = shared.value
            stirling = log_stirling(discount, EXACT_CUSTOMERS)
            for batch in batches:
                u, v, c, t, total = (batch.column(n).to_numpy() for n in ("u", "v", "c", "t", "kept"))
                if len(u):  # a retried task draws the same numbers
                    own = np.random.default_rng([seed, sweep, int(u[0]), int(v[0]), len(u)])
                    t = draw_tables(c, tables[u] - t, base[v], discount, own, stirling)
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), batch.column("c"), pa.array(t, pa.int64()), pa.array(total + t * keep, pa.int64())], ["u", "v", "c", "t", "kept"])

        state = materialise(state.mapInArrow(run, "u int, v int, c long, t long, kept long"), "seating")
        sums = _sums(state, classes)
        probability = parent()
        if keep:
            kept.append(((STRENGTH + discount * sums["tu"]) / (STRENGTH + sums["cu"]), probability))
    backed = np.array([b for b, _ in kept]).T @ np.array([p for _, p in kept]) / len(kept)
    own = state.select("u", "v", (F.col("c") - F.lit(discount / len(kept)) * F.col("kept")).alias("x")).toArrow()  # at most CLASSES squared
    u = own.column("u").to_numpy()
    backed[u, own.column("v").to_numpy()] += own.column("x").to_numpy() / (STRENGTH + sums["cu"][u])
    return np.log10(backed).astype(np.float32)


def sample_rare(spectrum: dict[int, int], seed: int = 7, sweeps: int = SWEEPS, burn_in: int = BURN_IN, draws: int = 64) -> dict[int, float]:
    """log10 probability of a word in the class of all others by its training count; 0: a word never seen.

    ``spectrum``: how many of these words were seen so often. Words of one count are alike, so each count is drawn ``draws``
    times and stands for all its words.
    """
    counts = np.array(sorted(spectrum), dtype=np.int64)
    many = np.array([spectrum[c] for c in counts.tolist()], dtype=np.float64)
    types, total = many.sum() + 1, float((counts * many).sum())
    d = discount_of(spectrum.get(1, 0), spectrum.get(2, 0))
    rng, stirling = np.random.default_rng([seed, 1]), log_stirling(d, EXACT_CUSTOMERS)
    tables, kept = np.minimum(counts, 1).astype(np.float64), []
    for sweep in range(sweeps):
        others = np.repeat((many * tables).sum() - tables, draws)
        drawn = draw_tables(np.repeat(counts, draws), others, np.full(len(others), 1 / types), d, rng, stirling)
        tables = drawn.reshape(len(counts), draws).mean(axis=1) if len(counts) else tables
        if sweep >= burn_in:
            back = (STRENGTH + d * (many * tables).sum()) / types
            kept.append(np.append((counts - d * tables + back), back) / (STRENGTH + total))
    return dict(zip([*counts.tolist(), 0], np.log10(np.mean(kept, axis=0)).tolist(), strict=True))


def learn(docs: DataFrame, classes: int = CLASSES, held_words: int = HELD_WORDS) -> Model:
    """From the texts of ``docs``."""
    totals = materialise(word_counts(docs), "word-counts")
    spectrum = {r.c: r.m for r in totals.groupBy("c").agg(F.count(F.lit(1)).alias("m")).collect()}
    least, room = 0, held_words
    for c in sorted(spectrum, reverse=True):
        if spectrum[c] > room:
            least = c
            break
        room -= spectrum[c]
    top = totals.where(F.col("c") > least).toArrow()  # at most ``held_words``
    top = sorted(zip(top.column("w").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, counts = [w for w, _ in top], np.array([c for _, c in top], dtype=np.int64)
    classes = min(classes, len(words))
    pairs = materialise(pair_counts(docs, words, classes), "pair-counts")
    rare = Counter(spectrum)
    rare.subtract(Counter(counts[:classes].tolist()))
    return Model(
        sum(c * m for c, m in spectrum.items()), sum(spectrum.values()), words, counts, least, classes,
        sample_pairs(pairs, classes), sample_rare({c: m for c, m in rare.items() if m > 0}), totals,
    )


def score(docs: DataFrame, model: Model, folds: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, k = docs.sparkSession, model.classes
    rare = np.array([model.rare[int(c)] if i >= k else 0.0 for i, c in enumerate(model.counts)])
    shared = spark.sparkContext.broadcast((model.words, model.base(model.counts), rare, model.log_pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, inside, log_pair = shared.value
        find = {w: i for i, w in enumerate(words)}.get
        for batch in batches:
            rid, left, n, sums = [], [], [], []
            for row, t in zip(batch.column("rid").to_pylist(), raw_bytes(batch, "text"), strict=True):
                tokens = [*lower_words(t), END]
                rank = _ranks(tokens, find)
                cls = np.where((rank < 0) | (rank >= k), k, rank)
                held = rank[rank >= 0]
                value = log_pair[np.concatenate([[k + 1], cls[:-1]]), cls].sum(dtype=np.float64) + inside[held].sum()
                sums.append((len(tokens), len(held), float(base[held].sum()), float(value)))
                rid.append(row)
                left.append(b" %d" % row)  # no word holds a space: this row joins nothing
                n.append(0)
                if len(held) < len(tokens):
                    rest = Counter(tokens[i] for i in np.flatnonzero(rank < 0).tolist())
                    rid += [row] * len(rest)
                    left += rest.keys()
                    n += rest.values()
                    sums += [(0, 0, 0.0, 0.0)] * len(rest)
            cols = list(zip(*sums, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(left, pa.binary()), pa.array(n, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]],
                ["rid", "w", "n", "n_tokens", "n_known", "base", "value"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), (crc_bucket(key, folds) == 0).alias("held_out"), F.col(text).alias("text"))
    parts = rows.select("rid", "text").mapInArrow(run, "rid long, w binary, n long, n_tokens long, n_known long, base double, value double")
    inside = spark.createDataFrame([(int(c), float(x)) for c, x in model.rare.items() if 0 < c <= model.least] or [(0, 0.0)], "c long, inside double")
    # words that the tasks do not hold, with their values
    valued = model.totals.where(F.col("c") <= model.least).join(inside, "c")
    scale = float(model.n_train + 0.1 * (model.n_types + 1))
    parts = parts.join(valued, "w", "left")
    parts = parts.select(
        "rid", "n_tokens", (F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / scale)).alias("base"),
        (F.col("value") + F.col("n") * F.coalesce("inside", F.lit(float(model.rare[0])))).alias("value"),
    )
    sums = parts.groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "value")])
    return rows.select("rid", "doc_id", "held_out").join(sums, "rid").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("value").alias("score"),
    )


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.Table]:
    """Several batches at a time: the draws work count by count, which short batches would repeat."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _word_pairs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word (and of the end) and of the word before it."""
    words = lower_words(text)
    own = np.append(token_hashes(words), END_HASH) if words else np.array([END_HASH])
    return np.append(START_HASH, own[:-1]), own


def _counted(u: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with their numbers, in one sort by the upper halves of both hashes: pairs that share these may stand more than once."""
    order = np.argsort((u & HIGH) | (v >> np.uint64(32)))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
    size = np.diff(np.append(first, len(u))) if n is None else np.add.reduceat(n[order], first)
    return u[first], v[first], size


def all_pairs(rows: DataFrame) -> DataFrame:
    """u, v, c: every pair of neighbouring words of the texts, and how often it is in the training texts (``train``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, v, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n)], ["u", "v", "n"])

        for batch in batches:
            for train, t in zip(batch.column("train").to_pylist(), raw_bytes(batch, "text"), strict=True):
                u, v = _word_pairs(t)
                held.append((u, v, np.full(len(u), int(train))))
                size += len(u)
                if size >= PAIRS_AT_ONCE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select("train", "text").mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("c"))


def _of(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def pair_values(pairs: DataFrame, seed: int = 7, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[DataFrame, int]:
    """u, v, known, base, value (log10 probability of v after u) of every pair in u, v, c, and the training tokens.

    Every word is a dish and a context. Restaurants are rows (u, v) of a table; the sums of tables by context and by dish are
    tables as well and are joined to it in each sweep, so nothing on the driver or in a task follows the vocabulary. A pair seen
    once has one table whatever is drawn: only pairs seen more often are drawn anew.
    """
    spark = pairs.sparkSession
    work: list[str] = []

    def kept_as(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        work.append(new_work_path(spark, name))
        return materialise(df, name, work[-1]), work[-1]

    times = lambda c: F.sum(F.when(F.col("c") == c, 1).otherwise(0))
    contexts, _ = kept_as(pairs.groupBy("u").agg(F.sum("c").alias("cu"), times(1).alias("su"), times(2).alias("twos")), "contexts")
    dishes, _ = kept_as(pairs.groupBy("v").agg(F.sum("c").alias("cv"), times(1).alias("sv"), (F.max("c") > 1).alias("again")), "dishes")
    n_train, n_types, still_ones = (int(x or 0) for x in dishes.agg(F.sum("cv"), F.sum((F.col("cv") > 0).cast("int")), F.sum((~F.col("again") & (F.col("sv") == 1)).cast("int"))).first())
    discount, types = discount_of(*(int(x or 0) for x in contexts.agg(F.sum("su"), F.sum("twos")).first())), n_types + 1
    contexts = contexts.drop("twos")
    state = pairs.where("c > 1").join(contexts.select("u", "su"), "u").select("u", "v", "c", F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("kept"), F.col("su").cast("long").alias("su"))
    state, at = kept_as(state, "seating")
    # v, tables of its dish (the parent's customers), the parent's tables of it, its kept probabilities; a dish of at most one table
    # whatever is drawn stays out, as its probability follows from the sweep's numbers
    moving = dishes.where("again or sv > 1").select("v", "sv")
    parent, parent_at, total = moving.select("v", F.lit(None).cast("long").alias("pt"), F.array().cast("array<double>").alias("p")), None, None
    sums, stays = [], []
    for sweep in range(-1, sweeps):
        keep = sweep >= burn_in
        if sweep >= 0:
            tables, base = state.groupBy("u").agg(F.sum("t").alias("tu")), parent.select("v", "now")
            joined = state.join(tables.hint("shuffle_hash"), "u").join(base.hint("shuffle_hash"), "v")  # rows a word: no sort of the state

            def draw(batches: Iterator[pa.RecordBatch], sweep=sweep, keep=keep) -> Iterator[pa.RecordBatch]:
                stirling = log_stirling(discount, EXACT_CUSTOMERS)
                for got in _gathered(batches):
                    u, v, c, t, total, su, tu, now = _of(got, "u", "v", "c", "t", "kept", "su", "tu", "now")
                    if len(u):  # a retried task draws the same numbers
                        own = np.random.default_rng([seed, sweep + 1, *(int(x) for x in (u[0].view(np.uint64), v[0].view(np.uint64))), len(u)])
                        t = draw_tables(c, su + tu - t, now, discount, own, stirling)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (u, v, c, t, total + t * keep, su))], ["u", "v", "c", "t", "kept", "su"])

            before = at
            state, at = kept_as(joined.select("u", "v", "c", "t", "kept", "su", "tu", "now").mapInArrow(draw, "u long, v long, c long, t long, kept long, su long"), "seating")
            discard(spark, before)
        if keep:
            sums.append(kept_as(state.groupBy("u").agg(F.sum("t").alias(f"t{len(sums)}")), "context-tables")[0])
        drawn = state.groupBy("v").agg(F.sum("t").alias("tv"))
        old = parent.select("v", "pt", "p")
        customers = moving.join(old, "v").join(drawn, "v", "left").select("v", (F.col("sv") + F.coalesce("tv", F.lit(0))).cast("long").alias("tv"), "pt", "p")
        customers, customers_at = kept_as(customers, "customers")
        n0, ones, twos, some = (int(x or 0) for x in customers.agg(F.sum("tv"), F.sum((F.col("tv") == 1).cast("int")), F.sum((F.col("tv") == 2).cast("int")), F.sum((F.col("tv") > 0).cast("int"))).first())
        n0, ones, some = n0 + still_ones, ones + still_ones, some + still_ones
        d0, others = discount_of(ones, twos), float(some if total is None else total)

        def seat(batches: Iterator[pa.RecordBatch], sweep=sweep, d0=d0, others=others) -> Iterator[pa.RecordBatch]:
            stirling = log_stirling(d0, EXACT_CUSTOMERS)
            for got in _gathered(batches):
                v, tv = _of(got, "v", "tv")
                pt = np.where(got.column("pt").is_null().to_numpy(), np.minimum(tv, 1), got.column("pt").fill_null(0).to_numpy())
                if len(v):
                    own = np.random.default_rng([seed, sweep + 1, int(v[0].view(np.uint64)), len(v)])
                    pt = draw_tables(tv, others - pt, np.full(len(v), 1 / types), d0, own, stirling)
                yield from pa.table([got.column("v"), got.column("tv"), pa.array(pt), got.column("p")], ["v", "tv", "pt", "p"]).to_batches()

        seated, seated_at = kept_as(customers.mapInArrow(seat, "v long, tv long, pt long, p array<double>"), "parent")
        total = int(seated.agg(F.sum("pt")).first()[0] or 0) + still_ones
        back = (STRENGTH + d0 * total) / types
        now = (F.col("tv") - F.lit(d0) * F.col("pt") + F.lit(back)) / F.lit(STRENGTH + n0)
        if keep:
            stays.append((F.col("sv") * F.lit(1 - d0) + F.lit(back)) / F.lit(STRENGTH + n0))
        parent = seated.select("v", "pt", (F.concat("p", F.array(now)) if keep else F.col("p")).alias("p"), now.alias("now"))
        for old_at in (customers_at, parent_at):
            if old_at and not keep:  # kept probabilities are columns of the later tables
                discard(spark, old_at)
        parent_at = seated_at
    rounds = len(sums)
    for k, s in enumerate(sums):
        contexts = contexts.join(s, "u", "left").withColumn(f"b{k}", (F.lit(STRENGTH) + F.lit(discount) * (F.col("su") + F.coalesce(f"t{k}", F.lit(0)))) / (F.lit(STRENGTH) + F.col("cu"))).drop(f"t{k}")
    rows = pairs.where("c <= 1").select("u", "v", "c", (F.col("c") * rounds).alias("kept")).unionByName(state.select("u", "v", "c", "kept"))
    contexts = contexts.select("u", (F.lit(STRENGTH) + F.col("cu")).alias("scale"), *[f"b{k}" for k in range(rounds)])
    words = dishes.join(parent.select("v", "p"), "v", "left").select("v", "cv", F.coalesce("p", F.array(*stays)).alias("p"))
    own = (F.col("c") - F.lit(discount / rounds) * F.col("kept")) / F.col("scale")
    rows = rows.join(contexts, "u").select("u", "v", own.alias("own"), *[f"b{k}" for k in range(rounds)]).join(words, "v")
    backed = sum(F.col(f"b{k}") * F.get("p", F.lit(k)) for k in range(rounds)) / rounds
    base = F.log10((F.col("cv") + 0.1) / F.lit(float(n_train + 0.1 * types))) if n_train else F.lit(0.0)
    return rows.select("u", "v", (F.col("cv") > 0).alias("known"), base.alias("base"), F.log10(F.col("own") + backed).alias("value")), n_train


def score_words(docs: DataFrame, folds: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``score`` by the model of all words, learned from the texts outside fold 0."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), (crc_bucket(key, folds) == 0).alias("held_out"), F.col(text).alias("text"))
    pairs = materialise(all_pairs(rows.select((~F.col("held_out")).alias("train"), "text")), "pair-counts")
    values, n_train = pair_values(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rid = np.repeat(np.array([x[0] for x in held]), [len(x[1]) for x in held])
            u, v, n = (np.concatenate(x) for x in zip(*(x[1:] for x in held), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n)], ["rid", "u", "v", "n"])

        for batch in batches:
            for rid, t in zip(batch.column("rid").to_pylist(), raw_bytes(batch, "text"), strict=True):
                held.append((rid, *_counted(*_word_pairs(t))))
                size += len(held[-1][1])
                if size >= PAIRS_A_BATCH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    held = rows.select("rid", "text").mapInArrow(run, "rid long, u long, v long, n long")
    # so many partitions that a task can hold its values: neither side is sorted then
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + pairs.count() // PAIRS_A_TASK)
    held = held.repartition(parts, "u", "v").join(values.repartition(parts, "u", "v").hint("shuffle_hash"), ["u", "v"])
    n = F.col("n")
    sums = held.groupBy("rid").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("known"), n).otherwise(0)).alias("n_known"), F.sum(n * F.col("base")).alias("base_score"), F.sum(n * F.col("value")).alias("score"))
    return rows.select("rid", "doc_id", "held_out").join(sums, "rid").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Per token, of the model and of the base, inside and outside the training texts."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("model"), per("base_score").alias("base"))


def learn_and_score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Learns outside fold 0 and scores every text."""
    return score_words(docs, folds)
