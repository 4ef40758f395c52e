"""Quality rules as a learned decision list, in DataFrame functions only.

``text_statistics`` turns whole texts into numbers inside the scan. ``learn`` covers the labelled bad documents rule by
rule: a rule grows one threshold at a time by information gain on one part of the rows, drops its last conditions while
that helps on the other part, and is kept while it is precise; its thresholds then move halfway to the nearest row it covers.
``as_column`` emits the list as one ordered CASE.

Defined cases: a null or empty text has no word and fails the base rule; texts of any length are taken whole; without
labels, or with labels of one kind only, the list is empty and the base rule alone decides; repeated labels of one
document count once (its lowest quality); rows of documents are never merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from regrowth.llm.common import SPACE, hash_share
from regrowth.session import materialise

#: Labelled rows that the rules are learned from, about: a bound for the classifier's sample, nothing else.
TRAIN_ROWS = 20_000
#: Thresholds tried for each statistic: its quantiles in the sample.
CUTS = 24
MAX_RULES, MAX_CONDITIONS = 8, 4
#: A rule is kept if it covers at least so many bad rows of the sample, and is right at least this often on both parts.
MIN_COVERED, MIN_PRECISION = 8, 0.98

FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "alpha_share", "digit_share", "upper_share",
    "end_share", "unique_share", "words_per_line",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def both(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The contract's counts and the features, one row per document, without a shuffle.

    Repeated windows: the 64-bit hashes of a text's 5-word windows are compared with their distinct ones; only a text
    with a repeat sorts them, marks equal neighbours, and adds up what the marked windows cover from left to right.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+"), lambda w: w != "")
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), words.alias("_words"))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_hash": F.transform("_words", lambda w: F.xxhash64(w))})
    windows = F.when(
        F.col("n_words") >= 5,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 5, F.lit(0))),
            lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(5)]),
        ),
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumns({"_windows": windows, "_lines": lines, "_joined": F.array_join("_words", "")})
    out = out.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = out.withColumn("_placed", F.when(F.col("_repeats"), placed))
    equal = F.filter(
        F.transform(
            "_placed",
            lambda x, i: F.when((x["h"] == F.get("_placed", i - 1)["h"]) | (x["h"] == F.get("_placed", i + 1)["h"]), x["p"]),
        ),
        lambda p: p.isNotNull(),
    )
    out = out.withColumn("_at", F.sort_array(equal))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    count = lambda pattern: F.regexp_count("_joined", F.lit(pattern)).cast("long")
    out = out.select(
        *keep, "n_words",
        F.char_length("_joined").cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), count("[^\\p{L}]").alias("_other"), count("[0-9]").alias("_digits"),
        count("\\p{Lu}").alias("_upper"), count("[.!?]").alias("_ends"), F.size(F.array_distinct("_hash")).alias("_unique"),
    )
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns({
        "mean_word": part("word_chars", "n_words"), "symbol_share": part("n_symbols", "word_chars"),
        "dup_line_share": part("n_dup_lines", "_n_lines"), "repeat_share": part("n_repeat_words", "n_words"),
        "alpha_share": 1.0 - part("_other", "word_chars"), "digit_share": part("_digits", "word_chars"),
        "upper_share": part("_upper", "word_chars"), "end_share": part("_ends", "n_words"),
        "unique_share": part("_unique", "n_words"), "words_per_line": part("n_words", "_n_lines"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_n_lines", "_other", "_digits", "_upper", "_ends", "_unique")


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gained on the bad rows that a longer rule keeps."""
    if p == 0:
        return -1.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, bad: str = "bad") -> list[list[Condition]]:
    """Ordered rules for bad rows from a bounded table with ``FEATURES``, the 0/1 column ``bad`` and a key ``doc_id``.

    Every count is one aggregate over the table; what reaches the driver is one row of sums per condition tried.
    """
    rows = labelled.select(*FEATURES, F.col(bad).cast("int").alias("_bad"), hash_share(F.col("doc_id"), 2 / 3).alias("_grow"))
    rows = materialise(rows, "rules")
    quantiles = rows.select(*[F.percentile_approx(F.col(f).cast("double"), [(i + 1) / (CUTS + 1) for i in range(CUTS)], 2000).alias(f) for f in FEATURES]).first()
    tried = [Condition(f, above, float(c)) for f in FEATURES for c in sorted(set(quantiles[f] or [])) for above in (False, True)]
    rules: list[list[Condition]] = []

    def left(part: Column | None = None) -> DataFrame:
        out = rows if part is None else rows.where(part)
        for r in rules:
            out = out.where(~both(r))
        return out

    def sums(df: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
        got = df.agg(*[F.sum(F.when(t, F.col("_bad")).otherwise(0)).alias(f"p{i}") for i, t in enumerate(tests)],
                     *[F.sum(F.when(t, 1 - F.col("_bad")).otherwise(0)).alias(f"n{i}") for i, t in enumerate(tests)]).first()
        return [(got[f"p{i}"] or 0, got[f"n{i}"] or 0) for i in range(len(tests))]

    while len(rules) < MAX_RULES and tried:
        grown: list[Condition] = []
        (p, n), = sums(left(F.col("_grow")), [F.lit(True)])
        if p < MIN_COVERED:
            break
        while n > 0 and len(grown) < MAX_CONDITIONS:
            got = sums(left(F.col("_grow")).where(both(grown)), [c.column() for c in tried])
            best = max(range(len(tried)), key=lambda i: (_gain(p, n, *got[i]), -i))
            if _gain(p, n, *got[best]) <= 0 or got[best] == (p, n):
                break
            grown.append(tried[best])
            p, n = got[best]
        if not grown:
            break
        heads = [grown[: k + 1] for k in range(len(grown))]
        got = sums(left(~F.col("_grow")), [both(h) for h in heads])
        worth = [(a - b) / (a + b) if a + b else -1.0 for a, b in got]
        at = max(range(len(heads)), key=lambda k: (worth[k], -k))
        rule = heads[at]
        (gp, gn), = sums(left(F.col("_grow")), [both(rule)])
        hp, hn = got[at]
        if gp + hp < MIN_COVERED or gp < MIN_PRECISION * (gp + gn) or hp < MIN_PRECISION * (hp + hn):
            break
        rules.append(centred(rule, left().where(both(rule))))
    return rules


def centred(rule: list[Condition], covered: DataFrame) -> list[Condition]:
    """Each threshold moved halfway to the nearest covered value: the sample's coverage stays, near misses are left alone."""
    ends = covered.agg(*[(F.min if c.above else F.max)(c.feature).cast("double").alias(f"e{i}") for i, c in enumerate(rule)]).first()
    return [Condition(c.feature, c.above, (c.cut + ends[f"e{i}"]) / 2) for i, c in enumerate(rule)]


def as_column(rules: list[list[Condition]]) -> Column:
    """The number (from 1) of the first rule that holds, else 0, as one ordered conditional expression."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(both(r), i + 1) if out is None else out.when(both(r), i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[list[Condition]]]:
    """Statistics, base rule, number of the rule that fires and verdict for every document, and the learned list."""
    stats = materialise(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "statistics")
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_q"))
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    sample = stats.join(known.where(hash_share(F.col("doc_id"), share)), "doc_id").where(~F.col("base_failed"))
    rules = learn(sample.withColumn("bad", (F.col("_q") == 0).cast("int")))
    out = stats.withColumn("rule", F.when(F.col("base_failed"), -1).otherwise(as_column(rules)).cast("int"))
    return out.withColumn("kept", F.col("rule") == 0), rules


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, _ = judge(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
