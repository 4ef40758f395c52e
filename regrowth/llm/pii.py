"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans, which may overlap: the exact patterns of four kinds, and loose ones (spelled-out
@ and dots, other separators, numbers without a plus). Boosted trees judge a candidate by its format and by its context, and
not by the marks that tell exact from loose spans; they are learned from the corpus itself, with the exact spans as
positive and all other candidates as negative rows (equal ones once, with their number as weight), and compiled to conditional
expressions. For each kind a threshold is
calibrated on rows the trees have not seen. Exact spans always stay; a loose one is added if it reaches its threshold and
overlaps no exact span and no loose one with a higher score.

Finding happens inside a row; learning shuffles the numbers of all candidates, counted by equal ones. Places are code points, end exclusive.

Defined cases: a null text is empty and has no spans; texts are read whole; repeated rows give one row each; without candidates
of both labels nothing is learned and the exact spans are the result; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from regrowth.llm.common import hash_share
from regrowth.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Exact patterns of the contract (fixed values), written so that no start is tried twice inside one run of characters.
EXACT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose generators.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{<]\x20?(?i:at)\x20?[)\]}>]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{<]\x20?(?i:dot|\.)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\x20?[(\[{]\x20?(?:\.|(?i:dot))\x20?[)\]}]\x20?|\x20\.\x20|\x20(?i:dot)\x20|,)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20_./\x{2013}\x{2011}\x{A0}-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"\+[0-9]{1,3}+\x20?\(?[0-9]{2,4}+\)?(?:[\x20.-]?[0-9]{2,4}+){2,3}(?!\.?[0-9])|(?<![0-9+])(?:00|\()?[0-9][\x20()./\x{A0}\x{2011}0-9-]{7,22}+(?<=[0-9])",
}
#: Cheap tests that a text must pass before a generator reads it; each follows from the generator's pattern. Most texts fail the first,
#: plain one (a digit, or a sign that stands for @), and the second is read in the others only.
NEEDS = {
    ("exact", "ip"): r"[0-9]\.[0-9]", ("exact", "card"): "[0-9][\\x20-]?[0-9]", ("exact", "phone"): r"\+[0-9]",
    ("loose", "ip"): r"[0-9](?:\x20?[(\[{]|\x20\.|\x20(?i:dot)|,[0-9])",
}
DIGIT, SPELLED_AT = "[0-9]", r"[aA][tT](?<=[\x20(\[{<]..)(?:\x20?[)\]}>]|\x20[A-Za-z0-9-]++(?:\.|\x20?[(\[{<]|\x20[dD][oO][tT]\x20))"
TREES, DEPTH = 12, 4
#: Share of the spans above a threshold that must be exact ones in the calibration rows, and the lowest threshold.
PRECISION, LEAST = 0.98, 0.8
CONTEXT = r"(?i)(mail|contact|write|tel|phone|call|mobile|fax|card|visa|credit|pay|host|server|addr|ip\b)"

FEATURES = (
    "n_chars", "n_digits", "n_letters", "n_spaces", "n_groups", "longest", "n_dots", "n_hyphens", "n_brackets", "luhn", "octets",
    "n_words", "last_word", "joined_left", "joined_right", "context", "is_email", "is_ip", "is_card", "is_phone",
)


def _starts(text: Column, pattern: str, found: Column) -> Column:
    """First places of the matches: between two matches lies one piece of the split text."""
    zipped = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.char_length(a).alias("a"), F.char_length(b).alias("b")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        zipped, zero,
        lambda acc, x: F.struct((acc["at"] + x["a"] + x["b"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["a"]).alias("starts")),
        lambda acc: acc["starts"],
    )


def _valid(kind: str, raw: Column) -> Column:
    digits = F.regexp_replace(raw, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return raw.rlike(r"^(?:0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.char_length(digits).between(9, 15)


_EMPTY = "array<struct<kind:int,start:int,end:int,raw:string,exact:boolean>>"


def _found(text: Column, digit: Column, kind: str, how: str) -> Column:
    """The generator's matches in order."""
    if kind == "email":
        first = F.contains(text, F.lit("@")) if how == "exact" else F.contains(text, F.lit(" @")) | F.contains(text, F.lit("@ ")) | text.rlike(SPELLED_AT)
    else:
        first = digit
    need = first & text.rlike(NEEDS[how, kind]) if (how, kind) in NEEDS else first
    matches = F.regexp_extract_all(text, F.lit((EXACT if how == "exact" else LOOSE)[kind]), F.lit(0))
    return F.when(need, matches).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, found: Column, kind: str, how: str) -> Column:
    """Their spans; the exact flag holds what the contract asks of a match."""
    made = F.zip_with(
        _starts(text, (EXACT if how == "exact" else LOOSE)[kind], found), found,
        lambda s, raw: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s.alias("start"), (s + F.char_length(raw)).alias("end"), raw.alias("raw"),
            (_valid(kind, raw) if how == "exact" else F.lit(False)).alias("exact"),
        ),
    )
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast(_EMPTY))


def candidates(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds ``_exact`` (by kind and place), ``_failed`` (matches of the exact patterns that fail their test) and ``_loose``.

    Tests, matches and spans are columns one after another, so that a pattern reads a text once, and again (for the places) only where
    it was found; inside one expression it would read the text for every use.
    """
    names = [(how, kind, f"{how[0]}{k}") for how in ("exact", "loose") for k, kind in enumerate(KINDS)]
    docs = docs.withColumn("_digit", F.col(text).rlike(DIGIT))
    docs = docs.withColumns({f"_f{c}": _found(F.col(text), F.col("_digit"), kind, how) for how, kind, c in names})
    docs = docs.withColumns({f"_{c}": _spans(F.col(text), F.col(f"_f{c}"), kind, how) for how, kind, c in names})
    exact, loose = F.concat(*[f"_e{k}" for k in range(4)]), F.concat(*[f"_l{k}" for k in range(4)])
    docs = docs.withColumns({"_exact": F.filter(exact, lambda s: s["exact"]), "_failed": F.filter(exact, lambda s: ~s["exact"]), "_loose": loose})
    return docs.drop("_digit", *[f"_{p}{c}" for *_, c in names for p in ("", "f")])


def _plain(text: Column, s: Column) -> Column:
    """A span's format without what tells an exact mark from a loose one (``(at)`` is @, a spelled-out dot a dot), and its context."""
    plain = F.regexp_replace(F.regexp_replace(s["raw"], r"\x20?[(\[{<]\x20?(?i:at)\x20?[)\]}>]\x20?|\x20(?i:at)\x20|\x20?@\x20?", "@"), r"\x20?[(\[{<]\x20?(?i:dot|\.)\x20?[)\]}>]\x20?|\x20(?i:dot)\x20", ".")
    left = F.substr(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
    place = [s[c].alias(c) for c in ("kind", "start", "end")]
    return F.struct(*place, F.regexp_replace(plain, r"^\+", "").alias("plain"), left.alias("left"), F.substr(text, s["end"] + 1, F.lit(1)).alias("right"))


def features(s: Column) -> dict[str, Column]:
    """Numbers of a plain span."""
    plain, left, right = s["plain"], s["left"], s["right"]
    digits = F.regexp_replace(plain, "[^0-9]", "")
    groups = F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z]+"), F.lit(0))
    number = lambda c: c.cast("double")
    octets = (F.size(groups) == 4) & ~F.exists(groups, lambda g: (F.char_length(g) > 3) | (g > "255") & (F.char_length(g) == 3))
    count = lambda pattern: number(F.regexp_count(plain, F.lit(pattern)))
    return {
        "n_chars": number(F.char_length(plain)), "n_digits": number(F.char_length(digits)), "n_letters": count("[A-Za-z]"), "n_spaces": count("\\s"),
        "n_groups": number(F.size(groups)), "longest": number(F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0))),
        "n_dots": count("\\."), "n_hyphens": count("-"), "n_brackets": count("[()\\[\\]{}]"),
        "luhn": number(F.char_length(digits).between(13, 19) & F.when(digits == "", False).otherwise(F.call_function("luhn_check", digits))), "octets": number(octets),
        "n_words": number(F.size(words)), "last_word": number(F.coalesce(F.char_length(F.element_at(F.concat(F.array(F.lit("")), words), -1)), F.lit(0))),
        "joined_left": number(left.rlike(r"[\p{L}\p{N}_]$")), "joined_right": number(right.rlike(r"[\p{L}\p{N}_]")), "context": number(left.rlike(CONTEXT)),
        **{f"is_{kind}": number(s["kind"] == k) for k, kind in enumerate(KINDS)},
    }


def _described(spans) -> Column:
    """Spans of ``_text`` with their features."""
    plain = F.transform(spans, lambda s: _plain(F.col("_text"), s))
    return F.transform(plain, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[c.alias(n) for n, c in features(s).items()]))


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, cut, left, right) or numbers, their weights, and a threshold for each kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def score(self, value) -> Column:
        """Probability by conditional expressions; ``value(name)`` is a feature's column."""
        def node(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(value(FEATURES[t[0]]) <= t[1], node(t[2])).otherwise(node(t[3]))

        margin = sum((node(t) * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _parse(text: str):
    """A printed regression tree as nested tuples."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]
    at = 0

    def node():
        nonlocal at
        line, at = lines[at], at + 1
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        low = node()
        at += 1  # Else
        return int(m[1]), float(m[2]), low, node()

    return node()


def _apart(s: Column) -> Column:
    """No match of the same kind's exact pattern overlaps. A loose copy of an exact span is no negative example, and a good span
    inside a match that fails as a whole (two numbers side by side) has no label at all."""
    return ~F.exists(F.concat("_exact", "_failed"), lambda e: (e["kind"] == s["kind"]) & (e["start"] < s["end"]) & (s["start"] < e["end"]))


def described(docs: DataFrame) -> DataFrame:
    """Adds the columns of ``candidates`` with the features of every span."""
    return candidates(docs).withColumns({c: _described(c) for c in ("_exact", "_failed", "_loose")})


def learn(docs: DataFrame) -> Trees:
    """From the candidates of all documents (``doc_id``, ``_text``)."""
    return _learned(described(docs))


def _learned(found: DataFrame) -> Trees:
    def labelled(spans, label: float):
        return F.transform(spans, lambda s: F.struct(s.alias("c"), F.lit(label).alias("label")))

    spans = F.concat(labelled("_exact", 1.0), labelled("_failed", 0.0), labelled(F.filter("_loose", _apart), 0.0))
    rows = found.select(hash_share(F.xxhash64("doc_id"), 0.7).alias("fit"), F.explode(spans).alias("x"))
    rows = rows.select("fit", "x.label", *[f"x.c.{n}" for n in ("kind", *FEATURES)])
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = materialise(rows, "candidates")
    fit, held = rows.where("fit"), rows.where("not fit")
    if {r.label for r in fit.select("label").distinct().collect()} != {0.0, 1.0}:
        return Trees()
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fit).select("features", "label", "n")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=1, weightCol="n").fit(assembled)
    out = Trees([_parse(t.toDebugString) for t in model.trees], [float(w) for w in model.treeWeights])
    # calibration: the lowest threshold of a grid from which on nearly all spans of the kind are exact ones
    scored = held.select("kind", "label", "n", F.floor(out.score(F.col) * 200).alias("step")).groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1.0, F.col("n")).otherwise(0.0)).alias("p"))
    got = [(r.kind, r.step, r.n, r.p) for r in scored.collect()]
    for k in range(len(KINDS)):
        for step in range(200, int(200 * LEAST) - 1, -1):
            n = sum(x[2] for x in got if x[0] == k and x[1] >= step)
            p = sum(x[3] for x in got if x[0] == k and x[1] >= step)
            if n and p < PRECISION * n:
                break
            if n:
                out.thresholds[k] = step / 200
    return out


def find(docs: DataFrame, trees: Trees | None = None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's key and ``keep`` columns (as _k0, ...), ``_text``, ``_null`` (no text), ``_exact`` and ``_all``: exact and added spans, by kind and place."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(text).isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    trees = trees or learn(rows.select("doc_id", "_text"))
    return _added(candidates(rows).withColumn("_free", _described(_free())), trees)


def _free() -> Column:
    """A loose candidate that touches an exact span is settled by it."""
    return F.filter(F.concat("_failed", "_loose"), lambda s: ~F.exists("_exact", lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"])))


def _added(rows: DataFrame, trees: Trees) -> DataFrame:
    """``_all``: the exact spans, and those of ``_free`` that the trees add."""
    if not trees.trees:
        return rows.withColumn("_all", F.transform("_exact", _place)).drop("_loose", "_failed", "_free")
    scored = F.transform("_free", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), trees.score(lambda n: s[n]).alias("score")))
    least = F.array(*[F.lit(t) for t in trees.thresholds])
    rows = rows.withColumn("_good", F.filter(scored, lambda s: s["score"] >= F.get(least, s["kind"])))
    beaten = lambda s: F.exists("_good", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (
        F.struct(o["score"], -o["kind"], -o["start"], o["end"]) > F.struct(s["score"], -s["kind"], -s["start"], s["end"])))
    added = F.transform(F.filter("_good", lambda s: ~beaten(s)), _place)
    return rows.withColumn("_all", F.array_sort(F.array_distinct(F.concat(F.transform("_exact", _place), added)))).drop("_loose", "_failed", "_free", "_good")


def _is(k: int):
    return lambda s: s["kind"] == k


def _place(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, counts of the exact spans, base_sha256, spans. Texts are read once: trees learn from the spans and judge them."""
    if trees is None:
        found = described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")))
        found = materialise(found.drop("_text"), "spans")
        found = _added(found.withColumn("_free", _free()), _learned(found))
    else:
        found = find(docs, trees)
    counts = [F.size(F.filter("_exact", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("_exact")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets (of overlapping spans, by that of the first);
    ``n_chars``, if there, follows the new text. Columns keep their names and order; rows without a text stay null."""
    own = docs.columns
    found = find(docs.withColumn("_id", F.lit(None).cast("long")) if "doc_id" not in own else docs, trees, "doc_id" if "doc_id" in own else "_id", text, tuple(c for c in own if c != text))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_place = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    pieces = F.aggregate(
        by_place, zero,
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substr(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.array(F.substr(F.col("_text"), a["at"] + 1, F.char_length("_text")))),
    )
    hit = F.size("_all") > 0
    new = F.when(hit, F.array_join(pieces, "")).when(~F.col("_null"), F.col("_text"))
    others = [c for c in own if c != text]
    found = found.withColumn("_new", new)
    cols = []
    for c in own:
        if c == text:
            cols.append(F.col("_new").alias(c))
        elif c == "n_chars":
            k = F.col(f"_k{others.index(c)}")
            cols.append(F.when(hit, F.char_length("_new").cast(dict(docs.dtypes)[c])).otherwise(k).alias(c))
        else:
            cols.append(F.col(f"_k{others.index(c)}").alias(c))
    return found.select(*cols)
