"""Language identification with string kernels.

The kernel of two texts counts the n-grams of 1 to 3 characters that both hold (a blended spectrum of presence bits), divided
by the geometric mean of the texts' own counts. Landmark texts span the Nystroem feature space, one-versus-rest kernel ridge
regression learns a score for each language in it, and a batch of texts is scored by matrix products: presence bits times
landmark bits gives the kernel rows, kernel rows times weights the scores. Because both are linear, their product is formed
once, so that a text costs one row of sums whatever the number of landmarks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text when nothing could be
learned; whole texts are read, long ones in pieces; repeated rows give one row each; equal scores go to the language that
sorts first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from regrowth.llm.common import crc_bucket

#: Bounds of the classifier's labelled sample: texts learned from and landmark texts, over all languages together, and the
#: longest stretch of a text that is learned from (a longer text gives a window at a place drawn from its id; texts to be classified
#: have no such bound).
TRAIN_TEXTS, LANDMARKS, SAMPLE_CHARS = 2_000, 192, 20_000
#: Strength of the ridge.
RIDGE = 1e-2
#: A text is of none of the languages if the share of its n-grams that no landmark has is over ``SLACK`` times that of the worst
#: ``TAIL`` of labelled texts. Texts under ``TELLING`` n-grams are too short for that and go only with under a quarter of the known share.
SLACK, TAIL, TELLING = 4.0, 0.01, 60
PIECE = 1 << 19
_GAPS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Sorted distinct n-grams (n = 1, 2, 3) of the lower-cased letters, other runs as one space; 21 bits a character."""
    s = f" {_GAPS.sub(' ', text.lower()).strip()} "
    found = []
    for at in range(0, len(s), PIECE):
        c = np.frombuffer(s[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        two = (c[:-1] << 21) | c[1:]
        found.append(np.unique(np.concatenate([c, two, (two[:-1] << 21) | c[2:]])))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Presence:
    """Products of presence rows with a dense matrix whose rows belong to a vocabulary of n-grams."""

    def __init__(self, vocabulary: np.ndarray, matrix: np.ndarray):
        self.vocabulary, self.matrix = vocabulary, matrix

    def __call__(self, texts: list[str]) -> np.ndarray:
        """One row per text: its presence bits times the matrix, over the root of its own count."""
        return self.rows(texts)[0]

    def rows(self, texts: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The product's rows, each text's share of n-grams in the vocabulary (where ``counts`` holds, if given), and its n-grams."""
        out = np.zeros((len(texts), self.matrix.shape[1]), dtype=np.float64)
        share, size = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        if not len(self.vocabulary):
            return out, share, size
        for i, t in enumerate(texts):
            g = grams(t)
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            own = at[self.vocabulary[at] == g]
            out[i] = self.matrix[own].sum(axis=0) / np.sqrt(len(g))
            share[i], size[i] = (len(own) if counts is None else counts[own].sum()) / len(g), len(g)
        return out, share, size


class Model:
    def __init__(self, languages: list[str], scorer: Presence | None, bias: np.ndarray, least: float = 0.0):
        self.languages, self.scorer, self.bias, self.least = languages, scorer, bias, least

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether enough of the text's n-grams are known for it to be in one of the languages."""
        names, scores, fits = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        seen = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        if seen:
            got, share, size = self.scorer.rows([texts[i] for i in seen])
            got = got + self.bias
            # less two standard errors of a share, which short texts need
            known = share >= np.where(size < TELLING, self.least / 4, self.least - 1 / np.sqrt(np.maximum(size, 1)))
            best = got.argmax(axis=1)
            for i, b, row, ok in zip(seen, best.tolist(), got, known.tolist(), strict=True):
                names[i], scores[i], fits[i] = self.languages[b], float(min(1.0, max(0.0, row[b]))), ok
        return names, scores, fits


def _sampled(known: DataFrame, counts: dict[str, int], total: int, salt: int) -> DataFrame:
    """About ``total`` rows, shared evenly by the languages, the same rows every time."""
    return known.where(_drawn(counts, total, salt))


def _drawn(counts: dict[str, int], total: int, salt: int):
    each = max(1, total // max(1, len(counts)))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.2 * each / n)))])
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return spot < share[F.col("lang")]


def _least(shares: np.ndarray) -> float:
    """The share of known n-grams that a text of the languages has at least, from the shares of labelled texts."""
    return max(0.0, 1.0 - SLACK * (1.0 - float(np.quantile(shares, TAIL, method="lower")))) if len(shares) else 0.0


def learn(docs: DataFrame, folds: int = 5) -> Model:
    """From text and language of the documents outside fold 0. The driver gets landmark n-grams and kernel rows of the bounded
    sample, never texts of the corpus."""
    known = docs.where(F.col("lang").isNotNull() & (crc_bucket("doc_id", folds) != 0))
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    known = known.select("doc_id", "lang", F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text")).where(F.col("text").rlike("\\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    if not counts:
        return Model([], None, np.zeros(0))
    languages = sorted(counts)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grams(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(got, pa.binary())], ["lang", "grams"])

    marks = _sampled(known, counts, LANDMARKS, 11).select("lang", "text").mapInArrow(sets, "lang string, grams binary").toArrow()
    marks = sorted(zip(marks.column("lang").to_pylist(), marks.column("grams").to_pylist(), strict=True))
    held = [np.frombuffer(g, dtype=np.int64) for _, g in marks]
    if not held:
        return Model([], None, np.zeros(0))
    vocabulary = np.unique(np.concatenate(held))
    bits = np.zeros((len(vocabulary), len(held)), dtype=np.float32)
    for j, g in enumerate(held):
        bits[np.searchsorted(vocabulary, g), j] = 1.0 / np.sqrt(len(g))
    kernel = docs.sparkSession.sparkContext.broadcast((vocabulary, bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = Presence(*kernel.value)
        # a landmark's own n-grams are all known: only those of another landmark count for it
        more = np.count_nonzero(product.matrix, axis=1) > 1
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), np.array(batch.column("landmark").to_pylist(), dtype=bool)
            got, share, _ = product.rows(texts)
            share[own] = product.rows([t for t, o in zip(texts, own, strict=True) if o], more)[1]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in got], pa.binary()), pa.array(share)], ["lang", "row", "share"])

    sample = _sampled(known, counts, TRAIN_TEXTS, 12).select("lang", "text", _drawn(counts, LANDMARKS, 11).alias("landmark"))
    sample = sample.mapInArrow(rows, "lang string, row binary, share double").toArrow()
    least = _least(sample.column("share").to_numpy())
    sample = sorted(zip(sample.column("lang").to_pylist(), sample.column("row").to_pylist(), strict=True))
    among = bits.T.astype(np.float64) @ bits.astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-9 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    y = np.array([languages.index(lang) for lang, _ in sample] or [languages.index(lang) for lang, _ in marks])
    k = np.array([np.frombuffer(r) for _, r in sample]) if sample else among
    features = np.hstack([k @ whiten, np.ones((len(y), 1))])
    size = np.bincount(y, minlength=len(languages))
    weight = (1.0 / np.maximum(1, size))[y]
    weight /= weight.mean()
    gram = (features * weight[:, None]).T @ features + RIDGE * np.diag([1.0] * (features.shape[1] - 1) + [1e-6])
    solved = np.linalg.solve(gram, (features * weight[:, None]).T @ np.eye(len(languages))[y])
    scorer = Presence(vocabulary, (bits @ (whiten @ solved[:-1])).astype(np.float32))
    return Model(languages, scorer, solved[-1], least)


def identify(docs: DataFrame, model: Model | None = None, folds: int = 5, keep: tuple[str, ...] = (), evidence: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, then the columns in ``keep`` as _k0, _k1, ... (the text, if named
    there, crosses to Python once) and with ``evidence`` whether the text fits the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, folds))
    names = ["doc_id", "held_out", *[f"_k{i}" for i in range(len(keep))]]
    text = names[2 + keep.index("text")] if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, fits = shared.value.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], [*names, "lang_pred", "score", "fits"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", folds) == 0).alias("held_out"),
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("_text")]),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, fits boolean").select("doc_id", "held_out", "lang_pred", "score", *names[2:], *(["fits"] if evidence else []))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language: not ``und``, and with n-grams like those of the labelled texts. The score does not decide:
    the scores of a text sum to one whatever it holds. Columns stay as they are."""
    own = docs.columns
    found = identify(docs, keep=tuple(own), evidence=True)
    return found.where((F.col("lang_pred") != "und") & F.col("fits")).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(own)])
