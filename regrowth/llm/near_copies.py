"""Near copies by SimHash over five-word shingles: a wide fingerprint, positional bytes in threes, Jaccard similarity verified.

Sets of shingles with Jaccard similarity 0.8 differ in 15 % of their SimHash bits on average, far over the three of 64 that
``simhash`` links at, so the fingerprint here has 31 positional bytes (248 bits). Positions are posted in threes. The 155 lines
{i, j, i xor j} of the positions 1 to 31 hold any two positions exactly once, and any 17 shared positions contain a whole line;
every second line of the same system with renumbered positions is posted too. Below 17 shared positions it is a matter of chance:
measured, 0.92 of pairs meet at similarity 0.80 to 0.84, 0.96 at 0.84 to 0.86, 0.99 above. What meets in a list is filtered by the
differing bits and verified by the Jaccard similarity of the whole shingle sets.

Keys have 24 bits, so lists of a few texts that share nothing else are common in a large table. All pairs of a list of up to ``SHORT``
nodes are met where the list is, by the differing bits of a 64-bit word of the fingerprint that the key has no part of; only what is
within ``WORD_BITS`` is written. Longer lists do not form all their pairs. A node first meets the least of its lists' leaders and
the smaller partner that it shares most short lists with; then, over the components found so far, partners in other components than its
own; then members outside their leader's component meet the rest of the list, again only in other components, once for all lists. Pairs
that the profiles of two nodes rule out (an upper bound of the shingles they share) are never verified on whole sets. Pairs left out lie in one component already or
are below the similarity, so a component is what all pairs of the lists would give, while a group of n copies costs about n pairs. Texts
of equal words are one node throughout. Whole texts are not shuffled: those wanted are found by a filter of bounded size first.

Defined cases: texts without a word are one node; a text of under five words has one shingle; repeated rows give one row each; a
null id is kept and never names a component while another id is there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regrowth.llm.common import lower_words, raw_bytes
from regrowth.llm.components import components
from regrowth.llm.decontaminate import hash_filter
from regrowth.llm.simhash import CHUNK, SEED
from regrowth.session import materialise

SIZE, SIMILAR = 5, 0.8
POSITIONS = 31
SYSTEM = [(i, j, i ^ j) for i in range(1, POSITIONS + 1) for j in range(i + 1, POSITIONS + 1) if j < i ^ j]
LINES = list(dict.fromkeys(SYSTEM + [tuple(sorted(3 * p % POSITIONS + 1 for p in line)) for line in SYSTEM[::2]]))
#: Differing bits at similarity 0.8: 37.6 on average with a deviation of 5.7; pairs over three deviations more go.
MAX_BITS = 56
#: Nodes of a list whose pairs are all met at once. Of the 64 bits of a word 9.7 differ on average at similarity 0.8, with a deviation
#: of 2.9 (24 is five deviations more), and 32 by chance, with one of 4.
SHORT, WORD_BITS = 8, 24
PARTS = ["f0", "f1", "f2", "f3"]
#: Bits of a profile: bit k is set if a shingle's hash is k modulo their number. It tells texts of up to some thousand shingles apart.
PROFILE_BITS = 1024
PROFILE = [f"p{k}" for k in range(PROFILE_BITS // 64)]
BOUND = ["size", "over", *PROFILE]


def shingle_set(text: bytes, size: int = SIZE) -> tuple[int, np.ndarray]:
    """Hash of the word sequence, and the distinct hashes of its shingles in order."""
    words = lower_words(text)
    if not words:
        return 0, np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    spots = zip((ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashed = xxhash.xxh64_intdigest
    return hashed(joined, SEED), np.unique(np.array([hashed(joined[a:b], SEED) for a, b in spots], dtype="<u8"))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash: the finaliser of a 64-bit mixing generator at its k-th step (fixed constants)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four signed longs whose bytes 1 to 31 are the positional bytes (byte 0 is unused): bits set in over half the hashes."""
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        wide = np.stack([_mixed(part, k) for k in range(4)], axis=1).view(np.uint8)
        counts += np.unpackbits(wide, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts[:8] = 0
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")


def profile(hashes: np.ndarray) -> np.ndarray:
    """The number of hashes, how many of them share a bit with an earlier one, and the bits as longs."""
    bits = np.zeros(PROFILE_BITS, dtype=bool)
    bits[(hashes % np.uint64(PROFILE_BITS)).astype(np.int64)] = True
    return np.concatenate([[len(hashes), len(hashes) - bits.sum()], np.packbits(bits, bitorder="little").view("<i8")])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, node (hash of the words), the fingerprint f0 to f3 and the profile of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.zeros(batch.num_rows, dtype=np.uint64)
            own = np.zeros((batch.num_rows, len(PARTS + BOUND)), dtype=np.int64)
            for i, t in enumerate(raw_bytes(batch, "text")):  # one set at a time
                nodes[i], hashes = shingle_set(t)
                own[i] = np.concatenate([wide_fingerprint(hashes), profile(hashes)])
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes.view(np.int64)), *[pa.array(c) for c in own.T.copy()]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", *PARTS, *BOUND])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, " + ", ".join(f"{p} long" for p in PARTS + BOUND))


def free_word(line: tuple[int, int, int]) -> int:
    """The last of the four words of the fingerprint that holds none of the line's positions."""
    return max(set(range(4)) - {p // 8 for p in line})


def postings(nodes: DataFrame) -> DataFrame:
    """(at, node, word): the list of each line's three positional bytes; ``at`` holds the line's number and the bytes."""
    by_position = F.array(*[F.shiftrightunsigned(PARTS[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255)) for p in range(POSITIONS + 1)])
    lines = F.array(*[
        F.struct(F.lit(n).cast("long").alias("n"), F.lit(free_word(line)).alias("w"), *[F.lit(p).alias(x) for p, x in zip(line, "ijk", strict=True)])
        for n, line in enumerate(LINES)
    ])
    byte = lambda p: F.get("_bytes", p)
    at = F.transform(lines, lambda t: F.struct(
        (((t["n"] * 256 + byte(t["i"])) * 256 + byte(t["j"])) * 256 + byte(t["k"])).alias("at"), F.get("_words", t["w"]).alias("word")))
    rows = nodes.select("node", by_position.alias("_bytes"), F.array(*PARTS).alias("_words"))
    return rows.select("node", F.explode(at).alias("_at")).select("_at.at", "node", "_at.word")


def met_lists(posted: DataFrame) -> DataFrame:
    """(at, node, n, leader, partners) of the lists of several nodes, from one exchange.

    In a list of up to ``SHORT`` nodes ``partners`` are the larger nodes within ``WORD_BITS`` of a node, and nodes without any have no row.
    """
    own = W.partitionBy("at")
    held = posted.repartition("at").withColumns({"n": F.count(F.lit(1)).over(own), "leader": F.min("node").over(own)}).where("n > 1")
    later = [F.struct(*[F.lead(c, k).over(own.orderBy("node")).alias(c) for c in ("node", "word")]) for k in range(1, SHORT)]
    held = held.withColumn("_later", F.array(*later))
    near = F.filter("_later", lambda x: x["node"].isNotNull() & (F.bit_count(x["word"].bitwiseXOR(F.col("word"))) <= WORD_BITS))
    held = held.select("at", "node", "n", "leader", F.when(F.col("n") <= SHORT, F.transform(near, lambda x: x["node"])).alias("partners"))
    return held.where((F.col("n") > SHORT) | (F.size("partners") > 0))


def _bits(a: str, b: str) -> Column:
    """Differing bits of two fingerprints whose columns begin with ``a`` and ``b``."""
    return sum(F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARTS)


def _may_be_similar(a: str, b: str) -> Column:
    """False if two profiles cannot belong to sets of ``SIMILAR``: hashes in both have a bit in both, or share one with an earlier hash."""
    both = sum(F.bit_count(F.col(f"{a}{p}").bitwiseAND(F.col(f"{b}{p}"))) for p in PROFILE)
    most = both + F.least(f"{a}over", f"{b}over")
    return most * (1 + SIMILAR) + 1e-6 >= F.lit(SIMILAR) * (F.col(f"{a}size") + F.col(f"{b}size"))


def _first_here(a: str, b: str, line: Column) -> Column:
    """True if two fingerprints share the three positional bytes of no line before the given one."""
    same = lambda p: F.shiftrightunsigned(F.col(f"{a}{PARTS[p // 8]}").bitwiseXOR(F.col(f"{b}{PARTS[p // 8]}")), 8 * (p % 8)).bitwiseAND(F.lit(255)) == 0
    shared = sum(F.when(same(p), F.lit(1 << p)).otherwise(F.lit(0)) for p in range(1, POSITIONS + 1))
    masks = F.slice(F.array(*[F.lit(sum(1 << p for p in x)).cast("long") for x in LINES]), F.lit(1), line)
    # the outer function holds the shared positions in a variable; the inner one ends at the first earlier line
    return ~F.exists(F.array(shared.cast("long")), lambda x: F.exists(masks, lambda m: m.bitwiseAND(x) == m))


def _side(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return table.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _differing(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs within ``MAX_BITS`` whose profiles allow the similarity."""
    both = pairs.join(_side(nodes, "a", PARTS + BOUND), "a").join(_side(nodes, "b", PARTS + BOUND), "b")
    return both.where((_bits("a_", "b_") <= MAX_BITS) & _may_be_similar("a_", "b_")).select(*pairs.columns)


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of the wanted nodes, made anew from one text of each; the filter lets few other texts into the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t)[1].view(np.int64) for t in raw_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    wanted = materialise(nodes.join(wanted, "node").select("node", "text_hash"), "wanted-texts")
    held = hash_filter(wanted.select(F.col("text_hash").alias("hash")))
    texts = docs.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text")).where(held("text_hash")).join(wanted, "text_hash")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return materialise(texts.mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes a, b whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(SIMILAR) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def rest_pairs(nodes: DataFrame, members: DataFrame, apart: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that a list holds besides its leader, each once, from the first list that has both.

    ``members`` are those of the lists (at, node, leader), ``apart`` the pairs (node, leader) in different components, ``of`` the
    components (node, of). A pair in different components has a member outside its leader's component in every list it is in. Pairs over
    ``MAX_BITS`` or whose profiles rule ``SIMILAR`` out are never made.
    """
    known = nodes.select("node", *PARTS, *BOUND).join(of, "node")
    lists = members.groupBy("node").agg(F.collect_list(F.struct("at", "leader")).alias("_lists"))  # one entry for each line at most
    leaders = apart.groupBy("node").agg(F.collect_set("leader").alias("_apart"))
    held = known.join(lists, "node").join(leaders, "node", "left").withColumn("_in", F.explode("_lists"))
    held = held.withColumns({"at": F.col("_in.at"), "apart": F.coalesce(F.array_contains("_apart", F.col("_in.leader")), F.lit(False))})
    one, other = (_side(held, name, ["at", *PARTS, *BOUND, "of", "apart"]) for name in ("u", "v"))
    met = (
        (F.col("u_at") == F.col("v_at")) & (F.col("u_of") != F.col("v_of")) & (~F.col("v_apart") | (F.col("u") < F.col("v")))
        & (_bits("u_", "v_") <= MAX_BITS) & _may_be_similar("u_", "v_") & _first_here("u_", "v_", F.shiftrightunsigned("u_at", 24).cast("int"))
    )
    return one.where("u_apart").join(other, met).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def _across(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (a, b) in different components, a node without a link being its own."""
    for x in ("a", "b"):
        pairs = pairs.join(names.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")), x, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash and component_id (smallest id reachable over verified links)."""
    rows = materialise(sketches(docs, key, text), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"), *[F.min(p).alias(p) for p in PARTS + BOUND])
    nodes = materialise(nodes, "nodes")
    lists = materialise(met_lists(postings(nodes)), "lists")
    short = lists.where(F.col("n") <= SHORT).select(F.col("node").alias("a"), F.explode("partners").alias("b"))
    near = materialise(_differing(nodes, short.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))), "near-pairs")
    members = lists.where(F.col("n") > SHORT).select("at", "node", "leader")
    led = materialise(members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "led")
    made: list[DataFrame] = []  # sets of shingles

    def links(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs, whose sets are made if they are not there yet."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for own in made:
            wanted = wanted.join(own.select("node"), "node", "left_anti")
        made.append(shingle_sets(docs, nodes, wanted, text))
        return materialise(similar(reduce(DataFrame.unionByName, made), pairs), "links")

    closest = near.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b")
    least = _differing(nodes, led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    edges = links(materialise(closest.unionByName(least).distinct(), "first-pairs"))
    names = materialise(components(edges), "names")
    more = materialise(_across(near, names), "near-pairs")
    if not more.isEmpty():
        edges = edges.unionByName(links(more))
        names = materialise(components(edges), "names")
    apart = materialise(_across(led, names), "apart")
    if not apart.isEmpty():  # a long list with a member outside its leader's component
        in_lists = led.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        of = in_lists.join(names, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
        near = rest_pairs(nodes, members, apart.select(F.col("a").alias("leader"), F.col("b").alias("node")), materialise(of, "list-components"))
        near = materialise(near, "near-pairs")
        if not near.isEmpty():
            names = materialise(components(edges.unionByName(links(near))), "names")
    of = nodes.join(names, "node", "left").select("node", "first", F.coalesce("component", "node").alias("_c"))
    least = of.groupBy("_c").agg(F.min("first").alias("component_id"))
    of = materialise(of.join(least, "_c").select("node", "component_id"), "node-components")
    return rows.join(of, "node").select("doc_id", "text_hash", "component_id")
