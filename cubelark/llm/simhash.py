"""SimHash near-dedup with pivot distance tables.

``simhash_components`` links 64-bit fingerprints that differ in few bits. Its
table holds, for each distinct fingerprint, the Hamming distances to many fixed
reference fingerprints (pivots). By the triangle inequality two fingerprints
within ``max_bits`` differ by no more than that in every coordinate, so pairs
are discarded by the largest coordinate difference and survivors are verified.
Pairs meet by equal blocks: of ``max_bits + c`` blocks at least ``c`` agree, so
no pair is lost. A bucket with many members is not paired up: its members meet
at the values one bit away from them (for two bits), of which each has 65.

``near_duplicates`` is for documents whose shingle sets have a Jaccard
similarity of 0.8 or more. Such fingerprints differ in some 15 % of their bits,
a radius at which equal blocks prune nothing; so its pairs meet by their rarest
shingles, SimHash and the pivot table discard, and whole shingle sets verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import batches_of, cut, discard, spread, written
from cubelark.llm.components import components

#: Reference fingerprints; members of a bucket that are paired up.
PIVOTS, PAIRED = 16, 64
SEED = 42
#: near_duplicates: bits by which verified pairs may differ at most (9.7 and a deviation of 2.9 are expected at 0.8), shingles below which fingerprints discard nothing.
FAR_BITS, FEW = 28, 40
#: Pivots in the packed table, a byte each; cells of the frequency sketch; rows that a worker takes at once.
PACKED, CELLS, CELL_SHIFT, BATCH = 8, 1 << 16, np.uint64(48), 1_000
_PIVOT_VALUES = [xxhash.xxh64_intdigest(b"pivot %d" % i) - (1 << 63) for i in range(PIVOTS)]


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text, A-Z lower-cased, repeats included; of the whole sequence where it is shorter; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII white space and lower-case ASCII letters
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -k])).tolist()
    whole = memoryview(b" ".join(words))
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text, as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": [signed(fingerprint(shingle_hashes(t, shingle))) for t in b["text"]]})

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, f"id {kind}, fp long")


def with_pivots(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Add the pivot table: d0, d1 ... are the Hamming distances to the reference fingerprints."""
    return fps.withColumns({f"d{i}": F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("byte") for i, p in enumerate(_PIVOT_VALUES)})


def near(a: str, b: str, max_bits: int):
    """Condition: no pivot coordinate differs by more than max_bits, and the fingerprints don't either."""
    coordinates = [F.abs(F.col(f"{a}.d{i}") - F.col(f"{b}.d{i}")) <= max_bits for i in range(PIVOTS)]
    return reduce(lambda x, y: x & y, coordinates) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= max_bits)


def _block_masks(n: int, max_bits: int) -> list[int]:
    """Masks of the blocks that must agree: more blocks, and so longer keys, for more fingerprints."""
    agree = 1
    while agree < 4 and 64 * agree / (max_bits + agree) < np.log2(max(2, n)) + 2:
        agree += 1
    edges = np.linspace(0, 64, max_bits + agree + 1).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [signed(reduce(lambda x, y: x | y, c)) for c in combinations(blocks, agree)]


def links(fps: DataFrame, max_bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints ``fp`` within ``max_bits`` (at most 2) of each other. A node may be a value between two fingerprints."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_block_masks(fps.count(), max_bits))])
    members = with_pivots(fps.select("fp")).withColumn("key", F.explode(keys)).select("key.t", "key.k", "fp", *[f"d{i}" for i in range(PIVOTS)])
    large = cut(members.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > paired).select("t", "k"))
    if large.isEmpty():
        small, rest = members, None
    else:
        small, rest = members.join(large, ["t", "k"], "left_anti"), members.join(large, ["t", "k"], "left_semi").select("fp").distinct()
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near("a", "b", max_bits)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if rest is None or max_bits == 0:
        return pairs
    balls = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    met = rest.select("fp", F.explode(balls).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 fingerprints are within one bit of a value
    if max_bits == 1:  # two members around a value may be two bits apart: only the value itself counts
        met = met.where(F.array_contains("fps", F.col("z")))
    return pairs.unionByName(met.select(F.explode("fps").alias("u"), F.col("z").alias("v")))


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed long), component_id (smallest id reachable over links of at most ``max_bits`` bits).

    Null and wordless texts have fingerprint zero and are linked like any other.
    Null ids are kept; a component whose ids are all null has a null
    component_id. Repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored.
    """
    own = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(fps, max_bits))
    labelled = cut(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    by_fp = labelled.join(least, "label").select("fp", "component_id")
    return own.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """Of each of ``CELLS`` cells, the shingles of all texts that fall into it: a fixed-size sketch of how common a shingle is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for whole in batches:
            for t in whole.column(0):
                total += np.bincount((np.unique(shingle_hashes(t.as_py(), shingle)) >> CELL_SHIFT).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        out[r["cell"]] = r["n"]
    return out


def prefix(n: int, similarity: float) -> int:
    """Elements of which two sets with that Jaccard similarity share one at least, if both take their first in one order."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _signatures(texts: DataFrame, shingle: int, similarity: float, frequencies: np.ndarray) -> DataFrame:
    """(id, same, n, fp, pivots, shingles, keys): the set of shingles, its prefix by rising frequency, and the distances of its fingerprint to the pivots, a byte each."""
    kind = texts.schema["id"].dataType.simpleString()
    sent = texts.sparkSession.sparkContext.broadcast(frequencies)
    pivots = np.array([v % (1 << 64) for v in _PIVOT_VALUES[:PACKED]], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = sent.value
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                once = np.unique(shingle_hashes(t, shingle))  # the similarity is that of sets
                rare = once[np.argsort(common[(once >> CELL_SHIFT).astype(np.int64)], kind="stable")[: prefix(len(once), similarity)]] if len(once) else once
                fp = fingerprint(once)
                apart = np.bitwise_count(pivots ^ np.uint64(fp)).astype(np.uint8).tobytes()
                rows.append((i, signed(xxhash.xxh64_intdigest(once.tobytes())), len(once), signed(fp), int.from_bytes(apart, "little", signed=True), np.unique((once >> np.uint64(32)).astype(np.uint32)).astype("<u4").tobytes(), rare.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "same", "n", "fp", "pivots", "shingles", "keys"])

    return texts.mapInPandas(run, f"id {kind}, same long, n int, fp long, pivots long, shingles binary, keys array<long>")


def _candidates(a: str, b: str, similarity: float):
    """Condition: sizes, places of the shared shingle, pivot coordinates and fingerprints of two rows allow the similarity.

    A set has n shingles of which ``at`` come before the shared one. Fingerprints of sets of few shingles say nothing.
    """
    n, m, at, to = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    sizes = (F.least(n, m) >= F.greatest(n, m) * similarity) & ((F.least(n - at, m - to)) * (1 + similarity) + 1e-9 >= (n + m) * similarity)
    part = lambda c, i: F.shiftrightunsigned(F.col(f"{c}.pivots"), 8 * i).bitwiseAND(F.lit(255))
    coordinates = reduce(lambda x, y: x & y, [F.abs(part(a, i) - part(b, i)) <= FAR_BITS for i in range(PACKED)])
    return sizes & ((F.least(n, m) < FEW) | (coordinates & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= FAR_BITS)))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: documents linked by a Jaccard similarity of word shingles of at least ``similarity``.

    Two such documents share one of the rarest shingles of either (a fifth of
    them at 0.8), so all links are found, but for pairs whose fingerprints
    differ in over ``FAR_BITS`` of 64 bits. Documents with equal shingle sets
    are one class from the start. The members of each shared shingle are first
    held against one leader; then only members of different components are
    held against each other, so a group of copies costs about a link for each.

    Null and wordless texts are one class. Repeated rows of an id give repeated
    rows; rows that share an id but not the text share the component of the id.
    Other columns are ignored, an empty table gives an empty result. Ids must be
    long and not null.
    """
    spark = docs.sparkSession
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    with batches_of(spark, BATCH):
        own = written(_signatures(texts, shingle, similarity, _frequencies(texts, shingle)), "signatures")
    classes = cut(own.groupBy("same").agg(F.min("id").alias("rep")))
    reps = own.join(classes.select(F.col("rep").alias("id"), "same"), ["id", "same"], "left_semi")
    keyed = reps.select("id", "n", "fp", "pivots", F.posexplode("keys").alias("at", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    common = written(keyed.join(shared, "key", "left_semi"), "shared-shingles")
    # The fewer shingles of its own a member has, the more of the others are near it: it leads.
    met = written(common.join(common.groupBy("id").agg(F.count(F.lit(1)).alias("weight")), "id"), "members")
    discard(common)
    sets = own.select("id", "same", "shingles").join(classes.select(F.col("rep").alias("id"), "same"), ["id", "same"], "left_semi").select("id", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            same = np.zeros(p.num_rows, bool)
            for k, (x, y) in enumerate(zip(p.column("a"), p.column("b"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    same[k] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([p.column("u").filter(pa.array(same)), p.column("v").filter(pa.array(same))], names=["u", "v"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        joined = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        with batches_of(spark, BATCH):
            found = cut(joined.mapInArrow(verify, "u long, v long"))
        discard(pairs)
        return found

    def pairs_of(a: DataFrame, b: DataFrame, apart) -> DataFrame:
        """Pairs (u, v), u the smaller id, of rows of ``a`` and ``b`` with a shingle in common."""
        a, b = a.alias("a"), b.alias("b")
        return a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _candidates("a", "b", similarity)).select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))

    row = ["id", "n", "fp", "pivots", "at"]
    by_weight = F.struct(F.col("weight"), (-F.col("id")).alias("order"), *row)
    leaders = met.groupBy("key").agg(F.max(by_weight).alias("l")).select("key", *[F.col(f"l.{c}").alias(c) for c in row])
    label = components(verified(pairs_of(met, leaders, F.col("a.id") != F.col("b.id"))))
    # Of each key, the members aside of the leader's component against all that are in another component than they.
    at = met.join(label.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    parted = cut(at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", by_weight).alias("main")).where("low <> high").select("key", "main"))
    if not parted.isEmpty():
        at = written(at.join(parted, "key"), "parted")
        more = verified(pairs_of(at.where("label <> main"), at, F.col("a.label") != F.col("b.label")))
        ends = more.join(label.select(F.col("node").alias("u"), F.col("label").alias("x")), "u", "left").join(label.select(F.col("node").alias("v"), F.col("label").alias("y")), "v", "left")
        over = components(ends.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")))
        grown = label.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("to", "label").alias("label"))
        label = grown.unionByName(grown.select(F.col("label").alias("node"), "label")).distinct()
        discard(at)
    discard(met)
    labelled = cut(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("same", "rep", F.coalesce("label", "rep").alias("label")))
    least = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    by_class = labelled.join(least, "label").select("same", "component_id")
    return own.select("id", "same").join(by_class, "same").select(F.col("id").alias(id_col), "component_id")
