"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

A document is the set of its word shingles. For SuperMinHash each element draws
a random permutation of the signature's positions, one step at a time, and
brings to the position of step j the rank j plus a random fraction; a position
keeps the smallest rank. An element so serves all positions with ranks that
exclude each other, which makes the estimate less variable than with independent
hashes, and elements stop as soon as the largest rank in the signature is below
their next step: a set of many elements needs one or two steps of each.

Documents meet where all values of a band agree. Of 32 bands of 4 values, two
sets at a similarity of 0.8 have none in common with a chance of 5e-8. Equal sets
are one class from the start. The members of a band's bucket are held against
one leader. Buckets that are in several components after that hold strangers;
their pairs are not all looked at, but those that share an element so rare for
them, so early in either set, that the similarity is possible (prefix filter).
Every link is confirmed on the full sets. Components are formed by rounds of
hooking and contraction, a union-find without a shared array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import batches_of, cut, discard, spread, written
from cubelark.llm.components import components

#: Values of a signature and of a band.
VALUES, ROWS = 128, 4
#: Elements that take their steps together; a set of more is cut, and its parts' signatures merged.
TOGETHER = 1 << 16
#: Rows that a worker takes at once where rows hold whole sets; identifiers that are broadcast at most.
BATCH, FEW = 500, 1_000_000
_A, _B, _STEP = (np.uint64(xxhash.xxh64_intdigest(b"superminhash %d" % i) | 1) for i in range(3))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = 2) -> np.ndarray:
    """The distinct k-word shingles of a text, A-Z lower-cased, as ascending hashes; the whole sequence as one where it is shorter; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(own))
    joined = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        joined = mixed(joined * _A + own[i : len(own) - k + 1 + i] * _B)
    return np.unique(joined)


def signatures(sets: list[np.ndarray], m: int = VALUES) -> np.ndarray:
    """A row of ``m`` values for each non-empty set: the step in the upper half of a value, the fraction in the lower one."""
    pieces = [(k, s[a : a + TOGETHER]) for k, s in enumerate(sets) for a in range(0, len(s), TOGETHER)]
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < len(pieces):
        end, n = start + 1, len(pieces[start][1])
        while end < len(pieces) and n + len(pieces[end][1]) <= TOGETHER:
            n += len(pieces[end][1])
            end += 1
        some = pieces[start:end]
        found = _stepped(np.concatenate([s for _, s in some]), np.repeat(np.arange(len(some)), [len(s) for _, s in some]), len(some), m)
        for (k, _), row in zip(some, found, strict=True):
            out[k] = np.minimum(out[k], row)
        start = end
    return out


def _stepped(x: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """Signatures of the sets whose elements are ``x``: all elements take a step before any takes the next."""
    values = np.full(sets * m, np.iinfo(np.uint64).max, np.uint64)
    places, row = None, None
    for j in range(m):
        draw = mixed(x + np.uint64(int(_STEP) * (j + 1) & (1 << 64) - 1))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k  # the permutation is still the identity
        else:
            place = places[row, k].astype(np.int64)
            places[row, k] = places[row, j]
        np.minimum.at(values, owner * m + place, np.uint64(j << 32) | (draw >> np.uint64(32)))
        left = values.reshape(sets, m).max(axis=1) >= np.uint64((j + 1) << 32)  # else no later step can lower a value
        going = left[owner]
        if not going.any():
            break
        if j == 0:
            places = np.empty((int(going.sum()), m), np.uint8 if m <= 256 else np.int32)
            places[:] = np.arange(m)
            row = np.arange(len(places))
            places[row, k[going]] = 0  # what the first step moved; its own place is not looked at again
        else:
            row = row[going]
        x, owner = x[going], owner[going]
    return values.reshape(sets, m)


def band_keys(found: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature."""
    bands = found.reshape(len(found), -1, rows)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(rows):
        keys = mixed(keys * _A + bands[:, :, i] * _B)
    return keys


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, id, same, n, keys) of (id, text): the digest and the size of the set, and the keys of its bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                some = whole.slice(k, 200)
                sets = [shingle_set(t.as_py(), shingle) for t in some.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in full])).view(np.int64)
                per = VALUES // ROWS
                sizes = np.array([per if len(s) else 0 for s in sets], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int32), sizes.cumsum(dtype=np.int32)))), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists], names=["id", "same", "n", "keys"])

    return docs.mapInArrow(run, f"id {kind}, same binary, n long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(same, shingles) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                sets = [shingle_set(t.as_py(), shingle).tobytes() for t in whole.slice(k, 200).column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["same", "shingles"])

    return docs.mapInArrow(run, "same binary, shingles binary")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their whole sets, the number of elements in common."""
    for p in batches:
        both = np.empty(p.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(p.column("a"), p.column("b"), strict=True)):
            both[k] = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
        yield pa.RecordBatch.from_arrays([p.column("u"), p.column("v"), p.column("n"), p.column("m"), pa.array(both)], names=["u", "v", "n", "m", "both"])


def near_duplicate_groups(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links, itself included).

    Two rows are linked where ``100 * intersection >= percent * union`` of their
    shingle sets. Null, empty and wordless texts have an empty set and are linked
    with nothing, not even each other: their component is their own id. Rows of
    one text are linked. Null ids are kept; a component without any other id has
    a null component_id. Rows that share an id but not the text are rows of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with batches_of(spark, BATCH):
        own = written(_signed(spread(texts), shingle).withColumn("row", F.monotonically_increasing_id()), "superminhash")
    classes = written(own.where("n > 0").groupBy("same").agg(F.min("row").alias("node"), F.min("id").alias("least")), "classes")
    reps = own.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    keyed = reps.select(F.col("row").alias("node"), "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    met = written(keyed.join(shared, "key", "left_semi"), "buckets")
    # A member of many buckets is near many others: it leads. Ties go by a hash, so that the same one leads in all buckets of a group.
    weights = met.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    members = written(met.join(weights, "node"), "members")
    discard(met)
    order = F.struct("weight", F.xxhash64("node").alias("tie"), "node", "n")
    leaders = cut(members.groupBy("key").agg(F.max(order).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n")))
    sizes = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent

    first = members.join(leaders, "key").where((F.col("node") != F.col("leader")) & sizes(F.col("n"), F.col("leader_n")))
    held = _held(texts, classes, members.select("node").distinct(), shingle)
    found = _compared(first.select(F.col("leader").alias("u"), F.col("node").alias("v"), F.col("leader_n").alias("n"), F.col("n").alias("m")), held)
    near = F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent
    label = components(found.where(near).select("u", "v"))

    # Buckets whose members are in several components still: what they hold is joined by prefixes.
    at = members.join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    parted = at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = written(at.join(parted, "key", "left_semi").select("node", "n", "label").distinct(), "parted")
    if not rest.isEmpty():
        more = _compared(_prefix_pairs(rest, held, percent), held)
        ends = more.where(near).join(label.select(F.col("node").alias("u"), F.col("label").alias("x")), "u", "left").join(label.select(F.col("node").alias("v"), F.col("label").alias("y")), "v", "left")
        over = components(ends.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")))
        grown = label.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("to", "label").alias("label"))
        label = cut(grown.unionByName(grown.select(F.col("label").alias("node"), "label")).distinct())
        discard(more)
    labelled = cut(classes.join(label, "node", "left").select("same", "least", F.coalesce("label", "node").alias("label")))
    low = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = cut(labelled.join(low, "label").select("same", "component_id"))
    discard(members, leaders, found, held, rest, classes)
    out = own.select("id", "same", "n").join(by_class, "same", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _held(texts: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): whole sets of the classes that share a bucket with another one, from the texts of their smallest ids, which are read once more."""
    involved = cut(classes.join(nodes, "node", "left_semi"))
    ids = involved.select(F.col("least").alias("wanted")).distinct()
    some = F.broadcast(ids) if involved.count() <= FEW else ids
    chosen = texts.join(some, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    with batches_of(texts.sparkSession, BATCH):
        return written(_sets(chosen, shingle).join(involved.select("same", "node"), "same").dropDuplicates(["node"]).select("node", "shingles"), "sets")


def _compared(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(u, v, n, m, both) of distinct pairs (u, v) with the sizes of their sets."""
    pairs = cut(pairs.distinct())
    joined = pairs.join(held.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    with batches_of(pairs.sparkSession, BATCH):
        out = written(joined.select("u", "v", "n", "m", "a", "b").mapInArrow(_common, "u long, v long, n long, m long, both long"), "compared")
    discard(pairs)
    return out


def shared_at_least(n: int, m: int, percent: int) -> int:
    """Elements that sets of n and m have in common at least, at that similarity."""
    return -(-percent * (n + m) // (100 + percent))


def size_edges(largest: int) -> np.ndarray:
    """The smallest sizes of the size classes, each about a twentieth above the one before."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return np.array(out)


def prefixes(n: int, percent: int, edges: np.ndarray) -> list[tuple[bool, int, int]]:
    """(longer, size class, length): how many of its first elements a set of n must show to partners of a class, as the shorter one of a pair in its own class, and as the longer one in all classes of shorter partners.

    Two sets with so much in common share one of these, in whatever order all sets are sorted.
    """
    least = -(-percent * n // 100)
    first, own = (int(np.searchsorted(edges, m, "right")) - 1 for m in (least, n))
    out = [(False, own, n - shared_at_least(n, n, percent) + 1)]
    return out + [(True, k, n - shared_at_least(n, max(least, int(edges[k])), percent) + 1) for k in range(first, own + 1)]


def _prefix_pairs(rest: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n, m) of nodes of different components that can be linked, by prefix and position.

    Elements are sorted by how many of these nodes have them, rarest first; one
    that no other has takes a place but meets nothing. What is special to a text
    comes first, so a text that has too much of that to be near any other meets
    none, however many share the rest with it. An element that a whole component
    has is looked at by the others alone.
    """
    sets = rest.join(held, "node").select("node", "shingles")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                some = whole.slice(k, 100)
                own = [np.frombuffer(raw.as_buffer(), np.int64) for raw in some.column(1)]
                sizes = np.array([len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], names=["node", "n", "element"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = size_edges(1 << 40)
        for whole in batches:
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(6)]
            for node, n, shared in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), whole.column(2), strict=True):
                order = shared.values.to_numpy()
                alone = n - len(order)
                for longer, k, length in prefixes(n, percent, edges):
                    met = max(0, min(length - alone, len(order)))
                    parts = (np.full(met, node), np.full(met, n), alone + np.arange(met), order[:met], np.full(met, int(longer)), np.full(met, k))
                    for c, x in zip(columns, parts, strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["node", "n", "at", "element", "longer", "class"])

    with batches_of(rest.sparkSession, BATCH):
        elements = sets.mapInArrow(apart, "node long, n long, element long")
        frequent = elements.groupBy("element").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
        sorted_ = elements.join(frequent, "element").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("f", "element")))["element"].alias("shared"))  # no more than the elements of a text
        shown = written(sorted_.mapInArrow(run, "node long, n long, at long, element long, longer long, class long"), "prefixes")
    weights = rest.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
    named = cut(rest.select("node", "label").join(weights, "label"))
    rows = shown.join(named, "node")
    keys = ["element", "class"]
    biggest = rows.groupBy(*keys).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("longer").alias("any_longer"), F.min("longer").alias("any"), F.max(F.struct("weight", "label"))["label"].alias("main")).where("low <> high AND any_longer = 1 AND any = 0").select(*keys, "main")
    rows = written(rows.join(biggest, keys).withColumn("aside", F.col("label") != F.col("main")).select("node", "n", "at", "label", *keys, "longer", "aside"), "prefix-members")
    discard(shown)
    n, m = F.col("x.n"), F.col("y.n")
    ordered = (n < m) | ((n == m) & (F.col("x.node") < F.col("y.node")))
    left = F.least(n - F.col("x.at"), m - F.col("y.at")) * (100 + percent) >= (n + m) * percent
    on = (F.col("x.element") == F.col("y.element")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.label") != F.col("y.label")) & ordered & left
    pick = [F.col("x.node").alias("u"), F.col("y.node").alias("v"), n.alias("n"), m.alias("m")]
    met = lambda a, b: rows.where(f"longer = 0 AND {a}").alias("x").join(rows.where(f"longer = 1 AND {b}").alias("y"), on).select(*pick)
    return met("aside", "true").unionByName(met("NOT aside", "aside"))
