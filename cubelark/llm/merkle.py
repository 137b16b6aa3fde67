"""Merkle manifest of a dataset, with proofs by octopus multiproofs.

Every row is a leaf; the leaves of a source, by identifier, form a tree of runs
of ``ARITY`` nodes, and the subroots of the sources form one more above them.

Proofs are not looked up one by one. The leaves are dealt out in contiguous
partitions of at most ``BLOCK``. Such a partition works out which nodes all its
proofs need that it can't derive from its own leaves: on each level the
children of the runs it touches, less those it knows (the minimal union).
These are fetched once by a join with the nodes of the trees; then it derives
the interiors that its proofs share and expands the single proofs locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import cut, discard, partitions, spread, written

#: Nodes of a run; leaves of a partition that are proved together, at most.
ARITY, BLOCK = 16, 4096
#: The tree over the sources; others are named by the place of their first leaf among all.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_of(*values: Column) -> Column:
    """Digest of the values: each ``-`` if null, else the UTF-8 byte count, a colon and the value, integers as decimals."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with ``rank``, their place from 0 in the order, and ``part``, the range they came to, as a written table.

    Ranges are cut at sampled splitters, ranked each for itself and moved by the
    counts before them; those are one number for a range, which the driver adds
    up. The last key parts equal rows, so that no range is bound to hold all of them.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, "tie")
    placed = written(placed.drop("tie").withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    before, start = 0, []
    for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row for a range
        start.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(start, "part int, start long"))
    ranked = placed.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    out = written(ranked.join(starts, "part").select(*rows.columns, "part", (F.col("start") + F.col("within") - 1).alias("rank")), name)
    discard(placed)
    return out


def nodes_of(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of each level, (tree, at, n, hash): ``leaves`` are level 0, ``n`` is the number of nodes that the tree has there. Trees of one node go no further."""
    levels = [leaves.select("tree", "at", "n", "hash")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        inner = levels[-1].where("n > 1").withColumnsRenamed({"at": "child", "n": "children"})
        runs = inner.groupBy("tree", F.expr(f"child div {ARITY}").alias("at"), F.expr(f"(children + {ARITY - 1}) div {ARITY}").alias("n"))
        in_order = F.array_sort(F.collect_list(F.struct("child", "hash")))  # of ARITY nodes at most
        levels.append(cut(runs.agg(F.sha2(F.array_join(F.transform(in_order, lambda x: x["hash"]), ""), 256).alias("hash"))))
        most = -(-most // ARITY)
    return levels


def missing(known: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level of a tree of n leaves the places of the nodes that proofs of the ``known`` leaves need and that can't be derived from them."""
    out = []
    while n > 1:
        runs = np.unique(known // ARITY)
        children = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(children[children < n], known))
        known, n = runs, -(-n // ARITY)
    return out


class Paths:
    """The part of a tree that a partition knows: its leaves, the fetched nodes and what follows from them."""

    def __init__(self, at: np.ndarray, hashes: Sequence[str], n: int, fetched: dict[tuple[int, int], str]):
        self.sizes, self.levels = [n], [dict(zip(at.tolist(), hashes, strict=True))]
        for k, places in enumerate(missing(at, n)):
            known = self.levels[k]
            known.update((p, fetched[k, p]) for p in places.tolist())
            runs: dict[int, list[str]] = {}
            for p in sorted(known):
                runs.setdefault(p // ARITY, []).append(known[p])
            self.levels.append({r: digest("".join(c)) for r, c in runs.items()})
            self.sizes.append(-(-self.sizes[-1] // ARITY))
        self.root = next(iter(self.levels[-1].values()))
        self.above: dict[tuple[int, int], list[str]] = {}

    def proof(self, at: int, level: int = 0) -> list[str]:
        """For each level the digests of the run's other nodes, joined from left to right. What lies above a node is put together once."""
        if level == len(self.sizes) - 1:
            return []
        if (level, at) not in self.above:
            known, first = self.levels[level], at - at % ARITY
            others = "".join(known[p] for p in range(first, min(first + ARITY, self.sizes[level])) if p != at)
            rest = self.proof(at // ARITY, level + 1)
            if level == 0:
                return [others, *rest]
            self.above[level, at] = [others, *rest]
        return self.above[level, at]


def fold(leaf: str, at: int, proof: Sequence[str]) -> str:
    """The root that a leaf and its proof lead to; ``at`` is its place."""
    for others in proof:
        k = 64 * (at % ARITY)
        leaf, at = digest(others[:k] + leaf + others[k:]), at // ARITY
    return leaf


@dataclass
class Manifest:
    """``leaves``: id, source, tree, place, n (leaves of the tree), source_place, sources (their number), block, leaf, checked. ``nodes``: tree, level, at, hash. ``subroots``: source, tree, n, subroot, source_place. ``root``: None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, checked: dict[str, Column] | None = None) -> Manifest:
    """The trees over the rows of ``docs``; ``columns`` are id, source and further values of the leaf, in order.

    ``checked`` replaces columns in the digest ``checked`` that proofs are to be
    held against (a copy whose integrity is in question); without it that is
    the leaf. Null values have a digest of their own, a null source is a source,
    the first one, and null ids come first. Rows that share source and id are
    in the order of their digests; repeated rows are leaves of their own.
    Other columns are ignored; an empty table has no leaves and no root.
    """
    spark = docs.sparkSession
    ident, source = columns[:2]
    value = lambda c: (checked or {}).get(c, F.col(f"`{c}`"))
    rows = spread(docs.select(*[F.col(f"`{c}`") for c in columns]))
    own = F.when(F.col(f"`{source}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")))  # never null, nulls first
    hashed = written(rows.select(F.col(f"`{ident}`").alias("id"), own.alias("src"), leaf_of(*[F.col(f"`{c}`") for c in columns]).alias("leaf"), leaf_of(*map(value, columns)).alias("checked")), "leaves")
    ranked = numbered(hashed, [F.col("src"), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("checked")], "ranked")
    discard(hashed)
    # Per source and range, so that a source of very many rows meets its tree in many places.
    pieces = ranked.groupBy("src", "part").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("rows"))
    trees = cut(pieces.groupBy("src").agg(F.min("low").alias("tree"), F.sum("rows").alias("n")))
    sources = numbered(trees, [F.col("src")], "sources")
    count = sources.count()
    named = sources.select("src", "tree", "n", F.col("rank").alias("source_place"))
    at_parts = cut(pieces.select("src", "part").join(named, "src"))
    placed = ranked.join(at_parts, ["src", "part"]).select("id", "src", "tree", (F.col("rank") - F.col("tree")).alias("place"), "n", "source_place", F.lit(count).cast("long").alias("sources"), F.expr(f"rank div {BLOCK}").alias("block"), "leaf", "checked")
    leaves = written(placed, "placed")
    discard(ranked, trees, at_parts)

    below = nodes_of(leaves.select("tree", F.col("place").alias("at"), "n", F.col("leaf").alias("hash")))
    tops = below[0].where("n = 1")
    for level in below[1:]:
        tops = tops.unionByName(level.where("n = 1"))
    subroots = cut(named.join(tops.select("tree", F.col("hash").alias("subroot")), "tree"))
    above = nodes_of(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("source_place").alias("at"), F.lit(count).cast("long").alias("n"), F.col("subroot").alias("hash")))
    root = above[-1].where("n = 1").select("hash").first()
    nodes = None
    for k, level in [*enumerate(below), *enumerate(above)]:
        one = level.where("n > 1").select("tree", F.lit(k).alias("level"), "at", "hash")
        nodes = one if nodes is None else nodes.unionByName(one)
    shown = lambda t: t.withColumn("source", F.when(F.col("src") == "", F.lit(None)).otherwise(F.expr("substring(src, 2)"))).drop("src")
    discard(sources)
    return Manifest(shown(leaves), nodes, shown(subroots), root[0] if root else None)


def proofs(made: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """(id, source, leaf, subroot, root, place, proof, source_place, source_proof, folded_root): a proof for each leaf, or for the ``leaves`` chosen from ``made.leaves``.

    A proof has one string for each level: the digests of the run's other nodes
    from left to right. ``folded_root`` is where ``checked`` and the proofs lead.
    """
    chosen = made.leaves if leaves is None else leaves
    kind = chosen.schema["id"].dataType.simpleString()

    def needs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(tree, k, p) for tree, some in rows.groupby("tree") for k, places in enumerate(missing(np.unique(some["place"].to_numpy()), int(some["n"].iloc[0]))) for p in places.tolist()]
        out += [(TOP, k, p) for k, places in enumerate(missing(np.unique(rows["source_place"].to_numpy()), int(rows["sources"].iloc[0]))) for p in places.tolist()]
        return pd.DataFrame({"block": np.full(len(out), key[0], np.int64), "tree": [o[0] for o in out], "level": [o[1] for o in out], "at": [o[2] for o in out]})

    wanted = chosen.select("block", "tree", "place", "n", "source_place", "sources").groupBy("block").applyInPandas(needs, "block long, tree long, level int, at long")
    fetched = wanted.join(made.nodes, ["tree", "level", "at"]).select("block", "tree", "level", "at", "hash")

    def expand(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=names)
        by_tree: dict[int, dict[tuple[int, int], str]] = {}
        for tree, k, p, h in zip(nodes["tree"].tolist(), nodes["level"].tolist(), nodes["at"].tolist(), nodes["hash"], strict=True):
            by_tree.setdefault(tree, {})[k, p] = h
        paths = {}
        for tree, some in rows.groupby("tree"):
            paths[tree] = Paths(some["place"].to_numpy(), some["leaf"].tolist(), int(some["n"].iloc[0]), by_tree.get(tree, {}))
        heads = rows.drop_duplicates("tree")
        top = Paths(heads["source_place"].to_numpy(), [paths[t].root for t in heads["tree"]], int(rows["sources"].iloc[0]), by_tree.get(TOP, {}))
        out = []
        for i, source, tree, place, source_place, leaf, checked in zip(*[rows[c].astype(object) for c in ("id", "source", "tree", "place", "source_place", "leaf", "checked")], strict=True):
            proof, higher = paths[tree].proof(place), top.proof(source_place)
            out.append((i, source, leaf, paths[tree].root, top.root, place, proof, source_place, higher, fold(fold(checked, place, proof), source_place, higher)))
        return pd.DataFrame(out, columns=names, dtype=object)

    schema = f"id {kind}, source string, leaf string, subroot string, root string, place long, proof array<string>, source_place long, source_proof array<string>, folded_root string"
    names = [part.split()[0] for part in schema.split(", ")]
    return chosen.groupBy("block").cogroup(fetched.groupBy("block")).applyInPandas(expand, schema)
