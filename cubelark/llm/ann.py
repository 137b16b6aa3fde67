"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt to shards of a bounded size by a hash of the identifier. A shard
collapses equal vectors, draws the levels of its nodes and inserts them level by
level, from the highest: a new node descends the levels above, a beam over the
graph as it stands finds what is near it, and it is linked to diverse ones of
those (one is kept if it is nearer to the node than to any kept before), both
ways; a node with too many links keeps diverse ones. Nodes are inserted a batch
at a time, and those of a batch see each other as well. Parts that the entry
point doesn't reach are tied in. The graph is stored as flat arrays of
neighbours with offsets, one table row a shard.

Each graph goes to one task, once; the queries go by it in blocks, descend its
levels and widen into a beam on the lowest one. Spark merges the shards' results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubelark.llm.common import partitions, spread, written

#: Rows of a shard and of a block of queries, about; links of a node (twice on the lowest level); near nodes that links are chosen from; width of the beam.
SHARD_ROWS, BLOCK_ROWS, LINKS, NEAR, BEAM = 8192, 512, 16, 64, 128
#: Candidates that a step of the beam expands; nodes that a shard starts from, and that are inserted together later.
STEP, SEED, BATCH = 4, 64, 256
#: Components beyond this are searched for as this.
LARGEST = 1e17


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def singles(x: np.ndarray) -> np.ndarray:
    """For the search: singles, within a range whose squares are finite too; scores come from the original vectors."""
    return np.clip(x, -LARGEST, LARGEST).astype(np.float32)


def beam(x: np.ndarray, q: np.ndarray, entry: np.ndarray, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the ``width`` nearest found for each row of ``q``, nearest first; node n, the number of nodes, where fewer."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    node = np.full((m, width), n, np.int32)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    node[:, 0], dist[:, 0], done[:, 0] = entry, ((x[entry] - q) ** 2).sum(1), False
    seen[np.arange(m), entry] = True
    step = min(STEP, width)
    while True:
        live = np.flatnonzero((~done).any(axis=1))
        if not len(live):
            return node, dist
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), open_.shape)
        chosen = np.where(np.take_along_axis(open_, pick, 1) < np.inf, np.take_along_axis(node[live], pick, 1), n)
        np.put_along_axis(mark := done[live], pick, True, 1)
        done[live] = mark
        near = table[chosen].reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], n, near)
        near.sort(axis=1)  # equal ones side by side
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near.sort(axis=1)
        near = near[:, : max(1, int((near < n).sum(axis=1).max()))]
        seen[live[:, None], near] = True
        d = ((x[np.minimum(near, n - 1)] - q[live][:, None, :]) ** 2).sum(2)
        d[near == n] = np.inf
        all_node, all_dist = np.concatenate((node[live], near), 1), np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], near == n), 1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        node[live], dist[live], done[live] = (np.take_along_axis(a, keep, 1) for a in (all_node, all_dist, all_done))


def diverse(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each node of ``own``, at most ``most`` of its candidates ``near`` (padded with n): by distance, each nearer to the node than to any kept before. Padded with n."""
    n = len(x)
    pad = near >= n
    at = x[np.minimum(near, n - 1)]
    to = ((at - x[own][:, None, :]) ** 2).sum(2)
    to[pad] = np.inf
    order = np.argsort(to, axis=1, kind="stable")
    near, to, at = np.take_along_axis(near, order, 1), np.take_along_axis(to, order, 1), np.take_along_axis(at, order[:, :, None], 1)
    norm = (at * at).sum(2)
    between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (at @ at.transpose(0, 2, 1)), 0)
    closest = np.full(to.shape, np.inf, to.dtype)
    kept, taken = np.full((len(own), most), n, np.int32), np.zeros(len(own), np.int64)
    for j in range(to.shape[1]):
        take = np.flatnonzero((to[:, j] < closest[:, j]) & (taken < most))
        kept[take, taken[take]] = near[take, j]
        taken[take] += 1
        closest[take] = np.minimum(closest[take], between[take, j])
    return kept


def level_table(x: np.ndarray, members: np.ndarray, links: int, above: list[np.ndarray]) -> np.ndarray:
    """Neighbours of the nodes of a level, a row for each node, padded with n; ``members`` in the order of insertion, those of the levels above (their tables, the highest first) ahead."""
    n, cap = len(x), 2 * links
    table = np.full((n + 1, cap), n, np.int32)
    size = np.zeros(n + 1, np.int64)
    done = 0
    while done < len(members):
        new = members[done : done + (SEED if done == 0 else min(BATCH, done))]
        apart = _squares(x[new], x[new])
        apart[np.arange(len(new)), np.arange(len(new))] = np.inf
        mates = np.where(np.take_along_axis(apart, order := np.argsort(apart, axis=1, kind="stable")[:, :NEAR], 1) < np.inf, new[order], n)
        if done:
            entry = np.full(len(new), members[0], np.int32)
            for t in above:
                entry = beam(x, x[new], entry, t, 4)[0][:, 0]
            near = np.concatenate((beam(x, x[new], entry, table, NEAR)[0], mates), axis=1)
        else:
            near = mates
        kept = diverse(x, new, near.astype(np.int32), links)
        table[new, :links], size[new] = kept, (kept < n).sum(axis=1)
        back: dict[int, list[int]] = {}
        for i, own in zip(new.tolist(), kept.tolist(), strict=True):
            for j in own:
                if j < n:
                    back.setdefault(j, []).append(i)
        full: dict[int, list[int]] = {}
        for j, sources in back.items():
            have = table[j, : size[j]].tolist()
            fresh = [i for i in sources if i not in have]
            if len(have) + len(fresh) <= cap:
                table[j, len(have) : len(have) + len(fresh)], size[j] = fresh, len(have) + len(fresh)
            else:
                full[j] = have + fresh
        if full:  # too many links: diverse ones stay
            wide = np.full((len(full), max(map(len, full.values()))), n, np.int32)
            for k, c in enumerate(full.values()):
                wide[k, : len(c)] = c
            own = np.fromiter(full, np.int64, len(full))
            table[own] = diverse(x, own, wide, cap)
            size[own] = (table[own] < n).sum(axis=1)
        done += len(new)
    return _tied(x, members, table)


def _tied(x: np.ndarray, members: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table with parts that the first member doesn't reach tied to what is nearest among those reached."""
    n = len(x)
    if not len(members):
        return table
    reached = np.zeros(n + 1, bool)
    reached[n] = True
    front = members[:1]
    reached[front] = True
    while True:
        while len(front):
            front = np.unique(table[front])
            front = front[~reached[front]]
            reached[front] = True
        rest = members[~reached[members]]
        if not len(rest):
            return table
        new, old = rest[0], members[reached[members]]
        near = old[((x[old] - x[new]) ** 2).sum(1).argmin()]
        for a, b in ((near, new), (new, near)):
            free = np.flatnonzero(table[a] == n)
            if not len(free):
                table = np.concatenate((table, np.full((n + 1, 1), n, np.int32)), axis=1)
                free = np.array([table.shape[1] - 1])
            table[a, free[0]] = b
        reached[new] = True
        front = np.array([new])


def build(vectors: np.ndarray, ids: np.ndarray) -> dict[str, bytes]:
    """The flat arrays of a shard's graph."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
    as_key = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, node = np.unique(as_key, return_index=True, return_inverse=True)
    nodes = singles(vectors[first])
    by_node = np.argsort(node, kind="stable")  # ids ascend inside a node
    id_offsets = np.concatenate(([0], np.bincount(node, minlength=len(first)).cumsum()))
    draw = np.random.default_rng(len(first)).random(len(first))
    levels = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int), 8)
    levels[0] = levels.max() if len(levels) else 0
    order = np.argsort(-levels, kind="stable")  # the higher ones first, node 0 ahead of all
    order = np.concatenate(([0], order[order != 0])) if len(order) else order
    tables: list[np.ndarray] = []
    for level in range(int(levels.max()), -1, -1):
        tables.append(level_table(nodes, order[levels[order] >= level], LINKS, tables))
    offsets, flat, starts = [], [], [0]
    for table in reversed(tables):
        there = table[:-1] < len(nodes)
        offsets.append(np.concatenate(([0], there.sum(axis=1).cumsum())))
        flat.append(table[:-1][there])
        starts.append(starts[-1] + len(flat[-1]))
    return {"nodes": vectors[first].tobytes(), "ids": ids[by_node].astype("<i8").tobytes(), "id_offsets": id_offsets.astype("<i8").tobytes(), "neighbours": np.concatenate(flat).astype("<i4").tobytes(), "offsets": np.concatenate(offsets).astype("<i8").tobytes(), "starts": np.array(starts, "<i8").tobytes()}


class Graph:
    def __init__(self, row: dict, dim: int, kind: str):
        self.exact = np.frombuffer(row["nodes"], kind).reshape(-1, dim)
        self.x = singles(self.exact)
        self.ids, self.id_offsets = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_offsets"], "<i8")
        n = len(self.x)
        starts, offsets, flat = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["offsets"], "<i8").reshape(-1, n + 1), np.frombuffer(row["neighbours"], "<i4")
        self.tables = []
        for level, own in enumerate(offsets):  # rows of equal width for gathers, padded with the node n
            sizes = np.diff(own)
            table = np.full((n + 1, max(1, int(sizes.max()))), n, np.int32)
            table[:n][np.arange(table.shape[1]) < sizes[:, None]] = flat[starts[level] : starts[level + 1]]
            self.tables.append(table)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, width: int) -> list[tuple[int, int, float]]:
        """(query id, id, distance) of the k nearest of each query, without its own id."""
        q32 = singles(q)
        entry = np.zeros(len(q), np.int32)  # node 0 is on every level
        for table in self.tables[:0:-1]:
            entry = beam(self.x, q32, entry, table, 4)[0][:, 0]
        nodes, _ = beam(self.x, q32, entry, self.tables[0], max(width, 2 * k))
        out = []
        for vector, me, found in zip(q.astype(np.float64), own.tolist(), nodes, strict=True):
            found = found[found < len(self.x)]
            apart = self.exact[found].astype(np.float64) - vector
            with np.errstate(over="ignore"):
                d = np.sqrt((apart**2).sum(1))
            if np.isinf(d).any():  # squares beyond the doubles
                largest = np.abs(apart).max(axis=1)
                d = np.where(np.isinf(d), largest * np.sqrt(((apart / np.maximum(largest, 1e-300)[:, None]) ** 2).sum(1)), d)
            best: list[tuple[float, int]] = []
            for i in np.argsort(d, kind="stable"):
                if len(best) >= k and d[i] > sorted(best)[k - 1][0]:
                    break
                a, b = self.id_offsets[found[i]], self.id_offsets[found[i] + 1]
                best += [(float(d[i]), x) for x in self.ids[a : min(b, a + k + 1)].tolist() if x != me]
            out += [(me, x, s) for s, x in sorted(best)[:k]]
        return out


def usable(vector):
    """Neither null, nor empty or zero, nor with a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row for which the Column ``is_query`` holds, among all other rows.

    Euclidean distance in double precision, ties to the smaller id; of several
    query rows of one id the one with the smallest vector is asked. Rows with a
    null id and unusable vectors take no part, neither do candidates of another
    dimension than the query's; rows that repeat an id are candidates each, but
    never of that id. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    kind = "<f8" if vectors.schema[vector_col].dataType.elementType.simpleString() == "double" else "<f4"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    n, n_queries = vectors.count(), vectors.where(is_query).count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // BLOCK_ROWS))
    packed = "dim int, shard int, nodes binary, ids binary, id_offsets binary, neighbours binary, offsets binary, starts binary"

    def make(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        flat = build(np.array(p["v"].tolist(), kind), p["id"].to_numpy(np.int64))
        return pd.DataFrame([{"dim": key[0], "shard": key[1], **flat}])

    spread(rows)  # ships the package
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = written(dealt.select("dim", "shard", "id", "v").repartition(max(shards, 1), "dim", "shard").groupBy("dim", "shard").applyInPandas(make, packed), "graphs")

    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # a block is of a bounded size
    graphs = index.withColumns({"block": F.lit(-1), "queries": F.lit(None).cast(asked.schema["queries"].dataType)})
    stream = graphs.unionByName(asked, allowMissingColumns=True).repartition(max(shards, partitions(spark)), "dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each shard the graph comes first, then the blocks of queries."""
        at, graph = None, None
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if r["block"] < 0:
                    at, graph = (r["dim"], r["shard"]), Graph(r, r["dim"], kind)
                elif at == (r["dim"], r["shard"]):  # else no candidate of that dimension is in the shard
                    q = np.array([x["v"] for x in r["queries"]], kind)
                    found = graph.search(q, np.array([x["id"] for x in r["queries"]], np.int64), k_nearest, beam_width)
                    ids, near, scores = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    k_nearest, beam_width = k, beam
    found = stream.mapInArrow(search, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
