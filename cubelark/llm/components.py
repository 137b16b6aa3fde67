"""Connected components by contraction.

Every round each node takes the first node of its closed neighbourhood in a
random order that changes from round to round; edges are mapped to those nodes,
loops and repeats are dropped. The graph shrinks by a constant factor a round
on average, whatever its shape. Nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two columns of long; the result (node, label) has each node of an edge between different nodes, with one node of its component as label.

    Joins are on written tables, so that Spark can split the shuffle partitions
    of nodes with very many edges.
    """
    a, b = edges.columns
    left = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        order = lambda c, t=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("n"))
        hooks = cut(both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.least(order("u"), F.col("m"))["n"].alias("to")))
        mapped = left.join(hooks.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(hooks.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        smaller = cut(mapped.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        discard(left)
        left = smaller
        maps.append(hooks)
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = maps[0].withColumnRenamed("to", "label")
    for hooks in maps[1:]:  # each is smaller than the one before by a constant factor on average
        labels = labels.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = cut(labels)
    discard(left, *maps)
    return labels
