"""Distinct values by mergeable sketches, exact only where a threshold is near.

All columns of a table are sketched in one aggregation: a state of fixed size
for each column, no row is copied for every column. Sketches of parts of a table
merge into that of the whole. A question such as "are more than 98 % of the
values distinct?" is answered by the sketch unless its estimate is within
``MARGIN`` of the threshold; only such columns are counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a sketch: binary logarithm of its registers (16 KB a column), and the relative distance to a threshold within which it decides nothing, six standard errors.
REGISTERS, MARGIN = 14, 0.05


def sketch(c: Column) -> Column:
    """A sketch of a column's distinct values; null is none of them. Any type with a hash."""
    return F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(REGISTERS))


def column_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, filled, sketch) of each column, in one aggregation. An empty table has empty sketches."""
    names = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"f{i}"), sketch(F.col(f"`{c}`")).alias(f"s{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"f{i}").alias("filled"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(names)])))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of parts of a table (days, sources) as those of the whole; a column that a part lacks counts the parts that have it."""
    return sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """Sketches with their estimates as ``distinct``, in place of the states."""
    return sketches.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def near(estimate: int, threshold: float, margin: float = MARGIN) -> bool:
    """Whether the true number may be on the other side of a threshold."""
    return estimate * (1 - margin) <= threshold <= estimate * (1 + margin)


def exact_where(df: DataFrame, estimates: Mapping[str, int], thresholds: Mapping[str, Sequence[float]]) -> dict[str, int]:
    """The estimates, with exact numbers for columns near one of their thresholds. No job if there are none."""
    doubtful = [c for c, at in thresholds.items() if any(near(estimates[c], t) for t in at)]
    if not doubtful:
        return dict(estimates)
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in doubtful]).first()
    return {**estimates, **dict(zip(doubtful, exact, strict=True))}
