"""Ordered target statistics: categories of any number of values as numbers, without a look ahead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.functions.exact import rounded
from cubelark.operators.cube import null_safe_join


def ordered_target(df: DataFrame, categories: Mapping[str, Sequence[str]], target: str, order: str, known: Column | None = None, weight: float = 1.0, digits: int = 6) -> DataFrame:
    """Add a column for each of ``categories`` (name: key columns): the mean target of the category's rows that are known by then, drawn towards the mean of all rows known by then.

    A row's target is known from the period ``known`` on, by default the period
    after its own; a row at period t sees targets known at t or before. The
    encoding is ``(sum + weight * mean) / (count + weight)``, null while nothing
    at all is known. Null keys are a category. Targets are summed as decimals of
    six digits, so the result does not depend on the order of rows.

    Sums are taken by category and period before anything is sorted, and running
    totals over those: a category costs a row for each period, whatever its size.
    """
    when = (F.col(order) + 1 if known is None else known).cast("long")
    names = list(dict.fromkeys(k for keys in categories.values() for k in keys))
    # A row tells its target at one period and asks at another; both, for all key sets, are summed in one scan.
    told = F.struct(when.alias("at"), F.when(when.isNotNull(), F.col(target).cast("decimal(28,6)")).alias("s"))
    asked = F.struct(F.col(order).cast("long").alias("at"), F.lit(None).cast("decimal(28,6)").alias("s"))
    each = df.select(*names, F.explode(F.array(told, asked)).alias("_t")).select(*names, F.col("_t.at").alias("_at"), F.col("_t.s").alias("_s")).where("_at IS NOT NULL")
    label = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in names]) if names else F.lit("")
    sets = [list(k) for k in dict.fromkeys([(), *[tuple(k for k in names if k in keys) for keys in categories.values()]])]
    by = each.groupingSets([[*[F.col(k) for k in keys], F.col("_at")] for keys in sets], *[F.col(k) for k in names], F.col("_at"))
    sums = by.agg(label.alias("_set"), F.sum("_s").cast("decimal(38,6)").alias("_s"), F.count("_s").alias("_n"))
    out = df

    def running(keys: Sequence[str], prefix: str) -> DataFrame:
        own = sums.where(F.col("_set") == "+".join(k for k in names if k in keys))
        so_far = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        return own.select(*keys, "_at", F.coalesce(F.sum("_s").over(so_far), F.lit(0)).cast("double").alias(f"{prefix}_s"), F.sum("_n").over(so_far).alias(f"{prefix}_n"))

    everything = running([], "_all")  # a row for each period
    out = out.join(F.broadcast(everything), F.col(order).cast("long") == F.col("_at"), "left").drop("_at")
    prior = F.try_divide(F.col("_all_s"), F.col("_all_n").cast("double"))
    for name, keys in categories.items():
        own = running(keys, "_own").withColumnRenamed("_at", order).withColumn(order, F.col(order).cast(df.schema[order].dataType))
        out = null_safe_join(out, own, [*keys, order], "left")
        value = F.try_divide(F.coalesce(F.col("_own_s"), F.lit(0.0)) + weight * prior, F.coalesce(F.col("_own_n"), F.lit(0)).cast("double") + weight)
        out = out.withColumn(name, rounded(value, digits)).drop("_own_s", "_own_n")
    return out.drop("_all_s", "_all_n")
