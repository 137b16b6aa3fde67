"""Mergeable states of a cube: counts by value instead of finished statistics.

A state says how many records of a segment have a value of a measure, or come
from an employer. States of different periods merge by adding up counts, so a
table that holds them by period gives the exact cube of all periods, or of any
coarser keys, medians and largest employers included, and never reads a record
again. States are plain rows: a segment with very many records has many rows,
not a large one. Almost every record has values of its own, so states are wider
than their records: records are dealt by their segment and period once, as they
are, and become states where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.functions.exact import EXACT, rounded
from cubelark.operators.cube import prepared, require

PERIOD = "state_period"
SALARIES = ("salary_mid", "salary_from", "salary_to")
#: Counts beside the number of records; they are held by the rows of employers, of which each record has one.
FLAGS = {"remote": "is_remote", "full_time": "is_full_time", "shift": "is_shift"}
SUMS = ("n", *FLAGS, "clean")


def cube_states(rows: DataFrame, keys: Sequence[str], period: Column | None = None) -> DataFrame:
    """States by keys and, if given, the period as a string: (keys, measure, number, text, n, remote, full_time, shift, clean).

    One scan and one exchange, of records: those of a segment and period meet in one task, which spills what it cannot hold. Records without an employer
    have the employer null; null salaries have no state. Null keys and periods
    are values of their own; no records, no states. Keys must not be named like
    the columns of a state; other columns may.
    """
    if clash := {"measure", "number", "text", PERIOD, *SUMS}.intersection(keys):
        raise ValueError(f"names of states: {', '.join(sorted(clash))}")
    base = prepared(rows, keys, **({PERIOD: period.cast("string")} if period is not None else {}))
    own = [*keys, *([PERIOD] if period is not None else [])]
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    flags = [yes(F.col(c)).alias(f) for f, c in FLAGS.items()] + [yes(F.coalesce(F.col("quality_flag_count"), F.lit(0)) == 0).alias("clean")]
    base = base.repartition(*own) if own else base
    none = [F.lit(0).cast("bigint").alias(c) for c in SUMS[1:]]
    employer = F.struct(F.lit("employer").alias("measure"), F.lit(None).cast("double").alias("number"), F.col("_employer").alias("text"), *flags)
    salaries = [F.struct(F.lit(c).alias("measure"), F.col(c).alias("number"), F.lit(None).cast("string").alias("text"), *none) for c in SALARIES]
    long = base.select(*own, F.inline(F.array(employer, *salaries))).where("measure = 'employer' OR number IS NOT NULL")
    return long.groupBy(*own, "measure", "number", "text").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS[1:]])


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of all periods, and of keys that are not among ``keys``, as one; states again."""
    require(states, keys)
    return states.groupBy(*keys, "measure", "number", "text").agg(*[F.sum(c).alias(c) for c in SUMS])


def cube_of(states: DataFrame, keys: Sequence[str], merged: bool = False) -> DataFrame:
    """The cube that ``monthly_cube`` gives of the records behind the states; ``merged`` if no segment has a value twice."""
    dealt = states.repartition(*keys) if keys else states  # once: the states merge and make the cube where they lie
    found = dealt if merged else merge_states(dealt, keys)
    n, number, of = F.col("n"), F.col("number"), lambda m: F.col("measure") == m
    known = of("employer") & F.col("text").isNotNull()
    salary = lambda m, at: F.percentile(F.when(of(m), number), F.array(*[F.lit(q) for q in at]), n)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("bigint")
    one = found.groupBy(*keys).agg(
        total(n, of("employer")).alias("vacancy_count"), total(n, of("salary_mid")).alias("salary_count"), F.count(F.when(known, 1)).alias("employer_count"),
        salary("salary_mid", (0.25, 0.5, 0.75)).alias("_mid"), salary("salary_from", (0.5,)).alias("_from"), salary("salary_to", (0.5,)).alias("_to"),
        F.sum(F.when(of("salary_mid"), number.cast(EXACT) * n)).cast("double").alias("_sum"), F.coalesce(F.max(F.when(known, n)), F.lit(0)).alias("_top"),
        *[F.sum(c).alias(f"_{c}") for c in SUMS[1:]],
    )
    part = lambda c: F.col(c).cast("double") / F.col("vacancy_count").cast("double")
    at = lambda c, i: rounded(F.get(c, F.lit(i)), 6)
    return one.select(
        *keys, "vacancy_count", "salary_count", "employer_count",
        at("_mid", 0).alias("p25_salary_mid"), at("_mid", 1).alias("median_salary_mid"), at("_mid", 2).alias("p75_salary_mid"), (F.col("_sum") / F.nullif(F.col("salary_count").cast("double"), F.lit(0.0))).alias("mean_salary_mid"),
        at("_from", 0).alias("median_salary_from"), at("_to", 0).alias("median_salary_to"),
        *[part(f"_{c}").alias(f"{c}_share") for c in FLAGS], part("_clean").alias("data_quality_score"), (1 - part("salary_count")).alias("salary_missing_rate"), part("_top").alias("top_employer_share"),
    )


def store_states(rows: DataFrame, keys: Sequence[str], period: Column, path: str) -> None:
    """Adds the periods of the rows to a table of states. Periods that the table has are replaced, the others left as they are.

    So a period is loaded with all its records, a load that runs again counts
    once, and late records are taken in by loading their period anew. A period's
    files follow its size.
    """
    states = cube_states(rows, keys, period)
    states.hint("rebalance", PERIOD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)


def stored_states(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The table of states; conditions on ``PERIOD`` choose folders. ``like``: states whose columns the table has, which saves the look at its files."""
    if like is None:
        return spark.read.parquet(path).withColumn(PERIOD, F.col(PERIOD).cast("string"))
    return spark.read.schema(like.schema).parquet(path)
