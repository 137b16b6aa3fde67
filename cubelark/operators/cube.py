"""Segment cubes, shares and re-aggregation. Null is a group of its own, and is one in the joins as well."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.functions.exact import exact_mean, quantile, quantiles, rounded, share, weighted_mean

MONTHLY_KEYS = ("source_dataset", "vacancy_month", "country", "region", "federal_district", "occupation_group", "occupation_code", "experience_group", "employment_type", "schedule_type")
SALARY_MEASURES = ("median_salary_mid", "mean_salary_mid", "p25_salary_mid", "p75_salary_mid", "median_salary_from", "median_salary_to")
VACANCY_MEASURES = ("salary_missing_rate", "remote_share", "full_time_share", "shift_share", "top_employer_share", "data_quality_score")


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are missing are added as null of the given type."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def prepared(rows: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """The columns that a cube needs, with the employer as ``_employer``; missing optional ones are null."""
    require(rows, keys)
    rows = with_optional(rows, {"salary_from": "double", "salary_to": "double", "salary_mid": "double", "is_remote": "boolean", "is_shift": "boolean", "is_full_time": "boolean", "quality_flag_count": "int", "employer_id": "string", "employer_name": "string"})
    employer = F.coalesce(F.col("employer_id").cast("string"), F.col("employer_name").cast("string"))
    return rows.select(*keys, *[c.alias(n) for n, c in more.items()], employer.alias("_employer"), *[F.col(c).cast("double").alias(c) for c in ("salary_from", "salary_to", "salary_mid")], "is_remote", "is_shift", "is_full_time", "quality_flag_count")


def monthly_cube(rows: DataFrame, keys: Sequence[str] = MONTHLY_KEYS) -> DataFrame:
    """AGG-01 to AGG-03: counts, salary statistics, shares, distinct employers and the share of the largest one.

    Records are dealt by their keys once, as they are: states of exact quantiles
    are larger than the records that they stand for, and so are not made before.
    There the records of an employer are numbered, which counts the employers
    and the largest one's records in the same aggregation. ``employer_id`` is
    taken before the name. Missing optional columns count as null.
    """
    base = prepared(rows, keys).repartition(*keys)
    numbered = base.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_employer").orderBy("_employer")))  # any order: only whether it is the first, and the last number, count
    known = F.col("_employer").isNotNull()
    total = F.col("vacancy_count").cast("double")
    out = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vacancy_count"),
        F.count("salary_mid").alias("salary_count"),
        *[c.alias(f"{n}_salary_mid") for n, c in zip(("p25", "median", "p75"), quantiles(F.col("salary_mid"), (0.25, 0.5, 0.75)), strict=True)],
        exact_mean(F.col("salary_mid")).alias("mean_salary_mid"),
        quantile(F.col("salary_from"), 0.5).alias("median_salary_from"),
        quantile(F.col("salary_to"), 0.5).alias("median_salary_to"),
        share(F.col("is_remote")).alias("remote_share"),
        share(F.col("is_full_time")).alias("full_time_share"),
        share(F.col("is_shift")).alias("shift_share"),
        share(F.coalesce(F.col("quality_flag_count"), F.lit(0)) == 0).alias("data_quality_score"),
        F.count(F.when(known & (F.col("_k") == 1), 1)).alias("employer_count"),
        F.coalesce(F.max(F.when(known, F.col("_k"))), F.lit(0)).alias("_top"),
    )
    return out.withColumns({"salary_missing_rate": 1 - F.col("salary_count").cast("double") / total, "top_employer_share": F.col("_top").cast("double") / total}).drop("_top")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null; the keys of the left side stay. Both sides are hashed on the same expressions."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def compute_share(df: DataFrame, keys: Sequence[str], column: str, value: object | Callable[[Column], Column], name: str = "share") -> DataFrame:
    """AGG-04: per group the share of rows whose column equals a value, or for which a condition on it holds."""
    require(df, [*keys, column])
    c = F.col(column)
    return df.groupBy(*keys).agg(share(value(c) if callable(value) else c == F.lit(value)).alias(name))


def reaggregate(cube: DataFrame, keys: Sequence[str], first: Sequence[str] = (), order: str = "month_idx", months: str | None = None) -> DataFrame:
    """AGG-05 and AGG-06: sums of counts, weighted means of all measures, first non-null values in the order of ``order``, distinct months; one aggregation."""
    counted = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("vacancy_count", "salary_count", "employer_count")]
    by_salary = [weighted_mean(F.col(c), F.col("salary_count")).alias(c) for c in SALARY_MEASURES]
    by_vacancy = [weighted_mean(F.col(c), F.col("vacancy_count")).alias(c) for c in VACANCY_MEASURES]
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in first]
    seen = [F.count_distinct(order).alias(months)] if months else []
    return cube.groupBy(*keys).agg(*counted, *by_salary, *by_vacancy, *firsts, *seen)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """AGG-07: counts of all values, null included, keys as strings."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """AGG-08 and AGG-10: the most frequent values with their share of all rows."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", rounded(100.0 * F.col("n") / F.col("total"), 2).alias("pct")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)


def flag_counts(df: DataFrame, column: str = "quality_flags") -> DataFrame:
    """AGG-09."""
    return df.select(F.explode(column).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).cast("bigint")


def pass_counts(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """FLT-04: how many rows pass each filter, and all filters up to it; one aggregation, one row a filter."""
    so_far, columns = F.lit(True), [F.count(F.lit(1)).alias("rows")]
    for name, f in filters.items():
        so_far = so_far & F.coalesce(f, F.lit(False))
        columns += [count_if(f).alias(f"{name}__alone"), count_if(so_far).alias(f"{name}__sequential")]
    one = df.agg(*columns)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("filter"), F.col("rows"), F.coalesce(F.col(f"{n}__alone"), F.lit(0)).alias("passed"), F.coalesce(F.col(f"{n}__sequential"), F.lit(0)).alias("passed_so_far")) for n in filters])))


def within_group_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """JOIN-04: the share of each value in its group, without a join."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))
