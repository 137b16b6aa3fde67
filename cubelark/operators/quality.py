"""Keys, hashes, duplicate marks, flags and schema gates. Rows are marked, never dropped."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubelark.functions.text import hash_form, strip
from cubelark.operators.cube import count_if
from cubelark.session import scratch

# Columns of the row hash and of the fallback key, in order.
HASH_COLUMNS = ("source_dataset", "source_vacancy_id", "source_url", "title_raw", "employer_name", "region", "city", "vacancy_date_raw", "salary_from", "salary_to")
FALLBACK_COLUMNS = ("title_raw", "employer_name", "region", "city", "vacancy_date_raw", "salary_raw")


def row_hash(columns: Sequence[Column]) -> Column:
    """HASH-01: SHA-256 of a compact JSON array of the normalised values."""
    return F.sha2(F.to_json(F.array(*[hash_form(c) for c in columns])), 256)


def source_key(source: Column, identifier: Column, fallback: Sequence[Column]) -> Column:
    """HASH-02."""
    own = strip(identifier.cast("string"))
    return F.when(F.coalesce(own, F.lit("")) != "", F.concat(source, F.lit(":"), own)).otherwise(F.concat(source, F.lit(":fallback:"), row_hash(fallback)))


def mark_duplicates(df: DataFrame, key: str, digest: str) -> DataFrame:
    """DQ-05: rows that share a key, or else a hash, with another; the group is named by its key, not numbered.

    Sizes are counted per key and joined, so that Spark can split a key with
    very many rows, which one window partition could not.
    """
    def sizes(c: str, n: str) -> DataFrame:
        return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)

    marked = df.join(sizes(key, "_nk"), F.col(key) == F.col(f"_{key}"), "left").join(sizes(digest, "_nd"), F.col(digest) == F.col(f"_{digest}"), "left")
    group = F.when(F.col("_nk").isNotNull(), F.concat(F.lit("key:"), F.col(key))).when(F.col("_nd").isNotNull(), F.concat(F.lit("hash:"), F.col(digest)))
    return marked.withColumns({"is_duplicate": F.col("_nk").isNotNull() | F.col("_nd").isNotNull(), "duplicate_group_id": group}).drop("_nk", "_nd", f"_{key}", f"_{digest}")


def quality_flags(flags: dict[str, Column]) -> tuple[Column, Column]:
    """ARR-01: the names of the flags that hold, in order, and their number."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return names, F.size(names)


def numbered_groups(df: DataFrame, key: str) -> DataFrame:
    """WIN-16: a dense number of each duplicated key, in the order of the keys.

    The keys are dealt out by range and sorted in their partitions; a number is
    the place in the partition, which the low bits of the increasing id are,
    after the keys of the partitions before.
    """
    spark = df.sparkSession
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = twice.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    to = scratch(spark, "numbered")
    dealt.withColumn("_id", F.monotonically_increasing_id()).write.parquet(to)  # once: the ranges come from a sample
    placed = spark.read.parquet(to).withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return placed.join(F.broadcast(before), "_part").select(key, "n", (F.col("_before") + F.col("_place")).cast("int").alias("group_number"))


def schema_gate(frames: dict[str, DataFrame], required: Sequence[str]) -> dict[str, dict[str, list[str]]]:
    """DQ-07, SET-05: required columns that are missing, and further columns that others lack. Metadata only."""
    further = {n: set(f.columns) - set(required) for n, f in frames.items()}
    every = set().union(*further.values()) if further else set()
    return {n: {"missing": [c for c in required if c not in f.columns], "lacking": sorted(every - further[n])} for n, f in frames.items()}


def gate_report(frames: dict[str, DataFrame], gate: dict[str, dict[str, list[str]]]) -> DataFrame:
    """DQ-07: what ``schema_gate`` found, a row for each source with its number of rows."""
    parts = [f.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), F.lit(",".join(gate[n]["missing"])).alias("missing"), F.lit(",".join(gate[n]["lacking"])).alias("lacking"), "rows") for n, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def union_sources(frames: dict[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """SET-01: all rows of compatible sources, columns in order."""
    gate = schema_gate(frames, required)
    bad = {n: g for n, g in gate.items() if g["missing"] or g["lacking"]}
    if bad:
        raise ValueError(f"incompatible schemas: {bad}")
    first = next(iter(frames.values()))
    columns = [*required, *[c for c in first.columns if c not in required]]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*columns) for f in frames.values()])


def processing_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """DQ-08."""
    a, b = before.agg(F.count(F.lit(1)).alias("rows_before")), after.agg(F.count(F.lit(1)).alias("rows_after"))
    return a.crossJoin(b).withColumn("rows_lost", F.col("rows_before") - F.col("rows_after"))


def validate_canonical(df: DataFrame, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """DQ-06: missing and further columns, and nulls of the required ones; one row."""
    nulls = [count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required if c in df.columns]
    missing, extra = [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]
    return df.agg(F.count(F.lit(1)).alias("rows"), *nulls).withColumns({"missing_columns": F.lit(",".join(missing)), "extra_columns": F.lit(",".join(extra))})


def validate_result(canonical: DataFrame, cube: DataFrame, saved_rows: int | None = None, least_parse_rate: float = 0.9) -> DataFrame:
    """DQ-10: the checks of a finished run, one row each; two aggregations."""
    c = canonical.agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("vacancy_date").isNotNull()).alias("parsed"), count_if(F.col("vacancy_date_raw").isNotNull()).alias("dated"), count_if((F.col("salary_from") == 0) | (F.col("salary_to") == 0)).alias("zero"), count_if(F.col("source_dataset").isNull()).alias("unnamed"))
    m = cube.agg(F.coalesce(F.sum("vacancy_count"), F.lit(0)).cast("bigint").alias("counted"), count_if(F.col("vacancy_month").isNull()).alias("monthless"))
    checks = {"dates_parsed": F.col("parsed") >= F.col("dated") * least_parse_rate, "no_zero_salary": F.col("zero") == 0, "sources_named": F.col("unnamed") == 0, "counts_conserved": F.col("counted") == F.col("rows"), "months_named": F.col("monthless") == 0, "rows_saved": F.lit(saved_rows).isNull() | (F.col("rows") == F.lit(saved_rows))}
    return c.crossJoin(m).select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(x, F.lit(False)).alias("passed")) for n, x in checks.items()])))


def merge_audit(df: DataFrame, columns: Sequence[str] = ("source_dataset", "vacancy_month", "salary_bound_type")) -> DataFrame:
    """DQ-09: counts of the values of some columns and of the flags, long form."""
    parts = [df.groupBy(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for c in columns]
    parts.append(df.select(F.explode("quality_flags").alias("value")).groupBy(F.lit("quality_flags").alias("what"), "value").agg(F.count(F.lit(1)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def readiness(cube: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """DQ-11: how many rows have a row in the next period."""
    w = Window.partitionBy(*keys).orderBy(order)
    return cube.withColumn("_next", F.lead(order).over(w) == F.col(order) + 1).agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("_next")).alias("rows_with_next"), F.count_distinct(F.struct(*keys)).alias("segments"))
