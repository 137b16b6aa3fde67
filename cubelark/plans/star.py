"""The star schema bound to the roles of the segment model: a line of an order is a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.functions.dates import month_index, month_label, quarter_index
from cubelark.functions.money import midpoint

KEYS = ("source_dataset", "month_idx", "vacancy_month", "region", "federal_district", "occupation_group")
SEGMENT = ("source_dataset", "region", "occupation_group")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their roles. Region and nation have a fixed number of rows; the rest joins by size as Spark finds it.

    Orders get their customers before they meet the lines, so that the largest table is dealt once, with no more than its roles need.
    """
    line, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    nation, region = F.broadcast(table(spark, sf_dir, "nation")), F.broadcast(table(spark, sf_dir, "region"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    placed = orders.join(named, F.col("o_custkey") == F.col("c_custkey"))
    lines = line.select(
        "l_orderkey", "l_returnflag", "l_suppkey", F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice")).alias("_paid"), (F.col("l_tax") > 0.04).alias("is_remote"), (F.col("l_linestatus") == "O").alias("is_shift"),
        ((F.col("l_discount") > 0.08).cast("int") + (F.col("l_quantity") > 45).cast("int")).alias("quality_flag_count"),
    )
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    when = F.col("o_orderdate")
    low, high = F.col("_paid") - 500, F.col("_paid") + 500
    return joined.select(
        F.col("l_returnflag").alias("source_dataset"), month_label(when).alias("vacancy_month"), month_index(when).alias("month_idx"), quarter_index(when).alias("quarter_idx"),
        F.nullif(F.col("r_name"), F.lit("AFRICA")).alias("region"), F.col("n_name").alias("federal_district"), F.col("c_mktsegment").alias("occupation_group"), F.col("o_orderpriority").alias("experience_group"),
        low.alias("salary_from"), high.alias("salary_to"), midpoint(low, high).alias("salary_mid"), F.col("l_suppkey").alias("employer_id"),
        "is_remote", "is_shift", (F.col("o_orderstatus") == "F").alias("is_full_time"), "quality_flag_count",
    )
