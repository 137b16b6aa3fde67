"""What the plans deal and compute again."""

import os

import pytest
from pyspark.sql import functions as F

from cubelark.functions import categories as CAT
from cubelark.functions import money as MON
from cubelark.operators import cube as C
from cubelark.operators import states as S
from cubelark.plans import canonical, cleaning, forecasts, rows_only
from cubelark.plans.star import records

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cube_deals_its_records_once(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("key"), (F.col("id") % 7).cast("string").alias("employer_id"), F.col("id").cast("double").alias("salary_mid"))
    assert plan(C.monthly_cube(rows, ["key"])).count("Exchange") == 1


def test_states_deal_records_once_and_a_cube_of_them_deals_states_once(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("key"), (F.col("id") % 5).alias("other"), (F.col("id") % 7).cast("string").alias("employer_id"), F.col("id").cast("double").alias("salary_mid"))
    day = F.concat(F.lit("d"), F.col("other") % 4)
    states = S.cube_states(rows, ["key", "other"], day)
    text = plan(states)
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")  # records, not states
    S.store_states(rows, ["key", "other"], day, f"{tmp_path}/states")
    assert plan(S.cube_of(S.stored_states(spark, f"{tmp_path}/states", states), ["key"])).count("Exchange") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_lines_meet_orders_once_and_last(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        text = plan(records(spark, DATA))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") == 4 and text.index("l_orderkey") < text.index("o_custkey")
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and "l_orderkey" in joins[0] and "o_custkey" in joins[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_training_rows_are_computed_once(spark):
    for rows in (rows_only.training_rows(spark, DATA), forecasts.supervised(spark, DATA)):
        assert "Exchange" not in plan(rows) and "lineitem" not in plan(rows)


def test_texts_are_cleaned_once_for_all_rules(spark):
    """Cleaning has four replacements and is spelt twice in a column: an expression that repeats it for each rule has dozens."""
    texts = spark.range(3).select(F.col("id").cast("string").alias("c"))
    for column in (CAT.experience(F.col("c"))[2], CAT.schedule(F.col("c"))[0], MON.parse_salary(F.col("c"))["salary_to"]):
        found = texts.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < found.count("regexp_replace") <= 16


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_raw_rows_are_dealt_to_all_cores_first(spark):
    found = canonical.process_source(cleaning.raw_customers(spark, DATA), "hh_kaggle").records.select("salary_from")
    assert f"RoundRobinPartitioning({spark.sparkContext.defaultParallelism})" in plan(found)
