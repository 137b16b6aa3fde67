"""The engine's operators as queries over the driver's tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubelark.functions.categories import support_bucket
from cubelark.functions.dates import cyclic, date_flags, month_label, month_label_of, quarter_label
from cubelark.functions.exact import exact_mean, quantile, rounded, share
from cubelark.functions.money import bound_type, log_ratio, midpoint
from cubelark.functions.text import json_key, keyword_category
from cubelark.operators import cube as C
from cubelark.operators import metrics as M
from cubelark.operators import periods as P
from cubelark.operators import profile as PR
from cubelark.operators import quality as Q
from cubelark.operators import states as ST
from cubelark.operators.serving import Mart
from cubelark.plans import datasets as D
from cubelark.plans.star import KEYS, SEGMENT, records, table
from cubelark.session import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FOLDS = (24000, 24006, 24012, 24015, 24018)
QUARTER_KEYS = ("source_dataset", "quarter_idx", "region", "occupation_group")
GROUPS = {"nr": ("N", "R")}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def cube(spark: SparkSession, d: str) -> DataFrame:
    return C.monthly_cube(records(spark, d), KEYS)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return C.reaggregate(cube(spark, d), [*SEGMENT, "month_idx"])


def quarters(spark: SparkSession, d: str) -> DataFrame:
    return D.quarterly(cube(spark, d), SEGMENT)


def observed(spark: SparkSession, d: str) -> DataFrame:
    return P.observed(monthly(spark, d), SEGMENT, "month_idx", "median_salary_mid", "target", "gap_to", "gap_from")


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """A fixed linear prediction beside the naive one: strategies are tested without a model."""
    return observed(spark, d).withColumn("model", 0.9 * F.col("median_salary_mid") + 1000)


def transitions(spark: SparkSession, d: str) -> DataFrame:
    q = P.observed(quarters(spark, d), SEGMENT, "quarter_idx", "median_salary_mid", "target", "gap", "gap_from")
    a, b = F.col("quarter_idx") % 4 + 1, (F.col("quarter_idx") + F.col("gap")) % 4 + 1
    return q.withColumn("quarter_transition", P.transition(a, b))


@query
def cube_monthly(spark, d):
    return cube(spark, d)


@query
def cube_incremental(spark, d):
    """The cube by quarters from a table of states by month: the months up to one of which not all records are known yet, then that month again with all later ones."""
    r, path, month = records(spark, d), scratch(spark, "states"), F.col("vacancy_month")
    late = F.col("month_idx") == FOLDS[2]
    ST.store_states(r.where((F.col("month_idx") < FOLDS[2]) | (late & F.col("is_remote"))), QUARTER_KEYS, month, path)
    ST.store_states(r.where(F.col("month_idx") >= FOLDS[2]), QUARTER_KEYS, month, path)
    return ST.cube_of(ST.stored_states(spark, path, ST.cube_states(r, QUARTER_KEYS, month)), QUARTER_KEYS)


@query
def cube_share(spark, d):
    r = records(spark, d)
    a = C.compute_share(r, ["source_dataset", "region"], "is_remote", True, "remote_share")
    b = C.compute_share(r, ["source_dataset", "region"], "quality_flag_count", lambda c: c >= 1, "flagged_share")
    return C.null_safe_join(a, b, ["source_dataset", "region"])


@query
def cube_broad_monthly(spark, d):
    return monthly(spark, d)


@query
def cube_quarterly_weighted(spark, d):
    return quarters(spark, d)


@query
def cube_first_values(spark, d):
    return C.reaggregate(cube(spark, d), SEGMENT, first=["federal_district"], months="months").select(*SEGMENT, "federal_district", "months")


@query
def filter_pass_counts(spark, d):
    return C.pass_counts(monthly(spark, d), {"salary_count": F.col("salary_count") >= 5, "vacancy_count": F.col("vacancy_count") >= 10, "data_quality_score": F.col("data_quality_score") >= 0.5})


@query
def monthly_strict_target(spark, d):
    out = D.strict_monthly(monthly(spark, d), SEGMENT, filtered=False)
    return out.select(*SEGMENT, "month_idx", "median_salary_mid", D.MONTHLY_TARGET, "median_salary_mid_lag_1", "median_salary_mid_lag_2")


@query
def quarterly_strict_target(spark, d):
    return D.strict_quarterly(cube(spark, d), SEGMENT).select(*SEGMENT, "quarter_idx", "median_salary_mid", D.QUARTERLY_TARGET, "median_salary_mid_lag_1q", "median_salary_mid_lag_2q")


@query
def broad_next_observed(spark, d):
    return observed(spark, d).select(*SEGMENT, "month_idx", "median_salary_mid", "target", "gap_to", "gap_from")


@query
def expanding_stats(spark, d):
    return P.past_statistics(monthly(spark, d), SEGMENT, "month_idx", "median_salary_mid").select(*SEGMENT, "month_idx", *[f"segment_previous_{n}" for n in ("observation_count", "salary_mean", "salary_median", "salary_std")])


@query
def pct_changes(spark, d):
    columns = ["median_salary_mid", "vacancy_count", "employer_count"]
    return P.changes(monthly(spark, d), SEGMENT, "month_idx", columns).select(*SEGMENT, "month_idx", *[f"{c}_{k}_lag_1" for c in columns for k in ("delta", "pct_change")])


@query
def seasonal_transition(spark, d):
    return P.seasonal_history(transitions(spark, d), "quarter_transition", "quarter_idx", "median_salary_mid", "target")


@query
def broad_quarterly_dataset(spark, d):
    out = D.broad_quarterly(cube(spark, d), SEGMENT).withColumn("target_log_salary_delta", rounded("target_log_salary_delta", 8))
    return out.select(*SEGMENT, "quarter_idx", "vacancy_count", "median_salary_mid", D.BROAD_QUARTERLY_TARGET, "gap_to_target_quarters", "quarter_transition", "is_q4_to_q1", "seasonal_transition_previous_count", "seasonal_transition_salary_ratio_mean", "seasonal_transition_salary_ratio_median", "target_log_salary_delta")


@query
def support_features(spark, d):
    return D.with_support(mart(spark, d).data.select(*SEGMENT, "month_idx"), SEGMENT)


@query
def residual_target(spark, d):
    return observed(spark, d).select(*SEGMENT, "month_idx", rounded(log_ratio(F.col("target"), F.col("median_salary_mid")), 8).alias("target_log_salary_delta"))


@query
def time_split_baseline(spark, d):
    rows = M.time_split(observed(spark, d).where("target is not null"), "month_idx")
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("gap_to") == 1, "gap_1")))
    return M.evaluate(rows.withColumn("subset", F.explode(subsets)), "target", "median_salary_mid", ["split", "subset"])


@query
def scorecard_by_region(spark, d):
    return M.evaluate(predicted(spark, d), "target", "model", ["region"])


@query
def scorecard_grouping_sets(spark, d):
    return M.evaluate_sets(predicted(spark, d), "target", "model", [["source_dataset"], ["region"], ["source_dataset", "region"], []])


@query
def compare_model_baseline(spark, d):
    return M.compare(predicted(spark, d), "target", "model", "median_salary_mid", ["source_dataset", "occupation_group"], min_rows=5)


@query
def strategy_metrics(spark, d):
    return M.evaluate_strategies(predicted(spark, d), "target", M.strategies(F.col("model"), F.col("median_salary_mid")))


@query
def q4q1_strategies(spark, d):
    t = transitions(spark, d)
    rows = P.with_seasonal(t, "quarter_transition", "quarter_idx", "median_salary_mid", "target")
    turn = (F.col("quarter_transition") == "Q4_to_Q1").cast("int")
    base = F.col("median_salary_mid")
    return M.evaluate_strategies(rows, "target", M.q4_strategies(0.9 * base + 1000, base, turn, F.col("seasonal_transition_salary_ratio_mean"), F.col("seasonal_transition_salary_ratio_median")))


@query
def naive_backtest_folds(spark, d):
    return M.evaluate(M.expanding_folds(predicted(spark, d), "month_idx", FOLDS), "target", "median_salary_mid", ["fold", "role"])


@query
def fold_summary(spark, d):
    test = M.expanding_folds(predicted(spark, d), "month_idx", FOLDS).where("role = 'test'")
    return M.fold_summary(M.evaluate_strategies(test, "target", M.strategies(F.col("model"), F.col("median_salary_mid")), ["fold"]), ["strategy"], "fold")


@query
def group_errors_share(spark, d):
    return M.group_errors(predicted(spark, d), "target", "model", ["region", "occupation_group"])


@query
def support_slices(spark, d):
    return M.slices(predicted(spark, d), M.support_masks("target", "model"), "target", "model")


@query
def largest_errors(spark, d):
    columns = [*SEGMENT, "month_idx"]
    return M.largest_errors(predicted(spark, d).select(*columns, "target", "model"), "target", "model", columns)


@query
def period_profile(spark, d):
    return M.period_profile(monthly(spark, d), "month_idx", 24000, "median_salary_mid")


@query
def forecast_decision(spark, d):
    base = F.col("median_salary_mid")
    model, turn = 0.9 * base + 1000, (F.col("quarter_transition") == "Q4_to_Q1").cast("int")
    return transitions(spark, d).select(*SEGMENT, "quarter_idx", rounded(M.forecast_decision(model, base, "quarterly", turn), 6).alias("quarterly"), rounded(M.forecast_decision(model, base, "monthly"), 6).alias("monthly"))


MARTS: dict[tuple, DataFrame] = {}


def version(spark: SparkSession, d: str) -> tuple:
    """What the star's files are now: number, bytes and time of the last change of each table's."""
    out = []
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out.append((len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)))
    return tuple(out)


def mart(spark: SparkSession, d: str) -> Mart:
    """The mart that the interface reads: stored once for a session and its tables as they are now, in folders by period. Tables that have changed since get a new one."""
    key = spark.sparkContext.applicationId, d, version(spark, d)
    if key not in MARTS:
        for old in [k for k in MARTS if k[:2] == key[:2]]:
            del MARTS[old]
        to, rows = scratch(spark, "mart"), monthly(spark, d).withColumn("period", month_label_of(F.col("month_idx")))
        rows.repartition("period").write.partitionBy("period").parquet(to)
        MARTS[key] = spark.read.schema(rows.schema).parquet(to)
    return Mart(MARTS[key], "period", "monthly", GROUPS)


CHOSEN = {"source_dataset": "nr", "region": "ASIA", "occupation_group": None}


@query
def api_filters(spark, d):
    return mart(spark, d).filters(CHOSEN)


@query
def api_overview(spark, d):
    return mart(spark, d).overview(CHOSEN)


@query
def api_trend(spark, d):
    return mart(spark, d).trend(CHOSEN)


@query
def api_segments(spark, d):
    return mart(spark, d).segments({}, "1999-12", 20)


@query
def api_history(spark, d):
    return mart(spark, d).history("nr", None, "BUILDING")


@query
def api_forecast_row(spark, d):
    return mart(spark, d).forecast_row("nr", "ASIA", "BUILDING").select(*SEGMENT, "period", "vacancy_count", "median_salary_mid")


@query
def value_counts(spark, d):
    return C.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query
def top_values(spark, d):
    return C.top_values(table(spark, d, "part"), "p_brand", 10)


@query
def market_mix(spark, d):
    return C.top_values(table(spark, d, "customer"), "c_mktsegment", 100)


@query
def conditional_counts(spark, d):
    return PR.split_summary(table(spark, d, "events"), F.col("value") > 50, "value")


@query
def pivot_compare(spark, d):
    kind = F.when(F.col("is_remote"), "remote").otherwise("onsite")
    wide = records(spark, d).withColumn("kind", kind).groupBy("occupation_group").pivot("kind", ["remote", "onsite"]).agg(F.count(F.lit(1)).alias("n"), quantile(F.col("salary_mid"), 0.5).alias("m"))
    out = wide.select("occupation_group", (F.coalesce("remote_n", F.lit(0)) + F.coalesce("onsite_n", F.lit(0))).alias("n"), F.col("remote_m").alias("remote"), F.col("onsite_m").alias("onsite"))
    return out.where("n >= 10").withColumn("pct_difference", rounded((F.col("remote") - F.col("onsite")) / F.nullif(F.col("onsite"), F.lit(0.0)) * 100, 4))


@query
def within_group_share(spark, d):
    return C.within_group_share(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query
def two_level_activity(spark, d):
    e = records(spark, d).groupBy("region", "employer_id").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("region").agg(F.count(F.lit(1)).alias("employers"), F.sum("n").alias("vacancies"), quantile(F.col("n"), 0.5).alias("median"), exact_mean(F.col("n")).alias("mean"))


@query
def null_profile(spark, d):
    return PR.null_percent(records(spark, d).select("region", "salary_mid"))


@query
def missing_values(spark, d):
    return PR.missing_values(table(spark, d, "documents").select("text", "lang"))


@query
def dup_profile(spark, d):
    return PR.duplicates(table(spark, d, "documents"), ["text"])


@query
def iqr_outliers(spark, d):
    return PR.iqr_outliers(table(spark, d, "orders"), "o_totalprice")


@query
def corr_pairs(spark, d):
    return PR.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query
def describe(spark, d):
    return PR.describe(table(spark, d, "events"), "value", ["event_type"])


@query
def date_coverage(spark, d):
    return PR.date_coverage(table(spark, d, "orders"), "o_orderdate")


@query
def text_lengths(spark, d):
    return PR.text_lengths(table(spark, d, "documents"), ["text", "source"])


@query
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", json_key(F.col("props"), "k").cast("bigint").alias("k"))


@query
def regex_numbers(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)), ",").alias("numbers"))


@query
def keyword_categories(spark, d):
    return table(spark, d, "part").select("p_partkey", keyword_category(F.col("p_type"), (("brass", ("brass",)), ("hard", ("steel", "tin"))), "other", "unknown").alias("category"))


@query
def bucket_case(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", support_bucket(F.col("n")))


@query
def row_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.row_hash([F.col("source"), F.col("lang"), F.col("n_chars")]).alias("digest"))


@query
def source_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.source_key(F.col("source"), F.col("doc_id"), [F.col("text")]).alias("source_key"))


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    flags, n = Q.quality_flags({"large": F.col("l_quantity") > 45, "discounted": F.col("l_discount") > 0.08, "untaxed": F.col("l_tax") == 0})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flags.alias("quality_flags"), n.alias("n_flags"))


@query
def flag_array(spark, d):
    return line_flags(spark, d).select("l_orderkey", "l_linenumber", F.array_join("quality_flags", ",").alias("flags"))


@query
def flag_counts(spark, d):
    return C.flag_counts(line_flags(spark, d))


@query
def dedup_mark(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("key"), F.sha2("text", 256).alias("digest"))
    return Q.mark_duplicates(docs, "key", "digest").select("doc_id", "is_duplicate")


@query
def dup_groups(spark, d):
    return Q.numbered_groups(table(spark, d, "documents").select(F.sha2("text", 256).alias("key")), "key")


@query
def union_sources(spark, d):
    r = records(spark, d).select("source_dataset", "region")
    frames = {s: r.where(F.col("source_dataset") == s) for s in ("A", "N", "R")}
    return Q.union_sources(frames, ["source_dataset", "region"]).groupBy("source_dataset", "region").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_values(spark, d):
    return records(spark, d).select("region", "occupation_group").distinct()


@query
def unique_segments(spark, d):
    return records(spark, d).select(*SEGMENT).distinct().agg(F.count(F.lit(1)).alias("segments"))


@query
def rolling2(spark, d):
    return P.rolling(monthly(spark, d), SEGMENT, "month_idx", "median_salary_mid").select(*SEGMENT, "month_idx", "median_salary_mid_rolling_mean_2", "median_salary_mid_rolling_std_2")


@query
def group_median_impute(spark, d):
    return P.impute_by_group(mart(spark, d).data, "median_salary_mid", ["source_dataset", "occupation_group"]).select(*SEGMENT, "month_idx", "median_salary_mid_imputed")


@query
def cyclic_month(spark, d):
    s, c = cyclic(F.col("month"))
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month")).select("month", rounded(s, 9).alias("month_sin"), rounded(c, 9).alias("month_cos"))


@query
def last_two_rows(spark, d):
    return P.last_rows(monthly(spark, d).select(*SEGMENT, "month_idx", "median_salary_mid"), SEGMENT, "month_idx")


@query
def period_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", month_label(F.col("o_orderdate")).alias("month_label"), quarter_label(F.col("o_orderdate")).alias("quarter_label"))


@query
def date_validity(spark, d):
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in date_flags("d", when.cast("string"), when, "1996-01-01", "2001-01-01").items()])


@query
def salary_midpoints(spark, d):
    low = F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice") - 1000)
    high = F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") - 20 * F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", midpoint(low, high).alias("mid"), bound_type(low, high).alias("bound_type"))


@query
def readiness(spark, d):
    return Q.readiness(monthly(spark, d), SEGMENT, "month_idx")


@query
def feature_mart(spark, d):
    """H-07: features by sphere, region and month with lags and the next value."""
    g = records(spark, d).groupBy("occupation_group", "region", "vacancy_month").agg(F.count(F.lit(1)).alias("vacancies"), quantile(F.col("salary_mid"), 0.5).alias("median_salary"), exact_mean(F.col("salary_mid")).alias("mean_salary"), share(F.col("is_remote")).alias("remote_share"), F.count_distinct("employer_id").alias("employers"))
    w = Window.partitionBy("occupation_group", "region").orderBy("vacancy_month")
    return g.withColumns({"lag_1": F.lag("median_salary", 1).over(w), "lag_2": F.lag("median_salary", 2).over(w), "target": F.lead("median_salary").over(w)})


@query
def top_share_regions(spark, d):
    """H-04: districts with enough rows by their share of a kind of work."""
    g = records(spark, d).groupBy("federal_district").agg(F.count(F.lit(1)).alias("n"), rounded(100.0 * share(F.col("is_remote")), 4).alias("remote_pct"))
    return g.where("n >= 100").orderBy(F.desc("remote_pct"), "federal_district").limit(15)


@query
def event_windows(spark, d):
    """Tumbling hours of events, the batch form of the streaming cube."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("s"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n", rounded(F.col("s") / F.col("n"), 4).alias("mean_value"))
