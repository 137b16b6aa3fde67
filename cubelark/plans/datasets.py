"""Supervised datasets from a monthly cube: strict (adjacent periods) and broad (observed periods), monthly and quarterly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.functions.categories import rare, support_bucket
from cubelark.functions.dates import month_label_of, quarter_label_of
from cubelark.functions.money import log_ratio
from cubelark.operators import periods as P
from cubelark.operators.cube import reaggregate, require

# Names of features and thresholds.
MONTHLY_TARGET, QUARTERLY_TARGET = "target_median_salary_mid_t_plus_1", "target_median_salary_mid_t_plus_1_quarter"
BROAD_MONTHLY_TARGET, BROAD_QUARTERLY_TARGET = "target_median_salary_mid_next_observed_month", "target_median_salary_mid_next_observed_quarter"
MONTHLY_LAGS = {
    "median_salary_mid_lag_1": ("median_salary_mid", 1), "median_salary_mid_lag_2": ("median_salary_mid", 2), "median_salary_from_lag_1": ("median_salary_from", 1), "median_salary_to_lag_1": ("median_salary_to", 1),
    "vacancy_count_lag_1": ("vacancy_count", 1), "salary_count_lag_1": ("salary_count", 1), "salary_missing_rate_lag_1": ("salary_missing_rate", 1), "employer_count_lag_1": ("employer_count", 1), "data_quality_score_lag_1": ("data_quality_score", 1),
}
QUARTERLY_LAGS = {
    "median_salary_mid_lag_1q": ("median_salary_mid", 1), "median_salary_mid_lag_2q": ("median_salary_mid", 2), "vacancy_count_lag_1q": ("vacancy_count", 1), "salary_count_lag_1q": ("salary_count", 1),
    "salary_missing_rate_lag_1q": ("salary_missing_rate", 1), "employer_count_lag_1q": ("employer_count", 1), "data_quality_score_lag_1q": ("data_quality_score", 1), "months_observed_in_quarter_lag_1q": ("months_observed_in_quarter", 1),
}
OBSERVED_LAGS = {
    "median_salary_mid_lag_1_observed": ("median_salary_mid", 1), "median_salary_mid_lag_2_observed": ("median_salary_mid", 2), "vacancy_count_lag_1_observed": ("vacancy_count", 1),
    "salary_count_lag_1_observed": ("salary_count", 1), "data_quality_score_lag_1_observed": ("data_quality_score", 1),
}
CHANGING = ("median_salary_mid", "vacancy_count", "salary_count", "employer_count", "data_quality_score")
RARE_REGION, RARE_OCCUPATION = 60, 100


def _filters(target: str, least: dict[str, float], bound: str | None = None) -> dict[str, Column]:
    out = {"has_target": F.col(target).isNotNull(), "has_salary": F.col("median_salary_mid").isNotNull()}
    return out | {f"{c}_at_least": F.col(c) >= v for c, v in least.items()}


# Least counts and quality of the strict and broad datasets.
STRICT_MONTHLY = {"salary_count": 5, "vacancy_count": 10, "data_quality_score": 0.5}
STRICT_QUARTERLY = {"months_observed_in_quarter": 1, "salary_count": 2, "vacancy_count": 3, "data_quality_score": 0.3}
BROAD = {"salary_count": 1, "vacancy_count": 2, "data_quality_score": 0.2}


def kept(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    for f in filters.values():
        df = df.where(f)
    return df


def strict_monthly(cube: DataFrame, segment: Sequence[str], order: str = "month_idx", filtered: bool = True) -> DataFrame:
    """ML-01. The cube must have one row for each segment and month."""
    require(cube, [*segment, order, "median_salary_mid"])
    out = P.adjacent_target(cube, segment, order, "median_salary_mid", MONTHLY_TARGET)
    out = P.adjacent_lags(out, segment, order, MONTHLY_LAGS)
    out = out.withColumns({"year": F.floor(F.col(order) / 12).cast("int"), "month": (F.col(order) % 12 + 1).cast("int"), "target_vacancy_month": F.when(F.col(MONTHLY_TARGET).isNotNull(), month_label_of(F.col(order) + 1))})
    return kept(out, _filters(MONTHLY_TARGET, STRICT_MONTHLY)) if filtered else out


def quarterly(cube: DataFrame, segment: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Months to quarters (DT-06), with the months seen in each."""
    by_quarter = cube.withColumn("quarter_idx", F.floor(F.col("month_idx") / 3).cast("int"))
    return reaggregate(by_quarter, [*segment, "quarter_idx"], first=first, months="months_observed_in_quarter").withColumn("vacancy_quarter", quarter_label_of(F.col("quarter_idx")))


def strict_quarterly(cube: DataFrame, segment: Sequence[str], filtered: bool = True) -> DataFrame:
    """ML-02."""
    q = quarterly(cube, segment)
    out = P.adjacent_target(q, segment, "quarter_idx", "median_salary_mid", QUARTERLY_TARGET)
    out = P.adjacent_lags(out, segment, "quarter_idx", QUARTERLY_LAGS)
    return kept(out, _filters(QUARTERLY_TARGET, STRICT_QUARTERLY)) if filtered else out


def _dynamics(df: DataFrame, segment: Sequence[str], order: str) -> DataFrame:
    out = P.past_statistics(df, segment, order, "median_salary_mid")
    out = P.changes(out, segment, order, CHANGING)
    return P.lag_changes(out, segment, order, "median_salary_mid")


def with_support(df: DataFrame, segment: Sequence[str]) -> DataFrame:
    """AGG-21, CAT-09, CAT-10."""
    out = P.observation_counts(df, {"region_observation_count": ["region"], "occupation_group_observation_count": ["occupation_group"], "segment_observation_count": list(segment)})
    return out.withColumns({
        "region_grouped": rare(F.col("region"), F.col("region_observation_count"), RARE_REGION, "rare_region"),
        "occupation_group_grouped": rare(F.col("occupation_group"), F.col("occupation_group_observation_count"), RARE_OCCUPATION, "rare_occupation"),
        "region_support_bucket": support_bucket(F.col("region_observation_count")),
        "segment_support_bucket": support_bucket(F.col("segment_observation_count")),
    })


def broad_monthly(cube: DataFrame, segment: Sequence[str], first: Sequence[str] = (), filtered: bool = True) -> DataFrame:
    """ML-03."""
    base = reaggregate(cube, [*segment, "month_idx"], first=first)
    out = P.observed(base, segment, "month_idx", "median_salary_mid", BROAD_MONTHLY_TARGET, "gap_to_target_months", "gap_from_previous_observed_month", OBSERVED_LAGS)
    out = _dynamics(out, segment, "month_idx")
    out = out.withColumns({"vacancy_month": month_label_of(F.col("month_idx")), "target_log_salary_delta": log_ratio(F.col(BROAD_MONTHLY_TARGET), F.col("median_salary_mid"))})
    return with_support(kept(out, _filters(BROAD_MONTHLY_TARGET, BROAD)) if filtered else out, segment)


def broad_quarterly(cube: DataFrame, segment: Sequence[str], first: Sequence[str] = (), filtered: bool = True) -> DataFrame:
    """ML-04: with seasonal transitions and the log-ratio target."""
    base = quarterly(cube, segment, first=first)
    out = P.observed(base, segment, "quarter_idx", "median_salary_mid", BROAD_QUARTERLY_TARGET, "gap_to_target_quarters", "gap_from_previous_observed_quarter", OBSERVED_LAGS)
    out = _dynamics(out, segment, "quarter_idx")
    quarter, target = F.col("quarter_idx") % 4 + 1, (F.col("quarter_idx") + F.col("gap_to_target_quarters")) % 4 + 1
    out = out.withColumns({"quarter": quarter, "target_quarter": target, "quarter_transition": P.transition(quarter, target), "is_q4_to_q1": F.coalesce(((quarter == 4) & (target == 1)).cast("int"), F.lit(0))})
    out = P.with_seasonal(out, "quarter_transition", "quarter_idx", "median_salary_mid", BROAD_QUARTERLY_TARGET)
    out = out.withColumn("target_log_salary_delta", log_ratio(F.col(BROAD_QUARTERLY_TARGET), F.col("median_salary_mid")))
    return kept(out, _filters(BROAD_QUARTERLY_TARGET, BROAD)) if filtered else out
