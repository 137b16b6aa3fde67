"""The queries of ``queries.py`` in SQL for an independent engine."""

from __future__ import annotations

STAR = """star AS (
  SELECT l_returnflag AS source_dataset, strftime(o_orderdate, '%Y-%m') AS vacancy_month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month_idx,
    CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS quarter_idx, nullif(r_name, 'AFRICA') AS region, n_name AS federal_district, c_mktsegment AS occupation_group, o_orderpriority AS experience_group,
    CASE WHEN l_quantity >= 5 THEN l_extendedprice - 500 END AS salary_from, CASE WHEN l_quantity >= 5 THEN l_extendedprice + 500 END AS salary_to,
    CASE WHEN l_quantity >= 5 THEN ((l_extendedprice - 500) + (l_extendedprice + 500)) / 2 END AS salary_mid, l_suppkey AS employer_id,
    l_tax > 0.04 AS is_remote, l_linestatus = 'O' AS is_shift, o_orderstatus = 'F' AS is_full_time, CAST(l_discount > 0.08 AS INT) + CAST(l_quantity > 45 AS INT) AS quality_flag_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
KEYS = "source_dataset, month_idx, vacancy_month, region, federal_district, occupation_group"
SEGMENT = "source_dataset, region, occupation_group"


def mean(x: str, over: str = "") -> str:
    o = f" OVER {over}" if over else ""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))){o} AS DOUBLE) / nullif(CAST(count({x}){o} AS DOUBLE), 0)"


def total(x: str, over: str = "") -> str:
    o = f" OVER {over}" if over else ""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))){o} AS DOUBLE)"


def part(c: str) -> str:
    return f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)"


def weighted(v: str, w: str) -> str:
    ok = f"CASE WHEN {v} IS NOT NULL AND {w} > 0 THEN"
    return f"coalesce(CAST(sum({ok} CAST({v} AS DECIMAL(18,6)) * {w} END) AS DOUBLE) / nullif(CAST(sum({ok} {w} END) AS DOUBLE), 0), {mean(v)}) AS {v}"


def cube(keys: str, name: str = "cube", source: str = "star") -> str:
    same = " AND ".join(f"m.{k} IS NOT DISTINCT FROM e.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT m.*, e.employer_count, 1 - CAST(m.salary_count AS DOUBLE) / m.vacancy_count AS salary_missing_rate, CAST(e.top AS DOUBLE) / m.vacancy_count AS top_employer_share FROM (
  SELECT {keys}, count(*) AS vacancy_count, count(salary_mid) AS salary_count, round(quantile_cont(salary_mid, 0.5), 6) AS median_salary_mid, {mean("salary_mid")} AS mean_salary_mid,
    round(quantile_cont(salary_mid, 0.25), 6) AS p25_salary_mid, round(quantile_cont(salary_mid, 0.75), 6) AS p75_salary_mid, round(quantile_cont(salary_from, 0.5), 6) AS median_salary_from, round(quantile_cont(salary_to, 0.5), 6) AS median_salary_to,
    {part("is_remote")} AS remote_share, {part("is_full_time")} AS full_time_share, {part("is_shift")} AS shift_share, {part("quality_flag_count = 0")} AS data_quality_score FROM {source} GROUP BY {keys}) m
  JOIN (SELECT {keys}, count(employer_id) AS employer_count, coalesce(max(CASE WHEN employer_id IS NOT NULL THEN n END), 0) AS top FROM (SELECT {keys}, employer_id, count(*) AS n FROM {source} GROUP BY {keys}, employer_id) GROUP BY {keys}) e ON {same})"""


SALARY = ("median_salary_mid", "mean_salary_mid", "p25_salary_mid", "p75_salary_mid", "median_salary_from", "median_salary_to")
VACANCY = ("salary_missing_rate", "remote_share", "full_time_share", "shift_share", "top_employer_share", "data_quality_score")


def reaggregate(keys: str, name: str, source: str = "cube", more: str = "") -> str:
    sums = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("vacancy_count", "salary_count", "employer_count"))
    means = ", ".join([weighted(c, "salary_count") for c in SALARY] + [weighted(c, "vacancy_count") for c in VACANCY])
    return f"{name} AS (SELECT {keys}, {sums}, {means}{more} FROM {source} GROUP BY {keys})"


CUBE = f"WITH {STAR}, {cube(KEYS)}"
MONTHLY = f"{CUBE}, {reaggregate(f'{SEGMENT}, month_idx', 'monthly')}"
QUARTERLY = f"{CUBE}, q AS (SELECT *, CAST(month_idx // 3 AS INT) AS quarter_idx FROM cube), {reaggregate(f'{SEGMENT}, quarter_idx', 'quarterly', 'q', ', count(DISTINCT month_idx) AS months_observed_in_quarter')}"
BY_SEGMENT = f"w AS (PARTITION BY {SEGMENT} ORDER BY {{o}}), x AS (PARTITION BY {SEGMENT} ORDER BY {{o}} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
MONTHLY_LABEL = "lpad(CAST(month_idx // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(month_idx % 12 + 1 AS VARCHAR), 2, '0')"
QUARTER_LABEL = "CAST(quarter_idx // 4 AS VARCHAR) || 'Q' || CAST(quarter_idx % 4 + 1 AS VARCHAR)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def scorecard(a: str, p: str) -> str:
    ok = f"CASE WHEN {a} IS NOT NULL AND {p} IS NOT NULL THEN"
    A, P = f"({ok} CAST({a} AS DOUBLE) END)", f"({ok} CAST({p} AS DOUBLE) END)"
    e = f"({P} - {A})"
    ape, sape = f"(100.0 * {ratio(f'abs({e})', f'abs({A})')})", f"(200.0 * {ratio(f'abs({e})', f'abs({A}) + abs({P})')})"
    return f"""count(*) AS row_count, count({A}) AS valid_row_count, round({mean(f"abs({e})")}, 4) AS mae, round(round(quantile_cont(abs({e}), 0.5), 6), 4) AS medae, round(sqrt(avg({e} * {e})), 4) AS rmse,
  round({mean(ape)}, 4) AS mape, round({mean(sape)}, 4) AS smape, round(100.0 * {ratio(total(f"abs({e})"), total(f"abs({A})"))}, 4) AS wape,
  round(round(quantile_cont({ape}, 0.5), 6), 4) AS ape_p50, round(round(quantile_cont({ape}, 0.75), 6), 4) AS ape_p75, round(round(quantile_cont({ape}, 0.9), 6), 4) AS ape_p90, round({mean(e)}, 4) AS bias"""


OBSERVED = f"""{MONTHLY}, observed AS (SELECT *, lead(median_salary_mid) OVER w AS target, lead(month_idx) OVER w - month_idx AS gap_to, month_idx - lag(month_idx) OVER w AS gap_from FROM monthly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY month_idx)),
predicted AS (SELECT *, 0.9 * median_salary_mid + 1000 AS model FROM observed)"""
Q_OBSERVED = f"""{QUARTERLY}, qobs AS (SELECT *, lead(median_salary_mid) OVER w AS target, lead(quarter_idx) OVER w - quarter_idx AS gap FROM quarterly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY quarter_idx)),
qtrans AS (SELECT *, 'Q' || CAST(quarter_idx % 4 + 1 AS VARCHAR) || '_to_Q' || CAST((quarter_idx + gap) % 4 + 1 AS VARCHAR) AS quarter_transition FROM qobs)"""
SEASONAL = f"""{Q_OBSERVED}, h AS (SELECT quarter_transition, quarter_idx, count(*) AS n, {total("target / median_salary_mid")} AS s, {total("ln(target / median_salary_mid)")} AS l, round(quantile_cont(target / median_salary_mid, 0.5), 6) AS m FROM qtrans WHERE median_salary_mid > 0 AND target > 0 AND quarter_transition IS NOT NULL GROUP BY 1, 2),
seasonal AS (SELECT quarter_transition, quarter_idx, CAST(coalesce(sum(n) OVER x, 0) AS BIGINT) AS seasonal_transition_previous_count, round({ratio(total("s", "x"), "coalesce(sum(n) OVER x, 0)")}, 6) AS seasonal_transition_salary_ratio_mean,
  round(quantile_cont(m, 0.5) OVER x, 6) AS seasonal_transition_salary_ratio_median, round({ratio(total("l", "x"), "coalesce(sum(n) OVER x, 0)")}, 6) AS seasonal_transition_log_delta_mean
  FROM h WINDOW x AS (PARTITION BY quarter_transition ORDER BY quarter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def changes(c: str) -> str:
    return f"round({c} - lag({c}) OVER w, 6) AS {c}_delta_lag_1, round({ratio(f'{c} - lag({c}) OVER w', f'abs(lag({c}) OVER w)')}, 6) AS {c}_pct_change_lag_1"


STRATEGIES = ", ".join(["{'s': 'always_baseline', 'v': median_salary_mid}", "{'s': 'always_catboost', 'v': model}"] + [f"{{'s': 'blend_alpha_{i / 10:.1f}', 'v': {i / 10} * model + (1 - {i / 10}) * median_salary_mid}}" for i in range(11)])
TURN = "quarter_transition = 'Q4_to_Q1'"


def q4(name: str, value: str, known: str = "TRUE") -> str:
    return f"{{'s': '{name}', 'v': CASE WHEN coalesce({TURN}, FALSE) AND {known} THEN {value} ELSE model END}}"


Q4 = ", ".join([
    q4("q4_to_q1_min_catboost_baseline", "least(model, median_salary_mid)"), q4("q4_to_q1_cap_growth_0pct", "least(model, median_salary_mid)"), q4("q4_to_q1_cap_growth_5pct", "least(model, median_salary_mid * 1.05)"),
    q4("q4_to_q1_baseline_minus_5pct", "median_salary_mid * 0.95"), q4("q4_to_q1_baseline_minus_10pct", "median_salary_mid * 0.90"),
    q4("q4_to_q1_historical_transition_mean", "median_salary_mid * rm", "median_salary_mid * rm IS NOT NULL"), q4("q4_to_q1_blend_catboost_historical_mean_0_5", "0.5 * model + 0.5 * (median_salary_mid * rm)", "median_salary_mid * rm IS NOT NULL"),
    q4("q4_to_q1_historical_transition_median", "median_salary_mid * rd", "median_salary_mid * rd IS NOT NULL"),
])
FOLDS = "(SELECT unnest([24000, 24006, 24012, 24015, 24018]) AS fold)"
OVERVIEW = f"count(*) AS segment_count, round(quantile_cont(median_salary_mid, 0.5), 4) AS median_salary_mid, CAST(sum(vacancy_count) AS BIGINT) AS vacancy_count, round({ratio('sum(salary_count)', 'sum(vacancy_count)')}, 6) AS salary_coverage"
FILTERED = "source_dataset IN ('N', 'R') AND region = 'ASIA'"
BUCKET = "CASE WHEN {n} <= 10 THEN 'very_low' WHEN {n} <= 30 THEN 'low' WHEN {n} <= 60 THEN 'medium' WHEN {n} <= 150 THEN 'high' ELSE 'very_high' END"
SP = "[\\t-\\r\\x1c- \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

ORACLES = {
    "cube_monthly": f"{CUBE} SELECT * FROM cube",
    "cube_incremental": f"WITH {STAR}, {cube('source_dataset, quarter_idx, region, occupation_group')} SELECT * FROM cube",
    "cube_share": f"WITH {STAR} SELECT source_dataset, region, {part('is_remote')} AS remote_share, {part('quality_flag_count >= 1')} AS flagged_share FROM star GROUP BY 1, 2",
    "cube_broad_monthly": f"{MONTHLY} SELECT * FROM monthly",
    "cube_quarterly_weighted": f"{QUARTERLY} SELECT *, {QUARTER_LABEL} AS vacancy_quarter FROM quarterly",
    "cube_first_values": f"{CUBE} SELECT {SEGMENT}, min_by(federal_district, lpad(CAST(month_idx AS VARCHAR), 8, '0') || federal_district) AS federal_district, CAST(count(DISTINCT month_idx) AS BIGINT) AS months FROM cube GROUP BY {SEGMENT}",
    "filter_pass_counts": f"""{MONTHLY}, f AS (SELECT salary_count >= 5 AS a, vacancy_count >= 10 AS b, data_quality_score >= 0.5 AS c FROM monthly)
      SELECT 'salary_count' AS filter, count(*) AS rows, count(*) FILTER (a) AS passed, count(*) FILTER (a) AS passed_so_far FROM f UNION ALL SELECT 'vacancy_count', count(*), count(*) FILTER (b), count(*) FILTER (a AND b) FROM f
      UNION ALL SELECT 'data_quality_score', count(*), count(*) FILTER (c), count(*) FILTER (a AND b AND c) FROM f""",
    "monthly_strict_target": f"""{MONTHLY} SELECT {SEGMENT}, month_idx, median_salary_mid, CASE WHEN lead(month_idx) OVER w = month_idx + 1 THEN lead(median_salary_mid) OVER w END AS target_median_salary_mid_t_plus_1,
      CASE WHEN lag(month_idx) OVER w = month_idx - 1 THEN lag(median_salary_mid) OVER w END AS median_salary_mid_lag_1, CASE WHEN lag(month_idx, 2) OVER w = month_idx - 2 THEN lag(median_salary_mid, 2) OVER w END AS median_salary_mid_lag_2
      FROM monthly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY month_idx)""",
    "quarterly_strict_target": f"""{QUARTERLY}, t AS (SELECT *, CASE WHEN lead(quarter_idx) OVER w = quarter_idx + 1 THEN lead(median_salary_mid) OVER w END AS target_median_salary_mid_t_plus_1_quarter, CASE WHEN lag(quarter_idx) OVER w = quarter_idx - 1 THEN lag(median_salary_mid) OVER w END AS median_salary_mid_lag_1q,
      CASE WHEN lag(quarter_idx, 2) OVER w = quarter_idx - 2 THEN lag(median_salary_mid, 2) OVER w END AS median_salary_mid_lag_2q FROM quarterly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY quarter_idx))
      SELECT {SEGMENT}, quarter_idx, median_salary_mid, target_median_salary_mid_t_plus_1_quarter, median_salary_mid_lag_1q, median_salary_mid_lag_2q FROM t WHERE target_median_salary_mid_t_plus_1_quarter IS NOT NULL AND median_salary_mid IS NOT NULL AND months_observed_in_quarter >= 1 AND salary_count >= 2 AND vacancy_count >= 3 AND data_quality_score >= 0.3""",
    "broad_next_observed": f"{OBSERVED} SELECT {SEGMENT}, month_idx, median_salary_mid, target, gap_to, gap_from FROM observed",
    "expanding_stats": f"""{MONTHLY} SELECT {SEGMENT}, month_idx, CAST(row_number() OVER w - 1 AS INT) AS segment_previous_observation_count, {mean("median_salary_mid", "x")} AS segment_previous_salary_mean, round(quantile_cont(median_salary_mid, 0.5) OVER x, 6) AS segment_previous_salary_median,
      round(stddev_samp(median_salary_mid) OVER x, 4) AS segment_previous_salary_std FROM monthly WINDOW {BY_SEGMENT.format(o="month_idx")}""",
    "pct_changes": f"{MONTHLY} SELECT {SEGMENT}, month_idx, {changes('median_salary_mid')}, {changes('vacancy_count')}, {changes('employer_count')} FROM monthly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY month_idx)",
    "seasonal_transition": f"{SEASONAL} SELECT * FROM seasonal",
    "broad_quarterly_dataset": f"""{SEASONAL} SELECT {SEGMENT}, quarter_idx, vacancy_count, median_salary_mid, target AS target_median_salary_mid_next_observed_quarter, gap AS gap_to_target_quarters, quarter_transition, CAST(coalesce({TURN}, FALSE) AS INT) AS is_q4_to_q1, seasonal_transition_previous_count, seasonal_transition_salary_ratio_mean,
      seasonal_transition_salary_ratio_median, round(CASE WHEN target > 0 AND median_salary_mid > 0 THEN ln(target) - ln(median_salary_mid) END, 8) AS target_log_salary_delta
      FROM qtrans LEFT JOIN seasonal USING (quarter_transition, quarter_idx) WHERE target IS NOT NULL AND median_salary_mid IS NOT NULL AND salary_count >= 1 AND vacancy_count >= 2 AND data_quality_score >= 0.2""",
    "support_features": f"""{MONTHLY}, n AS (SELECT {SEGMENT}, month_idx, count(*) OVER (PARTITION BY region) AS region_observation_count, count(*) OVER (PARTITION BY occupation_group) AS occupation_group_observation_count, count(*) OVER (PARTITION BY {SEGMENT}) AS segment_observation_count FROM monthly)
      SELECT *, CASE WHEN region_observation_count >= 60 THEN region ELSE 'rare_region' END AS region_grouped, CASE WHEN occupation_group_observation_count >= 100 THEN occupation_group ELSE 'rare_occupation' END AS occupation_group_grouped, {BUCKET.format(n="region_observation_count")} AS region_support_bucket, {BUCKET.format(n="segment_observation_count")} AS segment_support_bucket FROM n""",
    "residual_target": f"{OBSERVED} SELECT {SEGMENT}, month_idx, round(CASE WHEN target > 0 AND median_salary_mid > 0 THEN ln(target) - ln(median_salary_mid) END, 8) AS target_log_salary_delta FROM observed",
    "time_split_baseline": f"""{OBSERVED}, s AS (SELECT *, dense_rank() OVER (ORDER BY month_idx DESC) AS back FROM observed WHERE target IS NOT NULL), r AS (SELECT *, CASE WHEN back = 1 THEN 'test' WHEN back = 2 THEN 'validation' ELSE 'train' END AS split FROM s)
      SELECT split, 'all' AS subset, {scorecard("target", "median_salary_mid")} FROM r GROUP BY split UNION ALL SELECT split, 'gap_1', {scorecard("target", "median_salary_mid")} FROM r WHERE gap_to = 1 GROUP BY split""",
    "scorecard_by_region": f"{OBSERVED} SELECT region, {scorecard('target', 'model')} FROM predicted GROUP BY region",
    "scorecard_grouping_sets": f"{OBSERVED} SELECT source_dataset, region, concat_ws('+', CASE WHEN grouping(source_dataset) = 0 THEN 'source_dataset' END, CASE WHEN grouping(region) = 0 THEN 'region' END) AS grouping_set, {scorecard('target', 'model')} FROM predicted GROUP BY GROUPING SETS ((source_dataset), (region), (source_dataset, region), ())",
    "compare_model_baseline": f"""{OBSERVED}, c AS (SELECT source_dataset, occupation_group, count(*) AS row_count, round({mean(f"(100.0 * {ratio('abs(model - target)', 'abs(target)')})")}, 4) AS model_mape, round({mean(f"(100.0 * {ratio('abs(median_salary_mid - target)', 'abs(target)')})")}, 4) AS baseline_mape,
      CAST(sum(CASE WHEN target IS NOT NULL AND model IS NOT NULL AND median_salary_mid IS NOT NULL THEN CAST(abs(model - target) < abs(median_salary_mid - target) AS INT) END) AS BIGINT) AS better_rows FROM predicted GROUP BY 1, 2) SELECT *, round(model_mape - baseline_mape, 4) AS mape_delta FROM c WHERE row_count >= 5""",
    "strategy_metrics": f"{OBSERVED}, e AS (SELECT target, unnest([{STRATEGIES}]) AS o FROM predicted) SELECT o.s AS strategy, {scorecard('target', 'o.v')} FROM e GROUP BY 1",
    "q4q1_strategies": f"""{SEASONAL}, p AS (SELECT target, median_salary_mid, 0.9 * median_salary_mid + 1000 AS model, quarter_transition, seasonal_transition_salary_ratio_mean AS rm, seasonal_transition_salary_ratio_median AS rd FROM qtrans LEFT JOIN seasonal USING (quarter_transition, quarter_idx)),
      e AS (SELECT target, unnest([{Q4}]) AS o FROM p) SELECT o.s AS strategy, {scorecard("target", "o.v")} FROM e GROUP BY 1""",
    "naive_backtest_folds": f"{OBSERVED} SELECT fold, CASE WHEN month_idx = fold THEN 'test' WHEN month_idx = fold - 1 THEN 'validation' ELSE 'train' END AS role, {scorecard('target', 'median_salary_mid')} FROM predicted, {FOLDS} WHERE month_idx <= fold GROUP BY 1, 2",
    "fold_summary": f"""{OBSERVED}, e AS (SELECT fold, target, unnest([{STRATEGIES}]) AS o FROM predicted, {FOLDS} WHERE month_idx = fold), m AS (SELECT fold, o.s AS strategy, {scorecard("target", "o.v")} FROM e GROUP BY 1, 2)
      SELECT strategy, count(*) AS folds, round({mean("mape")}, 4) AS mean_mape, round(stddev_pop(mape), 3) AS std_mape, max(mape) AS worst_mape, max_by(fold, mape * 1e6 + fold) AS worst_fold FROM m GROUP BY 1""",
    "group_errors_share": f"{OBSERVED}, g AS (SELECT region, occupation_group, count(*) AS row_count, {total('abs(model - target)')} AS s, round(quantile_cont(abs(model - target), 0.5), 6) AS abs_error_median FROM predicted GROUP BY 1, 2) SELECT region, occupation_group, row_count, round(s, 4) AS abs_error_sum, abs_error_median, round({ratio('s', '(SELECT CAST(sum(CAST(s AS DECIMAL(30,6))) AS DOUBLE) FROM g)')}, 6) AS abs_error_share FROM g",
    "support_slices": f"""{OBSERVED}, e AS (SELECT target, model, unnest(list_filter([CASE WHEN salary_count = 1 THEN 'salary_count_eq_1' END, CASE WHEN salary_count <= 2 THEN 'salary_count_lte_2' END, CASE WHEN vacancy_count <= 2 THEN 'vacancy_count_lte_2' END, CASE WHEN data_quality_score < 0.5 THEN 'data_quality_score_lt_0_5' END,
      CASE WHEN abs(100.0 * {ratio("target - median_salary_mid", "median_salary_mid")}) > 50 THEN 'abs_salary_change_pct_gt_50' END, CASE WHEN 100.0 * {ratio("abs(model - target)", "abs(target)")} > 50 THEN 'catboost_ape_gt_50' END], lambda v: v IS NOT NULL)) AS slice FROM predicted) SELECT slice, {scorecard("target", "model")} FROM e GROUP BY slice""",
    "largest_errors": f"{OBSERVED} SELECT {SEGMENT}, month_idx, target, model, round(abs(model - target), 6) AS abs_error FROM predicted WHERE target IS NOT NULL AND model IS NOT NULL ORDER BY abs_error DESC, source_dataset NULLS LAST, region NULLS LAST, occupation_group NULLS LAST, month_idx NULLS LAST LIMIT 25",
    "period_profile": f"{MONTHLY} SELECT month_idx, count(*) AS rows, CAST(coalesce(sum(vacancy_count), 0) AS BIGINT) AS vacancy_count, round(quantile_cont(median_salary_mid, 0.5), 6) AS median, {mean('median_salary_mid')} AS mean FROM monthly WHERE month_idx BETWEEN 23999 AND 24001 GROUP BY 1",
    "forecast_decision": f"""{Q_OBSERVED} SELECT {SEGMENT}, quarter_idx, round(CASE WHEN coalesce({TURN}, FALSE) THEN least(0.9 * median_salary_mid + 1000, median_salary_mid) ELSE 0.9 * median_salary_mid + 1000 END, 6) AS quarterly, round(0.7 * (0.9 * median_salary_mid + 1000) + 0.3 * median_salary_mid, 6) AS monthly FROM qtrans""",
    "api_filters": f"{MONTHLY} SELECT DISTINCT facet, value FROM (SELECT 'source_dataset' AS facet, CASE WHEN source_dataset IN ('N', 'R') THEN 'nr' ELSE source_dataset END AS value FROM monthly WHERE region = 'ASIA' UNION ALL SELECT 'region', region FROM monthly WHERE source_dataset IN ('N', 'R') UNION ALL SELECT 'occupation_group', occupation_group FROM monthly WHERE {FILTERED} UNION ALL SELECT 'period', {MONTHLY_LABEL} FROM monthly WHERE {FILTERED}) WHERE value IS NOT NULL",
    "api_overview": f"{MONTHLY}, f AS (SELECT *, {MONTHLY_LABEL} AS period FROM monthly WHERE {FILTERED}) SELECT 'monthly' AS granularity, period, {OVERVIEW}, round({mean('data_quality_score')}, 4) AS data_quality_score FROM f WHERE period = (SELECT max(period) FROM f) GROUP BY period",
    "api_trend": f"{MONTHLY} SELECT {MONTHLY_LABEL} AS period, {OVERVIEW.removeprefix('count(*) AS segment_count, ')} FROM monthly WHERE {FILTERED} GROUP BY 1",
    "api_segments": f"{MONTHLY}, f AS (SELECT *, {MONTHLY_LABEL} AS period FROM monthly) SELECT {SEGMENT}, period, median_salary_mid, vacancy_count, salary_count FROM f WHERE period = '1999-12' ORDER BY vacancy_count DESC, median_salary_mid DESC NULLS LAST, source_dataset NULLS LAST, region NULLS LAST, occupation_group NULLS LAST LIMIT 20",
    "api_history": f"{MONTHLY} SELECT {MONTHLY_LABEL} AS period, round(quantile_cont(median_salary_mid, 0.5), 4) AS median_salary_mid, round(quantile_cont(p25_salary_mid, 0.5), 4) AS p25_salary_mid, round(quantile_cont(p75_salary_mid, 0.5), 4) AS p75_salary_mid, CAST(sum(vacancy_count) AS BIGINT) AS vacancy_count, CAST(sum(salary_count) AS BIGINT) AS salary_count, CAST(sum(employer_count) AS BIGINT) AS employer_count FROM monthly WHERE source_dataset IN ('N', 'R') AND region IS NULL AND occupation_group = 'BUILDING' GROUP BY 1",
    "api_forecast_row": f"{MONTHLY} SELECT {SEGMENT}, {MONTHLY_LABEL} AS period, vacancy_count, median_salary_mid FROM monthly WHERE source_dataset IN ('N', 'R') AND region = 'ASIA' AND occupation_group = 'BUILDING' ORDER BY period DESC, vacancy_count DESC, region NULLS LAST LIMIT 1",
    "value_counts": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    "top_values": "SELECT p_brand AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 2) AS pct FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "conditional_counts": "SELECT count(*) FILTER (value > 50) AS n_yes, count(*) FILTER (NOT value > 50) AS n_no, round(quantile_cont(value, 0.5) FILTER (value > 50), 6) AS median_yes, round(quantile_cont(value, 0.5) FILTER (NOT value > 50), 6) AS median_no FROM events",
    "pivot_compare": f"WITH {STAR}, m AS (SELECT occupation_group, count(*) AS n, round(quantile_cont(salary_mid, 0.5) FILTER (is_remote), 6) AS remote, round(quantile_cont(salary_mid, 0.5) FILTER (NOT is_remote), 6) AS onsite FROM star GROUP BY 1) SELECT *, round({ratio('remote - onsite', 'onsite')} * 100, 4) AS pct_difference FROM m WHERE n >= 10",
    "within_group_share": "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 4) AS pct FROM customer GROUP BY 1, 2",
    "two_level_activity": f"WITH {STAR}, e AS (SELECT region, employer_id, count(*) AS n FROM star GROUP BY 1, 2) SELECT region, count(*) AS employers, CAST(sum(n) AS BIGINT) AS vacancies, round(quantile_cont(n, 0.5), 6) AS median, {mean('n')} AS mean FROM e GROUP BY 1",
    "null_profile": f"WITH {STAR} SELECT 'region' AS column, round(100.0 * CAST(count(*) FILTER (region IS NULL) AS DOUBLE) / count(*), 4) AS pct, CASE WHEN pct >= 70 THEN 'critical' WHEN pct >= 30 THEN 'warning' ELSE 'ok' END AS level FROM star UNION ALL SELECT 'salary_mid', round(100.0 * CAST(count(*) FILTER (salary_mid IS NULL) AS DOUBLE) / count(*), 4) AS pct, CASE WHEN pct >= 70 THEN 'critical' WHEN pct >= 30 THEN 'warning' ELSE 'ok' END FROM star",
    "missing_values": "SELECT 'text' AS column, count(*) FILTER (text IS NULL) AS nulls, count(*) FILTER (trim(text) = '') AS empty, CAST(0 AS BIGINT) AS placeholders, '' AS examples FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*) FILTER (trim(lang) = ''), CAST(0 AS BIGINT), '' FROM documents",
    "dup_profile": "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_groups, CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM g",
    "iqr_outliers": "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT count(o_totalprice) AS n, round(max(q1), 6) AS q1, round(max(q3), 6) AS q3, count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1)) AS below, count(*) FILTER (o_totalprice > q3 + 1.5 * (q3 - q1)) AS above FROM orders, q",
    "corr_pairs": "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem",
    "describe": f"SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round({mean('value')}, 4) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 3) AS std FROM events GROUP BY 1",
    "date_coverage": "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1",
    "text_lengths": f"SELECT 'text' AS column, round({mean('length(text)')}, 4) AS mean_length, CAST(max(length(text)) AS BIGINT) AS longest FROM documents UNION ALL SELECT 'source', round({mean('length(source)')}, 4), CAST(max(length(source)) AS BIGINT) FROM documents",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "regex_numbers": "SELECT page_id, array_to_string(regexp_extract_all(url, '([0-9]+)', 1), ',') AS numbers FROM pages",
    "keyword_categories": "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'hard' WHEN p_type IS NULL THEN 'unknown' ELSE 'other' END AS category FROM part",
    "bucket_case": f"SELECT l_suppkey, count(*) AS n, {BUCKET.format(n='count(*)')} AS bucket FROM lineitem GROUP BY 1",
    "row_hash": """SELECT doc_id, sha256('["' || lower(source) || '","' || lower(lang) || '","' || CAST(n_chars AS VARCHAR) || '"]') AS digest FROM documents""",
    "source_keys": "SELECT doc_id, source || ':' || CAST(doc_id AS VARCHAR) AS source_key FROM documents",
    "flag_array": "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda v: v IS NOT NULL), ',') AS flags FROM lineitem",
    "flag_counts": "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount > 0.08 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda v: v IS NOT NULL)) AS flag FROM lineitem) GROUP BY 1",
    "dedup_mark": "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate FROM documents",
    "dup_groups": "WITH g AS (SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1) SELECT key, n, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INT) AS group_number FROM g WHERE n > 1",
    "union_sources": f"WITH {STAR} SELECT source_dataset, region, count(*) AS n FROM star GROUP BY 1, 2",
    "distinct_values": f"WITH {STAR} SELECT DISTINCT region, occupation_group FROM star",
    "unique_segments": f"WITH {STAR} SELECT count(*) AS segments FROM (SELECT DISTINCT {SEGMENT} FROM star)",
    "rolling2": f"""{MONTHLY} SELECT {SEGMENT}, month_idx, CASE WHEN count(median_salary_mid) OVER y = 2 THEN {mean("median_salary_mid", "y")} END AS median_salary_mid_rolling_mean_2, CASE WHEN count(median_salary_mid) OVER y = 2 THEN round(stddev_samp(median_salary_mid) OVER y, 4) END AS median_salary_mid_rolling_std_2
      FROM monthly WINDOW y AS (PARTITION BY {SEGMENT} ORDER BY month_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "group_median_impute": f"{MONTHLY} SELECT {SEGMENT}, month_idx, coalesce(median_salary_mid, round(quantile_cont(median_salary_mid, 0.5) OVER (PARTITION BY source_dataset, occupation_group), 6), (SELECT round(quantile_cont(median_salary_mid, 0.5), 6) FROM monthly)) AS median_salary_mid_imputed FROM monthly",
    "cyclic_month": "SELECT CAST(m AS INT) AS month, round(sin(m * 2.0 * pi() / 12.0), 9) AS month_sin, round(cos(m * 2.0 * pi() / 12.0), 9) AS month_cos FROM range(1, 13) t(m)",
    "last_two_rows": f"{MONTHLY} SELECT * FROM (SELECT {SEGMENT}, month_idx, median_salary_mid, CAST(row_number() OVER (PARTITION BY {SEGMENT} ORDER BY month_idx DESC) AS INT) AS from_last FROM monthly) WHERE from_last <= 2",
    "period_labels": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_label, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter_label FROM orders",
    "date_validity": "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' AS d_is_before_min_date, o_orderdate > TIMESTAMP '2001-01-01' AS d_is_after_max_date, FALSE AS d_has_impossible_year FROM orders",
    "salary_midpoints": "SELECT ps AS p_partkey, CASE WHEN lo > 0 AND hi > 0 AND lo <= hi THEN (lo + hi) / 2 END AS mid, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND (lo <= 0 OR hi <= 0 OR lo > hi) THEN 'invalid' WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'range' WHEN lo > 0 THEN 'lower_only' WHEN hi > 0 THEN 'upper_only' ELSE 'missing' END AS bound_type FROM (SELECT p_partkey AS ps, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice - 1000 END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice - 20 * p_size END AS hi FROM part)",
    "readiness": f"{MONTHLY}, n AS (SELECT *, lead(month_idx) OVER (PARTITION BY {SEGMENT} ORDER BY month_idx) = month_idx + 1 AS nx FROM monthly) SELECT count(*) AS rows, count(*) FILTER (nx) AS rows_with_next, (SELECT count(*) FROM (SELECT DISTINCT {SEGMENT} FROM monthly)) AS segments FROM n",
    "feature_mart": f"WITH {STAR}, g AS (SELECT occupation_group, region, vacancy_month, count(*) AS vacancies, round(quantile_cont(salary_mid, 0.5), 6) AS median_salary, {mean('salary_mid')} AS mean_salary, {part('is_remote')} AS remote_share, count(DISTINCT employer_id) AS employers FROM star GROUP BY 1, 2, 3) SELECT *, lag(median_salary) OVER w AS lag_1, lag(median_salary, 2) OVER w AS lag_2, lead(median_salary) OVER w AS target FROM g WINDOW w AS (PARTITION BY occupation_group, region ORDER BY vacancy_month)",
    "top_share_regions": f"WITH {STAR} SELECT federal_district, count(*) AS n, round(100.0 * {part('is_remote')}, 4) AS remote_pct FROM star GROUP BY 1 HAVING count(*) >= 100 ORDER BY remote_pct DESC, federal_district LIMIT 15",
    "market_mix": "SELECT c_mktsegment AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM customer), 2) AS pct FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 100",
    "event_windows": "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 4) AS mean_value FROM events GROUP BY 1, 2",
}
