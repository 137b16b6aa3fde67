"""The queries of ``forecasts.py`` in SQL, with their constants written out."""

from __future__ import annotations

from cubelark.plans.oracles import FOLDS, OBSERVED, STAR, mean, ratio, scorecard, total

SEGMENT = "source_dataset, region, occupation_group"


def ordered(source: str, categories: dict[str, str], target: str, known: str, weight: float, name: str) -> str:
    """Tables up to ``name``: ``source`` with a column for each category (name: keys)."""
    amount = f"CAST(sum(CAST(t.{target} AS DECIMAL(28,6))) AS DOUBLE)"
    out = [f"{name}_told AS (SELECT *, {known} AS known FROM {source} WHERE {target} IS NOT NULL)"]
    out.append(f"{name}_all AS (SELECT p.month_idx, {amount} / nullif(count(t.{target}), 0) AS prior FROM (SELECT DISTINCT month_idx FROM {source}) p LEFT JOIN {name}_told t ON t.known <= p.month_idx GROUP BY 1)")
    joins, columns = [f"JOIN {name}_all g ON g.month_idx = r.month_idx"], []
    for k, (column, keys) in enumerate(categories.items()):
        names = keys.split(", ")
        same = lambda a, b, names=names: " AND ".join(f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in names)
        listed = ", ".join(f"p.{x}" for x in names)
        out.append(f"{name}_{k} AS (SELECT {listed}, p.month_idx, coalesce({amount}, 0) AS s, count(t.{target}) AS n FROM (SELECT DISTINCT {keys}, month_idx FROM {source}) p LEFT JOIN {name}_told t ON {same('p', 't')} AND t.known <= p.month_idx GROUP BY ALL)")
        joins.append(f"JOIN {name}_{k} o{k} ON {same(f'o{k}', 'r')} AND o{k}.month_idx = r.month_idx")
        columns.append(f"round((o{k}.s + {weight} * g.prior) / (o{k}.n + {weight}), 6) AS {column}")
    out.append(f"{name} AS (SELECT r.*, {', '.join(columns)} FROM {source} r {' '.join(joins)})")
    return ", ".join(out)


SEASONAL = f"""{OBSERVED}, srows AS (SELECT *, month_idx % 12 AS season, round(CASE WHEN target > 0 THEN ln(target) - ln(median_salary_mid) END, 6) AS log_delta FROM predicted WHERE target IS NOT NULL AND median_salary_mid > 0),
{ordered('srows', {'seasonal_delta': 'source_dataset, season'}, 'log_delta', 'month_idx + gap_to', 5.0, 'told')}, sea AS (SELECT *, round(median_salary_mid * exp(coalesce(seasonal_delta, 0)), 4) AS seasonal FROM told)"""
BLENDS = ", ".join(["{'s': 'always_baseline', 'v': median_salary_mid}", "{'s': 'always_catboost', 'v': seasonal}"] + [f"{{'s': 'blend_alpha_{i / 10:.1f}', 'v': {i / 10} * seasonal + (1 - {i / 10}) * median_salary_mid}}" for i in range(11)])
SETS = {"source_dataset": ["source_dataset"], "region": ["region"], "occupation_group": ["occupation_group"], "source_dataset + region + occupation_group": ["source_dataset", "region", "occupation_group"], "gap_to": ["gap_to"]}
GROUPS = ", ".join("{'c': '" + c + "', 'v': " + " || ' | ' || ".join(f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys) + "}" for c, keys in SETS.items())
APE, BASE = f"(100.0 * {ratio('abs(model - target)', 'abs(target)')})", f"(100.0 * {ratio('abs(median_salary_mid - target)', 'abs(target)')})"
ERRORS = f"""{OBSERVED}, fold AS (SELECT * FROM predicted WHERE month_idx = 24018), each AS (SELECT unnest([{GROUPS}]) AS g, target, model, median_salary_mid FROM fold),
errs AS (SELECT g.c AS group_columns, g.v AS group_value, count(*) AS row_count, {total('abs(model - target)')} AS s, round({mean(APE)}, 4) AS model_mape, round({mean(BASE)}, 4) AS baseline_mape,
  round(avg(CAST(abs(model - target) < abs(median_salary_mid - target) AS INT)), 6) AS better_row_share FROM each GROUP BY 1, 2),
groups AS (SELECT group_columns, group_value, row_count, round(s, 4) AS abs_error_sum, model_mape, baseline_mape, better_row_share, round(model_mape - baseline_mape, 4) AS mape_delta, round({ratio('s', f"(SELECT {total('abs(model - target)')} FROM fold)")}, 6) AS abs_error_share FROM errs)"""
FORECASTS_SQL = {
    "ordered_targets": f"{OBSERVED}, rows_of AS (SELECT * FROM predicted WHERE target IS NOT NULL), {ordered('rows_of', {'region_value': 'region', 'occupation_value': 'occupation_group', 'segment_value': SEGMENT}, 'target', 'month_idx + gap_to', 1.0, 'enc')} SELECT {SEGMENT}, month_idx, region_value, occupation_value, segment_value FROM enc",
    "seasonal_folds": f"""{SEASONAL}, e AS (SELECT fold, CASE WHEN month_idx = fold THEN 'test' WHEN month_idx = fold - 1 THEN 'validation' ELSE 'train' END AS role, target, unnest([{{'s': 'baseline', 'v': median_salary_mid}}, {{'s': 'seasonal', 'v': seasonal}}]) AS o FROM sea, {FOLDS} WHERE month_idx <= fold)
      SELECT fold, role, o.s AS strategy, {scorecard('target', 'o.v')} FROM e GROUP BY 1, 2, 3""",
    "strategy_choice": f"""{SEASONAL}, e AS (SELECT fold, target, unnest([{BLENDS}]) AS o FROM sea, {FOLDS} WHERE month_idx = fold), m AS (SELECT fold, strategy, mape FROM (SELECT fold, o.s AS strategy, {scorecard('target', 'o.v')} FROM e GROUP BY 1, 2)),
      b AS (SELECT a.fold, b.strategy, round({mean('b.mape')}, 4) AS earlier_mape FROM (SELECT DISTINCT fold FROM m) a LEFT JOIN m b ON b.fold < a.fold GROUP BY 1, 2), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY fold ORDER BY earlier_mape NULLS LAST, strategy) = 1)
      SELECT c.fold, c.strategy, c.earlier_mape, m.mape AS fold_mape FROM c LEFT JOIN m ON m.fold = c.fold AND m.strategy = c.strategy""",
    "fold_group_errors": f"{ERRORS} SELECT * FROM groups",
    "fold_findings": f"""{ERRORS}, top AS (SELECT 'largest_error_contribution' AS finding, group_columns || '=' || group_value AS place, abs_error_share AS value FROM groups WHERE abs_error_share IS NOT NULL ORDER BY abs_error_share DESC, group_columns, group_value LIMIT 1),
      near AS (SELECT 'model_nearer_than_baseline' AS finding, CAST(NULL AS VARCHAR) AS place, round(count(*) FILTER (abs(model - target) < abs(median_salary_mid - target)) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS value FROM fold),
      above AS (SELECT 'errors_above_bound' AS finding, CAST(NULL AS VARCHAR) AS place, round(count(*) FILTER ({APE} > 50) / nullif(CAST(count(*) AS DOUBLE), 0), 6) AS value FROM fold)
      SELECT *, CASE finding WHEN 'largest_error_contribution' THEN 'Most of the error of one group: ' || place || ' with ' WHEN 'errors_above_bound' THEN 'Rows off by more than 50%: ' ELSE 'Rows nearer than the baseline: ' END || printf('%.1f%%', round(100.0 * value, 1)) AS note FROM (FROM top UNION ALL FROM near UNION ALL FROM above)""",
    "education_composition": f"WITH {STAR}, g AS (SELECT CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'A' ELSE 'B' END AS grp, experience_group AS level, count(*) AS n FROM star GROUP BY 1, 2) SELECT grp, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY grp), 4) AS within_pct FROM g",
    "education_parts": f"""WITH {STAR}, r AS (SELECT CASE WHEN region IN ('ASIA', 'EUROPE') THEN 'A' ELSE 'B' END AS grp, occupation_group, experience_group = '1-URGENT' AS high FROM star),
      g AS (SELECT occupation_group, CAST(count(*) FILTER (grp = 'A') AS DOUBLE) AS n_a, CAST(count(*) FILTER (grp = 'B') AS DOUBLE) AS n_b, CAST(count(*) FILTER (grp = 'A' AND high) AS DOUBLE) AS h_a, CAST(count(*) FILTER (grp = 'B' AND high) AS DOUBLE) AS h_b FROM r GROUP BY 1),
      p AS (SELECT *, n_a / sum(n_a) OVER () AS w_a, n_b / sum(n_b) OVER () AS w_b, coalesce(h_a / nullif(n_a, 0), h_b / nullif(n_b, 0)) AS s_a, coalesce(h_b / nullif(n_b, 0), h_a / nullif(n_a, 0)) AS s_b FROM g)
      SELECT occupation_group, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(100.0 * s_a, 4) AS a_pct, round(100.0 * s_b, 4) AS b_pct, round(100.0 * (s_a - s_b) * (w_a + w_b) / 2, 4) AS within_part, round(100.0 * (w_a - w_b) * (s_a + s_b) / 2, 4) AS mix_part FROM p""",
}
