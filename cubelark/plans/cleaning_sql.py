"""The queries of ``cleaning.py`` in SQL for an independent engine."""

from __future__ import annotations

from cubelark.functions import categories as CAT
from cubelark.functions import text as TX
from cubelark.plans.cleaning import SPELLINGS
from cubelark.plans.oracles import CUBE, MONTHLY, MONTHLY_LABEL, OBSERVED, SEGMENT, STAR, STRATEGIES, mean, ratio, scorecard

#: White space as Unicode has it, as characters.
SP = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def spelt(kind: str) -> str:
    forms = SPELLINGS[kind]
    return f"CAST([{', '.join(map(quoted, forms))}] AS VARCHAR[])[p_partkey % {len(forms)} + 1]"


def parts(*kinds: str) -> str:
    return f"p AS (SELECT p_partkey, {', '.join(f'{spelt(k)} AS raw_{k}' for k in kinds)} FROM part)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def bare(x: str) -> str:
    return f"""regexp_replace(regexp_replace({strip(x)}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""


def squeezed(x: str) -> str:
    return f"regexp_replace({x}, '{SP}+', ' ', 'g')"


def unless(x: str, words) -> str:
    return f"CASE WHEN lower({x}) IN {listed(words)} THEN NULL ELSE {x} END"


def clean(x: str) -> str:
    return unless(squeezed(bare(x)), TX.NULL_PLACEHOLDERS)


def contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def keyword(x: str, groups, default: str, missing: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '{missing}' " + " ".join(f"WHEN {contains(f'lower({x})', words)} THEN '{name}'" for name, words in groups) + f" ELSE '{default}' END"


ALIASES = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in CAT.REGION_ALIASES.items()) + "}"
NUMBER = r"try_cast(replace(regexp_replace({x}, '[^\d,.\-]', '', 'g'), ',', '.') AS DOUBLE)"


def schedule(t: str) -> str:
    order = {"plain": ("full", "part"), "mended": ("part", "full")}
    out = []
    for name, (one, two) in order.items():
        rules = {"full": "(contains({t}, 'полный') OR {t} = 'fullday')", "part": "(contains({t}, 'неполный') OR contains({t}, 'part'))"}
        kinds = {"full": "full_day", "part": "part_time"}
        x = "t" if name == "plain" else "replace(t, 'ё', 'е')"
        remote = contains(x, ("remote", "удален", "дистанц"))
        kind = f"CASE WHEN c IS NULL THEN 'unknown' WHEN {contains(x, ('вахт', 'flyinflyout'))} THEN 'fly_in_fly_out' WHEN {remote} THEN 'remote' WHEN {rules[one].format(t=x)} THEN '{kinds[one]}' WHEN {rules[two].format(t=x)} THEN '{kinds[two]}' WHEN {contains(x, ('гибк', 'flexible'))} THEN 'flexible' WHEN {contains(x, ('смен', 'shift', 'график'))} THEN 'shift' ELSE 'other' END"
        out.append((kind, remote))
    (a, ra), (b, rb) = out
    return f"{a} AS schedule_type, {ra} AS is_remote, {contains('t', ('смен', 'shift', 'график'))} AS is_shift, {contains('t', ('вахт', 'flyinflyout'))} AS is_fly_in_fly_out, {b} AS mended_type, {rb} AS mended_remote"


EXPERIENCE = """x AS (SELECT p_partkey, t, CASE WHEN t IS NULL THEN NULL WHEN t IN ('noexperience', 'нет опыта', 'без опыта', '0') THEN 0.0 WHEN t = 'between1and3' OR contains(t, 'от 1 года до 3 лет') THEN 1.0 WHEN t = 'between3and6' OR contains(t, 'от 3 до 6') THEN 3.0
  WHEN t = 'morethan6' OR contains(t, 'более 6') THEN 6.0 WHEN t = 'between0and1' OR contains(t, 'до 1 года') THEN 0.0 ELSE n[1] END AS lo, CASE WHEN t IS NULL THEN NULL WHEN t IN ('noexperience', 'нет опыта', 'без опыта', '0') THEN 0.0 WHEN t = 'between1and3' OR contains(t, 'от 1 года до 3 лет') THEN 3.0
  WHEN t = 'between3and6' OR contains(t, 'от 3 до 6') THEN 6.0 WHEN t = 'morethan6' OR contains(t, 'более 6') THEN NULL WHEN t = 'between0and1' OR contains(t, 'до 1 года') THEN 1.0 ELSE coalesce(n[2], n[1]) END AS hi
  FROM (SELECT p_partkey, t, list_transform(regexp_extract_all(t, '(\\d+(?:[,.]\\d+)?)', 1), lambda v: try_cast(replace(v, ',', '.') AS DOUBLE)) AS n FROM k))"""

PAY = """n AS (SELECT p_partkey, r, lower(r) AS f, list_transform(regexp_extract_all(r, '(\\d[\\d\\s ]*(?:[,.]\\d+)?)', 1), lambda v: try_cast(replace(regexp_replace(v, '[\\s ]', '', 'g'), ',', '.') AS DOUBLE)) AS v FROM k),
  q AS (SELECT *, len(v) AS c, contains(f, 'от') AS a, contains(f, 'до') AS b FROM n),
  s AS (SELECT p_partkey, r, CASE WHEN a AND b AND c >= 2 THEN v[1] WHEN a AND c >= 1 THEN v[1] WHEN b AND c >= 1 THEN NULL WHEN c >= 1 THEN v[1] END AS salary_from, CASE WHEN a AND b AND c >= 2 THEN v[2] WHEN a AND c >= 1 THEN NULL WHEN b AND c >= 1 THEN v[1] WHEN c >= 2 THEN v[2] END AS salary_to, nullif(regexp_extract(r, '\\b([A-Z]{3})\\b', 1), '') AS salary_currency FROM q)"""


def parsed(x: str) -> str:
    s = strip(x)
    day = f"coalesce(try_strptime({s}, '%d.%m.%Y'), try_strptime({s}, '%d.%m.%Y %H:%M'), try_strptime({s}, '%d.%m.%Y %H:%M:%S'))"
    when = f"CASE WHEN regexp_matches({s}, '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN {day} ELSE try_cast({s} AS TIMESTAMP) END"
    return f"(CASE WHEN year({when}) BETWEEN 1678 AND 2261 THEN {when} END)"


def hashed(*columns: str) -> str:
    return "sha256('[\"' || " + " || '\",\"' || ".join(f"coalesce({squeezed(strip(f'lower(CAST({c} AS VARCHAR))'))}, '')" for c in columns) + " || '\"]')"


CLEANING_SQL = {
    "clean_text": f"WITH {parts('text')} SELECT p_partkey, {clean('raw_text')} AS text, {bare('raw_text')} AS stripped FROM p",
    "clean_salary_and_quoted": f"""WITH {parts('salary', 'quoted')} SELECT p_partkey, {unless(bare('raw_salary'), TX.SALARY_PLACEHOLDERS)} AS salary, {unless(strip(f"regexp_replace({strip('raw_quoted')}, '^" + '"(.*)"' + "$', '\\1')"), TX.QUOTED_PLACEHOLDERS)} AS quoted FROM p""",
    "region_names": f"""WITH {parts('region')}, c AS (SELECT p_partkey, {clean('raw_region')} AS t FROM p), k AS (SELECT *, {strip(squeezed("regexp_replace(translate(lower(t), 'ё.,', 'е  '), '[(][^)]*[)]', '', 'g')"))} AS key FROM c)
      SELECT p_partkey, coalesce({ALIASES}[key], {ALIASES}[regexp_replace(key, '^(обл|область|край|республика|респ)\\s+', '')], {ALIASES}[lower(t)], t) AS name, t IS NULL AS is_unknown FROM k""",
    "occupation_groups": f"WITH {parts('occupation')}, c AS (SELECT p_partkey, {clean('raw_occupation')} AS t FROM p) SELECT p_partkey, {keyword('t', CAT.OCCUPATION_KEYWORDS, CAT.OTHER, CAT.UNKNOWN)} AS occupation_group FROM c",
    "experience_groups": f"""WITH {parts('experience')}, k AS (SELECT p_partkey, lower({clean('raw_experience')}) AS t FROM p), {EXPERIENCE} SELECT p_partkey, CAST(lo AS DOUBLE) AS least_years, CAST(hi AS DOUBLE) AS most_years,
      CASE WHEN lo IS NULL THEN 'unknown' WHEN lo = 0 AND hi = 0 THEN 'no_experience' WHEN lo < 1 AND (hi IS NULL OR hi <= 1) THEN 'up_to_1' WHEN lo < 3 THEN '1_to_3' WHEN lo < 6 THEN '3_to_6' ELSE '6_plus' END AS experience_group FROM x""",
    "schedule_types": f"WITH {parts('schedule')}, c AS (SELECT p_partkey, {clean('raw_schedule')} AS c, coalesce(lower({clean('raw_schedule')}), '') AS t FROM p) SELECT p_partkey, {schedule('t')} FROM c",
    "education_levels": f"WITH {parts('education', 'busy')}, c AS (SELECT *, {clean('raw_education')} AS e, upper({clean('raw_busy')}) AS b FROM p) SELECT p_partkey, {keyword('e', CAT.EDUCATION, 'NONE', 'NONE')} AS education_level, CASE WHEN contains(b, 'УДАЛЁНН') OR contains(b, 'REMOTE') THEN 'REMOTE' WHEN contains(b, 'ПОЛНАЯ') OR contains(b, 'FULL') THEN 'FULL' ELSE raw_busy END AS busy_type FROM c",
    "region_groups": "SELECT n_nationkey, CASE WHEN n_name IN ('GERMANY', 'FRANCE') THEN 'north' WHEN r_name = 'ASIA' THEN 'resort' ELSE 'other' END AS three, CASE WHEN n_name IN ('GERMANY', 'FRANCE') OR r_name = 'ASIA' THEN 'GROUP_A' ELSE 'GROUP_B' END AS two FROM nation JOIN region ON n_regionkey = r_regionkey",
    "booleans_and_numbers": f"""WITH {parts('boolean', 'number', 'year')} SELECT p_partkey, CASE WHEN {strip('lower(raw_boolean)')} IN {listed(TX.TRUE_WORDS)} THEN TRUE WHEN {strip('lower(raw_boolean)')} IN {listed(TX.FALSE_WORDS)} THEN FALSE END AS truth, {NUMBER.format(x='raw_number')} AS number,
      try_cast(regexp_replace(raw_number, '[^\\d.]', '', 'g') AS DOUBLE) AS digits, try_cast(raw_number AS DOUBLE) AS plain, try_cast(nullif(regexp_extract({strip('raw_year')}, '^([+-]?\\d{{3,4}})', 1), '') AS INT) AS year FROM p""",
    "json_ids": f"""WITH {parts('company')}, j AS (SELECT p_partkey, CASE WHEN json_valid(raw_company) AND starts_with(raw_company, '{{') THEN raw_company END AS c FROM p) SELECT p_partkey, coalesce(json_extract_string(c, '$.companyCode'), json_extract_string(c, '$.inn')) AS company_id, json_extract_string(c, '$.educationType') AS education_type FROM j""",
    "zeros_and_lists": f"WITH {parts('list')} SELECT p_partkey, CASE WHEN raw_list IN ('[]', '{{}}') THEN NULL ELSE raw_list END AS list, CAST(nullif(p_partkey % 3, 0) AS INT) AS zero, CAST(p_partkey % 100 AS INT) AS small FROM p",
    "salary_texts": f"WITH {parts('pay')}, k AS (SELECT p_partkey, {unless(bare('raw_pay'), TX.SALARY_PLACEHOLDERS)} AS r FROM p), {PAY} SELECT p_partkey, salary_from, salary_to, salary_currency, CASE WHEN r IS NULL THEN 'missing' WHEN salary_from IS NOT NULL OR salary_to IS NOT NULL THEN 'parsed' ELSE 'unparsed' END AS salary_parse_status FROM s",
    "salary_flags": """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN CAST((p_size - 3) * 60000 AS DOUBLE) END AS a, CASE WHEN p_size % 7 <> 0 THEN CAST((p_size - 10) * 50000 AS DOUBLE) END AS b, ['RUR', 'rub', 'USD', NULL][p_partkey % 4 + 1] AS c FROM part),
      s AS (SELECT *, CASE WHEN a > 0 THEN a END AS low, CASE WHEN b > 0 THEN b END AS high FROM r)
      SELECT p_partkey, low, high, CASE WHEN high IS NULL OR high = low THEN low ELSE (low + high) / 2 END AS mid_or_low, low IS NULL AND high IS NULL AS salary_has_missing_bounds, coalesce(a <= 0, FALSE) OR coalesce(b <= 0, FALSE) AS salary_has_zero_bound, coalesce(low > high, FALSE) AS salary_has_inverted_bounds,
        coalesce(low > 1000000, FALSE) OR coalesce(high > 1000000, FALSE) AS salary_has_extreme_value, coalesce(upper(c) NOT IN ('RUR', 'RUB'), FALSE) AS salary_is_non_rur FROM s""",
    "parse_dates": f"WITH {parts('date')}, w AS (SELECT *, {parsed('raw_date')} AS t FROM p) SELECT p_partkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS parsed, raw_date IS NOT NULL AND {strip('raw_date')} <> '' AND t IS NULL AS failed FROM w",
    "chosen_dates": f"WITH {parts('date')}, w AS (SELECT *, {parsed('raw_date')} AS t FROM p) SELECT p_partkey, strftime(coalesce(t, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2020-02-02' END, TIMESTAMP '2023-03-03'), '%Y-%m-%d') AS vacancy_date, CASE WHEN t IS NOT NULL THEN 'date' WHEN p_partkey % 2 = 0 THEN 'other' ELSE 'last' END AS vacancy_date_column FROM w",
    "text_matches": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_name), 'blue')",
    "clipped": "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 1000.0 WHEN p_retailprice > 1500 THEN 1500.0 ELSE p_retailprice END AS clipped, CASE WHEN p_size > 25 AND p_retailprice > 1200 THEN 1200.0 ELSE p_retailprice END AS smaller FROM part",
    "filled": f"WITH {parts('region', 'occupation')} SELECT p_partkey, coalesce(raw_region, 'UNKNOWN') AS region, coalesce(raw_region, raw_occupation) AS either, CAST(p_partkey % 4 AS INT) AS n FROM p",
    "log_ratio_back": f"{OBSERVED} SELECT {SEGMENT}, month_idx, round(median_salary_mid * exp(ln(target) - ln(median_salary_mid)), 4) AS target FROM observed WHERE target > 0 AND median_salary_mid > 0",
    "canonical_hash": f"SELECT p_partkey, {hashed('p_brand', 'p_partkey', 'p_type', 'p_name', 'p_type', 'p_brand', 'p_name', 'p_size', 'p_size', 'p_partkey')} AS source_row_hash, p_brand || ':fallback:' || {hashed('p_name', 'p_type', 'p_brand', 'p_name', 'p_size', 'p_partkey')} AS source_key FROM part",
    "profile_sections": """WITH r AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS d, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) - 50000 AS BIGINT) END AS s, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS i FROM orders),
      g AS (SELECT d, s, i, count(*) AS n FROM (SELECT d, s, coalesce(i, 'N/A') AS i FROM r) GROUP BY ALL), k AS (SELECT i, count(*) AS n FROM r GROUP BY 1)
      SELECT 'dates' AS section, 'order_date' AS "column", count(*) AS rows, count(d) AS filled, count(*) FILTER (d = 'soon') AS flagged, CAST(0 AS BIGINT) AS groups, min(nullif(d, 'soon')) AS low, max(nullif(d, 'soon')) AS high FROM r
      UNION ALL SELECT 'salaries', 'salary', count(*), count(s), count(*) FILTER (s <= 0), CAST(0 AS BIGINT), CAST(min(s) AS VARCHAR), CAST(max(s) AS VARCHAR) FROM r
      UNION ALL SELECT 'duplicates', 'full_row', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT), count(*) FILTER (n > 1), NULL, NULL FROM g
      UNION ALL SELECT 'duplicates', 'source_id', CAST(sum(n) AS BIGINT), CAST(sum(n) FILTER (i IS NOT NULL) AS BIGINT), CAST(coalesce(sum(n) FILTER (n > 1 AND i IS NOT NULL), 0) AS BIGINT), count(*) FILTER (n > 1 AND i IS NOT NULL), NULL, NULL FROM k""",
    "fallback_dates": """WITH k AS (SELECT c_custkey AS k, printf('%02d', CAST(c_custkey % 28 + 1 AS INT)) AS day, printf('%02d', CAST(c_custkey % 12 + 1 AS INT)) AS month FROM customer)
      SELECT CAST(k AS VARCHAR) AS source_vacancy_id, CASE WHEN k % 10 = 0 THEN '2022-' || month || '-' || day WHEN k % 10 <> 1 THEN '2023-' || month || '-' || day END AS vacancy_date, CASE WHEN k % 10 = 0 THEN day || '.' || month || '.2022' WHEN k % 10 <> 1 THEN day || '/' || month || '/2023' END AS vacancy_date_raw FROM k""",
    "canonical_records": """SELECT 'hh_kaggle:' || CAST(c_custkey AS VARCHAR) AS source_key, '2022-03' AS vacancy_month, CASE WHEN floor(abs(c_acctbal)) > 0 THEN floor(abs(c_acctbal)) END AS salary_from, 'RUR' AS salary_currency, '1_to_3' AS experience_group, 'full_day' AS schedule_type, FALSE AS is_duplicate,
      array_to_string(list_filter([CASE WHEN floor(abs(c_acctbal)) <= 0 THEN 'salary_missing' END, CASE WHEN floor(abs(c_acctbal)) <= 0 THEN 'salary_zero_bound' END, CASE WHEN c_custkey % 5 = 0 THEN 'missing_geography' END], lambda v: v IS NOT NULL), ',') AS flags FROM customer""",
    "canonical_checks": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS null_source_dataset, count(*) FILTER (c_custkey % 5 = 0) AS null_city, 'lat' AS missing_columns FROM customer",
    "processing_report": "SELECT count(*) AS rows_before, count(*) FILTER (o_orderstatus = 'F') AS rows_after, count(*) FILTER (o_orderstatus <> 'F') AS rows_lost FROM orders",
    "merge_audit": "SELECT 'source_dataset' AS what, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'salary_bound_type', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'quality_flags', 'large', count(*) FROM lineitem WHERE l_quantity > 45 HAVING count(*) > 0 UNION ALL SELECT 'quality_flags', 'untaxed', count(*) FROM lineitem WHERE l_tax = 0 HAVING count(*) > 0",
    "result_checks": f"""{CUBE}, c AS (SELECT count(*) AS n, count(*) FILTER (month_idx % 50 <> 0) AS ok, count(*) FILTER (salary_from = 0 OR salary_to = 0) AS zero, count(*) FILTER (source_dataset IS NULL) AS unnamed FROM star), m AS (SELECT sum(vacancy_count) AS counted, count(*) FILTER (vacancy_month IS NULL) AS monthless FROM cube)
      SELECT 'dates_parsed' AS "check", ok >= n * 0.9 AS passed FROM c UNION ALL SELECT 'no_zero_salary', zero = 0 FROM c UNION ALL SELECT 'sources_named', unnamed = 0 FROM c UNION ALL SELECT 'counts_conserved', counted = n FROM c, m UNION ALL SELECT 'months_named', monthless = 0 FROM m UNION ALL SELECT 'rows_saved', TRUE""",
    "schema_differences": "SELECT 'a' AS source, 'comment' AS missing, 'suppkey' AS lacking, count(*) AS rows FROM customer UNION ALL SELECT 'b', 'comment', 'custkey,mktsegment', count(*) FROM supplier",
    "column_issues": "SELECT 'p_partkey' AS column, 'nearly_unique' AS issue UNION ALL SELECT 'fixed', 'constant' UNION ALL SELECT 'blank', 'empty'",
    "dropped_columns": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS half FROM part",
    "column_roles": """WITH u AS (SELECT count(DISTINCT o_totalprice) / count(*) > 0.995 AND count(*) > 1000 AS unique_price FROM orders) SELECT 'o_orderkey' AS column, CASE WHEN count(*) > 1000 THEN 'id' ELSE 'numeric' END AS role FROM orders UNION ALL SELECT 'o_totalprice', CASE WHEN unique_price THEN 'id' ELSE 'numeric' END FROM u
      UNION ALL SELECT 'o_orderdate', 'datetime' UNION ALL SELECT 'o_orderstatus', 'categorical' UNION ALL SELECT 'o_note', CASE WHEN count(*) > 1000 THEN 'id' ELSE 'text' END FROM orders UNION ALL SELECT 'row_id', 'id'""",
    "guessed_columns": "SELECT 'date' AS kind, 'order_date' AS columns, count(*) AS rows, count(o_orderdate) AS filled FROM orders UNION ALL SELECT 'salary', 'salary_total', count(*), count(o_totalprice) FROM orders UNION ALL SELECT 'id', 'order_id,id', count(*), count(o_orderkey) + count(o_custkey) FROM orders",
    "salary_summary": f"""WITH {STAR} SELECT count(*) AS rows, count(salary_from) AS low_filled, min(salary_from) AS low_least, max(salary_from) AS low_most, round({mean("salary_from")}, 4) AS low_mean, count(salary_to) AS high_filled, min(salary_to) AS high_least, max(salary_to) AS high_most, round({mean("salary_to")}, 4) AS high_mean,
      count(*) FILTER (salary_from <= 0 OR salary_to <= 0) AS not_positive, count(*) FILTER (salary_from > salary_to) AS inverted, count(*) FILTER (salary_from > 1000000 OR salary_to > 1000000) AS extreme, count(*) FILTER (salary_from IS NULL AND salary_to IS NULL) AS missing FROM star""",
    "profile_bundle": " UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS column, '{k}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '') AS empty, count(DISTINCT {c}) AS \"distinct\" FROM {t}" for t, c, k in (("part", "p_brand", "string"), ("part", "p_size", "int"), ("documents", "lang", "string"), ("documents", "source", "string"))),
    "random_sample": "SELECT p_partkey, p_brand FROM part ORDER BY sha256(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey LIMIT 4",
    "period_deltas": f"{MONTHLY}, g AS (SELECT month_idx, CAST(sum(vacancy_count) AS BIGINT) AS vacancy_count FROM monthly GROUP BY 1) SELECT month_idx, vacancy_count, vacancy_count - lag(vacancy_count) OVER (ORDER BY month_idx) AS vacancy_count_delta FROM g ORDER BY month_idx DESC LIMIT 18",
    "ranked_candidates": f"{OBSERVED}, e AS (SELECT target, unnest([{STRATEGIES}]) AS o FROM predicted), s AS (SELECT o.s AS strategy, {scorecard('target', 'o.v')} FROM e GROUP BY 1) SELECT strategy, mape, ape_p90 FROM s ORDER BY mape, ape_p90, strategy LIMIT 5",
    "fold_assignment": f"{OBSERVED}, t AS (SELECT DISTINCT month_idx FROM observed WHERE target IS NOT NULL), f AS (SELECT month_idx, CAST(ntile(4) OVER (ORDER BY month_idx) - 1 AS INT) AS fold FROM t) SELECT fold, {scorecard('target', 'median_salary_mid')} FROM observed JOIN f USING (month_idx) WHERE target IS NOT NULL AND fold > 0 GROUP BY fold",
    "feature_availability": f"{MONTHLY} SELECT 'numeric' AS kind, 'median_salary_mid,vacancy_count' AS columns, count(*) AS rows, count(median_salary_mid) + count(vacancy_count) AS filled FROM monthly UNION ALL SELECT 'categorical', 'region', count(*), count(region) FROM monthly UNION ALL SELECT 'missing', 'absent_share,absent_group', count(*), 0 FROM monthly",
    "error_notes": f"""{OBSERVED}, c AS (SELECT region, round({mean(f"(100.0 * {ratio('abs(model - target)', 'abs(target)')})")}, 4) AS a, round({mean(f"(100.0 * {ratio('abs(median_salary_mid - target)', 'abs(target)')})")}, 4) AS b FROM predicted GROUP BY 1)
      SELECT region, coalesce(region, 'all') || ': model MAPE ' || coalesce(printf('%.2f', a), 'none') || ' against ' || coalesce(printf('%.2f', b), 'none') || CASE WHEN coalesce(round(a - b, 4), 0) < 0 THEN ', better' ELSE ', not better' END || ' than the baseline' AS note FROM c""",
    "health_row": f"{MONTHLY} SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS rows, CAST(max(month_idx) AS VARCHAR) AS latest FROM monthly",
    "strict_monthly_filtered": f"""{MONTHLY}, t AS (SELECT *, CASE WHEN lead(month_idx) OVER w = month_idx + 1 THEN lead(median_salary_mid) OVER w END AS nxt, CASE WHEN lag(month_idx) OVER w = month_idx - 1 THEN lag(vacancy_count) OVER w END AS vacancy_count_lag_1 FROM monthly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY month_idx))
      SELECT {SEGMENT}, month_idx, CAST(month_idx // 12 AS INT) AS year, CAST(month_idx % 12 + 1 AS INT) AS month, {MONTHLY_LABEL.replace('month_idx', '(month_idx + 1)')} AS target_vacancy_month, median_salary_mid, nxt AS target_median_salary_mid_t_plus_1, vacancy_count_lag_1 FROM t WHERE nxt IS NOT NULL AND median_salary_mid IS NOT NULL AND salary_count >= 5 AND vacancy_count >= 10 AND data_quality_score >= 0.5""",
    "broad_monthly_dataset": f"""{MONTHLY}, o AS (SELECT *, lead(median_salary_mid) OVER w AS nxt, lead(month_idx) OVER w - month_idx AS gap_to_target_months, month_idx - lag(month_idx) OVER w AS gap_from_previous_observed_month, lag(median_salary_mid) OVER w AS median_salary_mid_lag_1_observed, lag(vacancy_count) OVER w AS vacancy_count_lag_1_observed,
      CAST(row_number() OVER w - 1 AS INT) AS segment_previous_observation_count FROM monthly WINDOW w AS (PARTITION BY {SEGMENT} ORDER BY month_idx)), k AS (SELECT * FROM o WHERE nxt IS NOT NULL AND median_salary_mid IS NOT NULL AND salary_count >= 1 AND vacancy_count >= 2 AND data_quality_score >= 0.2), n AS (SELECT *, count(*) OVER (PARTITION BY region) AS region_observation_count FROM k)
      SELECT {SEGMENT}, month_idx, nxt AS target_median_salary_mid_next_observed_month, gap_to_target_months, gap_from_previous_observed_month, median_salary_mid_lag_1_observed, vacancy_count_lag_1_observed, segment_previous_observation_count, region_observation_count, CASE WHEN region_observation_count >= 60 THEN region ELSE 'rare_region' END AS region_grouped,
        round(CASE WHEN nxt > 0 AND median_salary_mid > 0 THEN ln(nxt) - ln(median_salary_mid) END, 8) AS target_log_salary_delta FROM n""",
    "company_sizes": """WITH s AS (SELECT CASE WHEN c_acctbal < 0 THEN 'MICRO' WHEN c_acctbal < 5000 THEN 'SMALL' WHEN c_acctbal < 9000 THEN 'MIDDLE' ELSE 'LARGE' END AS size FROM customer), o AS (SELECT count(*) AS rows, round(100.0 * count(*) FILTER (size IN ('MICRO', 'SMALL')) / count(*), 4) AS small_pct, round(100.0 * count(*) FILTER (size = 'LARGE') / count(*), 4) AS large_pct FROM s)
      SELECT *, small_pct > 60 AND large_pct < 15 AS holds FROM o""",
    "education_difference": f"""WITH {STAR}, g AS (SELECT coalesce(region IN ('ASIA', 'EUROPE'), FALSE) AS a, experience_group = '1-URGENT' AS high FROM star), o AS (SELECT round(100.0 * count(*) FILTER (a AND high) / count(*) FILTER (a), 4) AS a_pct, round(100.0 * count(*) FILTER (NOT a AND high) / count(*) FILTER (NOT a), 4) AS b_pct FROM g)
      SELECT *, round(a_pct - b_pct, 4) AS difference, round(a_pct - b_pct, 4) >= 20 AS holds FROM o""",
    "prepared_correlations": f"WITH {STAR}, r AS (SELECT *, CASE WHEN quality_flag_count >= 1 THEN salary_mid END AS rare FROM star), " + "f AS (SELECT * FROM r WHERE salary_mid BETWEEN 12000 AND 800000) " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(100.0 * count({c}) / count(*), 4) AS filled_pct, round({mean(c)}, 4) AS mean, round(corr({c}, salary_mid), 4) AS r FROM f HAVING (SELECT 100.0 * count(*) FILTER ({c} IS NULL) / count(*) FROM r) <= 68" for c in ("salary_from", "salary_to", "month_idx", "rare")),
    "numeric_profile": f"WITH {STAR} " + " UNION ALL ".join(f"SELECT '{c}' AS column, round(100.0 * count({c}) / count(*), 4) AS filled_pct, round({mean(c)}, 4) AS mean, round(corr({c}, salary_mid), 4) AS r FROM star" for c in ("salary_from", "salary_to", "month_idx", "quality_flag_count")),
}
