"""The cleaning layer as queries: each part gets one of a few raw spellings, by its key, and each function is applied to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubelark.functions import categories as CAT
from cubelark.functions import dates as DT
from cubelark.functions import money as MON
from cubelark.functions import text as TX
from cubelark.functions.exact import rounded
from cubelark.operators import cube as C
from cubelark.operators import metrics as M
from cubelark.operators import periods as P
from cubelark.operators import profile as PR
from cubelark.operators import quality as Q
from cubelark.operators import serving
from cubelark.plans import canonical as CN
from cubelark.plans import datasets as D
from cubelark.plans import model
from cubelark.plans.queries import Query, cube, monthly, observed, predicted
from cubelark.plans.star import SEGMENT, records, table

CLEANING: dict[str, Query] = {}

#: Raw spellings by kind of column.
SPELLINGS: dict[str, tuple[str | None, ...]] = {
    "text": ("  Инженер   ПТО ", '"Кассир"', "'повар'", "n/a", "Не Указано", "", " - ", None, "а б\tв", '""', "NULL", "value", '  "" x ""  '),
    "salary": ("з/п не указана", " 'от  100' ", "None", "не задано", None, '"5 000"', "", "nan"),
    "quoted": ('"HR"', ' " a b " ', "none", '"nan"', None, 'x"y', "", "'q'"),
    "region": ("г. Москва", "Республика Адыгея (Адыгея)", "обл. Тверская", "Ханты-Мансийский АО - Югра", "  САНКТ-ПЕТЕРБУРГ ", "не указано", None, "Город  Севастополь", "Край Камчатский", "респ. Москва", "Тула"),
    "occupation": ("Старший разработчик", "Бизнес-аналитик", "Продавец-кассир", "Врач", "Водитель", "Слесарь", "Повар", "Секретарь", "Прораб", "Учитель", "Астроном", "-", None, "Data Scientist", "BI developer"),
    "experience": ("noExperience", "Нет опыта", "between1And3", "от 3 до 6 лет", "Более 6 лет", "до 1 года", "2", "1,5 года", "от 2 до 4", "7", "без слов", None, "n/a", "0"),
    "schedule": ("Полный день", "fullDay", "Удалённая работа", "удаленно", "Сменный график", "вахта", "Гибкий", "Неполный день", "part", "flyInFlyOut", "shift", "иное", None, "remote"),
    "education": ("Высшее", "Среднее профессиональное", "СПО", "Среднее общее", "11 классов", "не указано", None, "Магистратура", "курсы", "Техникум"),
    "busy": ("Удалённая занятость", "Полная занятость", "remote", "FULL", "Частичная", None, "нет"),
    "boolean": ("true", "Да", " 1 ", "NO", "нет", "0", "maybe", None, "False", "YES", ""),
    "number": ("1 200,50", "-3", "abc", "12.5.1", None, "", "5000 руб.", "1-2", "7,"),
    "year": ("2024-01-02", "  199x", "-045", "20", "+2030 г.", None, "abc", "3000"),
    "company": ('{"companyCode":"c1","inn":"i1"}', '{"inn":"i2"}', "{}", "bad", None, '{"companyCode":null,"inn":"i3"}', '{"educationType":"Высшее"}', "[1]"),
    "pay": ("от 100 до 200 RUR", "до 300 USD", "от 50", "1 000 - 2 000 EUR", "100,5", "по договорённости", "з/п не указана", None, "отпуск 30", "до 5 от 7 KZT"),
    "date": ("2024-03-05", "05.03.2024", "5.3.2024 10:20", "2024-03-05 10:20:30", "31.02.2024", "bad", "", None, "1500-01-01", "  2024-12-31 ", "01.01.2022 1:02:03"),
    "list": ("[]", "{}", "[1]", "", None, "x"),
}


def query(f: Query) -> Query:
    CLEANING[f.__name__] = f
    return f


def spelt(kind: str) -> Column:
    """The spelling of a part's row."""
    forms = SPELLINGS[kind]
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))


def parts(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *[spelt(k).alias(k) for k in kinds])


@query
def clean_text(spark, d):
    """STR-01 to STR-03."""
    p = parts(spark, d, "text")
    return TX.normalize_nulls(p.withColumn("stripped", TX.strip_quotes(F.col("text"))), ["text"])


@query
def clean_salary_and_quoted(spark, d):
    """STR-04, STR-05."""
    return parts(spark, d, "salary", "quoted").select("p_partkey", TX.clean_salary_text(F.col("salary")).alias("salary"), TX.clean_quoted(F.col("quoted")).alias("quoted"))


@query
def region_names(spark, d):
    """CAT-01, MAP-01."""
    name, unknown = CAT.region(F.col("region"))
    return parts(spark, d, "region").select("p_partkey", name.alias("name"), unknown.alias("is_unknown"))


@query
def occupation_groups(spark, d):
    """CAT-02."""
    return parts(spark, d, "occupation").select("p_partkey", CAT.occupation(F.col("occupation")).alias("occupation_group"))


@query
def experience_groups(spark, d):
    """CAT-03."""
    low, high, group = CAT.experience(F.col("experience"))
    return parts(spark, d, "experience").select("p_partkey", low.alias("least_years"), high.alias("most_years"), group.alias("experience_group"))


@query
def schedule_types(spark, d):
    """CAT-04, in the default reading and in the mended one."""
    p = parts(spark, d, "schedule")
    kind, remote, shift, fly = CAT.schedule(F.col("schedule"))
    mended, mended_remote, _, _ = CAT.schedule(F.col("schedule"), fold_yo=True, part_time_first=True)
    return p.select("p_partkey", kind.alias("schedule_type"), remote.alias("is_remote"), shift.alias("is_shift"), fly.alias("is_fly_in_fly_out"), mended.alias("mended_type"), mended_remote.alias("mended_remote"))


@query
def education_levels(spark, d):
    """CAT-06, CAT-12."""
    return parts(spark, d, "education", "busy").select("p_partkey", CAT.education(F.col("education")).alias("education_level"), CAT.busy_type(F.col("busy")).alias("busy_type"))


@query
def region_groups(spark, d):
    """CAT-07, CAT-08: named nations, then those of a region, then the rest."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    three = CAT.in_group(F.col("n_name"), ("GERMANY", "FRANCE"), F.col("r_name"), ("ASIA",), "north", "resort", "other")
    two = CAT.in_group(F.col("n_name"), ("GERMANY", "FRANCE"), F.col("r_name"), ("ASIA",), "GROUP_A", None, "GROUP_B")
    return n.select("n_nationkey", three.alias("three"), two.alias("two"))


@query
def booleans_and_numbers(spark, d):
    """BOOL-01, CAST-01, CAST-02, STR-10, STR-13."""
    p = parts(spark, d, "boolean", "number", "year")
    return p.select("p_partkey", TX.to_boolean(F.col("boolean")).alias("truth"), TX.to_number(F.col("number")).alias("number"), TX.digits_only(F.col("number")).alias("digits"), F.col("number").try_cast("double").alias("plain"), TX.leading_year(F.col("year")).alias("year"))


@query
def json_ids(spark, d):
    """JSON-02, JSON-03."""
    return parts(spark, d, "company").select("p_partkey", TX.company_id(F.col("company")).alias("company_id"), TX.education_type(F.col("company")).alias("education_type"))


@query
def zeros_and_lists(spark, d):
    """NULL-01, STR-11, CAST-03: zeros and empty lists to null, small types."""
    p = parts(spark, d, "list").withColumns({"zero": F.col("p_partkey") % 3, "small": (F.col("p_partkey") % 100).cast("tinyint")})
    return TX.empty_lists_to_null(TX.normalize_zero_to_null(p, ["zero", "absent"])).select("p_partkey", "list", F.col("zero").cast("int").alias("zero"), F.col("small").cast("int").alias("small"))


@query
def salary_texts(spark, d):
    """MTH-07."""
    p = parts(spark, d, "pay")
    return p.select("p_partkey", *[c.alias(n) for n, c in MON.parse_salary(F.col("pay")).items()])


@query
def salary_flags(spark, d):
    """MTH-02 to MTH-04."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, (F.col("p_size") - 3) * 60_000.0).alias("a"), F.when(F.col("p_size") % 7 != 0, (F.col("p_size") - 10) * 50_000.0).alias("b"), F.element_at(F.array(F.lit("RUR"), F.lit(" rub "), F.lit("USD"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("c"))
    p = p.withColumns({"low": MON.positive(F.col("a")), "high": MON.positive(F.col("b"))})
    flags = MON.salary_flags(F.col("low"), F.col("high"), F.col("a"), F.col("b"), F.trim("c"))
    return p.select("p_partkey", "low", "high", MON.midpoint_or_low(F.col("low"), F.col("high")).alias("mid_or_low"), *[c.alias(n) for n, c in flags.items()])


@query
def parse_dates(spark, d):
    """DT-01, DT-02."""
    when = DT.parse_date(F.col("date"))
    return parts(spark, d, "date").select("p_partkey", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("parsed"), DT.parse_failed(F.col("date"), when).alias("failed"))


@query
def chosen_dates(spark, d):
    """DT-03: the first of a source's candidate columns that parses, and which one it was."""
    p = parts(spark, d, "date").withColumns({"other": F.when(F.col("p_partkey") % 2 == 0, F.lit("2020-02-02")), "last": F.lit("03.03.2023")})
    when, name = DT.first_date({n: F.col(n) for n in ("date", "other", "last")})
    return p.select("p_partkey", F.date_format(when, "yyyy-MM-dd").alias("vacancy_date"), name.alias("vacancy_date_column"))


@query
def text_matches(spark, d):
    """STR-09: rows in whose title one of two words occurs."""
    return table(spark, d, "part").where(F.lower("p_name").rlike("green|blue")).select("p_partkey")


@query
def clipped(spark, d):
    """MTH-06: values held between bounds, and the smaller of two; nulls are passed over."""
    x = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.least(F.greatest(x, F.lit(1000.0)), F.lit(1500.0)).alias("clipped"), F.least(x, F.when(F.col("p_size") > 25, F.lit(1200.0))).alias("smaller"))


@query
def filled(spark, d):
    """NULL-02, NULL-04: constants for nulls, and the first of two columns that has a value."""
    p = parts(spark, d, "region", "occupation").withColumn("n", F.nullif(F.col("p_partkey") % 4, F.lit(0)))
    return p.select("p_partkey", F.coalesce("region", F.lit("UNKNOWN")).alias("region"), F.coalesce("region", "occupation").alias("either"), F.coalesce("n", F.lit(0)).cast("int").alias("n"))


@query
def log_ratio_back(spark, d):
    """MTH-05: a log ratio taken back to the value that it came from."""
    o = observed(spark, d).where("target > 0 and median_salary_mid > 0")
    delta = MON.log_ratio(F.col("target"), F.col("median_salary_mid"))
    return o.select(*SEGMENT, "month_idx", rounded(MON.from_log_ratio(delta, F.col("median_salary_mid")), 4).alias("target"))


@query
def canonical_hash(spark, d):
    """HASH-01, HASH-02: the row hash over its ten columns, and the key without an identifier."""
    p = table(spark, d, "part").select("p_partkey", *[F.col(c).cast("string").alias(n) for n, c in zip(Q.HASH_COLUMNS, ("p_brand", "p_partkey", "p_type", "p_name", "p_type", "p_brand", "p_name", "p_size", "p_size", "p_partkey"), strict=True)])
    fallback = [F.col(c) for c in ("title_raw", "employer_name", "region", "city", "vacancy_date_raw", "salary_to")]
    return p.select("p_partkey", Q.row_hash([F.col(c) for c in Q.HASH_COLUMNS]).alias("source_row_hash"), Q.source_key(F.col("source_dataset"), F.lit(" "), fallback).alias("source_key"))


def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a raw source."""
    c = table(spark, d, "customer")
    pay = F.concat(F.lit("от "), F.floor(F.abs("c_acctbal")).cast("string"), F.lit(" RUR"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("open").alias("type"), F.lit("2022-03-04").alias("date_of_post"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("company"), F.when(F.col("c_custkey") % 5 != 0, F.lit("Москва")).alias("location"), pay.alias("salary"), F.lit("between1And3").alias("experience"), F.lit("Полный день").alias("job_type"), F.lit("").alias("description"), F.lit("").alias("key_skills"))


@query
def fallback_dates(spark, d):
    """DT-03 in the canonical plan: the source's usual column is missing, the next candidate holds dates with slashes, read by what the column looks like."""
    c, key = raw_customers(spark, d), F.col("id").cast("int")
    slashed = F.format_string("%02d/%02d/2023", key % 28 + 1, key % 12 + 1)
    raw = c.drop("date_of_post").withColumn("published_at_raw", F.when(key % 10 == 0, F.format_string("%02d.%02d.2022", key % 28 + 1, key % 12 + 1)).when(key % 10 != 1, slashed))
    return CN.process_source(raw, "hh_kaggle").records.select("source_vacancy_id", F.date_format("vacancy_date", "yyyy-MM-dd").alias("vacancy_date"), "vacancy_date_raw")


@query
def canonical_records(spark, d):
    """The canonical plan of a source, end to end."""
    return CN.process_source(raw_customers(spark, d), "hh_kaggle").records.select("source_key", "vacancy_month", "salary_from", "salary_currency", "experience_group", "schedule_type", "is_duplicate", F.array_join("quality_flags", ",").alias("flags"))


@query
def canonical_checks(spark, d):
    """DQ-06: columns missing and added, nulls of the required ones."""
    out = CN.process_source(raw_customers(spark, d), "hh_kaggle").records.drop("lat")
    return Q.validate_canonical(out, CN.CANONICAL, ("source_dataset", "city")).select("rows", "null_source_dataset", "null_city", "missing_columns")


@query
def processing_report(spark, d):
    """DQ-08."""
    o = table(spark, d, "orders")
    return Q.processing_report(o, o.where("o_orderstatus = 'F'"))


@query
def merge_audit(spark, d):
    """DQ-09."""
    f, _ = Q.quality_flags({"large": F.col("l_quantity") > 45, "untaxed": F.col("l_tax") == 0})
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source_dataset"), F.col("l_linestatus").alias("salary_bound_type"), f.alias("quality_flags"))
    return Q.merge_audit(rows, ("source_dataset", "salary_bound_type"))


@query
def result_checks(spark, d):
    """DQ-10: the checks of a finished run against its cube."""
    r = records(spark, d)
    rows = r.select("source_dataset", "salary_from", "salary_to", F.col("vacancy_month").alias("vacancy_date_raw"), F.when(F.col("month_idx") % 50 != 0, F.col("vacancy_month")).alias("vacancy_date"))
    return Q.validate_result(rows, cube(spark, d))


@query
def schema_differences(spark, d):
    """DQ-07, SET-05: columns that sources lack, and the rows that this concerns."""
    frames = {n: table(spark, d, t) for n, t in (("a", "customer"), ("b", "supplier"))}
    frames = {n: f.toDF(*[c.split("_", 1)[1] for c in f.columns]) for n, f in frames.items()}
    gate = Q.schema_gate(frames, ("name", "comment"))
    return Q.gate_report(frames, gate)


@query
def column_issues(spark, d):
    """DQ-13."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.lit("x").alias("fixed"), F.lit(None).cast("string").alias("blank"))
    return PR.issues(p)


@query
def dropped_columns(spark, d):
    """FLT-08: columns with too many nulls and named ones go."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).alias("sparse"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("half"))
    return PR.drop_sparse(p, also=("p_brand",))


@query
def column_roles(spark, d):
    """CAT-11, CAT-13."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", F.concat_ws(" ", F.lit("a comment that is long enough to count as running text"), F.col("o_orderkey").cast("string")).alias("o_note"), F.col("o_orderkey").alias("row_id"))
    return PR.roles(o)


@query
def guessed_columns(spark, d):
    """CAT-13: by the names, with the values that the columns hold."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("salary_total"), F.col("o_custkey").alias("id"))
    return PR.filled(o, PR.guess_columns(o))


@query
def salary_summary(spark, d):
    """DQ-03: bounds, midpoints and outliers of salaries in one table."""
    return PR.salary_summary(records(spark, d), "salary_from", "salary_to")


@query
def profile_bundle(spark, d):
    """DQ-04: profiles of several sources in one table."""
    return PR.profile_all({"part": table(spark, d, "part").select("p_brand", "p_size"), "documents": table(spark, d, "documents").select("lang", "source")})


@query
def profile_sections(spark, d):
    """DQ-04: dates, salaries and duplicates of a source whose columns are found by their names."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    raw = o.select(F.when(key % 7 != 0, F.when(key % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("order_date"), F.when(key % 3 != 0, F.floor("o_totalprice") - 50000).cast("string").alias("salary"), F.when(key % 11 == 0, F.lit("N/A")).otherwise(F.col("o_custkey").cast("string")).alias("source_id"))
    found = PR.guess_columns(raw)
    return PR.sections(raw, found["date"], found["salary"], found["id"])


@query
def random_sample(spark, d):
    """RSH-03: the same rows for a seed, whatever the partitions."""
    return PR.sample(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 4, seed=42)


@query
def period_deltas(spark, d):
    """WIN-14: change against the period before, the last rows first."""
    m = monthly(spark, d).groupBy("month_idx").agg(F.sum("vacancy_count").cast("bigint").alias("vacancy_count"))
    return P.last_deltas(m, "month_idx", ["vacancy_count"], 18)


@query
def ranked_candidates(spark, d):
    """SORT-04: strategies by error, ties by the worst error."""
    scores = M.evaluate_strategies(predicted(spark, d), "target", M.strategies(F.col("model"), F.col("median_salary_mid"))).select("strategy", "mape", "ape_p90")
    return scores.orderBy("mape", "ape_p90", "strategy").limit(5)


@query
def fold_assignment(spark, d):
    """ML-14: folds of consecutive periods, and the naive error of each."""
    rows = model.time_series_splits(observed(spark, d).where("target is not null"), "month_idx", 3).where("fold > 0")
    return M.evaluate(rows, "target", "median_salary_mid", ["fold"])


@query
def feature_availability(spark, d):
    """ML-06: the features that there are, with their values."""
    rows = monthly(spark, d)
    return PR.filled(rows, model.setup(rows, ("median_salary_mid", "vacancy_count", "absent_share"), ("region", "absent_group")))


@query
def error_notes(spark, d):
    """EVAL-10: a sentence for each group, made in the plan."""
    found = M.compare(predicted(spark, d), "target", "model", "median_salary_mid", ["region"])
    return found.select("region", M.note(F.coalesce("region", F.lit("all"))).alias("note"))


@query
def health_row(spark, d):
    """API-07: alive if the mart can be read."""
    return serving.Mart(monthly(spark, d), "month_idx", "monthly").health()


@query
def strict_monthly_filtered(spark, d):
    """ML-01 with its filters."""
    out = D.strict_monthly(monthly(spark, d), SEGMENT)
    return out.select(*SEGMENT, "month_idx", "year", "month", "target_vacancy_month", "median_salary_mid", D.MONTHLY_TARGET, "vacancy_count_lag_1")


@query
def broad_monthly_dataset(spark, d):
    """ML-03."""
    out = D.broad_monthly(cube(spark, d), SEGMENT)
    return out.select(*SEGMENT, "month_idx", D.BROAD_MONTHLY_TARGET, "gap_to_target_months", "gap_from_previous_observed_month", "median_salary_mid_lag_1_observed", "vacancy_count_lag_1_observed", "segment_previous_observation_count", "region_observation_count", "region_grouped", rounded("target_log_salary_delta", 8).alias("target_log_salary_delta"))


@query
def company_sizes(spark, d):
    """H-01: the share of each size, and whether small ones are above 60 and large ones below 15 per cent."""
    size = F.when(F.col("c_acctbal") < 0, "MICRO").when(F.col("c_acctbal") < 5000, "SMALL").when(F.col("c_acctbal") < 9000, "MIDDLE").otherwise("LARGE")
    return M.size_hypothesis(table(spark, d, "customer").select(size.alias("size")), "size", ("MICRO", "SMALL"), "LARGE")


@query
def education_difference(spark, d):
    """H-02: the share of a level in two groups and their difference in points, with whether it reaches 20."""
    r = records(spark, d).select(F.when(F.col("region").isin("ASIA", "EUROPE"), "GROUP_A").otherwise("GROUP_B").alias("group"), (F.col("experience_group") == "1-URGENT").alias("high"))
    return M.share_difference(r, "group", F.col("high"), "GROUP_A", "GROUP_B", 20.0)


@query
def prepared_correlations(spark, d):
    """H-06: the columns that are filled often enough, over salaries within bounds."""
    r = records(spark, d).withColumn("rare", F.when(F.col("quality_flag_count") >= 1, F.col("salary_mid")))
    return PR.prepared_against(r, "salary_mid", ["salary_from", "salary_to", "month_idx", "rare"])


@query
def numeric_profile(spark, d):
    """H-06: filled share, mean and correlation with the salary of each numeric column."""
    return PR.against(records(spark, d), "salary_mid", ["salary_from", "salary_to", "month_idx", "quality_flag_count"])
