"""Cubes, windows, scorecards, strategies and marks on small panels worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cubelark.operators import cube as C
from cubelark.operators import metrics as M
from cubelark.operators import periods as P
from cubelark.operators import profile as PR
from cubelark.operators import quality as Q
from cubelark.operators.serving import Mart
from cubelark.plans import canonical

PANEL = [("s", 24300, 100.0), ("s", 24301, 110.0), ("s", 24303, 121.0), ("s", 24304, 90.0)]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(PANEL, "k string, m int, v double")


def column(df, name, order="m"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_adjacent(panel):
    out = P.adjacent_lags(P.adjacent_target(panel, ["k"], "m", "v", "t"), ["k"], "m", {"l1": ("v", 1), "l2": ("v", 2)})
    assert column(out, "t") == [110.0, None, 90.0, None]
    assert column(out, "l1") == [None, 100.0, None, 121.0]
    assert column(out, "l2") == [None, None, None, None]


def test_observed(panel):
    out = P.observed(panel, ["k"], "m", "v", "t", "to", "since")
    assert column(out, "t") == [110.0, 121.0, 90.0, None]
    assert column(out, "to") == [1, 2, 1, None]
    assert column(out, "since") == [None, 1, 2, 1]


def test_past_statistics(panel):
    out = P.changes(P.past_statistics(panel, ["k"], "m", "v"), ["k"], "m", ["v"])
    assert column(out, "segment_previous_observation_count") == [0, 1, 2, 3]
    assert column(out, "segment_previous_salary_mean") == pytest.approx([None, 100, 105, 110.33333333])
    assert column(out, "segment_previous_salary_median") == [None, 100, 105, 110]
    assert column(out, "segment_previous_salary_std") == [None, None, 7.0711, 10.504]
    assert column(out, "v_pct_change_lag_1") == [None, 0.1, 0.1, -0.256198]


def test_weighted_mean(spark):
    def mean(rows):
        from cubelark.functions.exact import weighted_mean

        return spark.createDataFrame(rows, "v double, w int").agg(weighted_mean(F.col("v"), F.col("w"))).first()[0]

    assert mean([(100.0, 2), (200.0, 0), (None, 5), (400.0, 1)]) == 200
    assert mean([(100.0, 0), (300.0, 0)]) == 200
    assert mean([(None, 1), (None, 2)]) is None


def test_employers(spark):
    rows = spark.createDataFrame([("g", "A"), ("g", "A"), ("g", "B"), ("g", None), (None, None)], "key string, employer_id string")
    got = {r["key"]: (r["vacancy_count"], r["employer_count"], r["top_employer_share"]) for r in C.monthly_cube(rows, ["key"]).collect()}
    assert got == {"g": (4, 2, 0.5), None: (1, 0, 0.0)}


def test_null_keys_join(spark):
    df = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    assert C.null_safe_join(df, df.withColumnRenamed("v", "w"), ["k"]).count() == 2


def test_missing_columns(spark):
    with pytest.raises(KeyError):
        C.monthly_cube(spark.range(1), ["nope"])


def test_cube_conserves_rows(spark):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 5).cast("string")).alias("b"), F.col("id").cast("double").alias("salary_mid"))
    assert C.monthly_cube(rows, ["a", "b"]).agg(F.sum("vacancy_count")).first()[0] == 500
    assert C.monthly_cube(rows.limit(0), ["a", "b"]).count() == 0


def test_scorecard(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (0.0, 10.0), (None, 5.0)], "a double, p double")
    r = M.evaluate(df, "a", "p").first()
    assert (r["row_count"], r["valid_row_count"]) == (4, 3)
    assert [r[k] for k in ("mae", "medae", "rmse", "mape", "smape", "wape", "ape_p90", "bias")] == [13.3333, 10.0, 14.1421, 10.0, 73.35, 13.3333, 10.0, 0.0]


def test_q4_strategies(spark):
    df = spark.createDataFrame([(1,), (0,)], "turn int")
    options = M.q4_strategies(F.lit(120.0), F.lit(100.0), F.col("turn"))
    rows = df.select("turn", *[c.alias(n) for n, c in options.items()]).collect()
    assert list(rows[0])[1:] == pytest.approx([100, 100, 105, 95, 90])
    assert set(list(rows[1])[1:]) == {120.0}
    assert df.select(M.forecast_decision(F.lit(120.0), F.lit(100.0), "monthly")).first()[0] == pytest.approx(114)


def test_folds_and_split(panel):
    folds = M.expanding_folds(panel, "m", [24303, 24304])
    assert {(r["fold"], r["role"], r["n"]) for r in folds.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()} == {(24303, "test", 1), (24303, "train", 2), (24304, "test", 1), (24304, "validation", 1), (24304, "train", 2)}
    assert column(M.time_split(panel, "m"), "split") == ["train", "train", "validation", "test"]


def test_marks_and_flags(spark):
    df = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h2"), (3, None, "h3"), (4, None, "h3"), (5, "b", None), (6, None, None)], "i int, k string, h string")
    got = {r["i"]: (r["is_duplicate"], r["duplicate_group_id"]) for r in Q.mark_duplicates(df, "k", "h").collect()}
    assert got == {1: (True, "key:a"), 2: (True, "key:a"), 3: (True, "hash:h3"), 4: (True, "hash:h3"), 5: (False, None), 6: (False, None)}
    names, n = Q.quality_flags({"x": F.col("i") > 4, "y": F.col("k").isNull()})
    assert [tuple(r) for r in df.orderBy("i").select(F.array_join(names, ","), n).collect()][2:] == [("y", 1), ("y", 1), ("x", 1), ("x,y", 2)]


def test_schema_gate(spark):
    a, b = spark.range(1).select(F.lit(1).alias("r"), F.lit(2).alias("x")), spark.range(1).select(F.lit(1).alias("r"))
    with pytest.raises(ValueError):
        Q.union_sources({"a": a, "b": b}, ["r"])
    assert Q.union_sources({"a": a, "c": a}, ["r"]).columns == ["r", "x"]


def test_serving(spark):
    rows = [("hh_github", None, "o", "2025-01", 10.0, 3, 1), ("hh_kaggle", None, "o", "2025-02", 20.0, 4, 2), ("t", "R", "o", "2025-01", 30.0, 9, 9)]
    df = spark.createDataFrame(rows, "source_dataset string, region string, occupation_group string, p string, median_salary_mid double, vacancy_count long, salary_count long").withColumns({"p25_salary_mid": F.lit(1.0), "p75_salary_mid": F.lit(1.0), "employer_count": F.lit(1), "data_quality_score": F.lit(0.5)})
    mart = Mart(df, "p", "monthly")
    assert mart.overview({"source_dataset": "hh"}).first()["period"] == "2025-02"
    assert mart.overview({"source_dataset": "none"}).count() == 0
    assert [r["period"] for r in mart.history("hh", None, "o").collect()] == ["2025-01", "2025-02"]
    assert {tuple(r) for r in mart.filters({"source_dataset": None, "region": None}).collect()} >= {("source_dataset", "hh"), ("region", "R"), ("period", "2025-01")}
    with pytest.raises(ValueError):
        mart.segments({}, limit=501)
    assert mart.trend({"source_dataset": "'; drop table x"}).count() == 0


def test_canonical(spark):
    raw = spark.createDataFrame([("1", "open", "01.02.2022", "Программист", "ООО", "Москва", "от 100 000 до 150 000 RUR", "between1And3", "Полный день"), ("1", "close", "bad", None, None, None, "0", None, None)], "id string, type string, date_of_post string, title string, company string, location string, salary string, experience string, job_type string")
    out = {r["is_open"]: r for r in canonical.process_source(raw, "hh_kaggle").records.collect()}
    assert out[True]["vacancy_month"] == "2022-02"
    assert out[True]["salary_mid"] == 125000
    assert out[True]["is_duplicate"] and out[False]["is_duplicate"]
    assert {"date_parse_failed", "salary_missing", "missing_title", "missing_geography", "salary_zero_bound"} <= set(out[False]["quality_flags"])
    assert list(canonical.process_source(raw, "hh_kaggle").records.columns[:69]) == list(canonical.CANONICAL)


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), (None, 1), ("n/a", 1)], "s string, c int")
    got = {r["column"]: (r["nulls"], r["empty"], r["placeholders"]) for r in PR.missing_values(df).collect()}
    assert got == {"s": (1, 1, 2), "c": (0, 0, 0)}
    assert {(r["column"], r["issue"]) for r in PR.issues(df).collect()} == {("c", "constant"), ("s", "nearly_unique")}
    assert PR.duplicates(df, ["c"]).first()["surplus_rows"] == 3


def test_expanding_median_is_that_of_a_growing_frame(spark):
    import time

    import numpy as np
    from pyspark.sql import functions as F

    from cubelark.functions.exact import quantile
    from cubelark.operators import periods as P

    rng = np.random.default_rng(1)
    rows = [(None if k % 3 == 0 else f"s{k % 3}", int(t), None if rng.random() < 0.1 else round(float(rng.normal()), 3)) for k in range(3) for t in rng.permutation(60)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    got = P.expanding_median(df, ["s"], "t", "x", "m").withColumn("w", quantile(F.col("x"), 0.5, P.past(["s"], "t"))).collect()
    assert len(got) == 180 and all(r["m"] == r["w"] for r in got)
    many = spark.range(10_000).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.rand(5).alias("x"))
    began = time.time()
    assert P.expanding_median(many, ["s"], "t", "x", "m").agg(F.count("m")).first()[0] == 9_999
    assert time.time() - began < 20


def test_ranks_are_selected_exactly(spark, monkeypatch):
    import numpy as np

    from cubelark.functions import exact

    monkeypatch.setattr(exact, "CELLS", 4)
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=2001), np.repeat([3.0, 7.0], [50, 51]), [5.0], [-1e308, 0.0, 1e308, 1e308], rng.integers(0, 5, 500).astype(float), np.exp(rng.normal(size=300) * 40)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
        at = [0.0, 0.25, 0.5, 0.9, 1.0]
        assert exact.global_quantiles(df, "x", at) == [float(v) for v in np.quantile(np.array(values, float), at)] or np.allclose(exact.global_quantiles(df, "x", at), np.quantile(np.array(values, float), at), rtol=1e-12)
    assert exact.global_quantiles(spark.createDataFrame([], "x double"), "x", [0.5]) == [None]


def test_whole_tables_have_exact_percentiles(spark):
    """Without keys the quantiles are selected by rank; with one key for all rows they come from one state."""
    rows = spark.range(3000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("a"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(997)) / 9.0).alias("p"))
    assert M.evaluate(rows, "a", "p").first() == M.evaluate(rows, "a", "p", ["k"]).drop("k").first()
    assert PR.describe(rows, "p").first() == PR.describe(rows, "p", ["k"]).drop("k").first()
    got = PR.split_summary(rows, F.col("a") > 50, "p").first()
    want = rows.agg(*[F.round(F.percentile(F.when(c, F.col("p")), F.lit(0.5)), 6) for c in (F.col("a") > 50, F.col("a") <= 50)]).first()
    assert abs(got["median_yes"] - want[0]) < 1e-6 and abs(got["median_no"] - want[1]) < 1e-6
    none = PR.split_summary(rows.limit(0), F.col("a") > 50, "p").first()
    assert none["median_yes"] is None and M.evaluate(rows.limit(0), "a", "p").first()["medae"] is None


def test_filled_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, 3, None)], "a int, b int, c string")
    assert [tuple(r) for r in PR.filled(rows, {"some": ["a", "b"], "none": ["z"], "all": ["a", "b", "c"]}).collect()] == [("some", "a,b", 2, 3), ("none", "z", 2, 0), ("all", "a,b,c", 2, 4)]


def test_the_mart_follows_its_tables(spark, tmp_path):
    import shutil

    from cubelark.plans import queries as QS

    for name in ("lineitem", "orders", "customer", "nation", "region"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = QS.mart(spark, str(tmp_path)).data.count()
    assert QS.mart(spark, str(tmp_path)).data.count() == first and len([k for k in QS.MARTS if k[1] == str(tmp_path)]) == 1
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    lines.where("l_returnflag = 'A'").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert 0 < QS.mart(spark, str(tmp_path)).data.count() < first


def test_profile_sections_of_awkward_columns(spark):
    from cubelark.operators import profile as PR

    rows = [("2020-01-02", "10", "a"), ("never", "-1", "a"), (None, "x", " n/a "), ("01.02.2021", None, None), ("2020-01-02", "10", "a")]
    got = {(r["section"], r["column"]): tuple(r)[2:] for r in PR.sections(spark.createDataFrame(rows, "at_date string, salary string, id string"), ["at_date"], ["salary"], ["id"]).collect()}
    assert got[("dates", "at_date")] == (5, 4, 1, 0, "2020-01-02", "2021-02-01")
    assert got[("salaries", "salary")] == (5, 3, 1, 0, "-1", "10")
    assert got[("duplicates", "full_row")] == (5, 5, 2, 1, None, None)
    assert got[("duplicates", "id")] == (5, 3, 3, 1, None, None)
    none = PR.sections(spark.createDataFrame([], "id string"), [], [], ["id"]).collect()
    assert [tuple(r)[2:6] for r in none] == [(0, 0, 0, 0)] * 2
