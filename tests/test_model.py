"""Models, searches, artefacts, the rows-only queries and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cubelark import __main__ as cli
from cubelark.operators import metrics as M
from cubelark.plans import model
from cubelark.plans.forecasts import ROWS
from cubelark.plans.rows_only import ROWS_ONLY
from cubelark.sources import readers

DATA = "/root/testdata/sf0.001"
SMALL = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(s, "r", "o", m, 100.0 + 10 * k + m % 12, 101.0 + 10 * k + (m + 1) % 12, 5 + k) for k, s in enumerate("abcd") for m in range(24288, 24312)]
    return spark.createDataFrame(rows, "source_dataset string, region string, occupation_group string, month_idx int, median_salary_mid double, target_median_salary_mid_next_observed_month double, vacancy_count int").cache()


TARGET, NUMERIC, CATEGORICAL = "target_median_salary_mid_next_observed_month", ("median_salary_mid", "vacancy_count"), ("source_dataset",)


def test_model_and_artefacts(spark, panel, tmp_path):
    rows = M.time_split(panel, "month_idx")
    fitted = model.fit(rows, TARGET, NUMERIC, CATEGORICAL, **SMALL)
    found = model.predict(fitted, rows, NUMERIC, CATEGORICAL)
    assert found.count() == rows.count() and found.where("prediction is null").isEmpty()
    top = model.importances(fitted, NUMERIC, CATEGORICAL)
    assert [v for _, v in top] == sorted((v for _, v in top), reverse=True) and {n for n, _ in top} == {*NUMERIC, *CATEGORICAL}
    model.save_artefacts(fitted, spark, str(tmp_path / "m"), NUMERIC, CATEGORICAL, SMALL)
    assert readers.read_json(spark, str(tmp_path / "m/params.json"))["maxDepth"] == 2
    assert readers.read_metrics(spark, str(tmp_path / "m/importances")).count() == 3 and os.path.isdir(tmp_path / "m/model")


def test_searches(panel):
    found = model.grid_search(M.time_split(panel, "month_idx"), TARGET, NUMERIC, CATEGORICAL, {"maxDepth": (1, 3), "maxIter": (2,)})
    assert [(r["mape"], r["mae"]) for r in found] == sorted((r["mape"], r["mae"]) for r in found) and len(found) == 2
    ranked = model.backtest_search(panel, TARGET, NUMERIC, CATEGORICAL, "month_idx", [24309, 24310], {"maxDepth": (1, 3), "maxIter": (2,)}, "median_salary_mid").collect()
    assert len(ranked) == 2 and all(r.folds == 2 for r in ranked)
    assert [(r.mean_mape, r.worst_mape, -r.better_share) for r in ranked] == sorted((r.mean_mape, r.worst_mape, -r.better_share) for r in ranked)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert ROWS_ONLY[name](spark, DATA).count() > 0


def test_command_line(spark, panel, tmp_path, capsys):
    path = str(tmp_path / "panel")
    panel.withColumn("quarter_transition", F.lit("Q1_to_Q2")).write.parquet(path)
    run = lambda *a: cli.main([a[0], path, *a[1:]])
    assert run("baseline", "--kind", "broad-monthly").count() == 3
    assert run("transitions", "--kind", "broad-monthly").count() == 1
    grid = json.dumps({"maxDepth": [1], "maxIter": [2]})
    assert run("tune", "--kind", "broad-monthly", "--grid", grid).count() == 1
    assert run("tune-backtest", "--kind", "broad-monthly", "--periods", "24310", "--grid", grid).count() == 1
    assert run("evaluate", "--target", TARGET, "--model", "median_salary_mid", "--baseline", "median_salary_mid", "--keys", "region").count() == 1
    assert run("errors", "--target", TARGET, "--model", "median_salary_mid", "--keys", "source_dataset", "--output", str(tmp_path / "errors")).count() == 4
    assert spark.read.parquet(str(tmp_path / "errors")).count() == 4
    axes = json.dumps({"depth": [1, 2], "rate": [0.3], "l2": [1.0]})
    for command in ("search", "residual-search"):
        found = run(command, "--kind", "broad-monthly", "--periods", "24310", "--grid", axes, "--stages", "1,2").collect()
        assert sorted((r["depth"], r["iterations"]) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2)] and all(r["mean_mape"] is not None for r in found)
    slices = ("--target", TARGET, "--model", "median_salary_mid", "--baseline", "median_salary_mid", "--keys", "region,source_dataset+region")
    assert run("fold-errors", *slices, "--output", str(tmp_path / "kept"), "--no-save").count() == 5 and not (tmp_path / "kept").exists()
    assert run("fold-findings", *slices).count() == 3
    run("markdown", "--title", "t")
    assert "## t" in capsys.readouterr().out


def test_residual_backtest(spark):
    """Each fold has all strategies, one of them chosen but on the first; equal calls give equal results."""
    first, second = ([tuple(r) for r in ROWS["residual_backtest"](spark, "/root/testdata/sf0.001").orderBy("fold", "strategy").collect()] for _ in range(2))
    assert first == second and first
    chosen = {}
    for r in first:
        chosen[r[0]] = chosen.get(r[0], 0) + r[-1]
    assert [chosen[f] for f in sorted(chosen)] == [0] + [1] * (len(chosen) - 1)


def test_stored_model_is_the_fitted_one(spark):
    from cubelark.plans import rows_only

    got = ROWS_ONLY["model_artefacts"](spark, DATA).collect()
    features = [*rows_only.NUMERIC, *rows_only.CATEGORIES]
    assert [r["place"] for r in got] == list(range(1, len(features) + 1)) and {r["feature"] for r in got} == set(features) and got[0]["depth"] == 4
    assert abs(sum(r["importance"] for r in got) - 1) < 1e-9 and [r["importance"] for r in got] == sorted((r["importance"] for r in got), reverse=True)
    rows = rows_only.training_rows(spark, DATA)
    fitted = model.fit(rows, "target", features, [], maxIter=5, maxDepth=4)
    want = M.evaluate(model.predict(fitted, rows.where("split = 'test'"), features, []), "target", "prediction").first()
    assert all((r["valid_row_count"], r["mape"]) == (want["valid_row_count"], want["mape"]) for r in got)
