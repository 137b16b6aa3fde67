import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark.operators.encoding import ordered_target
from cubelark.plans import boosting as B


def panel(spark, n=600, regions=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        region, t = int(rng.integers(regions)), int(rng.integers(0, 12))
        x = float(rng.normal())
        rows.append((k, None if region == 0 else f"r{region}", t, t + int(rng.integers(1, 4)), x, None if k % 17 == 0 else round(region * 2.0 + 3 * (x > 0.2) + 0.1 * float(rng.normal()), 6)))
    return rows, spark.createDataFrame(rows, "id long, region string, t int, known int, x double, y double")


def test_ordered_target_is_a_prefix_mean(spark):
    rows, df = panel(spark)
    got = {r["id"]: r["e"] for r in ordered_target(df, {"e": ["region"]}, "y", "t", F.col("known"), weight=2.0).collect()}
    assert len(got) == len(rows)
    for i, region, t, *_ in rows:
        seen = [(r[1], r[5]) for r in rows if r[3] <= t and r[5] is not None]
        if not seen:
            assert got[i] is None
            continue
        own = [y for g, y in seen if g == region]
        prior = sum(y for _, y in seen) / len(seen)
        assert got[i] == pytest.approx((sum(own) + 2 * prior) / (len(own) + 2), abs=2e-6)


def test_a_thousand_categories_train(spark):
    rows, df = panel(spark, n=3000, regions=1000)
    data = B.matrix(df, "y", ["x"], {"region_value": ["region"]}, "t", 10, ["id", "y"], F.col("known"))
    fits = B.fit_many(data, [10], [B.Candidate(4, 0.3, 1.0)], 6)
    assert len(fits) == 1 and fits[0].errors[-1] < 0.8 * fits[0].errors[0]
    out = B.predict_many(data, fits, [6], ["id", "y"])
    assert out.count() == sum(r[2] == 10 for r in rows)


def plain_fit(x, y, train, depth, rate, l2, iterations):
    """One model's trees, row by row, with the same bins and units."""
    score = np.zeros(len(y), np.int64)
    for _ in range(iterations):
        rest, leaf = y - score, np.zeros(len(y), int)
        for level in range(depth):
            best = None
            for f in range(x.shape[1]):
                for b in range(B.BINS - 1):
                    gain = 0.0
                    for k in range(1 << level):
                        for side in (x[:, f] <= b, x[:, f] > b):
                            rows = train & (leaf == k) & side
                            gain += float(rest[rows].sum()) ** 2 / (rows.sum() + l2)
                    if best is None or gain > best[0] * (1 + 1e-12):
                        best = (gain, f, b)
            leaf |= (x[:, best[1]] > best[2]).astype(int) << level
        for k in range(1 << depth):
            rows = train & (leaf == k)
            score[leaf == k] += int(np.rint(rate * float(rest[rows].sum()) / (rows.sum() + l2)))
    return score


def test_many_fits_equal_single_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    rows, df = panel(spark, n=200, regions=6)
    data = B.matrix(df, "y", ["x"], {"region_value": ["region"]}, "t", 9, ["id"], F.col("known"))
    candidates = [B.Candidate(2, 0.5, 1.0), B.Candidate(3, 0.2, 5.0)]
    fits = B.fit_many(data, [9, 11], candidates, 3)
    assert [(m.candidate, m.fold, len(m.trees), len(m.errors)) for m in fits] == [(0, 9, 3, 4), (0, 11, 3, 4), (1, 9, 3, 4), (1, 11, 3, 4)]
    all_rows = data.rows.collect()
    x, order = np.array([r["_x"] for r in all_rows]), np.array([r["_order"] for r in all_rows])
    known = np.array([r["_y"] is not None for r in all_rows])
    y = np.array([r["_y"] or 0 for r in all_rows])
    for m in fits:
        expected = plain_fit(x, y, known & (order < m.fold - 1), m.depth, m.rate, m.l2, 3)
        got = np.zeros(len(y), np.int64)
        for t in m.trees:
            got += t.values[B._leaves(x, t.features, t.bounds)]
        assert (np.abs(got - expected) <= 3).all()
        seen = known & (order == m.fold - 1)
        assert m.errors[-1] == pytest.approx(np.sqrt(((y - got)[seen] ** 2.0).mean()) * data.unit)


def test_folds_without_validation_are_left_out(spark):
    _, df = panel(spark)
    data = B.matrix(df, "y", ["x"], {}, "t", 9, ["id"])
    assert [m.fold for m in B.fit_many(data, [0, 1, 5, 90], [B.Candidate(1)], 1)] == [5]


def test_ranking_is_that_of_sql_over_stored_scores(spark):
    import duckdb

    from cubelark.plans.forecasts import searched

    rng = np.random.default_rng(4)
    grid = {"depth": (4, 6), "rate": (0.1, 0.3), "l2": (1.0, 5.0)}
    scores = [(c, s, f, round(float(rng.uniform(10, 12)), 1), 11.0) for c in range(8) for s in (5, 10) for f in range(3)]
    got = searched(spark.createDataFrame(scores, "candidate int, stage int, fold long, mape double, baseline_mape double"), grid).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE s (candidate INT, stage INT, fold INT, mape DOUBLE, base DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?)", scores)
    ranked = con.sql("SELECT candidate, stage FROM s GROUP BY 1, 2 ORDER BY round(avg(mape), 4), max(mape), round(avg(CAST(mape < base AS INT)), 4) DESC, 1, 2").fetchall()
    assert [(r["candidate"], r["iterations"]) for r in got] == ranked
    assert [(r["depth"], r["rate"], r["l2"]) for r in got if r["candidate"] == 5][0] == (6, 0.1, 5.0)


def test_strategies_are_chosen_on_earlier_folds_only(spark):
    from cubelark.plans.forecasts import strategy_by_earlier_folds

    scored = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 9.0), (3, "a", 5.0), (3, "b", 4.0)], "fold int, strategy string, mape double")
    got = {r["fold"]: (r["strategy"], r["earlier_mape"], r["fold_mape"]) for r in strategy_by_earlier_folds(scored, scored).collect()}
    assert got == {1: (None, None, None), 2: ("b", 2.0, 9.0), 3: ("a", 2.0, 5.0)}


def test_parts_sum_to_the_difference(spark):
    from cubelark.operators import metrics as M

    rng = np.random.default_rng(5)
    rows = [("A" if rng.random() < 0.4 else "B", f"s{int(rng.integers(4))}", bool(rng.random() < 0.3)) for _ in range(400)] + [("A", "only_a", True)] * 9
    parts = M.difference_parts(spark.createDataFrame(rows, "g string, s string, h boolean"), "g", "s", F.col("h"), "A", "B").collect()
    share = lambda g: 100.0 * np.mean([h for x, _, h in rows if x == g])
    assert sum(p["within_part"] + p["mix_part"] for p in parts) == pytest.approx(share("A") - share("B"), abs=1e-3)
    assert [p["within_part"] for p in parts if p["s"] == "only_a"] == [0.0]


def test_findings_without_rows(spark):
    from cubelark.operators import metrics as M

    none = spark.createDataFrame([], "k string, y double, m double, b double")
    groups = M.group_error_sets(none, "y", "m", "b", [["k"]])
    assert {r["finding"]: r["value"] for r in M.findings(none, groups, "y", "m", "b").collect()} == {"model_nearer_than_baseline": None, "errors_above_bound": None}
