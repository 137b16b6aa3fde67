"""Distinct values by sketches: merged like whole, and the same decisions as exact counts."""

import pytest
from pyspark.sql import functions as F

from cubelark.operators import distinct as D
from cubelark.operators import profile as PR


@pytest.fixture(scope="module")
def rows(spark):
    """20,000 rows with columns on either side of the thresholds, right at them, constant, empty, and of awkward names."""
    i = F.col("id")
    mod = lambda n: (i % n)
    return spark.range(20_000, numPartitions=6).select(
        i.alias("number"), mod(19_901).alias("above"), mod(19_900).alias("at"), mod(19_899).alias("below"), mod(7).alias("few"),
        F.concat(F.lit("t"), mod(18_001).cast("string")).alias("t_above"), F.concat(F.lit("t"), mod(18_000).cast("string")).alias("t_at"), F.concat(F.lit("t"), mod(5).cast("string")).alias("t_few"),
        F.when(mod(2) == 0, F.floor(i / 2) % 9_801).alias("half_above"), F.when(mod(2) == 0, F.floor(i / 2) % 9_800).alias("half_at"),
        F.lit("x").alias("same"), F.when(mod(9) == 0, 1).alias("same_or_null"), F.lit(None).cast("string").alias("nothing"), mod(3).alias("a.b"), F.repeat(F.lit("long "), 20).alias("words"), (mod(2) == 0).alias("flag"), F.lit(float("nan")).alias("nan"),
    )


def exact(df):
    names = df.columns
    one = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(names)]).first()
    return dict(zip(names, one, strict=True))


def test_merged_sketches(spark, rows):
    parts = [rows.where(F.col("number") % 4 == k) for k in range(4)]
    whole = {r["column"]: (r["rows"], r["filled"], r["distinct"]) for r in D.estimated(D.column_sketches(rows)).collect()}
    merged = D.column_sketches(parts[0])
    for p in parts[1:]:
        merged = merged.unionByName(D.column_sketches(p))
    again = {r["column"]: (r["rows"], r["filled"], r["distinct"]) for r in D.estimated(D.merge_sketches(merged)).collect()}
    for c, n in exact(rows).items():
        assert whole[c][:2] == again[c][:2] == (20_000, rows.where(F.col(f"`{c}`").isNotNull()).count())
        assert whole[c][2] == pytest.approx(n, rel=D.MARGIN) and again[c][2] == pytest.approx(n, rel=D.MARGIN)
    assert {r["distinct"] for r in D.estimated(D.column_sketches(rows.limit(0))).collect()} == {0}


def test_exact_only_where_near(rows):
    assert D.exact_where(rows, {"few": 7}, {"few": [100.0]}) == {"few": 7}
    assert D.exact_where(rows, {"above": 19_000, "few": 6}, {"above": [19_900.0], "few": [15_000.0]}) == {"above": 19_901, "few": 6}


def test_issues_are_those_of_exact_counts(rows):
    want = set()
    for c, n in exact(rows).items():
        filled = rows.where(F.col(f"`{c}`").isNotNull()).count()
        if issue := "empty" if not filled else "constant" if n == 1 else "nearly_unique" if n > 0.98 * filled else None:
            want.add((c, issue))
    assert {tuple(r) for r in PR.issues(rows).collect()} == want
    assert ("half_above", "nearly_unique") in want and ("half_at", "nearly_unique") not in want
    assert {r["issue"] for r in PR.issues(rows.limit(0)).collect()} == {"empty"}


def test_roles_are_those_of_exact_counts(rows):
    got = dict(map(tuple, PR.roles(rows).collect()))
    assert list(got) == rows.columns
    assert {c for c, r in got.items() if r == "id"} == {"number", "above"}
    assert got["at"] == got["below"] == got["few"] == got["half_above"] == got["a.b"] == got["nan"] == "numeric"
    assert got["t_above"] == got["words"] == "text" and got["t_at"] == got["t_few"] == got["same"] == got["nothing"] == got["flag"] == "categorical"
    small = dict(map(tuple, PR.roles(rows.where("number < 1000")).collect()))
    assert small["number"] == "numeric" and small["t_above"] == "text"
    assert dict(map(tuple, PR.roles(rows.limit(0)).collect()))["t_few"] == "categorical"
