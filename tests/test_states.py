"""Cubes from mergeable states: equal to cubes of the records, whatever the periods, loads and keys."""

import pytest
from pyspark.sql import functions as F

from cubelark.operators import cube as C
from cubelark.operators import states as S

SCHEMA = "day string, a string, b int, salary_mid double, salary_from double, employer_id string, is_remote boolean, quality_flag_count int, n int"


def bag(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def rows(spark):
    """A segment with half of all records, null keys, days, salaries and employers, repeated rows, and a column named as one of a state."""
    made = [(f"d{i % 5}" if i % 11 else None, "hot" if i % 2 else (None if i % 3 else f"k{i % 4}"), i % 3, float(i % 17) * 10.5 if i % 4 else None, float(i % 9) if i % 5 else None, f"e{i % 6}" if i % 7 else None, (True, False, None)[i % 3], (0, 1, None)[i % 3], i) for i in range(600)]
    return spark.createDataFrame(made + made[:50], SCHEMA)


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["b"]])
def test_cube_of_states(rows, keys):
    want = C.monthly_cube(rows, keys)
    assert bag(S.cube_of(S.cube_states(rows, keys), keys, merged=True), want.columns) == bag(want, want.columns)
    fine = S.cube_states(rows, ["a", "b"], F.col("day"))
    assert bag(S.cube_of(fine, keys), want.columns) == bag(want, want.columns)
    assert bag(S.cube_of(S.merge_states(fine, ["b", *keys] if "b" not in keys else keys), keys), want.columns) == bag(want, want.columns)


def test_loads(spark, rows, tmp_path):
    """New days are added, days that come again are replaced, and all together give the cube of all records."""
    path, day = f"{tmp_path}/states", F.col("day")
    S.store_states(rows.where("day < 'd2' OR day = 'd3' AND n < 100 OR day IS NULL"), ["a", "b"], day, path)
    S.store_states(rows.where("day >= 'd2'"), ["a", "b"], day, path)
    S.store_states(rows.where("day = 'd4'"), ["a", "b"], day, path)
    want = C.monthly_cube(rows, ["a"])
    for found in (S.stored_states(spark, path), S.stored_states(spark, path, S.cube_states(rows, ["a", "b"], day))):
        assert bag(S.cube_of(found, ["a"]), want.columns) == bag(want, want.columns)
    one = S.stored_states(spark, path).where(F.col(S.PERIOD) == "d1")
    assert bag(S.cube_of(one, ["a"]), want.columns) == bag(C.monthly_cube(rows.where("day = 'd1'"), ["a"]), want.columns)
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()


def test_states_are_rows(spark, rows):
    """One scan; no state is a collection, and there are no more of them than values."""
    states = S.cube_states(rows, ["a"])
    assert not [f for f in states.schema.fields if f.dataType.typeName() in ("map", "array", "struct")]
    assert states.where("measure = 'salary_mid'").count() == rows.where("salary_mid IS NOT NULL").select("a", "salary_mid").distinct().count()
    assert states.where("measure = 'employer'").agg(F.sum("n")).first()[0] == rows.count()
    assert S.cube_of(states.limit(0), ["a"]).count() == 0
    with pytest.raises(KeyError):
        S.merge_states(states, ["b"])
    with pytest.raises(ValueError):
        S.cube_states(rows, ["a", "n"])
