"""Aggregates whose results do not depend on the order of rows: sums run over decimals and become doubles at the end.

Values are summed to six digits after the point, the seventh rounded; values of
10 ** 12 or more are out of range: an error with ANSI on, null without.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

EXACT = "decimal(18,6)"
#: Of the approximate pass of exact quantiles of a whole table.
ACCURACY = 100_000
#: Parts that a pass of rank selection counts.
CELLS = 1024


def rounded(x: Column | str, digits: int = 0) -> Column:
    """Round a double half away from zero in binary, as SQL engines do that scale, round and scale back; F.round rounds the shortest decimal form, which differs at ties."""
    x, scale = (F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(float(10**digits))
    return F.signum(x) * F.round(F.abs(x) * scale) / scale


def exact_sum(x: Column, over: WindowSpec | None = None) -> Column:
    s = F.sum(x.cast(EXACT))
    return (s if over is None else s.over(over)).cast("double")


def exact_mean(x: Column, over: WindowSpec | None = None) -> Column:
    n = F.count(x)
    n = n if over is None else n.over(over)
    return exact_sum(x, over) / F.nullif(n.cast("double"), F.lit(0.0))


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; null counts as false."""
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).cast("double") / F.count(F.lit(1)).cast("double")


def quantile(x: Column, q: float, over: WindowSpec | None = None, digits: int = 6) -> Column:
    """Exact quantile with linear interpolation."""
    p = F.percentile(x.cast("double"), F.lit(q))
    return rounded(p if over is None else p.over(over), digits)


def quantiles(x: Column, at: Sequence[float], digits: int = 6) -> list[Column]:
    """Several exact quantiles of one column from one state."""
    found = F.percentile(x.cast("double"), F.array(*[F.lit(q) for q in at]))
    return [rounded(F.get(found, F.lit(i)), digits) for i in range(len(at))]


def global_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole table's column; NaN and null are left out."""
    return whole_quantiles(df, {column: F.col(column)}, at)[column]


def whole_quantiles(df: DataFrame, values: dict[str, Column], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several expressions over a whole table by distributed rank selection; NaN and null are left out.

    Approximate quantiles bound the values that a rank can have. Then every pass
    counts the values in ``CELLS`` equal parts of each rank's bounds and goes on
    with the part that the rank falls into, until it holds one value. All ranks
    of all expressions share a pass, and the driver sees counts only, ``CELLS``
    for each rank.
    """
    each = F.array(*[F.struct(F.lit(i).alias("of"), v.cast("double").alias("x")) for i, v in enumerate(values.values())])
    rows = df.select(F.inline(each)).where("x IS NOT NULL AND NOT isnan(x)")
    margin = 2 / ACCURACY
    bounds = F.percentile_approx("x", F.array(*[F.lit(b) for q in at for b in (max(0.0, q - margin), min(1.0, q + margin))]), ACCURACY)
    known = {r["of"]: r for r in rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), bounds.alias("ends")).collect()}  # a row for each expression
    open_ranks: dict[tuple[int, int], tuple[float, float]] = {}
    for of, r in known.items():
        for i, q in enumerate(at):
            for rank in _around(q, r["n"]):
                low, high = open_ranks.get((of, rank), (r["ends"][2 * i], r["ends"][2 * i + 1]))
                open_ranks[of, rank] = min(low, r["ends"][2 * i]), max(high, r["ends"][2 * i + 1])
    found: dict[tuple[int, int], float] = {}
    while open_ranks:
        order = sorted(open_ranks)

        def part(of: int, rank: int):
            low, high = open_ranks[of, rank]
            scaled = F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * CELLS) if high > low else F.lit(0)  # halves: the distance of two doubles may be none
            return F.when(F.col("of") != of, None).when(F.col("x") < low, -1).when(F.col("x") <= high, F.least(scaled, F.lit(CELLS - 1))).cast("int")

        cells = F.array(*[F.struct(F.lit(k).alias("k"), part(*key).alias("cell")) for k, key in enumerate(order)])
        counted = rows.select("x", F.explode(cells).alias("c")).where("c.cell IS NOT NULL").groupBy("c.k", "c.cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        by_rank: dict[int, list] = {}
        for r in counted.collect():  # CELLS + 1 rows for each rank at most
            by_rank.setdefault(r["k"], []).append((r["cell"], r["n"], r["low"], r["high"]))
        for k, (of, rank) in enumerate(order):
            seen = 0
            open_ranks[of, rank] = known[of]["least"], known[of]["most"]  # stays where the approximate bounds were too high or too low
            for cell, count, low, high in sorted(by_rank.get(k, [])):
                if cell >= 0 and seen <= rank < seen + count:
                    open_ranks[of, rank] = low, high
                    if low == high:
                        found[of, rank] = low
                    break
                seen += count
        open_ranks = {r: b for r, b in open_ranks.items() if r not in found}

    def one(of: int, q: float) -> float | None:
        if of not in known:
            return None
        place, (low, *high) = q * (known[of]["n"] - 1), _around(q, known[of]["n"])
        a = found[of, low]
        return a + (found[of, high[0]] - a) * (place - low) if high else a

    return {name: [one(i, q) for q in at] for i, name in enumerate(values)}


def _around(q: float, n: int) -> list[int]:
    """The rank of a quantile among n values, or the two ranks that it lies between."""
    low = int(q * (n - 1))
    return [low, low + 1] if q * (n - 1) > low else [low]


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of weights, over rows with a value and a positive weight; the plain mean where there is none."""
    valid = value.isNotNull() & (weight > 0)
    top = F.sum(F.when(valid, value.cast(EXACT) * weight.cast("bigint"))).cast("double")
    bottom = F.sum(F.when(valid, weight.cast("bigint"))).cast("double")
    return F.coalesce(top / F.nullif(bottom, F.lit(0.0)), exact_mean(value))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pct_change(current: Column, previous: Column) -> Column:
    """(current - previous) / |previous|; null where previous is 0."""
    return ratio(current - previous, F.abs(previous))
