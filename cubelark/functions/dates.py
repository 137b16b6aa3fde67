"""Dates: mixed formats, periods as whole numbers, and validity flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.functions.text import leading_year, once, strip

MIN_DATE, MAX_DATE = "2000-01-01", "2026-05-21"
DAY_FIRST, SLASHED = r"^\d{1,2}\.\d{1,2}\.\d{4}", r"^\d{1,2}/\d{1,2}/\d{4}"


def looks_day_first(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: whether any value of the column is a day-first date with points, by which its dates with slashes are read."""
    return df.agg(F.coalesce(F.max(strip(F.col(column).cast("string")).rlike(DAY_FIRST)), F.lit(False)).alias(name))


def parse_date(c: Column, slashes_day_first: Column | None = None) -> Column:
    """DT-01, DT-02: ISO forms, and day-first dates with points, decided row by row. Years outside 1677 to 2262 are null.

    Dates with slashes are read only where it is said how, the other way round if they make no date so.
    """
    def read(text: Column) -> Column:
        day_first = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("d.M.yyyy", "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss")])
        offset = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
        when = F.when(text.rlike(DAY_FIRST), day_first).otherwise(F.try_to_timestamp(offset))
        if slashes_day_first is None:
            return when
        day, month = (F.coalesce(*[F.try_to_timestamp(text, F.lit(f + t)) for t in ("", " H:mm", " H:mm:ss")]) for f in ("d/M/yyyy", "M/d/yyyy"))
        return F.when(text.rlike(SLASHED), F.when(slashes_day_first, F.coalesce(day, month)).otherwise(F.coalesce(month, day))).otherwise(when)

    return once(once(strip(c), read), lambda when: F.when(F.year(when).between(1678, 2261), when))


def parse_failed(raw: Column, parsed: Column) -> Column:
    return raw.isNotNull() & (strip(raw) != "") & parsed.isNull()


def first_date(candidates: dict[str, Column]) -> tuple[Column, Column]:
    """DT-03: the first candidate that parses, in order, and its name."""
    parsed = {n: parse_date(c) for n, c in candidates.items()}
    name = F.coalesce(*[F.when(when.isNotNull(), F.lit(n)) for n, when in parsed.items()])
    return F.coalesce(*parsed.values()), name


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def month_index(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def quarter_index(c: Column) -> Column:
    return F.year(c) * 4 + F.quarter(c) - 1


def month_label_of(index: Column) -> Column:
    return F.concat(F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((index % 12 + 1).cast("string"), 2, "0"))


def quarter_label_of(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("Q"), (index % 4 + 1).cast("string"))


def cyclic(month: Column) -> tuple[Column, Column]:
    """DT-08."""
    angle = month * F.lit(2.0) * F.pi() / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def date_flags(name: str, raw: Column, parsed: Column, low: str = MIN_DATE, high: str = MAX_DATE) -> dict[str, Column]:
    """DT-05 for one column: before, after, impossible year."""
    false = F.lit(False)
    year = leading_year(raw)
    outside = parsed.isNull() & ((year < 2000) | (year > 2026))
    return {
        f"{name}_is_before_min_date": F.coalesce(parsed < F.lit(low).cast("timestamp"), false),
        f"{name}_is_after_max_date": F.coalesce(parsed > F.lit(high).cast("timestamp"), false),
        f"{name}_has_impossible_year": F.coalesce(outside, false),
    }


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
