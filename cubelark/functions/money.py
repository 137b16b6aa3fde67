"""Salaries: parsing, bounds, midpoints and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubelark.functions.text import clean_salary_text, once, squeeze, to_number

EXTREME = 1_000_000


def positive(c: Column) -> Column:
    """MTH-03: values of zero and below are null."""
    return F.when(c > 0, c)


def midpoint(low: Column, high: Column) -> Column:
    """MTH-01: null unless both bounds are given in order."""
    return F.when((low > 0) & (high > 0) & (low <= high), (low + high) / 2)


def midpoint_or_low(low: Column, high: Column) -> Column:
    """MTH-02: the lower bound where the upper one is missing, equal or not positive, else the mean."""
    return F.when(high.isNull() | (high <= 0) | (high == low), low).otherwise((low + high) / 2)


def bound_type(low: Column, high: Column) -> Column:
    """CAT-05."""
    both = low.isNotNull() & high.isNotNull()
    return F.when(both & ((low <= 0) | (high <= 0) | (low > high)), "invalid").when(both, "range").when(low > 0, "lower_only").when(high > 0, "upper_only").otherwise("missing")


def parse_salary(text: Column, word_bounds: bool = False) -> dict[str, Column]:
    """MTH-07: salary_from, salary_to, salary_currency and salary_parse_status of a free text.

    ``word_bounds`` asks for the words for from and to as words of their own;
    without it they count anywhere in the text.
    """
    def parsed(raw: Column, folded: Column, numbers: Column) -> Column:
        has = (lambda w: folded.rlike(rf"(?U)\b{w}\b")) if word_bounds else (lambda w: folded.contains(w))
        first, second, n = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1)), F.size(numbers)
        both = has("от") & has("до") & (n >= 2)
        low = F.when(both, first).when(has("от") & (n >= 1), first).when(has("до") & (n >= 1), F.lit(None)).when(n >= 1, first)
        high = F.when(both, second).when(has("от") & (n >= 1), F.lit(None)).when(has("до") & (n >= 1), first).when(n >= 2, second)
        currency = F.nullif(F.regexp_extract(raw, r"\b([A-Z]{3})\b", 1), F.lit(""))
        return F.struct(low.alias("salary_from"), high.alias("salary_to"), currency.alias("salary_currency"))

    def numbers_of(raw: Column) -> Column:
        found = F.regexp_extract_all(raw, F.lit(r"(\d[\d\s ]*(?:[,.]\d+)?)"), F.lit(1))
        return F.transform(found, lambda n: F.replace(F.regexp_replace(n, r"(?U)\s", ""), F.lit(","), F.lit(".")).try_cast("double"))

    def with_status(raw: Column, p: Column) -> Column:
        status = F.when(raw.isNull(), "missing").when(p["salary_from"].isNotNull() | p["salary_to"].isNotNull(), "parsed").otherwise("unparsed")
        return F.struct(p["salary_from"].alias("salary_from"), p["salary_to"].alias("salary_to"), p["salary_currency"].alias("salary_currency"), status.alias("salary_parse_status"))

    read = once(clean_salary_text(text), lambda raw: once(once(numbers_of(raw), lambda numbers: parsed(raw, F.lower(raw), numbers)), lambda p: with_status(raw, p)))
    return {n: read[n] for n in ("salary_from", "salary_to", "salary_currency", "salary_parse_status")}


def salary_flags(low: Column, high: Column, raw_low: Column, raw_high: Column, currency: Column) -> dict[str, Column]:
    """MTH-04. The zero bound is looked for in the raw bounds, before they are nulled."""
    false = F.lit(False)
    return {
        "salary_has_missing_bounds": low.isNull() & high.isNull(),
        "salary_has_zero_bound": F.coalesce((raw_low <= 0) | (raw_high <= 0), raw_low <= 0, raw_high <= 0, false),
        "salary_has_inverted_bounds": F.coalesce(low > high, false),
        "salary_has_extreme_value": F.coalesce(low > EXTREME, false) | F.coalesce(high > EXTREME, false),
        "salary_is_non_rur": F.coalesce(~F.upper(squeeze(currency)).isin("RUR", "RUB"), false),
    }


def log_ratio(target: Column, baseline: Column) -> Column:
    """MTH-05: ln(target) - ln(baseline) where both are positive."""
    return F.when((target > 0) & (baseline > 0), F.ln(target) - F.ln(baseline))


def from_log_ratio(delta: Column, baseline: Column) -> Column:
    return baseline * F.exp(delta)


def numeric_text(c: Column) -> Column:
    return positive(to_number(c))
