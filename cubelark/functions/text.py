"""Cleaning of text, JSON, booleans and numbers. White space is Unicode white space, no-break spaces included."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholders that mean null.
NULL_PLACEHOLDERS = ("", "-", "--", "na", "n/a", "nan", "none", "null", "нет", "не задано", "не указано", "ничего не выбрано", "з/п не указана", "зарплата не указана", "требования не предъявляются")
MISSING_PLACEHOLDERS = ("", "-", "--", "na", "n/a", "nan", "none", "null", "нет", "не задано", "не указано", "з/п не указана", "зарплата не указана")
SALARY_PLACEHOLDERS = ("", "none", "nan", "null", "з/п не указана", "зарплата не указана", "не указана", "не указано")
QUOTED_PLACEHOLDERS = ("", "none", "nan", "null")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "да"), ("false", "0", "no", "нет")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row: a column is an expression, computed again wherever it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def strip_quotes(c: Column) -> Column:
    """White space, then double quotes, then single quotes at both ends (STR-01)."""
    return F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", "")


def none_of(c: Column, words: Iterable[str]) -> Column:
    return once(c, lambda x: F.when(F.lower(x).isin(*words), F.lit(None)).otherwise(x))


def clean_text(c: Column) -> Column:
    """STR-02: stripped, white space squeezed, placeholders to null."""
    return none_of(squeeze(strip_quotes(c)), NULL_PLACEHOLDERS)


def clean_salary_text(c: Column) -> Column:
    """STR-04: stripped, placeholders of salaries to null, white space kept."""
    return none_of(strip_quotes(c), SALARY_PLACEHOLDERS)


def clean_quoted(c: Column) -> Column:
    """STR-05: one surrounding pair of double quotes dropped."""
    return none_of(strip(F.regexp_replace(strip(c), '^"(.*)"$', "$1")), QUOTED_PLACEHOLDERS)


def hash_form(c: Column) -> Column:
    """STR-06: the form that row hashes are made of."""
    return F.coalesce(squeeze(strip(F.lower(c.cast("string")))), F.lit(""))


def normalize_nulls(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """STR-03 on all string columns, or those named that exist."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if columns is None else [c for c in columns if c in df.columns]
    return df.withColumns({n: clean_text(F.col(n)) for n in names}) if names else df


def normalize_zero_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULL-01; columns that are missing are skipped."""
    names = [c for c in columns if c in df.columns]
    return df.withColumns({n: F.nullif(F.col(n), F.lit(0)) for n in names}) if names else df


def empty_lists_to_null(df: DataFrame) -> DataFrame:
    """STR-11: ``[]`` and ``{}`` to null on all string columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(F.col(n).isin("[]", "{}"), F.lit(None)).otherwise(F.col(n)) for n in names}) if names else df


def keyword_category(c: Column, groups: Iterable[tuple[str, tuple[str, ...]]], default: str, missing: str) -> Column:
    """STR-08: the first group of which a keyword is part of the text."""
    text = F.lower(c)
    out = F.when(c.isNull(), missing)
    for name, words in groups:
        found = F.lit(False)
        for w in words:
            found = found | text.contains(w)
        out = out.when(found, name)
    return out.otherwise(default)


def json_key(c: Column, key: str) -> Column:
    """JSON-01: null for what is no JSON object or lacks the key."""
    return F.get_json_object(c, f"$.{key}")


def education_type(c: Column) -> Column:
    return json_key(c, "educationType")


def company_id(c: Column) -> Column:
    return F.coalesce(json_key(c, "companyCode"), json_key(c, "inn"))


def to_boolean(c: Column) -> Column:
    """BOOL-01."""
    text = strip(F.lower(c.cast("string")))
    return F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)


def to_number(c: Column) -> Column:
    """CAST-02: digits, commas, points and minus signs kept; comma is a decimal point; null where that is no number."""
    return F.replace(F.regexp_replace(c, r"[^\d,.\-]", ""), F.lit(","), F.lit(".")).try_cast("double")


def digits_only(c: Column) -> Column:
    """STR-10."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def leading_year(c: Column) -> Column:
    """STR-13: a signed year of three or four digits at the start."""
    return F.nullif(F.regexp_extract(strip(c), r"^([+-]?\d{3,4})", 1), F.lit("")).try_cast("int")
