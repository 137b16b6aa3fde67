"""Cleaning, categories, money and dates on literals with hand-derived results."""

import pytest
from pyspark.sql import functions as F

from cubelark.functions import categories as CAT
from cubelark.functions import dates as DT
from cubelark.functions import money as MON
from cubelark.functions import text as TX


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *[c(F.col("v")) if callable(c) else c for c in columns]).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, ["  a   b ", '"не указано"', "N/A", None, "нет", "'x'", ""], TX.clean_text) == ["a b", None, None, None, None, "x", None]


def test_clean_quoted(spark):
    assert values(spark, ['"a"', '""a""', "none", " b "], TX.clean_quoted) == ["a", '"a"', None, "b"]


def test_numbers(spark):
    assert values(spark, ["1,5", "45 000", "1,234.5", "-5", "abc", None], TX.to_number) == [1.5, 45000.0, None, -5.0, None, None]


def test_booleans_and_json(spark):
    assert values(spark, ["Да", "0", "maybe", None], TX.to_boolean) == [True, False, None, None]
    assert values(spark, ['{"latitude":55.7}', "[1]", "bad", None, "{}"], lambda c: TX.json_key(c, "latitude")) == ["55.7", None, None, None, None]
    assert values(spark, ['{"inn": "7"}', '{"companyCode": "c", "inn": "7"}'], TX.company_id) == ["7", "c"]


def test_leading_year(spark):
    assert values(spark, ["1999-01-01", "-123x", "x", None], TX.leading_year) == [1999, -123, None, None]


def test_regions(spark):
    rows = ["г. Москва", "Республика Адыгея (Адыгея)", "респ Адыгея", "Московская область", "Томск", "не указано"]
    assert values(spark, rows, lambda c: CAT.region(c)[0], lambda c: CAT.region(c)[1]) == [("Москва", False), ("Республика Адыгея", False), ("Республика Адыгея", False), ("Московская область", False), ("Томск", False), (None, True)]


def test_occupations(spark):
    rows = ["Программист 1С", "Бизнес-аналитик", "Менеджер по продажам", "Администратор ресторана", "Дворник", "нет"]
    assert values(spark, rows, CAT.occupation) == ["IT и разработка", "Аналитика", "Продажи", "HoReCa", "Другое", "unknown"]


def test_experience(spark):
    rows = ["noExperience", "До 1 года", "0.5", "between1And3", "3", "От 3 до 6 лет", "moreThan6", "10", "опыт желателен", None]
    want = [(0.0, 0.0, "no_experience"), (0.0, 1.0, "up_to_1"), (0.5, 0.5, "up_to_1"), (1.0, 3.0, "1_to_3"), (3.0, 3.0, "3_to_6"), (3.0, 6.0, "3_to_6"), (6.0, None, "6_plus"), (10.0, 10.0, "6_plus"), (None, None, "unknown"), (None, None, "unknown")]
    assert values(spark, rows, *[(lambda c, k=k: CAT.experience(c)[k]) for k in range(3)]) == want


def test_schedules(spark):
    rows = ["fullDay", "Удаленная работа", "Удалённая работа", "Вахтовый метод", "Сменный график", "Гибкий график", "Неполный рабочий день", None]
    want = [("full_day", False, False, False), ("remote", True, False, False), ("other", False, False, False), ("fly_in_fly_out", False, False, True), ("shift", False, True, False), ("flexible", False, True, False), ("full_day", False, False, False), ("unknown", False, False, False)]
    assert values(spark, rows, *[(lambda c, k=k: CAT.schedule(c)[k]) for k in range(4)]) == want
    assert values(spark, ["Удалённая работа", "Неполный день"], lambda c: CAT.schedule(c, True, True)[0]) == ["remote", "part_time"]


def test_support_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 10, 11, 60, 61, 150, 151)], "n int")
    assert [r[0] for r in df.select(CAT.support_bucket(F.col("n"))).collect()] == ["very_low", "very_low", "low", "medium", "high", "high", "very_high"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("от 100 000 до 150 000 RUR", (100000.0, 150000.0, "RUR", "parsed")),
        ("от 80 000 RUR", (80000.0, None, "RUR", "parsed")),
        ("до 50 000 руб.", (None, 50000.0, None, "parsed")),
        ("100 000 - 120 000 USD", (100000.0, 120000.0, "USD", "parsed")),
        ("150000 - 100000 RUR", (150000.0, 100000.0, "RUR", "parsed")),
        ("по договоренности", (None, None, None, "unparsed")),
        ("з/п не указана", (None, None, None, "missing")),
        (None, (None, None, None, "missing")),
    ],
)
def test_salary_texts(spark, text, want):
    names = ("salary_from", "salary_to", "salary_currency", "salary_parse_status")
    assert values(spark, [text], *[(lambda c, n=n: MON.parse_salary(c)[n]) for n in names]) == [want]


def test_bounds_and_midpoints(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 1.0), (1.0, None), (None, 2.0), (None, None), (0.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in df.select(MON.bound_type(F.col("a"), F.col("b")), MON.midpoint(F.col("a"), F.col("b"))).collect()]
    assert got == [("range", 2.0), ("invalid", None), ("lower_only", None), ("upper_only", None), ("missing", None), ("invalid", None)]


def test_dates(spark):
    rows = ["01.02.2022", "2022-03-04", "2022-12-16T12:00:00+0300", "garbage", None]
    assert values(spark, rows, lambda c: F.date_format(DT.parse_date(c), "yyyy-MM-dd'T'HH:mm"), lambda c: DT.parse_failed(c, DT.parse_date(c))) == [("2022-02-01T00:00", False), ("2022-03-04T00:00", False), ("2022-12-16T09:00", False), (None, True), (None, False)]
    assert values(spark, ["2022-12-31T23:30:00-01:00"], lambda c: DT.month_label(DT.parse_date(c))) == ["2023-01"]


def test_period_labels(spark):
    df = spark.createDataFrame([(2025 * 12 + 3, 2025 * 4 + 1)], "m int, q int")
    assert tuple(df.select(DT.month_label_of(F.col("m")), DT.quarter_label_of(F.col("q"))).first()) == ("2025-04", "2025Q2")
