"""Categories by rules; the first rule that holds wins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubelark.functions.text import clean_text, keyword_category, once, squeeze, strip

# Spellings of regions, and keywords of occupations in the order in which they are tried.
REGION_ALIASES = {
    "адыгея": "Республика Адыгея",
    "республика адыгея": "Республика Адыгея",
    "республика адыгея (адыгея)": "Республика Адыгея",
    "москва": "Москва",
    "г москва": "Москва",
    "город москва": "Москва",
    "санкт-петербург": "Санкт-Петербург",
    "г санкт-петербург": "Санкт-Петербург",
    "город санкт-петербург": "Санкт-Петербург",
    "севастополь": "Севастополь",
    "г севастополь": "Севастополь",
    "ханты-мансийский автономный округ - югра": "Ханты-Мансийский автономный округ - Югра",
    "ханты-мансийский ао - югра": "Ханты-Мансийский автономный округ - Югра",
    "ямало-ненецкий автономный округ": "Ямало-Ненецкий автономный округ",
    "ямало-ненецкий ао": "Ямало-Ненецкий автономный округ",
}
OCCUPATION_KEYWORDS = (
    ("IT и разработка", ("программист", "разработчик", "developer", "devops", "инженер по тестированию", "qa", "data scientist", "аналитик данных")),
    ("Аналитика", ("аналитик", "analysis", "bi ")),
    ("Продажи", ("менеджер по продаж", "продавец", "кассир", "торговый представитель")),
    ("Медицина", ("врач", "медицин", "фельдшер", "медсест", "фармацевт")),
    ("Образование", ("учитель", "преподаватель", "педагог", "воспитатель")),
    ("Производство", ("слесарь", "токарь", "оператор стан", "монтажник", "сварщик")),
    ("Логистика и транспорт", ("водитель", "курьер", "логист", "экспедитор")),
    ("Строительство", ("строител", "прораб", "инженер пто", "мастер смр")),
    ("HoReCa", ("повар", "официант", "бариста", "администратор ресторана")),
    ("Администрирование", ("администратор", "секретарь", "офис-менеджер")),
)
OTHER, UNKNOWN = "Другое", "unknown"


def region(c: Column) -> tuple[Column, Column]:
    """CAT-01: (name, whether it is unknown)."""
    aliases = F.create_map(*[F.lit(x) for x in chain.from_iterable(REGION_ALIASES.items())])

    def name(text: Column) -> Column:
        key = strip(squeeze(F.regexp_replace(F.translate(F.lower(text), "ё.,", "е  "), r"\([^)]*\)", "")))
        short = lambda k: F.regexp_replace(k, r"^(обл|область|край|республика|респ)\s+", "")
        return F.coalesce(once(key, lambda k: F.coalesce(F.element_at(aliases, k), F.element_at(aliases, short(k)))), F.element_at(aliases, F.lower(text)), text)

    return once(clean_text(c), name), clean_text(c).isNull()


def occupation(c: Column) -> Column:
    """CAT-02."""
    return once(clean_text(c), lambda t: keyword_category(t, OCCUPATION_KEYWORDS, OTHER, UNKNOWN))


def experience(c: Column) -> tuple[Column, Column, Column]:
    """CAT-03: (least years, most years, group)."""
    found = once(F.lower(clean_text(c)), lambda t: once(_numbers(t), lambda numbers: _years(t, numbers)))
    with_group = once(found, lambda y: F.struct(y["low"].alias("low"), y["high"].alias("high"), _experience_group(y["low"], y["high"]).alias("group")))
    return with_group["low"], with_group["high"], with_group["group"]


def _numbers(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:[,.]\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))


def _years(t: Column, numbers: Column) -> Column:
    """(low, high) of a cleaned text and the numbers in it."""
    first = F.get(numbers, F.lit(0))
    rules = [  # fixed values: spellings and their years
        (t.isin("noexperience", "нет опыта", "без опыта", "0"), 0.0, 0.0),
        ((t == "between1and3") | t.contains("от 1 года до 3 лет"), 1.0, 3.0),
        ((t == "between3and6") | t.contains("от 3 до 6"), 3.0, 6.0),
        ((t == "morethan6") | t.contains("более 6"), 6.0, None),
        ((t == "between0and1") | t.contains("до 1 года"), 0.0, 1.0),
    ]
    low, high = F.when(t.isNull(), F.lit(None).cast("double")), F.when(t.isNull(), F.lit(None).cast("double"))
    for rule, a, b in rules:
        low, high = low.when(rule, F.lit(a)), high.when(rule, F.lit(b).cast("double"))
    return F.struct(low.otherwise(first).alias("low"), high.otherwise(F.coalesce(F.get(numbers, F.lit(1)), first)).alias("high"))


def _experience_group(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), UNKNOWN).when((low == 0) & F.coalesce(high == 0, F.lit(False)), "no_experience").when((low < 1) & (high.isNull() | (high <= 1)), "up_to_1").when(low < 3, "1_to_3").when(low < 6, "3_to_6").otherwise("6_plus")


def schedule(c: Column, fold_yo: bool = False, part_time_first: bool = False) -> tuple[Column, Column, Column, Column]:
    """CAT-04: (type, remote, shift, fly-in fly-out).

    By default the spelling with ё is not remote, and part time in Russian is
    full day, as it contains that word; the two options mend these.
    """
    def kinds(text: Column, t: Column) -> Column:
        def has(*words: str) -> Column:
            return t.rlike("|".join(words))

        # Words of each kind of schedule, and the names of the kinds.
        remote, shift, fly = has("remote", "удален", "дистанц"), has("смен", "shift", "график"), has("вахт", "flyinflyout")
        full, part = has("полный") | (t == "fullday"), has("неполный", "part")
        kind = F.when(text.isNull(), UNKNOWN).when(fly, "fly_in_fly_out").when(remote, "remote")
        kind = kind.when(part, "part_time").when(full, "full_day") if part_time_first else kind.when(full, "full_day").when(part, "part_time")
        kind = kind.when(has("гибк", "flexible"), "flexible").when(shift, "shift").otherwise("other")
        return F.struct(kind.alias("kind"), remote.alias("remote"), shift.alias("shift"), fly.alias("fly"))

    folded = lambda t: F.coalesce(F.translate(t, "ё", "е") if fold_yo else t, F.lit(""))
    found = once(clean_text(c), lambda text: once(folded(F.lower(text)), lambda t: kinds(text, t)))
    return found["kind"], found["remote"], found["shift"], found["fly"]


def support_bucket(n: Column) -> Column:
    """CAT-09: right-closed intervals."""
    return F.when(n <= 10, "very_low").when(n <= 30, "low").when(n <= 60, "medium").when(n <= 150, "high").when(n > 150, "very_high")


def rare(value: Column, n: Column, least: int, name: str) -> Column:
    """CAT-10."""
    return F.when(n >= least, value).otherwise(F.lit(name))


# Keywords of education levels in the order in which they are tried.
EDUCATION = (
    ("HIGH", ("высшее", "бакалавриат", "специалитет", "магистратура", "аспирантура", "доктор", "подготовка кадров высшей квалификации")),
    ("MIDDLE_SPECIAL", ("среднее профессиональное", "спо", "колледж", "техникум")),
    ("MIDDLE", ("среднее общее", "11 классов", "9 классов", "общее образование")),
)


def education(c: Column) -> Column:
    """CAT-06."""
    return once(clean_text(c), lambda t: keyword_category(t, EDUCATION, "NONE", "NONE"))


def in_group(c: Column, named: tuple[str, ...], district: Column, districts: tuple[str, ...], yes: str, middle: str | None, no: str) -> Column:
    """CAT-07 and CAT-08: named regions, then districts, then the rest."""
    return F.when(c.isin(*named), yes).when(district.isin(*districts), middle or yes).otherwise(no)


def busy_type(c: Column) -> Column:
    """CAT-12."""
    t = F.upper(clean_text(c))
    return F.when(t.rlike("УДАЛЁНН|REMOTE"), "REMOTE").when(t.rlike("ПОЛНАЯ|FULL"), "FULL").otherwise(c)
