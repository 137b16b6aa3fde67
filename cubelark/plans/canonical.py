"""From raw sources to canonical records: one lazy plan a source, marks and flags included."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubelark.functions import categories as CAT
from cubelark.functions import dates as DT
from cubelark.functions import money as MON
from cubelark.functions.text import clean_quoted, company_id, json_key, normalize_nulls, to_boolean, to_number
from cubelark.operators import quality as Q
from cubelark.operators.cube import require

# The canonical columns in order, and those that a source must have.
CANONICAL = (
    "source_dataset", "source_name", "source_file", "source_vacancy_id", "source_url", "vacancy_date", "vacancy_date_raw", "vacancy_date_type", "snapshot_date", "is_open",
    "title_raw", "title_normalized", "occupation_raw", "occupation_group", "occupation_code", "professional_sphere_raw", "professional_sphere_code",
    "employer_name", "employer_id", "employer_type", "industry_raw", "industry_group", "country", "region", "region_id", "federal_district", "city", "address_raw", "lat", "lon",
    "salary_from", "salary_to", "salary_mid", "salary_raw", "salary_currency", "salary_period", "salary_is_missing", "salary_bound_type", "salary_parse_status",
    "experience_raw", "experience_min_years", "experience_max_years", "experience_group", "employment_raw", "employment_type", "schedule_raw", "schedule_type", "is_remote", "is_shift", "is_fly_in_fly_out",
    "description_raw", "requirements_raw", "responsibilities_raw", "skills_raw", "skills_normalized", "education_raw", "education_level", "driver_license_required", "medical_card_required", "accommodation_available",
    "created_at_raw", "published_at_raw", "modified_at_raw", "last_seen_at_raw", "source_row_hash", "duplicate_group_id", "is_duplicate", "parse_warnings", "quality_flags",
)
REQUIRED = ("source_dataset", "source_vacancy_id")
TYPES = {"is_open": "boolean", "is_remote": "boolean", "is_shift": "boolean", "is_fly_in_fly_out": "boolean", "is_duplicate": "boolean", "salary_is_missing": "boolean", "salary_from": "double", "salary_to": "double", "salary_mid": "double", "experience_min_years": "double", "experience_max_years": "double", "lat": "double", "lon": "double", "vacancy_date": "timestamp", "snapshot_date": "timestamp", "quality_flags": "array<string>"}

# Which raw column each canonical column is read from.
RENAMED = {
    "trudvsem_latest": {
        "source_vacancy_id": "id", "source_url": "vacancyUrl", "vacancy_date_raw": "creationDate", "title_raw": "vacancyName", "occupation_raw": "typicalPosition", "occupation_code": "codeProfession",
        "professional_sphere_raw": "professionalSphereName", "professional_sphere_code": "codeProfessionalSphere", "employer_name": "fullCompanyName", "employer_type": "companyBusinessSize", "industry_raw": "industryBranchName",
        "region": "regionName", "region_id": "stateRegionCode", "federal_district": "federalDistrictCode", "address_raw": "vacancyAddress", "salary_from": "salaryMin", "salary_to": "salaryMax", "salary_raw": "salary",
        "experience_raw": "experienceRequirements", "employment_raw": "busyType", "schedule_raw": "scheduleType", "description_raw": "positionRequirements", "requirements_raw": "qualifications", "responsibilities_raw": "responsibilities",
        "skills_raw": "skills", "education_raw": "educationRequirements", "driver_license_required": "requiredDriveLicense", "medical_card_required": "needMedcard", "accommodation_available": "accommodationCapability",
        "created_at_raw": "creationDate", "published_at_raw": "datePublished", "modified_at_raw": "dateModify", "last_seen_at_raw": "changeTime",
    },
    "hh_github": {
        "source_vacancy_id": "id", "vacancy_date_raw": "published_at", "title_raw": "name", "occupation_raw": "professional_role", "employer_name": "employer_name", "city": "city", "salary_from": "salary_bottom", "salary_to": "salary_top",
        "salary_currency": "currency", "experience_raw": "experience", "schedule_raw": "schedule", "skills_raw": "key_skills", "published_at_raw": "published_at",
    },
    "hh_kaggle": {
        "source_vacancy_id": "id", "vacancy_date_raw": "date_of_post", "title_raw": "title", "employer_name": "company", "city": "location", "address_raw": "location", "salary_raw": "salary", "experience_raw": "experience",
        "employment_raw": "job_type", "schedule_raw": "job_type", "description_raw": "description", "skills_raw": "key_skills", "published_at_raw": "date_of_post",
    },
    "combined": {
        "source_vacancy_id": "id", "source_url": "link", "vacancy_date_raw": "last_found_at", "title_raw": "name", "occupation_raw": "role_name", "occupation_code": "role_id", "employer_name": "employer_name", "employer_id": "employer_id",
        "employer_type": "employer_type", "industry_raw": "employer_industry_name", "country": "country_name", "region": "region_name", "region_id": "region_id", "salary_from": "salary_from", "salary_to": "salary_to", "salary_raw": "salary",
        "experience_raw": "experience", "employment_raw": "employment", "schedule_raw": "schedule", "description_raw": "description", "requirements_raw": "requirements", "skills_raw": "raw_skills", "accommodation_available": "accomodation", "last_seen_at_raw": "last_found_at",
    },
}
# Where a source's date may be, in this order.
DATE_CANDIDATES = {
    "trudvsem_latest": ("created_at_raw", "creationDate", "vacancy_date_raw"), "hh_github": ("published_at_raw", "published_at", "vacancy_date_raw"),
    "hh_kaggle": ("published_at_raw", "date_of_post", "vacancy_date_raw"), "combined": ("last_seen_at_raw", "last_found_at", "vacancy_date_raw"),
}
DATE_TYPES = {"trudvsem_latest": "created_at", "hh_github": "published_at", "hh_kaggle": "published_at", "combined": "last_seen_at"}
FLAG_ORDER = ("impossible_date", "date_parse_failed", "salary_missing", "salary_zero_bound", "salary_inverted_bounds", "salary_extreme", "salary_non_rur", "missing_source_id", "missing_title", "short_title", "missing_geography")
SHORT_TITLE = 3


def _computed(source: str, raw: DataFrame) -> dict[str, Column]:
    """The columns that are more than another name."""
    c = lambda n: F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string")
    if source == "trudvsem_latest":
        return {"is_open": ~F.coalesce(to_boolean(c("deleted")), F.lit(False)), "employer_id": json_key(c("company"), "companyCode"), "country": F.lit("Россия"), "lat": json_key(c("geo"), "latitude"), "lon": json_key(c("geo"), "longitude")}
    if source == "hh_kaggle":
        return {"is_open": F.lower(c("type")) != "close"}
    if source == "combined":
        return {"is_open": to_boolean(c("is_open"))}
    return {}


def to_canonical(raw: DataFrame, source: str, company_fallback: bool = False) -> DataFrame:
    """The 69 columns from a raw source; columns that it lacks are null, those that have their canonical names already are taken as they are.

    The date comes from the first of the source's candidate columns that there is (DT-03); without any it is a KeyError.
    """
    if source not in RENAMED:
        raise ValueError(f"unsupported source {source!r}")
    dated = next((c for c in DATE_CANDIDATES[source] if c in raw.columns), None)
    if dated is None:
        raise KeyError(f"no date column for {source!r}; looked for {', '.join(DATE_CANDIDATES[source])}")
    names, special = RENAMED[source] | {"vacancy_date_raw": dated}, _computed(source, raw)
    if company_fallback and source == "trudvsem_latest" and "company" in raw.columns:
        special["employer_id"] = company_id(F.col("company"))

    def column(n: str) -> Column:
        if n == "source_dataset":
            return F.lit(source)
        if n == "vacancy_date_type":
            return F.lit(DATE_TYPES[source])
        value = special.get(n)
        if value is None:
            old = names.get(n) if names.get(n) in raw.columns else n
            value = F.col(f"`{old}`") if old in raw.columns else F.lit(None)
            value = clean_quoted(value.cast("string")) if source == "hh_github" else value
        kind = TYPES.get(n, "string")
        return value.cast("string") if n in ("salary_from", "salary_to", "lat", "lon") else value.cast(kind)

    return raw.select(*[column(n).alias(n) for n in CANONICAL])


def enrich(df: DataFrame, source: str, title_as_occupation: bool = False, fold_yo: bool = False, part_time_first: bool = False, word_bounds: bool = False) -> DataFrame:
    """Nulls, dates, salaries, categories, keys, marks and flags; the marks are the only shuffles."""
    require(df, REQUIRED)
    df = normalize_nulls(df)
    raw = F.col("vacancy_date_raw")
    df = df.crossJoin(F.broadcast(DT.looks_day_first(df, "vacancy_date_raw", "_day_first")))  # one row
    when = DT.parse_date(raw, F.col("_day_first"))
    df = df.withColumns({"vacancy_date": when, "snapshot_date": {"trudvsem_latest": DT.parse_date(F.col("modified_at_raw")), "combined": when}.get(source, F.lit(None).cast("timestamp"))}).drop("_day_first")
    df = df.withColumns({"vacancy_month": DT.month_label(F.col("vacancy_date")), "vacancy_date_parse_failed": DT.parse_failed(raw, F.col("vacancy_date")), **DT.date_flags("vacancy_date", raw, F.col("vacancy_date")), **DT.date_flags("snapshot_date", F.col("modified_at_raw"), F.col("snapshot_date"))})
    df = df.withColumn("has_impossible_date", DT.any_of([F.col(f"{n}_{k}") for n in ("vacancy_date", "snapshot_date") for k in ("is_before_min_date", "is_after_max_date", "has_impossible_year")]))
    if source == "hh_kaggle":
        parsed = MON.parse_salary(F.col("salary_raw"), word_bounds)
        low, high, currency, status = (parsed[n] for n in ("salary_from", "salary_to", "salary_currency", "salary_parse_status"))
    else:
        low, high, currency = to_number(F.col("salary_from")), to_number(F.col("salary_to")), F.col("salary_currency")
        status = F.when(low.isNotNull() | high.isNotNull(), "parsed").when(F.col("salary_from").isNull() & F.col("salary_to").isNull(), "missing").otherwise("unparsed")
    df = df.withColumns({"_low": low, "_high": high, "_currency": currency, "salary_parse_status": status})
    df = df.withColumns({"salary_from": MON.positive(F.col("_low")), "salary_to": MON.positive(F.col("_high")), "salary_currency": F.col("_currency")})
    df = df.withColumns({"salary_mid": MON.midpoint(F.col("salary_from"), F.col("salary_to")), "salary_bound_type": MON.bound_type(F.col("salary_from"), F.col("salary_to")), "salary_is_missing": F.col("salary_from").isNull() & F.col("salary_to").isNull(), **MON.salary_flags(F.col("salary_from"), F.col("salary_to"), F.col("_low"), F.col("_high"), F.col("salary_currency"))}).drop("_low", "_high", "_currency")
    name, unknown = CAT.region(F.col("region"))
    job = F.coalesce("occupation_raw", "title_raw") if title_as_occupation else F.col("occupation_raw")
    least, most, group = CAT.experience(F.col("experience_raw"))
    kind, remote, shift, fly = CAT.schedule(F.col("schedule_raw"), fold_yo, part_time_first)
    df = df.withColumns({"region_raw": F.col("region"), "region": name, "region_is_unknown": unknown, "occupation_group": CAT.occupation(job), "experience_min_years": least, "experience_max_years": most, "experience_group": group, "schedule_type": kind, "is_remote": remote, "is_shift": shift, "is_fly_in_fly_out": fly, "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "is_full_time": kind == "full_day"})
    text = lambda n: F.col(n).cast("string")
    df = df.withColumns({"source_row_hash": Q.row_hash([text(n) for n in Q.HASH_COLUMNS]), "source_key": Q.source_key(F.col("source_dataset"), F.col("source_vacancy_id"), [text(n) for n in Q.FALLBACK_COLUMNS])})
    df = Q.mark_duplicates(df.drop("is_duplicate", "duplicate_group_id"), "source_key", "source_row_hash")
    title = F.col("title_raw")
    holds = (F.col("has_impossible_date"), F.col("vacancy_date_parse_failed"), F.col("salary_has_missing_bounds"), F.col("salary_has_zero_bound"), F.col("salary_has_inverted_bounds"), F.col("salary_has_extreme_value"), F.col("salary_is_non_rur"), F.col("source_vacancy_id").isNull(), title.isNull(), F.char_length(title) < SHORT_TITLE, F.col("region").isNull() & F.col("city").isNull())
    flags, n = Q.quality_flags(dict(zip(FLAG_ORDER, holds, strict=True)))
    df = df.withColumns({"quality_flags": flags, "quality_flag_count": n})
    return df.select(*CANONICAL, *[c for c in df.columns if c not in CANONICAL])


@dataclass(frozen=True)
class SourceResult:
    """A source's records and its report, both lazy."""

    source: str
    records: DataFrame
    report: DataFrame


def process_source(raw: DataFrame, source: str, **options: bool) -> SourceResult:
    """The rows are dealt to all cores first: they are few bytes and much work, so a file of one or two splits would keep one or two tasks busy."""
    dealt = raw.repartition(raw.sparkSession.sparkContext.defaultParallelism)
    out = enrich(to_canonical(dealt, source), source, **options)
    return SourceResult(source, out, Q.processing_report(raw, out))


def merge_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """The gate and the union."""
    return Q.union_sources(frames, CANONICAL)
