"""Sources -> role tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cohort import build_cohort
from ..sources import sinks
from ..sources.extract import (
    DEATH_SCHEMA,
    DiagnosisShape,
    extract_cohort,
    extract_deaths,
    extract_diagnoses,
    extract_level_observations,
    extract_visit_summary,
    extract_visits,
)
from ..sources.tables import choose_by_coverage, first_readable, schema_snapshot


@dataclass(frozen=True)
class Sources:
    """Source tables and how to read the diagnoses among them."""

    cohort: DataFrame
    diagnoses: DataFrame
    visits: DataFrame
    deaths: DataFrame
    observations: DataFrame
    concept: DataFrame | None = None
    shape: DiagnosisShape = DiagnosisShape.PERSON_CONDITIONS
    distinct_patient_code: bool = False
    deaths_name: str | None = None
    level_pattern: str = "GMFCS"


@dataclass(frozen=True)
class Extract:
    cohort: DataFrame
    diagnoses: DataFrame
    visits: DataFrame
    deaths: DataFrame
    observations: DataFrame
    snapshot: DataFrame
    fallback_used: bool


def read_deaths(spark, names: list[str]) -> tuple[DataFrame, str | None]:
    """First death table that exists, else a typed empty one."""
    return first_readable(spark, names, DEATH_SCHEMA)


def extract_all(
    sources: Sources,
    fallback: Callable[[], Sources] | None = None,
    minimum_diagnosis_patients: int = 0,
    raw_visits: bool = False,
    limit_rows: int | None = None,
) -> Extract:
    """All role tables, lazily. The coverage test runs one count only when a minimum is set."""

    def diagnoses_of(s: Sources) -> DataFrame:
        return extract_diagnoses(s.diagnoses, s.cohort, s.shape, s.distinct_patient_code, s.concept, limit_rows)

    diagnoses, used = diagnoses_of(sources), False
    if fallback is not None:
        spare = fallback()
        diagnoses, used = choose_by_coverage(
            diagnoses, lambda: diagnoses_of(spare), minimum_diagnosis_patients, limit_rows
        )
        sources = spare if used else sources
    if raw_visits or limit_rows:
        visits = extract_visits(sources.visits, sources.cohort, limit_rows)
    else:
        visits = extract_visit_summary(sources.visits, sources.cohort)
    deaths = extract_deaths(sources.deaths, sources.deaths_name, sources.cohort, limit_rows)
    observations = extract_level_observations(sources.observations, sources.cohort, sources.level_pattern, limit_rows)
    cohort = build_cohort(extract_cohort(sources.cohort, limit_rows), visits, deaths, observations)
    tables = {
        "cohort": sources.cohort, "visits": sources.visits, "observations": sources.observations,
        "deaths": sources.deaths, "diagnoses": sources.diagnoses,
    }
    if sources.concept is not None:
        tables["concept"] = sources.concept
    return Extract(cohort, diagnoses, visits, deaths, observations, schema_snapshot(cohort.sparkSession, tables), used)


def extract_summary(extract: Extract) -> DataFrame:
    """One row of counts over the extracted tables."""
    people = extract.cohort.agg(
        F.count(F.lit(1)).alias("cohort_rows"), F.count("gmfcs_level").alias("gmfcs_patients")
    )
    events = extract.diagnoses.agg(
        F.count(F.lit(1)).alias("diagnosis_rows"),
        F.countDistinct("person_id").alias("diagnosis_patients"),
        F.countDistinct("source_code").alias("diagnosis_unique_source_codes"),
    )
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    one = lambda df, c: df.select(c).scalar()
    return people.select(
        "cohort_rows", "gmfcs_patients",
        *[one(events, c).alias(c) for c in events.columns],
        rows(extract.visits).alias("visit_rows"),
        rows(extract.deaths).alias("death_rows"),
        rows(extract.observations).alias("gmfcs_observation_rows"),
        F.lit(extract.fallback_used).alias("diagnosis_fallback_used"),
    )


def write_extract(extract: Extract, out: str) -> None:
    for name in ("cohort", "diagnoses", "visits", "deaths", "observations"):
        sinks.write_parquet(getattr(extract, name), f"{out}/{name}.parquet")
    sinks.write_json(extract.snapshot, f"{out}/schema_snapshot.json")
    sinks.write_json(extract_summary(extract), f"{out}/extract_summary.json")
