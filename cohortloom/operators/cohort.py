"""Person-level tables: visits, levels, deaths, eligibility, de-identification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import drop_point_zero
from ..functions.measures import day_span, to_number
from ..sources.tables import column_names

VISIT_SUMMARY_COLUMNS = ["person_id", "num_visits", "first_visit_date", "last_visit_date", "visit_duration_days"]
# Columns that hold direct dates, and demographic columns that may be kept.
DIRECT_DATE_COLUMNS = [
    "BIRTH_DATETIME", "YEAR_OF_BIRTH", "MONTH_OF_BIRTH", "DAY_OF_BIRTH",
    "FIRST_VISIT_DATETIME", "DEATH_DATE", "CP_DX_DATE",
]
DEMOGRAPHIC_COLUMNS = [
    "PERSON_ID", "GENDER_CONCEPT_ID", "GENDER_SOURCE_VALUE", "NUM_VISITS_TOTAL", "RACE_CONCEPT_ID",
    "RACE_SOURCE_VALUE", "ETHNICITY_CONCEPT_ID", "DEATH_DATE", "GMFCS_M", "CP_DX_SS", "CP_DX_AGE_INT",
    "NUM_VISITS_TOTAL_FILTERED", "VISIT_LENGTH", "INPERSON_VISIT_NUM", "gmfm_score", "qol_score",
]


def summarize_visits(visits: DataFrame) -> DataFrame:
    """Visit count and date span per person; an existing summary passes through."""
    if set(VISIT_SUMMARY_COLUMNS) <= column_names(visits):
        return visits.select(*VISIT_SUMMARY_COLUMNS)
    start = F.to_date("visit_start_date")
    return (
        visits.groupBy("person_id")
        .agg(
            F.countDistinct("visit_occurrence_id").alias("num_visits"),
            F.min(start).alias("first_visit_date"),
            F.max(start).alias("last_visit_date"),
        )
        .withColumn("visit_duration_days", day_span(F.col("first_visit_date"), F.col("last_visit_date")).cast("long"))
    )


def latest_level(observations: DataFrame, missing_time_last: bool = True) -> DataFrame:
    """Latest observation with a level, per person.

    The pick is a maximum over (time, id), so each map task sends one row per
    person and a person with very many observations costs no more than others.
    ``missing_time_last=False`` prefers rows without a time.
    """
    when = F.coalesce(F.col("observation_datetime").cast("timestamp_ntz"), F.col("observation_date").cast("timestamp_ntz"))
    untimed = when.isNull() if not missing_time_last else when.isNotNull()
    rank = F.struct(untimed.alias("a"), when.alias("b"), F.col("observation_id").alias("c"))
    picked = F.struct("gmfcs_level", "observation_datetime", "observation_source_value")
    return (
        observations.filter(F.col("gmfcs_level").isNotNull())
        .groupBy("person_id")
        .agg(F.max_by(picked, rank).alias("p"))
        .select(
            "person_id",
            F.col("p.gmfcs_level").alias("gmfcs_level"),
            F.col("p.observation_datetime").alias("gmfcs_observation_datetime"),
            F.col("p.observation_source_value").alias("gmfcs_source"),
        )
    )


def build_cohort(cohort: DataFrame, visits: DataFrame, deaths: DataFrame, observations: DataFrame) -> DataFrame:
    """Cohort with visit summary, latest level and death flag."""
    died = deaths.select("person_id").distinct().withColumn("death", F.lit(1))
    return (
        cohort.join(summarize_visits(visits), "person_id", "left")
        .join(latest_level(observations), "person_id", "left")
        .join(died, "person_id", "left")
        .na.fill(0, ["death", "num_visits"])
    )


def eligible_persons(cohort: DataFrame, min_visits: int | None = None, require_level: bool = False) -> DataFrame:
    """Ids of persons with enough visits and, if asked, a level."""
    kept = cohort
    if min_visits is not None:
        kept = kept.filter(to_number(F.col("num_visits")) >= int(min_visits))
    if require_level:
        kept = kept.filter(F.col("gmfcs_level").isNotNull())
    return kept.select(F.col("person_id").cast("string").alias("person_id")).distinct()


def eligibility_counts(cohort: DataFrame, min_visits: int | None = None, require_level: bool = False) -> DataFrame:
    """Distinct persons before and after the filter, in one pass."""
    keep = F.lit(True)
    if min_visits is not None:
        keep = keep & (to_number(F.col("num_visits")) >= int(min_visits))
    if require_level:
        keep = keep & F.col("gmfcs_level").isNotNull()
    person = F.col("person_id").cast("string")
    flagged = cohort.groupBy(person.alias("person_id")).agg(F.max(keep.cast("int")).alias("kept"))
    return flagged.agg(
        F.count(F.lit(1)).alias("cohort_patients_before_filter"),
        F.sum("kept").alias("cohort_patients_after_filter"),
    )


def first_event_per_person(events: DataFrame, person: str, when: str, tiebreak: str) -> DataFrame:
    """Whole first row per person by time, rows without a time last."""
    order = F.struct(F.col(when).isNull().alias("a"), F.col(when).alias("b"), F.col(tiebreak).alias("c"))
    return events.groupBy(person).agg(F.min_by(F.struct(*events.columns), order).alias("r")).select("r.*")


def keep_demographics(df: DataFrame, allowed: list[str] = DEMOGRAPHIC_COLUMNS) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def strip_direct_dates(df: DataFrame) -> DataFrame:
    """Drop direct dates; a death date leaves a 0/1 flag behind."""
    if "DEATH_DATE" in df.columns:
        df = df.withColumn("DEATH", F.col("DEATH_DATE").isNotNull().cast("int"))
    return df.drop(*[c for c in df.columns if c.upper() in DIRECT_DATE_COLUMNS])


def keep_with_level(metadata: DataFrame, level: str = "GMFCS_M", require_level: bool = True) -> DataFrame:
    return metadata.filter(F.col(level).isNotNull()) if require_level else metadata


def reference_person_metadata(events: DataFrame, tiebreak: str) -> DataFrame:
    """Demographics of each person's first event, keyed by the cleaned id."""
    first = first_event_per_person(events, "PERSON_ID", "CONDITION_START_DATETIME", tiebreak)
    return keep_demographics(first).withColumn("person_id_norm", drop_point_zero(F.col("PERSON_ID")))
