"""User-level readers: each turns source tables into one role table, lazily."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import contains_ignore_case
from ..functions.levels import parse_level
from .tables import column_names, conform, normalize_column_names, ordered_limit

_LONG, _TEXT, _DOUBLE, _DATE, _TIME = (
    T.LongType(), T.StringType(), T.DoubleType(), T.DateType(), T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Column names and types of the role tables.
COHORT_SCHEMA = _schema(
    person_id=_LONG, person_source_value=_TEXT, gender_source_value=_TEXT, race_source_value=_TEXT,
    ethnicity_source_value=_TEXT, year_of_birth=_LONG, month_of_birth=_LONG, day_of_birth=_LONG,
    birth_date=_DATE, birth_datetime=_TIME,
)
PREMAPPED_SCHEMA = _schema(phecode=_TEXT, phecode_str=_TEXT, phecode_category=_TEXT, icd_10=_TEXT, icd=_TEXT)
OBSERVATION_SCHEMA = _schema(
    person_id=_LONG, visit_occurrence_id=_LONG, observation_id=_LONG, observation_source_value=_TEXT,
    observation_date=_DATE, observation_datetime=_TIME, value_as_string=_TEXT, value_source_value=_TEXT,
    value_as_number=_DOUBLE, value_as_concept_id=_LONG,
)
DEATH_SCHEMA = _schema(person_id=_LONG, death_date=_DATE, death_datetime=_TIME, source_table=_TEXT)
VISIT_COLUMNS = [
    "person_id", "visit_occurrence_id", "visit_start_date", "visit_start_datetime",
    "visit_end_date", "visit_end_datetime", "visit_source_value", "visit_concept_id",
]


class DiagnosisShape(Enum):
    PERSON_CONDITIONS = "cp_person_conditions"
    CONDITION_OCCURRENCE = "condition_occurrence"


def restrict_to_cohort(df: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of cohort members; a repeated cohort id does not repeat rows."""
    return df.join(cohort.select("person_id"), "person_id", "left_semi")


def extract_cohort(table: DataFrame, limit_rows: int | None = None) -> DataFrame:
    return ordered_limit(conform(normalize_column_names(table), COHORT_SCHEMA), ["person_id"], limit_rows)


def lookup_concepts(events: DataFrame, concept: DataFrame | None) -> DataFrame:
    """Code, name, category and vocabulary from the concept dimension, else the source value.

    Whether the dimension is broadcast is left to Spark's own size check; a
    larger one joins by shuffle with skewed keys split at run time.
    """
    value = F.col("condition_source_value")
    null = F.lit(None).cast("string")
    if concept is None:
        return events.select(
            "*", value.alias("source_code"), null.alias("source_name"),
            null.alias("diagnosis_category"), null.alias("vocabulary_id"),
        )
    dimension = concept.select(
        F.col("concept_id").alias("condition_source_concept_id"),
        "concept_code", "concept_name", "domain_id", "vocabulary_id",
    )
    return (
        events.join(dimension, "condition_source_concept_id", "left")
        .withColumn("source_code", F.coalesce("concept_code", value))
        .withColumn("source_name", F.coalesce("concept_name", value))
        .withColumnRenamed("domain_id", "diagnosis_category")
    )


def extract_diagnoses(
    events: DataFrame,
    cohort: DataFrame,
    shape: DiagnosisShape = DiagnosisShape.PERSON_CONDITIONS,
    distinct_patient_code: bool = False,
    concept: DataFrame | None = None,
    limit_rows: int | None = None,
) -> DataFrame:
    """Coded events of the cohort, one row per event or one per (person, code)."""
    events = normalize_column_names(events)
    if shape is DiagnosisShape.CONDITION_OCCURRENCE:
        coded = events.filter(F.col("condition_source_value").isNotNull())
        coded = lookup_concepts(restrict_to_cohort(coded, cohort), concept)
        day: Column = F.col("condition_start_date")
        extra = ["vocabulary_id"]
        keys = ["person_id", "source_code", "vocabulary_id"]
    else:
        coded = restrict_to_cohort(events.filter(F.col("dx_code_char").isNotNull()), cohort)
        present = column_names(coded)
        for field in PREMAPPED_SCHEMA.fields:
            if field.name not in present:
                coded = coded.withColumn(field.name, F.lit(None).cast(field.dataType))
        coded = (
            coded.withColumnRenamed("dx_code_char", "source_code")
            .withColumnRenamed("dx_name", "source_name")
            .withColumnRenamed("dx_category", "diagnosis_category")
        )
        day = F.to_date("condition_start_datetime")
        extra = PREMAPPED_SCHEMA.fieldNames()
        keys = ["person_id", "source_code"]
    coded = coded.withColumn("diagnosis_datetime", F.col("condition_start_datetime")).withColumn("diagnosis_date", day)

    if not distinct_patient_code:
        rows = coded.select(
            "person_id", "visit_occurrence_id", "condition_occurrence_id", "source_code", "source_name",
            "diagnosis_category", "diagnosis_datetime", "diagnosis_date", *extra,
            F.lit(1).cast("long").alias("event_count"), F.lit(shape.value).alias("source_table"),
        )
        return ordered_limit(rows, ["person_id", "diagnosis_datetime"], limit_rows)

    rolled = roll_up_codes(
        coded, keys,
        ["source_name", "diagnosis_category", "diagnosis_datetime", "diagnosis_date", *[c for c in extra if c not in keys]],
    )
    rows = rolled.select(
        "person_id",
        F.lit(None).cast("long").alias("visit_occurrence_id"),
        F.lit(None).cast("long").alias("condition_occurrence_id"),
        "source_code", "source_name", "diagnosis_category", "diagnosis_datetime", "diagnosis_date", *extra,
        "event_count", F.lit(f"{shape.value}_patient_code").alias("source_table"),
    )
    return ordered_limit(rows, ["person_id", "source_code"], limit_rows)


def roll_up_codes(events: DataFrame, keys: list[str], least: list[str]) -> DataFrame:
    """One row per key with the least value of each other column and the event count."""
    return events.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in least], F.count(F.lit(1)).alias("event_count")
    )


def extract_visits(visits: DataFrame, cohort: DataFrame, limit_rows: int | None = None) -> DataFrame:
    rows = restrict_to_cohort(normalize_column_names(visits).select(*VISIT_COLUMNS), cohort)
    return ordered_limit(rows, ["person_id", "visit_start_date"], limit_rows)


def extract_visit_summary(visits: DataFrame, cohort: DataFrame) -> DataFrame:
    from ..operators.cohort import summarize_visits

    return summarize_visits(restrict_to_cohort(normalize_column_names(visits), cohort))


def extract_deaths(
    deaths: DataFrame, source_name: str | None, cohort: DataFrame, limit_rows: int | None = None
) -> DataFrame:
    """Deaths of the cohort with the name of the table they came from."""
    schema = T.StructType(DEATH_SCHEMA.fields[:3])
    rows = restrict_to_cohort(conform(normalize_column_names(deaths), schema), cohort)
    return ordered_limit(rows.withColumn("source_table", F.lit(source_name)), ["person_id"], limit_rows)


def extract_level_observations(
    observations: DataFrame, cohort: DataFrame, name_pattern: str = "GMFCS", limit_rows: int | None = None
) -> DataFrame:
    """Observations whose name holds the pattern, with the level read from their value."""
    rows = conform(normalize_column_names(observations), OBSERVATION_SCHEMA)
    rows = rows.filter(contains_ignore_case(F.col("observation_source_value"), name_pattern))
    rows = ordered_limit(restrict_to_cohort(rows, cohort), ["person_id", "observation_datetime"], limit_rows)
    value = F.coalesce("value_source_value", "value_as_string", F.col("value_as_number").cast("string"))
    return rows.withColumn("gmfcs_level", parse_level(value))
