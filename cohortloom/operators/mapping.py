"""Code map loading and event mapping with audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import (
    blank_to_null,
    infer_vocabulary,
    named_vocabulary,
    normalize_icd,
    normalize_vocabulary,
    strip,
    vocabulary_of,
)
from ..sources.tables import normalize_column_names, pick_column

# Accepted column names of maps and definitions, in order of preference.
CODE_COLUMNS = ["icd", "icd_code", "icd9", "icd10", "icd9cm", "icd10cm", "icd9cm_v1", "icd10cm_v1", "code"]
TARGET_COLUMNS = ["phecode", "phe_code"]
NAME_COLUMNS = ["phecode_str", "phenotype", "phecode_string", "phecodestring", "description"]
CATEGORY_COLUMNS = ["phecode_category", "phecodecategory", "category"]
VOCABULARY_COLUMNS = ["vocabulary_id", "vocabulary", "flag", "code_type", "icd_version"]
DEFINITION_NAME_COLUMNS = ["phenotype", "phecode_str", "description"]
DEFINITION_CATEGORY_COLUMNS = ["category", "phecode_category", "group"]


@dataclass(frozen=True)
class MappedEvents:
    """Mapped event rows, audit per vocabulary, and summary of unmapped codes; ``rows`` are those the audit counts, if a map was used."""

    events: DataFrame
    audit: DataFrame
    unmapped: DataFrame
    rows: DataFrame | None = None


def code_definitions(raw: DataFrame) -> DataFrame | None:
    """One (phecode, name, category) row per phecode; the least text wins among repeats."""
    raw = normalize_column_names(raw)
    target = pick_column(raw.columns, TARGET_COLUMNS)
    if target is None:
        return None
    name = pick_column(raw.columns, DEFINITION_NAME_COLUMNS)
    category = pick_column(raw.columns, DEFINITION_CATEGORY_COLUMNS)
    chosen = {"phecode_str": name, "phecode_category": category}
    texts = [F.min(strip(F.col(source))).alias(alias) for alias, source in chosen.items() if source]
    return raw.groupBy(strip(F.col(target)).alias("phecode")).agg(*texts) if texts else raw.select(
        strip(F.col(target)).alias("phecode")
    ).distinct()


def code_map(raw: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(icd_code, norm_code, phecode, vocabulary_id, name, category) rows of a raw map."""
    raw = normalize_column_names(raw)
    code, target = pick_column(raw.columns, CODE_COLUMNS), pick_column(raw.columns, TARGET_COLUMNS)
    if code is None or target is None:
        raise ValueError(f"code map needs a code and a phecode column, found {raw.columns}")
    name = pick_column(raw.columns, NAME_COLUMNS)
    category = pick_column(raw.columns, CATEGORY_COLUMNS)
    vocabulary = pick_column(raw.columns, VOCABULARY_COLUMNS)
    source = F.col(code)
    columns = [
        source.alias("icd_code"),
        normalize_icd(source).alias("norm_code"),
        blank_to_null(F.col(target)).alias("phecode"),
        (normalize_vocabulary(F.col(vocabulary), source) if vocabulary else infer_vocabulary(source)).alias(
            "vocabulary_id"
        ),
        (blank_to_null(F.col(name)) if name else F.lit(None).cast("string")).alias("phecode_str"),
    ]
    if category:
        columns.append(blank_to_null(F.col(category)).alias("phecode_category"))
    result = raw.select(*columns)
    if definitions is not None:
        result = fill_from_definitions(result, definitions)
    return result.filter(
        (F.col("norm_code") != "") & F.col("phecode").isNotNull() & F.col("vocabulary_id").isNotNull()
    ).distinct()


def fill_from_definitions(mapping: DataFrame, definitions: DataFrame) -> DataFrame:
    """Take missing names and categories from the definitions."""
    texts = [c for c in ("phecode_str", "phecode_category") if c in definitions.columns]
    side = definitions.select("phecode", *[F.col(c).alias(f"{c}_definition") for c in texts])
    joined = mapping.join(side, "phecode", "left")
    for c in texts:
        own = F.col(c) if c in mapping.columns else F.lit(None).cast("string")
        joined = joined.withColumn(c, F.coalesce(own, f"{c}_definition")).drop(f"{c}_definition")
    return joined


def with_code_keys(diagnoses: DataFrame, code: str = "source_code") -> DataFrame:
    """Add the normalised code and vocabulary used to look codes up."""
    if code not in diagnoses.columns:
        raise ValueError(f"diagnoses lack {code}")
    inferred = vocabulary_of(F.col("norm_code"))
    if "vocabulary_id" in diagnoses.columns:
        inferred = F.coalesce(named_vocabulary(F.col("vocabulary_id")), inferred)
    return diagnoses.withColumn("norm_code", normalize_icd(F.col(code))).withColumn("vocabulary_id", inferred)


def join_code_map(diagnoses: DataFrame, mapping: DataFrame, code: str = "source_code") -> DataFrame:
    """Left join on (norm_code, vocabulary_id); a code with several targets repeats its row."""
    side = mapping.select([c for c in mapping.columns if c in ("norm_code", "vocabulary_id") or c not in diagnoses.columns])
    return with_code_keys(diagnoses, code).join(side, ["norm_code", "vocabulary_id"], "left")


def mapping_audit(mapped: DataFrame, event_key: str | None = None) -> DataFrame:
    """Mapping coverage per vocabulary, NULL being a group of its own.

    ``rows`` counts rows after the join, repeats included. With an event key the
    number of events before the join is given too.
    """
    measures = [
        F.count(F.lit(1)).alias("rows"),
        F.count("phecode").alias("mapped_rows"),
        F.countDistinct("norm_code").alias("unique_codes"),
    ]
    if event_key:
        measures.append(F.countDistinct(event_key).alias("source_rows"))
    return mapped.groupBy("vocabulary_id").agg(*measures).withColumn(
        "mapping_rate", F.col("mapped_rows") / F.col("rows")
    )


def unmapped_codes(mapped: DataFrame, code: str = "source_code") -> DataFrame:
    """Rows and persons per unmapped code, largest first."""
    return (
        mapped.filter(F.col("phecode").isNull())
        .groupBy("vocabulary_id", "norm_code", code)
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("person_id").alias("persons"))
        .orderBy(F.desc("rows"), F.desc("persons"), "vocabulary_id", "norm_code", code)
    )


def map_events(diagnoses: DataFrame, mapping: DataFrame, code: str = "source_code") -> MappedEvents:
    mapped = join_code_map(diagnoses, mapping, code)
    return MappedEvents(
        events=mapped.filter(F.col("phecode").isNotNull()),
        audit=mapping_audit(mapped),
        unmapped=unmapped_codes(mapped, code),
        rows=mapped,
    )


def has_premapped_codes(diagnoses: DataFrame) -> bool:
    """Whether any row already carries a phecode."""
    if "phecode" not in diagnoses.columns:
        return False
    return not diagnoses.filter(F.col("phecode").isNotNull()).select("phecode").isEmpty()


def any_premapped(diagnoses: DataFrame) -> DataFrame:
    """The same test as a one-row table."""
    return diagnoses.agg((F.count("phecode") > 0).alias("has_premapped"))


def drop_empty_columns(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Drop those candidate columns that hold no value at all, found in one pass."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return df.drop(*[c for c in present if counts[c] == 0])


def _premapped(diagnoses: DataFrame) -> DataFrame:
    code = F.when(strip(F.col("phecode")) != "", strip(F.col("phecode")))
    name = F.col("phecode_str") if "phecode_str" in diagnoses.columns else F.lit(None).cast("string")
    return diagnoses.withColumn("phecode", code).withColumn("phecode_str", F.coalesce(name, code))


def premapped_audit(diagnoses: DataFrame) -> DataFrame:
    """Coverage of codes that came mapped; blank codes count as unmapped."""
    rows = _premapped(diagnoses)
    person = F.when(F.col("phecode").isNotNull(), F.col("person_id"))
    return rows.agg(
        F.lit("premapped_phecode").alias("mapping_source"),
        F.count(F.lit(1)).alias("diagnosis_rows"),
        F.count("phecode").alias("mapped_rows"),
        F.count_if(F.col("phecode").isNull()).alias("unmapped_rows"),
        F.countDistinct(person).alias("mapped_patients"),
        F.countDistinct("phecode").alias("mapped_phecodes"),
    )


def premapped_events(diagnoses: DataFrame) -> MappedEvents:
    rows = _premapped(diagnoses)
    return MappedEvents(
        events=rows.filter(F.col("phecode").isNotNull()),
        audit=premapped_audit(diagnoses),
        unmapped=rows.filter(F.col("phecode").isNull()),
    )
