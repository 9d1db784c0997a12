"""Diagnoses -> feature matrix."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import matches_code
from ..operators.cohort import eligible_persons
from ..operators.features import FeatureMatrix, build_matrix, feature_events, feature_metadata, with_feature_ids
from ..operators.mapping import MappedEvents, drop_empty_columns, has_premapped_codes, map_events, mapping_audit, premapped_events
from ..session import cut_lineage
from ..settings import MatrixSettings
from ..sources import sinks
from ..sources.tables import read_table


@dataclass(frozen=True)
class MatrixBuild:
    matrix: FeatureMatrix
    events: DataFrame
    metadata: DataFrame
    audit: DataFrame
    unmapped: DataFrame
    mapping_source: str
    settings: MatrixSettings = MatrixSettings()
    rows: DataFrame | None = None


def build_feature_matrix(
    diagnoses: DataFrame,
    code_map: DataFrame,
    settings: MatrixSettings = MatrixSettings(),
    cohort: DataFrame | None = None,
    premapped: bool | None = None,
) -> MatrixBuild:
    """Eligible persons -> mapped events -> long binary matrix.

    ``premapped=None`` looks whether any row carries a code of its own; if one
    does, the map is not used for any row.
    """
    rows = diagnoses.withColumn("person_id", F.col("person_id").cast("string"))
    if cohort is not None:
        persons = eligible_persons(cohort, settings.min_visits, settings.require_level)
        rows = rows.join(persons, "person_id", "left_semi")
    if has_premapped_codes(rows) if premapped is None else premapped:
        mapped: MappedEvents = premapped_events(rows)
        source = "premapped_phecode"
    else:
        rows = drop_empty_columns(rows, ["phecode", "phecode_str", "phecode_category"])
        # Feature ids are made on the map, once per code instead of once per event.
        mapped = map_events(rows, with_feature_ids(code_map, settings.feature_prefix))
        source = "icd_phecode_map"
    events = feature_events(mapped.events, settings.exclude_codes, settings.feature_prefix)
    matrix = build_matrix(events, settings.min_patients)
    metadata = feature_metadata(events).join(matrix.cells.select("feature_id"), "feature_id", "left_semi")
    return MatrixBuild(matrix, events, metadata, mapped.audit, mapped.unmapped, source, settings, mapped.rows)


def materialise(build: MatrixBuild) -> MatrixBuild:
    """Write events, persons and cells once, for steps that read the matrix many times.

    Rows without a target are written with the events, so that the audit counts
    what is written and the sources are not read and mapped once more for it.
    """
    wanted = ("person_id", "feature_id", "phecode", "phecode_str", "phecode_category")
    wanted = [c for c in wanted if c in build.events.columns]
    if build.rows is None:
        events, audit = cut_lineage(build.events.select(*wanted)), build.audit
    else:
        target, codes = F.col("phecode"), build.settings.exclude_codes
        kept = target.isNotNull() & ~matches_code(target, codes, build.settings.feature_prefix, F.col("feature_id"))
        rows = build.rows.withColumn("_kept", F.coalesce(kept, F.lit(False)))
        rows = cut_lineage(rows.select(*wanted, "norm_code", "vocabulary_id", "_kept"))
        events, audit = rows.filter("_kept").select(*wanted), mapping_audit(rows)
    fresh = build_matrix(events, build.settings.min_patients)
    matrix = FeatureMatrix(cut_lineage(fresh.persons), cut_lineage(fresh.cells))
    metadata = feature_metadata(events).join(matrix.cells.select("feature_id"), "feature_id", "left_semi")
    return replace(build, events=events, matrix=matrix, metadata=metadata, audit=audit)


def matrix_summary(build: MatrixBuild) -> DataFrame:
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return build.matrix.cells.agg(
        F.countDistinct("feature_id").alias("n_features"), F.count(F.lit(1)).alias("n_ones")
    ).select(
        rows(build.matrix.persons).alias("n_patients"), "n_features", "n_ones",
        rows(build.events).alias("n_event_rows"), F.lit(build.mapping_source).alias("mapping_source"),
    )


def write_matrix(build: MatrixBuild, out: str) -> None:
    sinks.write_parquet(build.events, f"{out}/phecode_events.parquet")
    sinks.write_parquet(build.matrix.cells, f"{out}/feature_cells.parquet")
    sinks.write_parquet(build.matrix.persons, f"{out}/persons.parquet")
    sinks.write_csv(build.metadata, f"{out}/feature_metadata.csv")
    sinks.write_csv(build.audit, f"{out}/mapping_audit.csv")
    sinks.write_csv(build.unmapped, f"{out}/unmapped_codes.csv")


def read_matrix(spark: SparkSession, folder: str) -> FeatureMatrix:
    """Matrix written by ``write_matrix``."""
    return FeatureMatrix(
        read_table(spark, f"{folder}/persons.parquet"), read_table(spark, f"{folder}/feature_cells.parquet")
    )
