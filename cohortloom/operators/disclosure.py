"""Subgroup sizes before data are shared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_to_roman, normalize_cluster
from ..sources.tables import choose_column

# Accepted column names, in order of preference.
PERSON_COLUMNS = ["person_id", "PERSON_ID", "h5ad_id", "numeric_person_id"]
CLUSTER_COLUMNS = [
    "stored_graph_published", "reference_subtype", "stored_graph_letter", "subtype", "cluster", "Cluster",
]
LEVEL_COLUMNS = ["GMFCS", "GMFCS_M", "gmfcs_level"]


def join_assignments(
    assignments: DataFrame,
    cohort: DataFrame,
    cluster: str | None = None,
    level: str | None = None,
    assignment_person: str | None = None,
    cohort_person: str | None = None,
) -> DataFrame:
    """(person_id, cluster, gmfcs) of persons found on both sides, columns picked by name."""
    left = assignments.select(
        F.col(assignment_person or choose_column(assignments, PERSON_COLUMNS, "assignment person")).cast("string").alias("person_id"),
        F.col(cluster or choose_column(assignments, CLUSTER_COLUMNS, "cluster")).alias("cluster"),
    )
    right = cohort.select(
        F.col(cohort_person or choose_column(cohort, PERSON_COLUMNS, "cohort person")).cast("string").alias("person_id"),
        F.col(level or choose_column(cohort, LEVEL_COLUMNS, "level")).alias("gmfcs"),
    )
    return left.join(right, "person_id")


def normalized_subgroups(data: DataFrame, cluster: str = "cluster", level: str = "gmfcs") -> DataFrame:
    return data.select("person_id", normalize_cluster(F.col(cluster)).alias("cluster"), level_to_roman(F.col(level)).alias("gmfcs"))


def subgroup_sizes(data: DataFrame, cluster: str = "cluster", level: str = "gmfcs") -> DataFrame:
    """Distinct persons per (cluster, level); rows without either are left out."""
    rows = normalized_subgroups(data, cluster, level).na.drop(subset=["cluster", "gmfcs"])
    return rows.groupBy("cluster", "gmfcs").agg(F.countDistinct("person_id").alias("n_patients"))


def flag_small_cells(counts: DataFrame, threshold: int = 10) -> DataFrame:
    return counts.withColumn("threshold", F.lit(int(threshold)).cast("long")).withColumn(
        "below_threshold", F.col("n_patients") < int(threshold)
    )


def cell_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("n_subgroups"),
        F.coalesce(F.min("n_patients"), F.lit(0)).cast("long").alias("minimum_subgroup_size"),
        F.count_if("below_threshold").alias("n_below_threshold"),
    )


def dropped_rows(data: DataFrame) -> DataFrame:
    """Rows the check cannot place: no cluster, or a text that is no level."""
    rows = normalized_subgroups(data)
    return rows.agg(
        F.countDistinct("person_id").alias("n_joined_patients"),
        F.count_if(F.col("cluster").isNull()).alias("n_without_cluster"),
        F.count_if(F.col("gmfcs").isNull()).alias("n_without_level"),
    )
