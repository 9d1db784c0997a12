"""Cell-level matrix checks, label reconciliation and feature filter audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import canonical_float_code, drop_point_zero, is_present_code
from .labels import adjusted_rand

# Relative and absolute tolerance of "all close".
_RTOL, _ATOL = 1e-5, 1e-8


def count_of(df: DataFrame, column: str) -> Column:
    return df.agg(F.countDistinct(column)).scalar()


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def translate_ids(
    rows: DataFrame, crosswalk: DataFrame, source: str, target: str, key: str = "person_id", missing: str = "null"
) -> DataFrame:
    """Replace ids through a crosswalk.

    Ids without an entry become NULL (``missing="null"``), or fail the job that
    meets one (``missing="error"``). A null id has no entry.
    """
    if missing not in ("null", "error"):
        raise ValueError("missing must be null or error")
    side = crosswalk.select(
        drop_point_zero(F.col(source)).alias("_from"), drop_point_zero(F.col(target)).alias("_to")
    ).distinct()
    joined = rows.join(side, drop_point_zero(F.col(key)) == F.col("_from"), "left")
    if missing == "error":
        text = F.concat(F.lit("no entry in the crosswalk for id "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        joined = joined.withColumn("_to", F.when(F.col("_to").isNull(), F.raise_error(text)).otherwise(F.col("_to")))
    return joined.drop("_from", key).withColumnRenamed("_to", key)


def untranslated(rows: DataFrame, crosswalk: DataFrame, source: str, target: str, key: str = "person_id") -> DataFrame:
    """One row: how many rows and distinct ids a translation meets, and how many of each have no entry."""
    side = crosswalk.filter(F.col(target).isNotNull()).select(drop_point_zero(F.col(source)).alias("_from")).distinct()
    per_id = rows.groupBy(drop_point_zero(F.col(key)).alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    known = per_id.join(side.withColumn("found", F.lit(True)), F.col("_id") == F.col("_from"), "left")
    lost = F.col("found").isNull()
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return known.agg(
        whole(F.sum("n")).alias("rows"), F.count(F.lit(1)).alias("ids"),
        whole(F.sum(F.when(lost, F.col("n")))).alias("missing_rows"), whole(F.sum(lost.cast("long"))).alias("missing_ids"),
    )


def common_cells(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of both matrices on their common persons and features, full outer, absent = 0."""
    persons = left.select("person_id").distinct().join(right.select("person_id").distinct(), "person_id")
    features = left.select("feature_id").distinct().join(right.select("feature_id").distinct(), "feature_id")

    def cut(cells: DataFrame, name: str) -> DataFrame:
        kept = cells.join(persons, "person_id", "left_semi").join(features, "feature_id", "left_semi")
        return kept.select("person_id", "feature_id", F.col("value").cast("double").alias(name))

    joined = cut(left, "a").join(cut(right, "b"), ["person_id", "feature_id"], "full_outer").na.fill(0.0, ["a", "b"])
    return joined, persons, features


def matrix_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences over all cells of the common block; implicit zeros count as cells."""
    joined, persons, features = common_cells(left, right)
    n, d = persons.agg(F.count(F.lit(1))).scalar(), features.agg(F.count(F.lit(1))).scalar()
    gap = F.abs(F.col("a") - F.col("b"))
    return joined.agg(
        F.count_if(F.col("a") != 0).alias("left_nonzero"),
        F.count_if(F.col("b") != 0).alias("right_nonzero"),
        F.count_if(F.col("a") != F.col("b")).alias("cell_differences"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("_total"),
        F.coalesce(F.bool_and(gap <= _ATOL + _RTOL * F.abs(F.col("b"))), F.lit(True)).alias("all_close"),
    ).select(
        n.alias("common_patients"), d.alias("common_features"), "left_nonzero", "right_nonzero", "cell_differences",
        "max_abs_diff", F.coalesce(F.try_divide(F.col("_total"), n * d), F.lit(0.0)).alias("mean_abs_diff"), "all_close",
    )


def reconcile_labels(
    object_labels: DataFrame, obs: DataFrame, crosswalk: DataFrame, demo: DataFrame, published: DataFrame
) -> DataFrame:
    """One row per object id with the labels every other table gives it.

    object_labels (person_id, cluster, subtype), obs the same, crosswalk
    (object_id, numeric_id, subcluster), demo (person_id, subtype), published
    (person_id, cluster).
    """
    key = lambda name: drop_point_zero(F.col(name))
    base = object_labels.select(key("person_id").alias("id"), "cluster", "subtype")
    side_obs = obs.select(key("person_id").alias("id"), F.col("cluster").alias("obs_cluster"), F.col("subtype").alias("obs_subtype"))
    bridge = crosswalk.select(key("object_id").alias("id"), key("numeric_id").alias("numeric_id"), "subcluster")
    side_demo = demo.select(key("person_id").alias("numeric_id"), F.col("subtype").alias("demo_subtype"))
    side_published = published.select(key("person_id").alias("numeric_id"), F.col("cluster").alias("published"))
    return (
        base.join(side_obs, "id", "left")
        .join(bridge, "id", "left")
        .join(side_demo, "numeric_id", "left")
        .join(side_published, "numeric_id", "left")
    )


def label_audit(reconciled: DataFrame) -> DataFrame:
    """Rows compared and labels that agree, per table, plus the adjusted Rand index."""
    ari = adjusted_rand(reconciled, "cluster", "subtype").agg(F.max("ari")).scalar()
    same = lambda a, b: F.count_if(F.col(a) == F.col(b))
    return reconciled.agg(
        F.count("obs_cluster").alias("obs_rows_compared"),
        same("cluster", "obs_cluster").alias("obs_cluster_match"),
        same("subtype", "obs_subtype").alias("obs_subtype_match"),
        F.count("numeric_id").alias("crosswalk_rows"),
        F.countDistinct("numeric_id").alias("crosswalk_unique_ids"),
        F.countDistinct("subcluster").alias("unique_subclusters"),
        F.count("demo_subtype").alias("demo_rows_compared"),
        same("subtype", "demo_subtype").alias("demo_subtype_match"),
        F.count("published").alias("published_rows_compared"),
    ).withColumn("ari_cluster_vs_subtype", ari)


def code_prevalence(events: DataFrame, matrix_codes: DataFrame) -> DataFrame:
    """Persons per cleaned code and name, and whether the matrix has the code.

    A person with two spellings of a code's name counts once, under the least.
    ``matrix_codes`` (feature_id) lists the matrix columns.
    """
    rows = events.filter(is_present_code(F.col("phecode"))).groupBy("person_id", "phecode").agg(F.min("phecode_str").alias("phecode_str"))
    counts = rows.groupBy(canonical_float_code(F.col("phecode")).alias("phecode_key"), "phecode_str").agg(
        F.countDistinct("person_id").alias("patient_count")
    )
    present = matrix_codes.select(F.col("feature_id").alias("phecode_key")).distinct().withColumn("_in", F.lit(True))
    return counts.join(present, "phecode_key", "left").withColumn("in_pivot", F.col("_in").isNotNull()).drop("_in")


def filter_audit(prevalence: DataFrame, low: int = 3) -> DataFrame:
    """Codes that the matrix lacks, split at the prevalence cut."""
    absent, n = ~F.col("in_pivot"), F.col("patient_count")
    return prevalence.agg(
        F.count(F.lit(1)).alias("unique_codes"),
        F.min(F.when(F.col("in_pivot"), n)).alias("present_min_patient_count"),
        F.count_if(absent).alias("missing_feature_count"),
        F.count_if(absent & (n <= low)).alias("missing_at_or_below_cut"),
        F.count_if(absent & (n > low)).alias("missing_above_cut"),
    )


def event_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.countDistinct("person_id").alias("event_patients"),
        F.countDistinct("phecode").alias("event_unique_phecodes"),
        F.countDistinct("phecode_str").alias("event_unique_phecode_str"),
    )
