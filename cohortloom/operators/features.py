"""Binary person x feature matrix in long form, its filters and transforms.

A matrix is a pair: ``persons`` (one row per person, zero rows included) and
``cells`` (distinct person_id, feature_id of the ones). Zeros are implied, so
every rate divides by person counts and not by cell counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import make_feature_id, matches_code
from ..functions.measures import binarise
from .grid import scalar_array


@dataclass(frozen=True)
class FeatureMatrix:
    persons: DataFrame
    cells: DataFrame


def exclude_codes(events: DataFrame, codes: tuple[str, ...] | list[str], prefix: str = "phe_") -> DataFrame:
    """Drop listed codes in any spelling."""
    if not codes:
        return events
    known = F.col("feature_id") if "feature_id" in events.columns else None
    return events.filter(~matches_code(F.col("phecode"), codes, prefix, known))


def with_feature_ids(rows: DataFrame, prefix: str = "phe_") -> DataFrame:
    return rows.withColumn("feature_id", make_feature_id(F.col("phecode"), prefix))


def feature_events(events: DataFrame, codes: tuple[str, ...] | list[str] = (), prefix: str = "phe_") -> DataFrame:
    """Events with their feature; ids that came along with the code map are not made again."""
    named = events if "feature_id" in events.columns else with_feature_ids(events, prefix)
    return exclude_codes(named, codes, prefix)


def feature_metadata(events: DataFrame) -> DataFrame:
    """One row per feature; among repeats the least code, then least text."""
    texts = [c for c in ("phecode", "phecode_str", "phecode_category") if c in events.columns]
    least = F.min(F.struct(*texts)).alias("m")
    return events.groupBy("feature_id").agg(least).select("feature_id", *[F.col(f"m.{c}").alias(c) for c in texts])


def binary_cells(events: DataFrame) -> DataFrame:
    """Distinct (person, feature); repeats collapse map-side before the shuffle."""
    return events.select(F.col("person_id").cast("string").alias("person_id"), "feature_id").distinct()


def merge_duplicate_features(cells: DataFrame, value: str = "value") -> DataFrame:
    """Maximum over rows that share a person and feature after clean-up."""
    return cells.groupBy("person_id", "feature_id").agg(F.max(value).alias(value))


def binarise_cells(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.withColumn(value, binarise(F.col(value)))


def feature_prevalence(cells: DataFrame) -> DataFrame:
    """Persons per feature; cells are distinct, so a count is enough."""
    return cells.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n_patients"))


def keep_features(cells: DataFrame, features: DataFrame) -> DataFrame:
    return cells.join(features.select("feature_id"), "feature_id", "left_semi").select("person_id", "feature_id")


def min_prevalence(cells: DataFrame, minimum: int) -> DataFrame:
    return keep_features(cells, feature_prevalence(cells).filter(F.col("n_patients") >= int(minimum)))


def prevalence_cut(cells: DataFrame, cutoff: int, strict: bool) -> DataFrame:
    """Features at or above the cutoff, or strictly above it."""
    n = F.col("n_patients")
    return feature_prevalence(cells).filter(n > cutoff if strict else n >= cutoff)


def build_matrix(events: DataFrame, min_patients: int) -> FeatureMatrix:
    """Persons are taken before the prevalence filter, so some may have no cell left."""
    cells = binary_cells(events)
    return FeatureMatrix(cells.select("person_id").distinct(), min_prevalence(cells, min_patients))


def n_persons(persons: DataFrame) -> Column:
    """Person count as a scalar subquery."""
    return persons.agg(F.count(F.lit(1))).scalar()


def drop_constant(matrix: FeatureMatrix) -> DataFrame:
    """Features that are neither absent from nor present in every person."""
    return feature_prevalence(matrix.cells).filter(F.col("n_patients") < n_persons(matrix.persons))


def without_constant(matrix: FeatureMatrix) -> FeatureMatrix:
    return FeatureMatrix(matrix.persons, keep_features(matrix.cells, drop_constant(matrix)))


def binary_values(cells: DataFrame) -> DataFrame:
    return cells.select("person_id", "feature_id", F.lit(1.0).alias("value"))


def normalize_log1p(cells: DataFrame, target: float = 10000.0) -> DataFrame:
    """ln(1 + target / row sum) on the ones; zero rows stay zero."""
    sums = cells.groupBy("person_id").agg(F.count(F.lit(1)).alias("row_sum"))
    return cells.join(sums, "person_id").select(
        "person_id", "feature_id", F.log1p(F.lit(float(target)) / F.col("row_sum")).alias("value")
    )


def column_moments(values: DataFrame, persons: DataFrame) -> DataFrame:
    """Mean and population deviation per feature over all persons, zeros included."""
    n = n_persons(persons)
    sums = values.groupBy("feature_id").agg(
        F.sum("value").alias("s"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("c")
    )
    share = F.col("c") / n
    # Law of total variance over the present and the absent cells.
    variance = share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m")
    return sums.select("feature_id", (F.col("s") / n).alias("mean"), F.sqrt(variance).alias("std"))


def zscore(values: DataFrame, persons: DataFrame, max_value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """z-scores without densifying: (scores of present cells, score of the absent cells per feature).

    A constant feature keeps a deviation of 1. Only the upper side is clipped.
    """
    moments = column_moments(values, persons).withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))

    def clip(z: Column) -> Column:
        return z if max_value is None else F.least(z, F.lit(float(max_value)))

    present = values.join(moments, "feature_id").select(
        "person_id", "feature_id", clip((F.col("value") - F.col("mean")) / F.col("std")).alias("value")
    )
    absent = moments.select("feature_id", clip(-F.col("mean") / F.col("std")).alias("absent_value"))
    return present, absent


def transform(matrix: FeatureMatrix, method: str, target: float = 10000.0, max_value: float | None = None) -> DataFrame:
    """Present cells of the transformed matrix, shifted so that absent cells are 0.

    The shift is constant per feature, so components of the centred matrix are unchanged.
    """
    if method in ("raw", "raw_binary"):
        return binary_values(matrix.cells)
    if method in ("scanpy_log1p", "lognorm"):
        return normalize_log1p(matrix.cells, target)
    if method == "scanpy_log1p_scale":
        values = normalize_log1p(matrix.cells, target)
    elif method in ("zscore", "zscore_binary"):
        values = binary_values(matrix.cells)
    else:
        raise ValueError(f"unsupported transform {method!r}")
    present, absent = zscore(values, matrix.persons, max_value)
    return present.join(absent, "feature_id").select(
        "person_id", "feature_id", (F.col("value") - F.col("absent_value")).alias("value")
    )


def cluster_counts(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Ones per (feature, cluster)."""
    return (
        cells.join(labels.select("person_id", "cluster"), "person_id")
        .groupBy("feature_id", "cluster")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cluster"))


def prevalence_range(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Largest minus least cluster prevalence per feature; a cluster without the feature counts as 0."""
    rates = cluster_counts(cells, labels).join(cluster_sizes(labels), "cluster").withColumn(
        "rate", F.col("n") / F.col("n_cluster")
    )
    k = labels.agg(F.countDistinct("cluster")).scalar()
    low = F.when(F.count(F.lit(1)) < k, F.lit(0.0)).otherwise(F.min("rate"))
    return rates.groupBy("feature_id").agg((F.max("rate") - low).alias("prevalence_range"))


def top_features(ranked: DataFrame, by: str, n: int) -> DataFrame:
    return ranked.orderBy(F.desc(by), "feature_id").limit(int(n))


def feature_sets(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(set_name, feature_id, label_informed) of the sensitivity grid's feature sets."""
    # Fixed values of the grid.
    cutoffs, overall, informed, least = [3, 50, 100, 150, 300, 500], [100, 300, 600], [25, 100, 300], 5
    prevalence = feature_prevalence(cells)
    spread = prevalence_range(cells, labels)
    above = prevalence.select(
        "feature_id",
        F.explode(F.array_compact(F.array(*[F.when(F.col("n_patients") > c, F.lit(c)) for c in cutoffs]))).alias("cutoff"),
    )
    big = above.groupBy("cutoff").count().filter(F.col("count") >= least)
    parts = [
        above.join(big, "cutoff", "left_semi").select(
            F.concat(F.lit("prevalence_gt_"), "cutoff").alias("set_name"), "feature_id", F.lit(False).alias("label_informed")
        )
    ]
    for names, ranked, by, flag in (
        ([(n, f"top_{n}_overall_prevalence") for n in overall], prevalence, "n_patients", False),
        ([(n, f"top_{n}_AE_prevalence_range") for n in informed], spread, "prevalence_range", True),
    ):
        for n, name in names:
            parts.append(
                top_features(ranked, by, n).select(
                    F.lit(name).alias("set_name"), "feature_id", F.lit(flag).alias("label_informed")
                )
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def subgroup_frequent_features(
    cells: DataFrame, groups: DataFrame, keys: list[str], threshold: float = 0.05
) -> DataFrame:
    """Highest prevalence of each feature in any subgroup, and whether it reaches the threshold."""
    sizes = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    rates = (
        cells.join(groups.select("person_id", *keys), "person_id")
        .groupBy("feature_id", *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sizes, keys)
        .withColumn("rate", F.col("n") / F.col("size"))
    )
    return rates.groupBy("feature_id").agg(F.max("rate").alias("max_rate")).withColumn(
        "frequent", F.col("max_rate") >= threshold
    )


def cluster_feature_grid(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """2x2 cell counts of every (cluster, feature), absent pairs as 0.

    Counts of a feature are gathered into one map of at most k entries, and the
    cluster list is a scalar; the grid needs no join of clusters with features.
    """
    sizes = cluster_sizes(labels)
    clusters = scalar_array(sizes, "cluster", "n_cluster")
    total = n_persons(labels)
    per_feature = (
        cluster_counts(cells, labels)
        .groupBy("feature_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("cluster", "n"))).alias("by_cluster"), F.sum("n").alias("n_all"))
    )
    grid = per_feature.select("feature_id", "by_cluster", "n_all", F.explode(clusters).alias("c"))
    n = F.coalesce(F.try_element_at("by_cluster", F.col("c.cluster")), F.lit(0)).cast("long")
    return grid.select(
        F.col("c.cluster").alias("cluster"),
        "feature_id",
        F.col("c.n_cluster").alias("cluster_patients"),
        n.alias("num_patients"),
        (total - F.col("c.n_cluster")).alias("rest_patients"),
        (F.col("n_all") - n).alias("rest_num_patients"),
    )
