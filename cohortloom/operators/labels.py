"""Comparing labellings: contingency, agreement, adjusted Rand index, picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(pairs: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*keys, left, right).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL included, in value order."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last(column))


def agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("rows_compared"), F.count_if(F.col(left) == F.col(right)).alias("matches")
    )


def adjusted_rand(pairs: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index (Hubert & Arabie 1985) per key, 1 when both labellings are trivial."""

    def choose_two(n):
        n = n.cast("double")
        return n * (n - 1) / 2

    keys = list(keys)
    cells = contingency(pairs, left, right, keys)
    cell_sum = cells.groupBy(*keys).agg(F.sum(choose_two(F.col("n"))).alias("cell"), F.sum("n").alias("n_all"))
    joined = cell_sum
    for column, name in ((left, "row"), (right, "column")):
        margin = cells.groupBy(*keys, column).agg(F.sum("n").alias("n"))
        side = margin.groupBy(*keys).agg(F.sum(choose_two(F.col("n"))).alias(name))
        joined = joined.join(side, keys) if keys else joined.withColumn(name, side.scalar())
    expected = F.try_divide(F.col("row") * F.col("column"), choose_two(F.col("n_all")))
    widest = (F.col("row") + F.col("column")) / 2
    score = F.try_divide(F.col("cell") - expected, widest - expected)
    return joined.select(*keys, F.coalesce(score, F.lit(1.0)).alias("ari"))


def select_target(scores: DataFrame, target: int) -> DataFrame:
    """Nearest cluster count to the target, then best silhouette, then lowest resolution."""
    return scores.orderBy(
        F.abs(F.col("n_clusters") - target), F.desc_nulls_last("silhouette"), "resolution"
    ).limit(1)


def select_discovery(scores: DataFrame, least: int, most: int) -> DataFrame:
    """Best silhouette among counts in range; among all when none is in range."""
    outside = ~F.col("n_clusters").between(least, most)
    return scores.orderBy(outside, F.desc_nulls_last("silhouette"), "resolution").limit(1)


def distinct_in_order(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once with its first position."""
    return df.groupBy(key).agg(F.min(position).alias("first_position"))


def sizes_json(labels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """JSON object of cluster sizes per key."""
    counts = labels.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "n")))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("cluster_sizes"))


def top_rows(df: DataFrame, group: str, order: Sequence, n: int) -> DataFrame:
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= int(n))
