"""Two-group feature comparison with descriptions and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import canonical_float_code
from ..functions.fisher import fisher_two_sided
from ..functions.measures import capped_ratio, keyword_tags
from .features import cluster_sizes

_NO_DESCRIPTION = "—"


def describe_codes(rows: DataFrame, definitions: DataFrame, code: str = "phecode") -> DataFrame:
    """Description by the code as written, else by its float text, else a dash."""
    exact = definitions.select(F.col("phecode").alias("_a"), F.col("phenotype").alias("_x")).distinct()
    loose = definitions.select(F.col("phecode").alias("_b"), F.col("phenotype").alias("_y")).distinct()
    joined = rows.join(exact, F.col(code) == F.col("_a"), "left").join(
        loose, canonical_float_code(F.col(code)) == F.col("_b"), "left"
    )
    text = F.coalesce(F.nullif("_x", F.lit("")), F.nullif("_y", F.lit("")), F.lit(_NO_DESCRIPTION))
    return joined.withColumn("description", text).drop("_a", "_b", "_x", "_y")


def compare_groups(cells: DataFrame, labels: DataFrame, first: str, second: str, definitions: DataFrame) -> DataFrame:
    """Prevalence of every feature in two clusters, with difference, ratio, Fisher p and tags.

    Both group sizes come from one scalar; counts of both groups from one pass over the cells.
    """
    pair = labels.filter(F.col("cluster").isin(first, second))
    sizes = cluster_sizes(pair)
    n_first = sizes.filter(F.col("cluster") == first).agg(F.coalesce(F.max("n_cluster"), F.lit(0))).scalar()
    n_second = sizes.filter(F.col("cluster") == second).agg(F.coalesce(F.max("n_cluster"), F.lit(0))).scalar()
    # One pass over the cells: those of other persons count as 0, so that every feature stays.
    mine = cells.join(pair.select("person_id", "cluster"), "person_id", "left")
    in_group = lambda group: F.count_if((F.col("cluster") == group) & F.col("feature_id").isNotNull())
    counts = mine.groupBy("feature_id").agg(in_group(first).alias("count_first"), in_group(second).alias("count_second"))
    rated = counts.withColumn("prev_first", F.col("count_first") / n_first).withColumn(
        "prev_second", F.col("count_second") / n_second
    )
    tested = rated.withColumn(
        "p_value",
        fisher_two_sided("count_first", n_first, F.col("count_first") + F.col("count_second"), n_first + n_second),
    )
    named = describe_codes(tested.withColumnRenamed("feature_id", "phecode"), definitions)
    return named.select(
        "phecode", "description", "count_first", "count_second",
        F.round("prev_first", 4).alias("prev_first"),
        F.round("prev_second", 4).alias("prev_second"),
        F.round(F.col("prev_second") - F.col("prev_first"), 4).alias("diff"),
        capped_ratio(F.col("prev_first"), F.col("prev_second")).alias("ratio"),
        "p_value",
        keyword_tags(F.col("description"), F.col("phecode")).alias("keywords"),
    )


def by_absolute(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(column)).desc(), key)


def highlights(compared: DataFrame, top: int = 40, tagged: int = 30) -> DataFrame:
    """Largest differences and the largest tagged ones, each code once."""
    first = by_absolute(compared, "diff", "phecode").limit(top)
    second = by_absolute(compared.filter(F.col("keywords") != ""), "diff", "phecode").limit(tagged)
    return by_absolute(union_distinct(first, second, "phecode"), "diff", "phecode")


def union_distinct(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, one per key."""
    return left.unionByName(right).dropDuplicates([key])
