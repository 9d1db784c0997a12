"""Table readers, schema helpers and source choice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.codes import drop_point_zero, strip_id_suffix
from ..functions.measures import to_number

SNAPSHOT_SCHEMA = "table_name string, column_name string, data_type string, ordinal long"


def read_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a parquet or CSV path by suffix, or a catalog table by name."""
    lowered = source.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        table = spark.read.parquet(source)
    elif lowered.endswith((".csv", ".csv.gz")):
        table = spark.read.csv(source, header=True, inferSchema=False)
    elif "/" in source:
        table = spark.read.load(source)
    else:
        table = spark.table(source)
    return table.select(*columns) if columns else table


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """Relational read split on a numeric key so that every executor takes a range."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    low, high = bounds
    return reader.options(
        partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions
    ).load()


def read_code_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV dimension: all text, Latin-1, trimmed lower-case headers."""
    return normalize_column_names(spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1"))


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().lower() for name in df.columns])


def column_names(df: DataFrame) -> set[str]:
    return {name.lower() for name in df.columns}


def schema_snapshot(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of each named table, each table once."""
    rows = [
        (name, field.name, field.dataType.simpleString(), position)
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, SNAPSHOT_SCHEMA)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the schema; absent columns become typed NULLs."""
    present = {name.lower(): name for name in df.columns}
    return df.select(
        *[
            (F.col(present[f.name]) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def pick_column(columns: Iterable[str], candidates: Iterable[str], ignore_case: bool = False) -> str | None:
    """First candidate that is a column, in candidate order."""
    known = {(name.lower() if ignore_case else name): name for name in columns}
    for candidate in candidates:
        found = known.get(candidate.lower() if ignore_case else candidate)
        if found is not None:
            return found
    return None


def choose_column(df: DataFrame, candidates: Sequence[str], label: str) -> str:
    found = pick_column(df.columns, candidates, ignore_case=True)
    if found is None:
        raise ValueError(f"no {label} column among {list(candidates)}")
    return found


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
    return df


def other_columns(df: DataFrame, known: Iterable[str]) -> list[str]:
    """Columns outside a known set, in table order."""
    skip = set(known)
    return [name for name in df.columns if name not in skip]


def first_readable(spark: SparkSession, sources: Sequence[str], empty: T.StructType) -> tuple[DataFrame, str | None]:
    """First source that exists, with its name; a typed empty table when none does."""
    for source in sources:
        try:
            return read_table(spark, source), source
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
    return spark.createDataFrame([], empty), None


def choose_by_coverage(
    primary: DataFrame, fallback: Callable[[], DataFrame], minimum: int, limit_rows: int | None = None
) -> tuple[DataFrame, bool]:
    """Use the fallback when the primary holds fewer distinct persons than the minimum."""
    if limit_rows or minimum <= 0:
        return primary, False
    persons = primary.agg(F.countDistinct("person_id")).first()[0]
    return (primary, False) if persons >= minimum else (fallback(), True)


def ordered_limit(df: DataFrame, keys: Sequence[str], limit_rows: int | None) -> DataFrame:
    """Rows in key order up to the limit; no sort at all without a limit."""
    return df.orderBy(*keys).limit(int(limit_rows)) if limit_rows else df


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted files that match a glob on any file system Spark can read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(pattern)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    return sorted(status.getPath().toString() for status in found)


def find_code_map_paths(spark: SparkSession, folder: str) -> tuple[str, str | None]:
    """First combined map and first definitions file of a folder."""
    maps = matching_paths(spark, f"{folder}/*icd9*icd10cm*.csv")
    if not maps:
        raise FileNotFoundError(f"no combined code map in {folder}")
    definitions = matching_paths(spark, f"{folder}/*definitions*1.2*.csv")
    return maps[0], definitions[0] if definitions else None


def read_optional(spark: SparkSession, source: str | None, schema: T.StructType) -> DataFrame:
    """Table at the source, or an empty one when no source is given or found."""
    return first_readable(spark, [source] if source else [], schema)[0]


def file_inventory(spark: SparkSession, required: Sequence[str]) -> DataFrame:
    """(path, size_bytes, present) of each required file, folder or glob; file contents are not read.

    A folder has the size of the data files below it. An absent path has no size.
    """
    return reduce(lambda left, right: left.unionByName(right), [_inventory_row(spark, path) for path in required])


def _inventory_row(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        size = reader.load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        size = spark.range(1).select(F.lit(None).cast("long").alias("size_bytes"))
    return size.select(F.lit(path).alias("path"), "size_bytes", F.col("size_bytes").isNotNull().alias("present"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def stack_labelled(tables: dict[str, DataFrame], label: str = "baseline_cluster") -> DataFrame:
    """Stack one table per cluster, labelled by its name without a ``cluster_`` prefix."""
    parts = [
        df.withColumn(label, F.lit(name.removeprefix("cluster_").removeprefix("Cluster_")))
        for name, df in tables.items()
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def cluster_display_names(names: DataFrame, key: str, final: str, allowed: Sequence[str] = tuple("ABCDE")) -> DataFrame:
    """Trimmed (cluster, name) pairs for the listed clusters with a non-null name."""
    pairs = names.select(F.trim(F.col(key)).alias("cluster"), F.trim(F.col(final)).alias("cluster_name"))
    return pairs.filter(F.col("cluster").isin(list(allowed)) & F.col("cluster_name").isNotNull())


def wide_to_cells(wide: DataFrame, id_column: str, strip_suffix: bool = False) -> DataFrame:
    """Wide 0/1 table -> distinct (person_id, feature_id) of positive cells.

    Headers are cleaned; columns that collide afterwards are merged by maximum,
    which for positive cells is a distinct. Text that is no number counts as 0.
    """
    clean = strip_id_suffix if strip_suffix else drop_point_zero
    features = other_columns(wide, [id_column])
    cells = wide.select(
        clean(F.col(f"`{id_column}`")).alias("person_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in features]
    ).unpivot("person_id", [f"`{c}`" for c in features], "feature", "value")
    positive = cells.filter(to_number(F.col("value")) > 0)
    return positive.select("person_id", drop_point_zero(F.col("feature")).alias("feature_id")).distinct()
