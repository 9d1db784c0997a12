"""Readers, writers and file checks over files that the query itself writes to the shared folder from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import sinks, tables
from .registry import query
from .roles import Roles


@query("S14 K1", "SELECT c_custkey AS person_id, c_mktsegment AS segment, 'second' AS source FROM customer WHERE c_mktsegment IS NOT NULL")
def first_source_that_exists(t: Roles) -> DataFrame:
    """The first of two sources was never written, so the rows come from the second."""
    folder = scratch_path(t.spark)
    rows = t.table("customer", "c_custkey", "c_mktsegment").where("c_mktsegment is not null")
    sinks.write_parquet(rows.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("segment")), f"{folder}/second.parquet")
    empty = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("segment", T.StringType())])
    found, source = tables.first_readable(t.spark, [f"{folder}/{name}.parquet" for name in ("first", "second")], empty)
    return found.select("person_id", "segment", F.lit(source.rsplit("/", 1)[1].removesuffix(".parquet")).alias("source"))


@query("S5 S11 K2", """
    SELECT CAST(p_partkey AS VARCHAR) AS icd, p_type || 'é' AS phecode, n AS definition_rows
    FROM part JOIN (SELECT p_type, CAST(count(*) AS VARCHAR) AS n FROM part GROUP BY 1) USING (p_type) WHERE p_partkey % 2 = 0""")
def code_map_from_folder(t: Roles) -> DataFrame:
    """Two maps and one file of definitions lie in the folder; the map that sorts first has the even keys."""
    folder = scratch_path(t.spark)
    part = t.table("part", "p_partkey", "p_type").withColumn("p_type", F.concat("p_type", F.lit("é")))
    for name, rest in (("b_icd9_icd10cm", 1), ("a_icd9_icd10cm", 0)):
        rows = part.where(F.col("p_partkey") % 2 == rest).select(F.col("p_partkey").alias("ICD"), F.col("p_type").alias("Phecode"))
        sinks.write_csv(rows, f"{folder}/{name}.csv", encoding="ISO-8859-1")
    counted = part.groupBy(F.col("p_type").alias("PheCode")).agg(F.count(F.lit(1)).alias("Definition_Rows"))
    sinks.write_csv(counted, f"{folder}/phecode_definitions1.2.csv", encoding="ISO-8859-1")
    codes, definitions = (tables.read_code_csv(t.spark, path) for path in tables.find_code_map_paths(t.spark, folder))
    return codes.join(definitions, "phecode").select("icd", "phecode", "definition_rows")


@query("K3", """
    SELECT count(*) AS orders, count(DISTINCT o_custkey) AS persons, round(sum(o_totalprice), 2) AS total,
      count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders""")
def summary_written_as_json(t: Roles) -> DataFrame:
    path = f"{scratch_path(t.spark)}/summary.json"
    summary = t.table("orders", "o_custkey", "o_orderstatus", "o_totalprice").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("persons"),
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    sinks.write_json(summary, path)
    return sinks.read_json(t.spark, path)


@query("S3", """
    SELECT DISTINCT table_name, column_name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS data_type,
      CAST(ordinal_position AS BIGINT) AS ordinal
    FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part')""")
def schema_snapshot_of_tables(t: Roles) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part")
    return tables.schema_snapshot(t.spark, {name: t.table(name) for name in names})


@query("S2 S12 P8 P10", """
    SELECT event_type AS feature, count(*) AS total, min(user_id) AS first_person, CAST(NULL AS VARCHAR) AS note FROM events GROUP BY 1""")
def feature_columns_with_metadata(t: Roles) -> DataFrame:
    """Totals of all columns but the id, with one metadata table that exists and one that does not."""
    folder = scratch_path(t.spark)
    events = t.table("events", "user_id", "event_type")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    sinks.write_parquet(events.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))), f"{folder}/wide.parquet")
    sinks.write_parquet(events.groupBy(F.col("event_type").alias("feature")).agg(F.min("user_id").alias("first_person")), f"{folder}/metadata.parquet")
    wide = tables.read_table(t.spark, f"{folder}/wide.parquet")
    key = tables.choose_column(wide, ["person_id", "USER_ID"], "id")
    features = tables.other_columns(tables.require_columns(wide, [key, *kinds], "the wide table"), [key])
    totals = wide.select([F.sum(f"`{name}`").alias(name) for name in features]).unpivot([], [f"`{name}`" for name in features], "feature", "total")
    known = tables.read_optional(t.spark, f"{folder}/metadata.parquet", T.StructType())
    notes = tables.read_optional(
        t.spark, f"{folder}/notes.parquet", T.StructType([T.StructField("feature", T.StringType()), T.StructField("note", T.StringType())])
    )
    return totals.join(known, "feature", "left").join(notes, "feature", "left").select("feature", "total", "first_person", "note")


@query("S16", """
    SELECT 'parts' AS file, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS size_bytes, true AS present FROM part
    UNION ALL SELECT 'customers', CAST(sum(strlen(c_name) + 1) AS BIGINT), true FROM customer
    UNION ALL SELECT 'orders', NULL, false""")
def inventory_of_written_files(t: Roles) -> DataFrame:
    """Sizes of text files with one name a line; the third file is not there."""
    folder = scratch_path(t.spark)
    t.table("part", "p_name").write.text(f"{folder}/parts")
    t.table("customer", "c_name").write.text(f"{folder}/customers")
    found = tables.file_inventory(t.spark, [f"{folder}/{name}" for name in ("parts", "customers", "orders")])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "present")
