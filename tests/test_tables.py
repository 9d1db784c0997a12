import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.sources import sinks, tables


def test_csv_dimension_headers_and_encoding(spark, tmp_path):
    (tmp_path / "map.csv").write_bytes(" ICD ,Phecode\nG80,343.0\nJ\xe9,1\n".encode("latin1"))
    df = tables.read_code_csv(spark, str(tmp_path / "map.csv"))
    assert df.columns == ["icd", "phecode"]
    assert {r["icd"] for r in df.collect()} == {"G80", "Jé"}


def test_reader_by_suffix_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.write_parquet(df, str(tmp_path / "t.parquet"))
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    sinks.write_json(df.select(F.struct("n", "s").alias("m")), str(tmp_path / "t.json"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).first()["n"] == 1
    assert tables.read_table(spark, str(tmp_path / "t.csv")).first()["n"] == "1"
    assert sinks.read_json(spark, str(tmp_path / "t.json")).first()["m"]["s"] == "a"


def test_conform_pads_and_casts(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    got = tables.conform(spark.createDataFrame([("7", 1)], "A string, c int"), schema)
    assert got.schema.simpleString() == "struct<a:bigint,b:string>"
    assert tuple(got.first()) == (7, None)


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2)], "GMFCS_M int, person_id int")
    assert tables.choose_column(df, ["gmfcs", "gmfcs_m"], "level") == "GMFCS_M"
    assert tables.pick_column(df.columns, ["gmfcs_m"]) is None
    with pytest.raises(ValueError):
        tables.choose_column(df, ["x"], "x")
    with pytest.raises(ValueError):
        tables.require_columns(df, ["x"], "df")
    assert tables.other_columns(df, ["person_id"]) == ["GMFCS_M"]


def test_first_readable_falls_back_only_when_missing(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    path = str(tmp_path / "b.parquet")
    spark.range(3).write.parquet(path)
    found, name = tables.first_readable(spark, [str(tmp_path / "a.parquet"), path], schema)
    assert (found.count(), name) == (3, path)
    empty, name = tables.first_readable(spark, [str(tmp_path / "a.parquet")], schema)
    assert (empty.count(), name) == (0, None)
    assert tables.read_optional(spark, None, schema).isEmpty()


def test_coverage_choice(spark):
    few = spark.createDataFrame([(1,), (1,)], "person_id int")
    many = spark.range(5).withColumnRenamed("id", "person_id")
    assert tables.choose_by_coverage(few, lambda: many, 2)[1] is True
    assert tables.choose_by_coverage(few, lambda: many, 1)[1] is False
    assert tables.choose_by_coverage(few, lambda: many, 2, limit_rows=10)[1] is False


def test_resource_paths_snapshot_inventory(spark, tmp_path):
    for name in ("b_icd9_icd10cm.csv", "a_icd9_icd10cm.csv", "definitions_1.2.csv"):
        (tmp_path / name).write_text("x\n")
    first, definitions = tables.find_code_map_paths(spark, str(tmp_path))
    assert first.endswith("a_icd9_icd10cm.csv") and definitions.endswith("definitions_1.2.csv")
    got = tables.file_inventory(spark, [str(tmp_path / "a_icd9_icd10cm.csv"), str(tmp_path / "none.csv")]).collect()
    assert {(r["path"].split("/")[-1], r["size_bytes"], r["present"]) for r in got} == {
        ("a_icd9_icd10cm.csv", 2, True), ("none.csv", None, False),
    }
    snapshot = tables.schema_snapshot(spark, {"t": spark.range(1)}).collect()
    assert [tuple(r) for r in snapshot] == [("t", "id", "bigint", 1)]


def test_wide_cells_merge_colliding_headers(spark):
    wide = spark.createDataFrame([("1.0", 1, "0", "x"), ("2", 0, "1", "3")], "`PERSON_ID` string, `100.0` int, `100` string, `200` string")
    got = {tuple(r) for r in tables.wide_to_cells(wide, "PERSON_ID").collect()}
    assert got == {("1", "100"), ("2", "100"), ("2", "200")}


def test_wide_matrix_keeps_zero_rows(spark):
    cells = spark.createDataFrame([("1", "a")], "person_id string, feature_id string")
    persons = spark.createDataFrame([("1",), ("2",)], "person_id string")
    got = {tuple(r) for r in sinks.wide_matrix(cells, persons, ["a", "b"]).collect()}
    assert got == {("1", 1, 0), ("2", 0, 0)}


def test_stack_and_names(spark):
    one = spark.createDataFrame([("250",)], "phecode string")
    got = {tuple(r) for r in tables.stack_labelled({"cluster_A": one, "B": one}).collect()}
    assert got == {("250", "A"), ("250", "B")}
    names = spark.createDataFrame([(" A ", " mild "), ("F", "x"), ("B", None)], "k string, final string")
    assert [tuple(r) for r in tables.cluster_display_names(names, "k", "final").collect()] == [("A", "mild")]


def test_inventory_of_folders_globs_and_empty_files(spark, tmp_path):
    (tmp_path / "deep" / "inner").mkdir(parents=True)
    (tmp_path / "deep" / "one.txt").write_text("abc")
    (tmp_path / "deep" / "inner" / "two.txt").write_text("de")
    (tmp_path / "empty.txt").write_text("")
    wanted = [f"{tmp_path}/{name}" for name in ("deep", "deep/*.txt", "empty.txt", "deep/none*.txt")]
    got = [(r["path"], r["size_bytes"], r["present"]) for r in tables.file_inventory(spark, wanted).collect()]
    assert got == list(zip(wanted, (5, 3, 0, None), (True, True, True, False), strict=True))


def test_csv_in_another_encoding_and_unreadable_source(spark, tmp_path):
    df = spark.createDataFrame([("é", 1)], "ICD string, Phecode int")
    sinks.write_csv(df, str(tmp_path / "map.csv"), encoding="ISO-8859-1")
    assert [tuple(r) for r in tables.read_code_csv(spark, str(tmp_path / "map.csv")).collect()] == [("é", "1")]
    (tmp_path / "broken.parquet").write_text("no table")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        tables.first_readable(spark, [str(tmp_path / "broken.parquet")], T.StructType())[0].collect()
