from datetime import datetime

from pyspark.sql import functions as F

from cohortloom.operators import cohort, features, mapping
from cohortloom.plans.matrix import build_feature_matrix, materialise
from cohortloom.settings import MatrixSettings


def as_set(df):
    return {tuple(r) for r in df.collect()}


def observations(spark):
    rows = [
        (1, 10, datetime(2020, 1, 1), 2), (1, 11, datetime(2021, 1, 1), 3), (1, 12, None, 5),
        (2, 13, datetime(2020, 1, 1), None), (3, 14, datetime(2020, 1, 1), 1), (3, 15, datetime(2020, 1, 1), 4),
    ]
    df = spark.createDataFrame(rows, "person_id long, observation_id long, observation_datetime timestamp, gmfcs_level int")
    return df.withColumn("observation_date", F.to_date("observation_datetime")).withColumn("observation_source_value", F.lit("x"))


def test_latest_level(spark):
    rows = observations(spark)
    assert as_set(cohort.latest_level(rows).select("person_id", "gmfcs_level")) == {(1, 3), (3, 4)}
    other = cohort.latest_level(rows, missing_time_last=False)
    assert as_set(other.select("person_id", "gmfcs_level")) == {(1, 5), (3, 4)}


def test_visit_summary_passes_through(spark):
    done = spark.createDataFrame([(1, 4, 9)], "person_id long, num_visits long, visit_duration_days long")
    done = done.withColumn("first_visit_date", F.lit("2020-01-01").cast("date")).withColumn("last_visit_date", F.lit("2020-01-10").cast("date"))
    assert cohort.summarize_visits(done).count() == 1
    raw = spark.createDataFrame([(1, 7, "2020-01-01"), (1, 7, "2020-01-05"), (1, 8, "2020-01-11")], "person_id long, visit_occurrence_id long, visit_start_date string")
    row = cohort.summarize_visits(raw).first()
    assert (row["num_visits"], row["visit_duration_days"]) == (2, 10)


def test_strip_direct_dates(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1990, "I")], "PERSON_ID long, DEATH_DATE string, year_of_birth int, GMFCS_M string")
    got = cohort.strip_direct_dates(df)
    assert got.columns == ["PERSON_ID", "GMFCS_M", "DEATH"] and got.first()["DEATH"] == 1
    assert cohort.keep_with_level(spark.createDataFrame([(None,)], "GMFCS_M string")).isEmpty()
    assert cohort.keep_with_level(spark.createDataFrame([(None,)], "GMFCS_M string"), require_level=False).count() == 1


MAP = [("G80", "10", "343.0", "palsy"), ("3439", "9", "343.0", "palsy"), ("E11", "10", "250.2", "dm"), ("E11", "10", "250.0", "dm any")]


def code_map(spark):
    return mapping.code_map(spark.createDataFrame(MAP, "icd string, flag string, phecode string, phecode_str string"))


def test_mapping_fans_out_and_audits(spark):
    dx = spark.createDataFrame([(1, "g80"), (1, "343.9"), (2, "E1.1"), (2, "Z99"), (3, "Z99")], "person_id long, source_code string")
    got = mapping.map_events(dx, code_map(spark))
    assert got.events.count() == 4
    audit = {r["vocabulary_id"]: (r["rows"], r["mapped_rows"], r["unique_codes"]) for r in got.audit.collect()}
    assert audit == {"ICD10CM": (5, 3, 3), "ICD9CM": (1, 1, 1)}
    assert as_set(got.unmapped) == {("ICD10CM", "Z99", "Z99", 2, 2)}


def test_definitions_fill_names(spark):
    raw = spark.createDataFrame([("A1", "1.0", None), ("B2", "2", "own")], "code string, phecode string, phenotype string")
    defs = mapping.code_definitions(spark.createDataFrame([("1.0", "one", "g"), ("2", "two", "h")], "phecode string, phenotype string, category string"))
    got = mapping.code_map(raw, defs)
    assert as_set(got.select("phecode", "phecode_str", "phecode_category")) == {("1.0", "one", "g"), ("2", "own", "h")}


def test_matrix_filters_and_keeps_zero_rows(spark):
    dx = spark.createDataFrame(
        [(1, "G80"), (1, "G80"), (2, "343.9"), (3, "E11"), (4, "G80")], "person_id long, source_code string"
    )
    people = spark.createDataFrame([(1, 5, 2), (2, 5, None), (3, 5, 1), (4, 0, 1)], "person_id long, num_visits long, gmfcs_level int")
    build = build_feature_matrix(dx, code_map(spark), MatrixSettings(min_patients=2, min_visits=1), people)
    assert as_set(build.matrix.persons) == {("1",), ("2",), ("3",)}
    assert as_set(build.matrix.cells) == {("1", "phe_343"), ("2", "phe_343")}
    strict = build_feature_matrix(dx, code_map(spark), MatrixSettings(min_patients=1, min_visits=1, require_level=True, exclude_codes=("343",)), people)
    assert as_set(strict.matrix.cells) == {("3", "phe_250_2"), ("3", "phe_250")}
    counts = cohort.eligibility_counts(people, 1, True).first()
    assert tuple(counts) == (4, 2)


def test_premapped_rows_switch_the_map_off(spark):
    dx = spark.createDataFrame(
        [(1, "G80", "401.0", "bp"), (2, "G80", "401", None), (2, "G80", "401", None), (3, "E11", None, None), (4, "E11", " ", None)],
        "person_id long, source_code string, phecode string, phecode_str string",
    )
    build = build_feature_matrix(dx, code_map(spark), MatrixSettings(min_patients=1))
    assert build.mapping_source == "premapped_phecode"
    assert as_set(build.matrix.cells) == {("1", "phe_401"), ("2", "phe_401")}
    audit = build.audit.first()
    assert (audit["diagnosis_rows"], audit["mapped_rows"], audit["unmapped_rows"]) == (5, 3, 2)
    assert build.unmapped.count() == 2


def test_zscore_equals_dense(spark):
    import numpy as np

    dense = np.array([[1, 0, 1], [1, 1, 0], [0, 0, 0], [1, 1, 0]], dtype=float)
    cells = spark.createDataFrame(
        [(str(i), f"f{j}") for i, j in zip(*np.nonzero(dense))], "person_id string, feature_id string"
    )
    persons = spark.createDataFrame([(str(i),) for i in range(4)], "person_id string")
    matrix = features.FeatureMatrix(persons, cells)
    sums = dense.sum(1, keepdims=True)
    log = np.log1p(np.divide(dense, sums, out=np.zeros_like(dense), where=sums > 0) * 1e4)
    z = np.minimum((log - log.mean(0)) / log.std(0), 1.0)
    shifted = {(r["person_id"], r["feature_id"]): r["value"] for r in features.transform(matrix, "scanpy_log1p_scale", max_value=1.0).collect()}
    absent = np.minimum(-log.mean(0) / log.std(0), 1.0)
    for i, j in zip(*np.nonzero(dense)):
        assert abs(shifted[(str(i), f"f{j}")] - (z[i, j] - absent[j])) < 1e-9


def test_audit_of_a_written_matrix_reads_what_was_written(spark):
    dx = spark.createDataFrame([("1", "343.0"), ("1", "250.00"), ("2", "343.0"), ("2", "no code"), (None, "250.00"), ("3", None)], "person_id string, source_code string")
    raw = spark.createDataFrame([("343.0", "9", "343.0"), ("250.00", "9", "250.1")], "ICD string, flag string, phecode string")
    build = build_feature_matrix(dx, mapping.code_map(raw), MatrixSettings(min_patients=1, exclude_codes=("343",)))
    saved = materialise(build)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(saved.audit) == rows(build.audit) and len(rows(saved.audit)) > 1
    assert saved.audit.inputFiles() and set(saved.audit.inputFiles()) == set(saved.events.inputFiles())
    assert rows(saved.events) == rows(build.events.select(saved.events.columns)) and rows(saved.matrix.cells) == rows(build.matrix.cells)
