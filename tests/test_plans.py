from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.features import FeatureMatrix
from cohortloom.plans import experiments
from cohortloom.plans.clustering import run_clustering
from cohortloom.plans.full_run import run_all
from cohortloom.plans.matrix import build_feature_matrix, read_matrix, write_matrix
from cohortloom.plans.reference import read_stored_object, replay_report, reproduce
from cohortloom.operators import fuzzy
from cohortloom.session import cut_lineage
from cohortloom.settings import ClusterSettings, MatrixSettings, ReplaySettings
from cohortloom.workload import QUERIES, Roles

import __spark_entry__ as entry_module


def planted_matrix(spark, people=60, features=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(people):
        for j in range(features):
            if rng.random() < (0.7 if (i % 3) == (j % 3) else 0.05):
                rows.append((str(i), f"phe_{j}"))
    persons = spark.createDataFrame([(str(i),) for i in range(people)], "person_id string")
    return FeatureMatrix(persons, spark.createDataFrame(rows, "person_id string, feature_id string"))


def test_clustering_recovers_planted_groups(spark):
    settings = replace(
        ClusterSettings(), pca_n_components=4, n_neighbors=8, target_clusters=3, discovery_min_clusters=2,
        discovery_max_clusters=6, resolution_grid=(0.5, 1.0), preprocess_method="scanpy_log1p",
    )
    found = run_clustering(planted_matrix(spark), settings)
    rows = found.assignments.filter("mode = 'target5'").collect()
    assert len(rows) == 60 and len({r["cluster"] for r in rows}) == 3
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], []).append(int(r["person_id"]) % 3)
    assert sum(max(g.count(v) for v in range(3)) for g in groups.values()) >= 57
    assert {r["mode"] for r in found.manifest.collect()} == {"target5", "discovery"}
    assert found.scores.count() == 2


def test_reduced_feature_validation_runs_all_its_configurations(spark, monkeypatch):
    """Both cutoffs and all resolutions, in one call of community detection."""
    asked = []

    def detect(edges, nodes, resolutions):
        asked.append(({r.graph for r in edges.select("graph").distinct().collect()}, tuple(resolutions)))
        found = nodes.select("graph", F.explode(F.array(*map(F.lit, resolutions))).alias("resolution"), "id")
        return found.select("*", (F.xxhash64("id") % 5).alias("label"))

    near = spark.createDataFrame([("0", "1", 0.5, 1)], "src string, dst string, distance double, rank int")
    monkeypatch.setattr(experiments, "nearest_neighbors", lambda points, k: near)
    monkeypatch.setattr(experiments, "detect_communities", detect)
    matrix = planted_matrix(spark, people=1500, features=6)
    truth = matrix.persons.withColumn("cluster", (F.col("person_id").cast("int") % 3).cast("string"))
    roles = SimpleNamespace(saved=SimpleNamespace(matrix=matrix), assignments=truth)
    rows = QUERIES["reduced_feature_validation"].build(roles).collect()
    graphs = {f"prev{cutoff}_pc{pcs}" for cutoff in (200, 300) for pcs in (15, 50)}
    assert asked == [(graphs, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0))]
    assert {r.graph for r in rows} <= graphs


def test_replay_of_a_stored_graph(spark):
    matrix = planted_matrix(spark, seed=1)
    from cohortloom.operators.embedding import first_components, person_vectors, principal_components
    from cohortloom.operators.features import normalize_log1p

    vectors, _ = person_vectors(matrix.persons, normalize_log1p(matrix.cells))
    scores = cut_lineage(principal_components(vectors, 4).scores)
    stored = fuzzy.build_graph(first_components(scores, 3), 8, "fuzzy")
    truth = matrix.persons.withColumn("cluster", (F.col("person_id").cast("int") % 3).cast("string"))
    settings = replace(ReplaySettings(), pca_n_components=4, neighbors_n_pcs=3, n_neighbors=8)
    replay = reproduce(matrix, stored, truth, settings, scores)
    ari = {r["graph"]: r["ari"] for r in replay.summary.collect()}
    assert set(ari) == {"stored", "fuzzy", "exact"} and min(ari.values()) > 0.7
    assert ari["stored"] == pytest.approx(ari["fuzzy"])
    assert replay.assignments.count() == 60
    assert replay.pca_check.agg(F.max("max_abs_diff")).first()[0] < 1e-8
    assert replay_report(replay).count() == 12


def test_full_run_and_written_matrix(spark, folder, tmp_path):
    roles = Roles(spark, folder)
    settings = replace(ClusterSettings(), pca_n_components=5, n_neighbors=6, resolution_grid=(1.0,))
    run = run_all(roles.sources, roles.code_map, MatrixSettings(min_patients=2), settings, roles.baseline, trees=5)
    assert run.interpretation["target5"].enrichment.count() > 0
    assert run.interpretation["target5"].importance.count() > 0
    assert run.comparison.report.filter("section = 'top_features'").count() > 0
    build = build_feature_matrix(roles.diagnoses, roles.code_map, MatrixSettings(min_patients=2), premapped=False)
    write_matrix(build, str(tmp_path))
    back = read_matrix(spark, str(tmp_path))
    assert back.cells.count() == build.matrix.cells.count()


def test_stored_object(spark, tmp_path):
    values = spark.createDataFrame([("1-ALL", "250.0", 8.1), ("1-ALL", "250", 1.0), ("2-ALL", "7", 0.0)], "person_id string, feature_id string, value double")
    for name in ("values", "persons", "features", "embedding", "edges"):
        values.write.parquet(f"{tmp_path}/{name}.parquet")
    stored = read_stored_object(spark, str(tmp_path))
    assert [tuple(r) for r in stored.cells.collect()] == [("1", "250")]


def test_hot_person_and_hot_feature_stay_whole(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("person_id"),
        F.when(F.col("id") % 3 == 1, F.lit("G80")).otherwise(F.concat(F.lit("G"), (F.col("id") % 50).cast("string"))).alias("source_code"),
    )
    from cohortloom.operators.mapping import code_map

    raw = spark.createDataFrame([("G80", "10", "1.0")] + [(f"G{i}", "10", f"{2 + i}") for i in range(50)], "icd string, flag string, phecode string")
    build = build_feature_matrix(rows, code_map(raw), MatrixSettings(min_patients=1), premapped=False)
    assert build.events.count() == 3000
    assert build.matrix.cells.filter("feature_id = 'phe_1'").count() == 1000
    assert build.matrix.cells.filter("person_id = '0'").count() == 50


def test_entry_and_registry(spark, folder):
    assert entry_module.entry(spark).count() > 0
    registered = set(entry_module.queries())
    rest = set(entry_module.llm.QUERIES) if entry_module.llm else set()
    rest |= {"pipeline"} if entry_module.corpus_pipeline else set()
    assert registered == set(QUERIES) | rest and not set(QUERIES) & rest
    assert set(entry_module.oracle_sql()) <= registered
    plans = {n: QUERIES[n].build(Roles(spark, folder))._jdf.queryExecution().executedPlan().toString() for n in (
        "diagnoses_occurrence_events", "join_code_map", "contingency_grid", "label_audit", "adjusted_rand_index", "subgroup_sizes")}
    for plan in plans.values():
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in QUERIES["nearest_neighbors"].build(Roles(spark, folder))._jdf.queryExecution().executedPlan().toString()
