from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import audit, contrast, disclosure, enrichment, features
from cohortloom.operators.grid import adjust_fdr
from cohortloom.operators.labels import adjusted_rand, select_discovery, select_target
from cohortloom.operators.matching import best_assignment, score_matches
from cohortloom.plans.disclosure import run_privacy_check
from cohortloom.plans.reference import build_reference_matrix


def test_fdr_equals_step_up(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.random(400) ** 3, np.full(300, 1.0), [1e-9, 1e-9, 0.03, 0.03]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p_value double")
    got = np.array([r["p_value_fdr"] for r in adjust_fdr(df).orderBy("i").collect()])
    order = np.argsort(p)
    steps = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(steps[::-1])[::-1])
    assert got == pytest.approx(want)


def test_enrichment_of_one_hot_feature(spark):
    cells = spark.createDataFrame([(str(i), "f") for i in range(8)] + [("9", "g")], "person_id string, feature_id string")
    labels = spark.createDataFrame([(str(i), "x" if i < 8 else "y") for i in range(12)], "person_id string, cluster string")
    got = {(r["cluster"], r["feature_id"]): r for r in enrichment.feature_enrichment(cells, labels).collect()}
    assert len(got) == 4
    row = got[("x", "f")]
    assert (row["num_patients"], row["rest_num_patients"], row["direction"]) == (8, 0, "enriched")
    assert row["prevalence_ratio"] == float("inf") and row["p_value"] == pytest.approx(2 / 990)
    with pytest.raises(ValueError):
        enrichment.require_labels(labels.select("person_id"), labels.filter("cluster = 'x'"))


def test_single_cluster_is_depleted(spark):
    cells = spark.createDataFrame([("1", "f")], "person_id string, feature_id string")
    labels = spark.createDataFrame([("1", "x"), ("2", "x")], "person_id string, cluster string")
    row = enrichment.feature_enrichment(cells, labels).first()
    assert row["direction"] == "depleted" and row["rest_prevalence"] is None


def test_adjusted_rand(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert adjusted_rand(rows, "a", "b").first()["ari"] == pytest.approx(0.5714285714)
    same = spark.createDataFrame([(0, 5), (0, 5)], "a int, b int")
    assert adjusted_rand(same, "a", "b").first()["ari"] == 1.0


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_assignment_equals_brute_force(spark, k, b, rng):
    table = [[rng.randint(0, 9) for _ in range(b)] for _ in range(k)]
    rows = [(f"c{i}", f"b{j}", table[i][j]) for i in range(k) for j in range(b)]
    got = best_assignment(spark.createDataFrame(rows, "cluster string, baseline_cluster string, score long")).collect()
    if k <= b:
        best = max(sum(table[i][p[i]] for i in range(k)) for p in permutations(range(b), k))
    else:
        best = max(sum(table[p[j]][j] for j in range(b)) for p in permutations(range(k), b))
    assert sum(r["score"] for r in got) == best and len(got) == min(k, b)
    assert len({r["baseline_cluster"] for r in got}) == len(got)


def test_match_scores(spark):
    found = spark.createDataFrame(
        [("0", "f1", "250", "endo", "enriched", 0.01, 3.0), ("0", "f2", "401", "circ", "depleted", 0.01, 0.2),
         ("1", "f3", "401", "circ", "enriched", 0.02, 2.0)],
        "cluster string, feature_id string, phecode string, com_category string, direction string, p_value_fdr double, prevalence_ratio double",
    )
    base = spark.createDataFrame([("A", "250", "endo"), ("B", "999", "circ")], "baseline_cluster string, phecode string, com_category string")
    got = {(r["cluster"], r["baseline_cluster"]): r["score"] for r in score_matches(found, base).collect()}
    assert got == {("0", "A"): 3, ("0", "B"): 0, ("1", "A"): 0, ("1", "B"): 1}


def test_disclosure(spark):
    people = spark.createDataFrame([("1", "a"), ("2", "A"), ("3", "B"), ("4", None), ("5", "B")], "h5ad_id string, cluster string")
    levels = spark.createDataFrame([("1", "Level II"), ("2", "2"), ("3", "2.0"), ("4", "I"), ("5", "V")], "PERSON_ID string, GMFCS_M string")
    check = run_privacy_check(people, levels, threshold=2)
    assert {tuple(r)[:3] for r in check.counts.collect()} == {("A", "II", 2), ("B", "V", 1)}
    row = check.summary.first()
    assert (row["n_below_threshold"], row["minimum_subgroup_size"], row["n_without_cluster"], row["n_without_level"]) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        run_privacy_check(people, levels.withColumn("GMFCS_M", F.lit("?")))
    assert disclosure.subgroup_sizes(spark.createDataFrame([("1", "A", "I"), ("1", "A", "1")], "person_id string, cluster string, gmfcs string")).first()["n_patients"] == 1


def test_resolution_picks(spark):
    rows = spark.createDataFrame([(0.1, 2, 0.9), (0.5, 4, 0.2), (0.7, 4, 0.2), (1.0, 6, None)], "resolution double, n_clusters long, silhouette double")
    assert select_target(rows, 4).first()["resolution"] == 0.5
    assert select_target(rows, 5).first()["resolution"] == 0.5
    assert select_discovery(rows, 3, 10).first()["resolution"] == 0.5
    assert select_discovery(rows, 20, 30).first()["resolution"] == 0.1


def test_matrix_difference_counts_implicit_zeros(spark):
    a = spark.createDataFrame([("1", "f", 1.0), ("2", "g", 1.0)], "person_id string, feature_id string, value double")
    b = spark.createDataFrame([("1", "f", 1.0), ("2", "f", 3.0), ("2", "g", 1.0), ("3", "h", 1.0)], "person_id string, feature_id string, value double")
    row = audit.matrix_difference(a, b).first()
    assert (row["common_patients"], row["common_features"], row["cell_differences"], row["max_abs_diff"]) == (2, 2, 1, 3.0)
    assert row["mean_abs_diff"] == pytest.approx(0.75) and row["all_close"] is False


def test_reference_matrix(spark):
    pivot = spark.createDataFrame([("1", "100"), ("2", "200"), ("3", "100")], "person_id string, feature_id string")
    events = spark.createDataFrame(
        [(1, "2020-01-01", "II", 5), (1, "2019-01-01", "III", 6), (2, None, None, 7)],
        "PERSON_ID long, CONDITION_START_DATETIME string, GMFCS_M string, k long",
    )
    got = build_reference_matrix(pivot, events, "k", pivot)
    assert {tuple(r) for r in got.matrix.cells.collect()} == {("1", "100")}
    assert got.metadata.first()["GMFCS_M"] == "III" and got.verification.first()["cell_differences"] == 0
    assert build_reference_matrix(pivot, events, "k", require_level=False).matrix.persons.count() == 2


def test_group_comparison(spark):
    cells = spark.createDataFrame([("1", "250"), ("2", "250"), ("3", "401.0"), ("9", "x")], "person_id string, feature_id string")
    labels = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", "B")], "person_id string, cluster string")
    names = spark.createDataFrame([("250.0", "joint pain"), ("401.0", "pressure")], "phecode string, phenotype string")
    got = {r["phecode"]: r for r in contrast.compare_groups(cells, labels, "A", "B", names).collect()}
    assert (got["250"]["description"], got["250"]["diff"], got["250"]["keywords"]) == ("joint pain", -1.0, "pain|joint")
    assert got["401.0"]["ratio"] == 99.0 and got["x"]["description"] == "—"
    assert contrast.highlights(spark.createDataFrame([("a", 0.1, ""), ("b", -0.5, "pain")], "phecode string, diff double, keywords string")).first()["phecode"] == "b"


def test_prevalence_range_counts_absent_clusters(spark):
    cells = spark.createDataFrame([("1", "f"), ("2", "f")], "person_id string, feature_id string")
    labels = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B")], "person_id string, cluster string")
    assert features.prevalence_range(cells, labels).first()["prevalence_range"] == 1.0


def test_forest_is_fitted_in_parts_of_bounded_size(spark, monkeypatch):
    from pyspark.ml import classification

    labels = spark.createDataFrame([(str(i), "AB"[i % 2]) for i in range(40)], "person_id string, cluster string")
    rows = [(str(i), f) for i in range(40) for f, has in (("tells", i % 2), ("noise", i % 3 == 0), ("other", i % 5 == 0)) if has]
    cells = spark.createDataFrame(rows, "person_id string, feature_id string")
    sizes = []
    fit = classification.RandomForestClassifier.fit

    def counted(self, rows):
        sizes.append(self.getNumTrees())
        return fit(self, rows)

    monkeypatch.setattr(classification.RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(enrichment, "_FOREST_ROWS", 200)
    found = {r["feature_id"]: r["importance"] for r in enrichment.forest_importance(cells, labels, trees=12).collect()}
    assert sizes == [5, 5, 2]
    assert set(found) == {"tells", "noise", "other"} and found["tells"] == max(found.values())
    assert abs(sum(found.values()) - 1) < 1e-9


def test_forest_of_tasks_is_like_that_of_spark(spark, monkeypatch):
    """Trees of few rows are grown in tasks, without a round of jobs for every level of every tree."""
    from pyspark.ml import classification

    draw = np.random.default_rng(3)
    has = draw.random((300, 9)) < np.linspace(0.05, 0.6, 9)
    score = has @ np.array([2.0, 0, 0, 1.5, 0, 0, 1, 0, 0]) + draw.random(300)
    labels = spark.createDataFrame([(str(i), "ABC"[int(x > 0.8) + int(x > 1.9)]) for i, x in enumerate(score)], "person_id string, cluster string")
    cells = spark.createDataFrame([(str(i), f"f{j}") for i, j in zip(*map(list, np.nonzero(has)), strict=True)], "person_id string, feature_id string").repartition(3)
    fits, fit = [], classification.RandomForestClassifier.fit
    monkeypatch.setattr(classification.RandomForestClassifier, "fit", lambda self, rows: fits.append(1) or fit(self, rows))
    told = lambda: {r.feature_id: r.importance for r in enrichment.forest_importance(cells, labels, trees=100).collect()}
    tasks = told()
    assert not fits and tasks == told()
    monkeypatch.setattr(enrichment, "_FOREST_ROWS", 300 * 100 - 1)
    monkeypatch.setattr(enrichment, "_TASK_TREES", 100)
    theirs = told()
    assert fits and set(tasks) == set(theirs) == {f"f{j}" for j in range(9)}
    assert abs(sum(tasks.values()) - 1) < 1e-9 and max(abs(tasks[f] - theirs[f]) for f in tasks) < 0.02


def test_groups_are_compared_in_one_pass(spark):
    cells = spark.range(60).select((F.col("id") % 12).cast("string").alias("person_id"), F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("feature_id"))
    labels = spark.createDataFrame([(str(k), "ABC"[k % 3]) for k in range(11)], "person_id string, cluster string")
    names = spark.createDataFrame([("f1", "one")], "phecode string, phenotype string")
    alone = cells.unionByName(spark.createDataFrame([("11", "only"), (None, "none")], "person_id string, feature_id string"))
    got = {r.phecode: (r.count_first, r.count_second) for r in contrast.compare_groups(alone, labels, "A", "B", names).collect()}
    assert got == {**{f"f{k}": (4, 4) for k in range(5)}, "only": (0, 0), "none": (0, 0)}
    plan = contrast.compare_groups(cells, labels, "A", "B", names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 60") == 1
