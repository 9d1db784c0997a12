"""Matrix, embedding, graph, statistics, matching, audits and whole plans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import community, contrast, disclosure, embedding, enrichment, features, fuzzy, labels, neighbors
from ..operators.features import FeatureMatrix
from ..operators.grid import adjust_fdr
from ..operators.matching import best_assignment
from ..operators.silhouette import silhouette
from ..plans import experiments
from ..plans.clustering import run_clustering, score_resolutions
from ..plans.disclosure import run_privacy_check
from ..plans.full_run import run_filtered
from ..plans.interpretation import run_comparison, run_interpretation
from ..plans.matrix import matrix_summary
from ..plans.reference import artifact_audit, build_reference_matrix, replay_report, reproduce
from ..session import cut_lineage
from ..settings import ClusterSettings, ReplaySettings
from ..sources.tables import wide_to_cells
from .registry import longs, query, r6, rounded
from .relational import _enrichment, _labels, signature_match_scores
from .roles import Roles

_K = 15
_GRID = ClusterSettings().resolution_grid


def _points(t: Roles) -> DataFrame:
    return t.points


def _near(t: Roles) -> DataFrame:
    return neighbors.nearest_neighbors(_points(t), _K)


def _rows(t: Roles) -> DataFrame:
    return t.points.withColumnRenamed("person_id", "id")


def _float_edges(edges: DataFrame) -> DataFrame:
    return rounded(edges, "weight")


# --- matrix -----------------------------------------------------------------


@query("M1 E3", "SELECT p.person_id, count(c.feature_id) AS n_features FROM persons p LEFT JOIN cells c ON c.person_id = p.person_id GROUP BY ALL", "persons cells")
def matrix_rows(t: Roles) -> DataFrame:
    m = t.build.matrix
    return m.persons.join(m.cells, "person_id", "left").groupBy("person_id").agg(F.count("feature_id").alias("n_features"))


@query("E3 A16", """
    SELECT (SELECT count(*) FROM persons) AS n_patients, count(DISTINCT feature_id) AS n_features, count(*) AS n_ones,
      (SELECT count(*) FROM events_mapped) AS n_event_rows, 'icd_phecode_map' AS mapping_source FROM cells""", "persons cells events_mapped")
def feature_matrix_summary(t: Roles) -> DataFrame:
    return matrix_summary(t.saved)


@query("M2", """
    SELECT person_id, feature_id, round(ln(1 + 10000.0 / count(*) OVER (PARTITION BY person_id)), 6) AS value FROM part_cells""", "part_cells")
def normalize_log1p(t: Roles) -> DataFrame:
    return rounded(features.normalize_log1p(t.part_matrix.cells), "value")


_MOMENTS = """WITH v AS (SELECT person_id, feature_id, ln(1 + 10000.0 / count(*) OVER (PARTITION BY person_id)) AS x FROM part_cells),
    n AS (SELECT count(*) AS n FROM part_persons),
    m AS (SELECT feature_id, sum(x) / n AS mean, sqrt(greatest(0, sum(x * x) / n - (sum(x) / n) ** 2)) AS std FROM v, n GROUP BY feature_id, n)"""


@query("M3 M4", f"""{_MOMENTS}
    SELECT person_id, feature_id, round(least((x - mean) / std, 5.0), 6) AS value FROM v JOIN m USING (feature_id)""", "part_cells part_persons")
def zscore_present_cells(t: Roles) -> DataFrame:
    m = t.part_matrix
    return rounded(features.zscore(features.normalize_log1p(m.cells), m.persons, 5.0)[0].select("person_id", "feature_id", "value"), "value")


@query("M3 M4", f"{_MOMENTS} SELECT feature_id, round(least(-mean / std, 5.0), 6) AS absent_value FROM m", "part_cells part_persons")
def zscore_absent_cells(t: Roles) -> DataFrame:
    m = t.part_matrix
    return rounded(features.zscore(features.normalize_log1p(m.cells), m.persons, 5.0)[1], "absent_value")


@query("M23 F12 L6", """
    WITH p AS (SELECT feature_id, count(*) AS n FROM all_part_cells GROUP BY feature_id),
      l AS (SELECT cluster, count(*) AS size FROM assignments GROUP BY cluster),
      r AS (SELECT feature_id, cluster, count(*) AS n FROM all_part_cells JOIN assignments USING (person_id) GROUP BY ALL),
      s AS (SELECT p.feature_id, max(coalesce(r.n, 0) / size) - min(coalesce(r.n, 0) / size) AS spread FROM p CROSS JOIN l
        LEFT JOIN r ON r.feature_id = p.feature_id AND r.cluster = l.cluster GROUP BY p.feature_id)
    SELECT 'prevalence_gt_' || c AS set_name, feature_id, false AS label_informed FROM p CROSS JOIN (VALUES (3), (50), (100), (150), (300), (500)) v(c)
      WHERE n > c AND c IN (SELECT c FROM p CROSS JOIN (VALUES (3), (50), (100), (150), (300), (500)) w(c) WHERE n > c GROUP BY c HAVING count(*) >= 5)
    UNION ALL SELECT 'top_' || k || '_overall_prevalence', feature_id, false FROM (SELECT feature_id, row_number() OVER (ORDER BY n DESC, feature_id) AS r FROM p)
      CROSS JOIN (VALUES (100), (300), (600)) v(k) WHERE r <= k
    UNION ALL SELECT 'top_' || k || '_AE_prevalence_range', feature_id, true FROM (SELECT feature_id, row_number() OVER (ORDER BY spread DESC, feature_id) AS r FROM s)
      CROSS JOIN (VALUES (25), (100), (300)) v(k) WHERE r <= k""", "all_part_cells assignments")
def feature_sets(t: Roles) -> DataFrame:
    return features.feature_sets(features.binary_cells(t.part_events), t.assignments)


# --- embedding --------------------------------------------------------------


def _components(t: Roles, k: int | None = None, target: float | None = None) -> embedding.Components:
    return embedding.principal_components(embedding.array_vectors(t.points), k, target)


@query("M5")
def principal_components(t: Roles) -> DataFrame:
    return _components(t, 15).scores


@query("M6 F6 M20")
def components_by_variance(t: Roles) -> DataFrame:
    m = features.without_constant(t.saved.matrix)
    vectors, _ = embedding.person_vectors(m.persons, features.transform(m, "zscore"))
    return embedding.principal_components(cut_lineage(vectors), variance_target=0.80).scores


@query("M7", "SELECT id AS person_id, list_transform(v[1:15], lambda x: round(x, 6)) AS embedding FROM points", "points")
def first_components(t: Roles) -> DataFrame:
    cut = embedding.first_components(t.points, 15)
    return cut.select("person_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 6)).alias("embedding"))


_LONG_POINTS = "SELECT id, label, generate_subscripts(v, 1) AS pc, unnest(v) AS x FROM points"


@query("M8", f"""
    WITH e AS ({_LONG_POINTS}), m AS (SELECT id, pc, x, CASE WHEN pc % 2 = 0 THEN -x ELSE x END AS y FROM e)
    SELECT pc, round(least(max(abs(x - y)), max(abs(x + y))), 6) AS max_abs_diff, max(abs(x + y)) < max(abs(x - y)) AS flipped FROM m GROUP BY pc""", "points")
def compare_embeddings(t: Roles) -> DataFrame:
    other = t.points.select(
        "person_id", F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i % 2 == 1, -x).otherwise(x)).alias("embedding")
    )
    mine = t.points.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(embedding.compare_embeddings(mine, other), "max_abs_diff")


_SHARES = f"""WITH e AS ({_LONG_POINTS}), v AS (SELECT pc, var_pop(x) AS v FROM e GROUP BY pc),
    s AS (SELECT CAST(pc AS INT) AS pc, v / sum(v) OVER () AS variance_ratio FROM v)"""


def _shares(t: Roles) -> DataFrame:
    """Share of variance of each vector position."""
    moments = embedding.component_moments(t.points).select((F.col("pc") + 1).alias("pc"), (F.col("std") * F.col("std")).alias("v"))
    return moments.select("pc", (F.col("v") / moments.agg(F.sum("v")).scalar()).alias("variance_ratio"))


@query("W9", f"{_SHARES} SELECT CAST(pc AS BIGINT) AS pc, round(variance_ratio, 6) AS variance_ratio, round(sum(variance_ratio) OVER (ORDER BY pc), 6) AS cumulative FROM s", "points")
def cumulative_variance(t: Roles) -> DataFrame:
    return longs(rounded(embedding.cumulative_variance(_shares(t)), "variance_ratio", "cumulative"), "pc")


@query("W9 M6", f"{_SHARES} SELECT CAST(min(pc) AS BIGINT) AS n_components FROM (SELECT pc, sum(variance_ratio) OVER (ORDER BY pc) AS c FROM s) WHERE c >= 0.8", "points")
def components_to_reach(t: Roles) -> DataFrame:
    return embedding.components_to_reach(_shares(t))


@query("T13", f"""{_SHARES} SELECT count(*) AS stored_pcs, round(max(variance_ratio) FILTER (pc = 1), 6) AS first_pc_variance,
    round(sum(variance_ratio) FILTER (pc <= 15), 6) AS first15_variance, round(sum(variance_ratio), 6) AS stored_variance FROM s""", "points")
def variance_summary(t: Roles) -> DataFrame:
    return rounded(embedding.variance_summary(_shares(t)), "first_pc_variance", "first15_variance", "stored_variance")


@query("A20", f"SELECT CAST(label AS BIGINT) AS cluster, CAST(pc - 1 AS BIGINT) AS pc, round(avg(x), 6) AS mean FROM ({_LONG_POINTS}) GROUP BY label, pc", "points")
def cluster_centroids(t: Roles) -> DataFrame:
    marks = t.point_labels.select(F.col("id").alias("person_id"), F.col("label").alias("cluster"))
    return longs(rounded(embedding.centroids(t.points, marks), "mean"), "pc")


# --- neighbours and graphs ----------------------------------------------------


@query("M9 J14 W8", "SELECT src, dst, round(distance, 6) AS distance, rank FROM near", "near")
def nearest_neighbors(t: Roles) -> DataFrame:
    return longs(rounded(_near(t), "distance"), "rank")


_GRAPH = "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(1 / (1 + distance)), 6) AS weight FROM near GROUP BY 1, 2"


@query("M10 J15 M14", _GRAPH, "near")
def knn_graph(t: Roles) -> DataFrame:
    return _float_edges(fuzzy.build_graph(_points(t), _K, "exact"))


@query("M11", "SELECT src, dst, round(1 / (1 + distance), 6) AS weight FROM near WHERE src < dst AND rank <= 14", "near")
def knn_graph_upper(t: Roles) -> DataFrame:
    return _float_edges(fuzzy.build_graph(_points(t), _K, "upper"))


@query("M13", "SELECT src, dst, round(1 / (1 + distance), 6) AS weight FROM near WHERE src < dst", "near")
def stored_graph(t: Roles) -> DataFrame:
    both = _near(t).select("src", "dst", neighbors.similarity(F.col("distance")).alias("weight"))
    return _float_edges(neighbors.stored_graph(both))


@query("M12", """
    , l AS (SELECT src, list(distance ORDER BY distance) AS d, coalesce(min(distance) FILTER (distance > 0), 0) AS rho FROM near WHERE rank <= 14 GROUP BY src),
    b(src, d, rho, lo, hi, mid, step) AS (
      SELECT src, d, rho, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE, 0 FROM l
      UNION ALL SELECT src, d, rho,
        CASE WHEN p < log2(15) THEN mid ELSE lo END, CASE WHEN p > log2(15) THEN mid ELSE hi END,
        CASE WHEN abs(p - log2(15)) < 1e-5 THEN mid WHEN p > log2(15) THEN (lo + mid) / 2 WHEN hi = 'infinity'::DOUBLE THEN mid * 2 ELSE (mid + hi) / 2 END,
        CASE WHEN abs(p - log2(15)) < 1e-5 THEN 99 ELSE step + 1 END
      FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) AS p FROM b WHERE step < 64)),
    s AS (SELECT src, any_value(rho) AS rho, arg_max(mid, step) AS sigma0, any_value(list_sum(d)) / 15 AS mean FROM b GROUP BY src),
    g AS (SELECT src, rho, greatest(sigma0, 0.001 * CASE WHEN rho > 0 THEN mean ELSE (SELECT avg(mean) FROM s) END) AS sigma FROM s),
    m AS (SELECT n.src, n.dst, CASE WHEN distance <= rho THEN 1.0 ELSE exp(-(distance - rho) / sigma) END AS w FROM near n JOIN g ON g.src = n.src WHERE rank <= 14),
    u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, coalesce(max(w) FILTER (src < dst), 0) AS a, coalesce(max(w) FILTER (src > dst), 0) AS b FROM m GROUP BY 1, 2)
    SELECT src, dst, round(2 * (a + b - a * b), 6) AS weight FROM u""", "near")
def fuzzy_graph(t: Roles) -> DataFrame:
    return _float_edges(fuzzy.build_graph(_points(t), _K, "fuzzy"))


# --- communities --------------------------------------------------------------


@query("M15 M17")
def communities_over_resolutions(t: Roles) -> DataFrame:
    graph = cut_lineage(fuzzy.build_graph(_points(t), _K, "fuzzy"))
    return score_resolutions(t.points, graph, _GRID, 42)[1]


@query("M16", f""", e AS ({_GRAPH}), b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    l AS (SELECT s.label AS label, sum(weight) AS k, coalesce(sum(weight) FILTER (s.label = d.label), 0) AS w FROM b
      JOIN points s ON s.id = b.src JOIN points d ON d.id = b.dst GROUP BY s.label)
    SELECT round(sum(w) - 0.5 * sum(k * k) / sum(k), 4) AS quality, count(*) AS n_communities FROM l""", "near")
def partition_quality(t: Roles) -> DataFrame:
    found = community.partition_quality(knn_graph(t), t.point_labels, 0.5)
    return found.select(F.round("quality", 4).alias("quality"), "n_communities")


_SILHOUETTE = """
    SELECT count(DISTINCT own) AS n_clusters, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
      SELECT src, any_value(la) AS own, coalesce(sum(s) FILTER (la = lb), 0) / nullif(max(c) FILTER (la = lb), 0) AS a, min(s / c) FILTER (la <> lb) AS b,
        1 + coalesce(max(c) FILTER (la = lb), 0) AS n FROM (
        SELECT src, la, lb, sum(distance) AS s, count(*) AS c FROM pairs GROUP BY src, la, lb) GROUP BY src)"""


@query("M18", _SILHOUETTE, "pairs")
def silhouette_of_labels(t: Roles) -> DataFrame:
    return rounded(silhouette(_rows(t), t.point_labels), "silhouette")


def _merge_sql(target: int, rounds: int) -> str:
    """``rounds`` steps of the same kind; a step with no more than ``target`` clusters left changes nothing."""
    steps = []
    for k in range(rounds):
        steps.append(f"""
    l{k} AS (SELECT * FROM r{k} WHERE (SELECT count(*) FROM r{k}) > {target} ORDER BY n, label LIMIT 1),
    i{k} AS (SELECT r.label AS into_label, l.label AS gone, l.n AS more, l.s AS plus, l.held AS also FROM r{k} r, l{k} l WHERE r.label <> l.label
      ORDER BY list_distance(list_transform(r.s, lambda x: x / r.n), list_transform(l.s, lambda x: x / l.n)), r.label LIMIT 1),
    r{k + 1} AS (SELECT label, CASE WHEN label = into_label THEN n + more ELSE n END AS n,
      CASE WHEN label = into_label THEN list_transform(list_zip(s, plus), lambda z: z[1] + z[2]) ELSE s END AS s,
      CASE WHEN label = into_label THEN list_concat(held, also) ELSE held END AS held FROM r{k} LEFT JOIN i{k} ON true WHERE gone IS NULL OR label <> gone)""")
    return f"""
    WITH c AS (SELECT label, pc, sum(x) AS x, count(*) AS n FROM ({_LONG_POINTS}) GROUP BY label, pc),
    r0 AS (SELECT CAST(label AS BIGINT) AS label, max(n) AS n, list(x ORDER BY pc) AS s, [CAST(label AS BIGINT)] AS held FROM c GROUP BY label),{",".join(steps)},
    m AS (SELECT unnest(held) AS own, row_number() OVER (ORDER BY label) - 1 AS merged FROM r{rounds})
    SELECT id, CAST(merged AS BIGINT) AS label FROM points JOIN m ON own = label"""


@query("M19", _merge_sql(5, 12), "points")
def merge_small_clusters(t: Roles) -> DataFrame:
    return community.merge_to_target(_rows(t), t.point_labels, 5)


@query("M21", """
    WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS t FROM c),
      a AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY quality)), b AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY toxic))
    SELECT round((s.x - a.x * b.x / (t * (t - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (t * (t - 1) / 2)), 6) AS ari FROM s, a, b""")
def adjusted_rand_index(t: Roles) -> DataFrame:
    return rounded(labels.adjusted_rand(t.table("labels"), "quality", "toxic"), "ari")


# --- statistics -----------------------------------------------------------------


@query("T1", "SELECT * FROM grid", "grid")
def contingency_grid(t: Roles) -> DataFrame:
    return features.cluster_feature_grid(t.saved.matrix.cells, _labels(t))


@query("T2", "SELECT cluster, feature_id, round(p_value, 6) AS p_value FROM tested", "tested")
def fisher_exact(t: Roles) -> DataFrame:
    tested = enrichment.enrichment_counts(features.cluster_feature_grid(t.saved.matrix.cells, _labels(t)))
    return tested.select("cluster", "feature_id", r6("p_value").alias("p_value"))


@query("T3 W7", """
    WITH p AS (SELECT o_orderkey, o_totalprice / (SELECT 2 * max(o_totalprice) FROM orders) AS p FROM orders),
      s AS (SELECT o_orderkey, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS step FROM p)
    SELECT o_orderkey, round(least(1.0, min(step) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_value_fdr FROM s""")
def false_discovery_rate(t: Roles) -> DataFrame:
    orders = t.table("orders", "o_orderkey", "o_totalprice")
    top = orders.agg(2 * F.max("o_totalprice")).scalar()
    tests = orders.select("o_orderkey", (F.col("o_totalprice") / top).alias("p_value"))
    return adjust_fdr(tests).select("o_orderkey", r6("p_value_fdr").alias("p_value_fdr"))


_ENRICHMENT_SQL = """
    SELECT cluster, feature_id, cluster_patients, num_patients, rest_patients, rest_num_patients, round(cluster_prevalence, 6) AS cluster_prevalence,
      round(rest_prevalence, 6) AS rest_prevalence, round(prevalence_ratio, 6) AS prevalence_ratio, ratio_is_infinite, round(p_value, 6) AS p_value,
      direction, round(p_value_fdr, 6) AS p_value_fdr, phecode, phecode_str, phecode_category FROM enrichment"""


def _rounded_enrichment(found: DataFrame) -> DataFrame:
    infinite = F.coalesce(F.col("prevalence_ratio") == float("inf"), F.lit(False))
    return found.select(
        "cluster", "feature_id", "cluster_patients", "num_patients", "rest_patients", "rest_num_patients",
        r6("cluster_prevalence").alias("cluster_prevalence"), r6("rest_prevalence").alias("rest_prevalence"),
        F.when(~infinite, r6("prevalence_ratio")).alias("prevalence_ratio"), infinite.alias("ratio_is_infinite"),
        r6("p_value").alias("p_value"), "direction", r6("p_value_fdr").alias("p_value_fdr"),
        "phecode", "phecode_str", "phecode_category",
    )


@query("T4 T1 T2 T3 X15 J6 L2", _ENRICHMENT_SQL, "enrichment")
def feature_enrichment(t: Roles) -> DataFrame:
    return _rounded_enrichment(enrichment.sort_enrichment(_enrichment(t)))


@query("W3 F9", "SELECT cluster, feature_id, rank FROM ranked WHERE rank <= 5", "ranked")
def top_enriched_features(t: Roles) -> DataFrame:
    return longs(enrichment.top_enriched(_enrichment(t), 5).select("cluster", "feature_id", "rank"), "rank")


@query("T5")
def forest_importance(t: Roles) -> DataFrame:
    return enrichment.forest_importance(t.saved.matrix.cells, _labels(t))


@query("T7", """
    , sc AS (SELECT c.cluster, b.baseline_cluster, coalesce(p.n, 0) * 2 + coalesce(k.n, 0) AS score
      FROM (SELECT DISTINCT cluster FROM ranked) c CROSS JOIN (SELECT DISTINCT baseline_cluster FROM baseline) b
      LEFT JOIN (SELECT cluster, baseline_cluster, count(DISTINCT phecode) AS n FROM ranked JOIN baseline USING (phecode) WHERE rank <= 30 GROUP BY ALL) p
        ON p.cluster = c.cluster AND p.baseline_cluster = b.baseline_cluster
      LEFT JOIN (SELECT cluster, baseline_cluster, count(DISTINCT com_category) AS n FROM ranked r JOIN baseline b2 ON r.phecode_category = b2.com_category
        WHERE rank <= 30 GROUP BY ALL) k ON k.cluster = c.cluster AND k.baseline_cluster = b.baseline_cluster),
    cl AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS i FROM (SELECT DISTINCT cluster FROM sc)),
    w(i, path, total) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT)
      UNION ALL SELECT w.i + 1, list_append(path, baseline_cluster), CAST(total + score AS BIGINT) FROM w JOIN cl ON cl.i = w.i + 1 JOIN sc ON sc.cluster = cl.cluster
      WHERE NOT list_contains(path, baseline_cluster)),
    best AS (SELECT path FROM w WHERE i = (SELECT count(*) FROM cl) ORDER BY total DESC, path LIMIT 1)
    SELECT sc.cluster, sc.baseline_cluster, sc.score FROM best, cl JOIN sc ON sc.cluster = cl.cluster WHERE path[cl.i] = sc.baseline_cluster""",
    "ranked baseline")
def best_assignment_to_baseline(t: Roles) -> DataFrame:
    return best_assignment(cut_lineage(signature_match_scores(t))).select("cluster", "baseline_cluster", "score")


@query("T8 X13 X16 L3 U1", """
    , s AS (SELECT count(*) FILTER (cluster = 'A') AS na, count(*) FILTER (cluster = 'B') AS nb FROM assignments),
    c AS (SELECT f.feature_id, count(*) FILTER (cluster = 'A') AS ca, count(*) FILTER (cluster = 'B') AS cb FROM part_cells f LEFT JOIN assignments USING (person_id) GROUP BY 1),
    r AS (SELECT feature_id, ca, cb, ca / na AS pa, cb / nb AS pb FROM c, s)
    SELECT feature_id AS phecode, ca AS count_first, cb AS count_second, round(pa, 4) AS prev_first, round(pb, 4) AS prev_second,
      round(CASE WHEN pa > 0.01 THEN pb / pa WHEN pb > 0 THEN 99.0 ELSE 0.0 END, 2) AS ratio FROM r""", "part_cells assignments")
def two_group_comparison(t: Roles) -> DataFrame:
    return _contrast(t).select("phecode", "count_first", "count_second", "prev_first", "prev_second", "ratio")


@query("T8 L3 U1")
def two_group_highlights(t: Roles) -> DataFrame:
    return contrast.highlights(cut_lineage(_contrast(t)))


def _contrast(t: Roles) -> DataFrame:
    named = t.table("part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("phecode"), F.col("p_name").alias("phenotype"))
    return contrast.compare_groups(t.part_matrix.cells, t.assignments, "A", "B", named)


# --- disclosure -----------------------------------------------------------------

_CELLS = """SELECT cluster, CASE gmfcs_level WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' ELSE 'V' END AS gmfcs, count(*) AS n_patients
    FROM assignments a JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR) WHERE gmfcs_level IS NOT NULL GROUP BY ALL"""


@query("A8 F11 T9 J8", f"SELECT *, CAST(10 AS BIGINT) AS threshold, n_patients < 10 AS below_threshold FROM ({_CELLS})", "assignments cohort")
def subgroup_sizes(t: Roles) -> DataFrame:
    joined = disclosure.join_assignments(t.assignments, t.cohort)
    return disclosure.flag_small_cells(disclosure.subgroup_sizes(joined), 10)


@query("E7 T9 A17 K6", f"""
    SELECT count(*) AS n_subgroups, min(n_patients) AS minimum_subgroup_size, CAST(count(*) FILTER (n_patients < 10) AS BIGINT) AS n_below_threshold,
      (SELECT count(*) FROM customer) AS n_joined_patients, CAST(0 AS BIGINT) AS n_without_cluster,
      CAST((SELECT count(*) FROM cohort WHERE gmfcs_level IS NULL) AS BIGINT) AS n_without_level FROM ({_CELLS})""", "assignments cohort")
def disclosure_summary(t: Roles) -> DataFrame:
    return run_privacy_check(t.assignments, t.cohort).summary


# --- plans ----------------------------------------------------------------------

_RUN = replace(
    ClusterSettings(), preprocess_method="scanpy_log1p", graph_method="fuzzy", random_seed=0,
)


@query("E4 M20 L4 S13")
def clustering_run(t: Roles) -> DataFrame:
    return run_clustering(t.saved.matrix, _RUN).assignments


def _cells_of(df: DataFrame, section: str, keys: list[str], values: list[str]) -> DataFrame:
    """(section, item, measure, value): one row for each value of each row."""
    item = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    measures = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), r6(F.col(v).cast("double")).alias("value")) for v in values]))
    return df.select(F.lit(section).alias("section"), item.alias("item"), measures.alias("m")).select("section", "item", "m.measure", "m.value")


@query("E5 T4 T5 A6 A7")
def interpretation_run(t: Roles) -> DataFrame:
    """All four results of the run, importance of the whole forest included."""
    found = run_interpretation(t.saved.matrix, t.assignments, t.saved.metadata, t.cohort)
    tests = _cells_of(cut_lineage(found.enrichment), "enrichment", ["cluster", "feature_id"], ["cluster_patients", "rest_patients", "cluster_prevalence", "rest_prevalence", "p_value", "p_value_fdr"])
    summary = _cells_of(found.summary, "summary", ["cluster"], ["n_patients", "percent", "death_rate", "median_visits", "gmfcs_available"])
    levels = _cells_of(found.levels, "levels", ["cluster", "gmfcs_level"], ["n", "percent"])
    return tests.unionByName(summary).unionByName(levels).unionByName(_cells_of(found.importance, "importance", ["feature_id"], ["importance"]))


@query("E6 K5 T6 T7")
def validation_report(t: Roles) -> DataFrame:
    names = t.table("part").select(F.col("p_type").alias("cluster"), F.initcap("p_type").alias("cluster_name")).distinct()
    summary = enrichment.cluster_summary(t.assignments, t.cohort)
    return run_comparison(cut_lineage(_enrichment(t)), summary, t.baseline, names, audit=t.saved.audit).report


@query("E8 T10 T11 T12 T13 K7")
def artifact_audit_report(t: Roles) -> DataFrame:
    m = t.saved.matrix
    pairs = t.assignments.select(F.col("person_id").alias("id"), "cluster", F.col("cluster").alias("subtype")).select(
        "id", "cluster", "subtype", F.col("cluster").alias("obs_cluster"), F.col("subtype").alias("obs_subtype"),
        F.col("id").alias("numeric_id"), F.col("cluster").alias("subcluster"), F.col("subtype").alias("demo_subtype"),
        F.col("cluster").alias("published"),
    )
    side = t.cohort.filter(F.col("gmfcs_level").isNotNull()).select(
        F.col("person_id").cast("string").alias("person_id"), F.col("gmfcs_level").alias("level")
    )
    return artifact_audit(pairs, t.saved.events, m.cells, features.normalize_log1p(m.cells), t.assignments.join(side, "person_id"))


@query("E9 S9 J16 J11", """
    SELECT count(DISTINCT user_id) AS common_patients, count(DISTINCT event_type) AS common_features, count(*) AS left_nonzero, count(*) AS right_nonzero,
      CAST(0 AS BIGINT) AS cell_differences, CAST(0 AS DOUBLE) AS max_abs_diff, CAST(0 AS DOUBLE) AS mean_abs_diff, true AS all_close
    FROM (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus IS NOT NULL))""")
def reference_matrix_check(t: Roles) -> DataFrame:
    kinds = [r[0] for r in t.table("events", "event_type").distinct().orderBy("event_type").collect()]
    wide = t.table("events", "user_id", "event_type").groupBy("user_id").pivot("event_type", kinds).count()
    cells = wide_to_cells(wide.withColumnRenamed("user_id", "PERSON_ID"), "PERSON_ID")
    events = t.table("orders").select(
        F.col("o_custkey").alias("PERSON_ID"), F.col("o_orderdate").alias("CONDITION_START_DATETIME"),
        F.col("o_orderstatus").alias("GMFCS_M"), "o_orderkey",
    )
    stored = t.observations.select(F.col("person_id").cast("string").alias("person_id"), F.col("observation_source_value").alias("feature_id")).distinct()
    return build_reference_matrix(cells, events, "o_orderkey", stored).verification


@query("E10 M25 K7 S10")
def replay_of_stored_clusters(t: Roles) -> DataFrame:
    m = t.saved.matrix
    settings = ReplaySettings()
    vectors, _ = embedding.person_vectors(m.persons, features.normalize_log1p(m.cells))
    points = embedding.first_components(embedding.principal_components(cut_lineage(vectors), settings.pca_n_components).scores, 15)
    stored = cut_lineage(fuzzy.build_graph(points, settings.n_neighbors, "fuzzy"))
    return replay_report(reproduce(m, stored, t.assignments, settings))


@query("E11")
def filtered_run(t: Roles) -> DataFrame:
    return run_filtered(t.sources, t.code_map, baseline=t.baseline, trees=0).comparison.mapping


def _point_matrix(t: Roles) -> FeatureMatrix:
    """Part features of the customers that have a level: a middling matrix for the experiments."""
    known = t.cohort.filter(F.col("gmfcs_level").isNotNull()).select(F.col("person_id").cast("string").alias("person_id"))
    return features.build_matrix(t.part_events.join(known, "person_id", "left_semi"), 4)


@query("E12 M22 L5")
def sensitivity_best(t: Roles) -> DataFrame:
    results = experiments.sensitivity_grid(
        _point_matrix(t), t.assignments, transforms=("lognorm",), rules=("fixed15",), neighbors=(15, 30),
        resolutions=(0.5, 1.0), sets=("top_300_overall_prevalence",),
    )
    return experiments.best_configurations(results)


@query("E12 M24")
def reduced_feature_validation(t: Roles) -> DataFrame:
    return experiments.best_reduced(experiments.reduced_feature_validation(t.saved.matrix, t.assignments))
