"""Readers, projections, filters, joins, aggregates, windows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, identity, levels, measures
from ..operators import audit, cohort, contrast, enrichment, features, labels, mapping
from ..operators.community import letters, relabel_sequential
from ..plans.extraction import extract_all, extract_summary
from ..session import cut_lineage
from ..sources import extract, sinks, tables
from ..sources.extract import DiagnosisShape
from .registry import longs, query, r6, rounded
from .roles import Roles

_SALT = "example salt"


# --- sources ---------------------------------------------------------------


@query("S1 S6", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def scan_and_aggregate(t: Roles) -> DataFrame:
    return t.table("orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("S4", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def scan_pruned_columns(t: Roles) -> DataFrame:
    return t.table("lineitem", "l_orderkey", "l_partkey", "l_returnflag").filter(F.col("l_returnflag") == "A").drop("l_returnflag")


@query("S7 P4", "SELECT domain_id AS baseline_cluster, concept_code FROM concept", roles="concept")
def stack_baseline_tables(t: Roles) -> DataFrame:
    names = [r[0] for r in t.concept.select("domain_id").distinct().orderBy("domain_id").collect()]
    parts = {f"cluster_{n}": t.concept.filter(F.col("domain_id") == n).select("concept_code") for n in names}
    return tables.stack_labelled(parts)


@query("S8", "SELECT chr(65 + r_regionkey) AS cluster, trim(r_name) AS cluster_name FROM region WHERE r_name IS NOT NULL AND r_regionkey < 5")
def cluster_display_names(t: Roles) -> DataFrame:
    rows = t.table("region").select(F.char(65 + F.col("r_regionkey")).alias("key"), F.col("r_name").alias("Final"))
    return tables.cluster_display_names(rows, "key", "Final")


@query("S9 A15 X22", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS person_id, event_type AS feature_id FROM events")
def wide_table_to_cells(t: Roles) -> DataFrame:
    kinds = [r[0] for r in t.table("events", "event_type").distinct().orderBy("event_type").collect()]
    wide = t.table("events", "user_id", "event_type").groupBy("user_id").pivot("event_type", kinds).count()
    renamed = wide.toDF("PERSON_ID", *[f"{k}.0" for k in kinds])
    return tables.wide_to_cells(renamed, "PERSON_ID")


@query("S14 S22 P4 J1", """
    SELECT person_id, CAST(NULL AS DATE) AS death_date, CAST(NULL AS TIMESTAMP) AS death_datetime, 'customer' AS source_table FROM deaths""",
    "deaths")
def deaths_with_provenance(t: Roles) -> DataFrame:
    return extract.extract_deaths(t.deaths, "customer", t.cohort_table)


@query("S15", """
    SELECT count(*) AS n_rows, count(DISTINCT person_id) AS n_persons FROM (
      SELECT person_id FROM visits WHERE (SELECT count(DISTINCT person_id) FROM observations) < 1000
      UNION ALL SELECT person_id FROM observations WHERE (SELECT count(DISTINCT person_id) FROM observations) >= 1000)""",
    "visits observations")
def source_by_coverage(t: Roles) -> DataFrame:
    chosen, _ = tables.choose_by_coverage(t.observations.select("person_id"), lambda: t.visits.select("person_id"), 1000)
    return chosen.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("person_id").alias("n_persons"))


@query("S17", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def table_shape(t: Roles) -> DataFrame:
    return tables.table_shape(t.table("lineitem"))


_COHORT_COLUMNS = """c_custkey AS person_id, c_name AS person_source_value, c_mktsegment AS gender_source_value,
    CAST(NULL AS VARCHAR) AS race_source_value, CAST(NULL AS VARCHAR) AS ethnicity_source_value, CAST(NULL AS BIGINT) AS year_of_birth,
    CAST(NULL AS BIGINT) AS month_of_birth, CAST(NULL AS BIGINT) AS day_of_birth, CAST(NULL AS DATE) AS birth_date,
    CAST(NULL AS TIMESTAMP) AS birth_datetime"""


@query("S18 P1 P2", f"SELECT {_COHORT_COLUMNS} FROM customer")
def cohort_conformed(t: Roles) -> DataFrame:
    return extract.extract_cohort(t.person)


@query("L1", f"SELECT {_COHORT_COLUMNS} FROM customer ORDER BY c_custkey LIMIT 100")
def cohort_ordered_limit(t: Roles) -> DataFrame:
    return extract.extract_cohort(t.person, limit_rows=100)


@query("S19 F1 J1", """
    SELECT person_id, visit_occurrence_id, condition_occurrence_id, dx_code_char AS source_code, dx_name AS source_name,
      dx_category AS diagnosis_category, condition_start_datetime AS diagnosis_datetime,
      CAST(condition_start_datetime AS DATE) AS diagnosis_date, phecode, CAST(NULL AS VARCHAR) AS phecode_str,
      CAST(NULL AS VARCHAR) AS phecode_category, CAST(NULL AS VARCHAR) AS icd_10, CAST(NULL AS VARCHAR) AS icd,
      CAST(1 AS BIGINT) AS event_count, 'cp_person_conditions' AS source_table FROM conditions WHERE dx_code_char IS NOT NULL""",
    "conditions")
def diagnoses_person_events(t: Roles) -> DataFrame:
    return extract.extract_diagnoses(t.conditions, t.cohort_table)


@query("S19 A1", """
    SELECT person_id, CAST(NULL AS BIGINT) AS visit_occurrence_id, CAST(NULL AS BIGINT) AS condition_occurrence_id,
      dx_code_char AS source_code, min(dx_name) AS source_name, min(dx_category) AS diagnosis_category,
      min(condition_start_datetime) AS diagnosis_datetime, min(CAST(condition_start_datetime AS DATE)) AS diagnosis_date,
      min(phecode) AS phecode, CAST(NULL AS VARCHAR) AS phecode_str, CAST(NULL AS VARCHAR) AS phecode_category,
      CAST(NULL AS VARCHAR) AS icd_10, CAST(NULL AS VARCHAR) AS icd, count(*) AS event_count,
      'cp_person_conditions_patient_code' AS source_table
    FROM conditions WHERE dx_code_char IS NOT NULL GROUP BY person_id, dx_code_char""", "conditions")
def diagnoses_person_codes(t: Roles) -> DataFrame:
    return extract.extract_diagnoses(t.conditions, t.cohort_table, distinct_patient_code=True)


@query("S19 J2 P5", """
    SELECT person_id, visit_occurrence_id, condition_occurrence_id, source_code, source_name, diagnosis_category,
      diagnosis_datetime, diagnosis_date, CAST(NULL AS VARCHAR) AS vocabulary_id, CAST(1 AS BIGINT) AS event_count,
      'condition_occurrence' AS source_table FROM diagnoses""", "diagnoses")
def diagnoses_occurrence_events(t: Roles) -> DataFrame:
    return t.diagnoses


@query("S19 A1 J2", """
    SELECT person_id, CAST(NULL AS BIGINT) AS visit_occurrence_id, CAST(NULL AS BIGINT) AS condition_occurrence_id, source_code,
      min(source_name) AS source_name, min(diagnosis_category) AS diagnosis_category, min(diagnosis_datetime) AS diagnosis_datetime,
      min(diagnosis_date) AS diagnosis_date, CAST(NULL AS VARCHAR) AS vocabulary_id, count(*) AS event_count,
      'condition_occurrence_patient_code' AS source_table FROM diagnoses GROUP BY person_id, source_code""", "diagnoses")
def diagnoses_occurrence_codes(t: Roles) -> DataFrame:
    return extract.extract_diagnoses(
        t.occurrences, t.cohort_table, DiagnosisShape.CONDITION_OCCURRENCE, True, t.concept.drop("p_size")
    )


@query("S20 J1", "SELECT * FROM visits WHERE person_id IN (SELECT person_id FROM deaths)", "visits deaths")
def visits_of_cohort(t: Roles) -> DataFrame:
    return extract.extract_visits(t.visits, t.deaths)


@query("S21 A2 X18", "SELECT * FROM visit_summary", "visit_summary")
def visit_summary(t: Roles) -> DataFrame:
    return extract.extract_visit_summary(t.visits, t.cohort_table)


@query("S23 F2 X1 P5", """
    SELECT person_id, CAST(NULL AS BIGINT) AS visit_occurrence_id, observation_id, observation_source_value, observation_date,
      observation_datetime, value_as_string, CAST(NULL AS VARCHAR) AS value_source_value, CAST(NULL AS DOUBLE) AS value_as_number,
      CAST(NULL AS BIGINT) AS value_as_concept_id, gmfcs_level FROM level_observations""", "level_observations")
def level_observations(t: Roles) -> DataFrame:
    return longs(t.level_observations, "gmfcs_level")


# --- sinks and reports ------------------------------------------------------


@query("K4 A9", """
    SELECT p.person_id, CAST(coalesce(max(CASE WHEN feature_id = 'phe_101' THEN 1 END), 0) AS BIGINT) AS phe_101,
      CAST(coalesce(max(CASE WHEN feature_id = 'phe_110' THEN 1 END), 0) AS BIGINT) AS phe_110,
      CAST(coalesce(max(CASE WHEN feature_id = 'phe_210' THEN 1 END), 0) AS BIGINT) AS phe_210
    FROM persons p LEFT JOIN cells c ON c.person_id = p.person_id GROUP BY p.person_id""", "persons cells")
def wide_binary_matrix(t: Roles) -> DataFrame:
    wide = sinks.wide_matrix(t.saved.matrix.cells, t.saved.matrix.persons, ["phe_101", "phe_110", "phe_210"])
    return longs(wide, "phe_101", "phe_110", "phe_210")


# --- projections ------------------------------------------------------------


@query("P6 P7 W2 J11 U5 F13", """
    SELECT o_custkey AS "PERSON_ID", o_orderpriority AS "GENDER_SOURCE_VALUE", o_orderstatus AS "GMFCS_M",
      CAST(o_orderkey IS NOT NULL AS BIGINT) AS "DEATH", CAST(o_custkey AS VARCHAR) AS person_id_norm FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_event_without_dates(t: Roles) -> DataFrame:
    events = t.table("orders").select(
        F.col("o_custkey").alias("PERSON_ID"), F.col("o_orderdate").alias("CONDITION_START_DATETIME"),
        F.col("o_orderpriority").alias("GENDER_SOURCE_VALUE"), F.col("o_orderstatus").alias("GMFCS_M"),
        F.col("o_orderdate").alias("DEATH_DATE"), F.col("o_orderdate").alias("BIRTH_DATETIME"), "o_orderkey",
    )
    people = cohort.keep_with_level(cohort.reference_person_metadata(events, "o_orderkey"))
    return longs(cohort.strip_direct_dates(people), "DEATH")


@query("P9", "SELECT * EXCLUDE (phecode_str, phecode_category) FROM (SELECT person_id, source_code, CAST(NULL AS VARCHAR) AS phecode_str, CAST(NULL AS VARCHAR) AS phecode_category FROM diagnoses)", "diagnoses")
def drop_empty_columns(t: Roles) -> DataFrame:
    null = F.lit(None).cast("string")
    rows = t.diagnoses.select("person_id", "source_code", null.alias("phecode_str"), null.alias("phecode_category"))
    return mapping.drop_empty_columns(rows, ["phecode", "phecode_str", "phecode_category"])


@query("P11 P3 P10 J8", """
    SELECT a.person_id, cluster, CAST(gmfcs_level AS VARCHAR) AS gmfcs FROM assignments a JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR)""",
    "assignments cohort")
def assignments_with_levels(t: Roles) -> DataFrame:
    from ..operators.disclosure import join_assignments

    return join_assignments(t.assignments, t.cohort).withColumn("gmfcs", F.col("gmfcs").cast("string"))


# --- filters ----------------------------------------------------------------


@query("F3", """
    SELECT count(DISTINCT person_id) AS cohort_patients_before_filter,
      CAST(count(DISTINCT CASE WHEN num_visits >= 8 AND gmfcs_level IS NOT NULL THEN person_id END) AS BIGINT) AS cohort_patients_after_filter FROM cohort""",
    "cohort")
def eligibility_counts(t: Roles) -> DataFrame:
    return cohort.eligibility_counts(t.cohort, 8, True)


@query("F3 X17", "SELECT CAST(person_id AS VARCHAR) AS person_id FROM cohort WHERE num_visits >= 8 AND gmfcs_level IS NOT NULL", "cohort")
def eligible_persons(t: Roles) -> DataFrame:
    return cohort.eligible_persons(t.cohort, 8, True)


@query("F4 X7 X8", "SELECT person_id, phecode, feature_id FROM events_mapped WHERE feature_id NOT IN ('phe_101', 'phe_110', 'phe_240')", "events_mapped")
def exclude_listed_codes(t: Roles) -> DataFrame:
    rows = features.feature_events(t.build.events, ["101.0", "110", "phe_240"])
    return rows.select("person_id", "phecode", "feature_id")


@query("F5 M1", "SELECT * FROM part_cells", "part_cells")
def prevalent_cells(t: Roles) -> DataFrame:
    return t.part_matrix.cells


@query("F6", """
    SELECT feature_id, count(*) AS n_patients FROM cells GROUP BY feature_id HAVING count(*) < (SELECT count(*) FROM persons)""", "cells persons")
def varying_features(t: Roles) -> DataFrame:
    return features.drop_constant(t.build.matrix)


@query("F7 X11", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS mark FROM orders WHERE regexp_matches(split_part(o_orderpriority, '-', 1), '^[0-9]+$')")
def digit_ids_only(t: Roles) -> DataFrame:
    rows = t.table("orders").select("o_orderkey", F.split("o_orderpriority", "-")[0].alias("mark"))
    return rows.filter(codes.is_all_digits(F.col("mark")))


@query("F8", "SELECT person_id, phecode FROM conditions WHERE phecode IS NOT NULL AND trim(phecode) <> ''", "conditions")
def present_codes(t: Roles) -> DataFrame:
    return t.conditions.filter(codes.is_present_code(F.col("phecode"))).select("person_id", "phecode")


@query("F12 A11", """
    SELECT feature_id, n_patients, cut FROM (SELECT feature_id, count(*) AS n_patients FROM all_part_cells GROUP BY feature_id)
    CROSS JOIN (VALUES ('at_least_35'), ('above_35')) v(cut) WHERE n_patients > 35 OR (n_patients = 35 AND cut = 'at_least_35')""", "all_part_cells")
def prevalence_cuts(t: Roles) -> DataFrame:
    cells = features.binary_cells(t.part_events)
    least = features.prevalence_cut(cells, 35, strict=False).withColumn("cut", F.lit("at_least_35"))
    return least.unionByName(features.prevalence_cut(cells, 35, strict=True).withColumn("cut", F.lit("above_35")))


# --- joins ------------------------------------------------------------------


@query("J3 E2", """
    SELECT person_id, condition_occurrence_id, norm_code, vocabulary_id, phecode FROM mapped""", "mapped")
def join_code_map(t: Roles) -> DataFrame:
    mapped = mapping.join_code_map(t.diagnoses, t.code_map)
    return mapped.select("person_id", "condition_occurrence_id", "norm_code", "vocabulary_id", "phecode")


@query("J4 P5 W10 U2", """
    SELECT m.icd_code, m.norm_code, m.phecode, m.vocabulary_id, coalesce(CASE WHEN m.phecode < '120' THEN m.phecode_str END, d.name) AS phecode_str,
      d.category AS phecode_category
    FROM code_map m LEFT JOIN (SELECT (100 + p_size) || '.0' AS phecode, min(p_name) AS name, min(p_type) AS category FROM part GROUP BY p_size) d
      ON d.phecode = m.phecode""", "code_map")
def code_map_with_definitions(t: Roles) -> DataFrame:
    definitions = mapping.code_definitions(
        t.table("part").select(
            F.concat((100 + F.col("p_size")).cast("string"), F.lit(".0")).alias("Phecode"),
            F.col("p_name").alias("phenotype"), F.col("p_type").alias("category"),
        )
    )
    partial = F.when(F.col("phecode") < "120", F.col("phecode_str")).otherwise("nan")
    raw = t.raw_map.withColumn("phecode_str", partial).drop("phecode_category")
    return mapping.code_map(raw, definitions)


@query("J5 W1", "SELECT * FROM cohort", "cohort")
def cohort_enriched(t: Roles) -> DataFrame:
    keep = [c for c in t.cohort.columns if not c.startswith(("race", "ethnicity", "year", "month", "day_", "birth"))]
    return longs(t.cohort.select(*keep), "gmfcs_level", "death")


@query("J7", """
    SELECT a.person_id, a.cluster, c.num_visits, c.gmfcs_level FROM assignments a LEFT JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR)""",
    "assignments cohort")
def assignments_left_cohort(t: Roles) -> DataFrame:
    side = t.cohort.select(F.col("person_id").cast("string").alias("person_id"), "num_visits", "gmfcs_level")
    return longs(t.assignments.join(side, "person_id", "left"), "gmfcs_level")


@query("J9 A18 M21 T11", """
    WITH x AS (SELECT s.s_suppkey, n.n_regionkey AS cluster, n.n_regionkey AS subtype FROM supplier s JOIN nation n ON s_nationkey = n_nationkey)
    SELECT count(*) AS obs_rows_compared, count(*) AS obs_cluster_match, count(*) AS obs_subtype_match, count(*) AS crosswalk_rows,
      count(DISTINCT s_suppkey) AS crosswalk_unique_ids, count(DISTINCT s_nationkey) AS unique_subclusters,
      (SELECT count(*) FROM x JOIN customer ON c_custkey = s_suppkey) AS demo_rows_compared,
      (SELECT count(*) FROM x JOIN customer ON c_custkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = cluster) AS demo_subtype_match,
      (SELECT count(*) FROM x JOIN customer ON c_custkey = s_suppkey) AS published_rows_compared, CAST(1.0 AS DOUBLE) AS ari_cluster_vs_subtype
    FROM supplier""")
def label_audit(t: Roles) -> DataFrame:
    nation = t.table("nation", "n_nationkey", "n_regionkey")
    region = F.col("n_regionkey").cast("string")
    own = t.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("person_id"), region.alias("cluster"),
        region.alias("subtype"), "s_nationkey", "s_suppkey",
    )
    crosswalk = own.select(F.col("person_id").alias("object_id"), F.col("s_suppkey").alias("numeric_id"), F.col("s_nationkey").alias("subcluster"))
    demo = t.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person_id"), region.alias("subtype"), region.alias("cluster")
    )
    rows = audit.reconcile_labels(own, own, crosswalk, demo, demo)
    return rounded(audit.label_audit(rows), "ari_cluster_vs_subtype")


@query("J10", """
    SELECT l_orderkey, CAST(o_custkey AS VARCHAR) AS person_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def translate_ids(t: Roles) -> DataFrame:
    rows = t.table("lineitem", "l_orderkey").withColumn("person_id", F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")))
    return audit.translate_ids(rows, t.table("orders", "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query("J10", """
    SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids, CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS missing_rows,
      CAST(count(DISTINCT l_orderkey) FILTER (o_orderkey IS NULL) AS BIGINT) AS missing_ids
    FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""")
def untranslated_ids(t: Roles) -> DataFrame:
    """A crosswalk of the finished orders only, so ids of the others have no entry."""
    finished = t.table("orders", "o_orderkey", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    rows = t.table("lineitem", "l_orderkey").select(F.col("l_orderkey").alias("person_id"))
    return audit.untranslated(rows, finished, "o_orderkey", "o_custkey")


@query("J12 U4", "SELECT c_custkey AS person_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def persons_without_events(t: Roles) -> DataFrame:
    people = t.cohort_table.select("person_id")
    return audit.missing_keys(people, t.observations, "person_id")


@query("J13 U3 W3 T6", """
    SELECT c.cluster, b.baseline_cluster, coalesce(p.n, 0) AS phecode_overlap, coalesce(k.n, 0) AS category_overlap,
      2 * coalesce(p.n, 0) + coalesce(k.n, 0) AS score
    FROM (SELECT DISTINCT cluster FROM ranked) c CROSS JOIN (SELECT DISTINCT baseline_cluster FROM baseline) b
    LEFT JOIN (SELECT cluster, baseline_cluster, count(DISTINCT phecode) AS n FROM ranked JOIN baseline USING (phecode) WHERE rank <= 30 GROUP BY ALL) p
      ON p.cluster = c.cluster AND p.baseline_cluster = b.baseline_cluster
    LEFT JOIN (SELECT cluster, baseline_cluster, count(DISTINCT com_category) AS n FROM ranked r JOIN baseline b2 ON r.phecode_category = b2.com_category
      WHERE rank <= 30 GROUP BY ALL) k ON k.cluster = c.cluster AND k.baseline_cluster = b.baseline_cluster""", "ranked baseline")
def signature_match_scores(t: Roles) -> DataFrame:
    from ..operators.matching import score_matches

    return score_matches(cut_lineage(_enrichment(t)), t.baseline)


@query("J16 A19 T10", """
    WITH a AS (SELECT person_id, feature_id, ln(1 + 10000.0 / count(*) OVER (PARTITION BY person_id)) AS v FROM cells),
      b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS person_id, 'phe_' || (100 + p_size) AS feature_id, 8.0 AS v
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
      p AS (SELECT person_id FROM a INTERSECT SELECT person_id FROM b), f AS (SELECT feature_id FROM a INTERSECT SELECT feature_id FROM b),
      j AS (SELECT coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b
        FROM (SELECT * FROM a WHERE person_id IN (FROM p) AND feature_id IN (FROM f)) x
        FULL JOIN (SELECT * FROM b WHERE person_id IN (FROM p) AND feature_id IN (FROM f)) y ON x.person_id = y.person_id AND x.feature_id = y.feature_id)
    SELECT (SELECT count(*) FROM p) AS common_patients, (SELECT count(*) FROM f) AS common_features,
      CAST(count(*) FILTER (a <> 0) AS BIGINT) AS left_nonzero, CAST(count(*) FILTER (b <> 0) AS BIGINT) AS right_nonzero,
      CAST(count(*) FILTER (a <> b) AS BIGINT) AS cell_differences, round(max(abs(a - b)), 6) AS max_abs_diff,
      round(sum(abs(a - b)) / ((SELECT count(*) FROM p) * (SELECT count(*) FROM f)), 6) AS mean_abs_diff,
      bool_and(abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS all_close FROM j""", "cells")
def matrix_difference(t: Roles) -> DataFrame:
    other = features.binary_cells(
        t.occurrences.join(t.concept, F.col("condition_source_concept_id") == F.col("concept_id")).select(
            "person_id", F.concat(F.lit("phe_"), (100 + F.col("p_size")).cast("string")).alias("feature_id")
        )
    ).withColumn("value", F.lit(8.0))
    found = audit.matrix_difference(features.normalize_log1p(t.saved.matrix.cells), other)
    return rounded(found, "max_abs_diff", "mean_abs_diff")


# --- aggregates -------------------------------------------------------------


@query("A3", """
    SELECT vocabulary_id, count(*) AS rows, count(phecode) AS mapped_rows, count(DISTINCT norm_code) AS unique_codes,
      count(DISTINCT condition_occurrence_id) AS source_rows, round(count(phecode) / count(*), 6) AS mapping_rate FROM mapped GROUP BY vocabulary_id""", "mapped")
def mapping_audit(t: Roles) -> DataFrame:
    mapped = mapping.join_code_map(t.diagnoses, t.code_map)
    return rounded(mapping.mapping_audit(mapped, "condition_occurrence_id"), "mapping_rate")


@query("A4 L2", """
    SELECT vocabulary_id, norm_code, source_code, count(*) AS rows, count(DISTINCT person_id) AS persons FROM mapped
    WHERE phecode IS NULL GROUP BY ALL""", "mapped")
def unmapped_codes(t: Roles) -> DataFrame:
    return mapping.map_events(t.diagnoses, t.code_map).unmapped


@query("A5", """
    SELECT 'premapped_phecode' AS mapping_source, count(*) AS diagnosis_rows, count(p) AS mapped_rows, CAST(count(*) FILTER (p IS NULL) AS BIGINT) AS unmapped_rows,
      count(DISTINCT CASE WHEN p IS NOT NULL THEN person_id END) AS mapped_patients, count(DISTINCT p) AS mapped_phecodes
    FROM (SELECT person_id, nullif(trim(phecode), '') AS p FROM conditions)""", "conditions")
def premapped_audit(t: Roles) -> DataFrame:
    return mapping.premapped_audit(t.conditions)


@query("A6 J7", """
    SELECT cluster, count(DISTINCT a.person_id) AS n_patients, round(count(DISTINCT a.person_id) / sum(count(DISTINCT a.person_id)) OVER (), 6) AS percent,
      round(avg(death), 6) AS death_rate, median(num_visits) AS median_visits, round(avg(CAST(gmfcs_level IS NOT NULL AS INT)), 6) AS gmfcs_available
    FROM assignments a LEFT JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR) GROUP BY cluster""", "assignments cohort")
def cluster_summary(t: Roles) -> DataFrame:
    return rounded(enrichment.cluster_summary(t.assignments, t.cohort), "percent", "death_rate", "gmfcs_available")


@query("A7 W4", """
    SELECT cluster, CAST(gmfcs_level AS VARCHAR) AS gmfcs_level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cluster), 6) AS percent
    FROM assignments a JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR) WHERE gmfcs_level IS NOT NULL GROUP BY cluster, gmfcs_level""", "assignments cohort")
def level_distribution(t: Roles) -> DataFrame:
    return rounded(enrichment.level_distribution(t.assignments, t.cohort), "percent")


@query("A9", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_crosstab(t: Roles) -> DataFrame:
    return labels.contingency(t.table("labels"), "quality", "toxic")


@query("A10", "SELECT gmfcs_level, count(*) AS n FROM level_observations GROUP BY ALL", "level_observations")
def value_counts(t: Roles) -> DataFrame:
    return longs(labels.value_counts(t.level_observations, "gmfcs_level"), "gmfcs_level")


@query("A11 A15", "SELECT feature_id, count(*) AS n_patients FROM (SELECT DISTINCT person_id, feature_id FROM part_events) GROUP BY feature_id", "part_events")
def feature_prevalence(t: Roles) -> DataFrame:
    ones = features.merge_duplicate_features(t.part_events.withColumn("value", F.lit(1)))
    return features.feature_prevalence(features.binarise_cells(ones))


@query("A12", """
    SELECT c.k AS phecode_key, c.phecode_str, c.n AS patient_count, c.k IN (SELECT phecode FROM code_map WHERE phecode < '130') AS in_pivot FROM (
      SELECT phecode AS k, phecode_str, count(DISTINCT person_id) AS n FROM mapped WHERE phecode IS NOT NULL GROUP BY ALL) c""", "mapped code_map")
def code_prevalence_audit(t: Roles) -> DataFrame:
    return audit.code_prevalence(mapping.map_events(t.diagnoses, t.code_map).events, _low_codes(t))


@query("A12 T12", """
    SELECT count(*) AS unique_codes, min(n) FILTER (i) AS present_min_patient_count, CAST(count(*) FILTER (NOT i) AS BIGINT) AS missing_feature_count,
      CAST(count(*) FILTER (NOT i AND n <= 3) AS BIGINT) AS missing_at_or_below_cut, CAST(count(*) FILTER (NOT i AND n > 3) AS BIGINT) AS missing_above_cut
    FROM (SELECT phecode, count(DISTINCT person_id) AS n, phecode < '130' AS i FROM mapped WHERE phecode IS NOT NULL GROUP BY phecode, phecode_str)""", "mapped")
def feature_filter_audit(t: Roles) -> DataFrame:
    events = mapping.map_events(t.diagnoses, t.code_map).events
    return audit.filter_audit(audit.code_prevalence(events, _low_codes(t)))


def _low_codes(t: Roles) -> DataFrame:
    return t.code_map.filter(F.col("phecode") < "130").select(F.col("phecode").alias("feature_id"))


@query("A13", """
    SELECT feature_id, round(max(r) - min(r), 6) AS prevalence_range FROM (SELECT feature_id, num_patients / cluster_patients AS r FROM grid) GROUP BY feature_id""", "grid")
def prevalence_range(t: Roles) -> DataFrame:
    return rounded(features.prevalence_range(t.saved.matrix.cells, _labels(t)), "prevalence_range")


@query("A14", """
    WITH g AS (SELECT a.person_id, cluster, gmfcs_level AS level FROM assignments a JOIN cohort c ON a.person_id = CAST(c.person_id AS VARCHAR) WHERE gmfcs_level IS NOT NULL),
      r AS (SELECT feature_id, cluster, level, count(*) AS n FROM part_cells JOIN g USING (person_id) GROUP BY ALL),
      s AS (SELECT cluster, level, count(*) AS size FROM g GROUP BY ALL)
    SELECT feature_id, round(max(n / size), 6) AS max_rate, max(n / size) >= 0.05 AS frequent FROM r JOIN s USING (cluster, level) GROUP BY feature_id""",
    "part_cells assignments cohort")
def subgroup_frequent_features(t: Roles) -> DataFrame:
    side = t.cohort.filter(F.col("gmfcs_level").isNotNull()).select(
        F.col("person_id").cast("string").alias("person_id"), F.col("gmfcs_level").alias("level")
    )
    groups = t.assignments.join(side, "person_id")
    return rounded(features.subgroup_frequent_features(t.part_matrix.cells, groups, ["cluster", "level"]), "max_rate")


@query("A16 E1 S3 S2", """
    SELECT (SELECT count(*) FROM cohort) AS cohort_rows, (SELECT count(gmfcs_level) FROM cohort) AS gmfcs_patients, count(*) AS diagnosis_rows,
      count(DISTINCT person_id) AS diagnosis_patients, count(DISTINCT source_code) AS diagnosis_unique_source_codes,
      (SELECT count(*) FROM visit_summary) AS visit_rows, (SELECT count(*) FROM deaths) AS death_rows,
      (SELECT count(*) FROM level_observations) AS gmfcs_observation_rows, false AS diagnosis_fallback_used FROM diagnoses""",
    "cohort diagnoses visit_summary deaths level_observations")
def extraction_summary(t: Roles) -> DataFrame:
    return extract_summary(extract_all(t.sources))


@query("A16", """
    SELECT count(*) AS event_rows, count(DISTINCT person_id) AS event_patients, count(DISTINCT phecode) AS event_unique_phecodes,
      count(DISTINCT phecode_str) AS event_unique_phecode_str FROM events_mapped""", "events_mapped")
def event_summary(t: Roles) -> DataFrame:
    return audit.event_summary(t.build.events)


@query("A18", "SELECT count(*) AS rows_compared, CAST(count(*) FILTER (quality = toxic) AS BIGINT) AS matches FROM labels")
def label_agreement(t: Roles) -> DataFrame:
    return labels.agreement(t.table("labels"), "quality", "toxic")


@query("A21", "SELECT count(phecode) > 0 AS has_premapped FROM conditions", "conditions")
def any_premapped_code(t: Roles) -> DataFrame:
    return mapping.any_premapped(t.conditions)


# --- windows, sorts, set operations -----------------------------------------


@query("W1", "SELECT * FROM latest_level", "latest_level")
def latest_level(t: Roles) -> DataFrame:
    return longs(cohort.latest_level(t.level_observations), "gmfcs_level")


@query("W5", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS code FROM documents")
def relabel_in_order(t: Roles) -> DataFrame:
    return longs(relabel_sequential(t.table("documents", "doc_id", "source"), "source", "code"), "code")


@query("W6", """
    SELECT doc_id, lang, chr(CAST(64 + r AS INT)) AS letter FROM documents JOIN (
      SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY lang) USING (lang)""")
def letters_by_size(t: Roles) -> DataFrame:
    return letters(t.table("documents", "doc_id", "lang"), "lang")


@query("W10", "SELECT * FROM metadata", "metadata")
def feature_metadata(t: Roles) -> DataFrame:
    return features.feature_metadata(t.build.events)


@query("L3 U1", """
    WITH c AS (SELECT p_partkey, p_retailprice - 1000 AS diff, p_brand FROM part),
      a AS (SELECT * FROM c ORDER BY abs(diff) DESC, p_partkey LIMIT 40), b AS (SELECT * FROM c WHERE p_brand = 'Brand#1' ORDER BY abs(diff) DESC, p_partkey LIMIT 30)
    SELECT DISTINCT p_partkey, round(diff, 4) AS diff FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def largest_differences(t: Roles) -> DataFrame:
    rows = t.table("part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("diff"), "p_brand")
    first = contrast.by_absolute(rows, "diff", "p_partkey").limit(40)
    second = contrast.by_absolute(rows.filter(F.col("p_brand") == "Brand#1"), "diff", "p_partkey").limit(30)
    return contrast.union_distinct(first, second, "p_partkey").select("p_partkey", F.round("diff", 4).alias("diff"))


_SCORE_SQL = """SELECT resolution, n_clusters, silhouette FROM (
    SELECT c_nationkey / 10.0 AS resolution, count(DISTINCT c_mktsegment) + (c_nationkey % 7) AS n_clusters, round(avg(c_acctbal), 6) AS silhouette
    FROM customer GROUP BY c_nationkey)"""


def _scores(t: Roles) -> DataFrame:
    return t.table("customer").groupBy("c_nationkey").agg(
        (F.countDistinct("c_mktsegment") + F.first(F.col("c_nationkey") % 7)).alias("n_clusters"),
        F.round(F.avg("c_acctbal"), 6).alias("silhouette"),
    ).select((F.col("c_nationkey") / 10.0).alias("resolution"), "n_clusters", "silhouette")


@query("L4", f"{_SCORE_SQL} ORDER BY abs(n_clusters - 8), silhouette DESC NULLS LAST, resolution LIMIT 1")
def pick_target_resolution(t: Roles) -> DataFrame:
    return labels.select_target(_scores(t), 8)


@query("L4 F10", f"{_SCORE_SQL} ORDER BY NOT (n_clusters BETWEEN 6 AND 9), silhouette DESC NULLS LAST, resolution LIMIT 1")
def pick_discovery_resolution(t: Roles) -> DataFrame:
    return labels.select_discovery(_scores(t), 6, 9)


@query("L6", """
    SELECT * FROM (SELECT feature_id, count(*) AS n_patients FROM part_cells GROUP BY feature_id ORDER BY n_patients DESC, feature_id LIMIT 100)""", "part_cells")
def top_features_by_prevalence(t: Roles) -> DataFrame:
    return features.top_features(features.feature_prevalence(t.part_matrix.cells), "n_patients", 100)


@query("U2", "SELECT DISTINCT person_id, source_code FROM diagnoses", "diagnoses")
def distinct_person_codes(t: Roles) -> DataFrame:
    return t.diagnoses.select("person_id", "source_code").distinct()


@query("U5", "SELECT person_id, min(condition_occurrence_id) AS first_position FROM occurrences GROUP BY person_id", "occurrences")
def distinct_in_order(t: Roles) -> DataFrame:
    return labels.distinct_in_order(t.occurrences, "person_id", "condition_occurrence_id")


# --- scalar functions -------------------------------------------------------


@query("X4 X5 X6 X7 X9 X10 X20", """
    SELECT concept_id, upper(replace(concept_code, '.', '')) AS norm_code,
      CASE WHEN concept_code LIKE 'g%' THEN 'ICD10CM' ELSE 'ICD9CM' END AS vocabulary,
      CASE WHEN p_size % 3 = 0 THEN 'ICD9CM' WHEN p_size % 3 = 1 THEN 'ICD10CM' WHEN concept_code LIKE 'g%' THEN 'ICD10CM' ELSE 'ICD9CM' END AS named_vocabulary,
      'phe_' || trim(regexp_replace(regexp_replace(concept_code, '\\.0$', ''), '[^A-Za-z0-9]+', '_', 'g'), '_') AS feature_id,
      regexp_replace(concept_code, '\\.0$', '') AS short_code,
      CASE WHEN concept_code LIKE 'g%' THEN concept_code || '0' ELSE concept_code END AS float_code,
      split_part(domain_id || '_1', '_', 1) AS prefix FROM concept""", "concept")
def code_texts(t: Roles) -> DataFrame:
    code = F.col("concept_code")
    name = F.when(F.col("p_size") % 3 == 0, "icd-9_cm").when(F.col("p_size") % 3 == 1, " ICD10 ").otherwise("other")
    return t.concept.select(
        "concept_id", codes.normalize_icd(code).alias("norm_code"), codes.infer_vocabulary(code).alias("vocabulary"),
        codes.normalize_vocabulary(name, code).alias("named_vocabulary"), codes.make_feature_id(code).alias("feature_id"),
        codes.drop_point_zero(code).alias("short_code"),
        codes.canonical_float_code(F.concat(code, F.lit("0"))).alias("float_code"),
        codes.label_prefix(F.concat("domain_id", F.lit("_1"))).alias("prefix"),
    )


@query("X1 X2", """
    SELECT observation_id, CAST(CASE value_as_string WHEN 'Level I' THEN 1 WHEN 'level-II' THEN 2 WHEN 'III' THEN 3 WHEN '4' THEN 4 WHEN 'Level V' THEN 5 END AS BIGINT) AS level,
      CASE value_as_string WHEN 'Level I' THEN 'I' WHEN 'III' THEN 'III' WHEN '4' THEN 'IV' WHEN 'Level V' THEN 'V' END AS roman FROM observations""", "observations")
def level_texts(t: Roles) -> DataFrame:
    value = F.col("value_as_string")
    return t.observations.select(
        "observation_id", levels.parse_level(value).cast("long").alias("level"), levels.level_to_roman(value).alias("roman")
    )


@query("X3 X19", """
    SELECT c_custkey, CASE WHEN n_regionkey < 5 THEN chr(65 + n_regionkey) ELSE n_regionkey || '' END AS label,
      CASE n_regionkey WHEN 1 THEN 'E' WHEN 4 THEN 'B' ELSE chr(65 + n_regionkey) END AS published FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cluster_texts(t: Roles) -> DataFrame:
    raw = F.concat(F.lit(" "), F.lower("cluster"))
    label = levels.normalize_cluster(raw)
    swapped = {"A": "A", "B": "E", "C": "C", "D": "D", "E": "B"}
    return t.assignments.select(
        F.col("person_id").cast("long").alias("c_custkey"), label.alias("label"), codes.remap_label(label, swapped).alias("published")
    )


@query("X11 X12", "SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS plain, CAST(o_orderkey AS VARCHAR) AS stripped, o_orderkey AS number FROM orders")
def identifier_texts(t: Roles) -> DataFrame:
    text = F.col("o_orderkey").cast("string")
    return t.table("orders").select(
        F.col("o_orderkey").alias("id"), codes.drop_point_zero(F.concat(F.lit(" "), text, F.lit(".0 "))).alias("plain"),
        codes.strip_id_suffix(F.concat(text, F.lit("-ALL"))).alias("stripped"),
        codes.leading_int(F.concat(text, F.lit("-ALL"))).alias("number"),
    )


@query("X13", """
    SELECT p_partkey, concat_ws('|', CASE WHEN x LIKE '%bolt%' THEN 'bolt' END, CASE WHEN x LIKE '%ring%' THEN 'ring' END, CASE WHEN x LIKE '%red%' THEN 'red' END,
      CASE WHEN x LIKE '%brand#1%' THEN 'brand#1' END) AS keywords FROM (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS x FROM part)""")
def keyword_tags(t: Roles) -> DataFrame:
    words = ["bolt", "ring", "red", "brand#1"]
    return t.table("part").select("p_partkey", measures.keyword_tags(F.col("p_name"), F.col("p_brand"), words=words).alias("keywords"))


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in _SALT.encode().ljust(64, b"\0")).hex()


@query("X14", f"""
    SELECT c_custkey, substr(sha256(from_hex('{_pad(0x5C)}') || from_hex(sha256(from_hex('{_pad(0x36)}') || encode(CAST(c_custkey AS VARCHAR))))), 1, 24) AS study_id FROM customer""")
def study_ids(t: Roles) -> DataFrame:
    return t.table("customer").select("c_custkey", identity.study_id(F.col("c_custkey"), _SALT).alias("study_id"))


@query("X15 X16", """
    SELECT c_custkey, CASE WHEN b <> 0 THEN round(a / b, 6) END AS ratio, (b = 0 AND a > 0) AS is_infinite,
      round(CASE WHEN a > 0.01 THEN b / a WHEN b > 0 THEN 99.0 ELSE 0.0 END, 2) AS capped
    FROM (SELECT c_custkey, greatest(c_acctbal, 0) / 100000 AS a, CAST(c_nationkey % 3 AS DOUBLE) / 8 AS b FROM customer)""")
def ratios(t: Roles) -> DataFrame:
    rows = t.table("customer").select(
        "c_custkey", (F.greatest("c_acctbal", F.lit(0)) / 100000).alias("a"), ((F.col("c_nationkey") % 3).cast("double") / 8).alias("b")
    )
    ratio = measures.prevalence_ratio(F.col("a"), F.col("b"))
    infinite = ratio == float("inf")
    return rows.select(
        "c_custkey", F.when(~infinite, r6(ratio)).alias("ratio"), F.coalesce(infinite, F.lit(False)).alias("is_infinite"),
        measures.capped_ratio(F.col("a"), F.col("b")).alias("capped"),
    )


@query("X17", """
    SELECT o_orderkey, coalesce(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), 0.0) AS number,
      coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 0.0) AS fallback FROM orders""")
def numbers_from_text(t: Roles) -> DataFrame:
    return t.table("orders").select(
        "o_orderkey", measures.to_number(F.split("o_orderpriority", "-")[0]).alias("number"),
        measures.to_number(F.col("o_orderpriority")).alias("fallback"),
    )


@query("X18", """
    SELECT o_orderkey, o_orderdate AS parsed, CAST(NULL AS TIMESTAMP) AS failed, CAST(CAST(o_orderdate AS DATE) - DATE '1990-01-01' AS BIGINT) AS days FROM orders""")
def dates_from_text(t: Roles) -> DataFrame:
    return t.table("orders").select(
        "o_orderkey", measures.to_timestamp_or_null(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("parsed"),
        measures.to_timestamp_or_null(F.col("o_orderpriority")).alias("failed"),
        measures.day_span(F.lit("1990-01-01").cast("date"), F.col("o_orderdate")).cast("long").alias("days"),
    )


@query("X21", """
    SELECT p_partkey, p_size || '' AS phecode, coalesce(d.name, '—') AS description FROM part
    LEFT JOIN (SELECT p_size AS k, min(p_name) AS name FROM part WHERE p_size <= 40 GROUP BY p_size) d ON d.k = p_size""")
def code_descriptions(t: Roles) -> DataFrame:
    definitions = t.table("part").filter(F.col("p_size") <= 40).groupBy("p_size").agg(F.min("p_name").alias("phenotype")).select(
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("phecode"), "phenotype"
    )
    rows = t.table("part").select("p_partkey", F.col("p_size").cast("string").alias("phecode"))
    return contrast.describe_codes(rows, definitions).select("p_partkey", "phecode", "description")


@query("X23", """
    SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS cluster_sizes
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def sizes_as_json(t: Roles) -> DataFrame:
    return labels.sizes_json(t.table("documents", "source", "lang"), ["source"], "lang")


def _labels(t: Roles) -> DataFrame:
    return enrichment.labels_of(t.saved.matrix.persons, t.assignments)


def _enrichment(t: Roles) -> DataFrame:
    return enrichment.feature_enrichment(t.saved.matrix.cells, _labels(t), t.saved.metadata)



