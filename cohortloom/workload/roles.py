"""Role tables derived from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import build_cohort
from ..operators.features import FeatureMatrix, build_matrix
from ..operators.mapping import code_map
from ..plans.extraction import Sources
from ..plans.matrix import MatrixBuild, build_feature_matrix, materialise
from ..settings import MatrixSettings
from ..sources.extract import DiagnosisShape, extract_cohort, extract_diagnoses, extract_level_observations
from ..sources.tables import read_table

LEVEL_PATTERN = "c"
MIN_PATIENTS = 30
MATRIX = MatrixSettings(min_patients=4, min_visits=3)


class Roles:
    """Role tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, *columns: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", list(columns) or None)

    @cached_property
    def person(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("PERSON_ID"), F.col("c_name").alias("person_source_value"),
            F.col("c_mktsegment").alias("gender_source_value"),
        )

    @cached_property
    def visits(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
        return self.table("orders").select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("visit_occurrence_id"),
            day.alias("visit_start_date"), F.col("o_orderdate").alias("visit_start_datetime"),
            day.alias("visit_end_date"), F.col("o_orderdate").alias("visit_end_datetime"),
            F.col("o_orderpriority").alias("visit_source_value"), status.cast("long").alias("visit_concept_id"),
        )

    @cached_property
    def concept(self) -> DataFrame:
        letter = F.when(F.col("p_partkey") % 2 == 0, "g").otherwise("")
        code = F.concat(letter, F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
        return self.table("part").select(
            F.col("p_partkey").alias("concept_id"), code.alias("concept_code"), F.col("p_name").alias("concept_name"),
            F.col("p_type").alias("domain_id"), F.lit(None).cast("string").alias("vocabulary_id"), "p_size",
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        """Condition occurrences; open returned items have no source value."""
        lines = self.table("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
        orders = self.table("orders", "o_orderkey", "o_custkey")
        blank = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("person_id"), F.col("l_orderkey").alias("visit_occurrence_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("condition_occurrence_id"),
            F.col("l_partkey").alias("condition_source_concept_id"),
            F.when(~blank, F.concat("l_returnflag", "l_linestatus")).alias("condition_source_value"),
            F.col("l_shipdate").alias("condition_start_datetime"), F.to_date("l_shipdate").alias("condition_start_date"),
        )

    @cached_property
    def conditions(self) -> DataFrame:
        """Pre-coded person conditions with a phecode of their own for most codes."""
        size = F.col("p_size")
        code = F.when(size <= 40, F.concat((100 + size).cast("string"), F.lit(".0"))).when(size == 50, F.lit(" "))
        return self.occurrences.join(
            self.concept, F.col("condition_source_concept_id") == F.col("concept_id")
        ).select(
            "person_id", "visit_occurrence_id", "condition_occurrence_id", "condition_start_datetime",
            F.when(F.col("condition_source_value").isNotNull(), F.col("concept_code")).alias("dx_code_char"),
            F.col("concept_name").alias("dx_name"), F.col("domain_id").alias("dx_category"), code.alias("phecode"),
        )

    @cached_property
    def raw_map(self) -> DataFrame:
        rows = self.concept.filter(F.col("p_size") <= 40).select("concept_code", "p_size").distinct()
        targets = F.when(
            F.col("p_size") % 10 == 0, F.array(100 + F.col("p_size"), 200 + F.col("p_size"))
        ).otherwise(F.array(100 + F.col("p_size")))
        flag = F.when(F.col("concept_code").startswith("g"), "10").otherwise("9")
        return rows.withColumn("target", F.explode(targets)).select(
            F.col("concept_code").alias("ICD"), flag.alias("flag"),
            F.concat(F.col("target").cast("string"), F.lit(".0")).alias("phecode"),
            F.concat(F.lit("condition "), F.col("target").cast("string")).alias("phecode_str"),
            F.concat(F.lit("band "), F.floor(F.col("p_size") / 10).cast("string")).alias("phecode_category"),
        )

    @cached_property
    def code_map(self) -> DataFrame:
        return code_map(self.raw_map)

    @cached_property
    def cohort_table(self) -> DataFrame:
        return self.person.withColumnRenamed("PERSON_ID", "person_id")

    @cached_property
    def diagnoses(self) -> DataFrame:
        """Occurrences coded through the concept dimension."""
        return extract_diagnoses(
            self.occurrences, self.cohort_table, DiagnosisShape.CONDITION_OCCURRENCE, concept=self.concept.drop("p_size")
        )

    @cached_property
    def observations(self) -> DataFrame:
        roman = F.pmod(F.floor("value"), F.lit(7)).cast("long")
        text = F.when(roman == 1, "Level I").when(roman == 2, "level-II").when(roman == 3, "III").when(
            roman == 4, "4"
        ).when(roman == 5, "Level V").otherwise("not assessed")
        return self.table("events", "event_id", "ts", "user_id", "event_type", "value").select(
            F.col("user_id").alias("person_id"), F.col("event_id").alias("observation_id"),
            F.col("event_type").alias("observation_source_value"), F.to_date("ts").alias("observation_date"),
            F.col("ts").alias("observation_datetime"), text.alias("value_as_string"),
        )

    @cached_property
    def level_observations(self) -> DataFrame:
        return extract_level_observations(self.observations, self.cohort_table, LEVEL_PATTERN)

    @cached_property
    def deaths(self) -> DataFrame:
        return self.table("customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("person_id"))

    @cached_property
    def cohort(self) -> DataFrame:
        return build_cohort(extract_cohort(self.cohort_table), self.visits, self.deaths, self.level_observations)

    @cached_property
    def assignments(self) -> DataFrame:
        nation = self.table("nation", "n_nationkey", "n_regionkey")
        return self.table("customer", "c_custkey", "c_nationkey").join(
            nation, F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("c_custkey").cast("string").alias("person_id"), F.char(65 + F.col("n_regionkey")).alias("cluster")
        )

    @cached_property
    def sources(self) -> Sources:
        return Sources(
            self.cohort_table, self.occurrences, self.visits, self.deaths, self.observations, self.concept.drop("p_size"),
            DiagnosisShape.CONDITION_OCCURRENCE, deaths_name="customer", level_pattern=LEVEL_PATTERN,
        )

    @cached_property
    def build(self) -> MatrixBuild:
        return build_feature_matrix(self.diagnoses, self.code_map, MATRIX, self.cohort, premapped=False)

    @cached_property
    def saved(self) -> MatrixBuild:
        """The built matrix as written tables, as one stage hands it to the next."""
        return materialise(self.build)

    @cached_property
    def part_events(self) -> DataFrame:
        """One feature per part: many features of middling prevalence."""
        return self.occurrences.select(
            F.col("person_id").cast("string").alias("person_id"),
            F.concat(F.lit("part_"), F.col("condition_source_concept_id").cast("string")).alias("feature_id"),
        )

    @cached_property
    def part_matrix(self) -> FeatureMatrix:
        return build_matrix(self.part_events, MIN_PATIENTS)

    @cached_property
    def baseline(self) -> DataFrame:
        """Part types as baseline groups with the codes their parts map to."""
        keyed = self.concept.select(F.upper(F.translate("concept_code", ".", "")).alias("norm_code"), "domain_id").distinct()
        return keyed.join(self.code_map, "norm_code").select(
            F.col("domain_id").alias("baseline_cluster"), "phecode", F.col("phecode_category").alias("com_category")
        ).distinct()

    @cached_property
    def points(self) -> DataFrame:
        return self.table("embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("person_id"), "embedding")

    @cached_property
    def point_labels(self) -> DataFrame:
        return self.table("embeddings", "vec_id", "label").select(
            F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")
        )


# The same roles as SQL: name -> (roles it reads, body).
SQL_ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "visits": ((), """
        SELECT o_custkey AS person_id, o_orderkey AS visit_occurrence_id, CAST(o_orderdate AS DATE) AS visit_start_date,
          o_orderdate AS visit_start_datetime, CAST(o_orderdate AS DATE) AS visit_end_date, o_orderdate AS visit_end_datetime,
          o_orderpriority AS visit_source_value,
          CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS visit_concept_id FROM orders"""),
    "concept": ((), """
        SELECT p_partkey AS concept_id, (CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE '' END) || p_size || '.' || (p_partkey % 10) AS concept_code,
          p_name AS concept_name, p_type AS domain_id, p_size FROM part"""),
    "occurrences": ((), """
        SELECT o_custkey AS person_id, l_orderkey AS visit_occurrence_id, l_orderkey * 10 + l_linenumber AS condition_occurrence_id,
          l_partkey AS condition_source_concept_id,
          CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE l_returnflag || l_linestatus END AS condition_source_value,
          l_shipdate AS condition_start_datetime, CAST(l_shipdate AS DATE) AS condition_start_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "conditions": (("occurrences", "concept"), """
        SELECT person_id, visit_occurrence_id, condition_occurrence_id, condition_start_datetime,
          CASE WHEN condition_source_value IS NOT NULL THEN concept_code END AS dx_code_char, concept_name AS dx_name,
          domain_id AS dx_category,
          CASE WHEN p_size <= 40 THEN (100 + p_size) || '.0' WHEN p_size = 50 THEN ' ' END AS phecode
        FROM occurrences JOIN concept ON condition_source_concept_id = concept_id"""),
    "raw_map": (("concept",), """
        SELECT concept_code AS icd, CASE WHEN concept_code LIKE 'g%' THEN '10' ELSE '9' END AS flag, target || '.0' AS phecode,
          'condition ' || target AS phecode_str, 'band ' || (p_size // 10) AS phecode_category
        FROM (SELECT DISTINCT concept_code, p_size, 100 + p_size AS target FROM concept WHERE p_size <= 40
          UNION SELECT DISTINCT concept_code, p_size, 200 + p_size FROM concept WHERE p_size <= 40 AND p_size % 10 = 0)"""),
    "code_map": (("raw_map",), """
        SELECT DISTINCT icd AS icd_code, upper(replace(icd, '.', '')) AS norm_code, phecode,
          CASE flag WHEN '9' THEN 'ICD9CM' ELSE 'ICD10CM' END AS vocabulary_id, phecode_str, phecode_category FROM raw_map"""),
    "diagnoses": (("occurrences", "concept"), """
        SELECT person_id, visit_occurrence_id, condition_occurrence_id, coalesce(concept_code, condition_source_value) AS source_code,
          coalesce(concept_name, condition_source_value) AS source_name, domain_id AS diagnosis_category,
          condition_start_datetime AS diagnosis_datetime, condition_start_date AS diagnosis_date
        FROM occurrences LEFT JOIN concept ON condition_source_concept_id = concept_id WHERE condition_source_value IS NOT NULL"""),
    "coded": (("diagnoses",), """
        SELECT *, upper(replace(source_code, '.', '')) AS norm_code,
          CASE WHEN regexp_matches(source_code, '^[0-9]') THEN 'ICD9CM' ELSE 'ICD10CM' END AS vocabulary_id FROM diagnoses"""),
    "mapped": (("coded", "code_map"), """
        SELECT c.*, m.icd_code, m.phecode, m.phecode_str, m.phecode_category
        FROM coded c LEFT JOIN code_map m ON c.norm_code = m.norm_code AND c.vocabulary_id = m.vocabulary_id"""),
    "observations": ((), """
        SELECT user_id AS person_id, event_id AS observation_id, event_type AS observation_source_value,
          CAST(ts AS DATE) AS observation_date, ts AS observation_datetime,
          CASE CAST(((floor(value) % 7) + 7) % 7 AS BIGINT) WHEN 1 THEN 'Level I' WHEN 2 THEN 'level-II' WHEN 3 THEN 'III'
            WHEN 4 THEN '4' WHEN 5 THEN 'Level V' ELSE 'not assessed' END AS value_as_string FROM events"""),
    "level_observations": (("observations",), """
        SELECT o.*, CAST(CASE value_as_string WHEN 'Level I' THEN 1 WHEN 'level-II' THEN 2 WHEN 'III' THEN 3 WHEN '4' THEN 4
            WHEN 'Level V' THEN 5 END AS BIGINT) AS gmfcs_level
        FROM observations o WHERE upper(observation_source_value) LIKE '%C%' AND person_id IN (SELECT c_custkey FROM customer)"""),
    "latest_level": (("level_observations",), """
        SELECT person_id, gmfcs_level, observation_datetime AS gmfcs_observation_datetime, observation_source_value AS gmfcs_source
        FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY observation_datetime DESC NULLS LAST, observation_id DESC) AS r
          FROM level_observations WHERE gmfcs_level IS NOT NULL) WHERE r = 1"""),
    "deaths": ((), "SELECT c_custkey AS person_id FROM customer WHERE c_acctbal < 0"),
    "visit_summary": (("visits",), """
        SELECT person_id, count(DISTINCT visit_occurrence_id) AS num_visits, min(visit_start_date) AS first_visit_date,
          max(visit_start_date) AS last_visit_date,
          CAST(max(visit_start_date) - min(visit_start_date) AS BIGINT) AS visit_duration_days FROM visits GROUP BY person_id"""),
    "cohort": (("visit_summary", "latest_level", "deaths"), """
        SELECT c_custkey AS person_id, c_name AS person_source_value, c_mktsegment AS gender_source_value,
          coalesce(num_visits, 0) AS num_visits, first_visit_date, last_visit_date, visit_duration_days, gmfcs_level,
          gmfcs_observation_datetime, gmfcs_source, CAST(c_custkey IN (SELECT person_id FROM deaths) AS BIGINT) AS death
        FROM customer LEFT JOIN visit_summary v ON v.person_id = c_custkey LEFT JOIN latest_level l ON l.person_id = c_custkey"""),
    "eligible": (("cohort",), "SELECT DISTINCT CAST(person_id AS VARCHAR) AS person_id FROM cohort WHERE num_visits >= 3"),
    "events_mapped": (("mapped", "eligible"), """
        SELECT CAST(m.person_id AS VARCHAR) AS person_id, phecode, phecode_str, phecode_category, diagnosis_datetime,
          'phe_' || replace(phecode, '.0', '') AS feature_id
        FROM mapped m WHERE phecode IS NOT NULL AND CAST(m.person_id AS VARCHAR) IN (SELECT person_id FROM eligible)"""),
    "all_cells": (("events_mapped",), "SELECT DISTINCT person_id, feature_id FROM events_mapped"),
    "persons": (("all_cells",), "SELECT DISTINCT person_id FROM all_cells"),
    "cells": (("all_cells",), """
        SELECT person_id, feature_id FROM all_cells
        WHERE feature_id IN (SELECT feature_id FROM all_cells GROUP BY feature_id HAVING count(*) >= 4)"""),
    "metadata": (("events_mapped",), """
        SELECT feature_id, m.phecode, m.phecode_str, m.phecode_category FROM (SELECT feature_id,
          min({'phecode': phecode, 'phecode_str': phecode_str, 'phecode_category': phecode_category}) AS m
          FROM events_mapped GROUP BY feature_id)"""),
    "part_events": (("occurrences",), """
        SELECT CAST(person_id AS VARCHAR) AS person_id, 'part_' || condition_source_concept_id AS feature_id FROM occurrences"""),
    "all_part_cells": (("part_events",), "SELECT DISTINCT person_id, feature_id FROM part_events"),
    "part_persons": (("all_part_cells",), "SELECT DISTINCT person_id FROM all_part_cells"),
    "part_cells": (("all_part_cells",), """
        SELECT person_id, feature_id FROM all_part_cells
        WHERE feature_id IN (SELECT feature_id FROM all_part_cells GROUP BY feature_id HAVING count(*) >= 30)"""),
    "assignments": ((), """
        SELECT CAST(c_custkey AS VARCHAR) AS person_id, chr(65 + n_regionkey) AS cluster
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "labels_of": (("assignments", "persons"), "SELECT * FROM assignments WHERE person_id IN (SELECT person_id FROM persons)"),
    "grid": (("labels_of", "cells"), """
        SELECT s.cluster, f.feature_id, s.n AS cluster_patients, coalesce(c.n, 0) AS num_patients, t.n - s.n AS rest_patients,
          f.n - coalesce(c.n, 0) AS rest_num_patients
        FROM (SELECT cluster, count(*) AS n FROM labels_of GROUP BY cluster) s
        CROSS JOIN (SELECT feature_id, count(*) AS n FROM cells GROUP BY feature_id) f
        CROSS JOIN (SELECT count(*) AS n FROM labels_of) t
        LEFT JOIN (SELECT cluster, feature_id, count(*) AS n FROM cells JOIN labels_of USING (person_id) GROUP BY ALL) c
          ON c.cluster = s.cluster AND c.feature_id = f.feature_id"""),
    "tested": (("grid",), """
        SELECT g.*, num_patients / cluster_patients AS cluster_prevalence, rest_num_patients / rest_patients AS rest_prevalence, f.p AS p_value
        FROM grid g JOIN (
          SELECT cluster, feature_id, least(1.0, sum(exp(lp)) FILTER (lp <= lo + ln(1 + 1e-7))) AS p FROM (
            SELECT cluster, feature_id,
              lgamma(n+1)-lgamma(x+1)-lgamma(n-x+1)+lgamma(t-n+1)-lgamma(m-x+1)-lgamma(t-n-m+x+1)-lgamma(t+1)+lgamma(m+1)+lgamma(t-m+1) AS lp,
              lgamma(n+1)-lgamma(a+1)-lgamma(n-a+1)+lgamma(t-n+1)-lgamma(m-a+1)-lgamma(t-n-m+a+1)-lgamma(t+1)+lgamma(m+1)+lgamma(t-m+1) AS lo
            FROM (SELECT cluster, feature_id, num_patients AS a, cluster_patients AS n, num_patients + rest_num_patients AS m,
                cluster_patients + rest_patients AS t,
                unnest(generate_series(greatest(0, cluster_patients + num_patients + rest_num_patients - cluster_patients - rest_patients),
                  least(cluster_patients, num_patients + rest_num_patients))) AS x FROM grid))
          GROUP BY cluster, feature_id) f ON f.cluster = g.cluster AND f.feature_id = g.feature_id"""),
    "adjusted": (("tested",), """
        SELECT cluster, feature_id, least(1.0, min(step) OVER (ORDER BY p_value DESC, step ROWS UNBOUNDED PRECEDING)) AS x FROM (
          SELECT cluster, feature_id, p_value, p_value * count(*) OVER () / count(*) OVER (ORDER BY p_value) AS step FROM tested)"""),
    "enrichment": (("tested", "adjusted", "metadata"), """
        SELECT t.*, CASE WHEN rest_prevalence <> 0 THEN cluster_prevalence / rest_prevalence END AS prevalence_ratio,
          (rest_prevalence = 0 AND cluster_prevalence > 0) AS ratio_is_infinite,
          CASE WHEN cluster_prevalence >= rest_prevalence THEN 'enriched' ELSE 'depleted' END AS direction, a.x AS p_value_fdr,
          m.phecode, m.phecode_str, m.phecode_category
        FROM tested t JOIN adjusted a ON a.cluster = t.cluster AND a.feature_id = t.feature_id LEFT JOIN metadata m ON m.feature_id = t.feature_id"""),
    "baseline": (("concept", "code_map"), """
        SELECT DISTINCT domain_id AS baseline_cluster, phecode, phecode_category AS com_category
        FROM (SELECT DISTINCT upper(replace(concept_code, '.', '')) AS norm_code, domain_id FROM concept) JOIN code_map USING (norm_code)"""),
    "ranked": (("enrichment",), """
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p_value_fdr,
          CASE WHEN ratio_is_infinite THEN 1e308 ELSE prevalence_ratio END DESC NULLS LAST, feature_id) AS rank
        FROM enrichment WHERE direction = 'enriched'"""),
    "points": ((), "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
    "pairs": (("points",), """
        SELECT a.id AS src, b.id AS dst, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS distance
        FROM points a JOIN points b ON a.id <> b.id"""),
    "near": (("pairs",), """
        SELECT src, dst, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 12), dst) AS rank FROM pairs)
        WHERE rank <= 15"""),
}


def with_roles(body: str, *roles: str) -> str:
    """SQL text with the WITH clause of the roles it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in SQL_ROLES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for role in roles:
        add(role)
    # Read more than once: keep them from being computed again at each use.
    parts = [f"{name} AS MATERIALIZED ({SQL_ROLES[name][1].strip()})" for name in ordered]
    text = body.strip()
    if not parts:
        return text
    # A body may bring tables of its own, as "WITH ..." or as ", ...".
    more = "," if text.startswith("WITH ") else ""
    return f"WITH RECURSIVE {', '.join(parts)}{more} {text.removeprefix('WITH ')}"
