"""Cases that the driver's tables do not hold."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.codes import canonical_float_code
from cohortloom.operators.community import letters
from cohortloom.operators.grid import adjust_fdr
from cohortloom.operators import audit
from cohortloom.operators.matching import best_assignment
from cohortloom.sources.tables import file_inventory


def test_missing_p_values_are_no_tests(spark):
    rows = [(1, 0.01), (2, 0.02), (3, None), (4, None)]
    got = {r.k: r.p_value_fdr for r in adjust_fdr(spark.createDataFrame(rows, "k int, p_value double")).collect()}
    assert got == {1: pytest.approx(0.02), 2: pytest.approx(0.02), 3: None, 4: None}


def test_letters_of_any_length(spark):
    count = 26 + 26**2 + 30
    got = {r.label: r.letter for r in letters(spark.range(count).select(F.col("id").alias("label"))).collect()}
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = ["".join(x) for size in (1, 2, 3) for x in itertools.islice(itertools.product(alphabet, repeat=size), count)]
    assert [got[k] for k in range(count)] == names[:count]


def test_float_texts(spark):
    cases = {".5": "0.5", "1e3": "1000.0", "1_000": "1000.0", "-0": "-0.0", "250": "250.0", "250.10": "250.1", "250.0": "250.0", "G80.1": "G80.1", "1__0": "1__0", "e3": "e3"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", canonical_float_code(F.col("v")).alias("c")).collect()
    assert {r.v: r.c for r in got} == cases


def test_assignment_of_many_baselines(spark):
    draw = random.Random(2)
    for clusters, baselines in ((20, 25), (4, 3), (3, 5)):
        table = {(f"c{i:02}", f"b{j:02}"): float(draw.randrange(4)) for i in range(clusters) for j in range(baselines)}
        rows = [(c, b, s) for (c, b), s in table.items()]
        got = best_assignment(spark.createDataFrame(rows, "cluster string, baseline_cluster string, score double")).collect()
        assert len(got) == min(clusters, baselines) == len({r.baseline_cluster for r in got})
        if clusters < 5:
            names, slots = sorted({c for c, _ in table}), [None] * max(0, clusters - baselines) + sorted({b for _, b in table})
            ways = {w for w in itertools.permutations(slots, clusters)}
            best = min(ways, key=lambda w: (-sum(table.get((c, b), 0.0) for c, b in zip(names, w, strict=True)), [b or "" for b in w]))
            assert {r.cluster: r.baseline_cluster for r in got} == {c: b for c, b in zip(names, best, strict=True) if b}


def test_inventory_does_not_match_by_ending(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("xa.csv", "22222")):
        (tmp_path / name).write_text(text)
    wanted = [f"{tmp_path}/a.csv", f"{tmp_path}/none.csv"]
    got = {r.path: (r.size_bytes, r.present) for r in file_inventory(spark, wanted).collect()}
    assert got == {wanted[0]: (1, True), wanted[1]: (None, False)}


def test_missing_ids_are_counted_or_fail(spark):
    rows = spark.createDataFrame([("1.0", 1), ("1", 2), ("2", 3), ("9", 4), (None, 5), ("3", 6)], "person_id string, n int")
    crosswalk = spark.createDataFrame([("1", "a"), ("2.0", "b"), ("3", None)], "old string, new string")
    told = audit.untranslated(rows, crosswalk, "old", "new").first().asDict()
    assert told == {"rows": 6, "ids": 5, "missing_rows": 3, "missing_ids": 3}
    assert {r["n"]: r["person_id"] for r in audit.translate_ids(rows, crosswalk, "old", "new").collect()} == {1: "a", 2: "a", 3: "b", 4: None, 5: None, 6: None}
    assert audit.translate_ids(rows.filter("n < 4"), crosswalk, "old", "new", missing="error").count() == 3
    with pytest.raises(Exception, match="no entry in the crosswalk for id 9"):
        audit.translate_ids(rows.filter("n = 4"), crosswalk, "old", "new", missing="error").collect()
    assert audit.untranslated(rows.limit(0), crosswalk, "old", "new").first().asDict() == {"rows": 0, "ids": 0, "missing_rows": 0, "missing_ids": 0}
