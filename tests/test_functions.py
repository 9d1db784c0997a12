import hashlib
import hmac
from fractions import Fraction
from math import comb

import numpy as np
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.functions import codes, identity, levels, measures
from cohortloom.functions.fisher import two_sided


def values(spark, expression, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_parse_level(spark):
    texts = ["Level IV", "gmfcs 3", "05", "2.5", "walks, I think", "vi", "", None, "no level", "LEVEL-II b", "9 1"]
    assert values(spark, levels.parse_level, texts) == [4, 3, 5, 2, 1, None, None, None, None, 2, 1]


def test_level_to_roman_needs_the_whole_text(spark):
    texts = ["gmfcs level ii", "2", "2.0", "Level II - walks", None, " v "]
    assert values(spark, levels.level_to_roman, texts) == ["II", "II", None, None, None, "V"]


def test_normalize_cluster(spark):
    assert values(spark, levels.normalize_cluster, [" a ", "E", "f", "10", None]) == ["A", "E", "f", "10", None]


def test_icd_and_vocabulary(spark):
    assert values(spark, codes.normalize_icd, [" g80.0 ", "343 .9", None]) == ["G800", "3439", ""]
    assert values(spark, codes.infer_vocabulary, ["g80", "343.9", "V10", "", "-", None]) == [
        "ICD10CM", "ICD9CM", "ICD10CM", None, None, None,
    ]
    assert values(spark, lambda c: codes.normalize_vocabulary(c, F.lit("G80")), ["icd-9-cm", "10", "x", None]) == [
        "ICD9CM", "ICD10CM", "ICD10CM", "ICD10CM",
    ]


def test_code_texts(spark):
    assert values(spark, codes.make_feature_id, ["343.0", " 250.10", "a--b.", None]) == ["phe_343", "phe_250_10", "phe_a_b", None]
    assert values(spark, codes.drop_point_zero, ["12.0", " 7 ", "1.00"]) == ["12", "7", "1.00"]
    assert values(spark, codes.canonical_float_code, ["250", "250.10", "250.0", "abc", "1.5", "007"]) == [
        "250.0", "250.1", "250.0", "abc", "1.5", "7.0",
    ]
    assert values(spark, codes.strip_id_suffix, ["12-ALL", "12.0", "x"]) == ["12", "12", "x"]
    assert values(spark, codes.leading_int, ["12-ALL", "7", "x-1"]) == [12, 7, None]


def test_matches_code_in_any_spelling(spark):
    hit = values(spark, lambda c: codes.matches_code(c, ["343.0", "phe_401"]), ["343", "343.0", "phe_343", "401", "343.1", "401.0"])
    assert hit == [True, True, True, True, False, True]


def test_study_id_equals_hmac(spark):
    for salt in ("short", "x" * 100):
        want = [hmac.new(salt.encode(), t.encode(), hashlib.sha256).hexdigest()[:24] for t in ("1", "abc", "ü")]
        assert values(spark, lambda c, s=salt: identity.study_id(c, s), ["1", "abc", "ü"]) == want
    assert values(spark, lambda c: identity.study_id(c, None), ["1"]) == [None]


def test_ratios_and_numbers(spark):
    rows = spark.createDataFrame([(0.5, 0.25), (0.5, 0.0), (0.0, 0.0), (0.0, 0.5)], "a double, b double")
    got = [r[0] for r in rows.select(measures.prevalence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [2.0, float("inf"), None, 0.0]
    got = [r[0] for r in rows.select(measures.capped_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.0, 0.0, 99.0]
    assert values(spark, measures.to_number, ["3", "x", None, "NaN", " 2.5 "]) == [3.0, 0.0, 0.0, 0.0, 2.5]


def test_tags_and_binary(spark):
    assert values(spark, measures.keyword_tags, ["Hemiplegia of JOINT", "none", "spasticity pain"]) == [
        "joint|hemiplegia|plegia", "", "pain|spasticity",
    ]
    rows = spark.createDataFrame([(2.0,), (0.0,), (None,), (-1.0,)], "v double")
    assert [r[0] for r in rows.select(measures.binarise(F.col("v"))).collect()] == [1, 0, 0, 0]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fisher_equals_rational_arithmetic(data):
    total = data.draw(st.integers(1, 80))
    drawn, marked = data.draw(st.integers(0, total)), data.draw(st.integers(0, total))
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    hits = data.draw(st.integers(low, high))
    ways = [comb(drawn, x) * comb(total - drawn, marked - x) for x in range(low, high + 1)]
    exact = Fraction(sum(w for w in ways if w <= ways[hits - low]), comb(total, marked))
    got = two_sided(np.array([hits]), np.array([drawn]), np.array([marked]), np.array([total]))[0]
    assert got == pytest.approx(float(exact), rel=1e-9)


@pytest.mark.parametrize(("hits", "drawn", "marked", "total"), [(30, 300, 6_000_000, 10**8), (170, 300, 5 * 10**7, 10**8), (0, 250, 10**6, 10**8), (299, 300, 99_000_000, 10**8), (12, 400, 400, 10**8), (7, 20, 9, 29)])
def test_fisher_of_large_totals_equals_integers(hits, drawn, marked, total):
    """The same sum over exact integer counts of tables."""
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    ways = {low: math.comb(marked, low) * math.comb(total - marked, drawn - low)}
    for x in range(low, high):
        ways[x + 1] = ways[x] * (marked - x) * (drawn - x) // ((x + 1) * (total - marked - drawn + x + 1))
    # No likelier than the observed table, ties included.
    rare = sum(w for w in ways.values() if w * 10**7 <= ways[hits] * (10**7 + 1))
    want = rare * 10**400 // math.comb(total, drawn)
    got = two_sided([hits], [drawn], [marked], [total])[0]
    assert math.log(got) == pytest.approx(math.log(want) - 400 * math.log(10), abs=1e-9)
