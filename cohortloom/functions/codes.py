"""Code, vocabulary and identifier clean-up as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the two code systems.
ICD9_NAMES = ["9", "ICD9", "ICD9CM", "ICD9DX"]
ICD10_NAMES = ["10", "ICD10", "ICD10CM", "ICD10DX"]
# Texts that stand for a missing code.
BLANK_CODES = ["", "nan", "None", "NaN"]


# Characters that count as white space at the ends of a text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(value.cast("string"), F.lit(WHITE_SPACE))


def clean_scalar(value: Column) -> Column:
    return F.coalesce(strip(value), F.lit(""))


def blank_to_null(value: Column) -> Column:
    text = strip(value)
    return F.when(~text.isin("", "nan"), text)


def is_present_code(value: Column) -> Column:
    """True for codes that are neither NULL nor one of the blank spellings."""
    return value.isNotNull() & ~strip(value).isin(BLANK_CODES)


def normalize_icd(value: Column) -> Column:
    return F.translate(F.upper(clean_scalar(value)), ". ", "")


def vocabulary_of(norm_code: Column) -> Column:
    """Code system by the first character of a normalised code: digit or letter."""
    first = F.substring(norm_code, 1, 1)
    # The plain ranges decide nearly every code; the patterns are for other alphabets.
    return (
        F.when(first.between("0", "9"), F.lit("ICD9CM"))
        .when(first.between("A", "Z"), F.lit("ICD10CM"))
        .when(first.rlike(r"^\p{Nd}"), F.lit("ICD9CM"))
        .when(first.rlike(r"^\p{L}"), F.lit("ICD10CM"))
    )


def infer_vocabulary(value: Column) -> Column:
    return vocabulary_of(normalize_icd(value))


def named_vocabulary(value: Column) -> Column:
    text = F.translate(F.upper(clean_scalar(value)), "-_", "")
    return F.when(text.isin(ICD9_NAMES), F.lit("ICD9CM")).when(text.isin(ICD10_NAMES), F.lit("ICD10CM"))


def normalize_vocabulary(value: Column, code: Column | None = None) -> Column:
    named = named_vocabulary(value)
    return named if code is None else F.coalesce(named, infer_vocabulary(code))


def drop_point_zero(value: Column) -> Column:
    """Trimmed text without a trailing ``.0``; used for codes and for identifiers."""
    text = strip(value)
    return F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def make_feature_id(code: Column, prefix: str = "phe_") -> Column:
    joined = F.regexp_replace(drop_point_zero(code), "[^A-Za-z0-9]+", "_")
    return F.concat(F.lit(prefix), F.btrim(joined, F.lit("_")))


def _feature_id_text(code: str, prefix: str) -> str:
    joined = re.sub("[^A-Za-z0-9]+", "_", re.sub(r"\.0$", "", code.strip()))
    return prefix + joined.strip("_")


def code_spellings(codes: Iterable[object], prefix: str = "phe_") -> list[str]:
    """Every spelling under which a listed code may be written."""
    spellings: set[str] = set()
    for code in codes:
        raw = str(code).strip()
        spellings |= {raw, raw.removesuffix(".0"), _feature_id_text(raw, prefix)}
    return sorted(spellings)


def matches_code(
    value: Column, codes: Iterable[object], prefix: str = "phe_", feature_id: Column | None = None
) -> Column:
    spellings = code_spellings(codes, prefix)
    if not spellings:
        return F.lit(False)
    own = make_feature_id(value, prefix) if feature_id is None else feature_id
    return strip(value).isin(spellings) | drop_point_zero(value).isin(spellings) | own.isin(spellings)


def canonical_float_code(value: Column) -> Column:
    """Decimal text of a numeric code: ``250`` -> ``250.0``, ``.5`` -> ``0.5``, ``1e3`` -> ``1000.0``, ``-0`` -> ``-0.0``; other text unchanged.

    Digits may be grouped by single underscores. Codes of over 25 digits or 10 decimals are no codes and stay as they are.
    """
    text = strip(value)
    bare = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    scientific = bare.rlike(r"^[+-]?([0-9]{1,15}\.?[0-9]{0,10}|\.[0-9]{1,10})[eE][+-]?[0-9]{1,2}$")
    number = F.when(scientific, bare.try_cast("double").try_cast("decimal(38,10)")).otherwise(bare.try_cast("decimal(38,10)")).cast("string")
    short = F.regexp_replace(number, "0+$", "")
    plain = F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)
    return (
        F.when(text.endswith(".0") & (text == bare) & text.rlike("^[^.]"), text)
        .when(bare.rlike(r"^-0+(\.0*)?$"), F.lit("-0.0"))
        .when((scientific | bare.rlike(r"^[+-]?([0-9]{1,25}(\.[0-9]{0,10})?|\.[0-9]{1,10})$")) & plain.isNotNull(), plain)
        .otherwise(text)
    )


def strip_id_suffix(value: Column) -> Column:
    text = drop_point_zero(value)
    return F.when(text.endswith("-ALL"), F.substring(text, F.lit(1), F.length(text) - 4)).otherwise(text)


def leading_int(value: Column) -> Column:
    """Number before the first dash, as a long."""
    return F.split(strip(value), "-")[0].try_cast("long")


def label_prefix(value: Column) -> Column:
    """``A_1`` -> ``A``."""
    return F.split(value.cast("string"), "_")[0]


def remap_label(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace labels by a dictionary; labels not listed stay as they are."""
    if not mapping:
        return value
    pairs = [F.lit(text) for item in mapping.items() for text in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def is_all_digits(value: Column) -> Column:
    return drop_point_zero(value).rlike("^[0-9]+$")


def contains_ignore_case(value: Column, pattern: str) -> Column:
    return F.upper(value).contains(pattern.upper())
