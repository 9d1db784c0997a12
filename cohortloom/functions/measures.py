"""Ratios, coercions and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that tag a feature description.
TAG_WORDS = [
    "pain", "joint", "contracture", "hemiplegia", "speech", "language", "spasticity",
    "unilateral", "plegia", "paresis", "stiffness", "dysphagia", "aspiration",
]


def prevalence_ratio(inside: Column, outside: Column) -> Column:
    """inside / outside; infinite when only ``outside`` is 0, NULL when undefined."""
    return F.when((outside == 0) & (inside > 0), F.lit(float("inf"))).when(outside != 0, F.try_divide(inside, outside))


def capped_ratio(base: Column, other: Column) -> Column:
    """other / base when base > 0.01, else 99 or 0; two decimals."""
    value = F.when(base > 0.01, F.try_divide(other, base)).when(other > 0, F.lit(99.0)).otherwise(F.lit(0.0))
    return F.round(value, 2)


def to_number(value: Column, default: float = 0.0) -> Column:
    """Number in the text, or the default when there is none."""
    number = value.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(default))


def to_timestamp_or_null(value: Column) -> Column:
    return value.cast("string").try_cast("timestamp_ntz")


def day_span(first: Column, last: Column) -> Column:
    """Whole days from ``first`` to ``last``."""
    return F.datediff(last, first)


def binarise(value: Column) -> Column:
    return F.coalesce((value > 0).cast("int"), F.lit(0))


def keyword_tags(*texts: Column, words: list[str] = TAG_WORDS) -> Column:
    """Listed words found in the texts, in list order, joined by ``|``."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.concat_ws("|", *[F.when(F.contains(text, F.lit(word)), F.lit(word)) for word in words])


def size_map_json(keys_and_counts: Column) -> Column:
    """JSON object text from an array of (key, count) structs."""
    return F.to_json(F.map_from_entries(keys_and_counts))
