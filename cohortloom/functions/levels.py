"""Ordinal level texts (I-V) and cluster label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import strip

# The five levels, in order.
ROMAN_LEVELS = ["I", "II", "III", "IV", "V"]
# First whole token that names a level.
LEVEL_TOKEN = "(^| )(III|II|IV|I|V|0*[1-5])( |$)"


def parse_level(value: Column) -> Column:
    """First level token anywhere in the text as 1-5, else NULL."""
    text = F.regexp_replace(F.upper(value.cast("string")), "LEVEL", " ")
    tokens = F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))
    token = F.regexp_replace(F.regexp_extract(tokens, LEVEL_TOKEN, 2), "^0+", "")
    result = F.when(token.rlike("^[1-5]$"), token.try_cast("int"))
    for number, roman in enumerate(ROMAN_LEVELS, start=1):
        result = result.when(token == roman, F.lit(number))
    return result


def level_to_roman(value: Column) -> Column:
    """Roman level when the whole text is a level, else NULL."""
    text = F.upper(strip(value))
    text = strip(F.regexp_replace(F.regexp_replace(text, "LEVEL", ""), "GMFCS", ""))
    result = F.when(text.isin(ROMAN_LEVELS), text)
    for number, roman in enumerate(ROMAN_LEVELS, start=1):
        result = result.when(text == str(number), F.lit(roman))
    return result


def normalize_cluster(value: Column) -> Column:
    """Trimmed label; a single letter a-e becomes upper case."""
    text = strip(value)
    return F.when(text.rlike("^[a-eA-E]$"), F.upper(text)).otherwise(text)
