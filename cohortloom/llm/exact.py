"""Exact duplicates by recipes of content-defined chunks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A chunk ends behind the first sentence or line end after 256 characters, or after 2048.
CHUNK = r"(?s).{256,2046}?(?:[.!?]\s|\n)|.{1,2048}"


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def chunks(text: Column) -> Column:
    """Consecutive pieces whose concatenation is the text; cuts depend on nearby content only."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _identifier(chunk: Column, ambiguous: list[str]) -> Column:
    short = F.substring(F.sha2(chunk, 256), 1, 32)
    return F.when(short.isin(ambiguous), F.concat(short, chunk)).otherwise(short) if ambiguous else short


def ambiguous_identifiers(docs: DataFrame) -> list[str]:
    """Identifiers that stand for more than one chunk. Each distinct chunk is moved and compared once.

    Two chunks with one 128-bit identifier are not expected in any corpus, so
    the list is empty or tiny; if there are some, recipes hold their text.
    """
    distinct = docs.select(F.explode(chunks(normalised("text"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("uses"))
    named = distinct.groupBy(_identifier(F.col("chunk"), []).alias("id")).agg(F.count("*").alias("texts"))
    return [r["id"] for r in named.where("texts > 1").select("id").collect()]


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_chunks``.

    Texts are equal when identical after lower-casing A-Z; null is the empty
    text, whose recipe is empty. Texts are cut into content-defined chunks, each
    chunk is replaced by an identifier verified against the chunk's text, and
    the ordered lists of identifiers are compared. The largest ``doc_id`` of a
    group stays; rows that repeat this id all count as kept. Rows with a null
    id are kept only in groups without any id. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    ambiguous = ambiguous_identifiers(docs)
    text = normalised("text")
    recipes = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.transform(chunks(text), lambda c: _identifier(c, ambiguous)).alias("recipe"))
    recipes = recipes.withColumn("bucket", F.xxhash64("recipe"))
    groups = recipes.groupBy("bucket", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = recipes.join(groups, ["bucket", "recipe"])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
