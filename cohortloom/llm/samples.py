"""Bounded training samples and held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def held_out(doc_id: str, folds: int, remainder: int) -> Column:
    """A null id is in no fold: never held out, and never learned from."""
    return F.coalesce(fold(doc_id, folds) == remainder, F.lit(False))


def drawn(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows and rarely less, if there are as many: those whose id hashes below a share of all hashes.

    The share comes from a count, so no task returns more than its part.
    """
    count = rows.count()
    share = 1.0 if count <= limit else min(1.0, (limit + 6 * limit**0.5 + 10) / count)
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, remainder: int = 0) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class 0 and 1, by hash order of the id, without the held-out fold."""
    usable = labels.where((fold("doc_id", folds) != remainder) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    order = [F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.col("doc_id")]
    picked = [drawn(usable.where(F.col("y") == y), per_class).orderBy(*order).limit(per_class) for y in (0, 1)]
    # At most 2 x per_class ids, so this side may be broadcast.
    chosen = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").orderBy(*order, "y").limit(2 * per_class).collect()
    return [(r["text"] or "", r["y"]) for r in rows]
