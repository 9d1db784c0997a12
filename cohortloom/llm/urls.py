"""URL verdicts by a cascade of Bloom filters with exact answers over the corpus's keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import LOWER, UPPER
from .scratch import Scratch
from .words import mix

#: (verdict, host and path prefix): fixed values.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

BITS_PER_KEY, PROBES = 12, 4
#: A cascade is broadcast; beyond this size building stops with an error.
MAX_BYTES = 1 << 30


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


@dataclass(frozen=True)
class Level:
    """One Bloom filter; ``words`` are its 64-bit words."""

    salt: int
    words: np.ndarray

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Bit numbers, one row per probe."""
        start = mix(h1.view(np.uint64) + np.uint64(self.salt))
        stride = mix(h2.view(np.uint64) + np.uint64(self.salt)) | np.uint64(1)
        return np.stack([(start + np.uint64(k) * stride) % np.uint64(64 * len(self.words)) for k in range(PROBES)])

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


class Cascade:
    """Level 1 holds the listed keys, level 2 the other keys that pass level 1, level 3 the listed ones that pass level 2, and so on.

    A key of the universe is listed if the first level that it fails has an
    even number, or if it passes all levels and the last one is odd.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for number, level in enumerate(self.levels, 1):
            passed = level.has(h1, h2)
            out[open_ & ~passed] = number % 2 == 0
            open_ &= passed
        out[open_] = len(self.levels) % 2 == 1
        return out


def _set_bits(level: Level):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = np.unique(level.places(batch.column("h1").to_numpy(), batch.column("h2").to_numpy()))
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    return run


def _passing(cascade_levels, last: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = cascade_levels.value[last]
        for batch in source:
            yield batch.filter(pa.array(level.has(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())))

    return run


def build_cascade(universe: DataFrame, listed: DataFrame, scratch: Scratch) -> Cascade:
    """``universe`` and ``listed``: a string column ``key``. ``listed`` has each key once.

    The bits of a level are OR-ed by a Spark aggregation and only the finished
    filter reaches the driver: about 12 bits for each listed key and a fraction
    of that for each further level. Keys are told apart by two 64-bit hashes.
    """
    context = universe.sparkSession.sparkContext
    schema = "key string, h1 long, h2 long"
    inside = scratch.keep(listed.select("key", *_hashes(F.col("key"))))
    outside = universe.select("key", *_hashes(F.col("key")))
    levels: list[Level] = []
    pending, other = inside, outside
    count = inside.count()
    first_pass = True
    while count:
        words = max(1, -(-count * BITS_PER_KEY // 64))
        if 8 * (words + sum(len(x.words) for x in levels)) > MAX_BYTES:
            raise ValueError("the filter cascade would exceed its broadcast bound; split the list by a hash of the key")
        level = Level(len(levels) + 1, np.zeros(words, np.uint64))
        # The copy without its own words: executors need only the size.
        bits = pending.select("h1", "h2").mapInArrow(_set_bits(level), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        filled = np.zeros(words, np.uint64)
        filled[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
        levels.append(Level(level.salt, filled))
        sent = context.broadcast(levels)
        wrong = other.mapInArrow(_passing(sent, len(levels) - 1), schema)
        if first_pass:
            wrong = wrong.distinct().join(inside.select("key"), "key", "left_anti")
            first_pass = False
        wrong = scratch.keep(wrong)
        pending, other = wrong, pending
        count = pending.count()
    return Cascade(levels)


def _longest_listed(cascade):
    """The longest listed key of each page, or null."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, h1, h2 = (batch.column(c) for c in ("keys", "h1", "h2"))
            row = texts.value_parent_indices().to_numpy()
            hit = np.flatnonzero(cascade.value.has(h1.flatten().to_numpy(), h2.flatten().to_numpy()))
            rule: list[str | None] = [None] * batch.num_rows
            for k, text in zip(row[hit].tolist(), texts.flatten().take(pa.array(hit)).to_pylist(), strict=True):
                if rule[k] is None or len(text) > len(rule[k]):
                    rule[k] = text
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string())], names=["page_id", "host", "path", "rule"])

    return run


def _member(cascade):
    @F.pandas_udf("boolean")
    def has(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(cascade.value.has(h1.to_numpy(), h2.to_numpy()))

    return has


def host_suffixes(host: Column) -> Column:
    """``a.b.c``, ``b.c``, ``c``; for the empty host only itself."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule text that could fit: host suffix and path prefix of each length that rules have."""
    return F.flatten(F.transform(host_suffixes(host), lambda s: F.filter(F.array(*[F.when(F.length(path) >= n, F.concat(s, F.substring(path, 1, n))) for n in lengths]), lambda k: k.isNotNull())))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, scratch: Scratch | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``host_listed``.

    A rule fits its host and subdomains if the path starts with the rule's
    path; the longest wins (``rules`` has no text twice). The hosts that have a
    page blocked by a rule are listed. A page without a rule is blocked if its
    host is listed, else allowed. Rule texts and listed hosts are both looked
    up in filter cascades over all keys that the pages have, without joins. A
    null url, or one without ``://``, has empty host and path and fits no rule.
    Repeated rows are judged one by one; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark)
    verdict_of = {text: verdict for verdict, text in rules}
    lengths = sorted({len(text) - text.index("/") for text in verdict_of})
    parts = scratch.keep(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    rule_list = spark.createDataFrame([(text,) for text in verdict_of], "key string") if rules else spark.createDataFrame([], "key string")
    by_rule = spark.sparkContext.broadcast(build_cascade(parts.select(F.explode(keys).alias("key")), rule_list, scratch))
    asked = parts.withColumn("keys", keys).select("*", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit("second"), k)).alias("h2"))
    schema = f"page_id {parts.schema['page_id'].dataType.simpleString()}, host string, path string, rule string"
    judged = scratch.keep(asked.mapInArrow(_longest_listed(by_rule), schema))
    ruling = F.create_map(*[F.lit(x) for text, verdict in verdict_of.items() for x in (text, verdict)])[F.col("rule")] if rules else F.lit(None).cast("string")
    blocked = judged.where(ruling == "block").select(F.col("host").alias("key")).distinct()
    by_host = spark.sparkContext.broadcast(build_cascade(judged.select(F.col("host").alias("key")), blocked, scratch))
    listed = _member(by_host)(*_hashes(F.col("host")))
    return judged.withColumn("host_listed", listed).select("page_id", "host", "path", "rule", F.coalesce(ruling, F.when(F.col("host_listed"), "block").otherwise("allow")).alias("verdict"), "host_listed")
