"""Hard negatives by exact search over rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Rows whose id is divisible by it ask.
ASKING = 100
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score between which a negative's score lies.
LEAST, MOST = 30, 90
#: Bytes of the anchors that are sent out for one pass.
PASS_BYTES = 32 << 20
#: One row of so many, drawn by hash, is searched first; it only bounds what the others must reach.
FIRST = 16
#: Bits of a component of a rotated anchor; anchors and rows that meet at once.
PLANES = 4
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 256, 2048
#: Share of pairs left from which a block is scored whole.
DENSE = 0.1

_FOUND = "anchor int, positive int, score long, vec_id long"


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(23).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def codes(rotated: np.ndarray) -> np.ndarray:
    """The signs of each row, 64 to a word."""
    signs = np.packbits(rotated >= 0, axis=1, bitorder="little")
    spare = -signs.shape[1] % 8
    return np.ascontiguousarray(np.pad(signs, ((0, 0), (0, spare)))).view(np.uint64)


def alignment(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row, and the cosine between the row and its code."""
    length = np.linalg.norm(rotated, axis=1)
    near = np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])
    return length, np.divide(near, length, out=np.zeros_like(near), where=length > 0)


@dataclass(frozen=True)
class Anchors:
    """Anchors of a pass, and what is known of them before: the least score that still counts for each of their lists.

    ``limits`` has one column while positives are looked for; then one for each
    positive, with the window of scores in ``low`` and ``high``.
    """

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    width: int
    limits: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @property
    def wanted(self) -> int:
        return POSITIVES if self.low is None else NEGATIVES


class Planes:
    """Rotated anchors in ``PLANES`` bits a component, so that popcounts give their products with codes."""

    def __init__(self, rotated: np.ndarray):
        self.length = np.linalg.norm(rotated, axis=1)
        self.base = rotated.min(axis=1) if rotated.shape[1] else np.zeros(len(rotated))
        top = rotated.max(axis=1) if rotated.shape[1] else np.zeros(len(rotated))
        self.step = np.maximum((top - self.base) / (2**PLANES - 1), 1e-12)
        level = np.rint((rotated - self.base[:, None]) / self.step[:, None]).astype(np.uint8)
        self.bits = [codes(np.where(level >> k & 1, 1.0, -1.0)) for k in range(PLANES)]
        kept = self.base[:, None] + self.step[:, None] * level
        self.total = kept.sum(axis=1)
        self.lost = np.linalg.norm(rotated - kept, axis=1)
        self.width = rotated.shape[1]

    def bounds(self, own: slice, code: np.ndarray, ones: np.ndarray, length: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with each row that the row's code, length and alignment allow.

        With s the product of anchor and unit code, the rest of the anchor has
        the length sqrt(|q|^2 - s^2), and Cauchy-Schwarz bounds its product with
        the rest of the row. s itself is known up to what the planes lost.
        """
        hits = np.zeros((len(self.length[own]), len(code)), np.float64)
        for k in range(PLANES):
            for word in range(code.shape[1]):
                hits += np.bitwise_count(self.bits[k][own, word, None] & code[None, :, word]) * float(1 << k)
        s = (2 * (self.base[own, None] * ones + self.step[own, None] * hits) - self.total[own, None]) / np.sqrt(max(self.width, 1))
        reach, q = self.lost[own, None], self.length[own, None]
        rest = np.sqrt(np.maximum(1 - near * near, 0))
        # Both bounds are extreme where s is nearest to the row's own direction, or to its opposite.
        up = np.clip(np.clip(near * q, s - reach, s + reach), -q, q)
        down = np.clip(np.clip(-near * q, s - reach, s + reach), -q, q)
        high = length * (near * up + rest * np.sqrt(np.maximum(q * q - up * up, 0)))
        low = length * (near * down - rest * np.sqrt(np.maximum(q * q - down * down, 0)))
        slack = 0.5 + 1e-6 * q * length
        return low - slack, high + slack


def _best(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` entries of each key: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, keys))
    sorted_keys = keys[order]
    begin = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(order)])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < count]


class Search:
    """Lists of one task: the best entries so far of every anchor (and positive), and the scores that others must reach."""

    def __init__(self, anchors: Anchors, turn: np.ndarray):
        self.anchors, self.planes = anchors, Planes(anchors.values.astype(float) @ turn)
        self.limits = anchors.limits.copy()
        self.lists = self.limits.shape[1]
        self.keys, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.largest = np.abs(anchors.values).sum(axis=1).max(initial=0)

    def meet(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, code: np.ndarray, length: np.ndarray, near: np.ndarray) -> None:
        a = self.anchors
        ones = np.bitwise_count(code).sum(axis=1).astype(float)
        # Sums below 2^53 are exact as doubles.
        exact = float(self.largest) * float(np.abs(values).max(initial=0)) < 2**53
        found = []
        for begin in range(0, len(a.ids), ANCHORS_AT_ONCE):
            own = slice(begin, begin + ANCHORS_AT_ONCE)
            low, high = self.planes.bounds(own, code, ones, length, near)
            same = a.labels[own, None] == labels
            if a.low is None:
                open_ = same & (a.ids[own, None] != ids) & (high >= self.limits[own])
            else:
                open_ = ~same & (a.ids[own, None] != ids) & (high >= np.maximum(a.low[own], self.limits[own]).min(axis=1)[:, None]) & (low <= a.high[own].max(axis=1)[:, None])
            i, j = np.nonzero(open_)
            if not len(i):
                continue
            if exact and len(i) > DENSE * open_.size:
                score = (a.values[own].astype(float) @ values.T.astype(float))[i, j].astype(np.int64)
            else:
                score = np.concatenate([(a.values[own][i[k : k + 65536]] * values[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)])
            found.append((i + begin, score, ids[j]))
        if found:
            self._take(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        a = self.anchors
        for k in range(self.lists):
            fits = score >= self.limits[anchor, k]
            if a.low is not None:
                fits &= (score >= a.low[anchor, k]) & (score <= a.high[anchor, k])
            at = np.flatnonzero(fits)
            self.keys = np.append(self.keys, anchor[at] * self.lists + k)
            self.scores, self.ids = np.append(self.scores, score[at]), np.append(self.ids, ids[at])
        keep = _best(self.keys, self.scores, self.ids, a.wanted)
        self.keys, self.scores, self.ids = self.keys[keep], self.scores[keep], self.ids[keep]
        full, count = np.unique(self.keys, return_counts=True)
        last = np.cumsum(count) - 1
        whole = count == a.wanted
        place = full[whole]
        self.limits[place // self.lists, place % self.lists] = np.maximum(self.limits[place // self.lists, place % self.lists], self.scores[last[whole]])

    def batch(self) -> pa.RecordBatch:
        kept = self.scores >= self.limits[self.keys // self.lists, self.keys % self.lists]
        keys, names = self.keys[kept], ["anchor", "positive", "score", "vec_id"]
        return pa.RecordBatch.from_arrays([pa.array((keys // self.lists).astype(np.int32)), pa.array((keys % self.lists).astype(np.int32)), pa.array(self.scores[kept]), pa.array(self.ids[kept])], names=names)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _encode(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width)
        for batch in source:
            rotated = _matrix(batch.column("values"), width, float) @ turn
            length, near = alignment(rotated)
            code = codes(rotated).view(np.int64)
            ends = np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(ends, code.ravel()), pa.array(length), pa.array(near)], names=[*batch.schema.names, "code", "length", "near"]
            )

    return run


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``values`` (whole numbers) of the rows that take part, each once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taking = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False)))
    return taking.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("values")).distinct()


def build_index(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The quantised rows with ``code``, ``length``, ``near``, written; and their width."""
    rows = scratch.keep(quantised(vectors))
    width = max(rows.agg(F.max(F.size("values"))).first()[0] or 0, 1)
    schema = "vec_id long, label int, values array<long>, code array<long>, length double, near double"
    return scratch.keep(rows.mapInArrow(_encode(width), schema)), width


def _searching(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        search = Search(anchors, rotation(anchors.width))
        for whole in source:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                code = _matrix(batch.column("code"), -(-anchors.width // 64), np.int64).view(np.uint64)
                plain = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "length", "near")]
                search.meet(plain[0], plain[1], _matrix(batch.column("values"), anchors.width, np.int64), code, plain[2], plain[3])
        yield search.batch()

    return run


def _lists(index: DataFrame, anchors: Anchors) -> DataFrame:
    """The first entries of each list over all rows of ``index``."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)
    found = index.mapInArrow(_searching(sent), _FOUND)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= anchors.wanted)


def _filled(rows, shape: tuple[int, int], wanted: int) -> np.ndarray:
    """The least score of every full list; the least long where a list is not full."""
    out = np.full(shape, np.iinfo(np.int64).min)
    for r in rows:
        if r["rank"] == wanted:
            out[r["anchor"], r["positive"]] = r["score"]
    return out


def _pass(index: DataFrame, sample: DataFrame, rows: list, width: int, scratch: Scratch) -> DataFrame:
    """Result rows of the anchors ``rows``; what the driver holds is bounded by their number."""
    values = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        values[k, : len(r["values"])] = r["values"]
    asked = Anchors(np.array([r["vec_id"] for r in rows]), np.array([r["label"] for r in rows]), values, width, np.full((len(rows), 1), np.iinfo(np.int64).min))
    limits = _filled(_lists(sample, asked).collect(), (len(rows), 1), POSITIVES)
    spark = index.sparkSession
    positives = scratch.keep(_lists(index, Anchors(asked.ids, asked.labels, values, width, limits)).select("anchor", (F.col("rank") - 1).alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = np.full((len(rows), POSITIVES), -1, np.int64)
    for r in positives.select("anchor", "positive", "positive_score").collect():
        scores[r["anchor"], r["positive"]] = r["positive_score"]
    # No score lies between the two percentages of a negative one. Hundreds and rest apart, so that no product overflows.
    low = scores // 100 * LEAST - (-LEAST * (scores % 100) // 100)
    high = scores // 100 * MOST + MOST * (scores % 100) // 100
    low[scores < 0], high[scores < 0] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    none = np.full(scores.shape, np.iinfo(np.int64).min)
    limits = _filled(_lists(sample, Anchors(asked.ids, asked.labels, values, width, none, low, high)).collect(), scores.shape, NEGATIVES)
    negatives = _lists(index, Anchors(asked.ids, asked.labels, values, width, limits, low, high))
    names = spark.createDataFrame([(k, r["vec_id"]) for k, r in enumerate(rows)], "anchor int, anchor_id long")
    found = negatives.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(positives, ["anchor", "positive"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, asking: Column | None = None) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``; exact.

    Anchors are the rows whose ``vec_id`` is divisible by ``ASKING``, or those
    where ``asking`` holds. Rows without id, label or vector, or with a null or
    non-finite component, take no part. A shorter vector counts as filled up
    with zeros; an empty one scores 0. Rows that repeat id, label and vector
    count once. Rows of one id that differ are rows of their own, but do not
    meet each other. Scores are exact while they fit a long. Other columns are
    ignored. An empty table, or one without anchors, gives no rows.

    Every row is stored once with its code and alignment. Anchors go out in
    passes of at most ``PASS_BYTES``; each pass reads all rows. A task keeps
    the lists of its own rows and returns what can still be in the first
    ``NEGATIVES`` of all, which a small sample, searched first, has bounded.
    """
    scratch = Scratch(vectors.sparkSession)
    index, width = build_index(vectors, scratch)
    anchors = scratch.keep(index.where(F.col("vec_id") % ASKING == 0 if asking is None else asking).select("vec_id", "label", "values"))
    at_once = max(1, PASS_BYTES // (8 * width))
    passes = -(-anchors.count() // at_once) * 2 if anchors.count() > at_once else 1
    sample = scratch.keep(index.where(F.pmod(F.xxhash64("vec_id"), F.lit(FIRST)) == 0))
    out = None
    for k in range(passes):
        rows = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "values"), F.lit(passes)) == k).orderBy("vec_id", "label", "values").collect()
        if not rows:
            continue
        part = _pass(index, sample, rows, width, scratch)
        # Written, so that the anchors of a pass are let go before the next.
        part = scratch.keep(part) if passes > 1 else part
        out = part if out is None else out.union(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
