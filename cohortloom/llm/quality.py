"""Document quality by a regularised quadratic discriminant over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, labelled_sample
from .words import LOWER, NOT_BLANK, Words, batches, pieces, text_bytes

#: Labelled texts of each class learned from at most.
SAMPLE = 3000
#: Weight of the pooled covariance, and of a multiple of the identity, in each class covariance.
POOLED, ROUND = 0.1, 0.05

_UPPER, _LOWER, _DIGIT, _OTHER, _BLANK, _LINE, _STOP, _COMMA, _EXCLAIM, _PIPE, _MARK = range(11)
_CLASS = np.full(256, _MARK)
_CLASS[0x80:] = _OTHER
for _kind, _bytes in ((_UPPER, range(0x41, 0x5B)), (_LOWER, range(0x61, 0x7B)), (_DIGIT, range(0x30, 0x3A)), (_BLANK, b" \t\r\v\f"), (_LINE, b"\n"), (_STOP, b".;:?"), (_COMMA, b",'-"), (_EXCLAIM, b"!"), (_PIPE, b"|")):
    _CLASS[list(_bytes)] = _kind
_LINE_BYTES = np.arange(256) != 0x0A


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a share, tame for 0 and 1."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row per text; an empty text has those of zero counts."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row * 11 + _CLASS[data], minlength=11 * rows).reshape(rows, 11).astype(float)
    words, lines = Words(LOWER[data], offsets, NOT_BLANK), Words(data, offsets, _LINE_BYTES)
    count, n_lines = np.diff(words.first).astype(float), np.diff(lines.first).astype(float)
    length = np.log1p(words.end - words.start)
    sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (length, length**2)]
    mean = [np.diff(s[words.first]) / np.maximum(count, 1) for s in sums]
    fresh, fresh_lines, top = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for k in range(rows):
        own = words.hash[words.first[k] : words.first[k + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            fresh[k], top[k] = len(times), times.max()
            fresh_lines[k] = len(np.unique(lines.hash[lines.first[k] : lines.first[k + 1]]))
    letters = kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _OTHER]
    return np.stack(
        [
            np.log1p(count), np.log1p(n_lines), mean[0], np.sqrt(np.maximum(mean[1] - mean[0] ** 2, 0)),
            _share(letters, size), _share(kinds[:, _UPPER], letters), _share(kinds[:, _DIGIT], size), _share(kinds[:, _STOP], size),
            _share(kinds[:, _COMMA], size), _share(kinds[:, _EXCLAIM], size), _share(kinds[:, _PIPE], size), _share(kinds[:, _MARK], size),
            _share(fresh, count), _share(top, count), _share(n_lines - fresh_lines, n_lines),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """Centre and spread of all statistics and, by class, mean, inverse Cholesky factor and log weight."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    level: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the log densities."""
        x = (x - self.centre) / self.spread
        dense = []
        for k in range(2):
            y = (x - self.means[k]) @ self.whiten[k].T
            dense.append(self.level[k] - 0.5 * (y**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Discriminant:
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / spread
    size = x.shape[1]
    own = [x[y == k] for k in (0, 1)]
    means = np.stack([o.mean(axis=0) for o in own])
    spreads = [np.cov(o.T, bias=True) if len(o) > 1 else np.eye(size) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, spreads, strict=True)) / len(x)
    whiten, level = [], []
    for k, share in ((0, 1 - prior), (1, prior)):
        shrunk = (1 - POOLED - ROUND) * spreads[k] + POOLED * pooled + ROUND * np.trace(pooled) / size * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        level.append(np.log(share) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, spread, means, np.stack(whiten), np.array(level))


def _statistics_of(texts: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    return np.concatenate([statistics(data[o[0] : o[-1]], o - o[0]) for o in (offsets[b : e + 1] for b, e in pieces(offsets))])


def _scored(sent, cut: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(source):
            score = sent.value.score(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Learns from at most ``per_class`` labelled texts of each class outside fold
    0 of 5; the class weights are those of all labels outside that fold. Null
    counts as the empty text. With no class, or one class, to learn from every
    score is the share of label 1 (0.5 without labels). Repeated rows are
    scored one by one; a null id stays null; other columns are ignored.
    """
    rows = labelled_sample(docs, labels, "quality", per_class)
    y = np.array([label for _, label in rows], int)
    plain = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    if len(np.unique(y)) < 2:
        constant = float(y.mean()) if len(y) else 0.5
        return plain.select("doc_id", "held_out", F.lit(constant).alias("score"), F.lit(int(constant >= cut)).alias("predicted"))
    known = labels.where(~held_out("doc_id", 5, 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg("quality")).first()[0]
    model = fit(_statistics_of([t for t, _ in rows]), y, min(max(prior, 1e-3), 1 - 1e-3))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_scored(sent, cut), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
