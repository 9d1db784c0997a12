"""Language identification with error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import drawn, fold, held_out
from .words import LOWER, batches, pieces, text_bytes, weights

#: Hash buckets of byte trigrams.
BUCKETS = 1 << 14
#: Texts learned from at most.
SAMPLE = 4000
#: Codewords as long as an exhaustive code up to this many languages.
EXHAUSTIVE = 5
#: Lead of the best codeword, as a probability, below which a text is flagged.
CLEAR = 0.1

# ASCII that is no letter counts as one blank.
_SEEN = np.where((LOWER < 0x80) & ~((LOWER >= 0x61) & (LOWER <= 0x7A)), 0x20, LOWER).astype(np.uint8)
_SCALE = weights(3, 29).astype(np.uint32)


def codewords(count: int) -> np.ndarray:
    """One row of -1 and 1 for each language: all distinct columns for few languages, else random columns that keep rows far apart."""
    if count == 1:
        return np.ones((1, 1), np.int8)
    if count <= EXHAUSTIVE:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(count - 1)] for k in range(2 ** (count - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, size, best, least = np.random.default_rng(7), 4 * int(np.ceil(np.log2(count))) + 3, None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (count, size))
        near = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(count), 2))
        if near > least and (np.abs(code.sum(axis=0, dtype=int)) < count).all():
            best, least = code, near
    return best


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets and, for each text, where its own begin; none spans two texts and each has a letter."""
    seen = _SEEN[data]
    count = max(0, len(seen) - 2)
    wide = seen.astype(np.uint32)
    bucket = wide[:count] * _SCALE[0] + wide[1 : count + 1] * _SCALE[1] + wide[2 : count + 2] * _SCALE[2]
    bucket = (bucket ^ (bucket >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    whole = seen[1 : count + 1] != 0x20
    inner = offsets[1:-1]
    for back in (1, 2):
        at = inner - back
        whole[at[(at >= 0) & (at < count)]] = False
    at = np.flatnonzero(whole)
    return bucket[at], np.searchsorted(at, offsets[:-1])


@dataclass(frozen=True)
class Coder:
    """Weights of the binary classifiers (bucket x bit), scale and offset of each bit, and the codewords."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    scale: np.ndarray
    offset: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of the trigrams of each text; 0 without trigrams."""
        bucket, begin = grams(data, offsets)
        rows = len(offsets) - 1
        out = np.zeros((rows, self.weight.shape[1]), np.float32)
        count = np.diff(np.append(begin, len(bucket)))
        has = np.flatnonzero(count)
        if len(has):
            out[has] = np.add.reduceat(self.weight[bucket], begin[has], axis=0) / count[has, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability and its lead, by the summed logistic loss of all bits."""
        logits = margins * self.scale + self.offset
        loss = np.logaddexp(0, -logits[:, None, :] * self.code[None].astype(np.float64)).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0)
        return best, top[:, -1], lead


def _fit_bit(x: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic model of one margin, by damped Newton steps."""
    a, b = 1.0, 0.0
    y = positive.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        grad = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return a, b


def fit(rows: list[tuple[str, str]]) -> Coder | None:
    """Learns from (text, language) rows; None without rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    data, offsets = text_bytes(pa.array([t for t, _ in rows], pa.string()))
    label = np.array([languages.index(lang) for _, lang in rows])
    counts = np.zeros((len(languages), BUCKETS))
    for begin, end in pieces(offsets):
        own = offsets[begin : end + 1]
        bucket, at = grams(data[own[0] : own[-1]], own - own[0])
        of = np.repeat(label[begin:end], np.diff(np.append(at, len(bucket))))
        counts += np.bincount(of * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
    rate = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weight = np.stack([np.log(rate[code[:, k] > 0].mean(axis=0)) - np.log(rate[code[:, k] < 0].mean(axis=0)) if (code[:, k] < 0).any() else np.zeros(BUCKETS) for k in range(code.shape[1])], axis=1)
    coder = Coder(languages, code, weight.astype(np.float32), np.ones(code.shape[1]), np.zeros(code.shape[1]))
    margins = np.concatenate([coder.margins(data[o[0] : o[-1]], o - o[0]) for o in (offsets[b : e + 1] for b, e in pieces(offsets))])
    fitted = [_fit_bit(margins[:, k], code[label, k] > 0) for k in range(code.shape[1])]
    return Coder(languages, code, coder.weight, np.array([a for a, _ in fitted]), np.array([b for _, b in fitted]))


def _predict(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = sent.value
        names = pa.array([*coder.languages, "und"])
        for batch, data, offsets in batches(source):
            best, share, lead = coder.decode(coder.margins(data, offsets))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letters, best, len(coder.languages))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c not in ("text", "letters")), names.take(pa.array(best)), pa.array(np.where(letters, share, 0.0)), pa.array(~letters | (lead < CLEAR))],
                names=[*(c for c in batch.schema.names if c not in ("text", "letters")), "lang_pred", "score", "ambiguous"],
            )

    return run


def training_rows(docs: DataFrame, limit: int = SAMPLE) -> list[tuple[str, str]]:
    usable = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = drawn(usable.select("doc_id", "text", "lang"), limit).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "lang").limit(limit).collect()
    return [(r["text"], r["lang"]) for r in rows]


def identify(docs: DataFrame, limit: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``, and the columns of ``carry``.

    The binary classifiers are log odds of byte trigrams, learned from at most
    ``limit`` texts outside fold 1 of 3. Every trigram of a text counts. A text
    is ``und`` with score 0 if it is null or has no letter, and every text is if
    there is nothing to learn from. ``ambiguous`` marks ``und`` and texts whose
    best codeword leads by less than ``CLEAR``. Repeated rows are judged one by
    one; a null id stays null; other columns are ignored.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    coder = fit(training_rows(plain, limit))
    text = F.col("text").cast("string")
    asked = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), *[F.col(c).alias(f"_{c}") for c in carry], text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if coder is None:
        return asked.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"), *[F.col(f"_{c}").alias(c) for c in carry])
    sent = docs.sparkSession.sparkContext.broadcast(coder)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[2:-2])
    schema = f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, held_out boolean{kept}, lang_pred string, score double, ambiguous boolean"
    told = asked.mapInArrow(_predict(sent), schema)
    return told.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", *[F.col(f"_{c}").alias(c) for c in carry])
