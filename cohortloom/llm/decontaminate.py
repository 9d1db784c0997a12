"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is one batch of documents. Only stretches of it whose word pairs all
occur in the benchmark can hold a benchmark window, so only these are indexed.
All windows are searched backwards at once through the ranks of a wavelet
matrix; occurrences are located through sampled suffix positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALPHANUMERIC, LOWER, Words, pieces, text_bytes

#: Characters of benchmark text handled in one pass; a larger benchmark takes several.
PART_CHARS = 32 << 20
SAMPLE_EVERY = 16


@dataclass(frozen=True)
class Phrases:
    """Windows of benchmark items as word numbers; 0 is kept for other words.

    ``of_item`` has, for each window, the numbers of the items that hold it.
    """

    vocabulary: np.ndarray
    pairs: np.ndarray
    single: np.ndarray
    shortest: int
    by_length: list[tuple[np.ndarray, list[list[int]]]]
    items: list[str]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)


def compile_phrases(items: list[tuple[str, str | None]], width: int) -> Phrases:
    data, offsets = text_bytes(pa.array([t or "" for _, t in items], pa.string()))
    words = Words(LOWER[data], offsets, ALPHANUMERIC)
    vocabulary, number = np.unique(words.hash, return_inverse=True)
    number = number + 1
    windows: dict[tuple[int, ...], list[int]] = {}
    for k in range(len(items)):
        own = number[words.first[k] : words.first[k + 1]].tolist()
        size = min(width, len(own))
        for begin in range(len(own) - size + 1 if size else 0):
            holders = windows.setdefault(tuple(own[begin : begin + size]), [])
            if not holders or holders[-1] != k:
                holders.append(k)
    by_length: dict[int, list] = {}
    for window, holders in windows.items():
        by_length.setdefault(len(window), []).append((window, holders))
    base = len(vocabulary) + 1
    pairs = {a * base + b for w in windows for a, b in zip(w, w[1:], strict=False)}
    return Phrases(
        vocabulary,
        np.array(sorted(pairs), np.int64),
        np.array(sorted(w[0] for w in windows if len(w) == 1), np.int64),
        min((n for n in by_length if n > 1), default=0),
        [(np.array([w for w, _ in found], np.int64), [h for _, h in found]) for _, found in sorted(by_length.items())],
        [k for k, _ in items],
    )


def _among(values: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    if not len(allowed):
        return np.zeros(len(values), bool)
    return allowed[np.minimum(np.searchsorted(allowed, values), len(allowed) - 1)] == values


def stretches(number: np.ndarray, row: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Which words may lie in an occurrence: runs of benchmark pairs long enough for a window, and one-word windows."""
    keep = _among(number, phrases.single)
    if phrases.shortest and len(number) > 1:
        joined = _among(number[:-1] * (len(phrases.vocabulary) + 1) + number[1:], phrases.pairs) & (row[:-1] == row[1:]) & (number[:-1] > 0) & (number[1:] > 0)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2] + 1
        fit = end - begin >= phrases.shortest
        change = np.zeros(len(number) + 1, np.int64)
        np.add.at(change, begin[fit], 1)
        np.add.at(change, end[fit], -1)
        keep |= np.cumsum(change[:-1]) > 0
    return keep


class FMIndex:
    """Full-text index of a sequence of numbers; 0 separates texts and occurs in no pattern."""

    def __init__(self, text: np.ndarray, symbols: int):
        size = len(text)
        order = self._suffixes(text)
        self.last = text[order - 1]
        # A row whose text position is sampled, or whose predecessor is a separator, needs no further step.
        known = (order % SAMPLE_EVERY == 0) | (self.last == 0)
        self.sample = np.where(known, order, -1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.zeros, self.split = [], []
        now = self.last
        for level in reversed(range(self.levels)):
            bit = (now >> level) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(bit == 0))))
            self.split.append(int(self.zeros[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.size = size

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling; separators differ by position, so no comparison crosses them."""
        size = len(text)
        rank = text + np.count_nonzero(text == 0)
        rank[text == 0] = np.arange(np.count_nonzero(text == 0))
        step = 1
        while True:
            after = np.zeros(size, np.int64)
            after[: size - step] = rank[step:] + 1 if step < size else 0
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(size, np.int64)
            rank[order] = fresh
            if fresh[-1] == size - 1 or step >= size:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the last column above ``row``."""
        begin = np.zeros(len(row), np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1 == 1
            zeros, split = self.zeros[k], self.split[k]
            row, begin = (np.where(one, split + x - zeros[x], zeros[x]) for x in (row, begin))
        return row - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the patterns that occur: their number and their first and last + 1 row."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for place in reversed(range(patterns.shape[1])):
            symbol = patterns[which, place]
            low, high = (self.before[symbol] + self.rank(symbol, x) for x in (low, high))
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled one."""
        place, steps, open_ = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        now = rows.copy()
        while len(open_):
            hit = self.sample[now[open_]] >= 0
            done = open_[hit]
            place[done] = self.sample[now[done]] + steps[done]
            open_ = open_[~hit]
            symbol = self.last[now[open_]]
            now[open_] = self.before[symbol] + self.rank(symbol, now[open_])
            steps[open_] += 1
        return place


def _occurrences(text: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, list[int]]]:
    """Text positions of each window that occurs, its length and its items."""
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    for patterns, holders in phrases.by_length:
        which, low, high = index.search(patterns)
        count = high - low
        if not len(which):
            continue
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        places = index.locate(rows)
        for k, at in zip(which.tolist(), np.split(places, np.cumsum(count)[:-1]), strict=True):
            yield at, patterns.shape[1], holders[k]


def _judge(parts, share: int):
    none = hashlib.sha256(b"").hexdigest()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            data, offsets = text_bytes(batch.column("text"))
            rows, carried = batch.num_rows, batch.schema.names[2:]
            total, hits = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            found: list[set[str | None]] = [set() for _ in range(rows)]
            spans: list[list[list[int]]] = [[] for _ in range(rows)]
            # Of the shard, only what may be hit is held: place, row and number by part of the benchmark.
            held: list[list[tuple]] = [[] for _ in parts]
            for begin, end in pieces(offsets):
                own = offsets[begin : end + 1]
                words = Words(LOWER[data[own[0] : own[-1]]], own - own[0], ALPHANUMERIC)
                counts = np.diff(words.first)
                total[begin:end] = counts
                row = np.repeat(np.arange(begin, end), counts)
                place = np.arange(len(row)) - np.repeat(words.first[:-1], counts)
                for mine, part in zip(held, parts, strict=True):
                    number = part.value.numbers(words.hash)
                    keep = np.flatnonzero(stretches(number, row, part.value))
                    mine.append((place[keep], row[keep], number[keep]))
            hit_words: list[np.ndarray] = []
            for mine, part in zip(held, parts, strict=True):
                place, row, number = (np.concatenate(x) for x in zip(*mine, strict=True)) if mine else (np.zeros(0, np.int64),) * 3
                if not len(number):
                    continue
                gap = np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)))
                at = np.arange(len(number)) + np.cumsum(gap)
                text = np.zeros(at[-1] + 2, np.int64)
                text[at] = number
                origin = np.full(len(text), -1)
                origin[at] = np.arange(len(number))
                change = np.zeros(len(text) + 1, np.int64)
                for places, length, holders in _occurrences(text, part.value):
                    np.add.at(change, places, 1)
                    np.add.at(change, places + length, -1)
                    names = [part.value.items[h] for h in holders]
                    for r in np.unique(row[origin[places]]).tolist():
                        found[r].update(names)
                covered = origin[(np.cumsum(change[:-1]) > 0) & (origin >= 0)]
                hit_words.append(np.stack([row[covered], place[covered]]))
            if hit_words:
                merged = np.unique(np.concatenate(hit_words, axis=1), axis=1)
                hits = np.bincount(merged[0], minlength=rows)
                cut = np.flatnonzero((merged[0, 1:] != merged[0, :-1]) | (merged[1, 1:] != merged[1, :-1] + 1)) + 1
                for run_ in np.split(np.arange(merged.shape[1]), cut):
                    if len(run_):
                        spans[int(merged[0, run_[0]])].append([int(merged[1, run_[0]]), int(merged[1, run_[-1]]) + 1])
            digest = [hashlib.sha256(",".join(sorted(f - {None})).encode()).hexdigest() if f else none for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), batch.column("doc_id"), pa.array(total), pa.array(hits.astype(np.int64)), pa.array([len(f) for f in found], pa.int64()), pa.array(digest), pa.array((hits > 0) & (share * hits >= total)), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=[*carried, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``spans``, and the columns of ``carry``.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower
    case. A window is ``width`` consecutive words of an item, or the whole item
    if it has fewer; items without words or with null text have none. ``spans``
    are the merged ranges of hit words [first, last + 1), the ranges to remove.
    Contaminated: some word is hit and ``share * n_hit >= n_words``. A null
    text has no words; null ids stay null. Items with one id count once; all items
    without id count as one more in ``n_items`` and are not named in the digest.
    Repeated rows are judged one by one; other columns are ignored. The
    benchmark is the query set: it goes to all tasks in parts of bounded size.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("string").alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    count = -(-size // PART_CHARS) or 1
    parts = []
    for number in range(count):
        own = items.where(F.pmod(F.xxhash64("k"), F.lit(count)) == number).orderBy("k", "t").collect()
        parts.append(spark.sparkContext.broadcast(compile_phrases([(r["k"], r["t"]) for r in own], width)))
    asked = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.schema.fields[2:])
    schema = f"{kept}doc_id {asked.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>"
    told = asked.mapInArrow(_judge(parts, share), schema)
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *[F.col(f"_{c}").alias(c) for c in carry])
