"""Removal of passages that an earlier document has, located by Aho-Corasick automata.

1.  In every window of 13 words the 5-gram with the least hash is its anchor.
    Equal windows have equal anchors, so only windows whose anchor occurs in two
    documents can repeat. Anchors are a fifth of all words.
2.  Those windows are confirmed by a count over 64-bit window hashes, which
    also gives the first document of each. Both counts combine before they
    shuffle, so a passage that a third of all documents share is no hot key.
3.  Documents are dealt to blocks, and each block is told where confirmed
    windows stand in it. Windows that follow each other are joined to passages,
    the passages are compiled to the block's automaton, and all documents of the
    block are streamed through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import NOT_BLANK, Words, batches, text_bytes, whole_runs, window_hashes

ANCHOR = 5
#: Characters of text that a block has on average.
BLOCK_CHARS = 1 << 20


def _anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, row and place of every whole window."""
    size = min(ANCHOR, width)
    grams = window_hashes(words, size)
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach, least = width - size + 1, grams
    done = 1
    while done * 2 <= reach:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if done < reach:
        rest = reach - done
        least = np.minimum(least[: len(least) - rest], least[rest:])
    row = np.searchsorted(first, np.arange(count), side="right") - 1
    whole = np.flatnonzero(np.arange(count) + width <= first[row + 1])
    return least[whole], row[whole], whole


def _anchor_rows(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(source):
            words = Words(data, offsets, NOT_BLANK)
            least, row, _ = _anchors(words.hash, words.first, width)
            if not len(least):
                continue
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), batch.column("doc_id").take(pa.array(row[new]))], names=["anchor", "doc_id"])

    return run


def _window_rows(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(source):
            words = Words(data, offsets, NOT_BLANK)
            least, row, place = _anchors(words.hash, words.first, width)
            if not len(least):
                continue
            ends = batch.column("anchors").offsets.to_numpy()
            wanted = batch.column("anchors").flatten().to_numpy().view(np.uint64)
            ends = ends - ends[0]
            number = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            keep = np.zeros(len(least), bool)
            for k in range(batch.num_rows):
                own = slice(number[k], number[k + 1])
                keep[own] = np.isin(least[own], wanted[ends[k] : ends[k + 1]])
            row, place = row[keep], place[keep]
            windows = window_hashes(words.hash, width)[place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows.view(np.int64)), batch.column("doc_id").take(pa.array(row)), pa.array((place - words.first[row]).astype(np.int32))],
                names=["window", "doc_id", "place"],
            )

    return run


class _Block:
    """The documents of one block, their words as dense numbers, and the places named for them."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        documents = table.filter(pa.compute.is_valid(table.column("row")))
        self.ids = documents.column("doc_id").to_pylist()
        texts = documents.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        self.data, offsets = text_bytes(texts)
        self.words = Words(self.data, offsets, NOT_BLANK)
        self.digits, self.coded = self._coded(np.unique(self.words.hash, return_inverse=True)[1])
        self.windows = window_hashes(self.words.hash, width).view(np.int64)
        self.row_of: dict[int, list[int]] = {}
        for k, doc in enumerate(self.ids):
            self.row_of.setdefault(doc, []).append(k)
        self.named = table.filter(pa.compute.is_null(table.column("row")))

    @staticmethod
    def _coded(number: np.ndarray) -> tuple[int, str]:
        """Each word as two or more characters: an automaton node searches its children one by one, so it may have few.

        The first character of a word is from another range than the others, so matches begin and end with words.
        """
        digits = 2
        while len(number) and number.max() >> 8 * digits:
            digits += 1
        parts = np.stack([((number >> 8 * k) & 255) + (0x400 if k == 0 else 0x800) for k in range(digits)], axis=1)
        return digits, parts.astype(np.uint32).tobytes().decode("utf-32-le")

    def automaton(self) -> ahocorasick.Automaton | None:
        """The named passages, each with the first document that has its windows and its number of words.

        Windows of a passage have one first document, so it holds for every place where the passage stands.
        """
        built = ahocorasick.Automaton()
        for doc, places, checks, firsts in zip(self.named.column("doc_id").to_pylist(), *(self.named.column(c) for c in ("places", "checks", "firsts")), strict=True):
            place, check, first = (x.values.to_numpy() for x in (places, checks, firsts))
            order = np.argsort(place)
            place, check, first = place[order].astype(np.int64), check[order], first[order]
            for k in self.row_of.get(doc, []):
                begin, end = int(self.words.first[k]), int(self.words.first[k + 1])
                fits = begin + place + self.width <= end
                # Rows may share an id; the check tells whether this row has the window there.
                fits[fits] = self.windows[begin + place[fits]].astype(np.int32) == check[fits]
                at, own = begin + place[fits], first[fits]
                if not len(at):
                    continue
                cut = np.flatnonzero((np.diff(at) != 1) | (own[1:] != own[:-1])) + 1
                head, tail = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + self.width
                for low, high, value in zip(head.tolist(), tail.tolist(), own[np.append(0, cut)].tolist(), strict=True):
                    built.add_word(self.coded[low * self.digits : high * self.digits], (value, high - low))
        if not len(built):
            return None
        built.make_automaton()
        return built

    def removed(self) -> list[np.ndarray]:
        """For each document which words are covered by a window that an earlier document has."""
        automaton = self.automaton()
        out = []
        for k, doc in enumerate(self.ids):
            begin, end = int(self.words.first[k]), int(self.words.first[k + 1])
            change = np.zeros(end - begin + 1, np.int64)
            if automaton is not None and doc is not None and end - begin >= self.width:
                found = [(at, size) for at, (first, size) in automaton.iter(self.coded[begin * self.digits : end * self.digits]) if first < doc]
                if found:
                    stop, size = np.array(found).T
                    stop = stop // self.digits + 1
                    np.add.at(change, stop - size, 1)
                    np.add.at(change, stop, -1)
            out.append(np.cumsum(change[:-1]) > 0)
        return out


    def joined(self, keep: np.ndarray) -> list[str]:
        """The kept words of each document, joined by one space."""
        start, size = self.words.start[keep], (self.words.end - self.words.start)[keep]
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends - size - 1, size) + step] = self.data[np.repeat(start, size) + step]
        before = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(keep)))[self.words.first]]
        raw = out.tobytes()
        return [raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


def _clean(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(source, "block"):
            keys = table.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                block = _Block(table.slice(low, high - low), width)
                masks = block.removed()
                gone = [int(m.sum()) for m in masks]
                counts = [len(m) for m in masks]
                kept_text = block.joined(~np.concatenate(masks) if masks else np.zeros(0, bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_text, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run


def repeated_passages(docs: DataFrame, width: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text``.

    Words are runs of anything but ASCII blanks, unchanged. A word goes if a
    window of ``width`` consecutive words that covers it also starts in a
    document with a smaller ``doc_id``; windows are judged on the input.
    ``kept_text`` joins the words that stay by one space. A null text has no
    words, a text of fewer words no window. A row without ``doc_id`` is neither
    earlier nor later than another: it loses nothing and takes nothing away.
    Rows that repeat an id are not earlier than each other. Other columns are
    ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    anchors = scratch.keep(known.mapInArrow(_anchor_rows(width), "anchor long, doc_id long"))
    shared = scratch.keep(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("anchor"))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    windows = scratch.keep(known.join(wanted, "doc_id").mapInArrow(_window_rows(width), "window long, doc_id long, place int"))
    scratch.drop(anchors, shared)
    confirmed = scratch.keep(windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("hi")).where("first <> hi").select("window", "first"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = F.lit(chars // BLOCK_CHARS + 1)
    later = windows.join(confirmed, "window").where("doc_id > first")
    check = F.shiftright(F.shiftleft("window", 32), 32).cast("int")
    named = later.groupBy(F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), "doc_id").agg(F.collect_list("place").alias("places"), F.collect_list(check).alias("checks"), F.collect_list("first").alias("firsts"))
    named = scratch.keep(named.select("block", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("row"), "places", "checks", "firsts"))
    scratch.drop(windows, confirmed)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("places", "array<int>"), ("checks", "array<int>"), ("firsts", "array<long>"))]
    own = F.pmod(F.xxhash64(F.coalesce("doc_id", F.length("text").cast("long"), F.lit(0))), blocks).alias("block")
    both = docs.select(own, "doc_id", "text", F.lit(0).alias("row"), *none).unionByName(named)
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(_clean(width), "doc_id long, n_words long, n_removed long, kept_text string")
