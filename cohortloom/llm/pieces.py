"""SentencePiece encoding and decoding by batched Viterbi in numpy."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .words import batches, mix, weights

#: Model file of a public tokenizer; a parameter, never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_NORMAL, _BYTE = 1, 6
_CODE, _BASE = weights(1, 41)[0], weights(1, 43)[0]
#: Penalty of a byte piece below the least score, as for unknown characters.
UNKNOWN_PENALTY = 10.0
#: Words that advance together.
AT_ONCE = 1 << 14
#: Characters up to which words of all lengths do.
SHORT = 16
#: Distinct words whose pieces a task remembers from batch to batch; then it begins anew.
REMEMBERED = 1 << 17
#: Bytes of text encoded at once; a longer text alone.
ENCODED_BYTES = 1 << 19
#: Bits of the filter that is asked before the sorted keys.
FILTER_BITS = 20


@dataclass(frozen=True)
class Pieces:
    """Sorted hashes of the pieces with their ids and scores; ids of the byte pieces; the texts for decoding."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    maybe: np.ndarray
    byte_ids: np.ndarray
    text: list[bytes]
    longest: int
    floor: float
    dummy_prefix: bool


def load_pieces(spark: SparkSession, path: str) -> Pieces:
    """Reads a model through Spark, so that it may lie in any store."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(bytes(raw))
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    normal = [(k, p.piece, p.score) for k, p in enumerate(model.pieces) if p.type == _NORMAL]
    inner = [p for _, p, _ in normal if _MARK in p.lstrip(_MARK)]
    if inner:
        raise ValueError("pieces that go across words are not supported")
    keys = np.array([_hash_of(p) for _, p, _ in normal], np.uint64)
    order = np.argsort(keys)
    byte_ids = np.full(256, -1, np.int64)
    text = [b""] * len(model.pieces)
    for k, p in enumerate(model.pieces):
        if p.type == _BYTE:
            byte_ids[int(p.piece[3:5], 16)] = k
            text[k] = bytes([int(p.piece[3:5], 16)])
        elif p.type == _NORMAL:
            text[k] = p.piece.replace(_MARK, " ").encode()
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    scores = np.array([s for _, _, s in normal])
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[keys >> np.uint64(64 - FILTER_BITS)] = True
    return Pieces(keys[order], np.array([k for k, _, _ in normal])[order], scores[order], maybe, byte_ids, text, max(len(p) for _, p, _ in normal), float(scores.min() - UNKNOWN_PENALTY), model.normalizer_spec.add_dummy_prefix)


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2^64."""
    one = np.ones(count, np.uint64)
    one[1:] = _BASE
    back = one.copy()
    back[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(one, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Sums of the scrambled codes times powers of the base, up to every place of each row."""
    count, size = codes.shape
    out = np.zeros((count, size + 1), np.uint64)
    np.cumsum(mix((codes.astype(np.uint64) + _CODE).ravel()).reshape(count, size) * _powers(size)[0], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _hash_of(piece: str) -> int:
    codes = np.array([[ord(c) for c in piece]], np.uint64)
    return int(mix(_prefixes(codes)[:, -1])[0])


def viterbi(codes: np.ndarray, sizes: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of words (word x character), longest first and filled up: for every end, id and length of the last piece; id -1 is a character without piece.

    The hash of a substring is the difference of two prefixes, shifted back to
    the beginning of the word. All substrings with one end are looked up at
    once. Most are no piece; a filter tells that of nearly all of them before
    the sorted keys are searched.
    """
    count, size = codes.shape
    prefix, back = _prefixes(codes), _powers(size + 1)[1]
    best = np.zeros((count, size + 1))
    last_id, last_size = np.full((count, size + 1), -1, np.int64), np.ones((count, size + 1), np.int64)
    reach = np.searchsorted(-sizes, -np.arange(size + 1), side="right").tolist()
    for end in range(1, size + 1):
        # Words that go so far; pieces of so many widths, shortest first.
        n, begin = reach[end], max(0, end - table.longest)
        widths, each = end - begin, np.arange(n)
        key = mix((prefix[:n, end, None] - prefix[:n, begin:end][:, ::-1]) * back[begin:end][::-1]).ravel()
        asked = np.flatnonzero(table.maybe[key >> np.uint64(64 - FILTER_BITS)])
        key = key[asked]
        at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
        hit = table.keys[at] == key
        (rows, more), at = np.divmod(asked[hit], widths), at[hit]
        tried, ids = np.full((n, widths), -np.inf), np.full((n, widths), -1, np.int64)
        tried[:, 0] = best[:n, end - 1] + table.floor
        tried[rows, more], ids[rows, more] = best[rows, end - 1 - more] + table.scores[at], table.ids[at]
        # The first of equal sums: the shortest last piece stays.
        pick = tried.argmax(axis=1)
        best[:n, end], last_id[:n, end], last_size[:n, end] = tried[each, pick], ids[each, pick], pick + 1
    return last_id, last_size


def _walk_back(last_id: np.ndarray, last_size: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece id and end of every piece, by row and place."""
    end, open_ = sizes.copy(), np.arange(len(sizes))
    rows, ids, ends = [], [], []
    while len(open_):
        at = end[open_]
        rows.append(open_)
        ids.append(last_id[open_, at])
        ends.append(at)
        end[open_] = at - last_size[open_, at]
        open_ = open_[end[open_] > 0]
    row, place = np.concatenate(rows), np.concatenate(ends)
    order = np.lexsort((place, row))
    return row[order], np.concatenate(ids)[order], place[order]


def _segment(words: list[str], table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words in a row, and how many each word has; words of like lengths advance together."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    owner, found, begin = [], [], 0
    while begin < len(words):
        # Words of more than half the length of the longest, or all that are short.
        longest = int(falling[begin])
        alike = int(np.searchsorted(-falling, -(longest // 2 if longest > SHORT else 0)))
        chosen = order[begin : min(alike, begin + max(1, min(AT_ONCE, (1 << 20) // longest)))]
        begin += len(chosen)
        codes = np.frombuffer("".join([words[k].ljust(longest, "\0") for k in chosen.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(chosen), longest)
        row, ids, place = _walk_back(*viterbi(codes, sizes[chosen], table), sizes[chosen])
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            # A character without piece becomes its bytes.
            parts = [table.byte_ids[list(chr(c).encode())] for c in codes[row[lost], place[lost] - 1].tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(p) for p in parts]
            row, ids = np.repeat(row, times), np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(parts)
        owner.append(chosen[row])
        found.append(ids)
    if not owner:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    own = np.concatenate(owner)
    return np.concatenate(found)[np.argsort(own, kind="stable")].astype(np.int32), np.bincount(own, minlength=len(words))


def _numbers() -> defaultdict[str, int]:
    """Numbers new words as they are asked for."""
    return defaultdict(count().__next__)


class Encoder:
    """Encodes texts; words seen before are looked up, up to ``REMEMBERED`` of them."""

    def __init__(self, table: Pieces):
        self.table = table
        self.number = _numbers()
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.array([len(t) for t in table.text], np.int64)
        self.bytes, self.length, self.begin = np.frombuffer(b"".join(table.text), np.uint8), lengths, np.cumsum(lengths) - lengths

    def words(self, text: str) -> list[str]:
        """Cuts before each run of blanks: no piece goes across such a place."""
        marked = ((" " if self.table.dummy_prefix and text else "") + text).replace(" ", _MARK)
        parts = marked.split(_MARK)
        if all(parts[1:]):
            return [*parts[: 1 if parts[0] else 0], *map(_MARK.__add__, parts[1:])]
        out, run = ([parts[0]] if parts[0] else []), 0
        for part in parts[1:]:
            run += 1
            if part:
                out.append(_MARK * run + part)
                run = 0
        return [*out, _MARK * run] if run else out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and how many each text has."""
        if len(self.number) > REMEMBERED:
            self.number, self.flat, self.size = _numbers(), self.flat[:0], self.size[:0]
        number, known = self.number, len(self.number)
        split = [self.words(t) for t in texts]
        row = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        if len(number) > known:
            fresh = list(islice(number, known, None))
            flat, size = _segment(fresh, self.table)
            self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        ids = self.flat[_spans((np.cumsum(self.size) - self.size)[row], self.size[row])]
        ends = np.concatenate(([0], np.cumsum(self.size[row])))
        words = np.cumsum([0, *(len(words) for words in split)])
        return ids, np.diff(ends[words])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.table.text[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.table.dummy_prefix and text.startswith(" ") else text

    def gives_back(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the bytes of each text's pieces, without the blank put before it, are the bytes of the text."""
        made = self.bytes[_spans(self.begin[ids], self.length[ids])]
        ends = np.concatenate(([0], np.cumsum(self.length[ids])))[np.concatenate(([0], np.cumsum(count)))]
        begin, size, want = ends[:-1], np.diff(ends), np.diff(offsets)
        if self.table.dummy_prefix:
            begin, size = begin + (size > 0), size - (size > 0)
        fits = size == want
        rows = np.flatnonzero(fits & (want > 0))
        same = made[_spans(begin[rows], want[rows])] == data[_spans(offsets[:-1][rows], want[rows])]
        if len(rows):
            fits[rows] = np.logical_and.reduceat(same, np.cumsum(want[rows]) - want[rows])
        return fits


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of consecutive runs, in 32 bits where that holds them."""
    total = int(size.sum())
    kind = np.int32 if max(total, int(begin.max(initial=0)) + total) < 1 << 31 else np.int64
    out = np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def _encoded(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch, data, offsets in batches(source, limit=ENCODED_BYTES):
            ids, count = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            same = coder.gives_back(ids, count, data, offsets)
            ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            values = pa.ListArray.from_arrays(ends, ids)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values, pa.array(np.diff(ends).astype(np.int64)), pa.array(same)], names=[*names, "piece_ids", "n_pieces", "round_trip"])

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every document with ``piece_ids``, ``n_pieces``, ``round_trip``.

    Segmentations have the greatest sum of piece scores; of equal sums the
    shortest last piece wins. Characters without a piece become byte pieces.
    ``round_trip`` tells that decoding gave the text back, which holds for
    every text. Null and empty texts have no pieces. Repeated rows are encoded
    one by one; columns outside ``keep`` are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(docs.sparkSession, model))
    plain = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(_encoded(sent), f"{kept}, piece_ids array<int>, n_pieces long, round_trip boolean")


def _decoded(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in source:
            ids, valid = batch.column("piece_ids"), batch.column("piece_ids").is_valid().to_pylist()
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            texts = [coder.decode(flat[ends[k] : ends[k + 1]]) if valid[k] else None for k in range(batch.num_rows)]
            names = [c for c in batch.schema.names if c != "piece_ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return run


def decode_pieces(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the ``text`` of ``piece_ids``; null stays null."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_pieces(encoded.sparkSession, model))
    plain = encoded.select(*keep, "piece_ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(_decoded(sent), f"{kept}, text string")
