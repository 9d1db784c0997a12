"""Words of whole texts as numpy arrays, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a piece of its own.
CHUNK_BYTES = 2 << 20

_BYTES = np.arange(256)
#: Every byte but the ASCII blanks.
NOT_BLANK = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Digits, lower-case ASCII letters and all bytes of other characters.
ALPHANUMERIC = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z; no other byte of UTF-8 changes.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(count: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE_VALUE = weights(256, 11)
_PLACE = weights(4096, 13)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[rows[0] : rows[-1]], rows - rows[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield begin, min(end, rows)
        begin = min(end, rows)


class Words:
    """Where the words of some texts lie, and a 64-bit hash of each.

    ``first`` has the number of the first word of each row, and the total.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashes: bool = True):
        inside = is_word[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        begins[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        ends[edge] = inside[edge]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = self._hash(data, np.flatnonzero(inside))

    def _hash(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        place = at - np.repeat(self.start, length)
        longest = int(length.max())
        scale = _PLACE[place] if longest <= len(_PLACE) else weights(longest, 13)[place]
        heads = np.concatenate(([0], np.cumsum(length)[:-1]))
        return mix(np.add.reduceat(_BYTE_VALUE[data[at]] * scale, heads) + length.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for the ``width`` words from each place on; row ends are the caller's matter."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    scale = weights(width, 17 + width)
    total = words[:count] * scale[0]
    for k in range(1, width):
        total += words[k : k + count] * scale[k]
    return mix(total)


def batches(source: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches in pieces of bounded text, with bytes and offsets of ``column``."""
    for batch in source:
        data, offsets = text_bytes(batch.column(column))
        for begin, end in pieces(offsets, limit):
            own = offsets[begin : end + 1]
            yield batch.slice(begin, end - begin), data[own[0] : own[-1]], own - own[0]


def whole_runs(source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold each run of equal, adjacent keys whole; the input is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
