"""Near-duplicate documents by an exact Jaccard join over word n-grams.

How no link is lost without comparing all pairs:

1.  Equal sets form one class. An n-gram that only one class has cannot be in
    an intersection. Over a fixed fraction of the hash range the classes of
    every n-gram are counted exactly; a class whose unshared n-grams alone
    exceed a fifth of its set links with nothing and leaves.
2.  The sets that remain are split by hash into segments of about 64 n-grams,
    whose number follows from the size band. If two sets reach the threshold,
    so does at least one pair of their segments (the total is a weighted mean),
    and that pair shares an n-gram of its two prefixes. Each prefix n-gram is
    sent on with a 128-bit hashed bitmap of its segment, so a row has the same
    size for long documents. In a tile (one n-gram, sorted by size) pairs of
    fitting sizes stay if the bit counts leave an intersection possible. A tile
    returns a spanning forest, never its pairs. Frequent n-grams come last in
    the order, so common lines and passages form no large tiles.
3.  The candidate components are cut into size-banded tiles of bounded size.
    Bitmaps as wide as the sets bound each overlap from above, and exact
    intersection of the sorted arrays decides. Every pair meets in one tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import LOWER, NOT_BLANK, Words, batches, mix, whole_runs, window_hashes

#: The part of the hash range in which n-grams are counted.
COUNTED = 0.3
#: N-grams aimed at in a segment.
SEGMENT = 64
#: The most frequent n-grams that are moved to the end of the order: a bound of the broadcast, not of the result.
FREQUENT = 100_000
#: Sets on one side of a tile.
TILE = 512
#: Rows up to which a list of ids is broadcast (16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: A little over 100 / 80, so that rounding cannot put fitting sizes two bands apart.
_SIZE_BASE = 1.26


def _sets_of(words: Words, rows: int, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    grams = window_hashes(words.hash, width)
    out = []
    for row in range(rows):
        begin, end = int(words.first[row]), int(words.first[row + 1])
        if end - begin >= width:
            out.append(np.unique(grams[begin : end - width + 1]))
        elif end > begin:
            out.append(window_hashes(words.hash[begin:end], end - begin))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _identity(grams: np.ndarray) -> int:
    """One 64-bit value for a set; 0 for the empty set."""
    return int(mix(np.array([mix(grams ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0]) if len(grams) else 0


def _describe(width: int):
    top = np.uint64(int(COUNTED * 2**64))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(source):
            sets = _sets_of(Words(LOWER[data], offsets, NOT_BLANK), batch.num_rows, width)
            parts = [s[: np.searchsorted(s, top)].view(np.int64) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_identity(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(ends, np.concatenate(parts) if parts else np.zeros(0, np.int64)),
                ],
                names=["doc_id", "n_shingles", "set_id", "counted"],
            )

    return run


def _full_sets(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in batches(source):
            sets = _sets_of(Words(LOWER[data], offsets, NOT_BLANK), batch.num_rows, width)
            own = pa.array([_identity(s) for s in sets], pa.int64())
            kept = pa.RecordBatch.from_arrays(
                [own, batch.column("copies"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["set_id", "copies", "n", "grams"],
            )
            yield kept.filter(pa.compute.equal(own, batch.column("wanted")))

    return run


def _levels(n: int) -> set[int]:
    """How many segments a set of ``n`` takes; two numbers if a partner may have the lower one."""
    return {max(1, 1 << max(0, (x // SEGMENT).bit_length() - 1)) for x in (n, -(-4 * n // 5))}


def _segment_rows(frequent: np.ndarray, percent: int):
    """The prefix n-grams of every segment, each with size and bitmap of its segment."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for set_id, n, raw in zip(batch.column("set_id").to_pylist(), batch.column("n").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                grams = np.frombuffer(raw, np.uint64)
                late = np.zeros(n, bool)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
                for level in _levels(n):
                    segment = (grams & np.uint64(level - 1)).astype(np.int64)
                    order = np.lexsort((grams, late, segment))
                    grams_, segment = grams[order], segment[order]
                    head = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
                    size = np.diff(np.append(head, n))
                    prefix = size - -(-percent * size // 100) + 1
                    rank = np.arange(n) - np.repeat(head, size)
                    bit = (grams_ >> np.uint64(20)) & np.uint64(127)
                    one = np.uint64(1) << (bit & np.uint64(63))
                    low = np.bitwise_or.reduceat(np.where(bit < 64, one, np.uint64(0)), head)
                    high = np.bitwise_or.reduceat(np.where(bit >= 64, one, np.uint64(0)), head)
                    take = rank < np.repeat(prefix, size)
                    at = np.repeat(np.arange(len(head)), size)[take]
                    key = mix(grams_[take] + np.uint64(level))
                    for column, values in zip(columns, (key.view(np.int64), np.full(len(key), set_id), np.full(len(key), n, np.int32), size[at].astype(np.int32), low[at].view(np.int64), high[at].view(np.int64)), strict=True):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "set_id", "n", "part", "low", "high"])

    return run


class _Forest:
    """Union-find over the rows of a table, with vectorised tests of equal roots."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Unites pairs; returns those that were apart."""
        new = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                new.append((x, y))
        if new:
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
        return new


def _possible(size: np.ndarray, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of at most (size - differing) / 2 can reach the threshold; size: of both sets together."""
    return (100 + percent) * (size - differing) >= 2 * percent * size


def _tile_edges(percent: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(source, "key"):
            key, ids, n, part, low, high = (table.column(c).to_numpy() for c in ("key", "set_id", "n", "part", "low", "high"))
            same = key[1:] == key[:-1]
            busy = np.concatenate((same, [False])) | np.concatenate(([False], same))
            key, ids, n, part, low, high = (x[busy] for x in (key, ids, n, part, low, high))
            n, part = n.astype(np.int64), part.astype(np.int64)
            # Bit counts of signed numbers are those of their absolute values.
            low, high = low.view(np.uint64), high.view(np.uint64)
            forest, found, at, step = _Forest(len(key)), [], np.arange(len(key)), 1
            while len(at):
                at = at[at + step < len(key)]
                other = at + step
                at = at[(key[at] == key[other]) & (100 * n[at] >= percent * n[other])]
                other = at + step
                fit = (100 * np.minimum(part[at], part[other]) >= percent * np.maximum(part[at], part[other])) & forest.apart(at, other) & (ids[at] != ids[other])
                a, b = at[fit], other[fit]
                differing = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
                fit = _possible(part[a] + part[b], differing, percent)
                found += forest.join(a[fit], b[fit])
                step += 1
            if found:
                pairs = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["u", "v"])

    return run


def _verified(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, grams: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of one tile: per set the number of linked documents, and a spanning forest. Pairs are between the sides, or within side 0 if there is no other."""
    order = np.argsort([len(g) for g in grams], kind="stable")
    size = np.array([len(grams[k]) for k in order])
    wide = max(64, 1 << int(size[-1] - 1).bit_length())
    tokens, local = np.unique(np.concatenate([grams[k] for k in order]), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    bits = np.zeros((len(order), wide // 64), np.uint64)
    place = mix(tokens)[local] % np.uint64(wide)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(order)), size), (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    links, forest, edges = np.zeros(len(order), np.int64), _Forest(len(order)), []
    one_side, mark = side.min() == side.max(), np.zeros(len(tokens), bool)
    for a in range(len(order) - 1):
        last = int(np.searchsorted(size, 100 * size[a] // percent, side="right"))
        b = np.arange(a + 1, last)
        if not one_side:
            b = b[side[order[b]] != side[order[a]]]
        if not len(b):
            continue
        differing = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype=np.int64)
        b = b[_possible(size[b] + size[a], differing, percent)]
        if not len(b):
            continue
        mark[local[first[a] : first[a + 1]]] = True
        spans = np.concatenate([np.arange(first[k], first[k + 1]) for k in b])
        common = np.add.reduceat(mark[local[spans]].astype(np.int64), np.concatenate(([0], np.cumsum(size[b])[:-1])))
        mark[local[first[a] : first[a + 1]]] = False
        b = b[100 * common >= percent * (size[b] + size[a] - common)]
        links[a] += copies[order[b]].sum()
        links[b] += copies[order[a]]
        b = b[forest.apart(np.full(len(b), a), b)]
        edges += [(order[x], order[y]) for x, y in forest.join(np.full(len(b), a), b)]
    back = np.empty(len(order), np.int64)
    back[order] = links
    return back, edges


def _tile_links(percent: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(source, "tile"):
            tile = table.column("tile").to_numpy()
            ids, copies, side = (table.column(c).to_numpy() for c in ("set_id", "copies", "side"))
            raw = table.column("grams")
            cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
            out: tuple[list, list, list] = ([], [], [])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                # Rows with one id and several texts can bring a set twice.
                _, own = np.unique(ids[begin:end], return_index=True)
                own += begin
                if len(own) < 2:
                    continue
                grams = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in own]
                links, edges = _verified(ids[own], copies[own], side[own], grams, percent)
                linked = np.flatnonzero(links)
                out[0].extend(ids[own][linked].tolist())
                out[1].extend([None] * len(linked))
                out[2].extend(links[linked].tolist())
                for a, b in edges:
                    out[0].append(int(ids[own[a]]))
                    out[1].append(int(ids[own[b]]))
                    out[2].append(0)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["set_id", "other", "links"])

    return run


def _tiled(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Deals the sets of each candidate component to tiles of at most about 2 x TILE sets.

    A component of up to TILE sets is one tile. A larger one is dealt by size
    band and, in a band, by hash to parts; a part meets the parts of its own
    band and of the next, because bands are a factor of over 1.25 apart.
    """
    band = F.floor(F.log(_SIZE_BASE, F.col("n"))).cast("int")
    placed = sets.join(groups, sets.set_id == groups.node).select("set_id", "copies", "n", "grams", F.col("root").alias("comp"), band.alias("band"))
    slim = sets.select("set_id", "n").join(groups, sets.set_id == groups.node).select(F.col("root").alias("comp"), band.alias("band"))
    counts = slim.groupBy("comp", "band").agg(F.count("*").alias("here"))
    parts = counts.groupBy("comp").agg(F.sum("here").alias("members"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("here") / TILE).cast("int")))).alias("parts"))
    shares = placed.join(parts, "comp")
    part = F.pmod(F.xxhash64("set_id"), F.col("parts")[F.col("band")]).cast("int")
    shares = shares.withColumn("part", F.when(F.col("members") > TILE, part).otherwise(0))
    own, none = F.col("band"), F.array().cast("array<struct<b1:int,p1:int,b2:int,p2:int,side:int>>")

    def tile(b1, p1, b2, p2, side):
        return F.struct(b1.cast("int").alias("b1"), p1.cast("int").alias("p1"), b2.cast("int").alias("b2"), p2.cast("int").alias("p2"), side.cast("int").alias("side"))

    def others(of):
        count = F.coalesce(F.col("parts")[of], F.lit(0))
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    p = F.col("part")
    within = F.transform(others(own), lambda q: tile(own, F.least(p, q), own, F.greatest(p, q), F.when(p > q, 1).otherwise(0)))
    above = F.transform(others(own + 1), lambda q: tile(own, p, own + 1, q, F.lit(0)))
    below = F.transform(others(own - 1), lambda q: tile(own - 1, q, own, p, F.lit(1)))
    single = F.array(tile(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    spread = F.when(F.col("members") > TILE, F.concat(within, above, below, none)).otherwise(single)
    dealt = shares.select("set_id", "copies", "grams", "comp", F.explode(spread).alias("t"))
    return dealt.select(F.xxhash64("comp", "t.b1", "t.p1", "t.b2", "t.p2").alias("tile"), "set_id", "copies", F.col("t.side").alias("side"), "grams")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``.

    Words are runs of anything but ASCII blanks, with A-Z in lower case. A set
    holds the distinct ``width``-word shingles; a text of fewer words is one
    shingle, a text without words or null has the empty set and no links. Two
    documents link when ``100 * intersection >= percent * union``; ``percent``
    is at least 80. ``component_id`` is the least ``doc_id`` reachable,
    ``n_links`` the number of other documents linked directly, equal texts
    included. A null ``doc_id`` keeps its row and never names a component that
    has another id. Repeated rows count as documents of their own; other
    columns are ignored. Shingles are 64-bit hashes.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.keep(docs.mapInArrow(_describe(width), "doc_id long, n_shingles long, set_id long, counted array<long>"))
    filled = sets.where("n_shingles > 0")
    classes = scratch.keep(filled.groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max(F.size("counted")).alias("seen")))
    grams = filled.select("set_id", F.explode("counted").alias("gram"))
    shared = scratch.keep(grams.groupBy("gram").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi"), F.count("*").alias("times")).where("lo <> hi").select("gram", "times"))
    frequent = np.array([r[0] for r in shared.where(F.col("times") > 64).orderBy(F.desc("times"), "gram").limit(FREQUENT).select("gram").collect()], np.int64)
    met = grams.join(shared, "gram").groupBy("set_id").agg(F.count("*").alias("met"))
    # Unshared n-grams are at most (100 - percent) % of a set that links; those without shared ones stay only if none was counted.
    alone = F.col("seen") - F.coalesce(F.col("met"), F.lit(0)) / F.col("copies")
    possible = scratch.keep(classes.join(met, "set_id", "left").where(100 * alone <= (100 - percent) * F.col("n_shingles")).select(F.col("set_id").alias("wanted"), "first", "copies"))
    scratch.drop(shared)
    small = possible.count() <= BROADCAST_ROWS
    wanted = F.broadcast(possible) if small else possible
    full = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "wanted", "copies")
    full = scratch.keep(full.mapInArrow(_full_sets(width), "set_id long, copies long, n int, grams binary"))
    rows = full.mapInArrow(_segment_rows(np.sort(frequent.view(np.uint64)), percent), "key long, set_id long, n int, part int, low long, high long")
    edges = rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_tile_edges(percent), "u long, v long")
    groups = components(edges, scratch)
    tiles = _tiled(full, groups).repartition("tile").sortWithinPartitions("tile")
    links = scratch.keep(tiles.mapInArrow(_tile_links(percent), "set_id long, other long, links long"))
    roots = scratch.keep(components(links.where("other is not null").select(F.col("set_id").alias("u"), F.col("other").alias("v")), scratch))
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    members = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    told = members.join(least, "root").join(counted, "set_id", "left").select("set_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = scratch.keep(told)
    scratch.drop(classes, possible, full, links, roots)
    out = sets.select("doc_id", "n_shingles", "set_id").join(told, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
