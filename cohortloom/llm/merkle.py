"""Merkle manifest of a table of documents, with an inclusion proof for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import LOWER, UPPER
from .ranks import ranked
from .samples import fold
from .scratch import Scratch

#: Children of a node; paths are texts of digits to this base.
FAN = 8
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row, with another ``text`` if given. Every field says its length, so fields cannot run into each other."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*(field(F.col(c) if c != "text" or text is None else text) for c in FIELDS))


def digits(rank: Column, total: Column) -> Column:
    """The path to a place among ``total`` in a tree of least depth; empty if it is alone."""
    depth = F.when(total > 1, F.length(F.conv((total - 1).cast("string"), 10, FAN))).otherwise(0)
    return F.when(total > 1, F.lpad(F.conv(rank.cast("string"), 10, FAN), depth, "0")).otherwise("")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``path``, ``leaf``, ``forged`` and the id of every row. ``records``: ``digest`` -> ``children``.

    ``root``: one row with the ``digest``. ``deep``: length of the longest path;
    ``wide``: length of the part of each path that names the group.
    """

    leaves: DataFrame
    records: DataFrame
    root: DataFrame
    deep: int
    wide: int


def _leaves(docs: DataFrame, tampered: Column, scratch: Scratch) -> tuple[DataFrame, int]:
    docs = docs.select("doc_id", F.col("source"), F.col("lang").cast("string").alias("lang"), "n_chars", F.col("text").cast("string").alias("text"))
    forged = F.when(tampered, leaf_digest(F.translate("text", UPPER, LOWER)))
    hashed = scratch.keep(docs.select("doc_id", "lang", leaf_digest().alias("leaf"), forged.alias("forged")))
    placed = ranked(hashed, ["lang"], [F.col("doc_id"), F.col("leaf")], scratch)
    groups = scratch.keep(placed.groupBy("lang").agg(F.max("total").alias("total")).withColumnRenamed("total", "leaves"))
    named = scratch.keep(ranked(groups, [], [F.col("lang")], scratch).select(F.col("lang").alias("_lang"), digits(F.col("rank"), F.col("total")).alias("head")))
    wide = named.agg(F.max(F.length("head"))).first()[0] or 0
    path = F.concat("head", digits(F.col("rank"), F.col("total")))
    leaves = placed.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select("doc_id", path.alias("path"), "leaf", "forged")
    return scratch.keep(leaves), wide


def build_manifest(docs: DataFrame, tampered: Column | None = None, scratch: Scratch | None = None) -> Manifest:
    """The tree of each ``lang`` and the tree of these trees, folded level by level.

    A node has at most ``FAN`` children, so no group grows. A level is a
    fraction of the one below, so all levels together cost little more than the
    first. ``forged`` of the leaves is the digest of the row with its text
    lower-cased where ``tampered`` holds, else null.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    leaves, wide = _leaves(docs, F.lit(False) if tampered is None else tampered, scratch)
    deep = leaves.agg(F.max(F.length("path"))).first()[0] or 0
    nodes, levels = leaves.where(F.length("path") == deep).select("path", F.col("leaf").alias("digest")), []
    for depth in range(deep - 1, -1, -1):
        runs = nodes.groupBy(F.substring("path", 1, depth).alias("path")).agg(F.sort_array(F.collect_list(F.struct("path", "digest"))).alias("run"))
        children = F.transform("run", lambda c: c["digest"])
        level = scratch.keep(runs.select("path", children.alias("children")).withColumn("digest", digest(F.array_join("children", ""))))
        levels.append(level)
        nodes = level.select("path", "digest").union(leaves.where(F.length("path") == depth).select("path", F.col("leaf").alias("digest")))
    store = levels[0] if levels else None
    for level in levels[1:]:
        store = store.union(level)
    if store is None:
        store = leaves.where("false").select("path", F.array("leaf").alias("children"), F.col("leaf").alias("digest"))
    records = scratch.keep(store.select("digest", "children").dropDuplicates(["digest"]))
    return Manifest(leaves, records, nodes.select("digest"), deep, wide)


def _descend(manifest: Manifest, requests: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``at``, ``children``, ``segments``, ``subroot``, ``root``: the records on the way to the requested paths.

    Requests that share their first digits go on as one; ``segments`` holds the
    siblings left and right of the way, from the root down.
    """
    wanted = scratch.keep(requests.where(F.length("path") > 0).select(F.expr("substring(path, 1, length(path) - 1)").alias("at")).distinct())
    empty = F.array().cast("array<struct<left:string,right:string>>")
    now = manifest.root.select(F.lit("").alias("at"), "digest", empty.alias("segments"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    found = []
    for depth in range(manifest.deep):
        if depth == manifest.wide:
            now = now.withColumn("subroot", F.col("digest"))
        met = scratch.keep(now.join(manifest.records, "digest").drop("digest"))
        found.append(met)
        if depth + 1 == manifest.deep:
            break
        # Each way that goes on takes one child along and leaves the others as siblings.
        ways = wanted.where(F.length("at") > depth).select(F.substring("at", 1, depth + 1).alias("next")).distinct()
        digit = F.substring("next", depth + 1, 1).cast("int")
        now = met.join(ways, F.col("at") == F.substring("next", 1, depth)).select(
            F.col("next").alias("at"), F.col("children")[digit].alias("digest"), F.concat("segments", F.array(_segment("children", digit))).alias("segments"), "subroot", "root"
        )
    out = None
    for met in found:
        out = met if out is None else out.unionByName(met)
    return out


def _segment(children: str, digit: Column) -> Column:
    left, right = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.lit(FAN))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def prove(manifest: Manifest, requests: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``forged``, ``subroot``, ``root``, ``proof`` (``left``, ``right`` of each level, leaf upwards) for the requested rows of ``leaves``; all by default."""
    requests = manifest.leaves if requests is None else requests
    scratch = scratch or Scratch(requests.sparkSession)
    # An only leaf is the root, and nothing is above it.
    alone = requests.where(F.length("path") == 0).select("doc_id", "leaf", "forged", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    ways = _descend(manifest, requests, scratch)
    if ways is None:
        return alone
    digit = F.substring("path", -1, 1).cast("int")
    met = requests.where(F.length("path") > 0).join(ways, F.expr("substring(path, 1, length(path) - 1) = at"))
    subroot = F.when(F.length("path") == manifest.wide, F.col("leaf")).otherwise(F.col("subroot"))
    return met.select("doc_id", "leaf", "forged", subroot.alias("subroot"), "root", F.reverse(F.concat("segments", F.array(_segment("children", digit)))).alias("proof"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a ``lang`` ascend by ``doc_id``, null ids first; of equal ids the
    smaller digest comes first, so repeated rows are leaves of their own with
    one digest. A null ``lang`` is a group of its own, before all others. A
    null field hashes as ``-``, unlike an empty one. Rows whose id is divisible
    by 3 under CRC-32 are tampered with by lower-casing A-Z; a null id is not.
    ``folded_root`` is what the (tampered) leaf and the original siblings give.
    An only row is leaf, subroot and root with an empty proof; without rows
    there is no result. Texts are read whole, once; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    tampered = F.coalesce(fold("doc_id", 3) == 0, F.lit(False))
    told = prove(build_manifest(docs, tampered, scratch), scratch=scratch)
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("proof", F.coalesce("forged", "leaf"), lambda up, s: digest(s["left"], up, s["right"]))
    out = told.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
