"""Manifest, hard negatives and order-sensitive fingerprints against brute force on small hard tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import negatives
from cohortloom.llm.merkle import build_manifest, prove, verified_manifest
from cohortloom.llm.negatives import hard_negatives
from cohortloom.llm.order_minhash import edit_fingerprints
from cohortloom.llm.ranks import ranked
from cohortloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, rank string, key string, leaf string, total string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "p", "r", "k", "l", "t") for r in rows], DOCS)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def mixed_rows(seed=3):
    draw = random.Random(seed)
    rows = [(k, draw.choice(["Some Text", "über Ärger", "", None, "x" * draw.randrange(50), "ABC abc"]), draw.choice(["en", "de", "én", None]), draw.choice(["web", None, ""]), draw.choice([3, None, 0])) for k in range(150)]
    rows += [(7, "Twice", "en", "web", 5), (7, "Twice", "en", "web", 5), (7, "other", "en", "web", 5), (None, "No Id", "en", None, None), (None, None, None, None, None), (-4, "Below", "de", None, 1), (400, "Alone", "zz", "s", 1), (401, "long " * 20000, "de", "s", 1)]
    draw.shuffle(rows)
    return rows


def brute_manifest(rows):
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    low = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())

    def climb(nodes):
        """The root, and for each node its siblings left and right on the way up."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
                ways[k].append((run[: place % 8], run[place % 8 + 1 :]))
            nodes, at = [sha(*nodes[b : b + 8]) for b in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], ways

    def tampered(r):
        text = lower(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        return leaf(r, text)

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=low)
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (low(r[0]), leaf(r, r[1])))
        trees[lang] = (own, *climb([leaf(r, r[1]) for r in own]))
    root, tops = climb([trees[lang][1] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        own, subroot, ways = trees[lang]
        for r, way in zip(own, ways, strict=True):
            up, proof = tampered(r), ""
            for left, right in way + tops[k]:
                proof += "".join(left + right)
                up = sha(*left, up, *right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha(proof), up, up == root))
    return out


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [mixed_rows(), mixed_rows()[:1], [(k, "T", f"l{k % 70}", None, None) for k in range(100)], [(k, "T", None, None, None) for k in range(65)], [(k, "T", "a", None, None) for k in range(8)] + [(9, "T", "b", None, None)]])
def test_manifest_is_brute_force(spark, rows):
    assert told(verified_manifest(make(spark, rows))) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_nothing_and_some_requests(spark):
    assert told(verified_manifest(make(spark, mixed_rows()[:0]))) == []
    docs = make(spark, [(k, f"t{k}", "a" if k < 100 else "b", None, None) for k in range(120)])
    manifest = build_manifest(docs)
    asked = manifest.leaves.where("doc_id in (0, 63, 64, 119)")
    got = {r["doc_id"]: r for r in prove(manifest, asked).collect()}
    want = {r["doc_id"]: r for r in prove(manifest).collect()}
    assert set(got) == {0, 63, 64, 119} and all(got[k] == want[k] for k in got)
    assert manifest.records.count() == manifest.records.select("digest").distinct().count()


def test_ranks_over_many_partitions(spark):
    rows = [(k % 3 if k % 5 else None, (k * 37) % 100) for k in range(200)]
    table = spark.createDataFrame(rows, "g int, v int").repartition(7)
    got = [tuple(r) for r in ranked(table, ["g"], [F.desc("v")], Scratch(spark)).collect()]
    for group in {g for g, _ in rows}:
        own = sorted((r for r in got if r[0] == group), key=lambda r: r[2])
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
        assert [r[1] for r in own] == sorted((v for g, v in rows if g == group), reverse=True)


VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string, code string"


def brute_negatives(rows):
    taking = set()
    for vec_id, vector, label in rows:
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            taking.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for a in taking:
        if a[0] % 100:
            continue
        score = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in taking if b[0] != a[0])
        for s, positive, _ in [x for x in score if x[2] == a[1]][:5]:
            found = [x for x in score if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], positive, k + 1, x[1], -s, -x[0]) for k, x in enumerate(found)]
    return sorted(out)


def vector_rows(width, count=900, seed=5):
    draw = np.random.default_rng(seed)
    centers = draw.standard_normal((6, width))
    rows = []
    for k in range(count):
        v = centers[k % 6] + draw.standard_normal(width) * draw.choice([0.1, 0.8, 2.0])
        rows.append((k, [float(x) for x in v], int(draw.integers(0, 4))))
    rows += [(k + 1000, list(rows[k][1]), rows[k][2]) for k in range(60)]
    rows += [rows[0], rows[100], (200, [0.5] * width, 1), (1100, [0.0] * width, 2), (1300, [1.0], 3), (1400, [], 0), (None, rows[3][1], 1), (1500, None, 1), (1600, rows[4][1], None)]
    rows += [(1700, [math.nan] * width, 1), (1800, [math.inf] + [0.0] * (width - 1), 1), (1900, [None] + [0.0] * (width - 1), 1), (-100, rows[5][1], 2)]
    return rows


@pytest.mark.parametrize("width", [3, 64, 100])
def test_negatives_are_brute_force(spark, monkeypatch, width):
    rows = vector_rows(width)
    table = spark.createDataFrame([(*r, "s", "r", "c") for r in rows], VECTORS).repartition(5)
    want = brute_negatives(rows)
    assert want and sorted(map(tuple, hard_negatives(table).collect())) == want
    # Anchors in several passes, and pairs scored one by one instead of in blocks.
    monkeypatch.setattr(negatives, "PASS_BYTES", 4 * 8 * width)
    monkeypatch.setattr(negatives, "DENSE", 1.1)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 50)
    assert sorted(map(tuple, hard_negatives(table).collect())) == want


def test_negatives_of_large_values_and_nothing(spark):
    rows = [(100 * k, [float(3e6 + k), float(-2e6 * k)], k % 2) for k in range(8)]
    table = spark.createDataFrame([(*r, "s", "r", "c") for r in rows], VECTORS)
    assert sorted(map(tuple, hard_negatives(table).collect())) == brute_negatives(rows)
    assert hard_negatives(table.limit(0)).collect() == [] and hard_negatives(table.where("vec_id = 100")).collect() == []


@pytest.mark.parametrize("width", [1, 64, 130])
def test_bounds_hold_every_product(width):
    draw = np.random.default_rng(width)
    turn = negatives.rotation(width)
    assert np.allclose(turn @ turn.T, np.eye(width))
    rows = draw.integers(-300, 300, (400, width)) * draw.choice([0, 1, 20], (400, 1))
    anchors = np.vstack([rows[:20], draw.integers(-300, 300, (40, width))])
    length, near = negatives.alignment(rows @ turn)
    code = negatives.codes(rows @ turn)
    low, high = negatives.Planes(anchors @ turn).bounds(slice(0, 60), code, np.bitwise_count(code).sum(axis=1).astype(float), length, near)
    product = anchors @ rows.T
    assert (low <= product).all() and (product <= high).all()
    # They are worth something: far closer than the lengths alone.
    assert width < 64 or (high - low).mean() < 1.5 * (np.linalg.norm(anchors, axis=1)[:, None] * length).mean()


MASK = (1 << 64) - 1


def spark_hash(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute_fingerprint(text):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    symbols = [spark_hash(s) for s in re.findall(r"[!-~\xa1-෿]{1,24}|[^ \t\n\x0b\f\r]", text)]
    seen, bins = {}, {}
    for k in range(len(symbols)):
        kmer = spark_hash(*((signed(h), 8) for h in symbols[k : k + 3])) >> 29
        number = seen[kmer] = seen.get(kmer, -1) + 1
        order = (kmer if number == 0 else spark_hash((kmer, 8), (number, 4))) & ((1 << 30) - 1)
        bins.setdefault(kmer >> 30, []).append((order, kmer, number, k))
    out = ""
    for b in range(32):
        chosen = sorted(sorted(bins.get(b, []))[:2], key=lambda x: x[3])
        out += f"{spark_hash(*(v for x in chosen for v in ((x[1], 8), (x[2], 4)))):016x}"[:8] if chosen else "." * 8
    return out


def fingerprint_rows():
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "日本語", "x" * 60, "!", "né"]
    rows = [(k * 3, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 3, 9, 200, 900])))) for k in range(40)]
    line = "the same line again and again\n"
    rows += [(500, line * 100), (501, line * 50), (502, None), (503, ""), (504, "  \n"), (505, "one"), (506, "one two three"), (507, "😀" * 40), (508, rows[3][1]), (509, "long text " * 20000), (-5, "last of all ids with words " * 9), (None, "a row without an id " * 5)]
    return rows + [rows[5], (6, "another text for this id")]


def test_fingerprints_are_brute_force(spark):
    rows = fingerprint_rows()
    got = told(edit_fingerprints(make(spark, [(k, t, "en", None, None) for k, t in rows]).repartition(4)))
    key = lambda r: hashlib.sha256(f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()
    plain = [(k, t or "") for k, t in rows]
    distinct = sorted(set(plain), key=lambda r: (r[0] is None, -(r[0] or 0), key(r)))
    prints = {r: brute_fingerprint(r[1]) for r in distinct}

    def near(a, b):
        x, y = ([f[k : k + 8] for k in range(0, 256, 8)] for f in (a, b))
        filled = sum(p != "." * 8 or q != "." * 8 for p, q in zip(x, y, strict=True))
        return 1.0 if a == b else sum(p == q != "." * 8 for p, q in zip(x, y, strict=True)) / max(filled, 1)

    want = []
    for k, r in enumerate(distinct):
        following = distinct[(k + 1) % len(distinct)]
        need = len(r[1]) // 3
        edited = r[1][: len(r[1]) - need] + following[1][:need]
        own = (r[0], len(r[1]), hashlib.sha256(edited.encode()).hexdigest(), prints[r], brute_fingerprint(edited), near(prints[r], brute_fingerprint(edited)), near(prints[r], prints[following]))
        want += [own] * plain.count(r)
    assert got == sorted(want, key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[508][3] == by_id[9][3] and by_id[503][3] == "." * 256
    # Half the repetitions are another text, though it has the same k-mers.
    assert near(by_id[500][3], by_id[501][3]) < 0.8


def test_fingerprints_of_few_rows(spark):
    assert edit_fingerprints(make(spark, [(1, "t", "en", None, None)]).limit(0)).collect() == []
    alone = edit_fingerprints(make(spark, [(1, "only one document", "en", None, None)])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprints_are_native(spark):
    plan = edit_fingerprints(make(spark, [(1, "t", "en", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
