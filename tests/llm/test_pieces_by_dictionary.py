"""Pieces against a plain dictionary search over the same table, ids and ties included."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cohortloom.llm import pieces
from cohortloom.llm.lines import deduplicate_lines


def plain(text, scores, byte_ids, floor):
    """Best sum of scores; of equal sums the shortest last piece."""
    if not text:
        return []
    marked = "\u2581" + text.replace(" ", "\u2581")
    best = [(0.0, None, 0)] + [None] * len(marked)
    for end in range(1, len(marked) + 1):
        for width in range(1, min(end, 64) + 1):
            part = marked[end - width : end]
            if part in scores:
                piece, own = scores[part]
            elif width == 1:
                piece, own = None, floor
            else:
                continue
            if best[end] is None or best[end - width][0] + own > best[end][0]:
                best[end] = (best[end - width][0] + own, piece, width)
    out, end = [], len(marked)
    while end:
        _, piece, width = best[end]
        out[:0] = [piece] if piece is not None else [byte_ids[b] for b in marked[end - 1].encode()]
        end -= width
    return out


def test_ids_equal_a_dictionary_search(spark, monkeypatch):
    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    scores = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == 1}
    byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
    floor = min(s for _, s in scores.values()) - pieces.UNKNOWN_PENALTY
    draw = random.Random(2)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(25).collect()]
    texts = [t[:600] if t else t for t in texts] + ["", None, "  a  b ", "Zürich 日本 😀☃", "\u0000\n\t", "ab" * 90] + ["".join(draw.choice("abe rstion") for _ in range(80)) for _ in range(20)]
    table = pieces.load_pieces(spark, pieces.MODEL)
    want = [plain(t or "", scores, byte_ids, floor) for t in texts]
    for remembered in (pieces.REMEMBERED, 3):
        monkeypatch.setattr(pieces, "REMEMBERED", remembered)
        coder, got = pieces.Encoder(table), []
        # Several batches, so that words are looked up and forgotten.
        for begin in range(0, len(texts), 7):
            ids, count = coder.encode([t or "" for t in texts[begin : begin + 7]])
            got += [part.tolist() for part in np.split(ids, count.cumsum()[:-1])]
        assert got == want


def test_lines_beside_columns_of_any_name(spark):
    line = "one and the same line of several words"
    docs = spark.createDataFrame([(1, line, "a"), (2, line + "\nanother line that stays where it is", "b"), (2, line, "c"), (None, line, "d")], "doc_id long, text string, keep string")
    docs = docs.withColumns({c: F.lit("x") for c in ("_gone", "_doc", "line", "root", "n_lines", "at")})
    got = sorted((r["keep"], r["text"], r["n_removed"], r["_gone"], r["_doc"]) for r in deduplicate_lines(docs).collect())
    assert [g[0] for g in got] == ["a", "b", "c", "d"] and all(g[3:] == ("x", "x") for g in got)
    assert got[0][1] == line and got[3][1] == line and got[1][1] == "another line that stays where it is"


def test_words_of_all_lengths_are_looked_up_together(spark, monkeypatch):
    table, calls = pieces.load_pieces(spark, pieces.MODEL), []
    mix = pieces.mix
    monkeypatch.setattr(pieces, "mix", lambda x: calls.append(len(x)) or mix(x))
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcdefghij") for _ in range(size)) for size in range(1, 16))]
    ids, count = pieces.Encoder(table).encode(texts)
    assert pieces.Encoder(table).decode(ids) == texts[0] and count.tolist() == [len(ids)]
    # One look-up for each place, not one for each length, place and width.
    assert len(calls) <= 17
