"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words, all of which are scored. The
input of a step is the word's own vector and the mean vector of its character
trigrams. A text's score is that of its worst window. Training is on the
driver, from a bounded sample; scoring runs in tasks over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, labelled_sample
from .words import ALPHANUMERIC, LOWER, Words, batches, mix, text_bytes, weights

#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 12
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 8, 8, 8
#: Labelled texts of each class learned from at most, and how.
SAMPLE, EPOCHS, BATCH, RATE, SEED = 1000, 4, 32, 0.01, 5
#: Windows scored at once.
AT_ONCE = 1024

_SCALE = weights(3, 31)


class Inputs:
    """Distinct words of some texts with their hash buckets, and the windows as numbers of distinct words; -1 is padding."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        words = Words(data, offsets, ALPHANUMERIC)
        unique, sample, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.word = (unique % np.uint64(WORD_BUCKETS)).astype(np.int64)
        start, length = words.start[sample], (words.end - words.start)[sample]
        # Trigrams over the word with one mark before and behind.
        total = length + 2
        head = np.cumsum(total) - total
        marked = np.full(int(total.sum()), 1, np.uint64)
        at = np.repeat(head + 1, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        marked[at] = data[np.repeat(start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)]
        self.gram_head = np.cumsum(length) - length
        gram = at - 1
        code = marked[gram] * _SCALE[0] + marked[gram + 1] * _SCALE[1] + marked[gram + 2] * _SCALE[2] if len(gram) else np.zeros(0, np.uint64)
        self.gram = (mix(code) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
        self.gram_count = length
        counts = np.diff(words.first)
        per_row = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
        self.first_window = np.concatenate(([0], np.cumsum(per_row)))
        row = np.repeat(np.arange(len(counts)), per_row)
        begin = words.first[row] + STRIDE * (np.arange(len(row)) - self.first_window[row])
        index = begin[:, None] + np.arange(WINDOW)
        inside = index < words.first[row + 1][:, None]
        self.windows = np.where(inside, number[np.minimum(index, max(len(number) - 1, 0))], -1) if len(row) else np.zeros((0, WINDOW), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and passes. Gates are in the order update, reset, candidate."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = WORD_SIZE + CHAR_SIZE

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_BUCKETS, WORD_SIZE, scale=0.1), "char": normal(CHAR_BUCKETS, CHAR_SIZE, scale=0.1)}
        for side in "fb":
            self.p |= {f"W{side}": normal(size, 3 * HIDDEN, scale=size**-0.5), f"U{side}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"Wa": normal(2 * HIDDEN, ATTENTION, scale=(2 * HIDDEN) ** -0.5), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION, scale=ATTENTION**-0.5), "wo": normal(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5), "bo": np.zeros(1, np.float32)}

    def embed(self, x: Inputs) -> np.ndarray:
        """One vector per distinct word."""
        if not len(x.word):
            return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
        chars = np.add.reduceat(self.p["char"][x.gram], x.gram_head, axis=0) / x.gram_count[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x.word], chars], axis=1)

    def _pass(self, side: str, projected: np.ndarray, mask: np.ndarray, cache: list | None) -> np.ndarray:
        """Hidden states (step, window, unit); padding leaves the state as it is."""
        steps, count = mask.shape
        h, u = np.zeros((count, HIDDEN), np.float32), self.p[f"U{side}"]
        out = np.empty((steps, count, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else reversed(range(steps)):
            x, own = projected[t], h @ u
            gate = _sigmoid(x[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            fresh = np.where(mask[t][:, None], n + z * (h - n), h)
            if cache is not None:
                cache.append((t, h, z, r, n, own[:, 2 * HIDDEN :]))
            h = out[t] = fresh
        return out

    def logits(self, vectors: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window; ``keep`` takes what the backward pass needs."""
        index = windows.T
        mask = index >= 0
        padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        states, caches = [], {}
        for side in "fb":
            caches[side] = [] if keep is not None else None
            projected = (padded @ self.p[f"W{side}"] + self.p[f"b{side}"])[index]
            states.append(self._pass(side, projected, mask, caches[side]))
        h = np.concatenate(states, axis=2)
        a = np.tanh(h @ self.p["Wa"] + self.p["ba"])
        e = np.where(mask, a @ self.p["va"], -1e9)
        share = np.exp(e - e.max(axis=0))
        share /= share.sum(axis=0)
        pooled = (share[..., None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"index": index, "mask": mask, "padded": padded, "caches": caches, "h": h, "a": a, "share": share, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"]

    def gradients(self, x: Inputs, keep: dict, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters by back-propagation through time."""
        h, a, share, mask = keep["h"], keep["a"], keep["share"], keep["mask"]
        g = {"wo": keep["pooled"].T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * self.p["wo"]
        dshare = (h * dpooled).sum(axis=2)
        de = share * (dshare - (share * dshare).sum(axis=0))
        g["va"] = np.einsum("tba,tb->a", a, de)
        da = de[..., None] * self.p["va"] * (1 - a**2)
        g["Wa"], g["ba"] = np.einsum("tbh,tba->ha", h, da), da.sum(axis=(0, 1))
        dh = share[..., None] * dpooled + da @ self.p["Wa"].T
        dpadded = np.zeros_like(keep["padded"])
        for k, side in enumerate("fb"):
            u, own = self.p[f"U{side}"], dh[..., k * HIDDEN : (k + 1) * HIDDEN]
            carry, du = np.zeros((mask.shape[1], HIDDEN), np.float32), np.zeros_like(u)
            dproj = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            for t, before, z, r, n, inner in reversed(keep["caches"][side]):
                total = carry + own[t]
                live = mask[t][:, None]
                dn = np.where(live, total * (1 - z) * (1 - n**2), 0)
                dz = np.where(live, total * (before - n) * z * (1 - z), 0)
                dr = dn * inner * r * (1 - r)
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
                drec = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ drec
                carry = np.where(live, total * z, total) + drec @ u.T
            flat = dproj.reshape(-1, 3 * HIDDEN)
            g[f"U{side}"], g[f"b{side}"] = du, flat.sum(axis=0)
            taken = keep["padded"][keep["index"]].reshape(len(flat), -1)
            g[f"W{side}"] = taken.T @ flat
            np.add.at(dpadded, keep["index"].ravel(), flat @ self.p[f"W{side}"].T)
        dvectors = dpadded[:-1]
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(g["word"], x.word, dvectors[:, :WORD_SIZE])
        np.add.at(g["char"], x.gram, np.repeat(dvectors[:, WORD_SIZE:] / x.gram_count[:, None], x.gram_count, axis=0))
        return g

    def worst(self, x: Inputs) -> np.ndarray:
        """Logit of the worst window of each text; -inf for a text without words."""
        rows, vectors = len(x.first_window) - 1, self.embed(x)
        each = np.concatenate([np.zeros(0, np.float32), *(self.logits(vectors, x.windows[k : k + AT_ONCE]) for k in range(0, len(x.windows), AT_ONCE))])
        out = np.full(rows, -np.inf, np.float32)
        has = np.flatnonzero(np.diff(x.first_window))
        if len(has):
            out[has] = np.maximum.reduceat(each, x.first_window[has])
        return out


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss of one window per text: a drawn one at first, then the worst. Classes weigh the same."""
    net, rng = Network(), np.random.default_rng(SEED)
    y = np.array([label for _, label in rows], np.float32)
    balance = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1))).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            x = Inputs(*text_bytes(pa.array([rows[k][0] for k in chosen], pa.string())))
            vectors = net.embed(x)
            if not len(x.windows):
                continue
            each = np.concatenate([net.logits(vectors, x.windows[k : k + AT_ONCE]) for k in range(0, len(x.windows), AT_ONCE)])
            picked, of = [], []
            for k in range(len(chosen)):
                own = each[x.first_window[k] : x.first_window[k + 1]]
                if len(own):
                    chance = np.exp(own - own.max())
                    at = int(own.argmax()) if epoch >= 2 else int(rng.choice(len(own), p=chance / chance.sum()))
                    picked.append(x.first_window[k] + at)
                    of.append(chosen[k])
            keep: dict = {}
            logit = net.logits(vectors, x.windows[picked], keep)
            wrong = ((_sigmoid(logit) - y[of]) * balance[of] / len(of)).astype(np.float32)
            step += 1
            for name, g in net.gradients(x, keep, wrong).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _scored(sent):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, empty = sent.value
        for batch, data, offsets in batches(source):
            worst = net.worst(Inputs(data, offsets)).astype(float)
            score = np.where(np.isinf(worst), empty, 1 / (1 + np.exp(-np.clip(worst, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Learns from at most ``per_class`` labelled texts of each class outside fold
    0 of 5. Texts without words (null too) score 0. With no class, or one
    class, to learn from every score is the share of label 1 (0 without
    labels). Repeated rows are scored one by one; a null id stays null; other
    columns are ignored.
    """
    rows = labelled_sample(docs, labels, "toxic", per_class)
    y = [label for _, label in rows]
    plain = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    if len(set(y)) < 2:
        constant = float(np.mean(y)) if y else 0.0
        return plain.select("doc_id", "held_out", F.lit(constant).alias("score"), F.lit(int(constant >= 0.5)).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast((train(rows, epochs), 0.0))
    return plain.mapInArrow(_scored(sent), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
