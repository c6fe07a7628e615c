"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs of a step are a hashed word embedding and the mean of the word's hashed character n-gram
embeddings.  The network is trained in numpy on a bounded sample of labelled rows: a text is a bag
of windows, and its label belongs to its highest-scoring window.  Scoring runs over all overlapping
windows of the whole text, one at every word; the text's score is a calibrated function of the
highest window logit.

The input part of the gates depends on the word alone, so scoring keeps it in a bounded table of
words.  Texts lie end to end, so that step t of all windows is one slice of the gates, t words on.

Edge cases: null and empty texts are one empty window and get a score like any other; texts of fewer
words than a window are one window; very long texts are scored whole, in chunks of windows; an empty
training set scores every text 0; windows of equal logits count as one; repeated rows each give a row;
an empty table gives an empty table; extra columns, whatever their names, are not read, and
drop_toxic() hands them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import BATCH_ROWS, bounded_chunks, bounded_sample, fit_in_task, held_out, map_batches, share_code, within_chars
from waybill.llm.words import WordTable, mean_rows, subword_buckets

SIZES = (2, 3, 4)


@dataclass(frozen=True)
class ToxicityParams:
    """The bounds of training: rows a label, and characters of all rows (half for each label); ``skip``: starts that a training pass moves on by."""

    rows_per_label: int = 1000
    train_chars: int = 8_000_000
    window: int = 8
    skip: int = 4
    hidden: int = 8
    word_dim: int = 8
    char_dim: int = 8
    word_buckets: int = 1 << 15
    char_buckets: int = 1 << 13
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    cache_words: int = 100_000
    #: Windows scored at once, and characters of the texts that are read at once; they bound the memory of a task.
    chunk: int = 8192
    batch_chars: int = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def end_to_end(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of so many words begins when each takes ``window`` places at least, and the place of every word."""
    taken = np.maximum(sizes, window)
    base = np.cumsum(taken) - taken
    return base, np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Network:
    """Parameters, forward pass and back-propagation."""

    def __init__(self, p: ToxicityParams, seed: int = 11) -> None:
        rng, h, d = np.random.default_rng(seed), p.hidden, p.word_dim + p.char_dim
        self.p = p  # words that training never meets have an embedding of zero, so they add no noise
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"word": np.zeros((p.word_buckets, p.word_dim), np.float32), "char": small(p.char_buckets, p.char_dim) * np.float32(0.3)}
        for way in "fb":  # forward, backward
            self.w |= {f"x{way}": small(d, 3 * h), f"h{way}": small(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.w |= {"attend": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        """One row a word: its word embedding beside the mean of its character embeddings."""
        raw = [w.encode() for w in words]
        owner, bucket = subword_buckets(raw, SIZES, self.p.char_buckets)
        chars = mean_rows(owner, bucket, self.w["char"], len(words))
        return np.concatenate([self.w["word"][self.word_rows(raw)], chars], axis=1)

    def word_rows(self, raw: list[bytes]) -> np.ndarray:
        import zlib

        return np.fromiter((zlib.crc32(w) % self.p.word_buckets for w in raw), dtype=np.int64, count=len(raw))

    def gates(self, words: list[str]) -> np.ndarray:
        """Input part of both directions' gates, one row a word; what scoring keeps."""
        x = self.inputs(words)
        return np.concatenate([x @ self.w["xf"] + self.w["cf"], x @ self.w["xb"] + self.w["cb"]], axis=1)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row in the word table, and the n-gram buckets of word i at first[i]:first[i + 1]; n-grams of so many words at once."""
        buckets, counts = [], []
        for i in range(0, len(words), 20_000):
            owner, bucket = subword_buckets([w.encode() for w in words[i : i + 20_000]], SIZES, self.p.char_buckets)
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(words[i : i + 20_000])))
        return self.word_rows([w.encode() for w in words]), np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def all_gates(self, words: list[str]) -> np.ndarray:
        """gates() of any number of words, so many at once that the n-grams stay small."""
        out = np.empty((len(words), 6 * self.p.hidden), np.float32)
        for i in range(0, len(words), 20_000):
            out[i : i + 20_000] = self.gates(words[i : i + 20_000])
        return out

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits from gate inputs (6h, steps, windows) and a mask (steps, windows).

        Masked steps leave the state as it is and get no attention.  Windows are the last axis of every
        array, so that each operation runs over long contiguous rows.
        """
        _, steps, n = gates.shape
        h = self.p.hidden
        states = np.empty((2 * h, steps, n), np.float32)
        whole, trace = bool(mask.all()), {}
        for k, way in enumerate("fb"):
            hidden, state = np.ascontiguousarray(self.w[f"h{way}"].T), np.zeros((h, n), np.float32)
            kept = []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a = gates[3 * h * k : 3 * h * (k + 1), t]
                r = hidden @ state
                zr = r[: 2 * h] + a[: 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                z, reset = zr[:h], zr[h:]
                new = reset * r[2 * h :]
                new += a[2 * h :]
                np.tanh(new, out=new)
                m = mask[t]
                step = new - state
                step *= 1 - z
                if not whole:
                    step *= m
                if keep:
                    kept.append((t, state, z, reset, new, r[2 * h :], m))
                state = states[h * k : h * (k + 1), t] = state + step
            trace[way] = kept
        scores = np.tensordot(self.w["attend"], states, 1)
        if not whole:
            scores = np.where(mask > 0, scores, -1e9)
        share = np.exp(scores - scores.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,dtn->dn", share, states)
        logits = self.w["out"] @ pooled + self.w["bias"][0]
        return (logits, states, share, pooled, trace) if keep else logits

    def gradients(self, back: np.ndarray, states: np.ndarray, share: np.ndarray, pooled: np.ndarray, trace: dict, shape: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of all but the embeddings, and of the gate inputs, from d loss / d logits."""
        h, g = self.p.hidden, {}
        g["out"], g["bias"] = pooled @ back, np.array([back.sum()], np.float32)
        d_pooled = np.outer(self.w["out"], back)
        d_share = np.einsum("dn,dtn->tn", d_pooled, states)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["attend"] = np.einsum("tn,dtn->d", d_score, states)
        d_states = share * d_pooled[:, None] + d_score * self.w["attend"][:, None, None]
        d_gates = np.zeros(shape, np.float32)
        for k, way in enumerate("fb"):
            hidden = self.w[f"h{way}"]
            g[f"h{way}"], carried = np.zeros_like(hidden), 0.0
            for t, state, z, reset, new, inner, m in reversed(trace[way]):
                d = d_states[h * k : h * (k + 1), t] + carried
                dm = d * m
                d_new = dm * (1 - z) * (1 - new * new)
                d_z = -dm * (new - state) * z * (1 - z)
                d_reset = d_new * inner * reset * (1 - reset)
                d_r = np.concatenate([d_z, d_reset, d_new * reset])
                d_gates[3 * h * k : 3 * h * (k + 1), t] = np.concatenate([d_z, d_reset, d_new])
                g[f"h{way}"] += state @ d_r.T
                carried = d * (1 - m * (1 - z)) + hidden @ d_r
        return g, d_gates


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.t = w, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """``rows``: for tables, the rows that the gradient has; the others stay as they are."""
        self.t += 1
        fix = math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = rows.get(k, slice(None))
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.w[k][at] -= self.rate * fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)


def train_toxicity(rows: Iterable[tuple[str, int]], p: ToxicityParams = ToxicityParams()) -> Network:
    """Fit on (text, label) rows.

    The first pass takes for a toxic text the window with the word of the highest log odds; later
    passes take the window that the network itself scores highest, for either label.  A pass looks at
    every ``skip``-th start of a text, and the next pass at the starts beside them; the calibration
    looks at all.  Words become numbers as texts are read, so no text is held.
    """
    net, rng = Network(p), np.random.default_rng(5)
    number: dict[str, int] = {}
    coded, labels = [], []
    for text, label in sorted((t or "", int(y)) for t, y in rows):
        coded.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32))
        labels.append(label)
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        net.w["bias"][0] = -20.0 if not labels or labels[0] == 0 else 20.0
        net.w["out"][:] = 0
        return net
    vocabulary = list(number) or [""]
    del number
    seen = np.zeros((2, len(vocabulary)))
    for c, label in zip(coded, labels, strict=True):
        seen[label, np.unique(c)] += 1
    odds = (np.log((seen[1] + 0.5) / ((y == 1).sum() + 1)) - np.log((seen[0] + 0.5) / ((y == 0).sum() + 1))).astype(np.float32)
    sizes = np.array([len(c) for c in coded], np.int64)
    base, place = end_to_end(sizes, p.window)
    n_starts = np.maximum(sizes - p.window, 0) + 1
    total = int(base[-1] + max(sizes[-1], p.window))
    flat, real = np.zeros(total, np.int32), np.zeros(total, np.float32)
    flat[place], real[place] = np.concatenate(coded), 1
    del coded, place
    doc = np.repeat(np.arange(len(y), dtype=np.int32), n_starts)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    start = (base[doc] + offset).astype(np.int32)
    steps = np.arange(p.window)[:, None]

    word_rows, bucket, first = net.features(vocabulary)
    n_grams = np.maximum(np.diff(first), 1)
    adam = Adam(net.w, p.rate)

    def best(some: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of the windows ``some``, each text's first highest-scoring one."""
        of = doc[some]
        edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        hit = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, edge), np.diff(np.append(edge, len(of)))))
        return some[hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]]

    def logits(some: np.ndarray) -> np.ndarray:
        gates, out = np.ascontiguousarray(net.all_gates(vocabulary).T), np.empty(len(some), np.float32)
        for i in range(0, len(some), p.chunk):
            at = start[some[i : i + p.chunk]] + steps
            out[i : i + p.chunk] = net.run(gates[:, flat[at]], real[at])
        return out

    for epoch in range(p.epochs):
        some = np.flatnonzero(offset % p.skip == np.minimum(epoch % p.skip, n_starts[doc] - 1))
        if epoch == 0:  # pad places hold the first word of all, so they are left out
            score = np.max([np.where(real[start[some] + t] > 0, odds[flat[start[some] + t]], -9) for t in range(p.window)], axis=0)
        else:
            score = logits(some)
        chosen = best(some, score)
        clean = some[y[doc[some]] == 0]
        chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), len(chosen)), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), p.batch):
            at = chosen[i : i + p.batch]
            places = start[at] + steps
            used, local = np.unique(flat[places], return_inverse=True)
            local = local.reshape(p.window, len(at))
            n = first[used + 1] - first[used]
            grams = bucket[np.repeat(first[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            gram_owner = np.repeat(np.arange(len(used)), n)
            chars = np.zeros((len(used), p.char_dim), np.float32)
            for d in range(p.char_dim):
                chars[:, d] = np.bincount(gram_owner, weights=net.w["char"][grams, d], minlength=len(used)) / n_grams[used]
            x = np.concatenate([net.w["word"][word_rows[used]], chars], axis=1)
            gates = np.concatenate([x @ net.w["xf"] + net.w["cf"], x @ net.w["xb"] + net.w["cb"]], axis=1).T[:, local]
            out, *state = net.run(gates, real[places], keep=True)
            back = ((_sigmoid(out) - y[doc[at]]) / len(at)).astype(np.float32)
            grads, d_gates = net.gradients(back, *state, gates.shape)
            d_word = np.stack([np.bincount(local.ravel(), weights=g.ravel(), minlength=len(used)) for g in d_gates], axis=1).astype(np.float32)
            h3 = 3 * p.hidden
            grads |= {"xf": x.T @ d_word[:, :h3], "xb": x.T @ d_word[:, h3:], "cf": d_word[:, :h3].sum(axis=0), "cb": d_word[:, h3:].sum(axis=0)}
            d_x = d_word[:, :h3] @ net.w["xf"].T + d_word[:, h3:] @ net.w["xb"].T
            rows_w, where = np.unique(word_rows[used], return_inverse=True)
            rows_c, where_c = np.unique(grams, return_inverse=True)
            g_word, g_char = np.zeros((len(rows_w), p.word_dim), np.float32), np.zeros((len(rows_c), p.char_dim), np.float32)
            for d in range(p.word_dim):
                g_word[:, d] = np.bincount(where, weights=d_x[:, d], minlength=len(rows_w))
            for d in range(p.char_dim):
                g_char[:, d] = np.bincount(where_c, weights=(d_x[:, p.word_dim + d] / n_grams[used])[gram_owner], minlength=len(rows_c))
            adam.rate = p.rate * (1 - 0.8 * epoch / p.epochs)
            adam.step(grads | {"word": g_word, "char": g_char}, {"word": rows_w, "char": rows_c})
    _calibrate(net, np.maximum.reduceat(logits(np.arange(len(doc))), np.cumsum(n_starts) - n_starts), y)
    return net


def _calibrate(net: Network, top: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift of the highest logit, by Newton steps on the log loss."""
    weight = np.full(len(y), 1.0 / len(y))
    x = np.stack([top, np.ones_like(top)], axis=1).astype(np.float64)
    b = np.array([0.5, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ b)
        slope = x.T @ (weight * (q - y)) + 1e-4 * b
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(2)
        b = np.clip(b - np.linalg.solve(curve, slope), -50, 50)
    net.scale, net.shift = max(float(b[0]), 1e-3), float(b[1])


def sliding(rows: np.ndarray, window: int) -> np.ndarray:
    """View (..., window, n) of rows (..., n + window - 1): step t of window i is place i + t."""
    return as_strided(rows, (*rows.shape[:-1], window, rows.shape[-1] - window + 1), (*rows.strides, rows.strides[-1]), writeable=False)


class Scorer:
    def __init__(self, net: Network) -> None:
        self.net, self.p = net, net.p
        self.table = WordTable(net.gates, 6 * net.p.hidden, net.p.cache_words)

    def top_logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of each text's windows."""
        p, words = self.p, [words_of(t) for t in texts]
        sizes = np.array([len(ws) for ws in words], np.int64)
        base, place = end_to_end(sizes, p.window)
        total = int(base[-1] + max(sizes[-1], p.window))
        flat, real = np.zeros(total, np.int64), np.zeros(total, np.float32)
        flat[place], real[place] = self.table.look_up([w for ws in words for w in ws]), 1
        n = total - p.window + 1
        out = np.empty(n, np.float32)
        for i in range(0, n, p.chunk):
            k = min(p.chunk, n - i)
            some = slice(i, i + k + p.window - 1)
            gates = np.ascontiguousarray(self.table.rows[flat[some]].T)
            out[i : i + k] = self.net.run(sliding(gates, p.window), sliding(real[some], p.window))
        # windows that run on into the next text count for none
        out[np.concatenate([np.arange(b - p.window + 1, b) for b in base[1:]] or [[]]).astype(np.int64)] = -np.inf
        return np.maximum.reduceat(out, base)

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        raw = np.concatenate([self.top_logits(part) for part in bounded_chunks(texts, self.p.batch_chars)]).astype(np.float64) * self.net.scale + self.net.shift
        return _sigmoid(np.clip(raw, -60, 60)).tolist()


def training_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """The bounded sample of labelled rows of any length, none held out, balanced by label.

    A document with several labels counts as toxic if one of them says so; a null label counts as none.
    """
    toxic = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = bounded_sample(toxic.filter(~held_out(F.col("doc_id"))), "toxic", ["doc_id"], p.rows_per_label)
    # about rows_per_label rows a label, by the draw; one id may have many texts, so the rows that it finds are drawn again
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(drawn), "doc_id")
    rows = bounded_sample(rows, "toxic", ["doc_id", "text"], p.rows_per_label)
    return within_chars(rows, "toxic", ["doc_id", "text"], p.train_chars).select("text", "toxic")


def score_documents(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    net = fit_in_task(training_rows(docs, labels, p), lambda rows: train_toxicity(rows, p))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def make():
        scorer = Scorer(shared.value)

        def work(doc_id, out, text):
            score = scorer.scores(text)
            return {"doc_id": doc_id, "held_out": out, "score": score, "predicted": [int(s >= 0.5) for s in score]}

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under one half.  Rows pass through in place: no join, no shuffle."""
    net = fit_in_task(training_rows(docs, labels, p), lambda rows: train_toxicity(rows, p))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    share_code(docs.sparkSession)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                scores = scorer.scores(part.column("text").to_pylist())
                yield part.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
