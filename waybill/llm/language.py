"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training is stochastic gradient descent in numpy on a bounded, documented sample of labelled rows.
Scoring uses the linearity of the model: the embedding table times the class weights is a small
table of logits, a word's logits are the mean over its subwords, a text's are the mean over its
words.  Confidence is calibrated by a temperature fitted on training rows that the weights did not
see; texts below the fitted confidence are marked ``rejected``.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0; an empty training set
gives ``und`` for every text; ties go to the label that sorts first; repeated rows each give a row;
very long texts are read whole; an empty table gives an empty table; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import bounded_chunks, bounded_sample, fit_in_task, held_out, map_batches, within_chars
from waybill.llm.words import WordTable, mean_rows, subword_buckets

UNKNOWN = "und"
SIZES = (2, 3, 4)


@dataclass(frozen=True)
class LanguageParams:
    """The bounds of training: rows a label, and characters of all rows (an even share for each label)."""

    rows_per_label: int = 300
    #: The most frequent languages up to so many are learnt; the model has a weight vector for each.
    max_languages: int = 4096
    train_chars: int = 16_000_000
    buckets: int = 1 << 15
    dim: int = 12
    epochs: int = 3
    rate: float = 0.5
    snippet_words: int = 12
    #: Accuracy wanted of the texts that are not rejected.
    target: float = 0.98
    cache_words: int = 400_000
    #: Characters of the texts that are read at once; bounds the memory of a task.
    batch_chars: int = 1_000_000


@dataclass
class LanguageModel:
    labels: list[str]
    logits: np.ndarray  # buckets x labels: embeddings times class weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _snippets(rows: list[tuple[str, str]], labels: list[str], p: LanguageParams) -> tuple[list[list[str]], np.ndarray]:
    found, y = [], []
    for text, lang in rows:
        words = text.lower().split()
        for i in range(0, len(words), p.snippet_words):
            found.append(words[i : i + p.snippet_words])
            y.append(labels.index(lang))
    return found, np.array(y, dtype=np.int64)


def train_language(rows: list[tuple[str, str]], p: LanguageParams = LanguageParams(), seed: int = 7) -> LanguageModel:
    """Fit on (text, lang) rows.  Every fifth row calibrates instead of fitting."""
    rows = sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[1], r[0]))
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return LanguageModel([], np.zeros((p.buckets, 1)), np.zeros(1), 1.0, 1.0)
    fit, check = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    rng = np.random.default_rng(seed)
    snippets, y = _snippets(fit or rows, labels, p)
    words = list(dict.fromkeys(w for s in snippets for w in s))
    number = {w: i for i, w in enumerate(words)}
    owner, bucket = subword_buckets([w.encode() for w in words], SIZES, p.buckets)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    table = (rng.random((p.buckets, p.dim)).astype(np.float64) - 0.5) / p.dim
    weights, bias = np.zeros((p.dim, len(labels))), np.zeros(len(labels))
    share = np.bincount(y, minlength=len(labels)).astype(float)
    cost = (1.0 / np.maximum(share, 1))[y]
    cost *= len(y) / cost.sum()
    coded = [np.fromiter((number[w] for w in s), dtype=np.int64, count=len(s)) for s in snippets]
    steps, size = p.epochs * -(-len(coded) // 64), 64
    done = 0
    for _ in range(p.epochs):
        shuffled = rng.permutation(len(coded))
        for i in range(0, len(coded), size):
            batch = shuffled[i : i + size]
            w = np.concatenate([coded[b] for b in batch])
            n = first[w + 1] - first[w]
            doc = np.repeat(np.arange(len(batch)), [len(coded[b]) for b in batch])
            grams = bucket[np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            g_doc = np.repeat(doc, n)
            weight = np.repeat(1.0 / n, n) / np.bincount(doc, minlength=len(batch))[g_doc]
            mean = np.stack([np.bincount(g_doc, weights=table[grams, d] * weight, minlength=len(batch)) for d in range(p.dim)], axis=1)
            wrong = _softmax(mean @ weights + bias)
            wrong[np.arange(len(batch)), y[batch]] -= 1
            wrong *= cost[batch][:, None] / len(batch)
            rate = p.rate * (1 - done / steps)
            back = wrong @ weights.T
            weights -= rate * 4 * mean.T @ wrong
            bias -= rate * 0.1 * wrong.sum(axis=0)
            scale = rate * 40 * len(batch)  # one subword is a small share of a snippet's mean
            for d in range(p.dim):
                table[:, d] -= np.bincount(grams, weights=back[g_doc, d] * weight * scale, minlength=p.buckets)
            done += 1
    model = LanguageModel(labels, table @ weights, bias, 1.0, 0.0)
    _calibrate(model, check, p)
    return model


def _calibrate(model: LanguageModel, rows: list[tuple[str, str]], p: LanguageParams) -> None:
    """Temperature by grid search over log loss; threshold as the lowest with the wanted accuracy above it."""
    texts, y = _snippets(rows, model.labels, p)
    if not texts:
        return
    raw = Scorer(model, p).raw([" ".join(s) for s in texts])
    grid = np.geomspace(0.05, 4.0, 40)
    loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    probs = _softmax(raw / model.temperature)
    sure, right = probs.max(axis=1), probs.argmax(axis=1) == y
    order = np.argsort(-sure, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= p.target
    model.threshold = float(sure[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


class Scorer:
    """Texts to logits, with a bounded memory of words."""

    def __init__(self, model: LanguageModel, p: LanguageParams = LanguageParams()) -> None:
        self.model, self.p = model, p

        def features(words: list[str]) -> np.ndarray:
            owner, bucket = subword_buckets([w.encode() for w in words], SIZES, p.buckets)
            return mean_rows(owner, bucket, model.logits, len(words))

        self.table = WordTable(features, model.logits.shape[1], p.cache_words)

    def raw(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        counts = np.array([len(w) for w in words])
        out = np.zeros((len(texts), len(self.model.bias)))
        some = np.flatnonzero(counts)
        if len(some):
            rows = self.table.look_up([w for ws in words for w in ws])
            sums = np.add.reduceat(self.table.rows[rows].astype(np.float64), np.concatenate([[0], np.cumsum(counts[some])[:-1]]), axis=0)
            out[some] = sums / counts[some][:, None]
        return out + self.model.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        n = len(texts)
        langs, scores, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
        known = [i for i, t in enumerate(texts) if t and self.model.labels and any(map(str.isalpha, t))]
        if known:
            raw = np.concatenate([self.raw(part) for part in bounded_chunks([texts[i] for i in known], self.p.batch_chars)])
            probs = _softmax(raw / self.model.temperature)
            best = probs.argmax(axis=1)
            for k, i in enumerate(known):
                langs[i], scores[i] = self.model.labels[best[k]], float(probs[k, best[k]])
                rejected[i] = scores[i] < self.model.threshold
        return langs, scores, rejected


def training_rows(docs: DataFrame, p: LanguageParams) -> DataFrame:
    """The bounded sample: about ``rows_per_label`` rows of each language, none held out, of any length."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = ["doc_id", "text"]
    return within_chars(bounded_sample(rows, "lang", key, p.rows_per_label, p.max_languages), "lang", key, p.train_chars).select("text", "lang")


def detect_languages(docs: DataFrame, p: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, from a model trained on the same table's labels."""
    model = fit_in_task(training_rows(docs, p), lambda rows: train_language(rows, p))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the input

    def make():
        scorer = Scorer(shared.value, p)

        def work(doc_id, out, text):
            langs, scores, rejected = scorer.predict(text)
            return {"doc_id": doc_id, "held_out": out, "lang_pred": langs, "score": scores, "rejected": rejected}

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
