"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed character 2- to 4-grams
(inside words, with the word's edges); a linear softmax over that average gives
the language. Embeddings and weights are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows (``per_language`` texts of each
of at most ``max_languages`` languages, chosen by a hash of the id). A part of
the sample that is not trained on sets the temperature of the probabilities and
the least probability below which a document is rejected.

At prediction time the embedding table and the weights are multiplied once, so
a text costs one lookup per n-gram; texts are taken whole, in Arrow batches.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; if there is nothing to learn from, everything is; every row gives
one row, repeated rows too. A document that occurs with several languages
teaches each of them, one without a language none; rows without an id are
predicted but not learned from. Very long texts are taken one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import bounded_sample, id_remainder, slices

BUCKETS = 1 << 16
DIM = 16
SIZES = (2, 3, 4)
PER_LANGUAGE = 400
MAX_LANGUAGES = 128
FOLDS = 5
# at most this share of the right answers of the calibration part may fall under the rejection threshold
REJECT_SHARE = 0.001
# and a document that is more likely than not of its language is never rejected
REJECT_BELOW = 0.5
CHUNK_CHARS = 400_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; its lower case where that is one code point."""
    n = 0x110000
    is_letter, lower = np.zeros(n, dtype=bool), np.arange(n, dtype=np.uint32)
    for c in range(n):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            is_letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return is_letter, lower


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, in order of the texts, and how many each text has."""
    is_letter, lower = letters()
    joined = np.frombuffer("".join([f"  {t}  " for t in texts]).encode("utf-32-le", "replace"), dtype="<u4")
    sizes = np.array([len(t) + 4 for t in texts])
    ok = is_letter[joined]
    codes = np.where(ok, lower[joined], 32).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    found, where = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        value = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            value = (value ^ codes[j:j + m]) * np.uint32(0x01000193)
        value ^= value >> np.uint32(15)
        keep = ok[0:m] | ok[n - 1:n - 1 + m]
        for j in range(1, n - 1):
            keep &= ok[j:j + m]
        at = np.flatnonzero(keep)
        found.append((value[at] % np.uint32(BUCKETS)).astype(np.int32))
        where.append(at)
    if len(texts) == 1:
        return np.concatenate(found), np.array([sum(map(len, found))])
    counts = [np.searchsorted(w, np.append(starts, len(codes))) for w in where]
    per_text = [np.diff(c) for c in counts]
    parts = [f[c[i]:c[i + 1]] for i in range(len(texts)) for f, c in zip(found, counts)]
    return np.concatenate(parts), sum(per_text)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # embedding table times weights: one row of class values per bucket
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best class (-1: none) and its calibrated probability."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.labels or not texts:
            return best, score
        ids, counts = grams(texts)
        some = np.flatnonzero(counts)
        if len(some) == 0:
            return best, score
        starts = (np.cumsum(counts) - counts)[some]
        logits = np.stack([np.add.reduceat(self.table[:, c][ids], starts, dtype=np.float64) for c in range(len(self.labels))], axis=1)
        logits = logits / counts[some, None] + self.bias
        p = softmax(logits / self.temperature)
        best[some], score[some] = p.argmax(1), p.max(1)
        return best, score


    def predict_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any number of texts, CHUNK_CHARS characters (or one text) at a time."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CHUNK_CHARS:
                size += len(texts[end])
                end += 1
            best[at:end], score[at:end] = self.predict(texts[at:end])
            at = end
        return best, score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 11) -> LanguageModel:
    """Stochastic gradient descent over single texts; every fifth one calibrates."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    bags = []
    for text, label in zip(texts, labels):
        ids, _ = grams([text])
        if len(ids):
            at, n = np.unique(ids, return_counts=True)
            bags.append((at, (n / n.sum()).astype(np.float32), names.index(label)))
    held = bags[4::5]
    fit = [b for i, b in enumerate(bags) if i % 5 != 4] or bags
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, share, label = fit[i]
            mean = share @ embed[at]
            grad = softmax(mean @ weight + bias)
            grad[label] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = weight @ grad
            weight -= step * np.outer(mean, grad)
            bias -= step * np.float32(0.1) * grad
            # the average spreads a step thin over many rows, so rows take it at full size
            embed[at] -= step * np.minimum(share * 20, 1)[:, None] * back[None, :]
            done += 1
    table = (embed @ weight).astype(np.float32)
    logits = np.array([share @ table[at] + bias for at, share, _ in held or fit], dtype=np.float64)
    truth = np.array([label for *_, label in held or fit])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.2, 20, 60):
        p = softmax(logits / t)[np.arange(len(truth)), truth]
        best = min(best, (float(-np.log(p + 1e-12).mean()), float(t)))
    p = softmax(logits / best[1])
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    reject = float(right[int(REJECT_SHARE * len(right))]) if len(right) else 0.0
    return LanguageModel(names, np.asfortranarray(table), bias.astype(np.float64), best[1], min(reject, REJECT_BELOW))


def fit_on(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
           per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Train on a bounded sample of the rows outside fold 0."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = named.where(F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), FOLDS) != 0))
    sample = bounded_sample(rows, "lang", per_language, max_languages, text="text")
    picked = sorted((r["doc_id"], r["lang"], r["text"]) for r in sample.collect())
    return train([t for *_, t in picked], [g for _, g, _ in picked])


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, rejected) per row. Map-only; the model is of fixed size."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                best, score = m.predict_all([t or "" for t in part.column(1).to_pylist()])
                names = [m.labels[b] if b >= 0 else UNKNOWN for b in best]
                rejected = [bool(b < 0 or s < m.reject_below) for b, s in zip(best, score)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[key, "lang_pred", "score", "rejected"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, all columns kept. Map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                best, score = m.predict_all([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array((best >= 0) & (score >= m.reject_below), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contract(docs: DataFrame) -> DataFrame:
    """The op5 contract."""
    out = predict(docs, fit_on(docs))
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
