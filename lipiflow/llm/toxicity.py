"""Toxicity by a classifier chain.

Categories are predicted in order; each linear model sees, beside its words, the probabilities of the
categories before it. Those are out-of-fold predictions in training, so that a later model learns from
errors like those it meets when scoring. Words are hashed; a model's features are the words whose presence
parts its classes best. Training takes a bounded sample of labelled rows, scoring every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, mix, passes

#: Buckets that words are hashed to, words that a model may use, and labelled rows for training.
BUCKETS, FEATURES, SAMPLE_ROWS = 1 << 20, 256, 20_000
FOLDS = 5
#: Categories in the chain's order, as SQL over the labels; the verdict is the last one's.
CATEGORIES = {"low_quality": "quality = 0", "toxic_low_quality": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}
THRESHOLD = 0.4


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each document its distinct buckets, sorted, in one array with offsets.

    There is a bucket for each word, runs of letters and digits in lower case, and for each word beginning of five
    code points that the document has at least once, twice, four and eight times.
    """
    w = Words(texts, lower=True, separator=_NOT_ALPHANUMERIC)
    doc = w.doc().astype(np.uint64) << np.uint64(32)
    found = [np.unique(doc | (w.hashes() % np.uint64(BUCKETS)))]
    begins, times = np.unique(doc | (w.prefixes(5).hashes(seed=5) & np.uint64(0xFFFFFFFF)), return_counts=True)
    for least in (1, 2, 4, 8):
        enough = begins[times >= least]
        found.append((enough & ~np.uint64(0xFFFFFFFF)) | (mix((enough & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(least)) % np.uint64(BUCKETS)))
    return _split(np.unique(np.concatenate(found)), len(texts))


def _split(pair: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    doc = (pair >> np.uint64(32)).astype(np.int64)
    return (pair & np.uint64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(doc, np.arange(documents + 1))


_NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@dataclass
class Linear:
    """A logistic model over chosen word buckets and the probabilities before it in the chain."""

    buckets: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logits(self, words: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.searchsorted(self.buckets, words)
        at[at == len(self.buckets)] = 0
        hit = self.buckets[at] == words if len(self.buckets) else np.zeros(len(words), bool)
        total = np.bincount(doc[hit], self.weights[at[hit]], len(offsets) - 1) if hit.any() else np.zeros(len(offsets) - 1)
        return total + before @ self.chain + self.bias

    def predict(self, words, offsets, before) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(words, offsets, before), -40, 40)))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear] = field(default_factory=list)

    def predict(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        out = np.zeros((len(offsets) - 1, 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(words, offsets, out)])
        return out


def fit_linear(words, offsets, before, y, features: int = FEATURES, ridge: float = 1.0, steps: int = 25) -> Linear:
    """Newton steps of a ridge logistic regression on the buckets with the largest likelihood-ratio statistic."""
    n, positives = len(y), y.sum()
    if n == 0 or positives in (0, n):
        return Linear(np.zeros(0, np.int32), np.zeros(0), np.zeros(before.shape[1]), -20.0 if not positives else 20.0)
    seen = np.bincount(words, minlength=BUCKETS).astype(float)
    seen_positive = np.bincount(words[np.repeat(y > 0, np.diff(offsets))], minlength=BUCKETS).astype(float)
    candidates = np.flatnonzero(seen >= 5)
    a, b = seen_positive[candidates], seen[candidates]
    rate, inside = positives / n, np.clip(a / b, 1e-6, 1 - 1e-6)
    rest = np.clip((positives - a) / np.maximum(n - b, 1), 1e-6, 1 - 1e-6)
    deviance = 2 * (a * np.log(inside / rate) + (b - a) * np.log((1 - inside) / (1 - rate)) + (positives - a) * np.log(rest / rate) + np.maximum(n - b - positives + a, 0) * np.log((1 - rest) / (1 - rate)))
    chosen = candidates[np.argsort(-deviance, kind="stable")[:features]]
    chosen = np.sort(chosen[deviance[np.searchsorted(candidates, chosen)] > 30.0]).astype(np.int32)
    x = np.zeros((n, len(chosen) + before.shape[1] + 1))
    if len(chosen):
        column = np.full(BUCKETS, -1, np.int32)
        column[chosen] = np.arange(len(chosen))
        at = column[words]
        hit = at >= 0
        x[np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[hit], at[hit]] = 1
    x[:, len(chosen) : -1] = before
    x[:, -1] = 1
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log(rate / (1 - rate))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(chosen, beta[: len(chosen)], beta[len(chosen) : -1], float(beta[-1]))


def _rows(words, offsets, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a mask."""
    size = np.diff(offsets)
    return words[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


def fit_chain(words, offsets, labels: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """labels has a column for each category. Folds are dealt by position."""
    n = len(labels)
    fold = np.arange(n) % folds
    out_of_fold = np.zeros((n, 0))
    chain = Chain(names)
    for j in range(len(names)):
        y = labels[:, j].astype(float)
        chain.models.append(fit_linear(words, offsets, out_of_fold, y))
        if j + 1 == len(names):
            break
        column = np.zeros(n)
        for k in range(folds):
            model = fit_linear(*_rows(words, offsets, fold != k), out_of_fold[fold != k], y[fold != k])
            column[fold == k] = model.predict(*_rows(words, offsets, fold == k), out_of_fold[fold == k])
        out_of_fold = np.column_stack([out_of_fold, column])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, categories: dict[str, str] = CATEGORIES) -> Chain:
    """A chain fitted to at most `sample_rows` labelled documents, those whose doc_id hashes lowest.

    Labels that are null, or of a document that is not there, are left out; of repeated ones the least (quality, toxic)
    counts, of rows that repeat a doc_id the one whose buckets come first. The sample, which is bounded, goes to the
    documents; only its word buckets come to the driver.
    """
    valid = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    valid = valid.groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("one")).select("doc_id", "one.*")
    drawn = valid.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h").limit(sample_rows)
    flags = [F.expr(e).cast("int").alias(f"_c{i}") for i, e in enumerate(categories.values())]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("_h", "doc_id", F.array(*flags).alias("y"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = word_buckets(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("y"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words, pa.int32()))], names=["h", "y", "words"])

    got = sample.mapInArrow(features, "h long, y array<int>, words array<int>").groupBy("h").agg(F.min(F.struct("y", "words")).alias("one")).select("h", "one.*").toArrow().combine_chunks()
    names = list(categories)
    if not got.num_rows:
        return fit_chain(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, len(names))), names)
    got = got.sort_by("h")
    lists = got.column("words").combine_chunks()
    sizes = np.array(lists.value_lengths())
    y = np.array(got.column("y").to_pylist())
    return fit_chain(np.array(lists.flatten()), np.concatenate([[0], np.cumsum(sizes)]), y, names)


def toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and is_toxic: the probability of `toxic` is over the threshold.

    Every row is scored on its whole text; null and empty texts have no words and get the models' base rates.
    Rows with null or repeated doc_id are scored each; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                p = sent.value.predict(*word_buckets(part.column("text")))
                columns = [pa.array(np.round(p[:, i], 6)) for i in range(len(names))]
                verdict = pa.array(p[:, names.index("toxic")] > threshold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, verdict], names=["doc_id", *(f"p_{n}" for n in names), "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", is_toxic boolean")
