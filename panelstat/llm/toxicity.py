"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is toxic if any of its sentences is: with sentence probabilities p_s = sigmoid(z_s), the
document's is 1 - prod(1 - p_s). Only documents carry labels; the likelihood of the labels under this
combination teaches the sentence model, which then locates the offending sentences. z_s is a bias
plus the weight of each word, the sum of the weights of its hashed features: the word itself, its
first three to six characters and its last four. A scorer therefore needs one number per distinct word.

Training reads at most `max_docs` labelled documents, those of smallest hashed doc_id outside the
held-out quarter (crc32 of the id's digits mod 4 is 2); that many rows of word features fit one task
at any corpus size. Scoring reads every row and whole text.

Edge cases: null and empty texts, and texts without words, have no sentence and score 0; a null label
teaches nothing, the largest of several labels of a document holds; a null doc_id is scored, not held
out, never learned from; without labels of both kinds every score is 0; repeated rows score alike; an
empty table returns none; other columns are ignored (`reject` returns them).
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.llm.worker import tidied

HASH_BITS = 18
LEAST_DOCS = 3
SENTENCE = re.compile(r"\w++|[.!?\n]")
ENDS = frozenset(".!?\n")
MAX_WORDS = 100_000
SCORE_SCHEMA = "doc_id long, score double, sentences array<struct<start:int,stop:int,score:double>>"


@functools.lru_cache(maxsize=30_000)
def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word."""
    parts = {"=" + word, "$" + word[-4:]} | {"^" + word[:n] for n in range(3, 7) if len(word) >= n}
    return tuple(sorted(zlib.crc32(p.encode()) >> (32 - HASH_BITS) for p in parts))


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence that has any."""
    out, held = [], []
    for token in SENTENCE.findall((text or "").lower()):
        if token in ENDS:
            if held:
                out.append(held)
                held = []
        else:
            held.append(token)
    return out + [held] if held else out


def _featurise(batches):
    """Per document: features of all words, and how many each sentence has."""
    for batch in batches:
        flat, sizes = [], []
        for text in batch.column("text").to_pylist():
            found = [[f for w in s for f in features(w)] for s in sentences(text)]
            flat.append([f for s in found for f in s])
            sizes.append([len(s) for s in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(flat, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
            ["toxic", "flat", "sizes"],
        )


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 20, batch: int = 32, rate: float = 0.2, lasso: float = 0.016):
    """(weights, bias) that maximise the noisy-or likelihood of the bags' labels, by Adagrad.

    Features of fewer than `LEAST_DOCS` documents are left out; the others bear an L1 penalty that falls
    with the root of the number of documents, as the noise of their gradients does.
    """
    bags = [b for b in bags if len(b[2])]
    spread = np.zeros(1 << HASH_BITS, np.int64)
    for _, flat, _ in bags:
        spread[np.unique(flat)] += 1
    used = np.flatnonzero(spread >= LEAST_DOCS)
    short = np.full(1 << HASH_BITS, len(used), np.int32)  # the last number stands for all features left out
    short[used] = np.arange(len(used), dtype=np.int32)
    bags = [(label, short[flat], sizes) for label, flat, sizes in bags]
    w, square = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-2)
    bias, square_bias, penalty = -5.0, 1e-2, lasso / np.sqrt(max(1, len(bags)))
    rng = np.random.default_rng(9)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = [bags[i] for i in order[at : at + batch]]
            flat, sizes = np.concatenate([b[1] for b in some]), np.concatenate([b[2] for b in some])
            z = np.clip(np.add.reduceat(w[flat], np.cumsum(sizes) - sizes) + bias, -30, 30)
            counts = np.array([len(b[2]) for b in some])
            no_log = np.add.reduceat(-np.logaddexp(0, z), np.cumsum(counts) - counts)
            label = np.array([b[0] for b in some])
            yes = np.maximum(-np.expm1(no_log), 1e-12)
            pull = np.where(label == 1, -np.exp(no_log) / yes, 1.0)  # times p_s: slope of the loss in z_s
            slope = np.repeat(pull, counts) / (1 + np.exp(-z)) / len(some)
            gradient = np.bincount(flat, np.repeat(slope, sizes), len(w))
            gradient[-1] = 0
            square += gradient**2
            step = rate / np.sqrt(square)
            w -= step * gradient
            w = np.sign(w) * np.maximum(np.abs(w) - penalty * step, 0)
            square_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(square_bias)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = w[:-1]
    return weights, bias


def _fit_in_task(batches):
    """All bags of the bounded sample to one row: numbers and values of the weights that aren't 0, and the bias."""
    bags = []
    for batch in batches:
        for y, flat, sizes in zip(batch.column("toxic").to_pylist(), batch.column("flat"), batch.column("sizes")):
            bags.append((y, flat.values.to_numpy(), sizes.values.to_numpy()))
    if len({y for y, _, _ in bags}) < 2:
        return
    # the order of rows decides the batches; sorting makes a fit repeat
    bags.sort(key=lambda b: (b[0], len(b[1]), int(b[1][:64].sum())))
    weights, bias = fit(bags)
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([used], pa.list_(pa.int32())), pa.array([weights[used]], pa.list_(pa.float64())), pa.array([bias])], ["used", "weights", "bias"]
    )


class _WordWeights(dict):
    """The sum of the weights of a word's features, computed once per word."""

    def __init__(self, weights: np.ndarray):
        super().__init__({end: None for end in ENDS})
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > MAX_WORDS:
            self.clear()
            self.update({end: None for end in ENDS})
        value = self[word] = float(self.weights[list(features(word))].sum())
        return value


def _probabilities(of: _WordWeights, bias: float, text: str | None) -> list[float]:
    """Log odds of each sentence."""
    out, total, some = [], bias, False
    for value in map(of.__getitem__, SENTENCE.findall((text or "").lower())):
        if value is not None:
            total += value
            some = True
        elif some:
            out.append(total)
            total, some = bias, False
    return out + [total] if some else out


def _spans(text: str) -> list[tuple[int, int]]:
    """Code points from the first word to the end of the last word of each sentence of the text itself."""
    out, start, stop = [], None, None
    for m in SENTENCE.finditer(text):
        if m[0] in ENDS:
            if start is not None:
                out.append((start, stop))
            start = None
        else:
            start, stop = m.start() if start is None else start, m.end()
    return out + [(start, stop)] if start is not None else out


def _score(weights: np.ndarray, bias: float, trained: bool, threshold: float):
    def run(batches):
        of = _WordWeights(weights)
        for batch in batches:
            scores, offending = [], []
            for text in (t.as_py() or "" for t in batch.column("text")):
                z = np.array(_probabilities(of, bias, text)) if trained else np.empty(0)
                score = float(-np.expm1(-np.logaddexp(0, z).sum()))
                scores.append(min(1.0, max(0.0, score)))
                found = []
                if score >= threshold:
                    spans, p = _spans(text), 1 / (1 + np.exp(-z))
                    # lower-casing may change word boundaries of rare letters; spans then can't be aligned
                    if len(spans) == len(p):
                        worst = max(p)
                        found = [
                            {"start": a, "stop": b, "score": float(q)}
                            for (a, b), q in zip(spans, p)
                            if q >= threshold or q == worst
                        ]
                offending.append(found)
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array(offending, kinds)], [*names, "score", "sentences"])

    return run


def fold(doc_id: Column) -> Column:
    """crc32 of the id's digits mod 4; rows of fold 2 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 10_000) -> tuple[np.ndarray, float, bool]:
    """(weights, bias, whether both kinds of label were there), fitted in one task on at most `max_docs` documents."""
    order = F.xxhash64("doc_id")
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(order, "doc_id")
        .limit(max_docs)
    )
    texts = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_docs rows
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .select("toxic", "text")
    )
    bags = texts.mapInArrow(tidied(_featurise), "toxic int, flat array<int>, sizes array<int>")
    # at most max_docs rows, so one task can hold them; the driver gets the fitted weights alone
    fitted = bags.repartition(1).mapInArrow(tidied(_fit_in_task), "used array<int>, weights array<double>, bias double").collect()
    weights = np.zeros(1 << HASH_BITS)
    if not fitted:
        return weights, 0.0, False
    weights[fitted[0].used] = fitted[0].weights
    return weights, fitted[0].bias, True


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 10_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) per row; `sentences` are the offending ones of a
    predicted document, as spans of code points. Runs the training jobs."""
    weights, bias, trained = train(docs, labels, max_docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    scored = texts.mapInArrow(tidied(_score(weights.astype(np.float32), bias, trained, threshold)), SCORE_SCHEMA)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "sentences",
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 10_000) -> DataFrame:
    """The rows of `docs` scored below the threshold. Runs the training jobs."""
    weights, bias, trained = train(docs, labels, max_docs)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    scored = renamed.withColumn("text", F.col(text)).mapInArrow(
        tidied(_score(weights.astype(np.float32), bias, trained, threshold)), f"{kinds}, {SCORE_SCHEMA.partition(', ')[2]}"
    )
    return scored.where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
