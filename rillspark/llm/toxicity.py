"""Toxicity by multiple-instance learning: documents have labels, sentences have scores.

A sentence's score is logistic in its words; a document's is the noisy-or of its sentences. Weights are fitted on
document labels through the noisy-or, so that the sentences that explain a label come out by themselves and can be
located afterwards.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import slices, table, workers_find_us

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)")
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_toxic bigint, toxic_spans string"


@dataclass(frozen=True)
class Model:
    """Log-odds of features and the bias of a sentence; prior: the score of every text where nothing could be learned, that
    is without weights."""

    weights: dict[str, float]
    bias: float
    prior: float

    @cached_property
    def known(self) -> Known:
        return Known(self.weights)


class Known(dict):
    """The features with a weight of each word met, worked out once; forgotten when there are many."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def get(self, word: str) -> tuple[str, ...]:
        return self[word]

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = tuple(f for f in features(word) if f in self.weights)
        return found


def features(word: str) -> tuple[str, ...]:
    """A word in lower case, and its first 4, 5 and 6 letters with a mark, for inflected words."""
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of each sentence with a word, in code points."""
    out = []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0])
        if words:
            out.append((m.start(), m.end(), [w.lower() for w in words]))
    return out


def fit(texts: list[str], labels: list[int], min_docs: int = 8, l1: float = 7e-4, l2: float = 2e-4, rounds: int = 320, rate: float = 0.15) -> Model:
    """Weights by gradient descent (Adam) on the documents' log-likelihood, classes weighted alike. Without texts, with one
    class only or without a feature of `min_docs` documents there are no weights, and the prior, the share of the label 1,
    smoothed (0.5 without texts), is every score."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    seen: dict[str, int] = {}
    for t in texts:
        for f in {f for _, _, ws in sentences(t or "") for w in set(ws) for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= min_docs))}
    del seen
    if len(set(labels)) < 2 or not vocabulary:
        return Model({}, 0.0, prior)
    y = np.array(labels, float)
    found, sizes, bag_of = array("i"), array("i"), array("i")
    for i, t in enumerate(texts):
        for _, _, ws in sentences(t or ""):
            known = {vocabulary[f] for w in set(ws) for f in features(w) if f in vocabulary}
            found.extend(sorted(known))
            sizes.append(len(known))
            bag_of.append(i)
    columns, bag, n = np.array(found, np.int32), np.array(bag_of, np.int32), np.array(sizes)
    del found
    worded = np.flatnonzero(n)  # sentences with features, whose columns stand in a row
    begins, rows = np.cumsum(n)[worded] - n[worded], np.repeat(np.arange(len(n), dtype=np.int32), n)
    by_column = np.argsort(columns, kind="stable")
    heads, of = np.cumsum(np.bincount(columns, minlength=len(vocabulary))), rows[by_column]
    heads = np.concatenate([[0], heads[:-1]])
    w, b = np.zeros(len(vocabulary)), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = y.mean()
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for step in range(1, rounds + 1):
        z = np.full(len(n), b)
        z[worded] += np.add.reduceat(w[columns], begins) if len(worded) else 0.0
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        full = np.clip(1 - none, 1e-9, 1)
        slope = importance * np.where(y == 1, none / full, -1.0)  # d log-likelihood / d(-log none)
        dz = slope[bag] * p
        grad = np.append(l1 * np.tanh(20 * w) + l2 * w - np.add.reduceat(dz[of], heads), -dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    kept = {word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-3}
    return Model(kept, float(b), prior)


def score(text: str | None, model: Model) -> tuple[float, list[tuple[int, int]]]:
    """The noisy-or of a text's sentences, and those with a score of a half or more. A text without words has no sentence
    and so the score 0. A model without weights gives every text its prior and finds no sentence."""
    if not model.weights:
        return model.prior, []
    get, none, found = model.known.get, 0.0, []
    for start, end, words in sentences(text or ""):
        seen = set().union(*filter(None, map(get, words)))
        z = model.bias + math.fsum(model.weights[f] for f in seen)
        p = 1 / (1 + math.exp(-min(z, 30.0))) if z > -30 else 0.0
        none += math.log1p(-min(p, 1 - 1e-12))
        if p >= 0.5:
            found.append((start, end))
    return 0.0 - math.expm1(none), found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int = 64 << 20) -> tuple[list[str], list[int]]:
    """At most `most` labelled texts that aren't held out and at most `most_bytes` of them together, in the order of the
    hashes of their ids; a text for which there is no room is passed over. A document with several labels takes the
    largest; null labels aren't used. Sizes are read first, so that no text comes to the driver that isn't used."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # `most` rows
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_key")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sizes = rows.select("doc_id", "text_key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).join(chosen, "doc_id").orderBy(*order).limit(most).collect()
    room, fits, copies = most_bytes, [], {}
    for r in sizes:
        if r.n <= room:
            room -= r.n
            fits.append((r.doc_id, r.text_key))
            copies[fits[-1]] = copies.get(fits[-1], 0) + 1
    if not fits:
        return [], []
    wanted = docs.sparkSession.createDataFrame(list(copies), "doc_id long, text_key long")
    found = rows.join(F.broadcast(wanted), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).collect()
    texts, toxic = {(r.doc_id, r.text_key): r.text or "" for r in found}, {r.doc_id: int(r.toxic) for r in sizes}
    return [texts[k] for k in fits], [toxic[k[0]] for k in fits]


def with_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs (doc_id, text). Null and empty texts get the score of no sentence, 0, or the prior of a model
    without weights; a null doc_id isn't held out; repeated rows are each scored. toxic_spans locates offending sentences as start:end, comma-joined."""
    workers_find_us(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [score(t, shared.value) for t in part["text"].to_pylist()]
                scores = [s for s, _ in found]
                columns = [part["doc_id"], part["held_out"], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                columns += [pa.array([len(x) for _, x in found], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in x) for _, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_toxic", "toxic_spans"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(scan, SCHEMA)


#: Labelled texts that the model is fitted on, at most, beside 64 MB of them.
SAMPLE = 3000


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_toxicity(docs, fit(*training_sample(docs, table(spark, sf_dir, "labels"), SAMPLE)))
