"""Toxicity by multiple-instance learning: a document is a bag of sentences, its label the noisy-or of theirs.

A sentence has the log-odds z = bias + sum of its words' weights; a document is toxic with probability
1 - prod(1 - sigmoid(z)). Only document labels are used to train, and the sentence probabilities then show where the
offence is. A word's weight is that of the word itself and of its stems (its first four to seven bytes).

Features are chosen and the model is fitted on a bounded sample of labelled rows: at most about `sample` rows, half for each label
where both are plentiful, chosen by a hash of doc_id. Every document is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, code_points, fold, map_rows, raw_texts, slices

STEMS = (4, 5, 6, 7)  # lengths of the stems in bytes
# The bytes that end a sentence.
_END = re.compile(rb"[.!?\n]+")
_TABLE = bytes(10 if x in b".!?\n" else ALNUM[x] for x in range(256))


def sentences(raw: bytes | None) -> list[list[bytes]]:
    """Words of each sentence that has any, A-Z in lower case."""
    return [w for s in raw.translate(_TABLE).split(b"\n") if (w := s.split())] if raw else []


def features(word: bytes) -> tuple[bytes, ...]:
    """A word and its stems, marked by a star for each byte that they hold."""
    return (word, *(word[:n] + b"*" * n for n in STEMS if n < len(word)))


@dataclass
class Model:
    """Weights of features; `constant` is the score of everything where the labels hold one class only."""

    bias: float
    weights: dict[bytes, float]
    constant: float | None = None


class _Words(dict):
    """Weight of each word, worked out at its first use."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        x = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) < 100_000:
            self[word] = x
        return x


def labelled(labels: DataFrame, *, id_column: str = "doc_id", label_column: str = "toxic", sample: int = 16_000) -> DataFrame:
    """(doc_id, label, weight): the training rows of labels (fold not 0), thinned by a hash of the id to about sample / 2 of each label.

    Rows without id or label don't count; of several labels of an id the largest does.
    """
    rows = labels.select(F.col(id_column).alias("doc_id"), (F.col(label_column) > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    keep = {k: min(1.0, sample / 2 / n) for k, n in counts.items()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / (1 << 20)
    limit = F.when(F.col("label") == 1, keep.get(1, 1.0)).otherwise(keep.get(0, 1.0))
    return rows.where(share < limit).withColumn("weight", 1 / limit)


def _choose(rows: DataFrame, n_features: int) -> list[bytes]:
    """The features whose documents' labels differ most from the average, by log-likelihood ratio; n_features at most reach the driver."""

    def count(batch: pa.RecordBatch) -> dict:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for raw, label in zip(raw_texts(batch, "text"), batch.column(1).to_pylist(), strict=True):
            seen[label].update({f for w in set((raw or b"").translate(ALNUM).split()) for f in features(w)})
            seen[label][b""] += 1
        names = [*seen[0].keys() | seen[1].keys()]
        return {"feature": names, "neg": [seen[0][f] for f in names], "pos": [seen[1][f] for f in names]}

    counts = map_rows(rows.select("text", "label"), count, "feature binary, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = counts.where(F.length("feature") == 0).first()
    if total is None or not total.neg or not total.pos:
        return []
    rate = total.pos / (total.pos + total.neg)
    n, p = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = F.when(p > 0, F.col("pos") * F.log(p / rate)).otherwise(0.0) + F.when(p < 1, F.col("neg") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    best = counts.where(F.length("feature") > 0).where(n >= 3).select("feature", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), "feature").limit(n_features)
    return [bytes(r.feature) for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = 16_000, n_features: int = 2000, rounds: int = 150, shrink: float = 1.0) -> Model:
    """Train on the labelled sample: the noisy-or likelihood of the documents' labels is climbed by Adam steps."""
    chosen = labelled(labels, id_column=id_column, label_column=label_column, sample=sample)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most about `sample` small rows
    names = _choose(rows, n_features)
    if not names:
        counts = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
        return Model(0.0, {}, counts.get(1, 0) / max(1, sum(counts.values())))
    number = {f: k for k, f in enumerate(names)}

    def bag(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"plain": [], "bags": []}
        for raw in raw_texts(batch, "text"):
            found = [[number[f] for w in s for f in features(w) if f in number] for s in sentences(raw)]
            out["bags"].append([x for x in found if x])
            out["plain"].append(sum(not x for x in found))
        return {k: batch.column(i) for i, k in enumerate(("doc_id", "label", "weight"))} | out

    ident = docs.schema[id_column].dataType.simpleString()
    bags = map_rows(rows.select("doc_id", "label", "weight", "text"), bag, f"doc_id {ident}, label int, weight double, plain int, bags array<array<int>>", 1000)
    bags = bags.select("doc_id", "label", "weight", "plain", F.xxhash64("bags").alias("h"), "bags").toArrow()
    bags = bags.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    return _climb(bags, names, rounds, shrink)


def _climb(bags: pa.Table, names: list[bytes], rounds: int, shrink: float) -> Model:
    y = bags["label"].to_numpy().astype(bool)
    weight = bags["weight"].to_numpy()
    weight = weight / weight.sum() * len(y)
    plain = bags["plain"].to_numpy().astype(float)
    lists = bags["bags"].combine_chunks()
    inner = lists.flatten()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))  # of each sentence
    place = np.repeat(np.arange(len(owner)), np.diff(inner.offsets.to_numpy()))  # of each feature
    feature = inner.flatten().to_numpy()
    x = np.zeros(len(names) + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = x[-1] + np.bincount(place, x[feature], len(owner))
        a = np.bincount(owner, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, x[-1]) + 1e-9
        slope = weight * np.where(y, -1 / np.expm1(np.minimum(a, 50)), 1.0) / len(y)
        dz = slope[owner] / (1 + np.exp(-z))
        g = np.empty_like(x)
        g[:-1] = np.bincount(feature, dz[place], len(names)) + shrink / len(y) * x[:-1]
        g[-1] = dz.sum() + (slope * plain).sum() / (1 + math.exp(-x[-1]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(float(x[-1]), {f: float(w) for f, w in zip(names, x[:-1], strict=True)})


def _probability(raw: bytes | None, weights: _Words, bias: float, constant: float | None) -> float:
    """Noisy-or of the sentences of a text."""
    if constant is not None:
        return constant
    total, floor = 0.0, math.log1p(math.exp(bias))
    for words in sentences(raw):
        z = sum(map(weights.__getitem__, words))
        total += math.log1p(math.exp(min(50.0, bias + z))) if z else floor
    return -math.expm1(-total)


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text", locate: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, score (noisy-or of its sentences), predicted (score >= 0.5), offending.

    offending lists the sentences of a predicted document with probability of at least `locate`, else the likeliest, as code
    point spans with their scores. Null and empty texts have no sentences and score 0, or the labels' mean where those hold one class only.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    ident = docs.schema[id_column].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(model)  # n_features weights at most

    made: list[_Words] = []  # once for each task

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(_Words(sent.value.weights))
        weights, bias, constant = made[0], sent.value.bias, sent.value.constant
        scores, places = [], []
        for raw in raw_texts(batch, "text"):
            p = _probability(raw, weights, bias, constant)
            scores.append(p)
            places.append(_offending(raw, weights, bias, locate) if p >= 0.5 and constant is None else [])
        return {"doc_id": batch.column(0), "score": scores, "predicted": [int(p >= 0.5) for p in scores], "offending": places}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_rows(rows, run, f"doc_id {ident}, score double, predicted int, offending array<struct<start:long,end:long,score:double>>", 1000)


def _offending(raw: bytes, weights: _Words, bias: float, locate: float) -> list[dict]:
    found, at = [], 0
    for m in [*_END.finditer(raw), None]:
        end = m.start() if m else len(raw)
        words = raw[at:end].translate(ALNUM).split()
        if words:
            found.append((1 / (1 + math.exp(-max(-50.0, min(50.0, bias + sum(map(weights.__getitem__, words)))))), at, end))
        at = m.end() if m else end
    worst = [x for x in found if x[0] >= locate] or [max(found)]
    points = code_points(raw, (x for f in worst for x in f[1:]))
    return [{"start": points[a], "end": points[b], "score": p} for p, a, b in worst]


def toxicity(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", **parameters) -> DataFrame:
    """Fit on labels and score every row of docs: the columns of score() and held_out (fold 0, never trained on)."""
    model = fit(docs, labels, id_column=id_column, **parameters)
    return score(docs, model, id_column=id_column).withColumn("held_out", fold("doc_id") == 0)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows of docs, whole and in place, that the model fitted on labels doesn't predict to be toxic."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, **parameters)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias, constant = _Words(sent.value.weights), sent.value.bias, sent.value.constant
        for batch in slices(batches):
            yield batch.filter(pa.array([_probability(raw, weights, bias, constant) < 0.5 for raw in raw_texts(batch, text_column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
