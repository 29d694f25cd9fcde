"""Quality classifier: hashed word n-gram logistic regression by follow-the-regularised-leader.

Executors turn texts into sparse vectors; the driver updates the weights on a bounded sample, row by row as
FTRL-proximal asks; executors score all texts as sparse dot products.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsieve.llm.common import HASHER, fit_rows, list_column, map_arrow, mix, remainder

BITS = 18
EPOCHS = 4
#: Rows of the sample that the fit reads at most; about 4 KB each as vectors.
FIT_ROWS = 8_000
TOKEN = re.compile(rb"[^\x00-\x20\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")
_hasher = HASHER


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: words and runs of signs, alone and in pairs, hashed to 2**BITS.

    A triple of words seen before in the text is marked by a feature of its own, so repetition shows. Case is
    part of a word's shape: a word in capitals adds the feature of its shape. Values are log counts of unit norm.
    """
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    lowered = [t.lower() for t in tokens]
    h = _hasher.array(lowered)
    parts = [mix(h)]
    if len(h) > 1:
        parts.append(mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    upper = sum(1 for t in tokens if len(t) > 1 and t.isupper())
    again = 0
    if len(h) > 2:
        triples = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:]
        again = len(triples) - len(np.unique(triples))
    extra = [_hasher[b"\x00upper%d" % min(9, 10 * upper // len(tokens))], _hasher[b"\x00again%d" % min(9, 10 * again // len(tokens))], _hasher[b"\x00length%d" % int(math.log2(len(tokens)))]]
    index = np.concatenate([keys, mix(np.array(extra, np.uint64))]) >> np.uint64(64 - BITS)
    value = np.log1p(counts.astype(np.float32))
    value = np.concatenate([value / np.sqrt((value * value).sum()), np.full(len(extra), 0.5, np.float32)])
    return index.astype(np.int32), value.astype(np.float32)


@dataclass
class Ftrl:
    """FTRL-proximal with L1 and L2, per-coordinate rates."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def update(self, index: np.ndarray, value: np.ndarray, y: int, importance: float) -> None:
        w, b = self.weights(index), self.bias()
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ value) + b))))
        g = (p - y) * importance * value
        # An index may occur twice in a text by collision: add, don't assign.
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        np.add.at(self.z, index, g - sigma * w)
        np.add.at(self.n, index, g * g)
        gb = (p - y) * importance
        self.bias_z += gb - (math.sqrt(self.bias_n + gb * gb) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += gb * gb


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from bounded rows (text, label). Without rows of both labels: all 0."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [vector(t) for t in batch[0].to_pylist()]
        sizes = [len(v[0]) for v in vectors]
        return pa.RecordBatch.from_arrays([batch[1], list_column(np.concatenate([v[0] for v in vectors]), sizes, pa.int32()), list_column(np.concatenate([v[1] for v in vectors]), sizes, pa.float32())], ["label", "index", "value"])

    texts = rows.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("label").cast("int"))
    got = map_arrow(texts, each, "label int, index array<int>, value array<float>").toArrow()
    labels = got["label"].to_numpy()
    model = Ftrl()
    if 0 < labels.sum() < len(labels):
        index, value = (got[c].combine_chunks() for c in ("index", "value"))
        ends, index, value = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
        # The order of collected rows depends on the tasks; a hash of the vector fixes it.
        order = np.lexsort((np.add.reduceat(value.astype(float), ends[:-1]), np.add.reduceat(index.astype(np.int64) ** 2, ends[:-1])))
        rng = np.random.default_rng(9)
        weight = {y: min(4.0, len(labels) / (2 * max(1, (labels == y).sum()))) for y in (0, 1)}
        for _ in range(EPOCHS):
            for i in rng.permutation(order):
                model.update(index[ends[i] : ends[i + 1]], value[ends[i] : ends[i + 1]], int(labels[i]), weight[int(labels[i])])
    return model.weights(np.arange(1 << BITS)).astype(np.float32), model.bias()


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text. Null and empty texts have the one feature of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, by the parameter BITS

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = shared.value, []
        for t in batch[1].to_pylist():
            index, value = vector(t)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[index].astype(float) @ value) + bias)))))
        return pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.float64())], ["id", "score"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return map_arrow(df, each, "id long, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out rows are never read.

    Null or empty texts get a score like any other. A null id is not held out, has no label and is scored. Repeated rows
    are scored one by one, texts of any length whole; other columns are ignored. Of several labels of an id the largest
    counts; rows that are equal as vectors are learned from in any order. An empty table gives no rows; without labels
    of both kinds all scores are 0.5.
    """
    weights, bias = fit(fit_rows(docs, labels, "quality", remainder("doc_id", mod) != held, FIT_ROWS))
    held_out = F.coalesce(remainder("doc_id", mod) == held, F.lit(False))
    return score(docs, weights, bias).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
