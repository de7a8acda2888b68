"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text becomes a sparse vector of token and token-pair counts hashed into 2^BITS buckets,
log-scaled and of unit length; a token equal to the one or two before it also counts in a bucket
of its own, whatever the token. Training passes over a bounded labelled sample row by row, in an
order given by a hash; scoring is a sparse dot product per text, inside the tasks that read it.

Defined cases: a null or empty text, or one without a token, has an empty vector and scores the
model's bias; a row with a null id is scored like any other; repeated rows are scored each; with no
labelled row the model is empty and scores 0.5. Only `doc_id` and `text` are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V

BITS = 20
#: Most labelled rows that training reads.
SAMPLE = 6_000


@dataclass(frozen=True)
class Model:
    """Non-zero weights by bucket, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each non-zero of the texts' unit vectors."""
    h, row = V.tokens(texts)
    again = [V.repeats(h, row, n) for n in (1, 2)]
    h, row = V.with_pairs(h, row)
    h, row = (np.concatenate([x, *(a[i] for a in again)]) for i, x in enumerate((h, row)))
    row, bucket, n = V.counted(row, h >> np.uint64(64 - BITS), BITS)
    x = np.log1p(n)
    norm = np.sqrt(np.bincount(row, x * x, len(texts)))
    return row, bucket, (x / norm[row]).astype(np.float32)


def sampled(labels: DataFrame, label: str, limit: int, split: F.Column) -> DataFrame:
    """At most `limit` labelled rows that `split` allows, chosen by a hash of their id."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & split)
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = frame["text"].tolist()
        for a, b in V.pieces(texts):
            row, bucket, x = vectors(texts[a:b])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].iloc[a:b], "label": frame["label"].iloc[a:b],
                "bucket": [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])],
                "value": [x[i:j].tobytes() for i, j in zip(cut, cut[1:])]})


def fit(docs: DataFrame, sample: DataFrame, passes: int = 3, alpha: float = 0.5,
        beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> Model:
    """Weights from the sampled labels; the sample's vectors, not its texts, reach the driver."""
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .mapInPandas(_features, "doc_id long, label int, bucket binary, value binary")
            .collect())
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % 2**64, r["label"], r["bucket"]))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(passes):
        for r in rows:
            at = np.append(np.frombuffer(r["bucket"], np.int32), 1 << BITS)
            x = np.append(np.frombuffer(r["value"], np.float32), 1.0)
            w = _weights(z[at], n[at], alpha, beta, l1, l2)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - r["label"]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = _weights(z, n, alpha, beta, l1, l2)
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept].astype(np.float32), float(w[-1]))


def _weights(z, n, alpha, beta, l1, l2):
    w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    table = np.zeros(1 << BITS, np.float32)
    table[model.bucket] = model.weight
    out = np.zeros(len(texts))
    for a, b in V.pieces(texts):
        row, bucket, x = vectors(texts[a:b])
        out[a:b] = np.bincount(row, table[bucket] * x, b - a)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id` and `score` of every row; the model is at most 2^BITS weights and travels along."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"],
                                "score": score_texts(model, frame["text"].tolist())})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
