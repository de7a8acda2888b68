"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w.x - threshold_k): one weight vector for all grades, ordered thresholds.
x holds the log-scaled counts of lower-cased tokens, kept by a 40-bit hash among those that enough
training rows share; an L1 term leaves only telling ones. The result of a text is
its expected grade, the sum of P(grade > k).

`fit` takes any non-negative integer grade. `graded` makes grades from a 0/1 label: a toxic row is
graded by how many distinct label-1 tokens (log-odds over ODDS) it holds.

Defined cases: a null or empty text, or one without a known token, gets the grade of the thresholds
alone; null ids and repeated rows are scored each; with no labelled row, or one grade only, every
text gets severity 0. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V
from .quality import sampled

BITS = 40
#: Most toxic rows that training reads; of the others it reads up to twice as many.
SAMPLE = 4_000
#: Training rows that must share a feature.
SUPPORT = 5
#: Log-odds over which a token counts towards a grade.
ODDS = 2.0
#: Fewest label-1 tokens of the grades after the first.
STEPS = (3, 6)


@dataclass(frozen=True)
class Model:
    key: np.ndarray              # sorted feature hashes with a weight
    weight: np.ndarray
    threshold: np.ndarray        # ascending, one fewer than grades


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature hash and log-scaled count of each distinct feature of each text."""
    h, row = V.tokens([(t or "").lower() for t in texts])
    row, key, n = V.counted(row, h >> np.uint64(64 - BITS), BITS)
    return row, key, np.log1p(n)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = frame["text"].tolist()
        for a, b in V.pieces(texts):
            row, key, x = features(texts[a:b])
            cut = np.searchsorted(row, np.arange(b - a + 1))
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].iloc[a:b], "grade": frame["label"].iloc[a:b],
                "key": [key[i:j].tobytes() for i, j in zip(cut, cut[1:])],
                "x": [x[i:j].astype(np.float32).tobytes() for i, j in zip(cut, cut[1:])]})


@dataclass
class Sample:
    """Training rows as one sparse matrix over the shared features."""

    key: np.ndarray
    row: np.ndarray
    column: np.ndarray
    x: np.ndarray
    grade: np.ndarray


def sample(docs: DataFrame, labelled: DataFrame, support: int = SUPPORT) -> Sample:
    """Vectors of the labelled rows (`doc_id`, integer `label`), which the caller has bounded."""
    got = (docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
           .mapInPandas(_packed, "doc_id long, grade int, key binary, x binary").collect())
    got.sort(key=lambda r: (r["doc_id"], r["grade"], r["key"]))
    keys = [np.frombuffer(r["key"], np.int64) for r in got]
    none = np.zeros(0, np.int64)
    key, inverse, n = np.unique(np.concatenate([none, *keys]), return_inverse=True,
                                return_counts=True)
    row = np.repeat(np.arange(len(got)), [len(k) for k in keys])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32)
    held = n >= support
    place = np.cumsum(held) - 1
    keep = held[inverse]
    return Sample(key[held], row[keep], place[inverse[keep]], x[keep],
                  np.array([r["grade"] for r in got], int))


def graded(s: Sample) -> Sample:
    """Grades 0 to 3 from labels 0 and 1."""
    n1 = max(1, (s.grade > 0).sum())
    n0 = max(1, (s.grade == 0).sum())
    with1 = np.bincount(s.column, s.grade[s.row] > 0, len(s.key))
    with0 = np.bincount(s.column, s.grade[s.row] == 0, len(s.key))
    telling = np.log((with1 + 0.5) / n1) - np.log((with0 + 0.5) / n0) > ODDS
    hits = np.bincount(s.row, telling[s.column], len(s.grade))
    grade = 1 + sum((hits >= k).astype(int) for k in STEPS)
    return Sample(s.key, s.row, s.column, s.x, np.where(s.grade > 0, grade, 0))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit_sample(s: Sample, l1: float = 1.5, rounds: int = 300, step: float = 0.5) -> Model:
    """Proximal AdaGrad on the ordinal likelihood, all rows at once."""
    top = int(s.grade.max(initial=0))
    if not top or not (s.grade == 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))
    above = s.grade[:, None] > np.arange(top)[None]
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first, gaps = -np.log(share / (1 - share))[0], np.full(top - 1, 1.0)
    w, seen_w = np.zeros(len(s.key)), np.full(len(s.key), 1e-8)
    seen_t = np.full(top, 1e-8)
    for _ in range(rounds):
        threshold = first + np.append(0, np.cumsum(gaps))
        wx = np.bincount(s.row, w[s.column] * s.x, len(s.grade))
        error = _sigmoid(wx[:, None] - threshold) - above
        g = np.bincount(s.column, error.sum(1)[s.row] * s.x, len(s.key))
        seen_w += g * g
        rate = step / np.sqrt(seen_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        # threshold_k is the first one plus gaps that stay positive, so the order holds
        gt = -error.sum(0)
        gt = np.cumsum(gt[::-1])[::-1]
        seen_t += gt * gt
        moved = step / np.sqrt(seen_t) * gt
        first, gaps = first - moved[0], np.maximum(gaps - moved[1:], 0.05)
    kept = np.flatnonzero(w)
    return Model(s.key[kept], w[kept].astype(np.float32), first + np.append(0, np.cumsum(gaps)))


def severity_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade > 0) of each text."""
    total = np.zeros(len(texts))
    if not len(model.threshold):
        return total, total.copy()
    for a, b in V.pieces(texts) if len(model.key) else ():
        row, key, x = features(texts[a:b])
        at = np.minimum(np.searchsorted(model.key, key), len(model.key) - 1)
        hit = model.key[at] == key
        total[a:b] = np.bincount(row[hit], model.weight[at[hit]] * x[hit], b - a)
    p = _sigmoid(total[:, None] - model.threshold)
    return p.sum(1), p[:, 0]


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `severity` (expected grade) and `p_toxic` of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            expected, toxic = severity_texts(model, frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "severity": expected,
                                "p_toxic": toxic})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, severity double, p_toxic double")


def train(docs: DataFrame, labels: DataFrame, label: str, split: F.Column) -> Model:
    """Model from a 0/1 label, on at most SAMPLE toxic rows and twice as many others."""
    rows = [sampled(labels.where(F.col(label) == v), label, n, split)
            for v, n in ((1, SAMPLE), (0, 2 * SAMPLE))]
    return fit_sample(graded(sample(docs, rows[0].unionByName(rows[1]))))
