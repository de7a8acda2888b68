"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits; one regularised least-squares classifier over hashed
character n-grams (orders 1 to 3) predicts each bit; a text gets the language whose codeword has
the least loss, each bit weighted by how well its classifier did on the training rows. A small gap
to the next codeword flags the row as ambiguous.

Defined cases: a null text or one without a letter is `und` with score 0 and not ambiguous; with no
labelled row every text with a letter is `und`; one learned language gives it to every text with a
letter; null ids and repeated rows are kept, one result each. Only `doc_id`, `text` (and `lang` in
training) are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as V

BITS = 13
#: Labelled rows that training reads of each language, as an expectation.
PER_LANGUAGE = 400
UNKNOWN = "und"
#: Gap of the mean loss between the two nearest codewords under which a row is ambiguous.
AMBIGUOUS = 0.1


@dataclass(frozen=True)
class Model:
    names: list[str]
    words: np.ndarray            # languages x bits, +1 or -1
    weight: np.ndarray           # buckets x bits
    bias: np.ndarray
    trust: np.ndarray            # weight of each bit in decoding, sum 1


def codewords(k: int) -> np.ndarray:
    """Rows far apart: every split of up to 7 languages, else rows of a Sylvester matrix."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        return np.array([(1, *c) for c in product((1, -1), repeat=k - 1)][1:], float).T
    m = np.ones((1, 1))
    while len(m) < max(16, k):
        m = np.block([[m, m], [m, -m]])
    return m[:k, 1:]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each character n-gram of the lower-cased letters, runs of the rest one blank."""
    flat, row = V.codes([(t or "").lower() for t in texts])
    letter = V.classes(flat) == V.LETTER
    c = np.where(letter, flat, 32).astype(np.uint64)
    held = letter.copy()
    if len(c):
        held[1:] |= letter[:-1] & (row[1:] == row[:-1])
    c, row, letter = c[held], row[held], letter[held]
    keys, rows = [c[letter]], [row[letter]]
    for n in (2, 3):
        if len(c) >= n:
            same = row[n - 1:] == row[:len(row) - n + 1]
            key = c[:len(c) - n + 1].copy()
            for i in range(1, n):
                key = (key << np.uint64(21)) ^ c[i:len(c) - n + 1 + i]
            keys.append(key[same])
            rows.append(row[n - 1:][same])
    key, row = np.concatenate(keys), np.concatenate(rows)
    return (V.mixed(key) >> np.uint64(64 - BITS)).astype(np.int64), row


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = frame["text"].tolist()
        for a, b in V.pieces(texts):
            bucket, row = ngrams(texts[a:b])
            row, bucket, n = V.counted(row, bucket, BITS)
            cut = np.searchsorted(row, np.arange(b - a + 1))
            yield pd.DataFrame({
                "lang": frame["lang"].iloc[a:b],
                "bucket": [bucket[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])],
                "n": [n[i:j].tobytes() for i, j in zip(cut, cut[1:])]})


def fit(docs: DataFrame, split: F.Column, per_language: int = PER_LANGUAGE,
        ridge: float = 0.02) -> Model:
    """Codewords and classifiers from rows with a language that `split` allows.

    The sample of a language is its rows whose hash falls under per_language / its count; only the
    sample's histograms (at most 2^BITS counts a row) reach the driver.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & split)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1))
    rate = rows.sparkSession.createDataFrame(
        [(k, per_language / n) for k, n in sizes.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    got = (rows.join(F.broadcast(rate), "lang").where(draw < F.col("rate"))
           .select("lang", "text")
           .mapInPandas(_histograms, "lang string, bucket binary, n binary").collect())
    got = sorted((r for r in got if r["bucket"]), key=lambda r: (r["lang"], r["bucket"], r["n"]))
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        n = np.frombuffer(r["n"], np.float32)
        x[i, np.frombuffer(r["bucket"], np.int32)] = n / n.sum()
    # rare n-grams tell more than their share of a text shows
    scale = 1 / np.sqrt(x.mean(0) + 1e-4) if len(got) else np.ones(1 << BITS)
    x *= scale.astype(np.float32)
    words = codewords(len(names))
    y = words[[names.index(r["lang"]) for r in got]].reshape(len(got), -1)
    if not len(got) or len(names) < 2:
        return Model(names, words, np.zeros((1 << BITS, words.shape[1])), words.mean(0),
                     np.full(words.shape[1], 1 / words.shape[1]))
    bias = y.mean(0)
    gram = (x @ x.T).astype(float)
    dual = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), y - bias)
    right = ((gram @ dual + bias) * y > 0).mean(0)
    trust = np.maximum(2 * right - 1, 1e-3)
    return Model(names, words, ((x.T @ dual) * scale[:, None]).astype(np.float32), bias,
                 trust / trust.sum())


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword by weighted exponential loss, its score, and whether the next is near."""
    agree = margin[:, None, :] * model.words[None]
    loss = (np.exp(-np.clip(agree, -4, 4)) * model.trust).sum(2)
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    best = loss.argmin(1)
    second = np.partition(loss, 1, 1)[:, 1] if loss.shape[1] > 1 else loss.min(1) + 1
    return best, 1 / p.sum(1), second - loss.min(1) < AMBIGUOUS


def identify_texts(model: Model, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray]:
    name, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model.names:
        return name, score, unsure
    for a, b in V.pieces(texts):
        bucket, row = ngrams(texts[a:b])
        if not len(row):
            continue
        n = np.bincount(row, minlength=b - a)
        n[[i for i, t in enumerate(texts[a:b]) if not any(map(str.isalpha, t or ""))]] = 0
        at, bucket, times = V.counted(row, bucket, BITS)
        margin = np.stack([np.bincount(at, w[bucket] * times, b - a) for w in model.weight.T], 1)
        has = np.flatnonzero(n)
        best, p, near = decode(model, margin[has] / n[has, None] + model.bias)
        for i, k in zip(has, best):
            name[a + i] = model.names[k]
        score[a + has], unsure[a + has] = p, near
    return name, score, unsure


VERDICT = "lang_pred string, score double, ambiguous boolean"


def verdict(text: Column, model: Model) -> Column:
    """`lang_pred`, `score` and `ambiguous` of a text column, as one struct.

    The model travels with the tasks: 2^BITS weights for each bit of a codeword.
    """
    @F.pandas_udf(VERDICT)
    def run(texts: pd.Series) -> pd.DataFrame:
        name, score, unsure = identify_texts(model, texts.tolist())
        return pd.DataFrame({"lang_pred": name, "score": score, "ambiguous": unsure})

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` and `ambiguous` of every row."""
    return docs.select("doc_id", verdict(F.col("text"), model).alias("v")).select("doc_id", "v.*")
