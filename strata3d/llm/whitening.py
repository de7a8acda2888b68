"""Whitening of embeddings from exact integer cross-products by bit-sliced scatter.

Entries become integers x = floor(256 c). Of the distinct vectors each dimension is shifted to begin
at zero and cut into bit planes; a plane packs one bit of 64 rows in a word. The cross-product of two
dimensions is then the sum over pairs of planes of 2^(p+q) times the number of common ones, an AND
and a population count a word. Tasks add up their rows, Spark adds up the tasks as decimals, and the
driver centres D x D integers (n * products - sums * sums) before the one floating-point step, eigh.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped; so are
vectors of another length than the most frequent one (the greater of equally frequent) and empty
ones. Repeated rows are kept, one result for each component; equal vectors fit once. A component
whose variance is zero (up to rounding) has a null `whitened` and is left out of identity_error;
`explained` is null if all variance is zero. `deviation` is null where it exceeds a long;
`deviation_exact` holds it in full. An empty table gives an empty result. Only `vec_id` and
`embedding` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement as pairs
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored

#: Steps of an entry, and components returned.
STEPS, COMPONENTS = 256, 4
#: Eigenvalues below this share of the greatest one are zero but for rounding.
NOTHING = 1e-13
#: Rows whose planes are counted at once.
ROWS = 1 << 15
LONG = (1 << 63) - 1


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # a column each
    trace: float


def quantised(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `x` (array<long>) of the rows whose vectors are whole and of the usual length."""
    c = F.col("embedding")
    whole = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = vectors.where(c.isNotNull() & (F.size(c) > 0)).where(whole).select(
        "vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * STEPS).cast("long")).alias("x"))
    usual = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64)


def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of the rows' unsigned entries: a row of words for each (dimension, bit)."""
    rows, dims = u.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for p in range(bits):
        one = (u >> np.uint64(p) & np.uint64(1)).astype(np.uint8)
        out[:, p, :-(-rows // 8)] = np.packbits(one, axis=0).T
    return out.view(np.uint64).reshape(dims, bits, words)


def products(u: np.ndarray, bits: int) -> np.ndarray:
    """Exact sums over the rows of u[:, i] * u[:, j] for i <= j, from common ones of bit planes."""
    w = planes(u, bits)
    dims = len(w)
    small = 2 * bits + len(u).bit_length() < 63
    out = np.zeros((dims, dims), np.int64 if small else object)
    weight = np.array([1 << q for q in range(bits)], np.int64 if small else object)
    for i in range(dims):
        for p in range(bits):
            common = np.bitwise_count(w[i:] & w[i, p]).sum(axis=2, dtype=np.int64)
            out[i, i:] += (common * weight).sum(axis=1) * (1 << p)
    return out


def fit(x: DataFrame) -> Fit | None:
    """Components of the rows of `x`, each of which counts; None for an empty table."""
    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                m = _matrix(frame["x"])
                wide = int(np.abs(m.astype(float)).max() * len(m)) >= 1 << 62
                sums = m.astype(object).sum(axis=0) if wide else m.sum(axis=0)
                yield pd.DataFrame({"dim": range(m.shape[1]), "n": len(m), "s": list(map(str, sums)),
                                    "lo": m.min(axis=0), "hi": m.max(axis=0)})

    total = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    by_dim = x.select("x").mapInPandas(ranges, "dim int, n long, s string, lo long, hi long").groupBy(
        "dim").agg(F.sum("n").alias("n"), total, F.min("lo").alias("lo"),
                   F.max("hi").alias("hi")).orderBy("dim").collect()       # a row a dimension
    if not by_dim:
        return None
    n, dims = by_dim[0]["n"], len(by_dim)
    sums, low = [int(r["s"]) for r in by_dim], [r["lo"] for r in by_dim]
    extent = max(r["hi"] - r["lo"] for r in by_dim)
    bits, lo = max(1, extent.bit_length()), np.array(low, np.int64)

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in batches:
            m = _matrix(frame["x"]).view(np.uint64) - lo.view(np.uint64) if len(frame) else None
            for a in range(0, len(frame), ROWS):
                one = products(m[a:a + ROWS], bits).astype(object)
                held = one if held is None else held + one
        if held is not None:
            ij = list(pairs(range(dims), 2))
            yield pd.DataFrame({"i": [i for i, _ in ij], "j": [j for _, j in ij],
                                "s": [str(held[i, j]) for i, j in ij]})

    crossed = x.select("x").mapInPandas(scatter, "i int, j int, s string").groupBy(
        "i", "j").agg(total).collect()                                     # dims x dims rows
    shifted = [s - n * a for s, a in zip(sums, low)]
    v = np.zeros((dims, dims))
    for r in crossed:
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["s"]) - shifted[i] * shifted[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    return Fit(n, sums, values[order], vectors[:, order], float(np.trace(v)))


def projected(x: np.ndarray, f: Fit, k: int) -> tuple[np.ndarray, list[int]]:
    """Whitened values (NaN where there is no variance) and exact deviations of the rows of x."""
    big = f.n * (int(np.abs(x.astype(float)).max()) + 1) + max(map(abs, f.sums)) if x.size else 0
    if big * big * max(1, x.shape[1]) <= LONG:
        away = x * f.n - np.array(f.sums, np.int64)
        deviation = (away * away).sum(axis=1).tolist()
    else:
        away = x.astype(object) * f.n - np.array(f.sums, object)
        deviation = (away * away).sum(axis=1).tolist()
    centred = away.astype(float) / f.n
    scale = np.where(f.values[:k] > NOTHING * max(f.values[0], 0), f.values[:k], np.nan)
    return centred @ f.vectors[:, :k] / np.sqrt(scale), deviation


def identity_error(x: DataFrame, f: Fit, k: int) -> float | None:
    """Largest entry of the covariance of the whitened rows of x minus the identity."""
    names = [f"w{c}" for c in range(k) if f.values[c] > NOTHING * max(f.values[0], 0)]
    if not names:
        return None
    at = [int(c[1:]) for c in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                w, _ = projected(_matrix(frame["x"]), f, k)
                yield pd.DataFrame(w[:, at], columns=names)

    w = x.select("x").mapInPandas(run, ", ".join(f"{c} double" for c in names))
    mean = w.agg(*(F.avg(c).alias(c) for c in names)).first()
    both = list(pairs(names, 2))
    cov = w.agg(*(F.avg((F.col(a) - mean[a]) * (F.col(b) - mean[b])).alias(f"{a}_{b}")
                  for a, b in both)).first()
    return float(max(abs(cov[f"{a}_{b}"] - (a == b)) for a, b in both))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and each of its first components."""
    x = quantised(vectors)
    once = stored(x.select("x").distinct())
    f = fit(once)
    schema = ("vec_id long, component int, n long, deviation long, deviation_exact string, "
              "whitened double, explained double, identity_error double")
    if f is None:
        return x.sparkSession.createDataFrame([], schema)
    k = min(components, len(f.values))
    error = identity_error(once, f, k)
    explained = [float(e) / f.trace if f.trace > 0 else None for e in np.maximum(f.values[:k], 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not len(frame):
                continue
            w, deviation = projected(_matrix(frame["x"]), f, k)
            fits = pd.array([d if d <= LONG else None for d in deviation], "Int64")
            text = pd.Series(list(map(str, deviation)), dtype=object)
            for c in range(k):
                value = pd.array(w[:, c], "Float64")
                yield pd.DataFrame({
                    "vec_id": frame["id"], "named": frame["named"], "component": c + 1, "n": f.n,
                    "deviation": fits, "deviation_exact": text, "whitened": value,
                    "explained": explained[c], "identity_error": error})

    out = x.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNotNull().alias(
        "named"), "x").mapInPandas(run, f"{schema}, named boolean")
    return out.select(
        F.when(F.col("named"), F.col("vec_id")).alias("vec_id"), "component", "n", "deviation",
        F.col("deviation_exact").cast("decimal(38,0)").alias("deviation_exact"), F.nanvl(
            "whitened", F.lit(None).cast("double")).alias("whitened"), "explained", "identity_error")
