"""SimHash near duplicates by covering locality-sensitive hashing.

Every word shingle votes on the 64 bits of its text's fingerprint. Fingerprints that differ in at
most RADIUS bits are linked. The tables of a covering family mask bits so that each bit is left out
of a table by the parity of a 3-bit label: whatever two bits differ, some table leaves both out, so
every pair within the radius shares its masked value there. Crowded values are masked once more by
the same scheme over the bits still free, until at most 2^FREE values can share one; then a group
fits a task whatever the data. Inside a group only a spanning forest of the links leaves the task.

Near copies of the pipeline (`copies`) are what fingerprints bring together and the sets of word
shingles prove; what the fingerprints miss, the parity-sketch join finds.

Defined cases: a null text or one without a word has fingerprint zero, linked like any other; fewer
words than a shingle are one shingle; rows with a null id get a fingerprint and a component, whose
id is the least non-null id in it (null if there is none); repeated rows are kept, one result each;
an empty table gives an empty result. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored

from . import components, parityjoin
from .shingling import SALTS, digests

RADIUS = 2
SHINGLE = 3
#: Fingerprints sharing a masked value above which it is masked once more.
CROWDED = 2_000
#: Free bits under which a group is small whatever the data.
FREE = 14
#: Of near copies: words of a shingle, and the similarity of the sets of these.
SIMILAR = parityjoin.Rule(5, 80, 100)
def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of the digests."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 15):
        part = h[a:a + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id` and signed 64-bit `fp` of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            fp = np.array([fingerprint(digests(t, SHINGLE)) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def covering(bits: tuple[int, ...], radius: int = RADIUS) -> list[int]:
    """Masks over `bits`: for any `radius` of them, one of the masks leaves all of these out.

    Bit i carries a label of radius+1 bits, 37 i mod 2^(radius+1); mask v keeps the bits whose label
    has an odd number of ones in common with v. Some non-zero v is orthogonal to any `radius`
    labels; the factor spreads few bits over all labels, so that every mask keeps some.
    """
    n = 1 << (radius + 1)
    return [sum(1 << b for i, b in enumerate(bits) if ((37 * i % n) & v).bit_count() % 2)
            for v in range(1, n)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def local_links(fp: np.ndarray, free: int, radius: int = RADIUS) -> tuple[
        np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that differ in free bits only."""
    fp = np.unique(fp)
    parent = np.arange(len(fp))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    used: list[tuple[int, int]] = []

    def link(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append((b, a))

    bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    if len(fp) <= 2 * sum(comb(len(bits), k) for k in range(1, radius + 1)):
        for i in range(len(fp) - 1):
            j = np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius) + i + 1
            link(np.full(len(j), i), j)
    else:
        for k in range(1, radius + 1):
            for flips in combinations(bits, k):
                other = fp ^ np.bitwise_or.reduce(np.array(flips, np.uint64))
                at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
                i = np.flatnonzero((fp[at] == other) & (at > np.arange(len(fp))))
                link(i, at[i])
    ends = np.array(used, np.int64).reshape(-1, 2)
    return fp[ends[:, 0]], fp[ends[:, 1]]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _linked(keys: DataFrame, radius: int) -> DataFrame:
    """Links inside the groups of (mask, masked value); every group is small by now.

    Groups lie one after the other in sorted partitions, since most are too small to be worth a
    call each; only a group cut by the end of a batch is carried over.
    """
    def found(mask: np.ndarray, cut: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        size = np.diff(cut)
        i = cut[:-1][size == 2]
        near = np.bitwise_count(fp[i] ^ fp[i + 1]) <= radius
        a, b = [fp[i + 1][near]], [fp[i][near]]
        for i, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            x, y = local_links(fp[i:i + n], ~int(mask[i]) & (2 ** 64 - 1), radius)
            a.append(x)
            b.append(y)
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64),
                             "b": np.concatenate(b).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = value = np.zeros(0, np.int64)
        fp = np.zeros(0, np.uint64)
        for frame in batches:
            mask = np.append(mask, frame["mask"].to_numpy(np.int64))
            value = np.append(value, frame["value"].to_numpy(np.int64))
            fp = np.append(fp, frame["fp"].to_numpy(np.int64).view(np.uint64))
            cut = np.append(0, np.flatnonzero((mask[1:] != mask[:-1])
                                              | (value[1:] != value[:-1])) + 1)
            yield found(mask, cut, fp)
            mask, value, fp = mask[cut[-1]:], value[cut[-1]:], fp[cut[-1]:]
        yield found(mask, np.array([0, len(fp)]), fp)

    return (keys.repartition(_parts(keys), "mask", "value").sortWithinPartitions("mask", "value")
            .mapInPandas(run, "a long, b long"))


def _masked(fps: DataFrame, masks: F.Column) -> DataFrame:
    return (fps.withColumn("mask", F.explode(masks))
            .withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`a`, `b`: links that join all distinct `fp` within the radius, directly or in steps."""
    free = {_signed(m): tuple(b for b in range(64) if not m >> b & 1)
            for m in covering(tuple(range(64)), radius)}
    # the table of fingerprints is small and may lie in few files: spread it before it grows
    keys = _masked(fps.select("fp").repartition(_parts(fps)),
                   F.array(*(F.lit(m).cast("long") for m in free)))
    found = None
    while True:
        sizes = stored(keys.groupBy("mask", "value").agg(F.count("*").alias("n"))
                       .where(F.col("n") > 1))
        done = F.col("n") <= CROWDED
        if deep := [m for m, b in free.items() if len(b) <= FREE]:
            done |= F.col("mask").isin(deep)
        some = _linked(keys.join(sizes.where(done).drop("n"), ["mask", "value"]), radius)
        found = some if found is None else found.unionByName(some)
        crowded = stored(sizes.where(~done).drop("n"))
        present = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # few masks
        if not present:
            return found
        pairs = [(m, _signed(m & (2 ** 64 - 1) | x)) for m in present
                 for x in covering(free[m], radius)]
        finer = fps.sparkSession.createDataFrame(pairs, "mask long, finer long")
        held = keys.join(crowded, ["mask", "value"]).join(F.broadcast(finer), "mask")
        keys = stored(held.select("fp", F.col("finer").alias("mask"),
                                  F.col("fp").bitwiseAND(F.col("finer")).alias("value")).distinct())
        free = {x: tuple(b for b in range(64) if not x >> b & 1) for _, x in pairs}


def components_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`doc_id`, `fp` and `component_id` of each row of `prints` (`doc_id`, `fp`).

    Rows meet their component on (fingerprint, salt), so one fingerprint's rows spread over tasks.
    """
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    each = stored(salted.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")))
    fps = stored(each.groupBy("fp").agg(F.min("least").alias("least")))
    root = components.components(links(fps, radius))
    joined = stored(fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"))
    named = stored(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = joined.join(named, "root").select("fp", "component_id")
    spread = each.select("fp", "salt").join(of_fp, "fp")
    return salted.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hexadecimal digits) and `component_id` of every row."""
    out = components_of(stored(fingerprints(docs)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets, given as their ascending 64-bit elements."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def copies(docs: DataFrame, rule: parityjoin.Rule = SIMILAR) -> DataFrame:
    """`row` (hash of id and text) of every document to drop: one of each group of near copies stays.

    Near copies are documents whose shingle sets link by the rule, directly or in steps; the least
    (id, row) of a group stays. Equal sets are one set. What shares a component of fingerprints is
    compared with the least of it on the full sets; pairs that fingerprints miss are found by the
    parity-sketch join, so that no link is lost. Documents without a word are copies of each other.
    Rows equal in id and text have one `row`.
    """
    docs = docs.select("doc_id", "text")
    at = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "row").alias("at")
    sets = stored(parityjoin.sets_of(docs, rule))
    held = stored(parityjoin.sketched(docs, sets, rule))
    prints = stored(fingerprints(held.select(F.col("node").alias("doc_id"), "text")))
    near = components_of(prints).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    found = parityjoin.verified(near.where("a != b"), held, rule)
    root = components.components(parityjoin.links(held, rule, found))
    rows = sets.select(at, "node", F.pmod("row", F.lit(SALTS)).alias("salt"))
    # the rows of one set meet what stays of its group on a salt as well
    each = stored(rows.groupBy("node", "salt").agg(F.min("at").alias("at")))
    of = stored(each.groupBy("node").agg(F.min("at").alias("at")).join(root, "node", "left")
                .select(F.coalesce("root", "node").alias("root"), "node", "at"))
    stays = of.groupBy("root").agg(F.min("at").alias("stays"))
    spread = each.select("node", "salt").join(
        of.join(stays, "root").select("node", "stays"), "node")
    return rows.join(spread, ["node", "salt"]).where(F.col("at") != F.col("stays")).select(
        F.col("at.row").alias("row")).distinct()
