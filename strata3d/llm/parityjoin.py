"""Similarity join of shingle sets by parity sketches.

A set is XOR-hashed: every shingle toggles one bit of a sketch, so two sketches differ in at most as
many bits as the sets differ in shingles. Sets that resemble each other enough differ in at most
`budget` shingles. The sketch of a size band is cut into half as many pieces again as the band's
budget; a shingle toggles a bit of one piece, so by the pigeonhole principle all but `budget` pieces
of such a pair are equal, and in any common order of pieces each of the two holds an equal one among
its first budget + 1. Pieces with more shingles come first, since a passage that many texts share
fills the light ones. A piece is 2^64 bits wide and kept as the XOR of its shingles' digests.

A set goes to its own band and, if it may resemble sets of the next one, to that band as well. Sets
with an equal piece are candidates; their compact sketches are compared by Hamming distance, and
what passes is verified on the full sets. Equal sets are one set from the start, and only sets in
different components are compared, so a pile of near copies costs no pair for each two of them.

Defined cases: a null text, or one without a word, has the empty set and is linked with nothing; fewer
words than a shingle are one shingle; a null id is no candidate for component_id, which is null if no
member has one; repeated rows are kept, one result each, and linked as their sets are equal; an empty
table gives an empty result. Only `doc_id` and `text` are read. Shingles and sets are told apart by
64-bit digests: of s distinct sets, s^2 / 2^65 pairs are expected to be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata3d.session import stored

from . import components
from .shingling import SALTS, SEED, digests

#: Pairs of different classes a holder of a key under which all of a key's sketches are compared.
DENSE = 512
#: Keys of a set that the first round looks at.
FIRST = 4
#: Holders of a key whose sketches one call compares; more are dealt into blocks, compared in pairs.
BLOCK = 1024


class Rule(NamedTuple):
    """Shingle size, and the least Jaccard similarity as a fraction num / den."""

    words: int
    num: int
    den: int

    def budget(self, n: int) -> int:
        """The most shingles in which a set of n differs from any larger or equal one it links to."""
        most = self.den * n // self.num
        return (self.den - self.num) * (n + most) // (self.den + self.num)

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return self.den * both >= self.num * (len(x) + len(y) - both) and both > 0


JOIN = Rule(4, 85, 100)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Ascending digests of the distinct shingles."""
    return np.unique(digests(text, words))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the digests on a power of two of bits, two to four for each digest."""
    bits = max(64, 2 << (len(h) - 1).bit_length()) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches, the longer one folded to the shorter one's bits."""
    m = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, m) ^ folded(y, m)).sum())


def folded(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_of(h: np.ndarray, band: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Key and number of shingles of each piece of the band's sketch.

    The piece of a digest is told by its leading bits, so the pieces of sorted digests are runs.
    """
    m = rule.budget(2 << band) * 3 // 2 + 2
    at = ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    n = np.bincount(at, minlength=m)
    value = np.zeros(m, np.uint64)
    full = np.flatnonzero(n)
    value[full] = np.bitwise_xor.reduceat(h, np.append(0, np.cumsum(n[full])[:-1]))
    place = np.arange(m, dtype=np.uint64) + np.uint64(band << 40)
    return _mix(_mix(value) + _mix(place) + n.astype(np.uint64)), n


def keys(h: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the pieces under which a set is looked up, ascending; none if only its equal links."""
    n = len(h)
    budget = rule.budget(n)
    if not budget:
        return np.zeros(0, np.uint64)
    band = n.bit_length() - 1
    out = []
    for b in (band, band + 1) if rule.den * n // rule.num >= 2 << band else (band,):
        key, weight = pieces_of(h, b, rule)
        out.append(key[np.lexsort((key, -weight))[:budget + 1]])
    return np.unique(np.concatenate(out))


def sets_of(docs: DataFrame, rule: Rule) -> DataFrame:
    """`row` (hash of id and text), `doc_id`, the set's size `n` and digest `node` of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            held = [shingle_set(t, rule.words) for t in frame["text"]]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes(), SEED) for h in held], np.uint64)
            yield pd.DataFrame({"row": frame["row"], "id": frame["id"], "named": frame["named"],
                                "n": [len(h) for h in held], "node": node.view(np.int64)})

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.coalesce(
        "doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("named"), "text")
    out = keyed.mapInPandas(run, "row long, id long, named boolean, n long, node long")
    return out.select("row", F.when(F.col("named"), F.col("id")).alias("doc_id"), "n", "node")


def sketched(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """`node`, `n`, `text`, `sketch` and `keys` of each distinct set that has keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            held = [shingle_set(t, rule.words) for t in frame["text"]]
            yield pd.DataFrame({
                "node": frame["node"], "n": [len(h) for h in held], "text": frame["text"],
                "sketch": [sketch(h).tobytes() for h in held],
                "keys": [keys(h, rule).view(np.int64) for h in held]})

    one = stored(sets.where("n > 0").groupBy("node").agg(F.min("row").alias("row")))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(
        one, "row").dropDuplicates(["row"])
    return texts.select("node", "text").mapInPandas(
        run, "node long, n long, text string, sketch binary, keys array<long>").where(
        F.size("keys") > 0)


def verified(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """The `a`, `b` that link: first by sketch, then on the sets of their texts."""
    @F.pandas_udf("boolean")
    def close(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            (rule.den + rule.num) * differing(np.frombuffer(x, np.uint64),
                                              np.frombuffer(y, np.uint64))
            <= (rule.den - rule.num) * (m + n) for m, n, x, y in zip(na, nb, a, b)], dtype=bool)

    @F.pandas_udf("boolean")
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, y = [], None, None
        for s, t in zip(a, b):
            if t != last:                        # rows come sorted by b
                last, y = t, shingle_set(t, rule.words)
            out.append(rule.linked(shingle_set(s, rule.words), y))
        return pd.Series(out, dtype=bool)

    def end(c: str, *names: str) -> DataFrame:
        return held.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in names))

    near = stored(pairs.select("a", "b").distinct().join(end("a", "n", "sketch"), "a")
                  .join(end("b", "n", "sketch"), "b")
                  .where(close("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b"))
    return stored(near.join(end("a", "text"), "a").join(end("b", "text"), "b")
                  .where(link("text_a", "text_b")).select("a", "b"))


def _classes(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """`nodes` with the `class` that the links found so far put each one in."""
    if links is None:
        return nodes.withColumn("class", F.col("node"))
    root = components.components(links).withColumnRenamed("root", "class")
    return nodes.join(root, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _may(x: str, y: str, rule: Rule) -> F.Column:
    """Whether sets of these sizes can link."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num


def _near(node: np.ndarray, n: np.ndarray, of: np.ndarray, block: np.ndarray, sketches: list,
          rule: Rule, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different classes, and of different blocks if there are two, whose sketches allow a link.

    If `nearest`, of each holder only the pair that is within the allowance by most.
    """
    held = [np.frombuffer(x, np.uint64) for x in sketches]
    words = min(map(len, held))
    x = np.stack([folded(h, words) for h in held])
    two = len(np.unique(block)) > 1
    a, b = [], []
    most, with_ = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
    for i in range(len(x) - 1):
        j = np.flatnonzero(of[i + 1:] != of[i]) + i + 1
        j = j[np.minimum(n[j], n[i]) * rule.den >= np.maximum(n[j], n[i]) * rule.num]
        if two:
            j = j[block[j] != block[i]]
        if len(j):
            apart = np.bitwise_count(x[j] ^ x[i]).sum(axis=1, dtype=np.int64)
            spare = (rule.den - rule.num) * (n[j] + n[i]) - (rule.den + rule.num) * apart
            j, spare = j[spare >= 0], spare[spare >= 0]
            if not nearest:
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
            elif len(j):
                better = spare > most[j]
                most[j[better]], with_[j[better]] = spare[better], i
                k = int(spare.argmax())
                if spare[k] > most[i]:
                    most[i], with_[i] = spare[k], j[k]
    if nearest:
        has = np.flatnonzero(most >= 0)
        a, b = [node[has]], [node[with_[has]]]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def _compared(rows: DataFrame, held: DataFrame, rule: Rule, nearest: bool = False) -> DataFrame:
    """`a`, `b`: holders of one key in different classes whose sketches allow a link, see `_near`.

    Keys lie one after the other in sorted partitions. A key with more than BLOCK holders is dealt
    into blocks, and every two blocks (and each with itself) meet as a key of their own.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            at = frame[["key", "lo", "hi"]].to_numpy()
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist()]
            yield part(frame.iloc[:cut[-1]], cut)
            rest = frame.iloc[cut[-1]:]
        if rest is not None and len(rest):
            yield part(rest, [0, len(rest)])

    def part(frame: pd.DataFrame, cut: list[int]) -> pd.DataFrame:
        node, n, of, block = (frame[c].to_numpy() for c in ("node", "n", "class", "block"))
        sketches, out = frame["sketch"].tolist(), [(np.zeros(0, np.int64),) * 2]
        for i, j in zip(cut, cut[1:]):
            if j - i > 1:
                out.append(_near(node[i:j], n[i:j], of[i:j], block[i:j], sketches[i:j], rule,
                                 nearest))
        a, b = map(np.concatenate, zip(*out))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(BLOCK)), blocks).cast("int")
    dealt = rows.withColumn("block", mine).withColumn("other", F.explode(
        F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "block", "node", "n", "class")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.join(held.select("node", "sketch"), "node").repartition(
        parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(
        run, "a long, b long").distinct()


def links(held: DataFrame, rule: Rule, found: DataFrame | None = None,
          nearest: bool = False) -> DataFrame:
    """`a`, `b`: links that join all sets of `held` that link, directly or in steps.

    `found` holds links known before. First each set is compared with the one set of another class
    that shares most of its least keys. Then every key whose holders lie in more than one class is
    opened. While keys hold very many pairs of different classes, all holders of a key are compared
    with one, which then leaves the key; what remains is compared sketch by sketch, key by key. If
    `nearest`, each holder's nearest pair is tried first, so that a family of many links is one class
    before its other pairs are listed.
    """
    nodes = held.select("node", "n")

    def more(new: DataFrame) -> DataFrame:
        return new if found is None else stored(found.unionByName(new))

    first = held.select("node", "n", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    mine = stored(first.join(_classes(nodes, found).select("node", "class"), "node"))
    lead = mine.groupBy("key").agg(F.min_by(F.struct("node", "n", "class"), F.xxhash64(
        "node")).alias("y"), F.count("*").alias("c")).where("c > 1")
    shared = mine.alias("x").join(lead, "key").where(
        (F.col("x.class") != F.col("y.class")) & _may("x", "y", rule)).groupBy(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"))
    best = shared.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    found = more(verified(best, held, rule))

    of = stored(_classes(nodes, found)).select("node", "class")
    spread = held.select("node", "n", "keys").join(of, "node").select(
        "node", "n", "class", F.explode("keys").alias("key"))

    def opened(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("key")
        return stored(rows.withColumn("lo", F.min("class").over(w)).withColumn(
            "hi", F.max("class").over(w)).withColumn("c", F.count("*").over(w)).where(
            "lo < hi").drop("lo", "hi"))

    rows = opened(spread)
    for k in count():
        parts = rows.groupBy("key", "class").agg(F.count("*").alias("c"))
        size = parts.groupBy("key").agg(F.sum("c").alias("rows"), F.sum(
            F.col("c") * F.col("c")).alias("alike")).agg(
            F.sum("rows").alias("rows"),
            F.sum(F.col("rows") * F.col("rows") - F.col("alike")).alias("pairs")).first()
        if not size["rows"]:
            return found
        if size["pairs"] <= DENSE * size["rows"] and nearest:
            nearest = False
            found = more(verified(_compared(rows, held, rule, True), held, rule))
            of = stored(_classes(nodes, found)).select("node", "class")
            rows = opened(rows.drop("class", "c").join(of, "node").select(
                "node", "n", "class", "key"))
            continue
        if size["pairs"] <= DENSE * size["rows"]:
            return more(verified(_compared(rows, held, rule), held, rule))
        lead = stored(rows.groupBy("key").agg(F.min_by(
            F.struct("node", "n", "class"), F.xxhash64("node", F.lit(k))).alias("y")))
        star = rows.alias("x").join(lead, "key").where(
            (F.col("x.class") != F.col("y.class")) & _may("x", "y", rule)).select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        found = more(verified(star, held, rule))
        left = rows.join(lead.select("key", F.col("y.node").alias("node")), ["key", "node"],
                         "left_anti").drop("class", "c")
        of = stored(_classes(nodes, found)).select("node", "class")
        rows = opened(left.join(of, "node").select("node", "n", "class", "key"))


def joined(docs: DataFrame, rule: Rule = JOIN) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of every row.

    Rows meet their component on (set, salt), so the rows of one set spread over tasks.
    """
    docs = docs.select("doc_id", "text")
    sets = stored(sets_of(docs, rule)).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    held = stored(sketched(docs, sets, rule))
    each = stored(sets.where("n > 0").groupBy("node", "salt").agg(F.min("doc_id").alias("least")))
    of = stored(_classes(each.groupBy("node").agg(F.min("least").alias("least")),
                         links(held, rule, nearest=True)))
    name = stored(of.groupBy("class").agg(F.min("least").alias("component_id")))
    spread = each.select("node", "salt").join(
        of.join(name, "class").select("node", "component_id"), "node")
    some = sets.where("n > 0").join(spread, ["node", "salt"])
    out = ("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.select(*out).unionByName(sets.where("n = 0").withColumn(
        "component_id", F.col("doc_id")).select(*out))
