"""Prefix trie of conversations in double arrays, a shard for each range of prefixes.

A turn is a 128-bit digest of role and text, a conversation the concatenation of its turns' digests.
Equal conversations are one path with a count. Paths are sorted into ranges, so all paths below a
prefix lie side by side and a shard is a run of them, whatever prefix is common: no key gathers its
rows in one task. A shard numbers its turns densely, packs BASE and CHECK over these ids (the child of
node s by turn c is slot BASE[s] + c if CHECK there is s), and walks its paths through them to count
members and sum up subtrees. Nodes off a shard's first and last path are whole in it. Those on them
may go on in a neighbour; they are merged globally: counts and sums over whole nodes add up, and what
each distinct shared node itself adds goes to its ancestors.

Defined cases: null role or text is empty; rows without conv_id belong to no conversation; turns of
one number are ordered by their digest; repeated rows are repeated turns; a conversation is one record,
as long as its turns are (16 bytes each); extra columns are not read; an empty table gives an empty
result. Digests that meet by chance (n^2 / 2^129 of n turns) are one turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata3d.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share their first turns, and the most turns they share.
BLOCK, SHARED = 20, 4
#: Bytes of a turn's digest; turns of a shard, at least one path; characters of a piece of an id list.
WIDTH, SHARD, PIECE = 16, 400_000, 1 << 16

NODE = ("shard binary, shared boolean, key binary, parent binary, above array<binary>, conv_id long, "
        "depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, words long, ends_sha256 string")
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
          "ends_sha256")


def rebuilt(turns: DataFrame) -> DataFrame:
    """`conv_id`, `path` (binary) and `words` (of each turn) of every conversation, rebuilt.

    Conversation c begins with the first crc32(c) % SHARED turns of c - c % BLOCK in place of its own.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    each = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct(
            F.col("turn").isNotNull().alias("set"), "turn", F.md5(said).alias("k"),
            F.regexp_count(text, F.lit(WORD)).alias("w")).alias("t"))
    own = stored(each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["k"].alias("k"), t["w"].alias("w"))).alias("ts")))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    head = own.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.slice("ts", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    mine = own.withColumn("base", base).withColumn("h", h).join(head, "base", "left")
    # slice takes positions that are there; an absent head is no turn
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("ts", 1, 0))
    rest = F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts") - F.col("h"), F.lit(0)))
    ts = F.concat(first, rest)
    return mine.select("conv_id", F.unhex(F.array_join(F.transform(ts, lambda t: t["k"]), "")).alias(
        "path"), F.transform(ts, lambda t: t["w"]).alias("words"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ends(members: DataFrame) -> DataFrame:
    """`key`, `ends_sha256`: SHA-256 of the ascending comma-joined `conv_id` of each key.

    A hash runs over its list in order. Range partitions cut the sorted list into pieces of text, and
    one task hashes pieces in order, holding one at a time.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            key, first, piece = [], [], []
            for k, of in groupby(zip(frame["key"], frame["conv_id"]), lambda r: r[0]):
                ids = [i for _, i in of]
                step = PIECE // 20
                for a in range(0, len(ids), step):
                    key.append(k)
                    first.append(ids[a])
                    piece.append(",".join(map(str, ids[a:a + step])))
            yield pd.DataFrame({"key": key, "first": first, "piece": piece})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, h = None, None
        for frame in batches:
            out = []
            for k, piece in zip(frame["key"], frame["piece"]):
                if k == last:
                    h.update(b"," + piece.encode())
                    continue
                if last is not None:
                    out.append((last, h.hexdigest()))
                last, h = k, hashlib.sha256(piece.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame({"key": [last], "ends_sha256": [h.hexdigest()]})

    n = _parts(members)
    pieces = members.repartitionByRange(n, "key", "conv_id").sortWithinPartitions(
        "key", "conv_id").mapInPandas(cut, "key binary, first long, piece string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInPandas(
        hashed, "key binary, ends_sha256 string")


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid * WIDTH] == b[:mid * WIDTH] else (lo, mid - 1)
    return lo


class DoubleArray:
    """BASE and CHECK of a trie, packed level by level over dense turn ids; slot 0 is the root."""

    def __init__(self) -> None:
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        self.free = 1                   # no slot before it is free

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def lone(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of parents that have one each: the next free slots, one after the other."""
        while True:
            open_ = np.flatnonzero(self.check[self.free:] < 0)
            if len(open_) >= len(parents):
                break
            self._grow(len(self.check) + len(parents))
        slots = open_[:len(parents)] + self.free
        self.base[parents] = slots - codes
        self.check[slots] = parents

    def family(self, parent: int, codes: np.ndarray) -> None:
        """The ascending codes of one parent: the first base at which all their slots are free."""
        away = codes - codes[0]
        while True:
            self._grow(self.free + 1)
            open_ = np.flatnonzero(self.check[self.free:] < 0) + self.free
            for slot in open_.tolist():
                self._grow(slot + int(away[-1]) + 1)
                if (self.check[slot + away] < 0).all():
                    self.base[parent] = slot - codes[0]
                    self.check[slot + away] = parent
                    return
            self._grow(2 * len(self.check))

    def settle(self) -> None:
        """Let `free` pass the slots that are taken by now."""
        open_ = np.flatnonzero(self.check[self.free:] < 0)
        self.free += int(open_[0]) if len(open_) else len(self.check) - self.free

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Child of each slot by its code; -1 if there is none."""
        to = self.base[slots] + codes
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def pack(paths: list[bytes]) -> tuple[DoubleArray, list[np.ndarray]]:
    """The double array of the sorted paths, and for each depth the dense ids there (-1 past the end)."""
    length = np.array([len(p) // WIDTH for p in paths])
    turns = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    start = np.append(0, np.cumsum(length))[:-1]
    shared = np.array([0, *(_lcp(a, b) for a, b in zip(paths, paths[1:]))])
    levels, seen, trie = [], {}, DoubleArray()
    slot = np.zeros(len(paths), np.int64)
    for d in range(int(length.max(initial=0))):
        at = np.flatnonzero(length > d)
        code = np.full(len(paths), -1, np.int64)
        # ids are dense in the order of first use, so the children of a node mostly lie together
        code[at] = [seen.setdefault(t, len(seen)) for t in map(tuple, turns[start[at] + d].tolist())]
        levels.append(code)
        # paths are sorted, so a node begins where less than d + 1 turns are shared with the one before
        new = at[[bool(np.min(shared[a + 1:b + 1], initial=d + 1) <= d)
                  for a, b in zip(np.append(-1, at[:-1]), at)]] if len(at) else at
        parent, child = slot[new], code[new]
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(first, len(parent)))
        for f, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            trie.family(int(parent[f]), np.sort(child[f:f + n]))
            trie.settle()
        one = first[size == 1]
        if len(one):
            trie.lone(parent[one], child[one])
            trie.settle()
        slot[at] = trie.step(slot[at], code[at])
    return trie, levels


def shard_nodes(paths: list[bytes], words: list, n: list[int], least: list[int],
                sha: list[str]) -> pd.DataFrame:
    """Every node of the trie of some sorted distinct paths, in the layout NODE."""
    trie, levels = pack(paths)
    size = len(trie.check)
    count, member, own = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    depth, end = np.zeros(size, np.int64), np.full(size, -1)
    weight, ids = np.array(n, np.int64), np.array(least, np.int64)
    slot, last = np.zeros(len(paths), np.int64), np.array([len(p) // WIDTH for p in paths])
    spine = {0: b""}
    for d in range(len(levels) + 1):
        at = np.flatnonzero(last >= d)
        if d:
            slot[at] = trie.step(slot[at], levels[d - 1][at])
            own[slot[at]] = [words[i][d - 1] for i in at.tolist()]
            depth[slot[at]] = d
            for i in {0, len(paths) - 1}:
                if last[i] >= d:
                    spine[int(slot[i])] = paths[i][:d * WIDTH]
        np.add.at(count, slot[at], weight[at])
        np.minimum.at(member, slot[at], ids[at])
        end[slot[at[last[at] == d]]] = at[last[at] == d]
    used = np.flatnonzero(count)
    shared = np.zeros(size, bool)
    shared[list(spine)] = True
    above = trie.check
    # a node on the spine is subtracted, and counted as a leaf, once it is merged
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), count * own - np.where(shared, 0, own)
    whole = used[~shared[used]]
    np.add.at(children, above[whole], 1)
    leaves[whole[children[whole] == 0]] = 1
    for d in range(len(levels), 0, -1):
        here = used[depth[used] == d]
        np.add.at(leaves, above[here], leaves[here])
        np.add.at(saved, above[here], saved[here])
    digest = {s: hashlib.md5(p).digest() for s, p in spine.items()}
    name = hashlib.md5(paths[0]).digest()
    nothing = hashlib.sha256(b"").hexdigest()
    up = [-1 if s == 0 else int(above[s]) for s in used.tolist()]
    lines = {s: [digest[t] for t in _line(s, above)] for s in spine}
    return pd.DataFrame({
        "shard": name, "shared": shared[used], "key": [digest.get(s) for s in used.tolist()],
        "parent": [digest.get(p) for p in up], "above": [lines.get(s) for s in used.tolist()],
        "conv_id": member[used], "depth": depth[used],
        "parent_conv_id": pd.array([None if p < 0 else int(member[p]) for p in up], "Int64"),
        "n_convs": count[used], "n_children": children[used], "n_leaves": leaves[used],
        "saved_tokens": saved[used], "words": own[used],
        "ends_sha256": [sha[e] if e >= 0 else None if s else nothing
                        for e, s in zip(end[used].tolist(), shared[used].tolist())]})


def _line(slot: int, above: np.ndarray) -> list[int]:
    """Slots over this one, up to the root."""
    out = []
    while slot:
        slot = int(above[slot])
        out.append(slot)
    return out


def nodes(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of `convs` (`conv_id`, `path`, `words`), in the layout RESULT."""
    convs = stored(convs.withColumn("key", F.unhex(F.md5("path"))))
    paths = convs.groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.any_value("path").alias("path"),
        F.any_value("words").alias("words")).join(ends(convs.select("key", "conv_id")), "key")
    paths = stored(paths.drop("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        turns = 0
        for frame in batches:
            for row in frame.itertuples(index=False, name=None):
                held.append(row)
                turns += len(row[0]) // WIDTH
                if turns >= SHARD:
                    yield shard_nodes(*map(list, zip(*held)))
                    held, turns = [], 0
        if held:
            yield shard_nodes(*map(list, zip(*held)))

    # a partition holds one shard or more; a shard ends with its partition
    some = stored(paths.select("path", "words", "n", "least", "ends_sha256").repartitionByRange(
        _parts(paths), "path").sortWithinPartitions("path").mapInPandas(run, NODE))
    whole, part = some.where("NOT shared"), some.where("shared")
    once = stored(part.groupBy("key").agg(
        *(F.any_value(c).alias(c) for c in ("parent", "above", "depth", "words")),
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in (
            "n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256")))
    kids = once.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("kids"))
    tree = stored(once.join(kids, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))))
    adds = tree.select(F.explode(F.concat("above", F.array("key"))).alias("key"), "words",
                       (F.col("n_children") == 0).cast("long").alias("leaf")).groupBy("key").agg(
        F.sum("words").alias("less"), F.sum("leaf").alias("leaf"))
    over = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    merged = tree.join(adds, "key").join(over, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("less")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    # a whole node under a shared one takes its parent's least member from the merged node; the
    # shard is part of the key, since much of a table may hang on the root
    known = part.select("shard", "key").join(tree.select("key", F.col("conv_id").alias("top")), "key")
    hung = whole.where("parent IS NOT NULL").join(
        known.withColumnRenamed("key", "parent"), ["shard", "parent"]).withColumn(
        "parent_conv_id", F.col("top"))
    return whole.where("parent IS NULL").select(*RESULT).unionByName(
        hung.select(*RESULT)).unionByName(merged)
