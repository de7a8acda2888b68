"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts are reduced to lower-case letters and digits with single blanks. An item of m characters that
occurs with at most e edits (`budget` of its length, rounded down) shares m - q + 1 - q*e of its
character q-grams with the text, all on diagonals (text position minus item position) no more than e
apart. q is 8, and m // (e + 1) for items too short for that, so the bound is 1 at least and every
length has its whole budget. Shared q-grams are counted in overlapping bands of 2(e + 1) diagonals, so
one band holds them all; bands that reach the bound are aligned on their diagonals, many at a time and
only as long as the budget holds, and regions with at most e edits are reported.

The benchmark is the stated query set: it is cut into blocks of BLOCK characters by a hash, each
block is indexed once and searched in all documents, so what is sent to the tasks is bounded. A text
that shares very many q-grams with the block (a phrase it repeats, which opens many items) is searched
in parts of MOST shared q-grams: fewer items at a time, then overlapping stretches of the text.

Defined cases: null or empty texts and items, and items with fewer than Q characters left, match
nothing; null ids and repeated rows are searched and reported each; overlapping hits
of one item are reported once, the one with fewest edits (then the first); empty tables give an
empty result. Only `doc_id`, `text` and `item_id`, `text` are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as V

Q = 8
#: Edits allowed, as a share of the item's characters.
BUDGET = 0.1
#: Characters of benchmark text indexed at a time.
BLOCK = 2_000_000
#: Shared q-grams unfolded at a time, and characters aligned at a time.
MOST = 2_000_000
_CELLS = 1_000_000
_FILTER = 22
_OUTSIDE, _PAST = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)      # equal to no character
_FAR = 1 << 24
_STEP = np.uint64(0x100000001B3)
RESULT = "doc_id long, item_id long, start long, stop long, edits int"


@cache
def _small() -> np.ndarray:
    low = [chr(i).lower() for i in range(0x10000)]
    return np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(low)], np.uint32)


def reduced(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, row and original offset of each character that counts, inner blanks single."""
    flat, row = V.codes(texts)
    start = np.searchsorted(row, np.arange(len(texts)))
    cls = V.classes(flat)
    solid = (cls == V.LETTER) | (cls == V.DIGIT)
    code = np.where(solid, np.where(flat < 0x10000, _small()[np.minimum(flat, 0xFFFF)], flat), 32)
    held = solid.copy()
    if len(code):
        held[1:] |= solid[:-1] & (row[1:] == row[:-1])
    at = np.flatnonzero(held)
    return code[at].astype(np.uint32), row[at], at - start[row[at]]


def grams(code: np.ndarray, row: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each q-gram inside one row."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = h * _STEP + code[i:i + n]
    at = np.flatnonzero(row[q - 1:] == row[:n])
    return V.mixed(h[at]), at


@dataclass(frozen=True)
class Grams:
    """The q-grams of the items of one q: sorted hashes, and for each its item and position."""

    q: int
    key: np.ndarray
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray             # which low hash bits occur at all

    def only(self, held: np.ndarray) -> Grams:
        return replace(self, key=self.key[held], item=self.item[held], at=self.at[held])


@dataclass(frozen=True)
class Index:
    """A block of items end to end, their budgets and bounds, and their q-grams by q."""

    ids: list
    codes: list[np.ndarray]
    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    grams: list[Grams]


def _low(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << _FILTER) - 1)).astype(np.int64)


def index(ids: list, texts: list[str | None], budget: float) -> Index:
    code, row, _ = reduced(texts)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    codes = [code[a:b] for a, b in zip(cut, cut[1:])]
    codes = [c[:-1] if len(c) and c[-1] == 32 else c for c in codes]
    m = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *codes])
    row = np.repeat(np.arange(len(codes)), m)
    start = np.append(0, np.cumsum(m))
    edits = (m * budget).astype(np.int64)
    q = np.where(m < Q, 0, np.minimum(Q, m // (edits + 1)))
    kinds = []
    for k in np.unique(q[q > 0]).tolist():
        key, at = grams(flat, row, k)
        mine = q[row[at]] == k
        key, at = key[mine], at[mine]
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << _FILTER, bool)
        seen[_low(key)] = True
        kinds.append(Grams(k, key[order], row[at][order], (at - start[row[at]])[order], seen))
    return Index(ids, codes, flat, start, m, edits, m - q + 1 - q * edits, kinds)


def _parts(ix: Index, g: Grams, key: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """The q-grams of a text in parts that share near MOST with the items of each part."""
    todo = [(g, key, at)]
    while todo:
        g, key, at = todo.pop()
        low = np.searchsorted(g.key, key)
        times = np.searchsorted(g.key, key, side="right") - low
        total = int(times.sum())
        if total > MOST:
            key, at = key[times > 0], at[times > 0]
            kinds, n = np.unique(key, return_counts=True)
            place = np.minimum(np.searchsorted(kinds, g.key), len(kinds) - 1)
            shared = np.bincount(g.item, weights=np.where(kinds[place] == g.key, n[place], 0))
            items = np.flatnonzero(shared)
            if len(items) > 1:
                half = int(np.searchsorted(np.cumsum(shared[items]), total / 2))
                left = g.item <= items[min(half, len(items) - 2)]
                todo += [(g.only(left), key, at), (g.only(~left), key, at)]
                continue
            reach = int(ix.size[items[0]] + ix.edits[items[0]])
            if at[-1] - at[0] > 4 * reach:
                middle = int(at[0] + at[-1]) // 2
                first, second = at < middle + reach, at >= middle
                todo += [(g, key[first], at[first]), (g, key[second], at[second])]
                continue
        if total:
            yield g, at, low, times


def _bands(ix: Index, g: Grams, row: np.ndarray, at: np.ndarray, low: np.ndarray,
           times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, row and lowest diagonal of each band that holds the item's bound of q-grams."""
    place = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    at, item, on = np.repeat(at, times), g.item[place], g.at[place]
    # rows lie far enough apart on the virtual text for no band to meet two of them
    gap = int(ix.size.max()) + 2 * int(ix.edits.max()) + 2
    r = row[at]
    cell = (item << 40) | ((at + r * gap - on + gap) // (ix.edits[item] + 1))
    order = np.lexsort((on, cell))
    cell, on, r = cell[order], on[order], r[order]
    once = np.append(True, (cell[1:] != cell[:-1]) | (on[1:] != on[:-1]))
    cell, r = cell[once], r[once]
    cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    cells, n = cell[cut], np.diff(np.append(cut, len(cell)))
    # a band is a cell and the next one
    both = n + np.where(np.append(cells[1:] == cells[:-1] + 1, False), np.append(n[1:], 0), 0)
    picked = np.flatnonzero(both >= ix.bound[cells >> 40])
    item, r = cells[picked] >> 40, r[cut[picked]]
    return item, r, (cells[picked] & ((1 << 40) - 1)) * (ix.edits[item] + 1) - gap - r * gap


def _taken(flat: np.ndarray, first: np.ndarray, end: np.ndarray, step: int, width: int,
           begin: np.ndarray, other: np.uint32) -> np.ndarray:
    """`width` characters from `begin` on, by `step`; `other` where outside [first, end)."""
    at = begin[:, None] + step * np.arange(width)
    inside = (at >= first[:, None]) & (at < end[:, None])
    return np.where(inside, flat[np.where(inside, at, 0)], other)


def _edits(pattern: np.ndarray, text: np.ndarray, size: np.ndarray, most: np.ndarray,
           row: np.ndarray) -> np.ndarray:
    """Edits of each pattern's first `size` characters, by diagonal of `text`, from `row` on.

    One vector step per character for all patterns; those beyond their budget are left out early.
    """
    out = np.full(row.shape, _FAR, np.int32)
    ramp = np.arange(row.shape[1], dtype=np.int32)
    live, ends, width = np.arange(len(row)), set(size.tolist()), row.shape[1]
    for j in range(pattern.shape[1]):
        step = row + (text[:, j:j + width] != pattern[:, j:j + 1])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        if j + 1 in ends:
            done = size == j + 1
            out[live[done]] = row[done]
        if j % 8 == 7:
            held = (size > j + 1) & (row.min(axis=1) <= most)
            if 4 * held.sum() < 3 * len(held):
                live, row, size, most = live[held], row[held], size[held], most[held]
                pattern, text = pattern[held], text[held]
                if not len(live):
                    break
    return out


def _aligned(ix: Index, code: np.ndarray, first: np.ndarray, item: np.ndarray, r: np.ndarray,
             low: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, edits, start and stop of the best region of each band, within the budget.

    A region's path keeps within its edits of a diagonal of the band, so the band is widened by
    them. Of equally good stops the first is taken, of equally good starts the last.
    """
    order = np.argsort(-ix.size[item], kind="stable")
    while len(order):
        i = order[0]
        room = int(ix.size[item[i]] + 4 * ix.edits[item[order]].max() + 2)
        mine, order = np.split(order, [max(_CELLS // room, 1)])
        i, rows, size, most = item[mine], r[mine], ix.size[item[mine]], ix.edits[item[mine]]
        a, z, e, m = first[rows], first[rows + 1], int(most.max()), int(size.max())
        pattern = _taken(ix.flat, ix.start[i], ix.start[i] + size, 1, m, ix.start[i], _PAST)
        begin = low[mine] - most
        text = _taken(code, a, z, 1, m + 4 * e + 1, begin, _OUTSIDE)
        ends = _edits(pattern, text, size, most, np.zeros((len(i), 4 * e + 2), np.int32))
        at = ends.argmin(axis=1)
        least = ends[np.arange(len(i)), at]
        good = np.flatnonzero(least <= most)
        if not len(good):
            continue
        i, rows, size, least = i[good], rows[good], size[good], least[good]
        a, z = a[good], z[good]
        stop = np.minimum(begin[good] + size + at[good], z)
        m = int(size.max())
        pattern = _taken(ix.flat, ix.start[i], ix.start[i] + size, -1, m,
                         ix.start[i] + size - 1, _PAST)
        text = _taken(code, a, stop, -1, m + 2 * e, stop - 1 + e, _OUTSIDE)
        row = np.arange(-e, e + 1, dtype=np.int32)
        row = np.repeat(np.where(row < 0, _FAR, row).astype(np.int32)[None], len(i), axis=0)
        back = _edits(pattern, text, size, least, row)
        start = np.maximum(stop - (size + back.argmin(axis=1) - e), a)
        yield from zip(rows.tolist(), i.tolist(), least.tolist(), start.tolist(), stop.tolist())


def search(ix: Index, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item number, start and stop in the given text, and edits of each region found."""
    code, row, origin = reduced(texts)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    found: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
    for g in ix.grams:
        key, at = grams(code, row, g.q)
        near = g.seen[_low(key)]
        for part in _parts(ix, g, key[near], at[near]):
            bands = _bands(ix, part[0], row, *part[1:])
            for r, i, edits, a, z in _aligned(ix, code, first, *bands):
                found.setdefault((r, i), set()).add((edits, a, z))
    for (r, i), hits in found.items():
        held: list[tuple[int, int]] = []
        for edits, a, z in sorted(hits):
            k = bisect_left(held, (a, z))
            if (not k or held[k - 1][1] <= a) and (k == len(held) or z <= held[k][0]):
                held.insert(k, (a, z))
                yield r, i, int(origin[a]), int(origin[z - 1]) + 1, edits


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """One row per region of a document within the edit budget of a benchmark item."""
    items = benchmark.select("item_id", "text").where(F.length("text") >= Q)
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // BLOCK)
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.orderBy("item_id", "text").collect()       # near BLOCK characters
        found = _search_block(docs, rows, budget)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def _search_block(docs: DataFrame, rows: list, budget: float) -> DataFrame:
    ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]
    held = docs.sparkSession.sparkContext.broadcast(index(ids, texts, budget))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = held.value
        for frame in batches:
            texts = frame["text"].tolist()
            ids = frame["doc_id"].astype("object").where(frame["doc_id"].notna(), None).tolist()
            for a, b in V.pieces(texts):
                hits = [(None if ids[a + r] is None else int(ids[a + r]), ix.ids[i], s, z, e)
                        for r, i, s, z, e in search(ix, texts[a:b])]
                if hits:
                    yield pd.DataFrame({n: pd.Series(v, dtype="Int64") for n, v in zip(
                        ("doc_id", "item_id", "start", "stop", "edits"), zip(*hits))})

    return docs.select("doc_id", "text").mapInPandas(run, RESULT)
