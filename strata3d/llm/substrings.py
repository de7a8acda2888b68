"""Substring dedup by content-defined chunking.

A gear hash rolls over the characters; a chunk ends where the hash is the strict least of REACH
characters to either side. Where a chunk ends thus depends on nearby characters only, so a passage
copied to another place is cut alike after its first few characters, whatever was put in before it.
Chunks are named by a 64-bit digest. A digest held by several documents stays in the one with the
least id; elsewhere runs of such chunks with at least `min_words` words are cut out.

Documents travel as arrays of digests; a digest's documents are reduced to the least and greatest
id by a partial aggregate, and the join back can be split where one passage is everywhere, as its
other side is a written table.

Defined cases: null and empty texts have no chunk and come back as they are; a text shorter than a
chunk is one chunk; repeats inside one document stay; rows that share an id are one document; rows
with a null id count as one document after all others; an empty table gives an empty result. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored

from . import textvec as V

#: Characters to either side over which a cut is the least; chunks are about twice as long.
REACH = 20
#: Characters the hash depends on: it moves by two bits a character.
MEMORY = 16
MIN_WORDS = 20
LAST = (1 << 63) - 1
GEAR = np.random.default_rng(42).integers(0, 1 << 32, 1024, dtype=np.uint32)
GEAR[0] = 0


def ends(flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Positions one past each chunk of the texts laid end to end; a text's end is always one."""
    pad = MEMORY + REACH
    place = np.arange(len(flat)) + (row + 1) * pad          # no text's hash sees another's
    size = len(flat) + (rows + 1) * pad
    h = np.zeros(size, np.uint32)
    h[place] = GEAR[(flat ^ (flat >> np.uint32(10))) & np.uint32(1023)]
    step = 1
    while step < MEMORY:
        h[step:] += h[:-step] << np.uint32(2 * step)
        step *= 2
    wide = np.full(size, 0xFFFFFFFF, np.uint32)
    wide[place] = h[place]
    def least(n: int) -> np.ndarray:
        """Least of the n values from each place on."""
        out, held = wide, 1
        while 2 * held <= n:
            out = np.minimum(out[:-held], out[held:])
            held *= 2
        return np.minimum(out[:len(out) - n + held], out[n - held:]) if held < n else out

    side = least(REACH)
    around = np.minimum(side[place - REACH], side[np.minimum(place + 1, len(side) - 1)])
    cut = wide[place] < around
    cut[:-1] |= row[1:] != row[:-1]
    cut[-1:] = True
    return np.flatnonzero(cut) + 1


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop (in the row's text) and digest of each chunk, in order."""
    flat, row = V.codes(texts)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    stop = ends(flat, row, len(texts))
    start = np.append(0, stop[:-1])
    digest = V.span_hashes(flat, start, stop).view(np.int64)
    base = np.searchsorted(row, np.arange(len(texts)))[row[start]]
    return row[start], start - base, stop - base, digest


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id` (LAST for null) and the distinct chunk `digests` of every row with text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in V.pieces(texts):
                row, _, _, digest = chunks(texts[a:b])
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "digests": [
                    np.unique(digest[i:j]) for i, j in zip(cut, cut[1:])]})

    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    return keyed.where(F.length("text") > 0).mapInPandas(run, "doc_id long, digests array<long>")


def foreign(docs: DataFrame) -> DataFrame:
    """`doc_id` (LAST for null) and `gone`, its digests that a document with a lesser id holds."""
    held = stored(digests(docs)).select("doc_id", F.explode("digests").alias("digest"))
    shared = stored(held.groupBy("digest").agg(F.min("doc_id").alias("first"),
                                               F.max("doc_id").alias("last"))
                    .where(F.col("first") < F.col("last")).select("digest", "first"))
    later = held.join(shared, "digest").where(F.col("doc_id") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))


def spans(text: str, gone: set[int], min_words: int) -> list[tuple[int, int]]:
    """Runs of chunks with a digest in `gone` that hold at least `min_words` words."""
    _, start, stop, digest = chunks([text])
    out: list[tuple[int, int]] = []
    for a, b, d in zip(start.tolist(), stop.tolist(), digest.tolist()):
        if d in gone:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return [(a, b) for a, b in out if len(text[a:b].split()) >= min_words]


def without(text: str, cut: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc_id`, shortened `text`, `n_cut` characters cut and their `cut_spans` (flat start, stop)
    in the given text, of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for text, gone in zip(frame["text"].tolist(), frame["gone"].tolist()):
                cut = [] if gone is None or text is None else spans(text, set(gone.tolist()),
                                                                    min_words)
                out.append((without(text, cut) if cut else text, sum(b - a for a, b in cut),
                            [x for s in cut for x in s]))
            text, n, cut = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": list(text), "n_cut": list(n),
                                "cut_spans": list(cut)})

    gone = foreign(docs).select(F.col("doc_id").alias("key"), "gone")
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("key"))
    return keyed.join(gone, "key", "left").select("doc_id", "text", "gone").mapInPandas(
        run, "doc_id long, text string, n_cut long, cut_spans array<long>")
