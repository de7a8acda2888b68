"""Building outlines from a height-above-ground surface.

Cells at least one storey high are labelled tile by tile, labels that meet across tile seams
are merged by repeated minimum over the seam graph. Sides of runs that no high cell meets are linked
into chains tile by tile; chains that go on in another tile find their ring and their place in it by
pointer doubling, so a component over many tiles is traced in as many tasks. Only the corners of a
ring, which are one row of the result, meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planar import simplify
from ..schemas import MIN_BUILDING_HEIGHT_M, MIN_FOOTPRINT_M2, PARTS, SIMPLIFY_M
from ..session import stored

_RUN = "raster_id string, label long, row int, c0 int, c1 int"


def _tile_runs(batches):
    """Horizontal runs of high cells with a label per 4-connected piece of the tile."""
    for pdf in batches:
        out = []
        for t in pdf.itertuples(index=False):
            high = np.asarray(t.values_, dtype=float).reshape(t.nrows, t.ncols)
            high = np.nan_to_num(high, nan=-1.0) >= MIN_BUILDING_HEIGHT_M
            parent: list[int] = []

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            runs, above = [], []
            for r in range(t.nrows):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], high[r].view(np.int8), [0]])))
                here = []
                for a, b in zip(edge[::2], edge[1::2]):
                    k = len(parent)
                    parent.append(k)
                    for a2, b2, k2 in above:
                        if a < b2 and a2 < b:
                            parent[root(k)] = root(k2)
                    here.append((a, b, k))
                    runs.append((r, a, b, k))
                above = here
            if len(parent) >> 22 or t.tile_col >> 20 or t.tile_row >> 20:
                raise ValueError("a tile of over 2^22 runs, or a raster of over 2^20 tiles a side")
            base = ((t.tile_row << 20) + t.tile_col) << 22
            out += [(t.raster_id, base + root(k), t.tile_row * t.nrows + r,
                     t.tile_col * t.ncols + a, t.tile_col * t.ncols + b)
                    for r, a, b, k in runs]
        yield pd.DataFrame(out, columns=["raster_id", "label", "row", "c0", "c1"])


def labelled_runs(height: DataFrame) -> DataFrame:
    """Runs [c0, c1) of high cells on the raster's global grid with their tile label."""
    t = height.select("raster_id", "tile_row", "tile_col", "ncols", "nrows",
                      F.col("values").alias("values_"))
    return t.mapInPandas(_tile_runs, _RUN)


def merge_labels(runs: DataFrame, ncols: int, nrows: int) -> DataFrame:
    """label -> component, merging labels that meet across tile seams.

    Only runs at tile borders enter the graph. Each round takes the smallest label in reach
    and then shortcuts through it, so rounds grow with the logarithm of the chain length.
    """
    spark = runs.sparkSession
    right = runs.filter(F.col("c1") % ncols == 0).select("raster_id", "row", F.col("c1").alias(
        "c"), F.col("label").alias("a"))
    left = runs.filter(F.col("c0") % ncols == 0).select("raster_id", "row", F.col("c0").alias(
        "c"), F.col("label").alias("b"))
    across = right.join(left, ["raster_id", "row", "c"]).select("raster_id", "a", "b")

    def cells(df, name):
        return df.select("raster_id", "row", F.explode(F.sequence("c0", F.col("c1") - 1))
                         .alias("c"), F.col("label").alias(name))

    low = cells(runs.filter((F.col("row") + 1) % nrows == 0)
                .withColumn("row", F.col("row") + 1), "a")
    top = cells(runs.filter(F.col("row") % nrows == 0), "b")
    down = low.join(top, ["raster_id", "row", "c"]).select("raster_id", "a", "b")
    edge = across.unionByName(down).filter("a <> b").distinct()
    both = stored(edge.unionByName(edge.select("raster_id", F.col("b").alias("a"),
                                                    F.col("a").alias("b"))))
    comp = stored(both.select("raster_id", F.col("a").alias("label")).distinct()
                       .withColumn("component", F.col("label")))
    while True:
        near = (both.join(comp.select("raster_id", F.col("label").alias("b"), "component"),
                          ["raster_id", "b"])
                .groupBy("raster_id", F.col("a").alias("label"))
                .agg(F.min("component").alias("_m")))
        step = (comp.join(near, ["raster_id", "label"])
                .select("raster_id", "label", F.col("component").alias("_old"),
                        F.least("component", "_m").alias("component")))
        jump = step.select("raster_id", F.col("label").alias("component"),
                           F.col("component").alias("_j"))
        step = (step.join(jump, ["raster_id", "component"], "left")
                .select("raster_id", "label", "_old",
                        F.coalesce("_j", "component").alias("component")))
        step = stored(step)
        changed = step.filter("component <> _old").limit(1).count()
        comp = step.drop("_old")
        if not changed:
            return comp


def open_sides(runs: DataFrame, below: bool) -> DataFrame:
    """Stretches of the lower (upper) side of each run that no run of the next row covers.

    Runs end at tile borders, so those that can meet share a tile column.
    """
    key = ["raster_id", "component", "tile_row", "tile_col", "row", "c0", "c1"]
    other = runs.select(F.col("raster_id").alias("_r"), F.col("component").alias("_c"),
                        F.col("tile_col").alias("_t"),
                        (F.col("row") + (-1 if below else 1)).alias("_row"),
                        F.col("c0").alias("_b0"), F.col("c1").alias("_b1"))
    met = ((F.col("raster_id") == F.col("_r")) & (F.col("component") == F.col("_c"))
           & (F.col("tile_col") == F.col("_t")) & (F.col("row") == F.col("_row"))
           & (F.col("_b0") < F.col("c1")) & (F.col("c0") < F.col("_b1")))
    covered = runs.join(other, met, "left").groupBy(*key).agg(F.sort_array(F.collect_list(
        F.when(F.col("_b0").isNotNull(), F.struct("_b0", "_b1")))).alias("by"))
    gaps = F.arrays_zip(F.concat(F.array("c0"), F.col("by._b1")).alias("a"),
                        F.concat(F.col("by._b0"), F.array("c1")).alias("b"))
    side = covered.select(*key, F.explode(F.filter(gaps, lambda g: g["a"] < g["b"])).alias("g"))
    # rows grow downwards: walking with the interior on the left in map space
    y = F.col("row") + (1 if below else 0)
    a, b = ("g.a", "g.b") if below else ("g.b", "g.a")
    return side.select(*_AT, F.col(a).alias("x0"), y.alias("y0"), F.col(b).alias("x1"),
                       y.alias("y1"))


_AT = ["raster_id", "component", "tile_row", "tile_col"]


def boundary_steps(runs: DataFrame) -> DataFrame:
    """Directed sides of a component, each within one tile; never unfolds the cells of a run."""
    lefts = runs.select(*_AT, "row", F.col("c0").alias("c"))
    rights = runs.select(*_AT, "row", F.col("c1").alias("c"))
    # runs of one component split at tile seams meet there; those sides are not open
    on = ["raster_id", "component", "row", "c"]
    west = lefts.join(rights.select(*on), on, "left_anti").select(
        *_AT, F.col("c").alias("x0"), F.col("row").alias("y0"), F.col("c").alias("x1"),
        (F.col("row") + 1).alias("y1"))
    east = rights.join(lefts.select(*on), on, "left_anti").select(
        *_AT, F.col("c").alias("x0"), (F.col("row") + 1).alias("y0"), F.col("c").alias("x1"),
        F.col("row").alias("y1"))
    return open_sides(runs, True).unionByName(open_sides(runs, False)).unionByName(
        west).unionByName(east)


_CHAIN = ("raster_id string, component long, x0 int, y0 int, x1 int, y1 int, xs array<int>, "
          "ys array<int>")


def _chains(steps: pd.DataFrame) -> pd.DataFrame:
    """Link one tile's steps into chains, corners only; a chain that ends where it starts is a ring."""
    rows = steps[["component", "x0", "y0", "x1", "y1"]].values.tolist()
    begin: dict = {}
    for i, (c, x, y, _, _) in enumerate(rows):
        begin.setdefault((c, x, y), []).append(i)
    # where two cells touch diagonally, turn left: that stays with the cell, and so in the tile
    after = [max(begin.get((c, x1, y1), [-1]), key=lambda k: (y1 - y0) * (rows[k][3] - x1)
                 - (x1 - x0) * (rows[k][4] - y1)) for c, x0, y0, x1, y1 in rows]
    fresh = [True] * len(rows)
    out = []
    for first in [*sorted(set(range(len(rows))) - set(after)), *range(len(rows))]:
        points, k, heading = [], first, None
        while k >= 0 and fresh[k]:
            fresh[k] = False
            _, x0, y0, x1, y1 = rows[k]
            if heading != (new := (np.sign(x1 - x0), np.sign(y1 - y0))):
                points.append((x0, y0))
            heading, k = new, after[k]
        if points:
            xs, ys = zip(*points)
            out.append((steps["raster_id"].iloc[0], rows[first][0], *points[0], x1, y1,
                        list(xs), list(ys)))
    return pd.DataFrame(out, columns=[f.split()[0] for f in _CHAIN.split(", ")])


def ring_places(chains: DataFrame) -> DataFrame:
    """`ring` (its least chain start) and `left` (chains to go to that one) of open chains.

    Pointer doubling: each round looks twice as far along the ring, until no chain finds a lesser
    start. Rounds grow with the logarithm of the chains in the longest ring.
    """
    key = ["raster_id", "component"]
    at = stored(chains.select(
        *key, F.struct("x0", "y0").alias("id"),
        F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0")).alias("to"),
        F.struct("x0", "y0").alias("ring"), F.lit(0).cast("long").alias("left")))
    hop = 1
    while True:
        ahead = at.select(*key, F.col("id").alias("to"), F.col("to").alias("_to"),
                          F.col("ring").alias("_ring"), F.col("left").alias("_left"))
        lesser = F.col("_ring") < F.col("ring")
        step = stored(at.join(ahead, [*key, "to"]).select(
            *key, "id", F.col("_to").alias("to"),
            F.when(lesser, F.col("_ring")).otherwise(F.col("ring")).alias("ring"),
            F.when(lesser, F.col("_left") + hop).otherwise(F.col("left")).alias("left"),
            lesser.alias("_moved")))
        at, hop = step.drop("_moved"), 2 * hop
        if not step.filter("_moved").limit(1).count():
            return at.drop("to")


def rings(steps: DataFrame) -> DataFrame:
    """raster_id, component, xs, ys: the corners of each ring in order, not closed."""
    chains = stored(steps.groupBy("raster_id", "tile_row", "tile_col").applyInPandas(
        _chains, _CHAIN))
    whole = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    done = chains.filter(whole).select("raster_id", "component", "xs", "ys")
    cut = chains.filter(~whole)
    if not cut.limit(1).count():
        return done
    placed = cut.withColumn("id", F.struct("x0", "y0")).join(
        ring_places(cut), ["raster_id", "component", "id"])
    # the least chain first, then those with the most still to go
    order = F.struct((F.col("left") != 0).alias("later"), (-F.col("left")).alias("n"), "xs", "ys")
    linked = placed.groupBy("raster_id", "component", "ring").agg(
        F.sort_array(F.collect_list(order)).alias("c"))
    return done.unionByName(linked.select("raster_id", "component", F.flatten("c.xs").alias("xs"),
                                          F.flatten("c.ys").alias("ys")))


def _polygon(xss, yss, res, origin):
    """The rings of one component as a simplified polygon, each from its least corner on; None if
    it is too small."""
    made = []
    for xs, ys in zip(xss, yss):
        r = np.column_stack([xs, ys]).astype(float)
        d = np.diff(np.vstack([r, r[:1]]), axis=0)
        turn = d[:, 0] * np.roll(d[:, 1], 1) - d[:, 1] * np.roll(d[:, 0], 1)
        r = r[turn != 0]
        r = np.roll(r, -int(np.lexsort((r[:, 1], r[:, 0]))[0]), axis=0)
        r = np.vstack([r, r[:1]]) * res + origin
        made.append(simplify(r, SIMPLIFY_M))
    made = [r for r in made if len(r) > 3]

    def size(r):
        d = r - r[0]
        return np.sum(d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]) / 2

    made.sort(key=lambda r: (-abs(size(r)), tuple(r[0])))
    area = abs(size(made[0])) - sum(abs(size(r)) for r in made[1:]) if made else 0.0
    if area < MIN_FOOTPRINT_M2:
        return None
    return [[[{"x": x, "y": y} for x, y in r] for r in made]]


def _polygons(batches):
    """One row per component, many to a batch: a group of its own would cost more than its rings."""
    for pdf in batches:
        pdf["parts"] = [
            _polygon(t.xs, t.ys, np.array([t.res_x, -t.res_y]), np.array([t.gx, t.gy]))
            for t in pdf.itertuples(index=False)]
        yield pdf.loc[pdf["parts"].notna(), ["raster_id", "component", "parts"]]


def outlines(height: DataFrame, ncols: int, nrows: int) -> DataFrame:
    """raster_id, component, parts: outlines of at least 15 m2, simplified to half a metre.

    `height`: tiles whose `values` are height above ground, on one regular tiling.
    """
    runs = stored(labelled_runs(height))
    merged = merge_labels(runs, ncols, nrows)
    # written: read back, its size is known, and a raster's components do not gather to meet it
    grid = stored(height.groupBy("raster_id").agg(
        F.min(F.col("x0") - F.col("tile_col") * F.col("ncols") * F.col("res_x")).alias("gx"),
        F.max(F.col("y0") + F.col("tile_row") * F.col("nrows") * F.col("res_y")).alias("gy"),
        F.first("res_x").alias("res_x"), F.first("res_y").alias("res_y")))
    whole = (runs.join(merged, ["raster_id", "label"], "left")
             .withColumn("component", F.coalesce("component", "label")).drop("label"))
    size = (whole.groupBy("raster_id", "component")
            .agg(F.sum(F.col("c1") - F.col("c0")).alias("n")).join(grid, "raster_id")
            .filter(F.col("n") * F.col("res_x") * F.col("res_y") >= MIN_FOOTPRINT_M2))
    kept = stored(whole.join(size.select("raster_id", "component"),
                                  ["raster_id", "component"], "left_semi")
                       .withColumn("tile_row", F.floor(F.col("row") / nrows).cast("int"))
                       .withColumn("tile_col", F.floor(F.col("c0") / ncols).cast("int")))
    found = rings(boundary_steps(kept)).groupBy("raster_id", "component").agg(
        F.collect_list(F.struct("xs", "ys")).alias("r"))
    return found.join(grid, "raster_id").select(
        "raster_id", "component", F.col("r.xs").alias("xs"), F.col("r.ys").alias("ys"), "gx", "gy",
        "res_x", "res_y").mapInPandas(
            _polygons, f"raster_id string, component long, parts {PARTS}")
