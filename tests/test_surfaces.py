import numpy as np
import pytest
from pyspark.sql import functions as F

from strata3d.functions import shapes
from strata3d.operators import footprints, raster
from strata3d.plans import detecting
from strata3d.schemas import TILE


def tiles(spark, name, grid, n=20, res=0.5, x0=276650.0, y0=2110660.0, nodata=None):
    rows = []
    for r in range(0, grid.shape[0], n):
        for c in range(0, grid.shape[1], n):
            rows.append((name, r // n, c // n, x0 + c * res, y0 - r * res, res, res, n, n, nodata,
                         [float(v) for v in grid[r:r + n, c:c + n].ravel()]))
    return spark.createDataFrame(rows, TILE)


def surfaces():
    dem = np.full((120, 120), 912.4, dtype=np.float32)
    dsm = dem.copy()
    dsm[20:60, 20:60] = 925.0
    dsm[70:100, 70:100] = 937.0
    return dem, dsm


def test_two_buildings_are_found_with_their_own_roofs(spark):
    dem, dsm = surfaces()
    found = detecting.elevation_detector(tiles(spark, "DEM", dem), tiles(spark, "DSM", dsm))
    got = sorted((r.floor_count, r.roof_level_m, round(r.area, 3)) for r in found.collect())
    assert got == [(4, 925.0, 400.0), (8, 937.0, 225.0)]


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(4)
    high = rng.random((60, 60)) < 0.55
    grid = np.where(high, 5.0, 0.0).astype(np.float32)
    h = tiles(spark, "H", grid, n=20, res=1.0)
    runs = footprints.labelled_runs(h)
    comp = footprints.merge_labels(runs, 20, 20)
    whole = (runs.join(comp, ["raster_id", "label"], "left")
             .withColumn("component", F.coalesce("component", "label")))
    sizes = sorted(r.n for r in whole.groupBy("component").agg(
        F.sum(F.col("c1") - F.col("c0")).alias("n")).collect())
    seen, want = np.zeros_like(high), []
    for start in zip(*np.nonzero(high)):
        if seen[start]:
            continue
        stack, n = [start], 0
        seen[start] = True
        while stack:
            r, c = stack.pop()
            n += 1
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < 60 and 0 <= p[1] < 60 and high[p] and not seen[p]:
                    seen[p] = True
                    stack.append(p)
        want.append(n)
    assert sizes == sorted(want)


def pieces_of(high):
    """Cells of each 4-connected piece, by plain flood fill."""
    seen, out = np.zeros_like(high), []
    for start in zip(*np.nonzero(high)):
        if seen[start]:
            continue
        stack, mine = [start], []
        seen[start] = True
        while stack:
            r, c = stack.pop()
            mine.append((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < high.shape[0] and 0 <= p[1] < high.shape[1] and high[p] and not seen[p]:
                    seen[p] = True
                    stack.append(p)
        out.append(mine)
    return out


def area(ring):
    x, y = np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring])
    return abs(np.sum((x[:-1] - x[0]) * (y[1:] - y[0]) - (x[1:] - x[0]) * (y[:-1] - y[0]))) / 2


def frames(n=60):
    """A frame over all tiles with one inside it, a spiral's worth of corners, and a diagonal touch."""
    high = np.zeros((n, n), bool)
    high[2:58, 2:58] = True
    high[6:54, 6:54] = False
    high[10:50, 10:50] = True
    high[12:48, 12:48] = False
    high[20, 20] = high[21, 21] = high[40, 40] = True
    high[39, 39] = high[39, 40] = True
    return high


@pytest.mark.parametrize("name", ["random", "frames"])
def test_outlines_over_many_tiles_hold_the_cells_of_each_piece(spark, name):
    high = np.random.default_rng(7).random((60, 60)) < 0.58 if name == "random" else frames()
    h = tiles(spark, "H", np.where(high, 5.0, 0.0).astype(np.float32), n=20, res=5.0)
    got = footprints.outlines(h, 20, 20).collect()
    outer = [r.parts[0] for r in got]
    sizes = sorted(area(p[0]) - sum(map(area, p[1:])) for p in outer)
    pieces = pieces_of(high)
    assert sizes == sorted(25.0 * len(p) for p in pieces)
    # each outline spans its piece's rows and columns
    boxes = sorted((max(c["x"] for c in p[0]) - min(c["x"] for c in p[0]),
                    max(c["y"] for c in p[0]) - min(c["y"] for c in p[0])) for p in outer)
    assert boxes == sorted((5.0 * (max(c for _, c in p) - min(c for _, c in p) + 1),
                            5.0 * (max(r for r, _ in p) - min(r for r, _ in p) + 1)) for p in pieces)
    if name == "frames":
        assert max(len(p) for p in outer) == 2 and len(outer) == 5
    runs = footprints.labelled_runs(h)
    assert runs.count() == sum(np.count_nonzero(np.diff(high[r, c:c + 20].astype(int), prepend=0) == 1)
                               for r in range(60) for c in (0, 20, 40))


def test_a_long_ring_is_linked_from_chains_of_many_tiles(spark):
    high = frames()
    h = tiles(spark, "H", np.where(high, 5.0, 0.0).astype(np.float32), n=10, res=5.0)
    runs = footprints.labelled_runs(h)
    one = (runs.join(footprints.merge_labels(runs, 10, 10), ["raster_id", "label"], "left")
           .withColumn("component", F.coalesce("component", "label")).drop("label")
           .withColumn("tile_row", F.floor(F.col("row") / 10).cast("int"))
           .withColumn("tile_col", F.floor(F.col("c0") / 10).cast("int")))
    steps = footprints.boundary_steps(one)
    chains = steps.groupBy("raster_id", "tile_row", "tile_col").applyInPandas(
        footprints._chains, footprints._CHAIN).filter("x0 <> x1 or y0 <> y1")
    placed = footprints.ring_places(chains).groupBy("component", "ring").agg(
        F.count("*").alias("n"), F.countDistinct("left").alias("places")).collect()
    assert max(r.n for r in placed) >= 20 and all(r.n == r.places for r in placed)


def test_zonal_statistics_and_coverage(spark):
    dem, _ = surfaces()
    rng = np.random.default_rng(1)
    dem = (dem + rng.normal(0, .3, dem.shape)).astype(np.float32)
    t = tiles(spark, "DEM", dem)
    box = (276655.0, 2110620.0, 276672.0, 2110650.0)
    feet = spark.createDataFrame([("in", *box), ("edge", 276640.0, 2110640.0, 276660.0, 2110650.0),
                                  ("away", 0.0, 0.0, 5.0, 5.0)],
                                 "unit_id string, a double, b double, c double, d double")
    feet = shapes.with_shape(feet.select("unit_id", F.lit("DEM").alias("raster_id"),
                                         shapes.rectangle(*[F.col(k) for k in "abcd"])
                                         .alias("parts")))
    got = {r.unit_id: r for r in raster.zonal(feet, t, "unit_id").collect()}
    xs = 276650 + (np.arange(120) + .5) * .5
    ys = 2110660 - (np.arange(120) + .5) * .5
    inside = dem[np.ix_((ys >= box[1]) & (ys <= box[3]), (xs >= box[0]) & (xs <= box[2]))]
    assert got["in"].level == pytest.approx(float(np.median(inside.astype(float))), abs=1e-9)
    assert got["in"].coverage == 1.0
    assert got["edge"].coverage == pytest.approx(.5)
    assert got["away"].level is None and got["away"].coverage == 0


@pytest.mark.parametrize("dsm,floors,conf0", [(19.0, 3, False), (11.0, None, True)])
def test_storey_estimate(spark, dsm, floors, conf0):
    df = spark.createDataFrame([("a", 10.0, dsm)] * 50 + [("a", float("nan"), 5.0)] * 3
                               + [("a", 10.0, dsm + 130)], "k string, dem double, dsm double")
    r = raster.building_statistics(df, "k").first()
    assert r.floor_count == floors and (r.confidence == 0) == conf0


def test_statistics_equal_numpy_and_read_the_cells_once(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(rng.normal(50, 2)), float(np.round(rng.normal(60 + 9 * k, 3), 1))) for k in range(4)
            for _ in range(400 if k else 1)]
    df = spark.createDataFrame(rows, "k int, dem double, dsm double")
    stats = raster.building_statistics(df, "k")
    for r in stats.collect():
        g, s = np.array([x[1:] for x in rows if x[0] == r.k]).T
        ground, roof = np.quantile(g, .5), np.quantile(s, .9)
        assert (r.ground_level_m, r.roof_level_m) == (pytest.approx(ground, abs=.0051), pytest.approx(roof, abs=.0051))
        h = roof - ground
        want = max(.4, min(.9, 1 - (s - g).std() / h * .5)) if h >= 2.5 else 0
        assert r.confidence == pytest.approx(want, abs=.0051)
    assert "explode" not in stats._jdf.queryExecution().toString()        # cells are read once, by the count


def test_medians_of_triangles_and_of_shapes_with_holes(spark):
    dem, _ = surfaces()
    dem = (dem + np.random.default_rng(2).normal(0, .3, dem.shape)).astype(np.float32)
    x, y = 276650.0, 2110600.0
    outer = [(x + 3, y + 3), (x + 40, y + 3), (x + 40, y + 40), (x + 3, y + 40), (x + 3, y + 3)]
    hole = [(x + 10, y + 10), (x + 10, y + 30), (x + 30, y + 30), (x + 30, y + 10), (x + 10, y + 10)]
    triangle = [(x + 5, y + 5), (x + 45, y + 5), (x + 5, y + 45), (x + 5, y + 5)]

    def parts(*rings):
        return F.array(F.array(*[F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
                                           for a, b in ring]) for ring in rings]))

    feet = spark.createDataFrame([("holed",), ("triangle",)], "unit_id string").select(
        "unit_id", F.lit("DEM").alias("raster_id"),
        F.when(F.col("unit_id") == "holed", parts(outer, hole)).otherwise(parts(triangle)).alias("parts"))
    got = {r.unit_id: r for r in raster.zonal(shapes.with_shape(feet), tiles(spark, "DEM", dem), "unit_id").collect()}
    gx, gy = np.meshgrid(276650 + (np.arange(120) + .5) * .5 - x, 2110660 - (np.arange(120) + .5) * .5 - y)

    def box(a, b):
        return (gx > a) & (gx < b) & (gy > a) & (gy < b)

    masks = {"holed": box(3, 40) & ~box(10, 30), "triangle": (gx > 5) & (gy > 5) & (gx + gy < 50)}
    for name, mask in masks.items():
        edge = (np.isclose(gx + gy, 50)).sum() if name == "triangle" else 0
        assert abs(got[name].cells - mask.sum()) <= edge
        assert got[name].level == pytest.approx(float(np.median(dem[mask].astype(float))), abs=.02 if edge else 1e-9)
