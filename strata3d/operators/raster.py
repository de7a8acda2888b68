"""Elevation surfaces stored as tiles: cells, zonal statistics, height differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import shapes
from ..schemas import ASSUMED_STOREY_M, MIN_BUILDING_HEIGHT_M
from ..session import stored

#: Values a metre in one bin of the counting quantiles.
BINS = 16


def _finite(v: Column) -> Column:
    return ~(F.isnan(v) | (F.abs(v) == float("inf")))


def _valid(v: Column, nodata: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (nodata.isNull() | (v != nodata))


def cells(tiles: DataFrame) -> DataFrame:
    """raster_id, col, row, x, y (centre), value for every valid cell."""
    at = tiles.select("*", F.posexplode("values").alias("_i", "value"))
    at = at.filter(_valid(F.col("value"), F.col("nodata")))
    c = F.pmod(F.col("_i"), F.col("ncols"))
    r = F.floor(F.col("_i") / F.col("ncols"))
    return at.select("raster_id", "tile_row", "tile_col", c.cast("int").alias("col"),
                     r.cast("int").alias("row"),
                     (F.col("x0") + (c + 0.5) * F.col("res_x")).alias("x"),
                     (F.col("y0") - (r + 0.5) * F.col("res_y")).alias("y"), "value")


def profile(tiles: DataFrame) -> DataFrame:
    """Width, height, extent and resolution per raster."""
    right = F.col("x0") + F.col("ncols") * F.col("res_x")
    bottom = F.col("y0") - F.col("nrows") * F.col("res_y")
    out = tiles.groupBy("raster_id").agg(
        F.min("x0").alias("x_min"), F.min(bottom).alias("y_min"), F.max(right).alias("x_max"),
        F.max("y0").alias("y_max"), F.first("res_x").alias("res_x"),
        F.first("res_y").alias("res_y"), F.lit(1).alias("bands"))
    return (out.withColumn("width", F.round((F.col("x_max") - F.col("x_min"))
                                            / F.col("res_x")).cast("int"))
            .withColumn("height", F.round((F.col("y_max") - F.col("y_min"))
                                          / F.col("res_y")).cast("int")))


def first_by_kind(registry: DataFrame) -> DataFrame:
    """First registered raster per project and kind."""
    return registry.groupBy("project_id", F.upper("kind").alias("kind")).agg(
        F.min_by("raster_id", "ord").alias("raster_id"),
        F.min_by("source_id", "ord").alias("source_id"))


def _grid(tiles: DataFrame) -> DataFrame:
    """One row per raster: where its regular tiling starts and how large a tile is.

    Written: read back, its size is known, and a raster's footprints do not gather to meet it.
    """
    return stored(tiles.groupBy("raster_id").agg(
        F.min(F.col("x0") - F.col("tile_col") * F.col("ncols") * F.col("res_x")).alias("gx"),
        F.max(F.col("y0") + F.col("tile_row") * F.col("nrows") * F.col("res_y")).alias("gy"),
        F.max(F.col("ncols") * F.col("res_x")).alias("tw"),
        F.max(F.col("nrows") * F.col("res_y")).alias("th"),
        F.max("tile_col").alias("max_col"), F.max("tile_row").alias("max_row")))


def cells_in(footprints: DataFrame, tiles: DataFrame, key: str,
             values: tuple[str, ...] = ("values",)) -> DataFrame:
    """Cells whose centre lies in a footprint: footprint columns plus one value per surface.

    `footprints`: raster_id, `key`, shape columns. A footprint joins the few tiles it touches
    by tile number, and only the cells inside its box are unfolded from a tile's array.
    """
    g = _grid(tiles)
    f = shapes.slim(footprints, "raster_id", key).join(g, "raster_id")

    def span(lo, hi, top):
        return F.sequence(F.greatest(F.floor(lo), F.lit(0)).cast("int"),
                          F.least(F.floor(hi), top).cast("int"))

    # `sequence` counts down when ends cross, so footprints off the raster go first
    tx0, tx1 = (F.col("x0") - F.col("gx")) / F.col("tw"), (F.col("x1") - F.col("gx")) / F.col("tw")
    ty0, ty1 = (F.col("gy") - F.col("y1")) / F.col("th"), (F.col("gy") - F.col("y0")) / F.col("th")
    f = f.filter((tx1 >= 0) & (ty1 >= 0) & (F.floor(tx0) <= F.col("max_col"))
                 & (F.floor(ty0) <= F.col("max_row")))
    f = (f.withColumn("tile_col", F.explode(span(tx0, tx1, F.col("max_col"))))
         .withColumn("tile_row", F.explode(span(ty0, ty1, F.col("max_row")))))
    foot = F.struct(*shapes.BOX, "is_rect", F.when(~F.col("is_rect"), shapes.edges(
        F.col("parts"))).alias("edges")).alias("f")
    f = f.select("raster_id", "tile_row", "tile_col", key, foot)
    t = f.join(tiles, ["raster_id", "tile_row", "tile_col"])
    first_c = F.greatest(F.ceil((F.col("f.x0") - F.col("x0")) / F.col("res_x") - 0.5), F.lit(0))
    last_c = F.least(F.floor((F.col("f.x1") - F.col("x0")) / F.col("res_x") - 0.5),
                     F.col("ncols") - 1)
    first_r = F.greatest(F.ceil((F.col("y0") - F.col("f.y1")) / F.col("res_y") - 0.5), F.lit(0))
    last_r = F.least(F.floor((F.col("y0") - F.col("f.y0")) / F.col("res_y") - 0.5),
                     F.col("nrows") - 1)
    t = t.select("*", first_c.cast("int").alias("c0"), last_c.cast("int").alias("c1"),
                 first_r.cast("int").alias("r0"), last_r.cast("int").alias("r1"))
    t = t.filter("c0 <= c1 and r0 <= r1")
    t = t.withColumn("r", F.explode(F.sequence("r0", "r1")))
    run = [F.slice(F.col(v), F.col("r") * F.col("ncols") + F.col("c0") + 1,
                   F.col("c1") - F.col("c0") + 1).alias(v) for v in values]
    t = t.select(key, "raster_id", "f", "nodata", "x0", "y0", "res_x", "res_y", "c0", "r",
                 F.posexplode(F.arrays_zip(*run)).alias("_c", "_v"))
    x = F.col("x0") + (F.col("c0") + F.col("_c") + 0.5) * F.col("res_x")
    y = F.col("y0") - (F.col("r") + 0.5) * F.col("res_y")
    inside = F.col("f.is_rect") | shapes.covers_point(F.col("f.edges"), x, y)
    return t.filter(inside).select(key, "raster_id", "nodata",
                                   *[F.col(f"_v.{v}").alias(v) for v in values])


def value_runs(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value occurs per group, `_v` and `_n`: counted on the way to the shuffle, so
    a footprint costs its distinct values and none is held in one task. Written once, so that the
    tiles are met once however often the runs are read."""
    known = cells.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    return stored(known.groupBy(*keys, "_v").agg(F.count("*").alias("_n")))


def run_quantiles(runs: DataFrame, keys: list[str], q: Column) -> DataFrame:
    """Exact interpolated quantile `q` and number of cells `n` per group of value runs.

    Counts per bin find the bins that hold the two middle ranks; only their values are ranked.
    """
    bin_ = F.floor(F.col("_v") * BINS)
    upto = Window.partitionBy(*keys).orderBy("_bin")
    bins = runs.groupBy(*keys, bin_.alias("_bin")).agg(F.sum("_n").alias("_m"))
    bins = (bins.withColumn("_to", F.sum("_m").over(upto))
            .withColumn("n", F.sum("_m").over(Window.partitionBy(*keys)))
            .withColumn("_rank", (F.col("n") - 1) * q)
            .withColumn("_from", F.col("_to") - F.col("_m")))
    lo, hi = F.floor("_rank"), F.ceil("_rank")
    bins = bins.filter((lo < F.col("_to")) & (hi >= F.col("_from")))
    fine = runs.withColumn("_bin", bin_).join(
        bins.select(*keys, "_bin", "_from", "_rank", "n"), [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    fine = fine.withColumn("_end", F.col("_from") + F.sum("_n").over(inside))

    def at(rank):
        return F.min(F.when(F.col("_end") > rank, F.col("_v")))

    out = fine.groupBy(*keys).agg(at(lo).alias("_a"), at(hi).alias("_b"),
                                  F.first("_rank").alias("_rank"), F.first("n").alias("n"))
    low, high = F.floor("_rank"), F.ceil("_rank")
    value = F.when(low == high, F.col("_a")).otherwise(
        (high - F.col("_rank")) * F.col("_a") + (F.col("_rank") - low) * F.col("_b"))
    return out.select(*keys, value.alias("q"), "n")


def zonal(footprints: DataFrame, tiles: DataFrame, key: str, q: float = 0.5) -> DataFrame:
    """level (exact quantile) and coverage (valid cells over expected cells, at most 1)."""
    res = stored(tiles.groupBy("raster_id").agg(F.first("res_x").alias("rx"), F.first("res_y")
                                                .alias("ry")))
    sized = footprints.join(res, "raster_id").withColumn(
        "expected", F.col("area") / (F.col("rx") * F.col("ry")))
    inside = cells_in(footprints, tiles, key).filter(_valid(F.col("values"), F.col("nodata")))
    stats = run_quantiles(value_runs(inside, [key], "values"), [key], F.lit(q))
    return sized.select(key, "expected").join(stats, key, "left").select(
        key, F.col("q").alias("level"), F.coalesce("n", F.lit(0)).alias("cells"),
        F.when(F.col("expected") > 0, F.least(F.lit(1.0), F.coalesce("n", F.lit(0))
                                              / F.col("expected"))).otherwise(0.0)
        .alias("coverage"))


def paired(dem: DataFrame, dsm: DataFrame) -> DataFrame:
    """Tiles of two surfaces on one grid, side by side: dem_values, dsm_values.

    With a `pair` column, surfaces of many pairs at once.
    """
    key = [*(["pair"] if "pair" in dem.columns else []), "tile_row", "tile_col"]
    low = dem.select(*key, F.col("values").alias("dem_values"))
    return dsm.withColumnRenamed("values", "dsm_values").join(low, key)


def height_above_ground(pairs: DataFrame) -> DataFrame:
    """`values`: DSM minus DEM in single precision, never below zero."""
    diff = F.zip_with("dsm_values", "dem_values", lambda s, d: F.greatest(
        (s.cast("float") - d.cast("float")).cast("float"), F.lit(0.0).cast("float")))
    return pairs.withColumn("values", diff)


def building_statistics(cell_pairs: DataFrame, key: str) -> DataFrame:
    """Ground, roof (p90), height, storeys and confidence per group of (dem, dsm) cells.

    Below one storey, no storey count and no confidence; cells unknown in either surface
    are left out in pairs. Ground, roof and difference are counted in one pass.
    """
    good = cell_pairs.filter(_finite(F.col("dem")) & _finite(F.col("dsm"))).select(
        key, F.col("dem").cast("double").alias("g"), F.col("dsm").cast("double").alias("s"))
    each = good.select(key, F.explode(F.map_from_arrays(
        F.array(*map(F.lit, ("ground", "roof", "spread"))),
        F.array("g", "s", F.col("s") - F.col("g")))).alias("_of", "v"))
    runs = value_runs(each, [key, "_of"], "v")
    level = run_quantiles(runs.filter("_of <> 'spread'"), [key, "_of"],
                          F.when(F.col("_of") == "roof", 0.9).otherwise(0.5))
    n, v = F.col("_n"), F.col("_v")
    part = runs.filter("_of = 'spread'").groupBy(key).agg(
        F.sum(n).alias("_c"), F.sum(n * v).alias("_t"), F.sum(n * v * v).alias("_tt"))
    mean = F.col("_t") / F.col("_c")
    spread = part.select(key, F.sqrt(F.greatest(F.col("_tt") / F.col("_c") - mean * mean,
                                                F.lit(0.0))).alias("spread"))
    stats = level.groupBy(key).agg(
        *[F.max(F.when(F.col("_of") == k, F.col("q"))).alias(k) for k in ("ground", "roof")]
    ).join(spread, key)
    h = F.greatest(F.col("roof") - F.col("ground"), F.lit(0.0))
    tall = h >= MIN_BUILDING_HEIGHT_M
    conf = F.greatest(F.lit(0.4), F.least(F.lit(0.9), F.lit(1.0) - F.col("spread") / h * 0.5))
    return stats.select(
        key, S.round_exact(F.col("ground"), 2).alias("ground_level_m"),
        S.round_exact(F.col("roof"), 2).alias("roof_level_m"),
        S.round_exact(h, 2).alias("height_m"),
        F.when(tall, F.greatest(F.bround(h / ASSUMED_STOREY_M).cast("int"), F.lit(1)))
        .alias("floor_count"), F.when(tall, "ndsm_division").alias("floor_count_method"),
        F.when(tall, S.round_exact(conf, 2)).otherwise(0.0).alias("confidence"))
