"""Area of a subdivided parent that its children leave open.

Children are widened by the parent's tolerance, so seams narrower than the measurement
error count as closed. A rectangle cut across by rectangles that span it in one direction is open
between their intervals, which column expressions decide. Other parents reach Python: one with many
children is cut into tiles so that no task sees more than a tile's worth, and copies of one child
outline are reduced to one first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import polygons, shapes
from ..functions import scalars as S
from ..functions.planar import Overlay, parts_of, rings_of, strips
from ..schemas import PARTS, PARTS_TYPE
from ..session import stored

CHILDREN_PER_TILE = 32
#: Children up to which a parent's intervals are decided in one row.
INTERVALS = 64
_GAPS = "array<struct<lo:double,hi:double>>"


@F.pandas_udf(T.StructType([T.StructField("area", T.DoubleType()),
                            T.StructField("parts", PARTS_TYPE)]))
def _open_area(parent: pd.Series, box: pd.Series, kids: pd.Series, tol: pd.Series) -> pd.DataFrame:
    """Parent within the tile that no widened child covers: area and parts."""
    area, parts = [], []
    for shape, tile, outlines, t in zip(parent, box, kids, tol):
        x0, y0, x1, y1 = tile
        ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
        taken, at = [], 0
        while at < len(outlines):
            n = int(outlines[at])
            rings = rings_of(outlines[at + 1:at + 1 + n])
            at += 1 + n
            band = strips(rings, t, reflex=False) if t > 0 else []
            taken += band if len(band) == 1 else [rings] + band
        over = Overlay([rings_of(shape), [ring]], taken)
        area.append(over.area())
        parts.append(parts_of(over.rings()))
    return pd.DataFrame({"area": area, "parts": parts})


def _between(kids: Column, lo: Column, hi: Column) -> Column:
    """What of [lo, hi] no interval of `kids`, widened by tol_h, covers."""
    wide = F.array_sort(F.transform(kids, lambda k: F.struct(
        (k["lo"] - F.col("tol_h")).alias("lo"), (k["hi"] + F.col("tol_h")).alias("hi"))))
    ends = F.concat(wide, F.array(F.struct(hi.alias("lo"), hi.alias("hi"))))

    def step(acc, k):
        stop = F.least(k["lo"], hi)
        gap = F.array(F.struct(acc["reach"].alias("lo"), stop.alias("hi"))).cast(_GAPS)
        return F.struct(F.greatest(acc["reach"], k["hi"]).alias("reach"), F.concat(
            acc["gaps"], F.when(acc["reach"] < stop, gap).otherwise(
                F.array().cast(_GAPS))).alias("gaps"))

    start = F.struct(lo.alias("reach"), F.array().cast(_GAPS).alias("gaps"))
    return F.aggregate(ends, start, step, lambda acc: acc["gaps"])


def _intervals(kids: DataFrame) -> DataFrame:
    """`uncovered` for parents whose children, rectangles like them, all span them one way."""
    across = F.array_distinct(F.transform("kids", lambda k: F.struct(k["kx0"].alias("lo"),
                                                                    k["kx1"].alias("hi"))))
    along = F.array_distinct(F.transform("kids", lambda k: F.struct(k["ky0"].alias("lo"),
                                                                   k["ky1"].alias("hi"))))
    box = [F.col(c) for c in shapes.BOX]
    x0, y0, x1, y1 = box
    group = kids.groupBy("project_id", "unit_id").agg(
        *[F.first(c).alias(c) for c in ("tol_h", *shapes.BOX, "tall")],
        F.collect_list(F.struct("kid_id", *[f"k{c}" for c in shapes.BOX])).alias("kids"))
    gaps = group.withColumn("gaps", F.when(F.col("tall"), _between(across, x0, x1)).otherwise(
        _between(along, y0, y1)))
    side = F.when(F.col("tall"), y1 - y0).otherwise(x1 - x0)
    missing = F.aggregate("gaps", F.lit(0.0), lambda acc, g: acc + (g["hi"] - g["lo"])) * side
    region = F.flatten(F.transform("gaps", lambda g: F.when(
        F.col("tall"), shapes.rectangle(g["lo"], y0, g["hi"], y1)).otherwise(
        shapes.rectangle(x0, g["lo"], x1, g["hi"]))))
    return (gaps.withColumn("missing", missing)
            .filter(F.col("missing") > S.negligible_area(F.col("tol_h")))
            .select("project_id", "unit_id", "missing", region.cast(PARTS).alias("open_parts"),
                    "tol_h", F.sort_array("kids.kid_id").alias("children")))


def uncovered(units: DataFrame, contains: DataFrame) -> DataFrame:
    """Parents left open beyond tolerance: project_id, unit_id, children, missing, tol_h
    and the region itself, open_parts."""
    key = ["project_id", "unit_id"]
    parents = shapes.slim(units.filter("attributes.subdivided"), *key, S.pair_tolerance(
        F.col("acc_h"), F.col("acc_h"), F.col("tolerance_k")).alias("tol_h"))
    edge = contains.select("project_id", F.col("from_unit_id").alias("unit_id"),
                           F.col("to_unit_id").alias("kid_id")).join(parents.select(
        *key, "tol_h", *shapes.BOX, F.col("is_rect").alias("flat")), key)
    kid = shapes.slim(units, "project_id", F.col("unit_id").alias("kid_id")).select(
        "project_id", "kid_id", *[F.col(c).alias(f"k{c}") for c in (*shapes.BOX, "is_rect")],
        F.col("parts").alias("kid"))
    tall = (F.col("ky0") <= F.col("y0")) & (F.col("ky1") >= F.col("y1"))
    wide = (F.col("kx0") <= F.col("x0")) & (F.col("kx1") >= F.col("x1"))
    found = stored(edge.join(kid, ["project_id", "kid_id"]).withColumn("_tall", tall)
                   .withColumn("_wide", wide))
    # rows of the plain parents and of the others, told apart once per parent
    form = found.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min("_tall").alias("tall"), F.min("_wide").alias("_across"),
        F.min(F.col("flat") & F.col("kis_rect")).alias("_flat"))
    plain = F.coalesce(F.col("_flat") & (F.col("tall") | F.col("_across"))
                       & (F.col("_n") <= INTERVALS), F.lit(False))
    form = form.select(*key, F.coalesce("tall", F.lit(False)).alias("tall"), plain.alias("plain"))
    found = found.join(form, key)
    rest = found.filter("NOT plain")
    return _intervals(found.filter("plain")).unionByName(_swept(
        parents.join(form.filter("NOT plain").select(*key), key, "left_semi"), rest))


def _swept(parents: DataFrame, found: DataFrame) -> DataFrame:
    """`uncovered` for any shapes, measured tile by tile in Python."""
    units = parents
    parents = parents.select("project_id", "unit_id", "tol_h", *shapes.BOX, F.coalesce(
        "parts", shapes.rectangle(*[F.col(c) for c in shapes.BOX])).alias("parts"))
    edge = found.select("project_id", "unit_id", "kid_id")
    kids = found.select("project_id", "unit_id", "kid_id", *[f"k{c}" for c in shapes.BOX], F.coalesce(
        "kid", shapes.rectangle(*[F.col(f"k{c}") for c in shapes.BOX])).alias("kid"))
    counted = kids.groupBy("project_id", "unit_id").agg(F.count("*").alias("n"))
    side = F.ceil(F.sqrt(F.col("n") / CHILDREN_PER_TILE)).cast("int")
    tiled = parents.join(counted.select("project_id", "unit_id", side.alias("side")),
                         ["project_id", "unit_id"])
    # copies of one outline cover no more than one does
    outlines = (kids.groupBy("project_id", "unit_id", "kid")
                .agg(*[F.first(f"k{c}").alias(f"k{c}") for c in shapes.BOX]))
    tw = (F.col("x1") - F.col("x0")) / F.col("side")
    th = (F.col("y1") - F.col("y0")) / F.col("side")
    last = F.col("side") - 1

    def span(lo, hi, base, step):
        def clip(v):
            return F.least(F.greatest(v, F.lit(0)), last).cast("int")
        return F.sequence(clip(F.floor((lo - F.col("tol_h") - base) / step)),
                          clip(F.floor((hi + F.col("tol_h") - base) / step)))

    def with_tile(df, i, j):
        return (df.withColumn("i", F.explode(i)).withColumn("j", F.explode(j))
                .withColumn("tile", F.col("i") * F.col("side") + F.col("j"))
                .withColumn("tx0", F.col("x0") + tw * F.col("i"))
                .withColumn("tx1", F.col("x0") + tw * (F.col("i") + 1))
                .withColumn("ty0", F.col("y0") + th * F.col("j"))
                .withColumn("ty1", F.col("y0") + th * (F.col("j") + 1))
                .select("project_id", "unit_id", "tile", "tol_h", "parts", "kid",
                        "tx0", "ty0", "tx1", "ty1"))

    every = F.sequence(F.lit(0), last)
    placed = with_tile(outlines.join(tiled, ["project_id", "unit_id"]),
                       span(F.col("kx0"), F.col("kx1"), F.col("x0"), tw),
                       span(F.col("ky0"), F.col("ky1"), F.col("y0"), th))
    empty = with_tile(tiled.withColumn("kid", F.lit(None).cast(PARTS)), every, every)
    # at most a tile's worth of distinct outlines per row; NULL marks the tile itself
    # (a fixed number of partitions: small inputs must not be merged into one Python task)
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.unionByName(empty).repartition(n, "project_id", "unit_id", "tile")
    tiles = spread.groupBy("project_id", "unit_id", "tile").agg(
        *[F.first(c).alias(c) for c in ("tol_h", "parts", "tx0", "ty0", "tx1", "ty1")],
        F.collect_list("kid").alias("kids"))
    flat = F.flatten(F.transform("kids", lambda k: F.concat(
        F.array(F.size(shapes.packed(k)).cast("double")), shapes.packed(k))))
    by_tile = tiles.select("project_id", "unit_id", _open_area(
        shapes.packed(F.col("parts")), F.array("tx0", "ty0", "tx1", "ty1"), flat,
        "tol_h").alias("open"))
    # the region is one value of the finding; tiles are joined along their common lines
    seams = F.flatten(F.collect_list("open.parts"))
    missing = (by_tile.groupBy("project_id", "unit_id").agg(
        F.sum("open.area").alias("missing"), seams.alias("open_parts"), F.count("*").alias("tiles"))
               .join(parents.select("project_id", "unit_id", "tol_h"),
                     ["project_id", "unit_id"])
               .filter(F.col("missing") > S.negligible_area(F.col("tol_h"))))
    # the finding itself names every child, so its list is as long as the result asks for
    named = (missing.select("project_id", "unit_id").join(edge, ["project_id", "unit_id"])
             .groupBy("project_id", "unit_id")
             .agg(F.sort_array(F.collect_list("kid_id")).alias("children")))
    whole = missing.withColumn("open_parts", F.coalesce(polygons.joined(
        F.when(F.col("tiles") > 1, F.col("open_parts"))), "open_parts")).drop("tiles")
    return whole.join(named, ["project_id", "unit_id"])
