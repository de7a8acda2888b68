"""Where a conflict lies: the region that a finding is about.

Only pairs that are findings get here. They are written once and part in three: boxes of rectangles
are compared, other convex shapes clipped by column expressions, and only the rest cross to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons, shapes
from ..session import stored


def pair() -> list[Column]:
    """`_box`, the box two rectangles `a` and `b` of a pair share, or `_a` and `_b` of other pairs."""
    flat = F.col("a.is_rect") & F.col("b.is_rect")
    ends = [*(F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in ("x0", "y0")),
            *(F.least(f"a.{c}", f"b.{c}").alias(c) for c in ("x1", "y1"))]
    return [F.when(flat, F.struct(*ends)).alias("_box"),
            *(F.when(~flat, shapes.full_parts(s)).alias(f"_{s}") for s in "ab")]


def common(hits: DataFrame) -> DataFrame:
    """`hits` with `affected`, the region that the shapes of `pair` share; NULL if they only touch."""
    both = shapes.is_convex(F.col("_a")) & shapes.is_convex(F.col("_b"))
    hits = stored(hits.withColumn("_convex", F.col("_box").isNull() & both))
    box = [F.col(f"_box.{c}") for c in shapes.BOX]
    flat = hits.filter("_box IS NOT NULL").withColumn("affected", F.when(
        (box[0] < box[2]) & (box[1] < box[3]), shapes.rectangle(*box)))
    plain = hits.filter("_convex").withColumn("affected", shapes.convex_common(
        F.col("_a"), F.col("_b")))
    swept = hits.filter("_box IS NULL AND NOT _convex").withColumn(
        "affected", polygons.intersection(F.col("_a"), F.col("_b")))
    out = flat.unionByName(plain).unionByName(swept).drop("_box", "_a", "_b", "_convex")
    return out.withColumn("affected", F.when(F.size("affected") > 0, F.col("affected")))


def outside(hits: DataFrame) -> DataFrame:
    """`hits` with `affected`, what of `_a`, eroded by `_t`, lies outside `_b`; NULL where `_a` is."""
    hits = stored(hits)
    out = hits.filter("_a IS NOT NULL").withColumn("affected", polygons.outside(
        F.col("_a"), F.col("_b"), F.col("_t")))
    none = hits.filter("_a IS NULL").withColumn("affected", F.lit(None).cast(
        out.schema["affected"].dataType))
    return out.unionByName(none).drop("_a", "_b", "_t")
