"""Loading vector layers into the register and describing where they reach."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.planar import hull
from .register import Register


def _hulls(batches):
    kept = np.empty((0, 2))
    for pdf in batches:
        kept = hull(np.vstack([kept, pdf[["x", "y"]].to_numpy()]))
    yield pd.DataFrame(kept, columns=["x", "y"])


def convex_hull(layer: DataFrame) -> DataFrame:
    """One row `coverage_wkt`: hull of all vertices.

    Each partition keeps only its own hull corners; those few are sent to one final task.
    """
    points = F.coalesce(shapes.vertices(F.col("parts")), F.col("path"))
    p = layer.select(F.explode(points).alias("p")).select("p.x", "p.y").filter(
        ~(F.isnan("x") | F.isnan("y")))
    local = p.mapInPandas(_hulls, "x double, y double")
    final = local.repartition(1).mapInPandas(_hulls, "x double, y double")
    ring = final.select(F.monotonically_increasing_id().alias("i"), "x", "y").agg(
        F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    closed = F.concat("r", F.slice("r", 1, 1))
    return ring.select(F.when(F.size("r") == 0, "POLYGON EMPTY").otherwise(F.concat(
        F.lit("POLYGON (("), F.array_join(F.transform(closed, lambda v: F.concat_ws(
            " ", v["x"].cast("string"), v["y"].cast("string"))), ", "), F.lit("))")))
        .alias("coverage_wkt"))


def write_layer(register: Register, layer: str, df: DataFrame, source: DataFrame,
                batch_id: str) -> bool:
    """Append a harmonised layer and register its source; an empty layer is skipped."""
    if df.isEmpty():
        return False
    register.append(layer, df, batch_id)
    row = source.withColumn("coverage_wkt", convex_hull(df).scalar()).withColumn(
        "processing_status", F.lit("processed"))
    register.upsert("source", row, ["project_id", "source_id"], batch_id)
    return True
