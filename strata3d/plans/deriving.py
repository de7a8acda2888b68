"""Surfaces to heights, floors and identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import identity, raster
from ..operators import units as U
from ..schemas import RELATIONSHIP, UNIT
from ..session import cut_lineage


@dataclass
class Derived:
    units: DataFrame            # grounded parcels, rebuilt buildings and new floors
    relationships: DataFrame
    sequences: DataFrame
    report: DataFrame


def _zonal(units: DataFrame, first: DataFrame, tiles: DataFrame) -> DataFrame:
    both = ["project_id", "raster_id"]
    key = F.concat_ws("/", *both)                       # raster ids repeat between projects
    placed = units.select("project_id", "unit_id", "parts").join(first, "project_id").withColumn(
        "raster_id", key)
    mine = tiles.join(first, both, "left_semi").withColumn("raster_id", key)
    return raster.zonal(shapes.with_shape(placed), mine, "unit_id")


def derive(units: DataFrame, settings: DataFrame, registry: DataFrame, tiles: DataFrame,
           held: DataFrame, *, default_floor_count: int = 1,
           estimate_floors: bool = False) -> Derived:
    """Ground the parcels, give buildings without limits their heights, and stack floors."""
    deducting = settings.filter("default_parapet_deduction_m <> 0").select(
        "project_id").limit(5).collect()
    if deducting:
        raise U.ParapetDeduction("the median roof level needs no parapet deduction: "
                                 + ", ".join(str(r[0]) for r in deducting))
    now = F.current_timestamp()
    dem, dsm = (U.first_surfaces(registry, k) for k in ("DEM", "DSM"))
    own = [c for c in units.columns]
    parcels = U.with_settings(units.filter("unit_type = 'land_parcel'"), settings)
    grounded = U.ground_parcels(parcels, _zonal(parcels, dem, tiles))
    waiting = U.with_settings(units.filter("unit_type = 'building' and lower_limit is null"),
                              settings)
    heights = U.derived_heights(waiting, _zonal(waiting, dem, tiles), _zonal(waiting, dsm, tiles))
    # outside both surfaces nothing was read, so the building is left exactly as it was
    seen = heights.withColumn("outcome", F.when(
        F.col("ground_level").isNull() | F.col("roof_level").isNull(), "no_raster")
        .when(F.col("base").isNull(), "thin_coverage").otherwise("derived"))
    touched = cut_lineage(U.rebuild(seen.filter("outcome <> 'no_raster'")))
    built = touched.filter("outcome = 'derived'").withColumn(
        "attributes", U.with_attributes(parent_ulpin_14=U.parcel_reference(touched)))
    count, guess = U.floor_plan_count(default_floor_count, estimate_floors)
    built = built.withColumn("storeys", count).withColumn("guess", guess)
    built = built.withColumn("attributes", F.when(F.col("guess"), U.with_attributes(
        floor_count=F.col("storeys"), floor_count_method=F.lit("ndsm_division"),
        assumed_storey_m=F.lit(3.0))).otherwise(F.col("attributes"))).withColumn(
        "confidence_score", F.when(F.col("guess"), 0.4).otherwise(F.col("confidence_score")))
    floors = cut_lineage(U.split_floors(built, F.col("storeys")))
    # numbers are given level by level, where a building has one floor: its order is theirs
    ids, rows = identity.mint(floors, held, settings.select("project_id", "ulpin_version"))
    named = (floors.drop("ulpin_version")
             .join(ids.select("project_id", "unit_id", "ulpin_provisional", "ulpin_version"),
                   ["project_id", "unit_id"], "left")
             .withColumn("recorded_from", now).withColumn("representation", F.lit("prism"))
             .withColumn("validation_state", F.lit("unvalidated"))
             .withColumn("dispute_state", F.lit("undisputed"))
             .withColumn("attributes", U.attributes(
                 parent_ulpin_14=F.col("parent_ulpin_14"), floor_index=F.col("floor_index"),
                 floor_height_m=F.col("floor_height_m"), subdivided=F.lit(False))))
    edges = floors.select("project_id", F.col("parent_id").alias("from_unit_id"),
                          F.col("unit_id").alias("to_unit_id"), "ord", now.alias("created_at"))
    thin = touched.filter("outcome = 'thin_coverage'")
    all_units = U.complete(grounded.filter("grounded").select(*own), UNIT)
    for part in (built, thin, named):
        all_units = all_units.unionByName(U.complete(part, UNIT))
    report = seen.groupBy("project_id", "outcome").agg(F.count("*").alias("n"))
    report = report.unionByName(grounded.filter("grounded").groupBy("project_id").agg(
        F.count("*").alias("n")).withColumn("outcome", F.lit("parcels_grounded")))
    report = report.unionByName(named.groupBy("project_id").agg(
        F.count("*").alias("n")).withColumn("outcome", F.lit("floors_created")))
    report = report.unionByName(named.groupBy("project_id").agg(
        F.count("ulpin_provisional").alias("n")).withColumn("outcome",
                                                            F.lit("floors_identified")))
    return Derived(all_units, U.complete(U.both_directions(edges), RELATIONSHIP), rows, report)
