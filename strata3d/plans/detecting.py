"""Surfaces to suggestions, and reviewed suggestions to units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import shapes
from ..operators import contracts, footprints, identity, ordered, raster, spatial
from ..operators import units as U
from ..schemas import OUTLINE_CONFIDENCE, RELATIONSHIP, SUGGESTION, UNIT
from ..session import cut_lineage, stored
from ..sources.documents import suggestion_id

#: (dem tiles, dsm tiles) -> raster_id, parts, confidence, floor_count, floor_count_method,
#: ground_level_m, roof_level_m
Detector = Callable[[DataFrame, DataFrame], DataFrame]


def elevation_detector(dem: DataFrame, dsm: DataFrame) -> DataFrame:
    """Outlines of what stands a storey above ground, with statistics per outline.

    Rasters of one tile size are traced together; there are as many passes as tile sizes.
    """
    pairs = raster.paired(dem, dsm)
    found = None
    for shape in dsm.select("ncols", "nrows").distinct().collect():
        same = pairs.filter((F.col("ncols") == shape.ncols) & (F.col("nrows") == shape.nrows))
        part = footprints.outlines(raster.height_above_ground(same), shape.ncols, shape.nrows)
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(shapes.with_shape(found).withColumn(     # labels repeat between rasters
        "component", F.concat_ws("/", "raster_id", F.col("component").cast("string"))))
    cells = raster.cells_in(found, pairs, "component", ("dem_values", "dsm_values"))
    stats = raster.building_statistics(
        cells.withColumnsRenamed({"dem_values": "dem", "dsm_values": "dsm"}), "component")
    return (found.join(stats, "component", "left")
            .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))


def fused(outlines: DataFrame, stats: DataFrame | None) -> DataFrame:
    """Outline confidence joined with statistics of the whole surface; without a surface the
    heights stay unknown."""
    base = outlines.withColumn("_o", F.lit(OUTLINE_CONFIDENCE))
    if stats is None:
        return base.select("*", F.col("_o").alias("confidence"), *[
            F.lit(None).cast(t).alias(c) for c, t in (
                ("ground_level_m", "double"), ("roof_level_m", "double"),
                ("floor_count", "int"), ("floor_count_method", "string"))]).drop("_o")
    return (base.join(stats.withColumnRenamed("confidence", "_c"), "raster_id")
            .withColumn("confidence", S.round_exact((F.col("_o") + F.col("_c")) / 2.0, 2))
            .drop("_o", "_c"))


def as_suggestions(found: DataFrame, project_id: Column, crs: Column, run_id: Column,
                   raster_ids: Column, at: Column) -> DataFrame:
    return (found.withColumn("project_id", project_id).withColumn("crs", crs)
            .withColumn("suggestion_id", suggestion_id(run_id, F.col("parts")))
            .withColumn("kind", F.lit("building_outline"))
            .withColumn("source_raster_ids", raster_ids)
            .withColumn("model", F.struct(F.lit("ndsm-threshold").alias("name"),
                                          F.lit("1").alias("version"), at.alias("run_at")))
            .withColumn("review_state", F.lit("pending")))


@dataclass
class Detected:
    fresh: DataFrame
    report: DataFrame


def sort_out(found: DataFrame, units: DataFrame, suggestions: DataFrame) -> Detected:
    """Drop detections the register or the queue already holds; the register asks first.

    Shapes computed here are written before they are searched, so that each polygon is measured once
    and not for every filter and pass; units that carry their shape are searched where they are.
    """
    f = found if "is_rect" in found.columns else shapes.with_shape(found)
    buildings = units.filter("unit_type = 'building'")
    if "is_rect" not in units.columns:
        buildings = stored(shapes.slim(shapes.with_shape(buildings.select(
            "project_id", "unit_id", "ord", "parts")), "project_id", "unit_id", "ord"))
    queued = stored(shapes.slim(shapes.with_shape(suggestions.select(
        "project_id", F.col("suggestion_id").alias("seen_id"), "ord",
        U.chosen_outline().alias("parts"))), "project_id", "seen_id", "ord"))
    once = stored(shapes.slim(f, "project_id", "suggestion_id"))
    mapped = spatial.same_place(once, buildings, "suggestion_id", "unit_id", "mapped")
    seen = spatial.same_place(once, queued, "suggestion_id", "seen_id", "seen")
    out = (f.join(mapped, ["project_id", "suggestion_id"], "left")
           .join(seen, ["project_id", "suggestion_id"], "left")
           .withColumn("outcome", F.when(F.col("mapped").isNotNull(), "already_mapped")
                       .when(F.col("seen").isNotNull(), "rediscovered").otherwise("fresh")))
    report = out.groupBy("project_id", "outcome").agg(F.count("*").alias("n"))
    return Detected(out.filter("outcome = 'fresh'").drop("mapped", "seen", "outcome"), report)


def receive(batch: DataFrame, stored: DataFrame | None, project_crs: Column,
            at: Column) -> DataFrame:
    """The suggestion table after a batch: all rows pass the contract or none is stored.

    A decided suggestion is never overwritten; a pending one is replaced.
    """
    checked = contracts.broken(batch, contracts.suggestion_clauses(project_crs))
    contracts.refuse_if_broken(checked, "suggestion_id")
    new = U.complete(batch.withColumn("review_state", F.lit("pending"))
                     .withColumn("reviewed_by", F.lit(None))
                     .withColumn("reviewed_at", F.lit(None))
                     .withColumn("edited_parts", F.lit(None)).withColumn("unit_id", F.lit(None))
                     .withColumn("received_at", at), SUGGESTION)
    if stored is None:
        return new
    key = ["project_id", "suggestion_id"]
    decided = stored.filter("review_state <> 'pending'").select(*key)
    new = new.join(decided, key, "left_anti")
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


@dataclass
class Applied:
    units: DataFrame
    relationships: DataFrame
    sequences: DataFrame
    suggestions: DataFrame
    report: DataFrame


class NotReviewed(ValueError):
    """A suggestion nobody accepted was asked to become a unit."""


def apply_reviewed(suggestions: DataFrame, units: DataFrame, registry: DataFrame,
                   settings: DataFrame, held: DataFrame) -> Applied:
    """Accepted and edited suggestions as building units, repeatable.

    A unit a suggestion already became is refreshed, never minted a second time.
    """
    now = F.current_timestamp()
    s = ordered.place_by_text(suggestions.filter("review_state in ('accepted', 'edited')"),
                              ["project_id"], "suggestion_id", "ord").withColumn(
        "parts", U.chosen_outline())
    s = s.withColumn("reused", F.col("unit_id").isNotNull()).withColumn(
        "unit_id", F.coalesce("unit_id", F.uuid()))
    s = cut_lineage(shapes.with_shape(U.with_settings(
        U.sources_of(s, registry), settings)).withColumn("local_id", F.col("suggestion_id"))
        .withColumn("named_parcel", F.lit(None).cast("string")))
    parcels = shapes.with_shape(units.filter("unit_type = 'land_parcel'").select(
        "project_id", F.col("unit_id").alias("parcel_id"),
        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"), "parts"))
    built = cut_lineage(U.suggestion_units(spatial.attach_to_parcel(s, parcels), now))
    # identifiers follow suggestion order
    ids, rows = identity.mint(built.select(
        "project_id", "unit_id", "ord", "unit_type", F.lit(0).alias("floor_index"),
        F.col("parcel_ulpin").alias("parent_ulpin_14")), held,
        settings.select("project_id", "ulpin_version"))
    named = built.drop("ulpin_version").join(
        ids.select("project_id", "unit_id", "ulpin_provisional", "ulpin_version"),
        ["project_id", "unit_id"], "left")
    edges = built.filter("parcel_id is not null").select(
        "project_id", F.col("parcel_id").alias("from_unit_id"),
        F.col("unit_id").alias("to_unit_id"), "ord", now.alias("created_at"))
    made = built.select("project_id", "suggestion_id", F.col("unit_id").alias("_u"))
    back = (suggestions.join(made, ["project_id", "suggestion_id"], "left")
            .withColumn("unit_id", F.coalesce("_u", "unit_id")).drop("_u"))
    report = named.groupBy("project_id").agg(
        F.count("*").alias("units"), F.count_if(~F.col("reused")).alias("created"),
        F.count_if("reused").alias("reused"), F.count("ulpin_provisional").alias("minted"),
        F.count("lower_limit").alias("with_heights"),
        F.count("parcel_unresolved").alias("unresolved"))
    return Applied(U.complete(named, UNIT),
                   U.complete(U.both_directions(edges), RELATIONSHIP), rows,
                   U.complete(back, SUGGESTION), report)


def require_reviewed(suggestions: DataFrame, suggestion_id_: str) -> None:
    row = suggestions.filter(F.col("suggestion_id") == suggestion_id_).select(
        "review_state").first()
    if row is None:
        raise KeyError(suggestion_id_)
    if row[0] not in ("accepted", "edited"):
        raise NotReviewed(f"{suggestion_id_} is {row[0]}")
