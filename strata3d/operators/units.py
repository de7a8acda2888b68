"""Building units out of layers, suggestions, surfaces and plans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons, shapes
from ..functions import scalars as S
from ..schemas import ASSUMED_STOREY_M, ATTRIBUTES, MIN_COVERAGE, UNIT, names, struct
from ..session import stored
from . import raster


class LayerMissing(RuntimeError):
    """A layer the job cannot do without is absent."""


class ParapetDeduction(ValueError):
    """A roof deduction is set, but the median roof level already leaves the parapet out."""


def attributes(**known: Column) -> Column:
    """Attribute struct with the given keys set and every other recognised key NULL."""
    fields = re.findall(r"(\w+) ([a-z]+(?:<[a-z,]+>)?)(?:, |$)", ATTRIBUTES)
    return F.struct(*[(known[n].cast(t) if n in known else F.lit(None).cast(t)).alias(n)
                      for n, t in fields])


def with_attributes(**changed: Column) -> Column:
    out = F.col("attributes")
    for name, value in changed.items():
        out = out.withField(name, value)
    return out


def complete(df: DataFrame, ddl: str = UNIT) -> DataFrame:
    """The table layout: missing columns become typed NULLs, order is fixed."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in struct(ddl).fields])


def optional(df: DataFrame, **types: str) -> DataFrame:
    """Add columns a layer may lack as typed NULLs."""
    for name, t in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(t))
    return df


def both_directions(edges: DataFrame) -> DataFrame:
    """`contains` edges (project_id, from, to, ord) plus the matching `inside` edges."""
    rest = [c for c in edges.columns
            if c not in ("from_unit_id", "to_unit_id", "rel_type")]
    down = edges.select("from_unit_id", "to_unit_id", F.lit("contains").alias("rel_type"),
                        *rest)
    up = edges.select(F.col("to_unit_id").alias("from_unit_id"),
                      F.col("from_unit_id").alias("to_unit_id"),
                      F.lit("inside").alias("rel_type"), *rest)
    return down.unionByName(up)


def _new_unit(df: DataFrame, at: Column) -> DataFrame:
    """Columns every imported unit shares; needs project_crs and project_datum."""
    return (df.withColumn("status", F.lit("needs_review"))
            .withColumn("validation_state", F.lit("unvalidated"))
            .withColumn("dispute_state", F.lit("undisputed"))
            .withColumn("representation", F.lit("prism"))
            .withColumn("crs", F.col("project_crs"))
            .withColumn("vertical_datum", F.col("project_datum"))
            .withColumn("recorded_from", at))


def with_settings(df: DataFrame, settings: DataFrame) -> DataFrame:
    s = settings.withColumnRenamed("vertical_datum", "project_datum")
    return df.join(s, "project_id")


def identify(rows: DataFrame, known: DataFrame) -> DataFrame:
    """unit_id a previous import gave to (unit_type, local_id), else a new one.

    New ids are random: write or checkpoint the result before it is used twice.
    """
    old = (known.filter("attributes.local_id is not null")
           .groupBy("project_id", "unit_type", F.col("attributes.local_id").alias("local_id"))
           .agg(F.max_by("unit_id", "ord").alias("_old")))
    return (rows.join(old, ["project_id", "unit_type", "local_id"], "left")
            .withColumn("unit_id", F.coalesce("_old", F.uuid()))
            .withColumn("reused", F.col("_old").isNotNull()).drop("_old"))


def parcel_units(parcels: DataFrame, at: Column) -> DataFrame:
    """Parcels as units: their column is the project stratum until it is grounded."""
    p = optional(parcels, parent_ulpin_14="string")
    ulpin = F.when(F.col("parent_ulpin_14") != "", F.col("parent_ulpin_14"))
    return (_new_unit(p, at)
            .withColumn("lower_limit", F.col("stratum_below_limit_m"))
            .withColumn("upper_limit", F.col("stratum_above_limit_m"))
            .withColumn("source_ids", F.array("source_id"))
            .withColumn("created_by", F.lit("derived"))
            .withColumn("attributes", attributes(local_id=F.col("local_id"),
                                                 parent_ulpin_14=ulpin)))


def building_units(attached: DataFrame, at: Column) -> DataFrame:
    """Attached footprints as units; heights stay unknown until surfaces are read."""
    b = optional(attached, floors_count="int")
    return (_new_unit(b, at)
            .withColumn("source_ids", F.array("source_id"))
            .withColumn("created_by", F.lit("derived"))
            .withColumn("attributes", attributes(
                local_id=F.col("local_id"), parcel_share=F.col("parcel_share"),
                parcel_unresolved=F.col("parcel_unresolved"),
                floor_count=F.col("floors_count"),
                heights_unavailable=F.lit("no elevation surface read yet"))))


def utility_units(lines: DataFrame, at: Column) -> DataFrame:
    """Lines widened to corridors; depths are relative to ground and stay as given."""
    kind = F.when(F.lower("stratum") == "below", "underground_feature").otherwise(
        "elevated_structure")
    u = (lines.withColumn("unit_type", kind)
         .withColumn("parts", polygons.flat_corridor(F.col("path"),
                                                     F.col("corridor_width_m"))))
    return (_new_unit(u, at)
            .withColumn("source_ids", F.array("source_id"))
            .withColumn("created_by", F.lit("derived"))
            .withColumn("attributes", attributes(
                local_id=F.col("local_id"), easement=F.lit(True),
                utility_kind=F.col("utility_kind"), depth_top_m=F.col("depth_top_m"),
                depth_bottom_m=F.col("depth_bottom_m"),
                corridor_width_m=F.col("corridor_width_m"),
                heights_unavailable=F.lit("depths are relative to ground"))))


def derived_heights(buildings: DataFrame, ground: DataFrame, roof: DataFrame) -> DataFrame:
    """Base and top per building from zonal medians; thin coverage leaves both unknown.

    `ground`/`roof`: unit_id, level, coverage. Adds base, top, cover, ground_level, roof_level.
    """
    g = ground.select("unit_id", F.col("level").alias("ground_level"),
                      F.col("coverage").alias("_gc"))
    r = roof.select("unit_id", F.col("level").alias("roof_level"), F.col("coverage").alias("_rc"))
    cover = F.least(F.coalesce("_gc", F.lit(0.0)), F.coalesce("_rc", F.lit(0.0)))
    enough = F.col("cover") >= MIN_COVERAGE
    return (buildings.join(g, "unit_id", "left").join(r, "unit_id", "left")
            .withColumn("cover", cover)
            .withColumn("base", F.when(enough, F.col("ground_level")
                                       + F.col("default_plinth_offset_m")))
            .withColumn("top", F.when(enough, F.col("roof_level"))).drop("_gc", "_rc"))


def rebuild(heights: DataFrame) -> DataFrame:
    """Write derived heights onto the building, keeping identity and other attributes."""
    ok = F.col("base").isNotNull()
    return (heights.withColumn("lower_limit", F.col("base"))
            .withColumn("upper_limit", F.col("top"))
            .withColumn("created_by", F.lit("derived"))
            .withColumn("status", F.lit("needs_review"))
            .withColumn("representation", F.lit("prism"))
            .withColumn("attributes", with_attributes(
                raster_coverage=S.round_exact(F.col("cover"), 3),
                ground_level_m=F.when(ok, S.round_exact(F.col("ground_level"), 3)).otherwise(
                    F.col("attributes.ground_level_m")),
                roof_level_m=F.when(ok, S.round_exact(F.col("roof_level"), 3)).otherwise(
                    F.col("attributes.roof_level_m")),
                plinth_offset_m=F.when(ok, F.col("default_plinth_offset_m")).otherwise(
                    F.col("attributes.plinth_offset_m")),
                heights_unavailable=F.when(~ok, "surface coverage below the minimum"))))


def parcel_reference(units: DataFrame) -> Column:
    """Parcel the unit names, else the one its own identifier begins with."""
    own = S.identifier_parts(F.coalesce("ulpin", "ulpin_provisional"))["parent_ulpin_14"]
    return F.coalesce(F.when(F.col("attributes.parent_ulpin_14") != "",
                             F.col("attributes.parent_ulpin_14")), own)


def ground_parcels(parcels: DataFrame, ground: DataFrame) -> DataFrame:
    """Parcel columns set relative to the median ground; unmeasured parcels are unchanged."""
    g = ground.select("unit_id", F.col("level").alias("_g"))
    hit = F.col("_g").isNotNull()
    return (parcels.join(g, "unit_id", "left")
            .withColumn("lower_limit", F.when(hit, F.col("_g") + F.col("stratum_below_limit_m"))
                        .otherwise(F.col("lower_limit")))
            .withColumn("upper_limit", F.when(hit, F.col("_g") + F.col("stratum_above_limit_m"))
                        .otherwise(F.col("upper_limit")))
            .withColumn("attributes", F.when(hit, with_attributes(
                ground_level_m=S.round_exact(F.col("_g"), 3),
                stratum_is_relative_to_ground=F.lit(True))).otherwise(F.col("attributes")))
            .withColumn("grounded", hit).drop("_g"))


def floor_plan_count(default: int, estimate: bool) -> tuple[Column, Column]:
    """(storeys, whether they are an estimate): declared, else estimated, else default."""
    declared = F.col("attributes.floor_count")
    height = F.col("upper_limit") - F.col("lower_limit")
    use = F.coalesce(declared, F.lit(0)) != 0
    guess = ~use & F.lit(estimate) & F.coalesce(height != 0, F.lit(False))
    count = (F.when(use, declared)
             .when(guess, F.greatest(F.lit(1), F.bround(height / ASSUMED_STOREY_M).cast("int")))
             .otherwise(F.lit(default)))
    return count, guess


def split_floors(buildings: DataFrame, count: Column, basements: Column | int = 0,
                 unit_id: Column | None = None) -> DataFrame:
    """One row per floor, contiguous from one base; basements get negative indexes.

    Buildings without limits or with fewer than one floor yield none; see `not_splittable`.
    """
    b = F.lit(basements) if isinstance(basements, int) else basements
    src = (buildings.withColumn("_n", count).withColumn("_b", b)
           .filter("_n >= 1 and lower_limit is not null and upper_limit is not null")
           .withColumn("_h", (F.col("upper_limit") - F.col("lower_limit"))
                       / (F.col("_n") + F.col("_b")))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") + F.col("_b") - 1))))
    low = F.col("lower_limit") + F.col("_i") * F.col("_h")
    keep = [c for c in ("parts", *shapes.BOX, "is_rect", "area", "crs", "vertical_datum",
                        "source_ids", "confidence_score") if c in src.columns]
    return src.select(
        "project_id", (F.uuid() if unit_id is None else unit_id).alias("unit_id"),
        F.lit("floor").alias("unit_type"), F.col("unit_id").alias("parent_id"), *keep,
        low.alias("lower_limit"), (low + F.col("_h")).alias("upper_limit"),
        F.lit("needs_review").alias("status"), F.lit("derived").alias("created_by"),
        (F.col("_i") - F.col("_b")).cast("int").alias("floor_index"),
        S.round_exact(F.col("_h"), 3).alias("floor_height_m"),
        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"), "ord")


def not_splittable(buildings: DataFrame, count: Column) -> DataFrame:
    return (buildings.withColumn("reason", F
                                 .when(F.coalesce(count, F.lit(0)) < 1, "floor count below one")
                                 .when(F.col("lower_limit").isNull()
                                       | F.col("upper_limit").isNull(), "no height range"))
            .filter("reason is not null").select("project_id", "unit_id", "reason"))


def implausible_floors(floors: DataFrame) -> DataFrame:
    """Storeys outside the project's plausible band; unknown heights are skipped."""
    height = F.col("upper_limit") - F.col("lower_limit")
    return floors.filter(~height.between(F.col("min_floor_height_m"),
                                         F.col("max_floor_height_m")))


def apartments(floors: DataFrame, plans: DataFrame) -> DataFrame:
    """Plan polygons clipped to their floor, with the floor's height range.

    `floors`: unit columns and shape. `plans`: floor_id, plan_id, source_ids, confidence and
    shape. Rectangles are clipped natively. Other shapes, which are written first so that Spark
    knows how few there are, meet apart and go through the sweep after boxes that do not meet are
    gone; no pair of rectangles crosses to Python.
    """
    f = shapes.slim(floors, "project_id", F.col("unit_id").alias("floor_id"), "crs",
                    "vertical_datum", "lower_limit", "upper_limit",
                    F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"),
                    F.col("attributes.floor_index").alias("floor_index"))
    p = shapes.slim(plans, "floor_id", "plan_id", "source_ids", "confidence")
    x0, y0 = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    x1, y1 = F.least("a.x1", "b.x1"), F.least("a.y1", "b.y1")

    def meeting(floors, plans):
        return floors.alias("a").join(plans.alias("b"), F.col("a.floor_id") == F.col(
            "b.floor_id")).filter((x0 < x1) & (y0 < y1))

    plain, odd = F.col("is_rect"), ~F.col("is_rect")
    odd_floors, odd_plans = stored(f.filter(odd)), stored(p.filter(odd))
    flat = meeting(f.filter(plain), p.filter(plain)).withColumn(
        "_made", shapes.rectangle(x0, y0, x1, y1))
    swept = [meeting(*pair).withColumn("_made", polygons.intersection(
        shapes.full_parts("a"), shapes.full_parts("b"))).filter(F.size("_made") > 0)
        for pair in ((odd_floors, p), (f.filter(plain), odd_plans))]
    made = [_apartment(rows) for rows in (flat, *swept)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _apartment(out: DataFrame) -> DataFrame:
    """Clipped plans `_made` of floors `a` and plans `b` as units."""
    return out.select(
        "a.project_id", F.col("b.plan_id").alias("plan_id"),
        F.lit("apartment").alias("unit_type"), F.col("a.floor_id").alias("parent_id"),
        F.col("_made").alias("parts"), "a.crs", "a.vertical_datum", "a.lower_limit", "a.upper_limit",
        "b.source_ids", F.col("b.confidence").alias("confidence_score"),
        "a.parent_ulpin_14", "a.floor_index", F.lit("derived").alias("created_by"),
        F.lit("needs_review").alias("status"))


def mark_subdivided(floors: DataFrame, made: DataFrame) -> DataFrame:
    """`subdivided` true on floors that got apartments, unchanged on the others."""
    hit = made.select(F.col("parent_id").alias("unit_id"), F.lit(True).alias("_hit")).distinct()
    return (floors.join(hit, "unit_id", "left")
            .withColumn("attributes", with_attributes(subdivided=F.coalesce(
                "_hit", F.col("attributes.subdivided")))).drop("_hit"))


def source_list(raster_ids: Column, lookup: Column) -> Column:
    """Source ids behind raster ids, first-seen order; unknown ids pass through."""
    return F.array_distinct(F.transform(raster_ids, lambda r: F.coalesce(
        F.when(F.element_at(lookup, r) != "", F.element_at(lookup, r)), r)))


def sources_of(suggestions: DataFrame, registry: DataFrame) -> DataFrame:
    """Add `source_ids`: distinct raster lists are resolved once, then joined back."""
    lists = suggestions.select("project_id", "source_raster_ids").distinct()
    r = registry.select("project_id", "raster_id", "source_id")
    resolved = (lists.select("project_id", "source_raster_ids",
                             F.posexplode("source_raster_ids").alias("_at", "raster_id"))
                .join(r, ["project_id", "raster_id"], "left")
                .groupBy("project_id", "source_raster_ids")
                .agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce(
                    F.when(F.col("source_id") != "", F.col("source_id")),
                    F.col("raster_id")).alias("s")))).alias("_s"))
                .select("project_id", "source_raster_ids", F.array_distinct(
                    F.col("_s.s")).alias("source_ids")))
    return suggestions.join(resolved, ["project_id", "source_raster_ids"], "left")


def chosen_outline(edited: str = "edited_parts", own: str = "parts") -> Column:
    """The reviewer's outline where the suggestion was edited, else the model's."""
    return F.when(F.col("review_state") == "edited", F.col(edited)).otherwise(F.col(own))


def suggestion_units(attached: DataFrame, at: Column) -> DataFrame:
    """Accepted suggestions as buildings; a height range only where both levels are known."""
    g, r = F.col("ground_level_m"), F.col("roof_level_m")
    both = g.isNotNull() & r.isNotNull()
    crs = F.col("crs")
    out = _new_unit(attached.withColumn("_crs", crs), at)
    return (out.withColumn("crs", F.col("_crs"))
            .withColumn("unit_type", F.lit("building"))
            .withColumn("created_by", F.lit("ai"))
            .withColumn("lower_limit", F.when(both, g + F.col("default_plinth_offset_m")))
            .withColumn("upper_limit", F.when(both, r))
            .withColumn("confidence_score", F.col("confidence"))
            .withColumn("attributes", attributes(
                suggestion_id=F.col("suggestion_id"),
                source_raster_ids=F.col("source_raster_ids"),
                parcel_share=F.col("parcel_share"),
                parcel_unresolved=F.col("parcel_unresolved"),
                parent_ulpin_14=F.col("parcel_ulpin"), floor_count=F.col("floor_count"),
                floor_count_method=F.col("floor_count_method"),
                ground_level_m=F.when(both, g), roof_level_m=F.when(both, r),
                plinth_offset_m=F.when(both, F.col("default_plinth_offset_m")),
                heights_unavailable=F.when(~both, "no ground and roof level suggested")))
            .drop("_crs"))


def first_surfaces(registry: DataFrame, kind: str) -> DataFrame:
    """project_id, raster_id of the first surface of a kind."""
    return (raster.first_by_kind(registry).filter(F.col("kind") == kind)
            .select("project_id", "raster_id"))


def unit_columns() -> list[str]:
    return names(UNIT)
