"""The fourteen validation rules: enriched units in, findings out.

Each rule is a function (Context) -> DataFrame with the core finding columns. `Context` only
names DataFrames; nothing runs until a caller writes or counts the union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons, shapes
from ..functions import scalars as S
from ..schemas import EASEMENT_TYPES, PARTS
from ..session import stored
from . import affected, context, gaps, ordered, spatial

CORE = ("project_id", "rule_id", "severity", "unit_id", "related_unit_ids", "message",
        "suggested_action", "affected_geometry", "measured_value", "tolerance")


@dataclass(frozen=True)
class Context:
    units: DataFrame            # context.enriched output
    contains: DataFrame         # `contains` edges
    parents: DataFrame | None = None        # unit_id, parent_id; None if `units` has parent_id
    plain: DataFrame | None = None          # `units` that did not meet accuracy
    lists: DataFrame | None = None          # accuracy per source list
    nested: str | None = None               # column of `units` with the `contains` edge's parent

    @classmethod
    def of(cls, units, relationships, sources, settings, nested: str | None = None) -> Context:
        """`units` is a stored table, of which each rule scans only its own columns and rows.
        Shapes it lacks are computed for all rules and written once. `nested` names the column of
        units that hold their only `contains` edge themselves; its ord is then the unit's."""
        lists = stored(context.accuracy(units, sources))
        plain = context.with_project(units, settings)
        rich = context.with_accuracy(plain, lists)
        if "is_rect" not in units.columns:
            rich = plain = stored(rich)
        return cls(rich, context.contains_edges(relationships), context.parents(relationships),
                   plain, lists, nested)

    def bare(self) -> DataFrame:
        """Units for rules that ask no accuracy, so that source lists, however many, are not met."""
        return self.units if self.plain is None else self.plain

    def accuracies(self) -> DataFrame:
        if self.lists is not None:
            return self.lists
        return self.units.select("project_id", "source_ids", "acc_v").distinct()

    def stacks(self) -> DataFrame:
        """Floors with `parent` and `edge_ord`, one row per `contains` edge."""
        floors = self.bare().filter("unit_type = 'floor' and floor_index is not null")
        own = ["project_id", "unit_id", "floor_index", "lower_limit", "upper_limit", "source_ids",
               "tolerance_k"]
        if self.nested is not None:
            return floors.filter(F.col(self.nested).isNotNull()).select(
                *own, F.col(self.nested).alias("parent"), F.col("ord").alias("edge_ord"))
        edges = self.contains.select("project_id", F.col("from_unit_id").alias("parent"),
                                     F.col("to_unit_id").alias("unit_id"),
                                     F.col("ord").alias("edge_ord"))
        return floors.select(*own).join(edges, ["project_id", "unit_id"])

    def family(self) -> DataFrame:
        """What pairs are made of, with parent_id: only these columns move to meet the parents."""
        if self.parents is None:
            return self.units
        own = [c for c in spatial.PAIR if c != "parent_id"]
        if self.nested is not None:
            return shapes.slim(self.units, *own, F.col(self.nested).alias("parent_id"))
        return shapes.slim(self.units, *own).join(self.parents, ["project_id", "unit_id"], "left")


Rule = Callable[[Context], DataFrame]


def _finding(df: DataFrame, rule: str, severity: str, *, message: Column, action: str,
             unit: str = "unit_id", related: Column | None = None,
             measured: Column | None = None, tolerance: Column | None = None,
             geometry: Column | None = None, project: str = "project_id") -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        F.col(project).alias("project_id"), F.lit(rule).alias("rule_id"),
        F.lit(severity).alias("severity"), F.col(unit).alias("unit_id"),
        (F.array().cast("array<string>") if related is None else related)
        .alias("related_unit_ids"),
        message.alias("message"), F.lit(action).alias("suggested_action"),
        (F.lit(None).cast(PARTS) if geometry is None else geometry).alias("affected_geometry"),
        (none if measured is None else measured).alias("measured_value"),
        (none if tolerance is None else tolerance).alias("tolerance"))


def geometry_invalid(ctx: Context) -> DataFrame:
    # a rectangle with positive area is valid, so only other shapes reach the sweep
    odd = (ctx.bare().filter(~F.col("is_rect"))
           .select("project_id", "unit_id", "parts", polygons.is_valid(F.col("parts")).alias("ok")))
    return _finding(odd.filter(~F.col("ok")), "GEOM_INVALID", "error",
                    message=F.lit("Footprint crosses itself, has a spike, or is not closed."),
                    geometry=F.col("parts"), action="Repair the footprint.")


def heights_impossible(ctx: Context) -> DataFrame:
    return _finding(ctx.bare().filter("lower_limit >= upper_limit"), "Z_IMPOSSIBLE", "error",
                    message=F.format_string("Lower limit %s is not below upper limit %s.",
                                            "lower_limit", "upper_limit"),
                    measured=F.col("upper_limit") - F.col("lower_limit"),
                    action="Correct the limits so that the unit has a positive height.")


def heights_unavailable(ctx: Context) -> DataFrame:
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c))
                                  for c in ("lower_limit", "upper_limit")])
    why = F.coalesce(F.concat(F.lit(" Reason: "), F.col("attributes.heights_unavailable")),
                     F.lit(""))
    return _finding(ctx.bare().filter("lower_limit is null or upper_limit is null"),
                    "HEIGHTS_UNAVAILABLE", "error",
                    message=F.concat(F.lit("Not known: "), missing, F.lit("."), why),
                    geometry=F.col("parts"),
                    action="Derive the heights from elevation data or enter them.")


def duplicates(ctx: Context) -> DataFrame:
    """Same outline and same limits (unknown equals unknown); the first by `ord` is kept."""
    outline = F.when(F.col("is_rect"), F.concat_ws(" ", *shapes.BOX)).otherwise(
        F.sha2(shapes.canonical_text(F.col("parts")), 256))
    keyed = ctx.bare().select("project_id", outline.alias("_k"), "lower_limit",
                             "upper_limit", "unit_id", "ord", "parts")
    keys = ["project_id", "_k", "lower_limit", "upper_limit"]
    groups = (keyed.groupBy(*keys)
              .agg(F.min(F.struct("ord", "unit_id")).alias("_first"),
                   F.count("*").alias("_n")).filter("_n > 1"))
    u, g = keyed.alias("u"), groups.alias("g")
    on = [F.col(f"u.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    later = (u.join(g, on).filter(F.col("u.ord") > F.col("g._first.ord"))
             .select("u.project_id", "u.unit_id", "u.parts",
                     F.col("g._first.unit_id").alias("first_id")))
    return _finding(later, "GEOM_DUPLICATE", "error", related=F.array("first_id"),
                    message=F.concat(F.lit("Same outline and limits as "), F.col("first_id")),
                    geometry=F.col("parts"), action="Merge the two or correct the limits.")


def crs_mismatch(ctx: Context) -> DataFrame:
    return _finding(ctx.bare().filter("crs <> project_crs"), "CRS_MISMATCH", "error",
                    message=F.format_string("Unit is in %s, project in %s.", "crs",
                                            "project_crs"),
                    action="Reproject the source when it is loaded.")


def datum_mismatch(ctx: Context) -> DataFrame:
    return _finding(ctx.bare().filter("vertical_datum <> project_datum"),
                    "DATUM_MISMATCH", "error",
                    message=F.format_string("Heights refer to %s, project to %s.",
                                            "vertical_datum", "project_datum"),
                    action="Convert the heights when the source is loaded.")


def provenance_missing(ctx: Context) -> DataFrame:
    text = F.when(F.size("source_ids") == 0, "No source is named.").otherwise(
        F.concat(F.lit("Accuracy not stated for all of: "), F.array_join("source_ids", ", ")))
    return _finding(ctx.units.filter(~F.col("acc_known")), "PROVENANCE_MISSING", "info",
                    message=text, action="Name the sources and record their accuracy.")


def confidence_low(ctx: Context) -> DataFrame:
    low = ctx.bare().filter("created_by = 'ai' and confidence_score < confidence_warn_below")
    return _finding(low, "CONFIDENCE_LOW", "warning",
                    message=F.format_string("Model confidence %.2f is under %s.",
                                            "confidence_score", "confidence_warn_below"),
                    measured=F.col("confidence_score"),
                    tolerance=F.col("confidence_warn_below"),
                    action="Look at the evidence before approving.")


def floor_sequence(ctx: Context) -> DataFrame:
    """Consecutive floors of one parent must meet within the pair's vertical tolerance.

    Floors that meet exactly are within any tolerance, so only the other pairs meet accuracy.
    """
    pairs = ordered.neighbours(ctx.stacks(), ["project_id", "parent"], "floor_index", "edge_ord",
                               ["unit_id", "lower_limit", "upper_limit", "source_ids",
                                "tolerance_k"])
    apart = (pairs.withColumn("delta", F.col("cur.lower_limit") - F.col("prev.upper_limit"))
             .filter((F.col("delta") != 0) | (F.col("cur.tolerance_k") < 0))
             .select("project_id", F.col("cur.unit_id").alias("unit_id"),
                     F.col("prev.unit_id").alias("below"), "delta",
                     F.col("cur.tolerance_k").alias("k"), F.col("prev.source_ids").alias("_prev"),
                     F.col("cur.source_ids").alias("_cur")))
    for side in ("_prev", "_cur"):
        apart = context.with_accuracy(apart, ctx.accuracies(), side, **{f"{side}_v": "acc_v"})
    pairs = (apart.withColumn("tol", S.pair_tolerance(F.col("_prev_v"), F.col("_cur_v"),
                                                      F.col("k")))
             .filter(F.abs("delta") > F.col("tol"))
             .select("project_id", "unit_id", "below", "delta", "tol"))
    word = F.when(F.col("delta") > 0, "gap").otherwise("overlap")
    return _finding(pairs, "FLOOR_SEQUENCE", "error", related=F.array("below"),
                    message=F.format_string("%.2f m %s above %s.", F.abs("delta"), word,
                                            F.col("below")),
                    measured=S.round_exact(F.abs("delta"), 2),
                    tolerance=S.round_exact(F.col("tol"), 3),
                    action="Correct the slab heights so that the floors meet.")


def floor_height(ctx: Context) -> DataFrame:
    height = F.col("upper_limit") - F.col("lower_limit")
    odd = ctx.bare().filter((F.col("unit_type") == "floor") & ~height.between(
        F.col("min_floor_height_m"), F.col("max_floor_height_m")))
    return _finding(odd, "FLOOR_HEIGHT_IMPLAUSIBLE", "warning",
                    message=F.format_string("Floor is %.2f m high, expected %s to %s m.", height,
                                            F.col("min_floor_height_m"),
                                            F.col("max_floor_height_m")),
                    measured=S.round_exact(height, 2),
                    action="Check floor count and levels; acknowledge if it is real.")


def sibling_overlap(ctx: Context) -> DataFrame:
    hits = spatial.sibling_overlaps(ctx.family()).select(
        F.col("a.project_id").alias("project_id"),
        F.least("a.unit_id", "b.unit_id").alias("unit_id"),
        F.greatest("a.unit_id", "b.unit_id").alias("other"), "shared", "tol_h",
        *affected.pair())
    return _finding(affected.common(hits), "OVERLAP_SIBLING", "error", related=F.array("other"),
                    geometry=F.col("affected"),
                    message=F.format_string("Shares %.2f m2 with %s at the same height.",
                                            "shared", "other"),
                    measured=S.round_exact(F.col("shared"), 2),
                    tolerance=S.round_exact(F.col("tol_h"), 3),
                    action="Move one of the two boundaries.")


def gap_in_parent(ctx: Context) -> DataFrame:
    found = gaps.uncovered(ctx.units, ctx.contains)
    limit = S.negligible_area(F.col("tol_h"))
    return _finding(found, "GAP_SIBLING", "warning",
                    related=F.col("children"), geometry=F.col("open_parts"),
                    message=F.format_string("%.2f m2 is covered by no child.", "missing"),
                    measured=S.round_exact(F.col("missing"), 2),
                    tolerance=S.round_exact(limit, 2),
                    action="Acknowledge common areas, or add the missing units.")


def escapes_parent(ctx: Context) -> DataFrame:
    """Eroded child outside its parent, else its height range outside; at most one finding."""
    own = shapes.slim(ctx.family(), "project_id", "unit_id", "lower_limit", "upper_limit",
                      "acc_h", "acc_v", "tolerance_k", "unit_type", "parent_id")
    child = own.filter(F.col("parent_id").isNotNull()
                       & ~F.col("unit_type").isin(*EASEMENT_TYPES)).alias("a")
    parent = shapes.slim(ctx.units, *[c for c in own.columns if c not in (
        *shapes.BOX, "is_rect", "area", "parts", "parent_id", "unit_type")]).alias("b")
    pairs = child.join(parent, (F.col("a.project_id") == F.col("b.project_id"))
                       & (F.col("a.parent_id") == F.col("b.unit_id")))
    k = F.col("a.tolerance_k")
    # native, exact: what lies outside before erosion bounds what lies outside after
    pairs = (pairs
             .withColumn("tol_h", S.pair_tolerance(F.col("a.acc_h"), F.col("b.acc_h"), k))
             .withColumn("tol_v", S.pair_tolerance(F.col("a.acc_v"), F.col("b.acc_v"), k))
             .withColumn("limit", S.negligible_area(F.col("tol_h")))
             .withColumn("raw", F.col("a.area") - shapes.common_area("a", "b")))
    out_z = F.coalesce((F.col("a.lower_limit") < F.col("b.lower_limit") - F.col("tol_v"))
                       | (F.col("a.upper_limit") > F.col("b.upper_limit") + F.col("tol_v")),
                       F.lit(False))
    known_z = F.coalesce(F.col("a.lower_limit"), F.col("a.upper_limit")).isNotNull()
    for c in ("a.lower_limit", "a.upper_limit", "b.lower_limit", "b.upper_limit"):
        known_z = known_z & F.col(c).isNotNull()
    # few pairs are left; written once, they part in what is decided here and what is swept
    pairs = stored(pairs.withColumn("out_z", known_z & out_z)
                   .filter((F.col("raw") > F.col("limit")) | F.col("out_z"))
                   .select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"), "tol_h",
                           "tol_v", "limit", "raw", "out_z"))
    t = F.col("tol_h")
    gone = ((F.col("a.x1") - F.col("a.x0") <= 2 * t) | (F.col("a.y1") - F.col("a.y0") <= 2 * t)
            | (t <= 0))
    d = F.when(gone, 0.0).otherwise(t)
    w, h = F.col("a.x1") - F.col("a.x0") - 2 * d, F.col("a.y1") - F.col("a.y0") - 2 * d
    cw = F.least(F.col("a.x1") - d, F.col("b.x1")) - F.greatest(F.col("a.x0") + d,
                                                                F.col("b.x0"))
    ch = F.least(F.col("a.y1") - d, F.col("b.y1")) - F.greatest(F.col("a.y0") + d,
                                                                F.col("b.y0"))
    flat = w * h - F.greatest(cw, F.lit(0.0)) * F.greatest(ch, F.lit(0.0))
    sweep = (F.col("raw") > F.col("limit")) & ~(F.col("a.is_rect") & F.col("b.is_rect"))
    swept = pairs.filter(sweep).withColumn("outside", polygons.area_outside(
        shapes.full_parts("a"), shapes.full_parts("b"), t))
    native = pairs.filter(~sweep).withColumn("outside", F.when(
        F.col("raw") <= F.col("limit"), 0.0).otherwise(flat))
    pairs = native.unionByName(swept)
    flatly = F.col("outside") > F.col("limit")
    hits = pairs.filter(flatly | F.col("out_z")).select(
        F.col("a.project_id").alias("project_id"), F.col("a.unit_id").alias("unit_id"),
        F.col("b.unit_id").alias("parent_id"),
        F.when(flatly, F.col("outside")).alias("outside"), "tol_v", t.alias("_t"),
        F.when(flatly, shapes.full_parts("a")).alias("_a"), shapes.full_parts("b").alias("_b"))
    return _finding(affected.outside(hits), "ESCAPES_PARENT", "error",
                    related=F.array("parent_id"), geometry=F.col("affected"),
                    message=F.coalesce(
                        F.format_string("%.2f m2 lies outside %s.", "outside", "parent_id"),
                        F.concat(F.lit("Height range leaves "), F.col("parent_id"))),
                    measured=S.round_exact(F.col("outside"), 2),
                    tolerance=F.when(F.col("outside").isNull(),
                                     S.round_exact(F.col("tol_v"), 3)),
                    action="Correct the unit, or give it the right parent.")


def utility_crossing(ctx: Context) -> DataFrame:
    hits = spatial.utility_crossings(ctx.units, ctx.contains).select(
        F.col("a.project_id").alias("project_id"), F.col("a.unit_id").alias("unit_id"),
        F.col("b.unit_id").alias("other"), "shared",
        F.coalesce("a.utility_kind", "a.unit_type").alias("kind"),
        *affected.pair())
    return _finding(affected.common(hits), "UTILITY_CROSSES_BUILDING", "error",
                    related=F.array("other"), geometry=F.col("affected"),
                    message=F.format_string("%s corridor runs through %s over %.2f m2.", "kind",
                                            "other", "shared"),
                    measured=S.round_exact(F.col("shared"), 2),
                    action="Move the corridor or record an easement on the unit.")


RULES: tuple[tuple[str, Rule], ...] = (
    ("GEOM_INVALID", geometry_invalid),
    ("Z_IMPOSSIBLE", heights_impossible),
    ("HEIGHTS_UNAVAILABLE", heights_unavailable),
    ("GEOM_DUPLICATE", duplicates),
    ("CRS_MISMATCH", crs_mismatch),
    ("DATUM_MISMATCH", datum_mismatch),
    ("PROVENANCE_MISSING", provenance_missing),
    ("CONFIDENCE_LOW", confidence_low),
    ("FLOOR_SEQUENCE", floor_sequence),
    ("FLOOR_HEIGHT_IMPLAUSIBLE", floor_height),
    ("OVERLAP_SIBLING", sibling_overlap),
    ("GAP_SIBLING", gap_in_parent),
    ("ESCAPES_PARENT", escapes_parent),
    ("UTILITY_CROSSES_BUILDING", utility_crossing),
)
