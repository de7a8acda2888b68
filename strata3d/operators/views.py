"""Reading the register: display rows, filters, search, hierarchy, dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.shapes import let
from ..schemas import TYPE_LABELS, UNIT_TYPES
from ..session import stored
from . import ordered
from .lifecycle import per_unit


def label() -> Column:
    return F.coalesce("ulpin", "ulpin_provisional", "unit_id")


def type_label(unit_type: str = "unit_type") -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(unit_type)), F.col(unit_type))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- display rows -------------------------------------------------------------------------

def display_ground(units: DataFrame, settings: DataFrame) -> DataFrame:
    """project_id, ground: lowest parcel bottom less the stratum below it, else the upper
    median of recorded ground levels, else the lowest limit, else 0.

    Written once: read back, its size is known, and no project's units gather in one task for it.
    """
    level = F.col("attributes.ground_level_m")
    base = units.groupBy("project_id").agg(
        F.min(F.when(F.col("unit_type") == "land_parcel", F.col("lower_limit"))).alias("_p"),
        F.min("lower_limit").alias("_l"), F.count(level).alias("_n"))
    # element n/2 of the sorted levels: counted, never collected
    tally = (units.filter(level.isNotNull()).groupBy("project_id", level.alias("_g"))
             .agg(F.count("*").alias("_c")))
    run = F.sum("_c").over(Window.partitionBy("project_id").orderBy("_g"))
    upper = (tally.withColumn("_to", run).join(base.select("project_id", "_n"), "project_id")
             .filter(F.col("_to") > F.floor(F.col("_n") / 2))
             .groupBy("project_id").agg(F.min("_g").alias("_m")))
    below = settings.select("project_id", F.col("stratum_below_limit_m").alias("_b"))
    return stored(base.join(upper, "project_id", "left").join(below, "project_id", "left")
                  .select("project_id", F.coalesce(F.col("_p") - F.col("_b"), "_m", "_l",
                                                   F.lit(0.0)).alias("ground")))


def outer_ring_wgs84(parts: Column, crs: Column) -> Column:
    zone = S.utm_zone(crs)
    ring = F.element_at(F.element_at(parts, 1), 1)
    return F.when(F.assert_true(zone.isNotNull(), F.concat(F.lit("not a UTM system: "), crs))
                  .isNull(), let(zone, lambda z: F.transform(
                      ring, lambda p: S.utm_inverse(p["x"], p["y"], z))))


def display_rows(units: DataFrame, edges: DataFrame, ground: DataFrame,
                 findings: DataFrame | None = None) -> DataFrame:
    """Units as a viewer shows them: label, parent, heights above display ground."""
    parent = (edges.filter("rel_type = 'inside'")
              .groupBy("project_id", F.col("from_unit_id").alias("unit_id"))
              .agg(F.max_by("to_unit_id", "ord").alias("parent_id")))
    out = (units.join(parent, ["project_id", "unit_id"], "left").join(ground, "project_id")
           .withColumn("label", label())
           .withColumn("validation_state", F.coalesce("validation_state",
                                                      F.lit("unvalidated")))
           .withColumn("dispute_state", F.coalesce("dispute_state", F.lit("undisputed")))
           .withColumn("easement", F.coalesce("attributes.easement", F.lit(False)))
           .withColumn("subdivided", F.col("attributes.subdivided"))
           .withColumn("base_m", F.col("lower_limit") - F.col("ground"))
           .withColumn("top_m", F.col("upper_limit") - F.col("ground")))
    if findings is not None:
        mine = findings.groupBy("project_id", "unit_id").agg(F.collect_list(F.struct(
            "rule_id", "severity", "message", "related_unit_ids", "measured_value",
            "tolerance")).alias("findings"))
        out = out.join(mine, ["project_id", "unit_id"], "left")
    return out


def display_extent() -> tuple[Column, Column]:
    """Drawn base and top: a thin slab for parcels, one metre where heights are unknown."""
    parcel = F.col("unit_type") == "land_parcel"
    unknown = F.col("base_m").isNull() | F.col("top_m").isNull()
    return (F.when(parcel | unknown, 0.0).otherwise(F.col("base_m")),
            F.when(parcel, 0.2).when(unknown, 1.0).otherwise(F.col("top_m")))


def extent_text() -> Column:
    known = F.col("lower_limit").isNotNull() & F.col("upper_limit").isNotNull()
    return F.when(known, F.format_string(
        "%.1f m → %.1f m %s (%.1f m)", "lower_limit", "upper_limit", "vertical_datum",
        F.col("upper_limit") - F.col("lower_limit"))).otherwise("unknown")


def features(rows: DataFrame) -> DataFrame:
    """One GeoJSON feature per unit, parcels first; needs `ring` (WGS84)."""
    coords = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    unknown = F.col("base_m").isNull() | F.col("top_m").isNull()
    body = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("unit_id").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
        .alias("geometry"),
        F.struct("unit_id", "label", "unit_type", "validation_state",
                 unknown.alias("unknown_height")).alias("properties")))
    return rows.select("project_id", "unit_id", parcels_first().alias("rank"), "ord",
                       body.alias("feature"))


def parcels_first() -> Column:
    return F.when(F.col("unit_type") == "land_parcel", 0).otherwise(1)


# --- filters -------------------------------------------------------------------------------

def unit_filter(types=None, validation=None, query: str | None = None) -> Column:
    """None restricts nothing, an empty list lets nothing through; query ignores case."""
    out = []
    if types is not None:
        out.append(F.col("unit_type").isin(*types) if types else F.lit(False))
    if validation is not None:
        out.append(F.col("validation_state").isin(*validation) if validation else F.lit(False))
    if query:
        q = query.strip().upper()
        out.append(F.upper("label").contains(q) | F.upper("unit_id").contains(q))
    return _all(out)


def scene_filter(show_underground: bool, slice_at: float | None, **filters) -> Column:
    """unit_filter, the underground switch, and the cut that hides what starts above it."""
    out = [unit_filter(**filters)]
    if not show_underground:
        out.append(F.col("unit_type") != "underground_feature")
    if slice_at is not None:
        out.append((F.col("unit_type") == "land_parcel")
                   | (F.coalesce("base_m", F.lit(0.0)) < slice_at))
    return _all(out)


def map_filter_v0(types=None, statuses=None, show_underground: bool = True) -> Column:
    """Older map: an empty list shows nothing, a missing one everything."""
    out = []
    for column, wanted in (("unit_type", types), ("status", statuses)):
        if wanted is not None:
            out.append(F.col(column).isin(*wanted) if wanted else F.lit(False))
    if not show_underground:
        out.append(F.col("unit_type") != "underground")
    return _all(out)


def scene_filter_v0(types=None, statuses=None, slice_at: float = 0.0,
                    show_underground: bool = True) -> Column:
    """Older scene: empty lists restrict nothing; the cut keeps what it passes through."""
    out = []
    if not show_underground:
        out.append(F.coalesce(F.col("unit_type") != "underground", F.lit(True)))
    for column, wanted in (("unit_type", types), ("status", statuses)):
        if wanted:
            out.append(F.coalesce(F.col(column).isin(*wanted), F.lit(True)))
    if slice_at > 0:
        base = F.coalesce("base_height", F.lit(0.0))
        top = F.coalesce(F.col("top_height"), base)
        out.append((base <= slice_at) & (top >= slice_at))
    return _all(out)


def search_v0(units: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Older identifier search: a blank query finds nothing."""
    q = query.strip().lower()
    hits = units.filter(F.lower("ulpin").contains(q) if q else F.lit(False))
    return hits if limit is None else hits.orderBy("ord").limit(limit)


def search_register(units: DataFrame, query: str, type_is: str | None = None,
                    status_is: str | None = None) -> DataFrame:
    """Identifier, unit id or type label contains the query; a blank query lists all."""
    q = query.strip().lower()
    rows = units.select("project_id", "unit_id", "ord", label().alias("ulpin"),
                        F.col("ulpin").isNull().alias("provisional"),
                        type_label().alias("type"), F.col("attributes.floor_index")
                        .alias("floor"), "status", "lower_limit", "upper_limit")
    if q:
        rows = rows.filter(F.lower("ulpin").contains(q) | F.lower("unit_id").contains(q)
                           | F.lower("type").contains(q))
    if type_is:
        rows = rows.filter(F.col("type") == type_is)
    return rows.filter(F.col("status") == status_is) if status_is else rows


def first_match(rows: DataFrame, **filters) -> DataFrame:
    return rows.filter(unit_filter(**filters)).orderBy("ord").limit(1)


def find_v0(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Older lookup: a unit's key is its identifier, or its feature id without one."""
    return units.withColumn("key", F.coalesce("ulpin", "id")).join(wanted, "key", "left_semi")


# --- hierarchy -----------------------------------------------------------------------------

def ancestors(links: DataFrame) -> DataFrame:
    """unit_id, ancestor, step (1 = parent) for all units at once.

    `links`: project_id, unit_id, parent_id. One equi join a level, written and read back, until
    no unit has a further ancestor; a unit already on its own path ends it.
    """
    up = links.select("project_id", F.col("unit_id").alias("_u"), F.col("parent_id")
                      .alias("_p"))
    real = links.select("project_id", F.col("unit_id").alias("_p"))
    at = (links.filter("parent_id is not null")
          .select("project_id", "unit_id", F.col("parent_id").alias("_p"))
          .join(real, ["project_id", "_p"], "left_semi")
          .withColumn("path", F.array("unit_id")).withColumn("step", F.lit(1)))
    out = []
    while True:
        at = stored(at.filter(~F.array_contains("path", F.col("_p"))))
        if out and at.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(at.select("project_id", "unit_id", F.col("_p").alias("ancestor"), "step"))
        at = (at.withColumn("path", F.concat("path", F.array("_p")))
              .withColumnRenamed("_p", "_u")
              .join(up.filter("_p is not null"), ["project_id", "_u"])
              .join(real, ["project_id", "_p"], "left_semi")
              .select("project_id", "unit_id", "_p", "path",
                      (F.col("step") + 1).alias("step")))


def children(links: DataFrame) -> DataFrame:
    return links.filter("parent_id is not null").groupBy("project_id", "parent_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("unit_id")).alias("children"))


PARENT_KEYS_V0 = ("parent_ulpin", "parentUlpin", "parent_id", "parentId", "parent")


def parent_v0(columns: list[str]) -> Column:
    """First parent key that is set, whatever spelling the collection uses."""
    have = [F.col(c).cast("string") for c in PARENT_KEYS_V0 if c in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


# --- dashboards ----------------------------------------------------------------------------

def finding_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        F.substring("finding_id", 1, 8).alias("id"), "finding_id",
        F.col("severity").alias("type"), F.col("rule_id").alias("category"),
        F.col("message").alias("description"), F.col("unit_id").alias("parcel"),
        F.initcap("severity").alias("severity"),
        F.col("acknowledged_by").alias("acknowledged_by"),
        F.col("measured_value").alias("measured"), "tolerance")


def severity_rank(column: str = "severity") -> Column:
    return (F.when(F.col(column) == "error", 0).when(F.col(column) == "warning", 1)
            .otherwise(2))


def top_alerts(findings: DataFrame, n: int = 3) -> DataFrame:
    return findings.orderBy(severity_rank(), "ord").limit(n)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def dashboard_units(units: DataFrame) -> DataFrame:
    out = [F.count_if(F.col("unit_type") == t).alias(t) for t in UNIT_TYPES]
    out += [F.count_if(F.col("status") == s).alias(s)
            for s in ("needs_review", "approved", "draft")]
    unknown = F.col("lower_limit").isNull() | F.col("upper_limit").isNull()
    return units.agg(*out, F.count("*").alias("total"),
                     F.count_if(unknown).alias("unknown_height"))


def dashboard_rollup(units: DataFrame) -> DataFrame:
    return units.rollup("project_id", "unit_type", "status").agg(F.count("*").alias("units"))


def review_queue(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Units waiting for review with what stands in their way.

    Infos stand in nobody's way. Counts have one row a unit, so they are hashed where they meet the
    units, and neither side is sorted.
    """
    waiting = units.filter("status = 'needs_review'")
    warn = F.col("severity") == "warning"
    counts = (per_unit(findings.filter(F.col("severity").isin("error", "warning")))
              .groupBy("project_id", F.col("named_unit_id").alias("unit_id"))
              .agg(F.count_if(F.col("severity") == "error").alias("errors"),
                   F.count_if(warn).alias("warnings"),
                   F.count_if(warn & F.col("acknowledged_by").isNull())
                   .alias("unacknowledged")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings",
                                                       "unacknowledged")]
    return (waiting.join(counts.hint("shuffle_hash"), ["project_id", "unit_id"], "left")
            .select("project_id", "unit_id", F.coalesce(
                "ulpin", "ulpin_provisional", F.lit("— not yet assigned —")).alias("ulpin"),
                F.col("ulpin").isNull().alias("provisional"), type_label().alias("type"),
                F.col("attributes.floor_index").alias("floor"), "created_by",
                F.col("confidence_score").alias("confidence"), *zero)
            .withColumn("approvable", (F.col("errors") == 0) & (F.col("unacknowledged") == 0)))


def review_record(queue: DataFrame) -> DataFrame:
    """Queue rows as a reviewer reads them."""
    return queue.withColumn("floor_text", F.when(F.col("floor").isNull(), "—").otherwise(
        F.concat(F.lit("Floor index "), F.col("floor").cast("string")))).withColumn(
        "confidence_text", F.when(F.col("confidence").isNull(), "n/a").otherwise(
            F.format_string("%.1f%%", F.col("confidence") * 100)))


def bounds(rows: DataFrame) -> DataFrame:
    """Extent of shaped rows; NULLs when there is none."""
    return rows.agg(F.min("x0").alias("x_min"), F.min("y0").alias("y_min"),
                    F.max("x1").alias("x_max"), F.max("y1").alias("y_max"))


def height_range(rows: DataFrame) -> DataFrame:
    """Slider ends over known heights of everything but parcels, never inside [0, 10]."""
    r = rows.filter("unit_type <> 'land_parcel'").agg(F.min("base_m").alias("lo"),
                                                      F.max("top_m").alias("hi"))
    return r.select(F.floor(F.least(F.lit(0.0), F.coalesce("lo", F.lit(0.0))) - 1)
                    .alias("range_min"),
                    F.ceil(F.greatest(F.lit(10.0), F.coalesce("hi", F.lit(10.0))) + 1)
                    .alias("range_max"))


def floor_marks(rows: DataFrame) -> DataFrame:
    return rows.filter("unit_type in ('floor', 'apartment') and base_m is not null").select(
        "project_id", "base_m").distinct()


def strata_spans(rows: DataFrame) -> DataFrame:
    return rows.filter("unit_type not in ('land_parcel', 'building') and base_m is not null "
                       "and top_m is not null").select("unit_id", "base_m", "top_m")


def compare_findings(reported: DataFrame, expected: DataFrame,
                     must_not: DataFrame) -> DataFrame:
    """Ruleset regression: findings missing, spurious, or forbidden."""
    key = ["rule_id", "unit_id", "related_unit_ids"]

    def tag(df, name):
        return df.select(*key, F.lit(name).alias("problem"))

    none = must_not.join(reported, ["rule_id", "unit_id"], "left_semi").withColumn(
        "related_unit_ids", F.array().cast("array<string>"))
    return (tag(expected.select(*key).exceptAll(reported.select(*key)), "missing")
            .unionByName(tag(reported.select(*key).exceptAll(expected.select(*key)),
                             "spurious"))
            .unionByName(tag(none, "must_not_fire")))


# --- listings ------------------------------------------------------------------------------

def suggestion_listing(suggestions: DataFrame, review_state: str | None = None) -> DataFrame:
    """All suggestions (of one state) with `place`: latest run first, then by id, per project."""
    s = suggestions if review_state is None else suggestions.filter(
        F.col("review_state") == review_state)
    latest = -F.unix_micros("model.run_at")
    return ordered.place_by_text(s, ["project_id"], "suggestion_id", "place", (latest,)).withColumn(
        "place", F.col("place") + 1)


def findings_of(findings: DataFrame, severity: str | None = None,
                rule_id: str | None = None) -> DataFrame:
    """Findings of one severity and one rule; None asks for all."""
    for column, wanted in (("severity", severity), ("rule_id", rule_id)):
        if wanted is not None:
            findings = findings.filter(F.col(column) == wanted)
    return findings
