"""One query per operator over the projected register, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata3d.functions import polygons, shapes
from strata3d.functions import scalars as S
from strata3d.operators import (context, contracts, footprints, identity, lifecycle, ordered,
                                raster, rules, spatial, views)
from strata3d.operators import units as U
from strata3d.plans import detecting
from strata3d.schemas import LEDGER, PARTS, SEQUENCE
from strata3d.session import stored
from strata3d.sources import documents, geojson, layers, register
from strata3d.sources.documents import parse_suggestions

from . import sqlkit as Q
from .views import PROJECT, Testbed, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_BEDS: dict[tuple[int, str], Testbed] = {}


def bed(spark: SparkSession, sf_dir: str) -> Testbed:
    key = (id(spark.sparkContext), sf_dir)
    if key not in _BEDS:
        _BEDS[key] = Testbed(spark, sf_dir)
    return _BEDS[key]


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(bed(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def joined(column: str, sep: str = ","):
    return F.array_join(column, sep).alias(column)


# --- validation rules ----------------------------------------------------------------------

def rule(name: str, fn: rules.Rule, sql: str, located: bool = False, once: bool = False) -> None:
    """`located` rules also compare area and box of the affected region; those that read units
    `once` do not have them stored."""
    def run(tb: Testbed) -> DataFrame:
        where, region = [], F.col("affected_geometry")
        if located:
            box = shapes.bbox(region)
            where = [F.round(shapes.area(region), 4).alias("where_area"),
                     *[F.round(box[c], 4).alias(f"where_{c}") for c in shapes.BOX]]
        return fn(tb.seen_context() if once else tb.context()).select(
            "rule_id", "severity", "unit_id",
            F.array_join("related_unit_ids", ",").alias("related"),
            F.col("measured_value").alias("measured"), "tolerance", *where)
    query(name, sql)(run)


def finding_sql(rule_id: str, severity: str, body: str, related: str = "''",
                measured: str = "CAST(NULL AS DOUBLE)",
                tolerance: str = "CAST(NULL AS DOUBLE)", extra: str = "",
                where: tuple[str, ...] = ()) -> str:
    """`where`: area and box of the region a finding is about."""
    names = ("area", *shapes.BOX)
    region = "".join(f", round({v}, 4) AS where_{n}" for n, v in zip(names, where))
    return (f"{Q.register()}{extra} SELECT '{rule_id}' AS rule_id, '{severity}' AS severity, "
            f"unit_id, {related} AS related, {measured} AS measured, "
            f"{tolerance} AS tolerance{region} FROM {body}")


rule("rule_z_impossible", rules.heights_impossible, finding_sql(
    "Z_IMPOSSIBLE", "error", "eu WHERE lower_limit >= upper_limit",
    measured="upper_limit - lower_limit"))
rule("rule_heights_unavailable", rules.heights_unavailable, finding_sql(
    "HEIGHTS_UNAVAILABLE", "error", "eu WHERE lower_limit IS NULL OR upper_limit IS NULL"))
rule("rule_duplicate", rules.duplicates, finding_sql(
    "GEOM_DUPLICATE", "error", """(SELECT unit_id, FIRST_VALUE(unit_id) OVER w AS f,
    ROW_NUMBER() OVER w AS rn FROM eu WINDOW w AS (PARTITION BY x0, y0, x1, y1, lower_limit,
    upper_limit ORDER BY ord)) WHERE rn > 1""", related="f"))
rule("rule_crs_mismatch", rules.crs_mismatch, finding_sql(
    "CRS_MISMATCH", "error", "eu WHERE crs <> 'EPSG:32643'"))
rule("rule_datum_mismatch", rules.datum_mismatch, finding_sql(
    "DATUM_MISMATCH", "error", "eu WHERE vertical_datum <> 'EGM2008'"))
rule("rule_provenance_missing", rules.provenance_missing, finding_sql(
    "PROVENANCE_MISSING", "info", "eu WHERE NOT acc_known"))
rule("rule_confidence_low", rules.confidence_low, finding_sql(
    "CONFIDENCE_LOW", "warning", "eu WHERE created_by = 'ai' AND confidence_score < 6e-1",
    measured="confidence_score", tolerance="6e-1"))
rule("rule_floor_sequence", rules.floor_sequence, finding_sql(
    "FLOOR_SEQUENCE", "error", "gap", related="below", measured=Q.rx("d", 2),
    tolerance=Q.rx("tol", 3), extra=",\n" + Q.STACK))
rule("rule_floor_height", rules.floor_height, finding_sql(
    "FLOOR_HEIGHT_IMPLAUSIBLE", "warning",
    "eu WHERE unit_type = 'floor' AND NOT (upper_limit-lower_limit BETWEEN 24e-1 AND 5e0)",
    measured=Q.rx("upper_limit-lower_limit", 2)))
rule("rule_sibling_overlap", rules.sibling_overlap, finding_sql(
    "OVERLAP_SIBLING", "error", f"""(SELECT least(a.unit_id, b.unit_id) AS unit_id,
    greatest(a.unit_id, b.unit_id) AS other, {Q.SHARED} AS shared, {Q.TH} AS th, {Q.TV} AS tv,
    {Q.COMMON_BOX} FROM eu a JOIN eu b ON a.unit_type = b.unit_type
    AND COALESCE(a.parent_id, '') = COALESCE(b.parent_id, '') AND a.unit_id < b.unit_id
    AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
    WHERE a.unit_type NOT IN ('underground_feature', 'elevated_structure')
    AND {Q.ZOVER.format(tv=Q.TV)} AND {Q.eroded(Q.TH)}) WHERE shared > greatest(th*th, 1e-9)""",
    related="other", measured=Q.rx("shared", 2), tolerance=Q.rx("th", 3),
    where=("shared", "wx0", "wy0", "wx1", "wy1")), located=True, once=True)
rule("rule_gap", rules.gap_in_parent, finding_sql(
    "GAP_SIBLING", "warning", """(SELECT f.unit_id, a.unit_id || ',' || b.unit_id AS kids,
    greatest((b.x0 - sqrt(f.acc_h*f.acc_h*2)) - (a.x1 + sqrt(f.acc_h*f.acc_h*2)), 0e0)
    * (f.y1 - f.y0) AS missing, sqrt(f.acc_h*f.acc_h*2) AS th, a.x1 + sqrt(f.acc_h*f.acc_h*2)
    AS wx0, b.x0 - sqrt(f.acc_h*f.acc_h*2) AS wx1, f.y0 AS wy0, f.y1 AS wy1 FROM eu f
    JOIN eu a ON a.parent_id = f.unit_id AND a.ord % 2 = 0
    JOIN eu b ON b.parent_id = f.unit_id AND b.ord % 2 = 1 WHERE f.subdivided)
    WHERE missing > greatest(th*th, 1e-9)""",
    related="kids", measured=Q.rx("round(missing, 9)", 2),
    tolerance=Q.rx("greatest(th*th, 1e-9)", 2),
    where=("missing", "wx0", "wy0", "wx1", "wy1")), located=True)
_D = ("(CASE WHEN a.x1-a.x0 <= 2*th OR a.y1-a.y0 <= 2*th THEN 0e0 ELSE th END)")
rule("rule_escapes_parent", rules.escapes_parent, finding_sql(
    "ESCAPES_PARENT", "error", f"""(SELECT unit_id, pid, lim, tv, out_z, ex0, ey0, ex1, ey1, qx0, qy0, qx1, qy1,
    CASE WHEN raw <= lim THEN 0e0 ELSE w*h - greatest(cw,0e0)*greatest(ch,0e0) END AS outside
    FROM (SELECT a.unit_id, a.pid, tv, px0 AS qx0, py0 AS qy0, px1 AS qx1, py1 AS qy1,
      a.x0+{_D} AS ex0, a.y0+{_D} AS ey0, a.x1-{_D} AS ex1, a.y1-{_D} AS ey1, greatest(th*th,1e-9) AS lim,
      (a.x1-a.x0)*(a.y1-a.y0) - greatest(least(a.x1,px1)-greatest(a.x0,px0),0e0)
        *greatest(least(a.y1,py1)-greatest(a.y0,py0),0e0) AS raw,
      a.x1-a.x0-2*{_D} AS w, a.y1-a.y0-2*{_D} AS h,
      least(a.x1-{_D},px1)-greatest(a.x0+{_D},px0) AS cw,
      least(a.y1-{_D},py1)-greatest(a.y0+{_D},py0) AS ch,
      COALESCE(a.lower_limit < plo - tv OR a.upper_limit > phi + tv, FALSE)
        AND a.lower_limit IS NOT NULL AND a.upper_limit IS NOT NULL
        AND plo IS NOT NULL AND phi IS NOT NULL AS out_z
      FROM (SELECT a.*, b.unit_id AS pid, b.x0 AS px0, b.y0 AS py0, b.x1 AS px1, b.y1 AS py1,
            b.lower_limit AS plo, b.upper_limit AS phi, {Q.TH} AS th, {Q.TV} AS tv
            FROM eu a JOIN eu b ON b.unit_id = a.parent_id) a))
    WHERE outside > lim OR out_z""", related="pid",
    measured=f"CASE WHEN outside > lim THEN {Q.rx('outside', 2)} END",
    tolerance=f"CASE WHEN outside <= lim THEN {Q.rx('tv', 3)} END",
    where=tuple(f"CASE WHEN outside > lim THEN {v} END" for v in (
        "outside", *(Q.beyond(c, end) for end in "01" for c in "xy")))), located=True)
rule("rule_utility_crossing", rules.utility_crossing, finding_sql(
    "UTILITY_CROSSES_BUILDING", "error", f"""(SELECT a.unit_id, b.unit_id AS other,
    {Q.SHARED} AS shared, {Q.COMMON_BOX} FROM eu a JOIN eu b
    ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
    WHERE a.unit_type IN ('underground_feature', 'elevated_structure')
    AND (b.unit_type IN ('floor', 'apartment') OR (b.unit_type = 'building' AND b.unit_id NOT IN
         (SELECT parent_id FROM eu WHERE unit_type = 'floor')))
    AND {Q.ZOVER.format(tv=Q.TV)} AND {Q.eroded(Q.TH)})""",
    related="other", measured=Q.rx("shared", 2), where=tuple(
        f"CASE WHEN shared > 0 THEN {v} END" for v in ("shared", "wx0", "wy0", "wx1", "wy1"))), located=True)


@query("rule_geometry_invalid", duckdb_with("sketch")
       + " SELECT k, form FROM sketch WHERE form = 0")
def _(tb):
    s = tb.kept("sketches").withColumn("project_id", F.lit(PROJECT)).withColumn(
        "unit_id", F.col("k").cast("string"))
    bad = rules.geometry_invalid(rules.Context(shapes.with_shape(s), None))
    return bad.select(F.col("unit_id").cast("bigint").alias("k")).join(
        s.select("k", "form"), "k")


@query("validation_run", f"""{Q.with_findings()} SELECT rule_id, severity,
       COUNT(*) AS findings FROM finding GROUP BY ALL""")
def _(tb):
    return tb.kept("findings").groupBy("rule_id", "severity").agg(
        F.count("*").alias("findings"))


# --- accuracy, graph, identity ---------------------------------------------------------------

@query("worst_source_accuracy", Q.register()
       + " SELECT unit_id, acc_h, acc_v, acc_known FROM acc")
def _(tb):
    return tb.context().units.select("unit_id", "acc_h", "acc_v", "acc_known")


@query("parents_by_contains", duckdb_with("unit")
       + " SELECT unit_id, parent_id FROM unit WHERE parent_id IS NOT NULL")
def _(tb):
    return context.parents(tb.kept("relationships")).select("unit_id", "parent_id")


@query("edges_both_directions", duckdb_with("unit") + """
       SELECT parent_id AS from_unit_id, unit_id AS to_unit_id, 'contains' AS rel_type
       FROM unit WHERE parent_id IS NOT NULL
       UNION ALL SELECT unit_id, parent_id, 'inside' FROM unit WHERE parent_id IS NOT NULL""")
def _(tb):
    return tb.kept("relationships").select("from_unit_id", "to_unit_id", "rel_type")


@query("children_of_units", duckdb_with("unit") + """
       SELECT parent_id, COUNT(*) AS n, string_agg(unit_id, ',' ORDER BY unit_id) AS children
       FROM unit WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def _(tb):
    links = tb.view("unit").select(F.lit(PROJECT).alias("project_id"), "unit_id", "parent_id")
    return views.children(links).select("parent_id", "n", joined("children"))


@query("ancestors_of_units", duckdb_with("unit").replace("WITH ", "WITH RECURSIVE ", 1) + """,
       up AS (SELECT unit_id, parent_id AS ancestor, 1 AS step FROM unit
              WHERE parent_id IS NOT NULL
              UNION ALL SELECT up.unit_id, u.parent_id, up.step + 1 FROM up
              JOIN unit u ON u.unit_id = up.ancestor WHERE u.parent_id IS NOT NULL)
       SELECT unit_id, ancestor, step FROM up""")
def _(tb):
    links = tb.kept("units").select("project_id", "unit_id",
                                    F.col("parent_ref").alias("parent_id"))
    return views.ancestors(links).select("unit_id", "ancestor", "step")


@query("identity_reuse", duckdb_with("building") + """
       SELECT 'B-' || CAST(k AS STRING) AS local_id, k % 2 = 0 AS reused,
              CASE WHEN k % 2 = 0 THEN unit_id END AS old_id FROM building""")
def _(tb):
    b = tb.view("building").select(F.lit(PROJECT).alias("project_id"), F.lit("building").alias(
        "unit_type"), F.concat(F.lit("B-"), F.col("k").cast("string")).alias("local_id"),
        F.col("k").alias("ord"), "unit_id")
    known = b.filter(F.pmod("ord", F.lit(2)) == 0).select(
        "project_id", "unit_type", "unit_id", "ord",
        F.struct(F.col("local_id").alias("local_id")).alias("attributes"))
    got = U.identify(b.drop("unit_id"), known)
    return got.select("local_id", "reused",
                      F.when(F.col("reused"), F.col("unit_id")).alias("old_id"))


_SEQ = """asked AS (SELECT unit_id, ord, parent_ulpin,
    CASE WHEN COALESCE(floor_index,0) < 0 THEN 'B' WHEN unit_type = 'land_parcel' THEN 'S'
         ELSE 'A' END AS stratum, abs(COALESCE(floor_index, 0)) AS level
    FROM unit WHERE unit_type IN ('land_parcel','building','floor')
    AND parent_ulpin IS NOT NULL),
  seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_ulpin, stratum, level ORDER BY ord)
                    - 1 AS sequence FROM asked)"""


def _asked(tb):
    return tb.kept("units").filter(
        "unit_type in ('land_parcel', 'building', 'floor')").select(
        "project_id", "unit_id", "ord", "unit_type",
        F.col("attributes.floor_index").alias("floor_index"),
        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"))


def _none_held(tb):
    """No row, which Spark knows beforehand, so that nothing moves to meet it."""
    return tb.spark.createDataFrame([], SEQUENCE).filter(F.lit(False))


@query("mint_provisional_identifiers", f"""{duckdb_with("unit")}, {_SEQ}
       SELECT unit_id, stratum, CAST(level AS INT) AS level, CAST(sequence AS INT) AS sequence,
              {Q.identifier("parent_ulpin", "stratum", "level", "sequence")}
              AS ulpin_provisional FROM seq""")
def _(tb):
    ids, _rows = identity.mint(_asked(tb), _none_held(tb), F.lit(1))
    return ids.select("unit_id", "stratum", "level", "sequence", "ulpin_provisional")


@query("sequence_with_held_numbers", f"""{duckdb_with("unit")}, {_SEQ},
       held AS (SELECT * FROM seq WHERE ord % 3 = 0),
       top AS (SELECT parent_ulpin, stratum, level, MAX(sequence) AS t FROM held GROUP BY ALL)
       SELECT unit_id, CAST(sequence AS INT) AS sequence, FALSE AS is_new FROM held
       UNION ALL SELECT s.unit_id, CAST(COALESCE(t, -1) + ROW_NUMBER() OVER (PARTITION BY
       s.parent_ulpin, s.stratum, s.level ORDER BY s.ord) AS INT), TRUE
       FROM seq s LEFT JOIN top USING (parent_ulpin, stratum, level) WHERE s.ord % 3 <> 0""")
def _(tb):
    asked = (_asked(tb).filter("parent_ulpin_14 is not null")
             .withColumn("stratum", identity.stratum(F.col("unit_type"), F.col("floor_index")))
             .withColumn("level", identity.level(F.col("floor_index"))))
    # requests keep their `ord`, so the third that holds its number is told without a join
    held = stored(identity.allocate(asked, _none_held(tb)).filter(F.pmod("ord", F.lit(3)) == 0)
                  .select(*identity.LEVEL_KEYS, "unit_id", "sequence"))
    return identity.allocate(asked, held).select("unit_id", "sequence", "is_new")


_OVER = """over AS (SELECT parent_ulpin, stratum, level, COUNT(*) - 1000 AS refused FROM (
    SELECT 'KA05B00000000' || CAST(k % 2 AS STRING) AS parent_ulpin, 'A' AS stratum, 0 AS level
    FROM building) GROUP BY ALL HAVING COUNT(*) > 1000)"""


@query("sequence_overflow_refused", f"""{duckdb_with("building")}, {_OVER}
       SELECT parent_ulpin AS parent_ulpin_14, stratum, CAST(level AS INT) AS level, refused
       FROM over""")
def _(tb):
    crowded = tb.view("building").select(
        F.lit(PROJECT).alias("project_id"), "unit_id", F.col("k").alias("ord"),
        F.concat(F.lit("KA05B00000000"), F.pmod("k", F.lit(2)).cast("string"))
        .alias("parent_ulpin_14"), F.lit("A").alias("stratum"), F.lit(0).alias("level"))
    return identity.exhausted(identity.allocate(crowded, _none_held(tb))).select(
        "parent_ulpin_14", "stratum", "level", "refused")


_AUDIT = f"""{duckdb_with("parcel")}, good AS (SELECT k, {Q.identifier(
    "'KA05B' || lpad(CAST(k AS STRING),9,'0')", "'S'", "k % 100", "k % 1000")} AS u FROM parcel),
  ids AS (SELECT k, CASE WHEN k % 37 = 0 THEN substr(u,1,25)||'*' WHEN k % 41 = 0
          THEN substr(u,1,13)||CASE WHEN substr(u,14,1)='5' THEN '6' ELSE '5' END||substr(u,15)
          ELSE u END AS ulpin FROM good)"""


def _identifiers(tb):
    k = F.col("k")
    p = tb.view("parcel").select(k, S.format_identifier(
        F.concat(F.lit("KA05B"), F.lpad(k.cast("string"), 9, "0")), F.lit(1), F.lit("S"),
        F.pmod(k, F.lit(100)), F.pmod(k, F.lit(1000))).alias("u"))
    other = F.when(F.substring("u", 14, 1) == "5", "6").otherwise("5")
    return p.select("k", F.lit(PROJECT).alias("project_id"), F.when(
        F.pmod("k", F.lit(37)) == 0, F.concat(F.substring("u", 1, 25), F.lit("*")))
        .when(F.pmod("k", F.lit(41)) == 0, F.concat(F.substring("u", 1, 13), other,
                                                    F.substring("u", 15, 20)))
        .otherwise(F.col("u")).alias("ulpin"))


@query("identifier_audit", f"""{_AUDIT} SELECT k, k % 37 <> 0 AS well_formed,
       k % 37 <> 0 AND k % 41 <> 0 AS valid,
       CASE WHEN k % 37 <> 0 AND k % 41 <> 0 THEN 'urn:ulpin:3d:v1:'||substr(ulpin,1,14)||':S:'
       ||substr(ulpin,20,2)||':'||substr(ulpin,23,3) END AS urn FROM ids""")
def _(tb):
    return identity.audit(_identifiers(tb), "ulpin").select("k", "well_formed", "valid", "urn")


@query("identifier_lookup", f"""{_AUDIT} SELECT k, CASE WHEN k % 37 = 0 OR k % 41 = 0
       THEN 'malformed' WHEN k % 2 = 0 THEN 'found' ELSE 'never_issued' END AS outcome,
       CASE WHEN k % 2 = 0 AND k % 37 <> 0 AND k % 41 <> 0 THEN CASE WHEN k % 10 = 0
       THEN 'closed' ELSE 'issued' END END AS state FROM ids""")
def _(tb):
    ids = _identifiers(tb)
    led = (ids.filter((F.pmod("k", F.lit(2)) == 0) & S.is_identifier(F.col("ulpin")))
           .select("project_id", "ulpin", F.col("k").cast("string").alias("unit_id"),
                   F.lit("issued").alias("state"), F.lit(None).cast("timestamp")
                   .alias("issued_at"), F.col("k").alias("ord")))
    closing = led.filter(F.pmod("ord", F.lit(10)) == 0).select(
        "project_id", "ulpin", F.lit("closed").alias("state"), "ord")
    return identity.resolve(ids, identity.mark(led, closing)).select("k", "outcome", "state")


@query("identifier_repeats_and_ledger", f"""{duckdb_with("building")}
       SELECT CAST(k // 2 AS STRING) AS ulpin, COUNT(*) AS n, MIN(CASE WHEN k // 2 % 3 = 0
       THEN 'not_in_ledger' WHEN k // 2 % 3 = 1 THEN 'other_unit' END) AS problem
       FROM building GROUP BY ALL HAVING COUNT(*) > 1""")
def _(tb):
    u = tb.view("building").select(F.lit(PROJECT).alias("project_id"), "unit_id",
                                   F.floor(F.col("k") / 2).cast("string").alias("ulpin"))
    num = F.pmod(F.col("ulpin").cast("bigint"), F.lit(3))
    led = u.groupBy("project_id", "ulpin").agg(F.min("unit_id").alias("unit_id")).filter(
        num != 0).withColumn("unit_id", F.when(num == 1, "X").otherwise(F.col("unit_id")))
    bad = (identity.ledger_mismatches(u, led).filter((num != 2))
           .groupBy("ulpin").agg(F.min("problem").alias("problem")))
    return identity.repeated(u, "ulpin").select("ulpin", "n").join(bad, "ulpin", "left")


@query("freeze_on_approval", f"""{duckdb_with("building")},
       a AS (SELECT unit_id, k, parent_ulpin, k % 5 AS c, ROW_NUMBER() OVER (PARTITION BY
         parent_ulpin, k % 5 <> 0 ORDER BY k) AS rn FROM building WHERE parent_ulpin IS NOT NULL)
       SELECT unit_id, 'unknown_parcel' AS outcome FROM building WHERE parent_ulpin IS NULL
       UNION ALL SELECT unit_id, CASE WHEN c = 0 AND rn > 1 THEN 'already_issued'
         ELSE 'issued' END FROM a""")
def _(tb):
    b = tb.view("building")
    prov = F.when(F.pmod("k", F.lit(5)) == 0, S.format_identifier(
        F.col("parent_ulpin"), F.lit(1), F.lit("A"), F.lit(0), F.lit(999)))
    asked = b.select(F.lit(PROJECT).alias("project_id"), "unit_id", F.col("k").alias("ord"),
                     F.lit("building").alias("unit_type"), F.lit(None).cast("int").alias(
                         "floor_index"), F.col("parent_ulpin").alias("parent_ulpin_14"),
                     prov.alias("ulpin_provisional"))
    # numbers 999 are spent on level 0, so fresh ones are asked on level 1
    asked = asked.withColumn("floor_index", F.when(F.col("ulpin_provisional").isNull(), 1))
    out, _rows = identity.freeze(asked, _none_held(tb), tb.spark.createDataFrame([], LEDGER),
                                 F.lit(1))
    return out.select("unit_id", "outcome")


# --- spatial joins -----------------------------------------------------------------------------

_ATTACH = """pairs AS (SELECT f.id, p.unit_id AS pid, greatest(least(f.x1,p.x1)
      -greatest(f.x0,p.x0),0e0)*greatest(least(f.y1,p.y1)-greatest(f.y0,p.y0),0e0)
      / ((f.x1-f.x0)*(f.y1-f.y0)) AS share FROM f JOIN parcel p
      ON f.x0 < p.x1 AND p.x0 < f.x1 AND f.y0 < p.y1 AND p.y0 < f.y1),
    best AS (SELECT id, MAX(share) AS share, arg_max(pid, share) AS pid, COUNT(*) AS n
             FROM pairs GROUP BY id)
    SELECT f.id, CASE WHEN share > 5e-1 THEN pid END AS parcel_id,
      CASE WHEN share > 5e-1 THEN {rx} END AS parcel_share,
      CASE WHEN share > 5e-1 THEN 'attached' WHEN n IS NULL THEN 'none' ELSE 'spread' END AS how
    FROM f LEFT JOIN best USING (id)"""


def _attached(found, tb):
    parcels = tb.kept("units").filter("unit_type = 'land_parcel'").select(
        "project_id", F.col("unit_id").alias("parcel_id"),
        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"), "parts", *shapes.BOX,
        "is_rect", "area")
    out = spatial.attach_to_parcel(found.withColumn("named_parcel", F.lit(None).cast("string")),
                                   parcels)
    how = F.when(F.col("parcel_id").isNotNull(), "attached").when(
        F.col("parcel_unresolved").startswith("no parcel"), "none").otherwise("spread")
    return out.select(F.col("local_id").alias("id"), "parcel_id", "parcel_share",
                      how.alias("how"))


@query("attach_buildings_to_parcels", duckdb_with("building", "parcel") + """,
       f AS (SELECT unit_id AS id, x0, y0, x1, y1 FROM building), """
       + _ATTACH.replace("{rx}", Q.rx("share", 4)))
def _(tb):
    return _attached(tb.kept("units").filter("unit_type = 'building'")
                     .withColumn("local_id", F.col("unit_id")), tb)


@query("attach_suggestions_to_parcels", duckdb_with("suggestion", "parcel") + """,
       f AS (SELECT suggestion_id AS id, x0 + edit_shift AS x0, y0, x1 + edit_shift AS x1, y1
             FROM suggestion WHERE review_state IN ('accepted', 'edited')), """
       + _ATTACH.replace("{rx}", Q.rx("share", 4)))
def _(tb):
    s = tb.kept("suggestions").filter("review_state in ('accepted', 'edited')").withColumn(
        "parts", U.chosen_outline())
    return _attached(shapes.with_shape(s).withColumn("local_id", F.col("suggestion_id")), tb)


@query("attach_named_parcel", duckdb_with("building", "parcel") + """
       SELECT b.unit_id AS id, CASE WHEN b.k % 3 <> 0 THEN b.parcel_id END AS parcel_id,
              CASE WHEN b.k % 3 = 0 THEN 'unknown name' ELSE 'attached' END AS how
       FROM building b""")
def _(tb):
    b = tb.kept("units").filter("unit_type = 'building'").withColumn(
        "local_id", F.col("unit_id")).withColumn("named_parcel", F.when(
            F.pmod("ord", F.lit(3)) == (10 ** 12) % 3, "nowhere").otherwise(F.col("parent_ref")))
    parcels = tb.kept("units").filter("unit_type = 'land_parcel'").select(
        "project_id", F.col("unit_id").alias("parcel_id"),
        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"), "parts", *shapes.BOX,
        "is_rect", "area")
    out = spatial.attach_to_parcel(b, parcels)
    return out.select(F.col("local_id").alias("id"), "parcel_id", F.when(
        F.col("parcel_unresolved").startswith("named"), "unknown name").otherwise("attached")
        .alias("how"))


_SAME = f"""SELECT a.id AS id, arg_min(b.known, b.ord) AS match FROM f a JOIN g b
    ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
    WHERE {Q.SHARED} > 5e-1*(a.x1-a.x0)*(a.y1-a.y0)
      AND {Q.SHARED} > 5e-1*(b.x1-b.x0)*(b.y1-b.y0) GROUP BY a.id"""
_FOUND = "f AS (SELECT suggestion_id AS id, x0, y0, x1, y1 FROM suggestion)"
_QUEUE = """g AS (SELECT suggestion_id AS known, ord, x0 + edit_shift + 1e0 AS x0, y0,
    x1 + edit_shift + 1e0 AS x1, y1 FROM suggestion)"""
_BUILT = "g AS (SELECT unit_id AS known, k AS ord, x0, y0, x1, y1 FROM building)"


def _found(tb):
    return shapes.with_shape(tb.sighted().select("project_id", "suggestion_id", "parts"))


def _queue(tb):
    """The queue as reviewers left it, one metre east of the new sightings."""
    s = tb.view("suggestion")
    move = F.col("edit_shift") + 1.0
    return s.select(F.lit(PROJECT).alias("project_id"), "suggestion_id", "ord", shapes.rectangle(
        F.col("x0") + move, F.col("y0"), F.col("x1") + move, F.col("y1")).alias("parts"),
        F.lit("pending").alias("review_state"), F.lit(None).cast(
            PARTS).alias("edited_parts"))


@query("detections_already_mapped", f"{duckdb_with('suggestion', 'building')}, {_FOUND}, "
       f"{_BUILT} {_SAME}")
def _(tb):
    b = tb.kept("units").filter("unit_type = 'building'")
    return spatial.same_place(_found(tb), b, "suggestion_id", "unit_id", "match").select(
        F.col("suggestion_id").alias("id"), "match")


@query("detections_rediscovered", f"{duckdb_with('suggestion')}, {_FOUND}, {_QUEUE} {_SAME}")
def _(tb):
    q = shapes.with_shape(_queue(tb)).withColumnRenamed("suggestion_id", "seen_id")
    return spatial.same_place(_found(tb), q, "suggestion_id", "seen_id", "match").select(
        F.col("suggestion_id").alias("id"), "match")


@query("fresh_detections", f"""{duckdb_with('suggestion', 'building')}, {_FOUND},
       m AS (WITH {_BUILT} {_SAME}), s AS (WITH {_QUEUE} {_SAME})
       SELECT CASE WHEN m.id IS NOT NULL THEN 'already_mapped' WHEN s.id IS NOT NULL
       THEN 'rediscovered' ELSE 'fresh' END AS outcome, COUNT(*) AS n
       FROM f LEFT JOIN m USING (id) LEFT JOIN s USING (id) GROUP BY ALL""")
def _(tb):
    return detecting.sort_out(_found(tb), tb.seen(), _queue(tb)).report.select(
        "outcome", "n")


@query("raster_sources_of_suggestions", duckdb_with("suggestion", "raster") + """,
       r AS (SELECT suggestion_id, 'RST-' || CAST(ord % 7 AS STRING) AS r0,
                    'RST-' || CAST(ord % 211 AS STRING) AS r1 FROM suggestion)
       SELECT suggestion_id, CASE WHEN COALESCE(a.source_id, r0) = COALESCE(b.source_id, r1)
         THEN COALESCE(a.source_id, r0)
         ELSE COALESCE(a.source_id, r0) || ',' || COALESCE(b.source_id, r1) END AS source_ids
       FROM r LEFT JOIN raster a ON a.raster_id = r0 LEFT JOIN raster b ON b.raster_id = r1""")
def _(tb):
    reg = tb.view("raster").withColumn("project_id", F.lit(PROJECT))
    return U.sources_of(tb.kept("suggestions"), reg).select("suggestion_id", joined("source_ids"))


@query("first_raster_by_kind", duckdb_with("raster") + """ SELECT upper(kind) AS kind,
       arg_min(raster_id, ord) AS raster_id, arg_min(source_id, ord) AS source_id
       FROM raster GROUP BY upper(kind)""")
def _(tb):
    reg = tb.view("raster").withColumn("project_id", F.lit(PROJECT))
    return raster.first_by_kind(reg).select("kind", "raster_id", "source_id")


# --- geometry functions -------------------------------------------------------------------------

@query("polygon_area_and_box", duckdb_with("sketch") + """ SELECT k, round(CASE form
       WHEN 0 THEN 0e0 WHEN 1 THEN 75e-2*w*h WHEN 2 THEN w*h WHEN 3 THEN 5e-1*w*h
       ELSE 75e-2*w*h END, 6) AS area, form = 2 AS is_rect, x AS x0, y + h AS y1
       FROM sketch""")
def _(tb):
    return shapes.with_shape(tb.kept("sketches")).select(
        "k", F.round("area", 6).alias("area"), "is_rect", "x0", "y1")


@query("repair_invalid_polygons", duckdb_with("sketch") + """ SELECT k, round(CASE form
       WHEN 0 THEN 5e-1*w*h WHEN 1 THEN 75e-2*w*h WHEN 2 THEN w*h WHEN 3 THEN 5e-1*w*h
       ELSE 75e-2*w*h END, 6) AS area FROM sketch""")
def _(tb):
    s = tb.kept("sketches").withColumn("ok", polygons.is_valid(F.col("parts")))
    fixed = s.withColumn("parts", F.coalesce(polygons.repair(F.when(~F.col("ok"),
                                                                    F.col("parts"))), "parts"))
    return fixed.select("k", F.round(shapes.area(F.col("parts")), 6).alias("area"))


@query("polygon_shared_area", duckdb_with("sketch") + """ SELECT k, round(CASE form
       WHEN 1 THEN w*h*5e-1 WHEN 2 THEN w*h*5e-1 WHEN 3 THEN w*h*375e-3
       ELSE w*h*375e-3 END, 6) AS shared FROM sketch WHERE form <> 0""")
def _(tb):
    s = tb.kept("sketches").filter("form <> 0")
    half = shapes.rectangle(F.col("x"), F.col("y"), F.col("x") + F.col("w"),
                            F.col("y") + F.col("h") / 2)
    return s.select("k", F.round(shapes.shared_area(
        shapes.edges(F.col("parts")), shapes.edges(half), F.col("y")), 6).alias("shared"))


@query("layer_convex_hull", duckdb_with("sketch") + """
       SELECT min(x) AS x_min, max(x + w) AS x_max, min(y) AS y_min FROM sketch""")
def _(tb):
    hull = layers.convex_hull(tb.kept("sketches").withColumn("path", F.lit(None).cast(
        "array<struct<x:double,y:double>>")))
    nums = F.transform(F.split(F.regexp_replace("coverage_wkt", "[A-Z() ]*\\(\\(|\\)\\)", ""),
                               ", "), lambda p: F.split(p, " "))
    xs = F.transform(nums, lambda p: p[0].cast("double"))
    return hull.select(F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"),
                       F.array_min(F.transform(nums, lambda p: p[1].cast("double")))
                       .alias("y_min"))


@query("layer_profile", duckdb_with("sketch") + """ SELECT COUNT(*) AS feature_count,
       'EPSG:32643' AS crs, min(x) AS x_min, max(y + h) AS y_max, 'Polygon' AS geometry_types
       FROM sketch""")
def _(tb):
    layer = tb.kept("sketches").select(
        F.lit("Polygon").alias("geometry_type"), F.lit("EPSG:32643").alias("crs_name"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("properties"), "parts",
        F.lit(None).cast("array<struct<x:double,y:double>>").alias("path"))
    return geojson.profile(layer).select(
        "feature_count", "crs", F.col("bbox")[0].alias("x_min"), F.col("bbox")[3]
        .alias("y_max"), joined("geometry_types"))


#: 700 steps of a tenth of a degree: however many events, none lies beyond 75 degrees north
_UTM = {"lon": "72e0 + (event_id % 600) / 100e0",
        "lat": "5e0 + ((event_id // 600) % 700) / 10e0"}


@query("reproject_round_trip", f"""SELECT event_id AS k, round({_UTM['lon']}, 7) AS lon,
       round({_UTM['lat']}, 7) AS lat FROM events""")
def _(tb):
    lon = F.lit(72.0) + F.pmod("event_id", F.lit(600)) / 100.0
    lat = F.lit(5.0) + F.pmod(F.floor(F.col("event_id") / 600), F.lit(700)) / 10.0
    e = tb.table("events").select(F.col("event_id").alias("k"), lon.alias("lon"),
                                  lat.alias("lat"))
    m = e.withColumn("m", S.utm_forward(F.col("lon"), F.col("lat"), F.lit(43)))
    g = m.withColumn("g", S.utm_inverse(F.col("m.x"), F.col("m.y"), F.lit(43)))
    return g.select("k", F.round("g.x", 7).alias("lon"), F.round("g.y", 7).alias("lat"))


# --- surfaces ---------------------------------------------------------------------------------

_ZONAL = duckdb_with("parcel", "cell") + """,
    z AS (SELECT p.unit_id, median(CAST(c.dem AS DOUBLE)) AS g, COUNT(c.dem) AS n,
          (p.x1-p.x0)*(p.y1-p.y0)/25e0 AS want FROM parcel p JOIN cell c
          ON c.x BETWEEN p.x0 AND p.x1 AND c.y BETWEEN p.y0 AND p.y1 GROUP BY ALL)"""


def _parcels_on(tb, raster_id):
    return tb.kept("units").filter("unit_type = 'land_parcel'").withColumn(
        "raster_id", F.lit(raster_id))


@query("zonal_median_and_coverage", _ZONAL + """ SELECT p.unit_id, g AS level,
       COALESCE(n, 0) AS cells, least(1e0, COALESCE(n, 0) / ((p.x1-p.x0)*(p.y1-p.y0)/25e0)) AS coverage
       FROM parcel p LEFT JOIN z USING (unit_id)""")
def _(tb):
    tiles = tb.kept("tiles").filter("raster_id = 'DEM'")
    return raster.zonal(_parcels_on(tb, "DEM"), tiles, "unit_id")


@query("zonal_median_counting", _ZONAL + " SELECT unit_id, g AS q FROM z")
def _(tb):
    tiles = tb.kept("tiles").filter("raster_id = 'DEM'")
    c = raster.cells_in(_parcels_on(tb, "DEM"), tiles, "unit_id").filter("values <> -9999")
    return raster.run_quantiles(raster.value_runs(c, ["unit_id"], "values"), ["unit_id"],
                                F.lit(0.5)).select("unit_id", "q")


@query("ground_parcels", _ZONAL + f""" SELECT p.unit_id, COALESCE(g - 30e0, lower_limit)
       AS lower_limit, COALESCE(g + 150e0, upper_limit) AS upper_limit, {Q.rx('g', 3)}
       AS ground_level_m FROM parcel p LEFT JOIN z USING (unit_id)""")
def _(tb):
    tiles = tb.kept("tiles").filter("raster_id = 'DEM'")
    parcels = U.with_settings(tb.kept("units").filter("unit_type = 'land_parcel'")
                              .withColumn("attributes", U.attributes()), tb.settings())
    return U.ground_parcels(parcels, raster.zonal(_parcels_on(tb, "DEM"), tiles, "unit_id")
                            ).select("unit_id", "lower_limit", "upper_limit",
                                     "attributes.ground_level_m")


_HEIGHTS = duckdb_with("building", "cell") + """,
    b AS (SELECT unit_id, x0, y0, x1, y1 FROM building),
    z AS (SELECT b.unit_id, median(CAST(c.dem AS DOUBLE)) AS g, COUNT(*) AS gn,
          median(CAST(CASE WHEN c.dsm <> -9999 THEN c.dsm END AS DOUBLE)) AS r,
          COUNT(CASE WHEN c.dsm <> -9999 THEN 1 END) AS rn FROM b JOIN cell c
          ON c.x BETWEEN b.x0 AND b.x1 AND c.y BETWEEN b.y0 AND b.y1 GROUP BY ALL),
    h AS (SELECT b.unit_id, g, r, least(1e0, COALESCE(gn,0)/(48e0/25e0),
          COALESCE(rn,0)/(48e0/25e0)) AS cover FROM b LEFT JOIN z USING (unit_id))"""


def _heights(tb):
    b = tb.kept("units").filter("unit_type = 'building'")
    z = {k: raster.zonal(b.withColumn("raster_id", F.lit(k)),
                         tb.kept("tiles").filter(F.col("raster_id") == k), "unit_id")
         for k in ("DEM", "DSM")}
    with_s = U.with_settings(b.select("project_id", "unit_id"), tb.settings())
    return U.derived_heights(with_s, z["DEM"], z["DSM"])


@query("building_heights", _HEIGHTS + f""" SELECT unit_id, {Q.rx('cover', 3)} AS cover,
       CASE WHEN cover >= 6e-1 THEN g + 6e-1 END AS base,
       CASE WHEN cover >= 6e-1 THEN r END AS top FROM h""")
def _(tb):
    return _heights(tb).select("unit_id", S.round_exact(F.col("cover"), 3).alias("cover"),
                               "base", "top")


def _quantile(cells: str, q: str) -> str:
    """Linear interpolation between the two middle ranks of a sorted list."""
    pos = f"((len({cells}) - 1) * {q})"
    low, high = f"CAST(floor({pos}) AS INT)", f"CAST(ceil({pos}) AS INT)"
    return (f"(CASE WHEN {low} = {high} THEN {cells}[{low} + 1] ELSE ({high} - {pos}) * "
            f"{cells}[{low} + 1] + ({pos} - {low}) * {cells}[{high} + 1] END)")


_STATS = """SELECT *, greatest(roof - ground, 0e0) AS h FROM s"""


def _stat_columns() -> str:
    tall = "h >= 25e-1"
    conf = "greatest(4e-1, least(9e-1, 1e0 - spread / h * 5e-1))"
    return f"""{Q.rx('ground', 2)} AS ground_level_m, {Q.rx('roof', 2)} AS roof_level_m,
      {Q.rx('h', 2)} AS height_m, CASE WHEN {tall} THEN CAST(greatest(round_even(h / 3, 0), 1)
      AS INT) END AS floor_count,
      CASE WHEN {tall} THEN round({conf}, 2) ELSE 0e0 END AS confidence"""


@query("detection_statistics", duckdb_with("parcel", "cell") + f""",
       r AS (SELECT p.unit_id, list_sort(list(CAST(dem AS DOUBLE))) AS low,
         list_sort(list(CAST(dsm AS DOUBLE))) AS high,
         stddev_pop(CAST(dsm AS DOUBLE) - CAST(dem AS DOUBLE)) AS spread
         FROM parcel p JOIN cell c ON c.x BETWEEN p.x0 AND p.x1 AND c.y BETWEEN p.y0 AND p.y1
         GROUP BY ALL),
       s AS (SELECT unit_id, spread, {_quantile('low', '5e-1')} AS ground,
         {_quantile('high', '9e-1')} AS roof FROM r),
       t AS ({_STATS}) SELECT unit_id, {_stat_columns()} FROM t""")
def _(tb):
    t = tb.kept("tiles")
    pairs = raster.paired(t.filter("raster_id = 'DEM'"), t.filter("raster_id = 'DSM'"))
    # the detector does not know nodata: such cells stay in and the quantiles absorb them
    cells = raster.cells_in(_parcels_on(tb, "DSM"), pairs, "unit_id",
                            ("dem_values", "dsm_values")).withColumnsRenamed(
        {"dem_values": "dem", "dsm_values": "dsm"})
    real = cells.filter("dem <> -9999")
    return raster.building_statistics(real, "unit_id").select(
        "unit_id", "ground_level_m", "roof_level_m", "height_m", "floor_count",
        F.round("confidence", 2).alias("confidence"))


@query("height_above_ground", duckdb_with("cell") + """ SELECT gx, gy,
       CAST(greatest(CAST(dsm - dem AS FLOAT), 0) AS DOUBLE) AS height FROM cell""")
def _(tb):
    t = tb.kept("tiles")
    high = raster.height_above_ground(raster.paired(t.filter("raster_id = 'DEM'"),
                                                    t.filter("raster_id = 'DSM'")))
    real = high.withColumn("nodata", F.lit(None).cast("float")).withColumn(
        "values", F.zip_with("values", "dem_values", lambda v, g: F.when(g != -9999, v)))
    return raster.cells(real).select(
        F.floor((F.col("x") - 445000.0) / 5).cast("bigint").alias("gx"),
        F.floor((F.col("y") - 1434000.0) / 5).cast("bigint").alias("gy"),
        F.col("value").cast("double").alias("height"))


@query("raster_profile", duckdb_with("cell") + """ SELECT k.kind AS raster_id,
       CAST(CEIL((max(gx)+1)/20e0)*20 AS INT) AS width,
       CAST(CEIL((max(gy)+1)/20e0)*20 AS INT) AS height, 5e0 AS res_x FROM cell,
       (SELECT UNNEST(['DEM','DSM']) AS kind) k GROUP BY k.kind""")
def _(tb):
    return raster.profile(tb.kept("tiles")).select("raster_id", "width", "height", "res_x")


@query("building_outlines")
def _(tb):
    t = tb.kept("tiles")
    high = raster.height_above_ground(raster.paired(t.filter("raster_id = 'DEM'"),
                                                    t.filter("raster_id = 'DSM'")))
    n = tb.TILE
    found = footprints.outlines(high.select("raster_id", "tile_row", "tile_col", "x0", "y0",
                                            "res_x", "res_y", "ncols", "nrows", "values"), n, n)
    return found.select(F.col("component").cast("string").alias("component"),
                        F.round(shapes.area(F.col("parts")), 3).alias("area"))


# --- floors, apartments, suggestions as units ------------------------------------------------

@query("split_floors", duckdb_with("building") + f""",
       b AS (SELECT *, COALESCE(floor_count, 1) + k % 2 AS n FROM building
             WHERE lower_limit IS NOT NULL)
       SELECT unit_id || '/' || CAST(i - k % 2 AS STRING) AS unit_id, CAST(i - k % 2 AS INT)
              AS floor_index, lower_limit + i * ((upper_limit-lower_limit)/n) AS lower_limit,
              lower_limit + i * ((upper_limit-lower_limit)/n) + (upper_limit-lower_limit)/n
              AS upper_limit, {Q.rx('(upper_limit-lower_limit)/n', 3)} AS floor_height_m
       FROM b, LATERAL (SELECT UNNEST(range(n)) AS i)""")
def _(tb):
    b = tb.kept("units").filter("unit_type = 'building'")
    low = F.pmod(F.col("ord"), F.lit(2)).cast("int")
    made = U.split_floors(b, F.coalesce("attributes.floor_count", F.lit(1)), low,
                          unit_id=F.concat_ws("/", "unit_id", (F.col("_i") - F.col("_b"))
                                              .cast("string")))
    return made.select("unit_id", "floor_index", "lower_limit", "upper_limit", "floor_height_m")


@query("implausible_floors", duckdb_with("floor") + """ SELECT unit_id FROM floor
       WHERE NOT (upper_limit - lower_limit BETWEEN 24e-1 AND 5e0)""")
def _(tb):
    floors = U.with_settings(tb.kept("units").filter("unit_type = 'floor'"), tb.settings())
    return U.implausible_floors(floors).select("unit_id")


@query("apartments_from_plan", duckdb_with("floor") + """,
       p AS (SELECT unit_id AS fid, unit_id || '/' || CAST(h AS STRING) AS plan_id,
         x0 - 1 + 4 * h AS px0, y0 + 1 AS py0, x0 + 3 + 4 * h AS px1, y1 + 1 AS py1
         FROM floor, (SELECT UNNEST(range(3)) AS h))
       SELECT plan_id, greatest(x0,px0) AS x0, least(x1,px1) AS x1, round((least(x1,px1)
       -greatest(x0,px0))*(least(y1,py1)-greatest(y0,py0)),6) AS area, lower_limit
       FROM p JOIN floor ON unit_id = fid WHERE greatest(x0,px0) < least(x1,px1)""")
def _(tb):
    f = tb.seen().filter("unit_type = 'floor'")
    h = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    plans = f.select(F.col("unit_id").alias("floor_id"), "x0", "y0", "y1", h.alias("h")).select(
        "floor_id", F.concat_ws("/", "floor_id", F.col("h").cast("string")).alias("plan_id"),
        F.array(F.lit("SRC-1")).alias("source_ids"), F.lit(None).cast("double")
        .alias("confidence"), shapes.rectangle(
            F.col("x0") - 1 + 4 * F.col("h"), F.col("y0") + 1, F.col("x0") + 3 + 4 * F.col("h"),
            F.col("y1") + 1).alias("parts"))
    made = shapes.with_shape(U.apartments(f, shapes.with_shape(plans)))
    return made.select("plan_id", "x0", "x1", F.round("area", 6).alias("area"), "lower_limit")


@query("mark_subdivided_floors", duckdb_with("floor", "apartment") + """ SELECT unit_id,
       CASE WHEN unit_id IN (SELECT floor_id FROM apartment) THEN TRUE ELSE subdivided END
       AS subdivided FROM floor""")
def _(tb):
    f = tb.kept("units").filter("unit_type = 'floor'")
    made = tb.view("apartment").select(F.col("floor_id").alias("parent_id"))
    return U.mark_subdivided(f, made).select("unit_id", "attributes.subdivided")


@query("suggestions_as_units", duckdb_with("suggestion") + """ SELECT suggestion_id,
       CASE WHEN roof_level_m IS NOT NULL THEN ground_level_m + 6e-1 END AS lower_limit,
       CASE WHEN ground_level_m IS NOT NULL THEN roof_level_m END AS upper_limit,
       x0 + edit_shift AS x0, confidence AS confidence_score FROM suggestion
       WHERE review_state IN ('accepted', 'edited')""")
def _(tb):
    s = tb.kept("suggestions").filter("review_state in ('accepted', 'edited')").withColumn(
        "parts", U.chosen_outline())
    for c, t in (("parcel_share", "double"), ("parcel_unresolved", "string"),
                 ("parcel_ulpin", "string")):
        s = s.withColumn(c, F.lit(None).cast(t))
    u = U.suggestion_units(U.with_settings(s, tb.settings()), F.current_timestamp())
    return shapes.with_shape(u).select("attributes.suggestion_id", "lower_limit", "upper_limit",
                                       "x0", "confidence_score")


@query("utility_corridors", duckdb_with("utility") + """ SELECT unit_id, unit_type,
       round((x1-x0)*(y1-y0), 6) AS area, y0 FROM utility""")
def _(tb):
    u = tb.view("utility").select(
        F.lit(PROJECT).alias("project_id"), "unit_id", F.col("unit_id").alias("local_id"),
        F.array(shapes.point(F.col("x0"), F.col("y0") + 1), shapes.point(
            F.col("x1"), F.col("y0") + 1)).alias("path"), F.lit(2.0).alias("corridor_width_m"),
        F.when(F.col("unit_type") == "underground_feature", "Below").otherwise("above")
        .alias("stratum"), "utility_kind", F.lit(1.0).alias("depth_top_m"),
        F.lit(2.0).alias("depth_bottom_m"), F.lit("SRC-1").alias("source_id"))
    made = U.utility_units(U.with_settings(u, tb.settings()), F.current_timestamp())
    return shapes.with_shape(made).select("unit_id", "unit_type",
                                          F.round("area", 6).alias("area"), "y0")


# --- findings, lifecycle -------------------------------------------------------------------------

@query("findings_by_severity", f"""{Q.with_findings()} SELECT severity,
       COUNT(*) AS findings FROM finding GROUP BY severity""")
def _(tb):
    return views.by_severity(tb.kept("findings"))


@query("findings_per_unit", f"""{Q.with_findings()} SELECT named AS unit_id, COUNT(*) AS n
       FROM named GROUP BY named""")
def _(tb):
    return lifecycle.per_unit(tb.kept("findings")).groupBy(
        F.col("named_unit_id").alias("unit_id")).agg(F.count("*").alias("n"))


@query("validation_state_of_units", f"""{Q.with_findings()}, w AS (SELECT named,
       MAX(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 END) AS r FROM named
       GROUP BY named) SELECT unit_id, CASE r WHEN 2 THEN 'failed' WHEN 1
       THEN 'passed_with_warnings' ELSE 'passed' END AS validation_state
       FROM unit LEFT JOIN w ON named = unit_id""")
def _(tb):
    return lifecycle.validation_states(tb.kept("units"), tb.kept("findings")).select(
        "unit_id", "validation_state")


_GUARD = """blocked AS (SELECT named, COUNT(*) AS blocking,
    string_agg(DISTINCT severity || ' ' || rule_id, ',' ORDER BY severity || ' ' || rule_id)
    AS blockers FROM named WHERE severity = 'error' OR (severity = 'warning'
    AND acknowledged_by IS NULL) GROUP BY named)"""


@query("approvable_units", f"""{Q.with_findings()}, {_GUARD} SELECT unit_id,
       blocking IS NULL AS approvable, COALESCE(blocking, 0) AS blocking,
       COALESCE(blockers, '') AS blockers FROM unit LEFT JOIN blocked ON named = unit_id""")
def _(tb):
    return lifecycle.approvable(tb.kept("units"), tb.kept("findings")).select(
        "unit_id", "approvable", "blocking", joined("blockers"))


@query("acknowledge_findings", f"""{Q.with_findings()} SELECT rule_id, CASE WHEN severity = 'error'
       THEN 'refused_error' ELSE 'acknowledged' END AS outcome, COUNT(*) AS n FROM finding
       GROUP BY ALL UNION ALL SELECT NULL, 'not_found', COUNT(*) FROM events""")
def _(tb):
    f = tb.kept("findings")
    # a request names the rule of what it asks for, so findings meet requests once
    asked = f.select("project_id", "finding_id", F.lit(0).cast("bigint").alias("ord"),
                     F.lit("a").alias("actor"), "rule_id").unionByName(
        tb.table("events").select(F.lit(PROJECT).alias("project_id"), F.concat(
            F.lit("none-"), F.col("event_id").cast("string")).alias("finding_id"),
            F.col("event_id").alias("ord"), F.lit("a").alias("actor"),
            F.lit(None).cast("string").alias("rule_id")))
    return (lifecycle.acknowledge(f, asked).groupBy("rule_id", "outcome")
            .agg(F.count("*").alias("n")))


@query("lifecycle_transitions", f"""{Q.with_findings('request').replace('WITH ', 'WITH RECURSIVE ', 1)},
       {_GUARD},
       r AS (SELECT q.*, u.status, b.blocking IS NULL AS ok, ROW_NUMBER() OVER
             (PARTITION BY q.unit_id ORDER BY q.ord) AS rn FROM request q
             LEFT JOIN unit u ON u.unit_id = q.unit_id LEFT JOIN blocked b ON named = q.unit_id),
       walk AS (
         SELECT unit_id, 0::BIGINT AS rn, ANY_VALUE(status) AS after, NULL::BIGINT AS ord,
                NULL::VARCHAR AS outcome FROM r WHERE status IS NOT NULL GROUP BY unit_id
         UNION ALL SELECT w.unit_id, r.rn, CASE WHEN (w.after || '>' || r.target IN
           ('draft>processing','processing>needs_review','processing>draft',
            'needs_review>draft','approved>replaced','approved>closed'))
           OR (w.after || '>' || r.target = 'needs_review>approved' AND r.ok) THEN r.target
           ELSE w.after END, r.ord,
           CASE WHEN w.after || '>' || r.target IN ('draft>processing',
            'processing>needs_review','processing>draft','needs_review>draft',
            'approved>replaced','approved>closed') THEN 'applied'
           WHEN w.after || '>' || r.target = 'needs_review>approved'
           THEN CASE WHEN r.ok THEN 'applied' ELSE 'blocked' END ELSE 'not_allowed' END
         FROM walk w JOIN r ON r.unit_id = w.unit_id AND r.rn = w.rn + 1)
       SELECT unit_id, ord, after, outcome FROM walk WHERE rn > 0
       UNION ALL SELECT unit_id, ord, NULL, 'not_found' FROM r WHERE status IS NULL""")
def _(tb):
    asked = tb.view("request").select(F.lit(PROJECT).alias("project_id"), "unit_id", "ord",
                                      "target")
    guard = lifecycle.approvable(tb.kept("units"), tb.kept("findings")).withColumn(
        "has_run", F.lit(True))
    return lifecycle.transitions(tb.kept("units"), asked, guard).select(
        "unit_id", "ord", "after", "outcome")


@query("review_decisions", duckdb_with("suggestion") + """ SELECT suggestion_id,
       CASE WHEN review_state = 'pending' THEN 'bad_decision' WHEN ord % 13 = 0 THEN 'unsigned'
       WHEN ord % 5 = 0 THEN 'not_found' WHEN ord % 7 = 0 THEN 'already_applied'
       WHEN review_state = 'edited' AND ord % 2 = 0 THEN 'edit_without_geometry'
       ELSE 'applied' END AS outcome FROM suggestion""")
def _(tb):
    s = tb.kept("suggestions")
    stored = s.filter(F.pmod("ord", F.lit(5)) != 0).withColumn(
        "unit_id", F.when(F.pmod("ord", F.lit(7)) == 0, "U"))
    asked = s.select("project_id", "suggestion_id", "ord", F.when(
        F.col("review_state") != "pending", F.col("review_state")).alias("state"),
        F.when(F.pmod("ord", F.lit(13)) != 0, F.coalesce("reviewed_by", F.lit("x")))
        .alias("actor"), F.when(F.pmod("ord", F.lit(2)) == 1, F.col("edited_parts"))
        .alias("edited_parts"))
    return lifecycle.decide(stored, asked).select("suggestion_id", "outcome")


# --- views -----------------------------------------------------------------------------------------

@query("dashboard_counts", f"""{duckdb_with("unit")} SELECT
       {", ".join(f"COUNT(*) FILTER (WHERE unit_type = '{t}') AS {t}" for t in
                  ("land_parcel", "building", "floor", "apartment", "underground_feature",
                   "elevated_structure"))},
       {", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in
                  ("needs_review", "approved", "draft"))}, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE lower_limit IS NULL OR upper_limit IS NULL) AS unknown_height
       FROM unit""")
def _(tb):
    return views.dashboard_units(tb.kept("units"))


@query("dashboard_rollup", duckdb_with("unit") + f""", p AS (SELECT '{PROJECT}' AS project_id, *
       FROM unit) SELECT project_id, unit_type, status, COUNT(*) AS units FROM p
       GROUP BY ROLLUP (project_id, unit_type, status)""")
def _(tb):
    return views.dashboard_rollup(tb.kept("units"))


@query("review_queue", f"""{Q.with_findings()}, c AS (SELECT named,
       COUNT(*) FILTER (WHERE severity = 'error') AS errors,
       COUNT(*) FILTER (WHERE severity = 'warning') AS warnings,
       COUNT(*) FILTER (WHERE severity = 'warning' AND acknowledged_by IS NULL)
       AS unacknowledged FROM named GROUP BY named)
       SELECT unit_id, COALESCE(errors, 0) AS errors, COALESCE(warnings, 0) AS warnings,
       COALESCE(unacknowledged, 0) AS unacknowledged, COALESCE(errors, 0) = 0
       AND COALESCE(unacknowledged, 0) = 0 AS approvable, CASE WHEN floor_index IS NULL THEN '—'
       ELSE 'Floor index ' || CAST(floor_index AS STRING) END AS floor_text
       FROM unit LEFT JOIN c ON named = unit_id WHERE status = 'needs_review'""")
def _(tb):
    none = F.lit(None).cast("string")
    u = tb.seen().withColumn("ulpin", none).withColumn("ulpin_provisional", none)
    return views.review_record(views.review_queue(u, tb.found())).select(
        "unit_id", "errors", "warnings", "unacknowledged", "approvable", "floor_text")


@query("top_alerts", f"""{Q.with_findings()} SELECT rule_id, unit_id FROM finding
       ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
       rule_id || unit_id LIMIT 3""")
def _(tb):
    f = tb.kept("findings").withColumn("ord", F.concat("rule_id", "unit_id"))
    return views.top_alerts(f).select("rule_id", "unit_id")


@query("finding_table_rows", f"""{Q.with_findings()} SELECT rule_id AS category, unit_id AS parcel,
       upper(substr(severity,1,1)) || substr(severity,2) AS severity, acknowledged_by
       FROM finding WHERE severity = 'warning'""")
def _(tb):
    rows = views.finding_rows(tb.kept("findings").filter("severity = 'warning'"))
    return rows.select("category", "parcel", "severity", "acknowledged_by")


@query("layer_bounds", duckdb_with("unit") + """ SELECT unit_type, min(x0) AS x_min,
       min(y0) AS y_min, max(x1) AS x_max, max(y1) AS y_max FROM unit GROUP BY unit_type""")
def _(tb):
    u = tb.kept("units")
    out = None
    for t in ("land_parcel", "building", "floor", "apartment", "underground_feature",
              "elevated_structure"):
        b = views.bounds(u.filter(F.col("unit_type") == t)).withColumn("unit_type", F.lit(t))
        out = b if out is None else out.unionByName(b)
    return out.filter("x_min is not null")


def _rows(tb):
    u = tb.kept("units").withColumn("validation_state", F.lit(None).cast("string"))
    for c in ("dispute_state", "ulpin", "ulpin_provisional"):
        u = u.withColumn(c, F.lit(None).cast("string"))
    u = u.withColumn("attributes", U.attributes(
        subdivided=F.col("attributes.subdivided"), easement=F.col("unit_type").isin(
            "underground_feature", "elevated_structure")))
    return views.display_rows(u, tb.kept("relationships"),
                              views.display_ground(u, tb.settings()))


_UP = duckdb_with("unit") + ", g AS (SELECT min(lower_limit) + 30 AS g FROM unit WHERE " \
    "unit_type = 'land_parcel'), d AS (SELECT unit.*, lower_limit - g AS base_m, " \
    "upper_limit - g AS top_m FROM unit, g)"


@query("display_rows", _UP + """ SELECT unit_id, unit_id AS label, parent_id, base_m, top_m,
       CASE WHEN unit_type = 'land_parcel' OR base_m IS NULL OR top_m IS NULL THEN 0e0
       ELSE base_m END AS drawn_base, CASE WHEN unit_type = 'land_parcel' THEN 2e-1
       WHEN base_m IS NULL OR top_m IS NULL THEN 1e0 ELSE top_m END AS drawn_top FROM d""")
def _(tb):
    low, high = views.display_extent()
    return _rows(tb).select("unit_id", "label", "parent_id", "base_m", "top_m",
                            low.alias("drawn_base"), high.alias("drawn_top"))


@query("height_range", _UP + """ SELECT CAST(floor(least(0e0, min(base_m)) - 1) AS BIGINT)
       AS range_min, CAST(ceil(greatest(10e0, max(top_m)) + 1) AS BIGINT) AS range_max
       FROM d WHERE unit_type <> 'land_parcel'""")
def _(tb):
    return views.height_range(_rows(tb))


@query("floor_marks", _UP + """ SELECT DISTINCT base_m FROM d WHERE unit_type IN
       ('floor','apartment') AND base_m IS NOT NULL""")
def _(tb):
    return views.floor_marks(_rows(tb)).select("base_m")


@query("strata_spans", _UP + """ SELECT unit_id, base_m, top_m FROM d WHERE unit_type NOT IN
       ('land_parcel','building') AND base_m IS NOT NULL AND top_m IS NOT NULL""")
def _(tb):
    return views.strata_spans(_rows(tb))


@query("display_ground_from_levels", """SELECT g AS ground FROM (SELECT g, ROW_NUMBER() OVER
       (ORDER BY g) AS rn, COUNT(*) OVER () AS n FROM (SELECT value AS g FROM events))
       WHERE rn = n // 2 + 1""")
def _(tb):
    u = tb.table("events").select(F.lit(PROJECT).alias("project_id"), F.lit("building").alias(
        "unit_type"), F.lit(1.0).alias("lower_limit"),
        F.struct(F.col("value").alias("ground_level_m")).alias("attributes"))
    return views.display_ground(u, tb.settings()).select("ground")


@query("filter_units", _UP + """ SELECT unit_id FROM d WHERE unit_type IN ('floor','building')
       AND upper(unit_id) LIKE '%LR-1%'""")
def _(tb):
    return _rows(tb).filter(views.unit_filter(types=["floor", "building"],
                                              query=" lr-1 ")).select("unit_id")


@query("filter_scene_slice", _UP + """ SELECT unit_id FROM d WHERE
       unit_type <> 'underground_feature' AND (unit_type = 'land_parcel'
       OR COALESCE(base_m, 0) < 7e0)""")
def _(tb):
    return _rows(tb).filter(views.scene_filter(False, 7.0)).select("unit_id")


_V0 = """CASE unit_type WHEN 'land_parcel' THEN 'parcel' WHEN 'underground_feature'
    THEN 'underground' ELSE unit_type END"""


def _v0(tb):
    kind = (F.when(F.col("unit_type") == "land_parcel", "parcel")
            .when(F.col("unit_type") == "underground_feature", "underground")
            .otherwise(F.col("unit_type")))
    return tb.view("unit").select("unit_id", "ord", kind.alias("unit_type"), "status",
                                  F.col("lower_limit").alias("base_height"),
                                  F.col("upper_limit").alias("top_height"),
                                  F.col("unit_id").alias("ulpin"), F.lit(None).cast("string")
                                  .alias("id"), F.col("parent_id").alias("parentId"))


@query("filter_map_v0", duckdb_with("unit") + f""" SELECT unit_id FROM unit
       WHERE {_V0} IN ('parcel', 'floor', 'underground') AND {_V0} <> 'underground'
       AND status IN ('needs_review')""")
def _(tb):
    return _v0(tb).filter(views.map_filter_v0(["parcel", "floor", "underground"],
                                              ["needs_review"], False)).select("unit_id")


@query("filter_scene_v0", duckdb_with("unit") + f""" SELECT unit_id FROM unit
       WHERE {_V0} <> 'underground' AND COALESCE(lower_limit, 0e0) <= 9155e-1
       AND COALESCE(upper_limit, lower_limit, 0e0) >= 9155e-1""")
def _(tb):
    return _v0(tb).filter(views.scene_filter_v0([], [], 915.5, False)).select("unit_id")


@query("search_v0", duckdb_with("unit") + """ SELECT unit_id FROM unit
       WHERE lower(unit_id) LIKE '%bld-12%' ORDER BY ord LIMIT 8""")
def _(tb):
    return views.search_v0(_v0(tb), "bld-12", 8).select("unit_id")


@query("find_v0", duckdb_with("unit") + " SELECT unit_id FROM unit WHERE unit_id IN "
       "(SELECT 'BLD-' || CAST(event_id AS STRING) FROM events)")
def _(tb):
    wanted = tb.table("events").select(F.concat(F.lit("BLD-"), F.col("event_id").cast("string"))
                                       .alias("key"))
    return views.find_v0(_v0(tb), wanted).select("unit_id")


@query("children_v0", duckdb_with("unit") + """ SELECT parent_id, COUNT(*) AS n FROM unit
       WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def _(tb):
    u = _v0(tb)
    return (u.withColumn("parent_id", views.parent_v0(u.columns)).filter("parent_id is not null")
            .groupBy("parent_id").agg(F.count("*").alias("n")))


@query("search_register", duckdb_with("unit") + """ SELECT unit_id, CASE unit_type
       WHEN 'land_parcel' THEN 'parcel' WHEN 'underground_feature' THEN 'underground'
       WHEN 'elevated_structure' THEN 'elevated' ELSE unit_type END AS type FROM unit
       WHERE (lower(unit_id) LIKE '%par%' OR unit_type IN ('land_parcel','apartment'))
       AND status = 'needs_review'""")
def _(tb):
    none = F.lit(None).cast("string")
    u = tb.kept("units").withColumn("ulpin", none).withColumn("ulpin_provisional", none)
    return views.search_register(u, "PAR", status_is="needs_review").select("unit_id", "type")


@query("first_search_match", duckdb_with("unit") + """ SELECT unit_id FROM unit
       WHERE upper(unit_id) LIKE '%-77%' ORDER BY ord LIMIT 1""")
def _(tb):
    return views.first_match(_rows(tb), query="-77").select("unit_id")


@query("vertical_extent_text", duckdb_with("unit") + """ SELECT unit_id, CASE WHEN
       lower_limit IS NULL OR upper_limit IS NULL THEN 'unknown' ELSE printf('%.1f', lower_limit)
       || ' m → ' || printf('%.1f', upper_limit) || ' m ' || vertical_datum || ' (' ||
       printf('%.1f', upper_limit - lower_limit) || ' m)' END AS extent
       FROM unit WHERE unit_type IN ('building', 'land_parcel')""")
def _(tb):
    u = tb.kept("units").filter("unit_type in ('building', 'land_parcel')")
    return u.select("unit_id", views.extent_text().alias("extent"))


@query("map_features", _UP + """ SELECT unit_id, CASE WHEN unit_type = 'land_parcel' THEN 0
       ELSE 1 END AS rank, base_m IS NULL OR top_m IS NULL AS unknown_height, 5 AS points
       FROM d""")
def _(tb):
    r = _rows(tb).withColumn("ring", views.outer_ring_wgs84(F.col("parts"), F.lit("EPSG:32643")))
    f = views.features(r)
    j = F.col("feature")
    return f.select(
        "unit_id", "rank", F.get_json_object(j, "$.properties.unknown_height").cast("boolean")
        .alias("unknown_height"), F.json_array_length(F.get_json_object(
            j, "$.geometry.coordinates[0]")).alias("points"))


@query("compare_rule_results", f"""{Q.with_findings()} SELECT rule_id, COUNT(*) AS n,
       'missing' AS problem FROM finding WHERE length(unit_id) % 3 = 0 GROUP BY rule_id""")
def _(tb):
    f = tb.kept("findings")
    third = F.pmod(F.length("unit_id"), F.lit(3))
    out = views.compare_findings(f.filter(third != 0), f, f.filter(third == 0).limit(0))
    return out.groupBy("rule_id", "problem").agg(F.count("*").alias("n"))


# --- contracts, register tables, documents -----------------------------------------------------------

@query("unit_contract", duckdb_with("unit") + """, v AS (SELECT unit_id, list_filter([
       CASE WHEN created_by = 'ai' THEN 'ai_has_model' END,
       CASE WHEN status = 'approved' THEN 'approved_has_identifier' END], lambda x: x IS NOT NULL)
       AS v FROM unit) SELECT unit_id, array_to_string(v, ',') AS violations FROM v
       WHERE len(v) > 0""")
def _(tb):
    u = tb.kept("units")
    for c, v in (("validation_state", "unvalidated"), ("dispute_state", "undisputed"),
                 ("representation", "prism"), ("ulpin", None), ("ulpin_version", None),
                 ("model", None)):
        u = u.withColumn(c, F.lit(v).cast("string"))
    out = contracts.broken(u, contracts.unit_clauses())
    return out.filter(F.size("violations") > 0).select("unit_id", joined("violations"))


@query("suggestion_contract", """SELECT event_id AS k, array_to_string(list_filter([
       CASE WHEN value / 300 > 1 THEN 'confidence' END,
       CASE WHEN event_id % 5 = 0 THEN 'kind' END,
       CASE WHEN event_id % 7 = 0 THEN 'no_other_key' END], lambda x: x IS NOT NULL), ',')
       AS violations FROM events""")
def _(tb):
    k = F.col("event_id")
    body = F.concat(
        F.lit('{"suggestion_id":"'), k.cast("string"), F.lit('","kind":"'),
        F.when(F.pmod(k, F.lit(5)) == 0, "roof").otherwise("building_outline"),
        F.lit('","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},'
              '"crs":"EPSG:32643","source_raster_ids":["RST-1"],"confidence":'),
        (F.col("value") / 300).cast("string"),
        F.when(F.pmod(k, F.lit(7)) == 0, ',"extra":1').otherwise(""),
        F.lit(',"model":{"name":"m","version":"1","run_at":"2024-01-01T00:00:00Z"},'
              '"attributes":{"floor_count":2},"review":{"state":"pending"}}'))
    s = parse_suggestions(tb.table("events").select(body.alias("value")), PROJECT)
    return s.select(F.col("suggestion_id").cast("bigint").alias("k"), joined("violations"))


@query("source_contract", duckdb_with("source") + """ SELECT source_id, array_to_string(
       list_filter([CASE WHEN acc_h IS NULL THEN 'horizontal_accuracy_m' END, CASE WHEN
       k % 3 = 0 THEN 'source_type' END, CASE WHEN acc_v IS NULL THEN 'vertical_accuracy_m' END],
       lambda x: x IS NOT NULL), ',') AS violations FROM source""")
def _(tb):
    s = tb.view("source").select(
        "source_id", F.when(F.pmod("k", F.lit(3)) == 0, "tape").otherwise("dem")
        .alias("source_type"), F.col("acc_h").alias("horizontal_accuracy_m"),
        F.col("acc_v").alias("vertical_accuracy_m"))
    return contracts.broken(s, contracts.source_clauses()).select("source_id",
                                                                  joined("violations"))


@query("unknown_source_types", "SELECT DISTINCT c_mktsegment AS source_type FROM customer")
def _(tb):
    s = tb.table("customer").select(F.lower("c_mktsegment").alias("source_type"),
                                    "c_mktsegment").unionByName(
        tb.table("customer").select(F.lit("dem").alias("source_type"), "c_mktsegment"))
    return contracts.unknown_source_types(s).select(F.upper("source_type").alias("source_type"))


@query("register_constraints", duckdb_with("unit", "suggestion") + """
       SELECT 'approved_without_identifier' AS problem, COUNT(*) AS n FROM unit
       WHERE status = 'approved' UNION ALL SELECT 'ulpin_repeated', COUNT(*) FROM (SELECT
       parent_ulpin FROM unit WHERE parent_ulpin IS NOT NULL AND status <> 'approved'
       GROUP BY parent_ulpin HAVING COUNT(*) > 1)""")
def _(tb):
    u = tb.kept("units").select("project_id", "unit_id", "status", F.when(
        F.col("status") != "approved", F.col("attributes.parent_ulpin_14")).alias("ulpin"))
    out = contracts.register_problems(u, tb.kept("relationships"), tb.kept("suggestions"))
    return out.groupBy("problem").agg(F.count("*").alias("n"))


@query("publish_gate", duckdb_with("unit") + """ SELECT COUNT(*) AS units, COUNT(*) FILTER
       (WHERE status <> 'approved') AS unvalidated, CAST(COUNT(*) FILTER (WHERE status <>
       'approved') AS STRING) || ' of ' || CAST(COUNT(*) AS STRING) ||
       ' units are not covered by a validation run' AS refusal FROM unit""")
def _(tb):
    u = tb.kept("units").withColumn("validation_state", F.when(F.col("status") == "approved",
                                                               "passed"))
    return contracts.publish_gate(u, tb.settings(), live=True)


@query("upsert_latest_wins", """SELECT user_id AS unit_id, MAX(event_id) AS batch,
       arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def _(tb):
    e = tb.table("events").select(F.col("user_id").alias("unit_id"), F.col("event_id")
                                  .alias("batch"), "value")
    return register.latest_per_key(e, ["unit_id"], F.col("batch"))


@query("upsert_into_table", duckdb_with("building") + """ SELECT unit_id, CASE WHEN k % 2 = 0
       THEN 'approved' ELSE status END AS status FROM building""")
def _(tb):
    b = tb.view("building").select("unit_id", "k", "status")
    new = b.filter(F.pmod("k", F.lit(2)) == 0).withColumn("status", F.lit("approved"))
    return register.upserted(b, new, ["unit_id"]).select("unit_id", "status")


@query("latest_validation_run", """SELECT 'run-' || CAST(event_id AS STRING) AS run_id FROM events
       ORDER BY ts DESC, event_id DESC LIMIT 1""")
def _(tb):
    runs = tb.table("events").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("ts").alias("started_at"), F.col("event_id").alias("ord"))
    return register.latest_run(runs).select("run_id")


@query("suggestion_listing", duckdb_with("suggestion") + """ SELECT suggestion_id, ROW_NUMBER()
       OVER (ORDER BY run_at DESC, suggestion_id) AS place FROM suggestion
       WHERE review_state = 'accepted'""")
def _(tb):
    return views.suggestion_listing(tb.kept("suggestions"), "accepted").select(
        "suggestion_id", "place")


@query("project_document_units", duckdb_with("unit") + """ SELECT unit_id, lower_limit IS NULL
       AS no_lower, confidence_score IS NOT NULL AS has_confidence, unit_type FROM unit""")
def _(tb):
    docs = documents.unit_documents(tb.kept("units"))
    d = F.col("document")
    keys = F.json_object_keys(d)
    return docs.select("unit_id", (F.array_contains(keys, "lower_limit") & F.get_json_object(
        d, "$.lower_limit").isNull()).alias("no_lower"), F.array_contains(
        keys, "confidence_score").alias("has_confidence"),
        F.get_json_object(d, "$.unit_type").alias("unit_type"))


@query("publish_manifest", duckdb_with("unit") + f""", n AS ({Q.with_findings()} SELECT COUNT(*)
       AS c FROM finding) SELECT 'live · pilot.db' AS source, COUNT(*) AS unit_count,
       (SELECT c FROM n) AS finding_count, 'run run-0001 · ruleset r1' AS label FROM unit""")
def _(tb):
    m = documents.manifest(tb.kept("units"), tb.kept("findings"), "/home/x/pilot.db", "run",
                           "run-0001-testbed", "r1")
    return m.select("source", "unit_count", "finding_count", contracts.validation_label(
        F.col("kind"), F.col("run_id"), F.col("ruleset_version")).alias("label"))


@query("register_lookup", duckdb_with("unit") + """ SELECT unit_id, status, lower_limit FROM unit
       WHERE unit_id IN (SELECT 'BLD-' || CAST(c_custkey AS STRING) FROM customer)""")
def _(tb):
    ids = tb.table("customer").select(F.concat(F.lit("BLD-"), F.col("c_custkey").cast("string"))
                                      .alias("unit_id"))
    return tb.kept("units").join(ids, "unit_id", "left_semi").select("unit_id", "status",
                                                                     "lower_limit")


@query("round_half_even_exact", f"""SELECT event_id AS k, {Q.rx('value', 1)} AS one,
       {Q.rx('value / 7', 2)} AS two, {Q.rx('value / 2000', 4)} AS four FROM events""")
def _(tb):
    v = F.col("value")
    return tb.table("events").select(
        F.col("event_id").alias("k"), S.round_exact(v, 1).alias("one"),
        S.round_exact(v / 7, 2).alias("two"), S.round_exact(v / 2000, 4).alias("four"))


@query("positions_in_hot_group", """SELECT event_id AS k, ROW_NUMBER() OVER (PARTITION BY
       CASE WHEN user_id < 50 THEN -1 ELSE user_id END ORDER BY event_id) - 1 AS at
       FROM events""")
def _(tb):
    e = tb.table("events").select(F.col("event_id").alias("k"), F.when(
        F.col("user_id") < 50, -1).otherwise(F.col("user_id")).alias("g"))
    return ordered.position_in_group(e, ["g"], "k", "at").select("k", "at")


@query("consecutive_in_hot_group", """SELECT * FROM (SELECT event_id AS cur, LAG(event_id) OVER
       (PARTITION BY user_id // 50 ORDER BY floor(value), event_id) AS prev FROM events)
       WHERE prev IS NOT NULL""")
def _(tb):
    e = tb.table("events").select(
        F.floor(F.col("user_id") / 50).alias("g"), F.floor("value").cast("int").alias("i"),
        F.col("event_id").alias("o"))
    n = ordered.neighbours(e, ["g"], "i", "o", ["o"])
    return n.select(F.col("cur.o").alias("cur"), F.col("prev.o").alias("prev"))
