"""GeoJSON layers as DataFrames, whole documents or one feature per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygons, shapes
from ..functions import scalars as S
from ..schemas import PARTS

_FEATURE = ("type string, id string, properties map<string,string>, "
            "geometry struct<type:string,coordinates:string>")
_DOCUMENT = ("features array<struct<type:string,id:string,properties:map<string,string>,"
             "geometry:struct<type:string,coordinates:string>>>, "
             "crs struct<type:string,properties:struct<name:string>>")


class CrsMissing(ValueError):
    """A layer states no coordinate system and no default is allowed."""


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """id, properties (map), geometry_type, coordinates (JSON text), crs_name, file.

    `lines` reads newline-delimited features, which Spark can split; a whole document is
    one task per file.
    """
    if lines:
        f = spark.read.schema(_FEATURE).json(path).withColumn("crs_name",
                                                              F.lit(None).cast("string"))
        f = f.withColumn("file", F.input_file_name())
    else:
        doc = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
        f = doc.select(F.inline("features"), F.col("crs.properties.name").alias("crs_name"),
                       F.input_file_name().alias("file"))
    return f.select("id", "properties", F.col("geometry.type").alias("geometry_type"),
                    F.col("geometry.coordinates").alias("coordinates"), "crs_name", "file")


def _ring(r: Column) -> Column:
    return F.transform(r, lambda p: shapes.point(F.element_at(p, 1), F.element_at(p, 2)))


def parse_geometry(df: DataFrame) -> DataFrame:
    """Add `parts` for polygons and `path` for lines."""
    poly = F.from_json("coordinates", "array<array<array<double>>>")
    multi = F.from_json("coordinates", "array<array<array<array<double>>>>")
    line = F.from_json("coordinates", "array<array<double>>")
    parts = (F.when(F.col("geometry_type") == "Polygon", F.array(F.transform(poly, _ring)))
             .when(F.col("geometry_type") == "MultiPolygon", F.transform(
                 multi, lambda p: F.transform(p, _ring))))
    return (df.withColumn("parts", parts.cast(PARTS))
            .withColumn("path", F.when(F.col("geometry_type") == "LineString", _ring(line))))


def epsg(name: Column) -> Column:
    """'urn:ogc:def:crs:EPSG::32643' or 'EPSG:32643' -> 'EPSG:32643'; CRS84 is 4326."""
    code = F.regexp_extract(name, r"EPSG:+(\d+)$", 1)
    return (F.when(name.rlike("CRS84$"), "EPSG:4326")
            .when(code != "", F.concat(F.lit("EPSG:"), code)))


def rename(df: DataFrame, mapping: dict[str, str], source_id: str) -> DataFrame:
    """Properties under their contract names; `source_id` only where the layer has none."""
    known = {**mapping, **{v: v for v in mapping.values()}}
    cols = {}
    for old, new in known.items():
        cols.setdefault(new, []).append(F.element_at("properties", old))
    out = df.select("*", *[F.coalesce(*v).alias(k) for k, v in cols.items()])
    if "source_id" not in out.columns:
        out = out.withColumn("source_id", F.coalesce(F.element_at("properties", "source_id"),
                                                     F.lit(source_id)))
    return out


def harmonise(df: DataFrame, target_crs: str, default_crs: str | None = "EPSG:4326",
              repair: bool = True) -> DataFrame:
    """Geometry in the project's UTM system, broken polygons repaired.

    A layer without a CRS is read as `default_crs`, or refused where that is None. Sources
    already in the target system are not touched; others must be geographic WGS84.
    """
    if default_crs is None:
        missing = df.filter(epsg(F.col("crs_name")).isNull()).limit(1).count()
        if missing:
            raise CrsMissing("the layer states no coordinate system")
    crs = F.coalesce(epsg(F.col("crs_name")), F.lit(default_crs))
    zone = S.utm_zone(F.lit(target_crs))

    def move(p):
        return S.utm_forward(p["x"], p["y"], zone)

    known = F.assert_true(zone.isNotNull() & crs.isin(target_crs, "EPSG:4326"), F.concat(
        F.lit("cannot project "), crs, F.lit(f" to {target_crs}"))).isNull()
    same = crs == target_crs
    out = df.withColumn("parts", F.when(known & same, F.col("parts")).otherwise(F.transform(
        "parts", lambda rings: F.transform(rings, lambda r: F.transform(r, move)))))
    out = out.withColumn("path", F.when(same, F.col("path")).otherwise(
        F.transform("path", move))).withColumn("crs_name", F.lit(target_crs))
    if not repair:
        return out
    # rectangles are valid; other polygons are checked, and only broken ones are rebuilt
    box = shapes.with_shape(out)
    checked = box.withColumn("_ok", polygons.is_valid(F.when(~F.col("is_rect"),
                                                             F.col("parts"))))
    fixed = polygons.repair(F.when(~F.col("_ok"), F.col("parts")))
    return checked.withColumn("parts", F.coalesce(fixed, "parts")).select(*out.columns)


def profile(df: DataFrame) -> DataFrame:
    """One row: feature count, CRS, extent, geometry types, property names, CRS warning."""
    points = F.coalesce(shapes.vertices(F.col("parts")), F.col("path"))
    at = df.select("geometry_type", "crs_name", F.map_keys("properties").alias("k"),
                   F.transform(points, lambda p: p["x"]).alias("xs"),
                   F.transform(points, lambda p: p["y"]).alias("ys"))
    ends = [f(f2(c)) for f, f2, c in ((F.min, F.array_min, "xs"), (F.min, F.array_min, "ys"),
                                      (F.max, F.array_max, "xs"), (F.max, F.array_max, "ys"))]
    return at.agg(
        F.count("*").alias("feature_count"), F.max(epsg(F.col("crs_name"))).alias("crs"),
        F.array(*[F.coalesce(e, F.lit(0.0)) for e in ends]).alias("bbox"),
        F.sort_array(F.collect_set("geometry_type")).alias("geometry_types"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("k")))).alias("columns"),
        F.when(F.max(epsg(F.col("crs_name"))).isNull(), "no coordinate system stated")
        .alias("warning"))


def display_collection(df: DataFrame) -> DataFrame:
    """Older display features: their fixed properties as columns."""
    def prop(name, kind="string"):
        return F.element_at("properties", name).cast(kind).alias(name)

    return parse_geometry(df).select(
        "id", prop("ulpin"), prop("unit_type"), prop("parent_ulpin"),
        prop("base_height", "double"), prop("top_height", "double"), prop("status"),
        prop("owner"), prop("source"), prop("confidence", "double"),
        F.from_json(F.element_at("properties", "findings"),
                    "array<struct<level:string,msg:string>>").alias("findings"), "parts")
