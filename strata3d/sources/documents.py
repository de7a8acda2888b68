"""Suggestion documents in, project documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import contracts
from .geojson import _ring

_SUGGESTION = (
    "suggestion_id string, kind string, geometry struct<type:string,"
    "coordinates:array<array<array<double>>>>, crs string, source_raster_ids array<string>, "
    "confidence double, model struct<name:string,version:string,run_at:timestamp>, "
    "attributes struct<floor_count:int,floor_count_method:string,ground_level_m:double,"
    "roof_level_m:double>, review struct<state:string,reviewed_by:string,"
    "reviewed_at:timestamp,edited_geometry:struct<type:string,"
    "coordinates:array<array<array<double>>>>>")


def read_suggestions(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """One suggestion document per line, with the contract clauses its text breaks."""
    raw = spark.read.text(path)
    return parse_suggestions(raw, project_id)


def parse_suggestions(raw: DataFrame, project_id: str) -> DataFrame:
    checked = contracts.broken(raw, contracts.suggestion_document_clauses(F.col("value")))
    d = checked.withColumn("d", F.from_json("value", _SUGGESTION)).select("violations", "d.*")

    def parts(g: str) -> Column:
        return F.when(F.col(g).isNotNull(), F.array(F.transform(f"{g}.coordinates", _ring)))

    return d.select(
        F.lit(project_id).alias("project_id"), "suggestion_id", "kind",
        parts("geometry").alias("parts"), "crs", "source_raster_ids", "confidence", "model",
        "attributes.*", F.col("review.state").alias("review_state"),
        F.col("review.reviewed_by").alias("reviewed_by"),
        F.col("review.reviewed_at").alias("reviewed_at"),
        parts("review.edited_geometry").alias("edited_parts"), "violations")


def suggestion_id(run_id: Column, parts: Column) -> Column:
    """Repeatable id from run and outline, in the shape of a uuid."""
    h = F.sha2(F.concat_ws("|", run_id, shapes.canonical_text(parts)), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4),
                                                                (17, 4), (21, 12))])


def suggestion_documents(s: DataFrame) -> DataFrame:
    """suggestion_id and its JSON document; absent values are left out."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform(
        F.element_at("parts", 1), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
        .alias("coordinates"))
    doc = F.struct(
        "suggestion_id", "kind", geometry.alias("geometry"), "crs", "source_raster_ids",
        "confidence", "model", F.struct("floor_count", "floor_count_method", "ground_level_m",
                                        "roof_level_m").alias("attributes"),
        F.struct(F.coalesce("review_state", F.lit("pending")).alias("state")).alias("review"))
    return s.select("suggestion_id", F.to_json(doc).alias("document"))


def write_suggestions(s: DataFrame, path: str) -> None:
    """One document per line."""
    suggestion_documents(s).select(F.col("document").alias("value")).write.mode(
        "overwrite").text(path)


def _geometry(name: str, parts: str) -> Column:
    """`"name":` and the geometry of all parts: a Polygon, a MultiPolygon, or null."""
    return F.concat(F.lit(f'"{name}":'), F.coalesce(shapes.geojson(F.col(parts)), F.lit("null")))


# --- project document ----------------------------------------------------------------------

def unit_documents(units: DataFrame) -> DataFrame:
    """One JSON object per unit: unknown optionals are left out, limits always written."""
    optional = [c for c in ("ulpin", "ulpin_provisional", "ulpin_version", "confidence_score",
                            "model", "valid_from", "valid_to", "recorded_from", "recorded_to",
                            "attributes") if c in units.columns]
    have = [c for c in ("unit_id", "unit_type", "status", "validation_state", "dispute_state",
                        "representation", "crs", "vertical_datum") if c in units.columns]
    body = F.to_json(F.struct(*have, "source_ids", "created_by", *optional))

    def limit(name):
        return F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(name).cast("string"),
                                                        F.lit("null")))

    text = F.concat(F.lit("{"), limit("lower_limit"), F.lit(","), limit("upper_limit"),
                    F.lit(","), _geometry("footprint_2d", "parts"), F.lit(","),
                    F.substr(body, F.lit(2)))
    return units.select("project_id", "unit_id", "ord", text.alias("document"))


def finding_documents(findings: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(*[c for c in findings.columns if c not in
                                ("project_id", "affected_geometry", "ord")]),
                     {"ignoreNullFields": "false"})
    text = F.concat(F.lit("{"), _geometry("affected_geometry", "affected_geometry"), F.lit(","),
                    F.substr(body, F.lit(2)))
    return findings.select("project_id", "finding_id", text.alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    body = F.to_json(F.struct("from_unit_id", "to_unit_id", "rel_type"))
    return edges.select("project_id", body.alias("document"))


def export(units: DataFrame, edges: DataFrame, findings: DataFrame, settings: DataFrame,
           path: str) -> None:
    """The project document as one folder per section, one JSON object per line.

    A register of millions of units has no business in one string. Findings appear under
    both names consumers read.
    """
    parts = {"units": unit_documents(units), "relationships": edge_documents(edges),
             "findings": finding_documents(findings),
             "expected_findings": finding_documents(findings),
             "project": settings.select("project_id", F.to_json(F.struct(*[
                 c for c in settings.columns if c != "project_id"])).alias("document"))}
    for name, df in parts.items():
        (df.select("project_id", F.col("document").alias("value")).write.mode("overwrite")
         .partitionBy("project_id").text(f"{path}/{name}"))


def manifest(units: DataFrame, findings: DataFrame, source: str, kind: str | None,
             run_id: str | None, ruleset: str | None, live: bool = True) -> DataFrame:
    """One row: when, from what (base name only), how much, and what checked it."""
    name = F.element_at(F.split(F.lit(source), "/"), -1)
    return units.agg(F.count("*").alias("unit_count")).select(
        F.current_timestamp().alias("exported_at"),
        F.concat(F.lit("live · " if live else "fixture · "), name).alias("source"),
        "unit_count", findings.agg(F.count("*")).scalar().alias("finding_count"),
        F.lit(kind).alias("kind"), F.lit(run_id).alias("run_id"),
        F.lit(ruleset).alias("ruleset_version"))
