"""A project bundle (one JSON document) as the register's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import complete
from ..schemas import (ATTRIBUTES, RELATIONSHIP, SETTINGS, SETTINGS_DEFAULTS, SOURCE, UNIT,
                       struct)
from .geojson import _ring

_BUNDLE = (
    "project map<string,string>, sources array<map<string,string>>, "
    "units array<struct<unit_id:string,unit_type:string,status:string,representation:string,"
    "validation_state:string,dispute_state:string,crs:string,vertical_datum:string,"
    "footprint_2d:struct<type:string,coordinates:string>,"
    "lower_limit:double,upper_limit:double,source_ids:array<string>,created_by:string,"
    "ulpin:string,ulpin_provisional:string,ulpin_version:string,confidence_score:double,"
    "model:struct<name:string,version:string,run_at:timestamp>,valid_from:date,valid_to:date,"
    "recorded_from:timestamp,recorded_to:timestamp,attributes:string>>, "
    "relationships array<struct<from_unit_id:string,to_unit_id:string,rel_type:string,"
    "created_at:timestamp>>, "
    "findings array<struct<rule_id:string,severity:string,unit_id:string,"
    "related_unit_ids:array<string>,measured_value:double,message:string,note:string>>, "
    "expected_findings array<struct<rule_id:string,severity:string,unit_id:string,"
    "related_unit_ids:array<string>,measured_value:double,message:string,note:string>>, "
    "must_not_fire array<struct<rule_id:string,unit_id:string,note:string>>")


def _parts(geometry: Column) -> Column:
    """Parts of a Polygon or a MultiPolygon, whose coordinates nest one level deeper."""
    one = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    return F.when(geometry["type"] == "MultiPolygon", F.transform(
        many, lambda rings: F.transform(rings, _ring))).otherwise(F.array(F.transform(one, _ring)))


def read(spark: SparkSession, path: str, project_id: str) -> dict[str, DataFrame]:
    """settings, sources, units, relationships, findings and must_not_fire of one bundle."""
    doc = (spark.read.schema(_BUNDLE).option("multiLine", True).json(path)
           .withColumn("project_id", F.lit(project_id)))
    project = F.col("project")
    settings = doc.select("project_id", *[
        F.coalesce(F.element_at(project, f.name).cast(f.dataType),
                   F.lit(SETTINGS_DEFAULTS[f.name]).cast(f.dataType)).alias(f.name)
        for f in struct(SETTINGS).fields if f.name != "project_id"])
    s = doc.select("project_id", F.explode("sources").alias("s"))
    sources = complete(s.select("project_id", *[
        F.element_at("s", f.name).cast(f.dataType).alias(f.name)
        for f in struct(SOURCE).fields if f.name not in ("project_id", "coverage_wkt")]), SOURCE)
    u = doc.select("project_id", F.posexplode("units").alias("ord", "u")).select(
        "project_id", "ord", "u.*")
    known = F.from_json("attributes", ATTRIBUTES)
    every = F.from_json("attributes", "map<string,string>")
    names = [f.name for f in struct(ATTRIBUTES).fields]
    units = u.select(
        "*", _parts(F.col("footprint_2d")).alias("parts")
    ).withColumn("attributes", known.withField("extra", F.map_filter(
        every, lambda k, v: ~k.isin(*names))))
    for column, value in (("representation", "prism"), ("validation_state", "unvalidated"),
                          ("dispute_state", "undisputed")):
        units = units.withColumn(column, F.coalesce(column, F.lit(value)))
    rels = doc.select("project_id", F.posexplode("relationships").alias("ord", "r")).select(
        "project_id", "ord", "r.*")
    found = F.coalesce("findings", "expected_findings")
    return {"settings": settings, "sources": sources, "units": complete(units, UNIT),
            "relationships": complete(rels, RELATIONSHIP),
            "findings": doc.select("project_id", F.inline(found)),
            "must_not_fire": doc.select("project_id", F.inline("must_not_fire"))}
