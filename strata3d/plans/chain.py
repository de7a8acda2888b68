"""The whole register job in order: import, detect, apply, derive, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle, ordered
from ..operators import units as U
from ..schemas import SEQUENCE, SUGGESTION
from ..sources.register import Register
from . import detecting, deriving, importing, validate


def _stored(register: Register, table: str, ddl: str) -> DataFrame:
    if register.has(table):
        return register.read(table)
    return register.spark.createDataFrame([], ddl)


def detect(register: Register, batch_id: str,
           detector: detecting.Detector = detecting.elevation_detector) -> DataFrame | None:
    """Detect on each project's first DEM and DSM and queue what is new."""
    registry = register.read("raster")
    dem, dsm = (U.first_surfaces(registry, k).withColumnRenamed("raster_id", k.lower())
                for k in ("DEM", "DSM"))
    pairs = dem.join(dsm, "project_id").withColumn(
        "pair", F.concat_ws("/", "project_id", "dsm", "dem"))
    if pairs.isEmpty():
        return None                      # nothing to look at is not an error
    tiles = register.read("raster_tile")

    def side(name: str) -> DataFrame:
        ids = pairs.select("project_id", "pair", F.col(name).alias("raster_id"))
        return tiles.join(ids, ["project_id", "raster_id"]).withColumn(
            "raster_id", F.col("pair")).drop("project_id")

    settings = register.read("project_settings").select(
        "project_id", F.col("project_crs").alias("_crs"))
    found = (detector(side("dem"), side("dsm")).withColumnRenamed("raster_id", "pair")
             .join(pairs, "pair").join(settings, "project_id"))
    s = detecting.as_suggestions(
        found, F.col("project_id"), F.col("_crs"), F.concat_ws("/", F.lit(batch_id), "project_id"),
        F.array("dsm", "dem"), F.current_timestamp()).drop("pair", "dsm", "dem", "_crs")
    queue = _stored(register, "ai_suggestion", SUGGESTION)
    sorted_out = detecting.sort_out(s, register.read("unit"), queue)
    # ordinals go on where the project's queue ends, in the order of the ids
    last = queue.groupBy("project_id").agg((F.max("ord") + 1).alias("_from"))
    ready = ordered.place_by_text(sorted_out.fresh.join(settings, "project_id"), ["project_id"],
                                  "suggestion_id", "_at")
    ready = ready.join(last, "project_id", "left").withColumn(
        "ord", F.coalesce("_from", F.lit(0)) + F.col("_at")).drop("_from", "_at")
    register.replace("ai_suggestion", detecting.receive(
        ready, queue, F.col("_crs"), F.current_timestamp()), batch_id)
    return sorted_out.report


def review(register: Register, decisions: DataFrame, batch_id: str) -> DataFrame:
    queue = register.read("ai_suggestion")
    outcomes = lifecycle.decide(queue, decisions)
    register.replace("ai_suggestion", lifecycle.record_decisions(
        queue, outcomes, F.current_timestamp()).select(*queue.columns), batch_id)
    return outcomes


def _store(register: Register, done, batch_id: str) -> None:
    register.append("ulpin_sequence", done.sequences, batch_id)
    register.upsert("unit", done.units, ["project_id", "unit_id"], batch_id)
    register.upsert("unit_relationship", done.relationships,
                    ["project_id", "from_unit_id", "to_unit_id", "rel_type"], batch_id)


def apply_suggestions(register: Register, batch_id: str) -> DataFrame:
    done = detecting.apply_reviewed(
        register.read("ai_suggestion"), register.read("unit"), register.read("raster"),
        register.read("project_settings"), _stored(register, "ulpin_sequence", SEQUENCE))
    _store(register, done, batch_id)
    register.replace("ai_suggestion", done.suggestions, batch_id)
    return done.report


def derive(register: Register, batch_id: str, **options) -> DataFrame:
    done = deriving.derive(
        register.read("unit"), register.read("project_settings"), register.read("raster"),
        register.read("raster_tile"), _stored(register, "ulpin_sequence", SEQUENCE), **options)
    _store(register, done, batch_id)
    return done.report


def run(register: Register, batch_id: str, decisions: DataFrame | None = None,
        **derive_options) -> dict[str, DataFrame | None]:
    """Every step in order; a report per step. Steps without input are passed over."""
    out: dict[str, DataFrame | None] = {}
    out["import"] = importing.import_project(register, f"{batch_id}-import")
    if register.has("raster_tile"):
        out["detect"] = detect(register, f"{batch_id}-detect")
        if decisions is not None:
            out["review"] = review(register, decisions, f"{batch_id}-review")
            out["apply"] = apply_suggestions(register, f"{batch_id}-apply")
        out["derive"] = derive(register, f"{batch_id}-derive", **derive_options)
    validate.run(register, f"{batch_id}-validate")
    found = register.read("finding").filter(F.col("run_id") == f"{batch_id}-validate")
    out["validate"] = found.groupBy("severity").agg(F.count("*").alias("findings"))
    return out
