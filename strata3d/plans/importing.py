"""Layers to units: the import job, and creating a project from its sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import contracts, identity, spatial
from ..operators import units as U
from ..schemas import RASTER, RELATIONSHIP, SEQUENCE, SOURCE, UNIT
from ..session import cut_lineage
from ..sources import geojson, layers
from ..sources.register import ProjectExists, Register


@dataclass
class Imported:
    units: DataFrame
    relationships: DataFrame
    sequences: DataFrame        # rows to add
    report: DataFrame


def _shape(df: DataFrame) -> DataFrame:
    return df if "is_rect" in df.columns else shapes.with_shape(df)


def import_units(parcels: DataFrame, footprints: DataFrame | None, lines: DataFrame | None,
                 settings: DataFrame, known: DataFrame, held: DataFrame) -> Imported:
    """Parcels, footprints and utility lines as units with parents and identifiers.

    Layers carry project_id, their contract columns, geometry and `ord`. `known` is the
    current unit table (for identity), `held` the sequence table.
    """
    now = F.current_timestamp()

    def settled(df, local, unit_type):
        return U.with_settings(df.withColumn("local_id", F.col(local).cast("string")),
                               settings).withColumn("unit_type", F.lit(unit_type))

    p = U.identify(settled(_shape(parcels), "parcel_local_id", "land_parcel"), known)
    p = cut_lineage(U.parcel_units(p, now))            # new ids are drawn once
    out = [p]
    places = p.withColumn("parcel_id", F.col("local_id")).withColumn(
        "parent_ulpin_14", F.col("attributes.parent_ulpin_14"))
    edges = None
    if footprints is not None:
        b = U.optional(_shape(footprints), parcel_local_id="string", floors_count="int")
        b = settled(b, "building_local_id", "building").withColumn(
            "named_parcel", F.col("parcel_local_id").cast("string"))
        b = U.identify(spatial.attach_to_parcel(b, places), known)
        b = cut_lineage(U.building_units(b, now))
        out.append(b)
        parcel_unit = p.select("project_id", F.col("local_id").alias("parcel_id"),
                               F.col("unit_id").alias("from_unit_id"))
        edges = b.join(parcel_unit, ["project_id", "parcel_id"]).select(
            "project_id", "from_unit_id", F.col("unit_id").alias("to_unit_id"), "ord",
            now.alias("created_at"))
    if lines is not None:
        u = U.utility_units(settled(lines, "utility_local_id", "underground_feature"), now)
        out.append(cut_lineage(U.identify(u, known)))
    cols = ["project_id", "unit_id", "ord", "unit_type", "local_id", "reused"]
    asked = p.select(*cols, F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"))
    if footprints is not None:
        asked = asked.unionByName(b.select(*cols, F.col("parcel_ulpin")
                                           .alias("parent_ulpin_14")))
    ids, rows = identity.mint(asked.withColumn("floor_index", F.lit(0)), held,
                              settings.select("project_id", "ulpin_version"))
    named = ids.select("project_id", "unit_id", "ulpin_provisional")
    stacked = U.complete(out[0], UNIT)
    for part in out[1:]:
        stacked = stacked.unionByName(U.complete(part, UNIT))
    version_text = settings.select("project_id", F.col("ulpin_version").alias("_v"))
    stacked = (stacked.drop("ulpin_provisional")
               .join(named, ["project_id", "unit_id"], "left").join(version_text, "project_id")
               .withColumn("ulpin_version", F.when(F.col("ulpin_provisional").isNotNull(),
                                                   F.col("_v"))))
    stacked = U.complete(stacked, UNIT)
    reuse = out[0].select("project_id", "unit_id", "reused")
    for part in out[1:]:
        reuse = reuse.unionByName(part.select("project_id", "unit_id", "reused"))
    flags = stacked.join(reuse, ["project_id", "unit_id"])
    report = flags.groupBy("project_id").agg(
        F.count_if(~F.col("reused")).alias("created"), F.count_if("reused").alias("reused"),
        F.count("ulpin_provisional").alias("minted"),
        F.count("attributes.parcel_unresolved").alias("unresolved"))
    both = None if edges is None else U.complete(U.both_directions(edges), RELATIONSHIP)
    return Imported(stacked, both, rows, report)


def import_project(register: Register, batch_id: str) -> DataFrame:
    """Run the import over the stored layers and write units, edges and sequences."""
    if not register.has("parcel"):
        raise U.LayerMissing("no `parcel` layer has been written")
    spark = register.spark

    def stored(table, ddl=None):
        if register.has(table):
            return register.read(table)
        return None if ddl is None else spark.createDataFrame([], ddl)

    done = import_units(register.read("parcel"), stored("building_footprint"),
                        stored("utility_line"), register.read("project_settings"),
                        stored("unit", UNIT), stored("ulpin_sequence", SEQUENCE))
    # numbers first: a crash then wastes numbers but never gives one out twice
    register.append("ulpin_sequence", done.sequences, batch_id)
    register.upsert("unit", done.units, ["project_id", "unit_id"], batch_id,
                    sort_by=("project_id", "ulpin_provisional"))
    edges = done.relationships if done.relationships is not None else spark.createDataFrame(
        [], RELATIONSHIP)
    register.upsert("unit_relationship", edges,
                    ["project_id", "from_unit_id", "to_unit_id", "rel_type"], batch_id)
    return done.report


#: A source's rows are numbered from its place times 2^52: Spark's row numbers stay below that for
#: half a million partitions.
SOURCE_BITS = 52


class ProjectCreateError(Exception):
    """The sources cannot make a project; says why."""


def create(register: Register, settings: DataFrame, sources: list[dict],
           mappings: dict[str, dict[str, str]] | None = None, *, batch_id: str,
           overwrite: bool = False) -> None:
    """Check every source, then load vectors and register rasters and the rest.

    `sources` are dicts of the source layout plus `path` (and `resolution_m` for rasters).
    Settings with a parapet deduction and paths that cannot be read are refused here, before
    anything is written. Other projects of the register stay as they are; `overwrite` starts this
    one anew, but keeps the numbers it has given out.
    """
    spark = register.spark
    if not sources:
        raise ProjectCreateError("a project needs at least one source")
    first = settings.first()
    held = 0 if overwrite else register.units_held(first.project_id)
    if held:
        raise ProjectExists(f"{held} units of {first.project_id} already stand in {register.base}")
    if first.default_parapet_deduction_m:
        raise U.ParapetDeduction("set default_parapet_deduction_m to 0")
    listed = spark.createDataFrame(
        [{"project_id": first.project_id, "crs": first.project_crs,
          "vertical_datum": first.vertical_datum, "processing_status": "registered",
          **{k: v for k, v in s.items() if k not in ("path", "resolution_m")}}
         for s in sources], SOURCE)
    bad = contracts.broken(listed, contracts.source_clauses())
    contracts.refuse_if_broken(bad, "source_id")
    missing = [s["path"] for s in sources if not _readable(spark, s["path"])]
    if missing:
        raise ProjectCreateError("no such file: " + ", ".join(missing))
    kinds = {s["source_type"] for s in sources}
    if not kinds & set(contracts.X.VECTOR_SOURCES):
        raise ProjectCreateError("no vector source: nothing to build a register on")
    if overwrite:
        for table in ("parcel", "building_footprint", "utility_line", "source", "unit",
                      "unit_relationship", "ai_suggestion", "raster_tile", "finding",
                      "validation_run"):
            register.forget(table, first.project_id, batch_id)
    for k, s in enumerate(sources):
        layer = contracts.X.VECTOR_SOURCES.get(s["source_type"])
        row = listed.filter(F.col("source_id") == s["source_id"])
        if layer is None:
            register.upsert("source", row.withColumn("coverage_wkt", F.lit("")),
                            ["project_id", "source_id"], f"{batch_id}-{s['source_id']}")
            continue
        raw = geojson.parse_geometry(geojson.read(spark, s["path"]))
        named = geojson.rename(raw, (mappings or {}).get(layer, {}), s["source_id"])
        ready = geojson.harmonise(named, first.project_crs)
        ready = ready.withColumn("project_id", F.lit(first.project_id)).withColumn(
            "ord", F.lit(k << SOURCE_BITS) + F.monotonically_increasing_id())
        layers.write_layer(register, layer, ready, row, f"{batch_id}-{s['source_id']}")
    rasters = [{"project_id": first.project_id, "raster_id": f"RST-{s['source_id']}",
                "kind": contracts.X.RASTER_SOURCES[s["source_type"]], "path": s["path"],
                "crs": first.project_crs, "vertical_datum": first.vertical_datum,
                "resolution_m": s.get("resolution_m") or s["horizontal_accuracy_m"],
                "source_id": s["source_id"], "ord": i} for i, s in enumerate(sources)
               if s["source_type"] in contracts.X.RASTER_SOURCES]
    register.replace_project("raster", spark.createDataFrame(rasters, RASTER), first.project_id,
                             batch_id)
    register.replace_project("project_settings", settings, first.project_id, batch_id)


def load_tiles(register: Register, tiles: DataFrame, batch_id: str) -> None:
    """Add elevation tiles of registered rasters: project_id and the tile columns.

    A tile loaded before, under whatever batch, is replaced.
    """
    both = ["project_id", "raster_id"]
    unknown = tiles.select(*both).distinct().join(
        register.read("raster").select(*both), both, "left_anti").limit(5).collect()
    if unknown:
        raise ProjectCreateError("tiles of unregistered rasters: " + ", ".join(
            str(r[0]) for r in unknown))
    register.upsert("raster_tile", tiles.dropDuplicates(), [*both, "tile_row", "tile_col"], batch_id)


def _readable(spark, path: str) -> bool:
    """Whether Spark finds the path, whatever store it lies in."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException:
        return False
    return True

