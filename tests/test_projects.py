"""Several projects in one register, and results that no cap or first project cuts short."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata3d.operators import context, ordered, rules, views
from strata3d.plans import chain, importing
from strata3d.sources.register import ProjectIncomplete, Register, settings_row

from .golden import tables
from .test_jobs import square
from .test_surfaces import tiles as surface

MAPPED = {"parcel": {"plot": "parcel_local_id", "parent_ulpin_14": "parent_ulpin_14"},
          "building_footprint": {"building_local_id": "building_local_id"}}


def sources_of(folder, name, x, n=1):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32643"}}
    kinds = {"parcel_map": [square(x, 1434000, 90, "p", plot="P1", parent_ulpin_14=f"KA05B01234567{n}")],
             "footprint": [square(x + 70, 1434010, 8, "b", building_local_id="B1")]}
    out = []
    for kind, feats in kinds.items():
        path = folder / f"{name}-{kind}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": feats}))
        out.append({"source_id": f"SRC-{kind}", "source_type": kind, "name": kind, "provider": "t",
                    "path": str(path), "horizontal_accuracy_m": 0.2, "vertical_accuracy_m": 0.2})
    for kind in ("dem", "dsm"):
        path = folder / f"{name}-{kind}.bin"
        path.write_text("x")
        out.append({"source_id": f"SRC-{kind}", "source_type": kind, "name": kind, "provider": "t",
                    "path": str(path), "horizontal_accuracy_m": 0.2, "vertical_accuracy_m": 0.2, "resolution_m": 1.0})
    return out


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("two")
    reg = Register(spark, str(folder / "register"))
    for n, (p, x) in enumerate((("A", 445000), ("B", 447000)), 1):
        importing.create(reg, settings_row(spark, p, ulpin_version=f"v{n}"),
                         sources_of(folder, p, x, n), MAPPED, batch_id=f"c{p}")
    return reg, folder


def test_both_projects_are_created_and_kept_apart(two):
    reg, folder = two
    assert {r[0] for r in reg.read("project_settings").select("project_id").collect()} == {"A", "B"}
    assert reg.read("raster").groupBy("project_id").count().count() == 2
    ords = [r[0] for r in reg.read("parcel").select("ord").unionByName(
        reg.read("building_footprint").filter("project_id = 'A'").select("ord")).collect()]
    assert len(reg.read("parcel").collect()) == 2 and len(set(ords)) >= 2


def test_missing_files_are_named_before_anything_is_written(two, spark):
    reg, folder = two
    bad = sources_of(folder, "C", 449000)
    bad[1]["path"] = str(folder / "absent.geojson")
    with pytest.raises(importing.ProjectCreateError, match="absent"):
        importing.create(reg, settings_row(spark, "C"), bad, MAPPED, batch_id="cC")
    assert reg.read("parcel").filter("project_id = 'C'").isEmpty()


def test_import_uses_each_projects_version_and_overwrite_clears_its_own(two, spark):
    reg, folder = two
    importing.import_project(reg, "i1")
    ids = {r.project_id: r.ulpin_provisional for r in reg.read("unit").filter(
        "unit_type = 'land_parcel'").collect()}
    assert "-V1-" in ids["A"] and "-V2-" in ids["B"]
    importing.create(reg, settings_row(spark, "B", ulpin_version="v2"), sources_of(folder, "B2", 447500, 2),
                     MAPPED, batch_id="cB2", overwrite=True)
    assert reg.read("unit").filter("project_id = 'B'").isEmpty()
    assert reg.read("unit").filter("project_id = 'A'").count() == 2
    left = reg.read("parcel").filter("project_id = 'B'").collect()
    assert len(left) == 1
    assert reg.read("parcel").filter("project_id = 'A'").count() == 1


def test_detection_covers_every_project(two, spark):
    reg, _ = two
    ground = np.full((40, 40), 100.0, dtype=np.float32)
    roof = ground.copy()
    roof[8:30, 8:34] = 112.0
    made = None
    for p, shift in (("A", 0), ("B", 2500)):
        for kind, grid in (("dem", ground), ("dsm", roof)):
            t = surface(spark, f"RST-SRC-{kind}", grid).withColumn("project_id", F.lit(p)).withColumn(
                "x0", F.col("x0") + shift)
            made = t if made is None else made.unionByName(t)
    importing.load_tiles(reg, made, "t1")
    once = reg.read("raster_tile").count()
    importing.load_tiles(reg, made.filter("project_id = 'A'"), "t1b")       # a tile is kept once
    assert reg.read("raster_tile").count() == once
    with pytest.raises(importing.ProjectCreateError):
        importing.load_tiles(reg, made.withColumn("raster_id", F.lit("nobody")), "t2")
    report = {(r.project_id, r.outcome): r.n for r in chain.detect(reg, "d1").collect()}
    assert report[("A", "fresh")] == 1 and report[("B", "fresh")] == 1
    queue = reg.read("ai_suggestion").collect()
    assert {q.project_id for q in queue} == {"A", "B"} and len({q.suggestion_id for q in queue}) == 2


def test_ancestors_have_no_depth_limit(spark):
    rows = [("P", f"u{i}", f"u{i + 1}" if i < 30 else None) for i in range(31)] + [("P", "a", "b"), ("P", "b", "a")]
    got = views.ancestors(spark.createDataFrame(rows, "project_id string, unit_id string, parent_id string"))
    assert sorted(r.step for r in got.filter("unit_id = 'u0'").collect()) == list(range(1, 31))
    assert got.filter("unit_id = 'a'").count() == 1


def test_places_follow_the_text_in_every_group(spark):
    rows = [(g, f"{h:05x}", h % 3) for g in "xy" for h in range(0, 9000, 7)]
    df = spark.createDataFrame(rows, "g string, id string, lead int")
    for lead, key in (((), lambda r: r.id), ((F.col("lead"),), lambda r: (r.lead, r.id))):
        for g, part in [(g, [r for r in ordered.place_by_text(df, ["g"], "id", "at", lead).collect() if r.g == g]) for g in "xy"]:
            assert [r.at for r in sorted(part, key=key)] == list(range(len(part))), g


def test_units_without_sources_or_settings_are_reported(spark, tmp_path):
    units, edges, sources, settings = tables(spark)
    lost = units.withColumn("source_ids", F.when(F.col("unit_id") == units.first().unit_id, None).otherwise(
        F.col("source_ids")))
    ctx = context.build(lost, edges, sources, settings)
    assert ctx.count() == units.count()
    found = rules.provenance_missing(rules.Context.of(lost, edges, sources, settings))
    assert units.first().unit_id in {r.unit_id for r in found.collect()}
    reg = Register(spark, str(tmp_path / "r"))
    for name, df in (("unit", units), ("unit_relationship", edges), ("source", sources)):
        reg.replace(name, df, "b")
    reg.replace("project_settings", settings.withColumn("project_id", F.lit("other")), "b")
    with pytest.raises(ProjectIncomplete, match="settings"):
        reg.project()


def test_a_later_batch_may_bring_columns(spark, tmp_path):
    reg = Register(spark, str(tmp_path / "r"))
    reg.append("layer", spark.createDataFrame([(1, "a")], "k int, a string"), "b1")
    reg.append("layer", spark.createDataFrame([(2, 5.0)], "k int, b double"), "b2")
    got = {r.k: (r.a, r.b) for r in reg.read("layer").collect()}
    assert got == {1: ("a", None), 2: (None, 5.0)}
