import json

import pytest
from pyspark.sql import functions as F

from strata3d.operators import contracts, lifecycle
from strata3d.operators import units as U
from strata3d.plans import chain, importing, validate
from strata3d.sources import bundle, documents
from strata3d.sources.register import ProjectExists, ProjectIncomplete, Register, settings_row
from strata3d.streaming import requests

from .golden import tables, unit_layout


def square(x, y, s, name, **props):
    ring = [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    return {"type": "Feature", "properties": {**props}, "geometry": {
        "type": "Polygon", "coordinates": [ring]}}


@pytest.fixture()
def project(spark, tmp_path):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32643"}}
    layers = {
        "parcel_map": [square(445000, 1434000, 40, "p", plot="P1",
                              parent_ulpin_14="KA05B012345678"),
                       square(445040, 1434000, 40, "p", plot="P2")],
        "footprint": [square(445005, 1434005, 10, "b", building_local_id="B1", floors_count="2"),
                      square(445035, 1434005, 10, "b", building_local_id="B2"),
                      square(445050, 1434005, 8, "b", building_local_id="B3")]}
    sources = []
    for kind, feats in layers.items():
        path = tmp_path / f"{kind}.geojson"
        path.write_text(json.dumps({"type": "FeatureCollection", "crs": crs,
                                    "features": feats}))
        sources.append({"source_id": f"SRC-{kind}", "source_type": kind, "name": kind,
                        "provider": "t", "path": str(path), "horizontal_accuracy_m": 0.2,
                        "vertical_accuracy_m": 0.2})
    reg = Register(spark, str(tmp_path / "register"))
    importing.create(reg, settings_row(spark, "P"), sources,
                     {"parcel": {"plot": "parcel_local_id",
                                 "parent_ulpin_14": "parent_ulpin_14"},
                      "building_footprint": {"building_local_id": "building_local_id",
                                             "floors_count": "floors_count"}}, batch_id="c1")
    return reg, sources


def test_create_import_validate_and_stream(spark, project, tmp_path):
    reg, sources = project
    report = chain.run(reg, "n1")
    r = report["import"].first()
    assert (r.created, r.reused, r.minted, r.unresolved) == (5, 0, 2, 1)
    again = importing.import_project(reg, "n2").first()
    assert (again.created, again.reused) == (0, 5)          # identity survives a re-import
    validate.run(reg, "n3")
    with pytest.raises(ProjectExists):
        importing.create(reg, settings_row(spark, "P"), sources, batch_id="c2")
    units = {u.attributes.local_id: u for u in reg.read("unit").collect()}
    assert units["B1"].ulpin_provisional.startswith("KA05B012345678-V1-A00-000-")
    assert units["B2"].attributes.parcel_unresolved.startswith("spread over 2")
    assert units["B1"].validation_state == "failed"         # heights are not known yet
    # a request stream: approval is refused while an error stands, parcels pass
    p1, p2 = units["P1"].unit_id, units["P2"].unit_id     # P2 names no parcel of the old register
    folder = tmp_path / "requests"
    folder.mkdir()
    rows = [{"request_id": "1", "ord": 1, "kind": "transition", "project_id": "P",
             "subject": units["B1"].unit_id, "target": "approved", "actor": "a"},
            {"request_id": "2", "ord": 2, "kind": "transition", "project_id": "P",
             "subject": p1, "target": "approved", "actor": "a"},
            {"request_id": "3", "ord": 3, "kind": "transition", "project_id": "P",
             "subject": p1, "target": "closed", "actor": "a"},
            {"request_id": "4", "ord": 4, "kind": "transition", "project_id": "P",
             "subject": p2, "target": "approved", "actor": "a"},
            {"request_id": "5", "ord": 5, "kind": "transition", "project_id": "P",
             "subject": p2, "target": "closed", "actor": "a"}]
    (folder / "1.json").write_text("\n".join(json.dumps(x) for x in rows))
    q = requests.start(reg, str(folder), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    out = {r.ord: r.outcome for r in reg.read("request_outcome").collect()}
    assert out == {1: "blocked", 2: "applied", 3: "applied", 4: "unknown_parcel", 5: "not_allowed"}
    assert reg.read("unit").filter(F.col("unit_id") == p2).first().status == units["P2"].status
    p = reg.read("unit").filter(F.col("unit_id") == p1).first()
    assert p.status == "closed" and p.ulpin.startswith("KA05B012345678-V1-S00-000-")
    assert reg.read("ulpin_ledger").count() == 1


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(ProjectIncomplete, match="unit"):
        Register(spark, str(tmp_path)).project()
    with pytest.raises(U.LayerMissing):
        importing.import_project(Register(spark, str(tmp_path)), "b")


def test_fail_closed_without_a_run(spark):
    units, *_ = tables(spark)
    u = units.select("project_id", "unit_id", "status").limit(1)
    asked = u.select("project_id", "unit_id", F.lit(1).cast("bigint").alias("ord"),
                     F.lit("approved").alias("target"))
    guard = u.select("project_id", "unit_id", F.lit(True).alias("approvable"),
                     F.lit(False).alias("has_run"))
    assert lifecycle.transitions(u, asked, guard).first().outcome == "no_validation_run"


def test_transitions_fold_across_pieces(spark):
    """Requests far apart in `ord` land in different pieces and still chain."""
    u = spark.createDataFrame([("P", "u", "draft")], "project_id string, unit_id string, "
                              "status string")
    steps = ["processing", "approved", "needs_review", "approved", "draft", "closed"]
    asked = spark.createDataFrame([("P", "u", i * 5000, t) for i, t in enumerate(steps)],
                                  "project_id string, unit_id string, ord bigint, target string")
    guard = u.select("project_id", "unit_id", F.lit(True).alias("approvable"),
                     F.lit(True).alias("has_run"))
    got = [r.outcome for r in lifecycle.transitions(u, asked, guard).orderBy("ord").collect()]
    assert got == ["applied", "not_allowed", "applied", "applied", "not_allowed", "applied"]


def test_bad_suggestion_refuses_the_batch(spark):
    good = {"suggestion_id": "s", "kind": "building_outline", "geometry": {
        "type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
        "crs": "EPSG:32643", "source_raster_ids": ["r"], "confidence": 0.5,
        "model": {"name": "m", "version": "1", "run_at": "2024-01-01T00:00:00Z"},
        "review": {"state": "pending"}}
    bad = {**good, "confidence": 1.5, "extra": 1}
    bad.pop("kind")
    raw = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "value string")
    got = [r.violations for r in documents.parse_suggestions(raw, "P").collect()]
    assert got == [[], ["confidence", "has_kind", "kind", "no_other_key"]]
    with pytest.raises(contracts.ContractViolation):
        contracts.refuse_if_broken(documents.parse_suggestions(raw, "P"), "suggestion_id")


def test_document_round_trip(spark, tmp_path):
    units, edges, sources, settings = tables(spark)
    text = {
        "project": settings.drop("project_id").first().asDict(),
        "sources": [r.asDict() for r in sources.select(
            "source_id", "horizontal_accuracy_m", "vertical_accuracy_m").collect()],
        "units": [json.loads(r.document) for r in documents.unit_documents(
            unit_layout(units)).collect()],
        "relationships": [r.asDict() for r in edges.drop("project_id", "ord").collect()]}
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps(text))
    back = bundle.read(spark, str(path), "P")
    assert back["units"].count() == 16 and back["relationships"].count() == edges.count()
    f = back["units"].filter("unit_id = 'FLR-B01'").first()
    assert f.attributes.floor_index == -1 and f.upper_limit == 913.0
    assert back["settings"].first().tolerance_k == 1.0
