"""Regions of conflicts between shapes that are no rectangles."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata3d.functions import planar, polygons, shapes
from strata3d.operators import gaps, rules
from strata3d.schemas import PARTS
from strata3d.sources import bundle, documents

from .test_geometry import area_of, packed, star

COLUMNS = ("unit_id string, parent_id string, unit_type string, parts " + PARTS +
           ", lower_limit double, upper_limit double, subdivided boolean")


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


ELL = ring((0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10))


def context(spark, rows, acc=0.0):
    df = spark.createDataFrame(rows, COLUMNS)
    df = df.select("*", F.lit("P").alias("project_id"), F.lit(acc).alias("acc_h"), F.lit(acc).alias("acc_v"),
                   F.lit(1.0).alias("tolerance_k"), F.lit("water").alias("utility_kind"),
                   F.struct("subdivided").alias("attributes"), F.monotonically_increasing_id().alias("ord"))
    units = shapes.with_shape(df)
    contains = df.filter("parent_id IS NOT NULL").select(
        "project_id", F.col("parent_id").alias("from_unit_id"), F.col("unit_id").alias("to_unit_id"),
        F.lit("contains").alias("rel_type"), "ord")
    return rules.Context(units, contains)


def regions(findings):
    out = {}
    for r in findings.collect():
        parts = r["affected_geometry"]
        parts = parts and [[[q.asDict() for q in ring_] for ring_ in part] for part in parts]
        assert parts is None or planar.valid(packed(parts))
        out[r["unit_id"], *r["related_unit_ids"]] = (r["measured_value"], parts)
    return out


def test_overlaps_of_concave_convex_and_flat_pairs(spark):
    flat = lambda i, *parts: (i, "F", "apartment", list(parts), 0.0, 3.0, None)      # noqa: E731
    rows = [flat("L", [ELL]), flat("M", [ring((2, 2), (12, 2), (12, 12), (8, 12), (8, 6), (2, 6))]),
            flat("R", [box(100, 0, 110, 10)]), flat("S", [box(108, 8, 120, 20)]),
            flat("T", [ring((200, 0), (210, 0), (200, 10))]), flat("U", [box(195, -5, 204, 4)]),
            flat("V", [box(300, 0, 310, 10), box(304, 4, 306, 6)]), flat("W", [box(303, 3, 307, 7)])]
    ctx = context(spark, rows)
    got = regions(rules.sibling_overlap(ctx))
    assert set(got) == {("L", "M"), ("R", "S"), ("T", "U"), ("V", "W")}
    for measured, parts in got.values():
        assert area_of(parts) == pytest.approx(measured, abs=.006)
    assert got["V", "W"][0] == 12 and [len(p) for p in got["V", "W"][1]] == [2]
    assert got["R", "S"][1] == [[box(108, 8, 110, 10)]]
    assert rules.geometry_invalid(ctx).count() == 0


def test_convex_clipping_equals_the_sweep(spark):
    rng, rows = random.Random(7), []
    for i in range(150):
        def convex():
            cloud = np.array([(rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(rng.randrange(3, 9))])
            h = [tuple(p) for p in planar.hull(cloud)]
            return [[ring(*(h if rng.random() < .5 else h[::-1]))]]
        rows.append((i, convex(), convex()))
    rows.append((900, [[[{"x": x, "y": y} for x, y in star(rng, 0, 0, 9, 5)]]], rows[0][2]))
    df = spark.createDataFrame(rows, f"i int, a {PARTS}, b {PARTS}")
    got = df.select("i", shapes.is_convex(F.col("a")).alias("convex"), shapes.area(polygons.intersection(
        F.col("a"), F.col("b"))).alias("swept"), F.coalesce(shapes.area(shapes.convex_common(
            F.col("a"), F.col("b"))), F.lit(0.0)).alias("cut")).collect()
    for r in got:
        assert r.convex == (r.i != 900)
        if r.convex:
            assert r.cut == pytest.approx(r.swept, abs=1e-6)


def test_bent_corridors_cross_what_they_share(spark):
    path = [{"x": float(x), "y": float(y)} for x, y in ((-5, 2), (5, 2), (5, 15))]
    (corridor,) = spark.createDataFrame([(path,)], "p array<struct<x:double,y:double>>").select(
        polygons.flat_corridor(F.col("p"), F.lit(2.0))).first()
    rows = [("pipe", None, "underground_feature", corridor, 0.0, 2.0, None),
            ("floor", None, "floor", [[box(0, 0, 10, 10)]], 1.0, 4.0, None),
            ("wall", None, "floor", [[box(6, 0, 9, 9)]], 1.0, 4.0, None)]
    ctx = context(spark, rows)
    got = regions(rules.utility_crossing(ctx))
    measured, parts = got["pipe", "floor"]
    assert len(parts) == 1 and area_of(parts) == pytest.approx(measured, abs=.006) and 25 < measured < 27
    assert got["pipe", "wall"][1] is None or area_of(got["pipe", "wall"][1]) < .01
    assert rules.geometry_invalid(ctx).count() == 0


def test_what_leaves_a_parent(spark):
    two = [[box(0, 0, 5, 10)], [box(5, 0, 10, 10)]]
    rows = [("P", None, "floor", [[box(0, 0, 10, 10)]], 0.0, 3.0, None),
            ("in", "P", "apartment", two, 0.0, 3.0, None),
            ("out", "P", "apartment", [[ring((2, 2), (14, 2), (14, 4), (4, 4), (4, 14), (2, 14))]], 0.0, 3.0, None),
            ("high", "P", "apartment", [[box(1, 1, 2, 2)]], 0.0, 9.0, None)]
    got = regions(rules.escapes_parent(context(spark, rows, acc=.1)))
    assert set(got) == {("out", "P"), ("high", "P")}
    measured, parts = got["out", "P"]
    assert len(parts) == 2 and area_of(parts) == pytest.approx(measured, abs=.006)
    assert got["high", "P"] == (None, None)


@pytest.mark.parametrize("per_tile", [gaps.CHILDREN_PER_TILE, 1])
def test_the_open_region_of_an_l_shaped_floor(spark, monkeypatch, per_tile):
    monkeypatch.setattr(gaps, "CHILDREN_PER_TILE", per_tile)
    rows = [("F", None, "floor", [[ELL]], 0.0, 3.0, True)]
    rows += [(f"k{i}", "F", "apartment", [[box(*b)]], 0.0, 3.0, None) for i, b in enumerate(
        ((0, 0, 4, 2), (4, 0, 10, 2), (0, 5, 4, 10), (0, 2, 2, 5), (8, 2, 10, 4)))]
    (item,) = regions(rules.gap_in_parent(context(spark, rows))).values()
    measured, parts = item
    assert measured == 14 and len(parts) == 1 and area_of(parts) == pytest.approx(14)


def test_documents_carry_every_part_and_the_region(spark):
    found = spark.createDataFrame([("P", "f1", "R", [[ELL], [box(20, 0, 21, 1)]]), ("P", "f2", "R", None)],
                                  f"project_id string, finding_id string, rule_id string, affected_geometry {PARTS}")
    docs = {r["finding_id"]: json.loads(r["document"]) for r in documents.finding_documents(found).collect()}
    assert docs["f1"]["affected_geometry"]["type"] == "MultiPolygon" and docs["f1"]["rule_id"] == "R"
    assert len(docs["f1"]["affected_geometry"]["coordinates"]) == 2 and docs["f2"]["affected_geometry"] is None


def test_bundles_are_read_with_every_part(spark, tmp_path):
    unit = {"unit_id": "u", "unit_type": "floor", "source_ids": [], "attributes": {}}
    coords = lambda *parts: [[[[p["x"], p["y"]] for p in r] for r in part] for part in parts]      # noqa: E731
    two = {"type": "MultiPolygon", "coordinates": coords([ELL], [box(2110633.25, 0.1, 2110634.3, 1)])}
    one = {"type": "Polygon", "coordinates": coords([box(0, 0, 9, 9), box(1, 1, 2, 2)])[0]}
    doc = {"project": {}, "sources": [], "relationships": [], "findings": [], "must_not_fire": [],
           "units": [{**unit, "footprint_2d": two}, {**unit, "unit_id": "v", "footprint_2d": one}]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    units = bundle.read(spark, str(tmp_path / "b.json"), "P")["units"]
    got = {r["unit_id"]: [[[q.asDict() for q in r_] for r_ in part] for part in r["parts"]] for r in units.collect()}
    assert got["u"] == [[ELL], [box(2110633.25, 0.1, 2110634.3, 1)]]
    assert got["v"] == [[box(0, 0, 9, 9), box(1, 1, 2, 2)]]
