import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata3d.functions import planar, polygons, shapes
from strata3d.functions import scalars as S


def star(rng, cx, cy, n, r):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + r * d * math.cos(t), cy + r * d * math.sin(t))
           for t, d in ((t, rng.uniform(.3, 1)) for t in turns)]
    return [*pts, pts[0]]


def test_shared_area_matches_the_sweep_on_random_polygons(spark):
    rng = random.Random(5)
    rows = [(i, star(rng, 0, 0, 8, 10), star(rng, rng.uniform(-5, 5), 2, 7, 9))
            for i in range(60)]
    df = spark.createDataFrame(
        [(i, [[[{"x": x, "y": y} for x, y in a]]], [[[{"x": x, "y": y} for x, y in b]]])
         for i, a, b in rows],
        "i int, a array<array<array<struct<x:double,y:double>>>>, "
        "b array<array<array<struct<x:double,y:double>>>>")
    got = df.select("i", shapes.shared_area(shapes.edges(F.col("a")), shapes.edges(F.col("b")),
                                            F.lit(-20.0)).alias("native"),
                    shapes.area(polygons.intersection(F.col("a"), F.col("b"))).alias("parts"))
    for r in got.collect():
        a, b = np.array(rows[r.i][1]), np.array(rows[r.i][2])
        want = planar.sweep([[a], [b]], [])
        assert r.native == pytest.approx(want, abs=1e-9)
        assert r.parts == pytest.approx(want, abs=1e-6)


def test_erosion_and_dilation_closed_forms():
    box = [np.array([(0, 0), (24, 0), (24, 18), (0, 18), (0, 0)], float)]
    assert planar.sweep([box], planar.strips(box, .5, True)) == pytest.approx(391.0)
    wide = [np.array([(-9, -9), (40, -9), (40, 40), (-9, 40), (-9, -9)], float)]
    grown = planar.sweep([wide], planar.strips(box, .5, False))
    assert 49 * 49 - grown == pytest.approx(474.785, abs=0.002)


def test_validity_and_repair(spark):
    def poly(*rings):
        return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]]

    cases = [
        (poly([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), True, 16.0),
        (poly([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]), False, 8.0),
        (poly([(0, 0), (4, 0), (4, 4), (0, 4)]), False, None),
        (poly([(0, 0), (4, 0), (2, 0), (0, 0)]), False, 0.0),
        (poly([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)],
              [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]), True, 77.0),
        (poly([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)],
              [(12, 2), (14, 2), (14, 4), (12, 4), (12, 2)]), False, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)],
                               "i int, p array<array<array<struct<x:double,y:double>>>>")
    got = df.select("i", polygons.is_valid(F.col("p")).alias("ok"),
                    shapes.area(polygons.repair(F.col("p"))).alias("area")).collect()
    for r in got:
        assert r.ok == cases[r.i][1], r.i
        if cases[r.i][2] is not None:
            assert r.area == pytest.approx(cases[r.i][2])


def test_round_exact_matches_python(spark):
    rng = random.Random(3)
    vals = [rng.uniform(-1000, 1000) for _ in range(2000)]
    vals += [k / 8 for k in range(-40, 40)] + [2.675, 1.005, 0.125, 0.375, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (0, 2, 3):
        for r in df.select("v", S.round_exact(F.col("v"), n).alias("r")).collect():
            assert r.r == round(r.v, n), (r.v, n)


def test_utm_of_a_known_point_and_back(spark):
    df = spark.createDataFrame([(72.8776, 19.0761)], "lon double, lat double")
    m = df.select(S.utm_forward(F.col("lon"), F.col("lat"), F.lit(43)).alias("m"))
    p = m.select("m.x", "m.y", S.utm_inverse(F.col("m.x"), F.col("m.y"), F.lit(43))
                 .alias("g")).first()
    assert p.x == pytest.approx(276678.94, abs=.01)      # western edge of the sample building
    top = df.select(S.utm_forward(F.lit(72.8776), F.lit(19.0764), F.lit(43)).alias("m")).first()
    assert top.m.y == pytest.approx(2110633.25, abs=.01)  # and its northern edge
    assert (p.g.x, p.g.y) == (pytest.approx(72.8776, abs=1e-9), pytest.approx(19.0761, abs=1e-9))


def test_corridor_is_flat_ended(spark):
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}], 3.0)],
                               "p array<struct<x:double,y:double>>, w double")
    assert df.select(shapes.area(polygons.flat_corridor(F.col("p"), F.col("w")))).first()[0] == 30


# --- rings from the sweep -----------------------------------------------------------------

def packed(parts):
    out = [float(len(parts))]
    for part in parts:
        out.append(float(len(part)))
        for ring in part:
            out.append(float(len(ring)))
            out += [c for p in ring for c in ((p["x"], p["y"]) if isinstance(p, dict) else p)]
    return out


def area_of(parts):
    return sum(planar._turned(np.array([(q["x"], q["y"]) for q in ring])) for part in parts for ring in part)


def square(x0, y0, x1, y1):
    return [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]


@pytest.mark.parametrize("off", [0.0, 2.1e6])
def test_swept_shapes_are_valid_and_keep_their_area(off):
    rng = random.Random(11)
    for _ in range(80):
        a = [np.array(star(rng, off, off, rng.randrange(3, 14), 10))]
        b = [np.array(star(rng, off + rng.uniform(-5, 5), off + 2, rng.randrange(3, 14), 9))]
        both, only, any_ = (planar.Overlay([a, b], []), planar.Overlay([a], [b]),
                            planar.Overlay([a, b], [], union=True))
        for over in (both, only, any_):
            parts = planar.parts_of(over.rings())
            assert planar.valid(packed(parts))
            assert area_of(parts) == pytest.approx(over.area(), abs=1e-5)
        whole = [planar.sweep([p], []) for p in (a, b)]
        assert both.area() + only.area() == pytest.approx(whole[0], abs=1e-5)
        assert any_.area() + both.area() == pytest.approx(sum(whole), abs=1e-5)


def test_a_clipped_l_is_one_l_and_keeps_given_corners():
    l_shape = [np.array([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10), (0, 0)], float) + 2110633.3]
    (part,) = planar.sweep([l_shape, square(2110635.3, 2110635.3, 2110641.3, 2110641.3)], [], collect=True)
    (ring,) = part
    assert len(ring) == 7 and {(p["x"], p["y"]) for p in ring} >= {(2110637.3, 2110637.3), (2110635.3, 2110635.3)}


def test_holes_go_with_their_shell_and_touching_parts_stay_apart():
    parts = planar.sweep([square(0, 0, 10, 10)], [square(3, 3, 5, 5), square(6, 6, 10, 8)], collect=True)
    assert [len(r) for r in parts[0]] == [9, 5] and len(parts) == 1
    bow = [np.array([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], float)]
    assert [len(p) for p in planar.sweep([bow], [], collect=True)] == [1, 1]
    inner = [np.array([(0, 5), (3, 3), (3, 7), (0, 5)], float)]
    (part,) = planar.sweep([square(0, 0, 10, 10)], [inner], collect=True)
    assert len(part) == 2 and planar.valid(packed([part]))       # a hole that touches its shell


def test_parts_that_touch_erode_as_one():
    two, one = packed([square(0, 0, 1, 2), square(1, 0, 2, 2)]), packed([square(0, 0, 2, 2)])
    assert planar.eroded_parts_outside(two, one, .1) == planar.eroded_parts_outside(one, two, .1) == 0
    assert planar.eroded_touch(two, packed([square(.95, .5, 1.05, .6)]), .01)
    overlapping = packed([square(0, 0, 1.5, 2), square(.5, 0, 2, 2)])
    assert sum(map(planar._turned, planar.dissolved(overlapping))) == pytest.approx(4)


def test_bent_corridors_are_one_valid_shape(spark):
    rng, rows = random.Random(12), []
    for i in range(40):
        turns, at, path = rng.uniform(0, 6), [0.0, 0.0], []
        for _ in range(rng.randrange(2, 7)):
            path.append({"x": at[0], "y": at[1]})
            turns += rng.uniform(-1.2, 1.2)
            at = [at[0] + 9 * math.cos(turns), at[1] + 9 * math.sin(turns)]
        rows.append((i, path))
    df = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>")
    band = df.select("i", "p", polygons.flat_corridor(F.col("p"), F.lit(2.0)).alias("c"))
    for r in band.select("i", "p", F.size("c").alias("parts"), polygons.is_valid(F.col("c")).alias("ok"),
                         shapes.area(F.col("c")).alias("area")).collect():
        assert r.ok and r.parts == 1
        assert 0 < r.area <= 18 * (len(r.p) - 1) + 4


def test_two_thousand_corners_take_under_a_second():
    import time
    m = np.linspace(0, 2 * math.pi, 2000, endpoint=False)
    r = 1000 * (1 + .1 * np.sin(9 * m))
    ring = np.column_stack([r * np.cos(m), r * np.sin(m)])
    a = [np.vstack([ring, ring[:1]])]
    b = [a[0] + np.array([60.0, 35.0])]
    at = time.time()
    parts = planar.sweep([a, b], [], collect=True)
    assert planar.valid(packed(parts)) and planar.valid(packed([a]))
    assert planar.eroded_parts_outside(packed([a]), packed([b]), .5) > 0
    assert time.time() - at < 1


def test_validity_of_rings_that_meet():
    shell = square(0, 0, 10, 10)[0]
    assert planar.valid(packed([[shell], square(10, 10, 12, 12)]))           # corners touch
    assert not planar.valid(packed([[shell], square(10, 0, 12, 10)]))        # a common side
    assert not planar.valid(packed([[shell], square(5, 5, 12, 12)]))
    assert not planar.valid(packed([[shell, square(0, 2, 4, 4)[0]]]))
