"""Planar polygons as columns: parts -> rings -> points, in metres.

A polygon is `parts array<array<array<struct<x,y>>>>`: each part is a shell followed by its
holes, rings closed. Everything here is a built-in expression; what needs a sweep over many
polygons (erosion, union, clipping to geometry) lives in `polygons`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGES


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise rectangle as a one-part polygon."""
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1),
                                   point(x0, y1), point(x0, y0))))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def _finite(v: Column) -> Column:
    return ~(F.isnan(v) | (F.abs(v) == float("inf")))


def bbox(parts: Column) -> Column:
    """struct<x0,y0,x1,y1> over finite coordinates; fields NULL on an empty polygon."""
    def ends(v):
        return F.struct(F.array_min(v["xs"]).alias("x0"), F.array_min(v["ys"]).alias("y0"),
                        F.array_max(v["xs"]).alias("x1"), F.array_max(v["ys"]).alias("y1"))

    def axes(points):
        return let(F.struct(
            F.filter(F.transform(points, lambda p: p["x"]), _finite).alias("xs"),
            F.filter(F.transform(points, lambda p: p["y"]), _finite).alias("ys")), ends)

    return let(vertices(parts), axes)


def ring_area(ring: Column) -> Column:
    """Signed area, counter-clockwise positive, summed about the first point."""
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    o = F.element_at(ring, 1)

    def term(acc, i):
        p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
        return acc + ((p["x"] - o["x"]) * (q["y"] - o["y"])
                      - (q["x"] - o["x"]) * (p["y"] - o["y"]))

    return F.when(F.size(ring) > 2, F.aggregate(steps, F.lit(0.0), term) / 2).otherwise(0.0)


def area(parts: Column) -> Column:
    """Shells minus holes, over all parts."""
    def part_area(rings):
        rest = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        holes = F.aggregate(rest, F.lit(0.0), lambda a, r: a + F.abs(ring_area(r)))
        return F.abs(ring_area(F.element_at(rings, 1))) - holes

    return F.aggregate(parts, F.lit(0.0), lambda a, p: a + part_area(p))


def is_rectangle(parts: Column, box: Column) -> Column:
    """One axis-parallel four-cornered ring filling its bounding box."""
    ring = F.element_at(F.element_at(parts, 1), 1)
    one = (F.size(parts) == 1) & (F.size(F.element_at(parts, 1)) == 1)
    corners = F.forall(ring, lambda p: ((p["x"] == box["x0"]) | (p["x"] == box["x1"]))
                       & ((p["y"] == box["y0"]) | (p["y"] == box["y1"])))
    full = F.abs(ring_area(ring)) == (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.coalesce(one & (F.size(ring) == 5) & closed & corners & full
                      & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), F.lit(False))


def edges(parts: Column) -> Column:
    """Signed edges: the region is the sum of `s` over edges lying above a point."""
    def ring_edges(ring, sign):
        turn = F.signum(ring_area(ring)) * sign
        steps = F.sequence(F.lit(1), F.size(ring) - 1)

        def edge(i):
            p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
            right = p["x"] < q["x"]
            a, b = F.when(right, p).otherwise(q), F.when(right, q).otherwise(p)
            return F.struct(a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"),
                            b["y"].alias("yb"), F.when(right, -turn).otherwise(turn).alias("s"))

        return F.filter(F.transform(steps, edge), lambda e: e["xa"] < e["xb"])

    def part_edges(rings):
        return F.flatten(F.transform(
            rings, lambda r, i: ring_edges(r, F.when(i == 0, 1.0).otherwise(-1.0))))

    return F.flatten(F.transform(parts, part_edges)).cast(EDGES)


def shared_area(a: Column, b: Column, floor_y: Column) -> Column:
    """Area common to two polygons given as signed edges.

    The two regions are signed sums of strips below their edges, so the common area is the
    signed sum over edge pairs of the integral of the lower edge; closed form, any shape.
    `floor_y` is any level near the polygons; it cancels and only keeps digits.
    """
    def pair(e, f):
        lo, hi = F.greatest(e["xa"], f["xa"]), F.least(e["xb"], f["xb"])

        def at(g, x):
            return (g["ya"] - floor_y
                    + (x - g["xa"]) / (g["xb"] - g["xa"]) * (g["yb"] - g["ya"]))

        e0, e1, f0, f1 = at(e, lo), at(e, hi), at(f, lo), at(f, hi)
        d0, d1 = e0 - f0, e1 - f1
        spread = F.when(d0 * d1 >= 0, F.abs(d0) + F.abs(d1)).otherwise(
            (d0 * d0 + d1 * d1) / (F.abs(d0) + F.abs(d1)))
        low = (e0 + e1 + f0 + f1 - spread) / 4
        return F.when(lo < hi, e["s"] * f["s"] * (hi - lo) * low).otherwise(0.0)

    total = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + F.aggregate(
        b, F.lit(0.0), lambda acc2, f: acc2 + pair(e, f)))
    return F.greatest(total, F.lit(0.0))


#: Corners up to which a ring is tested and clipped natively; both routes give the same region.
NATIVE_CORNERS = 32
_RING = "array<struct<x:double,y:double>>"


def _beside(p: Column, q: Column, r: Column) -> Column:
    """Twice the area of p, q, r: positive if r lies left of the line from p to q."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def is_convex(parts: Column) -> Column:
    """One closed ring without a hole, no corner of which lies outside any of its edges."""
    ring = F.element_at(F.element_at(parts, 1), 1)
    one = ((F.size(parts) == 1) & (F.size(F.element_at(parts, 1)) == 1)
           & F.size(ring).between(4, NATIVE_CORNERS + 1))
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    turn = F.signum(ring_area(ring))
    all_left = F.forall(steps, lambda i: F.forall(ring, lambda r: turn * _beside(
        F.element_at(ring, i), F.element_at(ring, i + 1), r) >= 0))
    return F.coalesce(F.when(one, (F.element_at(ring, 1) == F.element_at(ring, -1))
                             & (turn != 0) & all_left), F.lit(False))


def convex_common(a: Column, b: Column) -> Column:
    """Region common to two convex polygons: `a` cut by one edge of `b` after the other.

    NULL where they share no area.
    """
    def points(parts):
        ring = F.element_at(F.element_at(parts, 1), 1)
        left = F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)
        return F.slice(left, 1, F.size(left) - 1).cast(_RING)

    def cut(ring, edge):
        p, q = edge["p"], edge["q"]

        def meeting(u, v):
            su, sv = _beside(p, q, u), _beside(p, q, v)
            t = su / (su - sv)
            return point(u["x"] + t * (v["x"] - u["x"]), u["y"] + t * (v["y"] - u["y"]))

        def step(v, i):
            u = F.element_at(ring, F.when(i == 0, -1).otherwise(i).cast("int"))
            inside, before = _beside(p, q, v) >= 0, _beside(p, q, u) >= 0
            return F.when(inside & before, F.array(v)).when(
                inside, F.array(meeting(u, v), v)).when(
                before, F.array(meeting(u, v))).otherwise(F.array().cast(_RING)).cast(_RING)

        return F.when(F.size(ring) == 0, ring).otherwise(
            F.flatten(F.transform(ring, step))).cast(_RING)

    def edges_of(pts):
        return F.transform(pts, lambda p, i: F.struct(p.alias("p"), F.element_at(
            pts, F.when(i + 1 == F.size(pts), 1).otherwise(i + 2).cast("int")).alias("q")))

    def closed(pts):
        ring = F.concat(pts, F.slice(pts, 1, 1))
        return F.when(ring_area(ring) > 0, F.array(F.array(ring)))

    clipped = F.aggregate(edges_of(points(b)), points(a), cut)
    return let(F.array_distinct(clipped), closed)


def covers_point(a: Column, x: Column, y: Column) -> Column:
    """Point in polygon from signed edges (half-open in x, so shared edges count once)."""
    above = F.filter(a, lambda e: (e["xa"] <= x) & (x < e["xb"]) & (
        e["ya"] + (x - e["xa"]) / (e["xb"] - e["xa"]) * (e["yb"] - e["ya"]) > y))
    return F.aggregate(above, F.lit(0.0), lambda acc, e: acc + e["s"]) > 0.5


def packed(parts: Column) -> Column:
    """Flat array<double>: part count, then per part its ring count, per ring its point
    count and coordinates. One level of nesting is what Arrow moves fastest."""
    def counted(items, each):
        return F.concat(F.array(F.size(items).cast("double")),
                        F.flatten(F.transform(items, each)))

    def ring(r):
        return counted(r, lambda p: F.array(p["x"], p["y"]))

    return counted(parts, lambda rings: counted(rings, ring))


def canonical_text(parts: Column) -> Column:
    """Same text for the same polygon whatever its start point, direction or part order."""
    def ring_text(ring):
        turned = F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)
        pts = F.slice(turned, 1, F.greatest(F.size(turned) - 1, F.lit(0)))
        at = F.array_position(pts, F.array_min(pts)).cast("int")
        tail = F.slice(pts, at, F.size(pts) - at + 1)
        head = F.slice(pts, 1, F.greatest(at - 1, F.lit(0)))
        return F.array_join(F.transform(F.concat(tail, head), lambda p: F.concat_ws(
            " ", p["x"].cast("string"), p["y"].cast("string"))), ",")

    def part_text(rings):
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
        return F.concat_ws("|", ring_text(F.element_at(rings, 1)), F.array_join(
            F.array_sort(F.transform(holes, ring_text)), "|"))

    return F.array_join(F.array_sort(F.transform(parts, part_text)), ";")


def wkt(parts: Column) -> Column:
    def ring_text(ring):
        return F.concat(F.lit("("), F.array_join(F.transform(ring, lambda p: F.concat_ws(
            " ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))

    def part_text(rings):
        return F.concat(F.lit("("), F.array_join(F.transform(rings, ring_text), ", "),
                        F.lit(")"))

    return (F.when(F.size(parts) == 0, "POLYGON EMPTY")
            .when(F.size(parts) == 1, F.concat(F.lit("POLYGON "),
                                               part_text(F.element_at(parts, 1))))
            .otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(
                F.transform(parts, part_text), ", "), F.lit(")"))))


def geojson(parts: Column) -> Column:
    """GeoJSON geometry text; a one-part polygon is a Polygon, more a MultiPolygon."""
    def coords(rings):
        return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))

    one = F.to_json(F.struct(F.lit("Polygon").alias("type"),
                             coords(F.element_at(parts, 1)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"),
                              F.transform(parts, coords).alias("coordinates")))
    return F.when(F.size(parts) == 1, one).when(F.size(parts) > 1, many)


def _plain(parts: Column) -> Column:
    """The shape struct of a closed ring of four corners along the axes, without a lambda; NULL for
    other polygons. Of a polygon made in the same query only the corners are left to compute."""
    ring = F.get(F.get(parts, F.lit(0)), F.lit(0))
    a, b, c, d, e = (F.get(ring, F.lit(i)) for i in range(5))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((p["x"], p["y"]) for p in (a, b, c, d))
    one = ((F.size(parts) == 1) & (F.size(F.get(parts, F.lit(0))) == 1) & (F.size(ring) == 5)
           & (e["x"] == ax) & (e["y"] == ay))
    turns = (((ay == by) & (bx == cx) & (cy == dy) & (dx == ax))
             | ((ax == bx) & (by == cy) & (cx == dx) & (dy == ay)))
    inf = float("inf")
    real = ((F.abs(ax) < inf) & (F.abs(ay) < inf) & (F.abs(cx) < inf) & (F.abs(cy) < inf)
            & (ax != cx) & (ay != cy))
    x0, y0, x1, y1 = F.least(ax, cx), F.least(ay, cy), F.greatest(ax, cx), F.greatest(ay, cy)
    return F.when(one & turns & real, F.struct(
        *[v.alias(n) for n, v in zip(BOX, (x0, y0, x1, y1))], F.lit(True).alias("is_rect"),
        ((x1 - x0) * (y1 - y0)).alias("area")))


def with_shape(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add what spatial operators need: bbox x0..y1, `is_rect`, `area`."""
    def with_area(s, p):
        flat = (s["x1"] - s["x0"]) * (s["y1"] - s["y0"])
        return F.struct(*[s[c].alias(c) for c in BOX], s["is_rect"].alias("is_rect"),
                        F.when(s["is_rect"], flat).otherwise(area(p)).alias("area"))

    def with_form(b, p):
        return let(F.struct(*[b[c].alias(c) for c in BOX],
                            is_rectangle(p, b).alias("is_rect")), lambda s: with_area(s, p))

    # a filter on `area` is pushed to where `parts` is made and repeats this; there as here the
    # polygon is bound once, not made anew for every use
    any_form = let(F.col(parts), lambda p: let(bbox(p), lambda b: with_form(b, p)))
    return df.withColumn("_s", F.coalesce(_plain(F.col(parts)), any_form)).select(
        "*", "_s.*").drop("_s")


BOX = ("x0", "y0", "x1", "y1")


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """`columns` plus the shape, leaving `parts` NULL where the box already says it all."""
    return df.select(*columns, *BOX, "is_rect", "area",
                     F.when(~F.col("is_rect"), F.col("parts")).alias("parts"))


def full_parts(side: str) -> Column:
    """Polygon of a slimmed row under alias `side`."""
    return F.coalesce(F.col(f"{side}.parts"),
                      rectangle(*[F.col(f"{side}.{n}") for n in BOX]))


def rectangle_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def level(y, s):
        return F.struct(x0.alias("xa"), y.alias("ya"), x1.alias("xb"), y.alias("yb"),
                        F.lit(s).alias("s"))

    return F.array(level(y0, -1.0), level(y1, 1.0))


def common_area(a: str, b: str) -> Column:
    """Area shared by two shaped rows under aliases `a` and `b`."""
    def c(side, name):
        return F.col(f"{side}.{name}")

    w = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    h = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    flat = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    def signed(side):
        return F.when(c(side, "is_rect"), rectangle_edges(*[c(side, n) for n in BOX])
                      ).otherwise(edges(c(side, "parts")))

    return F.when(c(a, "is_rect") & c(b, "is_rect"), flat).when(
        (w <= 0) | (h <= 0), 0.0).otherwise(
        shared_area(signed(a), signed(b), F.greatest(c(a, "y0"), c(b, "y0"))))
