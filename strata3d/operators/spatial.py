"""Candidate pairs by grid cell, and the spatial joins built on them.

A bounding-box join has no equality, so Spark would run it as a nested loop. Rows are cut
into square cells instead and joined on the cell. Sizes differ by orders of magnitude, so
there are five cell sizes: a row's own size is the smallest that needs at most 64 cells. A
row is registered ("home") at its own size and looked up ("visit") at every coarser size in
use, which keeps the explode bounded for a continent-sized parcel and for a 2 m hut alike. A
pair is emitted only in the cell holding the lower-left corner of the two boxes' overlap, so
no de-duplication shuffle follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons, shapes
from ..functions import scalars as S
from ..schemas import EASEMENT_TYPES, MAJORITY
from ..session import stored

CELL_SIZES = (32.0, 256.0, 2048.0, 16384.0, 131072.0)
MAX_HOME_CELLS = 64
#: Siblings up to which all of a family are compared; larger families are cut into cells.
FAMILY = 64
#: Least height of a bin where candidates are also split vertically.
Z_BIN_M = 8.0
#: Mean heights of a family in one bin: a row is cut into one and a half bins on average.
BIN_HEIGHTS = 2.0


def _span(lo: Column, hi: Column, size) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def own_size(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Smallest cell size that covers the box with at most MAX_HOME_CELLS cells."""
    out = F.lit(CELL_SIZES[-1])
    for size in reversed(CELL_SIZES[:-1]):
        n = ((F.floor(x1 / size) - F.floor(x0 / size) + 1)
             * (F.floor(y1 / size) - F.floor(y0 / size) + 1))
        out = F.when(n <= MAX_HOME_CELLS, F.lit(size)).otherwise(out)
    return out


def cells_at(df: DataFrame, sizes: Column) -> DataFrame:
    """One row per (cell size in `sizes`, cell) the row's box touches: cell, cx, cy."""
    out = df.withColumn("cell", F.explode(sizes))
    out = out.withColumn("cx", F.explode(_span(F.col("x0"), F.col("x1"), F.col("cell"))))
    return out.withColumn("cy", F.explode(_span(F.col("y0"), F.col("y1"), F.col("cell"))))


def candidates(left: DataFrame, right: DataFrame, *, keys: list[Column | str] = (),
               within: Column | None = None, self_join: bool = False,
               split_z: Column | None = None) -> DataFrame:
    """Pairs (struct `a`, struct `b`) whose boxes meet and whose `keys` are null-safe equal.

    Needs x0,y0,x1,y1 on both sides and, for a self join, a total order column `unit_id`;
    then every unordered pair appears once, in no particular order of ends. `split_z` also
    cuts candidates into height bins of so many metres, the same for all rows of a key (rows
    without limits take part in none).
    """
    size = own_size(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    left, right = left.withColumn("_own", size), right.withColumn("_own", size)
    if split_z is not None:
        left, right = left.withColumn("_bin", split_z), right.withColumn("_bin", split_z)
        known = F.col("lower_limit").isNotNull() & F.col("upper_limit").isNotNull()
        left, right = left.filter(known), right.filter(known)

    def sizes_in_use(df):
        # a scalar subquery of at most five values, whatever the data
        return df.agg(F.collect_set("_own")).scalar()

    def rows(df, name, looks, roles):
        """Cells of a side with `role`: 1 pairs left homes with everything on the right, 2
        pairs left visits with right homes. One pass over the side serves both."""
        payload = F.struct(*[F.col(c) for c in df.columns if not c.startswith("_")])
        own = F.col("_own")
        out = df.withColumn("_sizes", looks)
        sizes = F.concat(F.array(own), F.filter("_sizes", lambda s: s > own))
        out = cells_at(out.select("*", payload.alias(name)), sizes)
        out = out.withColumn("role", F.explode(roles(F.col("cell") == own)))
        if split_z is not None:
            out = out.withColumn("cz", F.explode(_span(
                F.least("lower_limit", "upper_limit"),
                F.greatest("lower_limit", "upper_limit"), F.col("_bin"))))
        else:
            out = out.withColumns({"cz": F.lit(0).cast("bigint"), "_bin": F.lit(None).cast("double")})
        return out.select(name, "_own", "cell", "cx", "cy", "cz", "role", "_bin",
                          *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])

    none = F.array().cast("array<double>")
    one, two, both = (F.array(*[F.lit(i) for i in r]) for r in ((1,), (2,), (1, 2)))
    h = rows(left, "a", none if self_join else sizes_in_use(right),
             lambda home: F.when(home, one).otherwise(two)).alias("h")
    v = rows(right, "b", sizes_in_use(left), lambda home: (
        one if self_join else F.when(home, both).otherwise(one))).alias("v")
    on = [F.col(f"h.{c}") == F.col(f"v.{c}") for c in ("cell", "cx", "cy", "cz", "role")]
    on += [F.col(f"h.k{i}").eqNullSafe(F.col(f"v.k{i}")) for i in range(len(keys))]
    if self_join:
        on.append((F.col("h._own") > F.col("v._own"))
                  | (F.col("h.a.unit_id") < F.col("v.b.unit_id")))
    a, b, cell = F.col("h.a"), F.col("v.b"), F.col("h.cell")
    on += [a["x0"] <= b["x1"], b["x0"] <= a["x1"], a["y0"] <= b["y1"], b["y0"] <= a["y1"],
           F.floor(F.greatest(a["x0"], b["x0"]) / cell) == F.col("h.cx"),
           F.floor(F.greatest(a["y0"], b["y0"]) / cell) == F.col("h.cy")]
    if split_z is not None:
        on.append(F.floor(F.greatest(F.least(a["lower_limit"], a["upper_limit"]),
                                     F.least(b["lower_limit"], b["upper_limit"]))
                          / F.col("h._bin")) == F.col("h.cz"))
    out = h.join(v, reduce(lambda p, q: p & q, on)).select("a", "b")
    return out if within is None else out.filter(within)


def attach_to_parcel(footprints: DataFrame, parcels: DataFrame) -> DataFrame:
    """Majority attachment: adds parcel_id, parcel_ulpin, parcel_share, parcel_unresolved.

    `footprints`: project_id, local_id, named_parcel (nullable) and shape columns.
    `parcels`: project_id, parcel_id, parent_ulpin_14 and shape columns. A named parcel is
    taken as given, a wrong name is reported; otherwise the parcel that holds more than
    half of the footprint wins, and at most one can.
    """
    p = shapes.slim(parcels, "project_id", "parcel_id")
    unnamed = shapes.slim(footprints.filter(F.col("named_parcel").isNull()
                                            & (F.col("area") > 0)), "project_id", "local_id")
    pairs = candidates(p, unnamed, keys=["project_id"])
    shares = (pairs.select(F.col("b.project_id").alias("project_id"),
                           F.col("b.local_id").alias("local_id"),
                           F.col("a.parcel_id").alias("parcel_id"),
                           (shapes.common_area("a", "b") / F.col("b.area")).alias("share"))
              .filter("share > 0")
              .groupBy("project_id", "local_id")
              .agg(F.max_by("parcel_id", F.struct("share", "parcel_id")).alias("best"),
                   F.max("share").alias("share"), F.count("*").alias("n")))
    named = parcels.select("project_id", F.col("parcel_id").alias("named_parcel"),
                           F.lit(True).alias("exists"))
    won = F.col("share") > MAJORITY
    out = (footprints.join(shares, ["project_id", "local_id"], "left")
           .join(named, ["project_id", "named_parcel"], "left")
           .withColumn("parcel_id", F.when(F.col("exists"), F.col("named_parcel"))
                       .when(F.col("named_parcel").isNull() & won, F.col("best")))
           .withColumn("parcel_share", F.when(F.col("named_parcel").isNull() & won,
                                              S.round_exact(F.col("share"), 4)))
           .withColumn("parcel_unresolved", F
                       .when(F.col("named_parcel").isNotNull() & F.col("exists").isNull(),
                             F.concat(F.lit("named parcel "), F.col("named_parcel"),
                                      F.lit(" is not in this project")))
                       .when(F.col("parcel_id").isNotNull(), F.lit(None))
                       .when(~(F.col("area") > 0), F.lit("footprint has no area"))
                       .when(F.col("n").isNull(), F.lit("no parcel overlaps"))
                       .otherwise(F.format_string("spread over %d parcels, most (%.3f) in %s",
                                                  "n", "share", "best"))))
    ulpins = parcels.select("project_id", "parcel_id",
                            F.col("parent_ulpin_14").alias("parcel_ulpin"))
    return (out.join(ulpins, ["project_id", "parcel_id"], "left")
            .drop("best", "share", "n", "exists"))


def same_place(found: DataFrame, known: DataFrame, found_id: str, known_id: str,
               out: str) -> DataFrame:
    """found_id -> the first known row (by `ord`) with each more than half in the other."""
    pairs = candidates(shapes.slim(known.filter("area > 0"), "project_id", known_id, "ord"),
                       shapes.slim(found.filter("area > 0"), "project_id", found_id),
                       keys=["project_id"])
    both = (pairs.withColumn("shared", shapes.common_area("a", "b"))
            .filter((F.col("shared") > MAJORITY * F.col("a.area"))
                    & (F.col("shared") > MAJORITY * F.col("b.area"))))
    return (both.groupBy(F.col("b.project_id").alias("project_id"),
                         F.col(f"b.{found_id}").alias(found_id))
            .agg(F.min_by(F.col(f"a.{known_id}"), F.col("a.ord")).alias(out)))


PAIR = ["project_id", "unit_id", "parent_id", "unit_type", "lower_limit", "upper_limit",
         "acc_h", "acc_v", "tolerance_k", "utility_kind"]


def _eroded_meet(tol: Column) -> tuple[Column, Column]:
    """(closed form for rectangle pairs, flag that a sweep is needed)."""
    def c(s, n):
        return F.col(f"{s}.{n}")

    def shrunk(s):
        # a side no longer than twice the tolerance vanishes: keep the shape as it is
        gone = (c(s, "x1") - c(s, "x0") <= 2 * tol) | (c(s, "y1") - c(s, "y0") <= 2 * tol)
        t = F.when(gone | (tol <= 0), 0.0).otherwise(tol)
        return c(s, "x0") + t, c(s, "y0") + t, c(s, "x1") - t, c(s, "y1") - t

    ax0, ay0, ax1, ay1 = shrunk("a")
    bx0, by0, bx1, by1 = shrunk("b")
    flat = (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)
    return flat, ~(c("a", "is_rect") & c("b", "is_rect"))


def conflicts(pairs: DataFrame, *, need_area: bool) -> DataFrame:
    """Pairs sharing height beyond tolerance whose eroded footprints meet.

    Adds tol_h, tol_v, shared (area). Native expressions decide every rectangle pair, which never
    reaches Python; other shapes are swept after the height, box and (for `need_area`) area tests.
    """
    k = F.col("a.tolerance_k")
    out = (pairs
           .withColumn("tol_h", S.pair_tolerance(F.col("a.acc_h"), F.col("b.acc_h"), k))
           .withColumn("tol_v", S.pair_tolerance(F.col("a.acc_v"), F.col("b.acc_v"), k))
           .filter(S.z_overlap(F.col("a.lower_limit"), F.col("a.upper_limit"),
                               F.col("b.lower_limit"), F.col("b.upper_limit"),
                               F.col("tol_v")))
           .withColumn("shared", shapes.common_area("a", "b")))
    if need_area:
        out = out.filter(F.col("shared") > S.negligible_area(F.col("tol_h")))
    flat, odd = _eroded_meet(F.col("tol_h"))
    # written once, pairs part in rectangles, decided by now, and what is swept
    out = stored(out.withColumn("_odd", odd).filter(F.col("_odd") | flat))
    swept = out.filter("_odd").filter(polygons.still_touch(
        shapes.full_parts("a"), shapes.full_parts("b"), F.col("tol_h")))
    return out.filter("NOT _odd").unionByName(swept).drop("_odd")


def sibling_overlaps(units: DataFrame) -> DataFrame:
    """Same type, same parent (two roots are siblings), not easements, real overlap.

    Small families meet on their key alone; only large ones are cut into cells, each of which
    costs a copy of its rows.
    """
    keys = ["project_id", "unit_type", "parent_id"]
    known = F.col("lower_limit").isNotNull() & F.col("upper_limit").isNotNull()
    mine = [c for c in PAIR if c != "utility_kind"]
    own = stored(shapes.slim(units.filter(~F.col("unit_type").isin(*EASEMENT_TYPES) & known),
                             *mine))
    # written, so that Spark knows how few large families there are before rows move; their bins
    # are as high as their members, which tall ones would else be cut into one by one
    tall = F.avg(F.abs(F.col("upper_limit") - F.col("lower_limit"))) * BIN_HEIGHTS
    crowd = stored(own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.greatest(tall, F.lit(Z_BIN_M)).alias("_height"))
        .filter(F.col("n") > FAMILY)
        .select("_height", *[F.col(k).alias(f"_{k}") for k in keys]))
    crowded = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    # a pair carries what it is decided by; its family is the key and moves once
    pair = [c for c in own.columns if c not in ("unit_type", "parent_id", "area")]
    large = own.join(crowd, crowded).select(*pair, *crowd.columns)
    # in structs null equals null; both sides of the join read this one exchange. What a pair needs
    # is asked here: Spark would ask it of one side or the other, and each would move by itself
    family = F.struct(*keys)
    needed = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (
        "unit_id", *shapes.BOX, "lower_limit", "upper_limit", "acc_v", "tolerance_k")])
    small = own.filter(needed).join(crowd, crowded, "left_anti").withColumn(
        "_f", family).repartition("_f")

    def side(name):
        return small.select(F.col("_f").alias(f"_{name}"), F.struct(*pair).alias(name))

    a, b = F.col("a"), F.col("b")
    on = [F.col("_a") == F.col("_b"), a["unit_id"] < b["unit_id"], a["x0"] <= b["x1"], b["x0"] <= a["x1"],
           a["y0"] <= b["y1"], b["y0"] <= a["y1"]]
    pairs = side("a").join(side("b"), reduce(lambda p, q: p & q, on)).select("a", "b")
    return conflicts(pairs.unionByName(candidates(
        large, large, keys=[f"_{k}" for k in keys], self_join=True, split_z=F.col("_height"))), need_area=True)


def utility_targets(units: DataFrame, contains: DataFrame) -> DataFrame:
    """Floors, apartments, and buildings without any floor."""
    floors = units.filter("unit_type = 'floor'").select(
        "project_id", F.col("unit_id").alias("to_unit_id"))
    with_floor = (contains.join(floors, ["project_id", "to_unit_id"], "left_semi")
                  .select("project_id", F.col("from_unit_id").alias("unit_id")))
    bare = (units.filter("unit_type = 'building'")
            .join(with_floor, ["project_id", "unit_id"], "left_anti"))
    return units.filter(F.col("unit_type").isin("floor", "apartment")).unionByName(bare)


def utility_crossings(units: DataFrame, contains: DataFrame) -> DataFrame:
    mine = [c for c in PAIR if c != "parent_id"]
    lines = shapes.slim(units.filter(F.col("unit_type").isin(*EASEMENT_TYPES)), *mine)
    targets = shapes.slim(utility_targets(units, contains), *mine)
    return conflicts(candidates(lines, targets, keys=["project_id"]), need_area=False)
