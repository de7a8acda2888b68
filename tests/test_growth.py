"""What must not move or gather as tables grow."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

from strata3d.functions import shapes
from strata3d.operators import footprints, gaps, ordered, rules, spatial, units, views
from strata3d.plans import detecting
from strata3d.schemas import PARTS
from strata3d.session import checkpoint_dir, stored
from testbed.queries import QUERIES
from testbed.views import Testbed, duckdb_with

from .golden import UNITS, tables

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def python_rows(df):
    """Rows that Python gave back in a plan that has run."""
    nodes, n = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while nodes:
        node = nodes.pop()
        given = node.metrics().get("pythonNumRowsReceived")
        n += given.get().value() if given.isDefined() else 0
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
    return n


def written(spark):
    where = checkpoint_dir(spark).removeprefix("file:")
    return set(glob.glob(f"{where}/table-*") + glob.glob(f"{where}/*/table-*"))


def test_shaped_units_are_neither_moved_nor_written_again_for_the_rules(spark):
    units, edges, sources, settings = tables(spark, UNITS)
    shaped = units if "is_rect" in units.columns else stored(shapes.with_shape(units))
    before = written(spark)
    ctx = rules.Context.of(shaped, edges, sources, settings)
    new = [spark.read.parquet(p).columns for p in written(spark) - before]
    assert new and not any("unit_id" in c for c in new)
    assert "SortMergeJoin" not in plan(ctx.units)
    assert ctx.units.filter("acc_h is null").count() == 0


def test_display_ground_is_met_without_gathering_a_project(spark):
    rows = spark.range(20).select(
        F.lit("P").alias("project_id"), F.lit("building").alias("unit_type"),
        F.col("id").cast("double").alias("lower_limit"),
        F.struct(F.col("id").cast("double").alias("ground_level_m")).alias("attributes"))
    settings = spark.createDataFrame([("P", 30.0)], "project_id string, stratum_below_limit_m double")
    ground = views.display_ground(rows, settings)
    assert "Window" not in plan(ground)
    joined = stored(rows).join(ground, "project_id")
    assert "SortMergeJoin" not in plan(joined) and joined.filter("ground = 10").count() == 20


def test_children_across_their_parent_are_decided_without_python(spark):
    floor = ("F", "floor", (0, 0, 12, 8), (0.0, 3.0), ["SRC-005"], None, 0, True)
    kids = [(f"K{i}", "apartment", b, (0.0, 3.0), ["SRC-005"], "F", 0, None) for i, b in
            enumerate([(0, 0, 3, 8), (5, -1, 7, 9), (6, 0, 9, 8)])]
    got = []
    for turn in (False, True):          # turned shapes take the general way
        ctx = rules.Context.of(*tables(spark, [floor, *kids], turn=turn))
        if not turn:
            seen = gaps._intervals(spark.createDataFrame([], (
                "project_id string, unit_id string, tol_h double, x0 double, y0 double, x1 double, "
                "y1 double, tall boolean, kid_id string, kx0 double, ky0 double, kx1 double, ky1 double")))
            assert "Python" not in plan(seen)
        row = gaps.uncovered(ctx.units, ctx.contains).select(
            "missing", "children", shapes.area(F.col("open_parts")).alias("area")).first()
        got.append(row)
    t = 0.05 * 2 ** 0.5
    for row in got:
        assert row.missing == pytest.approx(8 * ((2 - 2 * t) + (3 - t)), abs=1e-6)
        assert row.area == pytest.approx(row.missing, abs=1e-6)
        assert row.children == ["K0", "K1", "K2"]


def test_small_families_are_not_cut_into_cells_and_agree_with_large_ones(spark, monkeypatch):
    home = ("P", "land_parcel", (0, 0, 300, 300), (900.0, 1000.0), ["SRC-005"], None, None, None)
    kids = [(f"B{i}", "building", (20 * i, 0, 20 * i + 26, 8), (900.0, 900.0 + 9 * (1 + i % 3)),
             ["SRC-005"], "P", None, None) for i in range(6)]
    ctx = rules.Context.of(*tables(spark, [home, *kids]))
    cut = []
    real = spatial.candidates
    monkeypatch.setattr(spatial, "candidates", lambda left, *a, **k: cut.append(left.count())
                        or real(left, *a, **k))
    got = []
    for family in (64, 2):
        monkeypatch.setattr(spatial, "FAMILY", family)
        got.append({(r.unit_id, r.related_unit_ids[0]) for r in rules.sibling_overlap(ctx).collect()})
    assert cut == [0, 6]
    assert got[0] == got[1] == {(f"B{i}", f"B{i + 1}") for i in range(5)}


def test_round_trip_stays_on_earth_however_many_events(spark, tmp_path):
    spark.createDataFrame([(0,), (599999,), (6_000_000,), (9_999_999,)], "event_id bigint").write.parquet(
        str(tmp_path / "events.parquet"))
    got = {r.k: (r.lon, r.lat) for r in QUERIES["reproject_round_trip"](spark, str(tmp_path)).collect()}
    for k, (lon, lat) in got.items():
        assert (lon, lat) == (round(72 + k % 600 / 100, 7), round(5 + k // 600 % 700 / 10, 7))


def test_rounds_of_pointer_doubling_carry_no_plan_from_round_to_round(spark):
    n = 16
    cut = spark.createDataFrame([("R", 1, i, 0, (i + 1) % n, 0) for i in range(n)],
                                "raster_id string, component long, x0 int, y0 int, x1 int, y1 int")
    placed = footprints.ring_places(cut)
    assert placed._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert sorted((r.id.x0, r.ring.x0, r.left) for r in placed.collect()) == [
        (i, 0, (n - i) % n) for i in range(n)]


def test_units_move_only_the_keys_of_orders_and_the_lines(spark):
    """Buildings are derived behind the exchange, floors and apartments from one pass."""
    tb = Testbed(spark, SMOKE)
    made = tb.units().drop("parts")
    assert plan(made).count("Exchange hashpartitioning") <= 2
    assert tb.placed().columns == ["o_custkey", "o_orderkey", "o_orderstatus"]


def test_units_are_the_rows_of_their_sql(spark):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    cols = ("unit_id, ord, unit_type, status, crs, vertical_datum, x0, y0, x1, y1, lower_limit, "
            "upper_limit, created_by, confidence_score, parent_ulpin, floor_index, subdivided, "
            "utility_kind, parent_id, floor_count, source_ids")
    wanted = con.execute(f"{duckdb_with('unit')} SELECT {cols} FROM unit").fetchall()
    got = [tuple(r) for r in Testbed(spark, SMOKE).view("unit").selectExpr(
        *cols.split(", ")).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(wanted, key=lambda r: r[0])


def test_neighbours_carry_a_row_once_and_meet_across_pieces_and_ranges(spark):
    step = 1 << ordered.BUCKET_BITS
    rows = [("A", i, o) for i, o in ((0, 5), (0, 7), (0, step + 1), (0, 3 * step), (1, 2), (300, 1),
                                     (300, step), (301, 4), (-1, 9), (900, 2 * step), (900, 6))]
    rows += [("B", 2, 1), ("C", 0, 3), ("C", 700, 2)]
    n = ordered.neighbours(spark.createDataFrame(rows, "g string, i int, o long"), ["g"], "i", "o",
                           ["g", "i", "o"])
    got = sorted((tuple(r.prev), tuple(r.cur)) for r in n.collect())
    line = sorted(rows)
    assert got == [(a, b) for a, b in zip(line, line[1:]) if a[0] == b[0]]
    # first and last of a piece are one row where it has one, and no aggregate holds both
    assert "Aggregate" not in plan(n)


def test_acknowledged_findings_move_once(spark):
    done = QUERIES["acknowledge_findings"](spark, SMOKE)
    assert plan(done).count("Join") == 1


def test_positions_in_small_groups_take_one_exchange_and_agree_with_large_ones(spark, monkeypatch):
    step = 1 << ordered.BUCKET_BITS
    rows = [(g, i * step // 3 + n) for n, g in enumerate(("A", "B", None)) for i in range(7 - n)]
    df = stored(spark.createDataFrame(rows, "g string, o long"))
    wanted = sorted((g or "", o, sum(h == g and p < o for h, p in rows)) for g, o in rows)
    for whole in (1 << 16, 2):
        monkeypatch.setattr(ordered, "WHOLE_GROUP", whole)
        got = ordered.position_in_group(df, ["g"], "o", "at")
        assert sorted((r.g or "", r.o, r.at) for r in got.collect()) == wanted
    only = ordered.position_in_group(df, ["g"], "o", "at")
    monkeypatch.setattr(ordered, "WHOLE_GROUP", 1 << 16)
    for made in (only, ordered.position_in_group(df, ["g"], "o", "at", among=df)):
        assert "LeftAnti" in plan(made)


def test_numbers_are_allocated_without_meeting_units_again(spark):
    got = QUERIES["sequence_with_held_numbers"](spark, SMOKE)
    assert plan(got).count("SortMergeJoin") <= 6 and got.count() > 0


def test_small_stacks_take_one_exchange_and_agree_with_tall_ones(spark, monkeypatch):
    step = 1 << ordered.BUCKET_BITS
    rows = [(g, i, o * step // 2 + o) for n, g in enumerate(("A", "B", None)) for i in (0, 1, 1, 700)
            for o in range(n + 1, 4)]
    rows = sorted(set(rows), key=lambda r: (r[0] or "", *r[1:]))
    df = stored(spark.createDataFrame(rows, "g string, i int, o long"))
    wanted = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[0]]
    for whole in (1 << 16, 2):
        monkeypatch.setattr(ordered, "WHOLE_GROUP", whole)
        n = ordered.neighbours(df, ["g"], "i", "o", ["g", "i", "o"])
        assert "LeftAnti" in plan(n)
        got = sorted((tuple(r.prev), tuple(r.cur)) for r in n.filter("g is not null").collect())
        assert got == wanted
        assert n.count() == len(rows) - 3


def test_rules_that_ask_no_accuracy_do_not_meet_source_lists(spark):
    units, edges, sources, settings = tables(spark, UNITS)
    ctx = rules.Context.of(stored(shapes.with_shape(units)), edges, sources, settings)
    for rule in (rules.heights_impossible, rules.heights_unavailable, rules.confidence_low,
                 rules.floor_height, rules.crs_mismatch, rules.datum_mismatch):
        assert plan(rule(ctx)).count("Join") <= 1, rule


def test_floors_that_hold_their_edge_meet_no_edges_and_agree(spark):
    units, edges, sources, settings = tables(spark, UNITS)
    up = edges.filter("rel_type = 'contains'").select(
        "project_id", F.col("to_unit_id").alias("unit_id"), F.col("from_unit_id").alias("above"))
    held = stored(shapes.with_shape(units).join(up, ["project_id", "unit_id"], "left"))
    got = []
    for nested in (None, "above"):
        found = rules.floor_sequence(rules.Context.of(held, edges, sources, settings, nested=nested))
        got.append([(r.unit_id, r.related_unit_ids, r.measured_value, r.tolerance)
                    for r in found.collect()])
    assert got[0] == got[1] == [("FLR-005", ["FLR-004"], 0.4, got[0][0][3])]


def test_review_queue_writes_no_findings_and_sorts_no_units(spark, monkeypatch):
    from testbed import queries
    monkeypatch.setattr(queries, "_BEDS", {})
    first = QUERIES["review_queue"](spark, SMOKE)
    tb = queries.bed(spark, SMOKE)
    assert not {"findings", "units"} & tb._kept.keys() and "PROVENANCE" not in plan(first)
    assert "SortMergeJoin" not in plan(first) and "format_string" not in plan(first)
    rows = sorted(map(tuple, first.collect()))
    tb.kept("findings")                 # the stored run has the same findings
    assert sorted(map(tuple, QUERIES["review_queue"](spark, SMOKE).collect())) == rows


def test_units_derived_where_they_are_read_move_nothing_and_are_the_stored_ones(spark):
    tb = Testbed(spark, SMOKE)
    seen = tb.seen()
    assert "Exchange" not in plan(seen)
    # one unit type reads the numbers of that type only
    assert plan(seen.filter("unit_type = 'floor'").select("unit_id")).count("FileScan") == 1
    ids = tb.relationships(seen).select("from_unit_id", "to_unit_id", "rel_type", "ord")
    assert "units" not in tb._kept
    kept = tb.kept("units")
    assert tb.seen() is kept and seen.dtypes == kept.dtypes and seen.count() == kept.count()
    assert seen.exceptAll(kept).isEmpty() and kept.exceptAll(seen).isEmpty()
    assert ids.exceptAll(tb.kept("relationships").select(*ids.columns)).isEmpty()


def test_detections_are_measured_once_and_not_for_every_search(spark):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]

    def rows(*boxes):
        return spark.createDataFrame([("P", f"S{i}", i, *map(float, b)) for i, b in enumerate(boxes)], (
            "project_id string, suggestion_id string, ord long, x0 double, y0 double, x1 double, "
            "y1 double")).withColumn("parts", shapes.rectangle(*box)).drop("x0", "y0", "x1", "y1")

    found = rows((0, 0, 8, 8), (100, 0, 108, 8), (200, 0, 208, 8))
    units = rows((1, 0, 9, 8), (40, 0, 48, 8)).select(
        "project_id", F.col("suggestion_id").alias("unit_id"), F.lit("building").alias("unit_type"),
        "ord", "parts")
    queue = rows((101, 0, 109, 8), (1, 0, 9, 8)).withColumn("review_state", F.lit("pending")).withColumn(
        "edited_parts", F.lit(None).cast(PARTS))
    for held in (units, stored(shapes.with_shape(units))):
        done = detecting.sort_out(shapes.with_shape(found), held, queue)
        assert "isnan" not in plan(done.report).lower()         # of the general way to a box
        assert {r.outcome: r.n for r in done.report.collect()} == {
            "already_mapped": 1, "rediscovered": 1, "fresh": 1}
        assert [r.suggestion_id for r in done.fresh.collect()] == ["S2"]


def test_plain_rectangles_have_the_shape_of_the_general_way(spark):
    nan, inf = float("nan"), float("inf")
    square = [(0, 0), (2, 0), (2, 3), (0, 3), (0, 0)]
    crossed = [(0, 0), (2, 3), (2, 0), (0, 3), (0, 0)]
    half = [(0, 0), (2, 0), (2, 3), (0, 0), (0, 0)]
    rings = [[square], [square[::-1]], [[*square[2:4], *square[:3]]], [crossed], [half],
             [[*square[:4], (0, 1)]], [square[:4]], [[(0, 0), (2, 0), (2, 0), (0, 0), (0, 0)]],
             [[(nan, 0), (2, 0), (2, 3), (nan, 3), (nan, 0)]],
             [[(0, 0), (inf, 0), (inf, 3), (0, 3), (0, 0)]], [square, square]]
    typed = [[[[tuple(map(float, p)) for p in r] for r in rs]] for rs in rings]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*typed, typed[0] * 2, [], None])],
                               f"i int, parts {PARTS}")
    got = {r.i: (r.x0, r.y0, r.x1, r.y1, r.is_rect, r.area) for r in shapes.with_shape(df).collect()}
    whole = (0.0, 0.0, 2.0, 3.0)
    assert [got[i] for i in (0, 1, 2)] == [(*whole, True, 6.0)] * 3
    assert [got[i] for i in (3, 4, 5, 6, 10, 11)] == [
        (*whole, False, a) for a in (0.0, 3.0, 6.0, 6.0, 0.0, 12.0)]
    assert got[7][4] is False and got[7][5] == 0.0 and not got[8][4] and not got[9][4]
    assert got[12] == (None, None, None, None, False, 0.0)
    assert got[13] == (None, None, None, None, False, None)


def test_plans_of_rectangles_are_clipped_without_python_and_each_pair_once(spark):
    def ring(*points):
        return [[[tuple(map(float, p)) for p in (*points, points[0])]]]

    def box(x0, y0, x1, y1):
        return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))

    def bent(x0):           # 8 by 8 without its upper right quarter
        return ring((x0, 0), (x0 + 8, 0), (x0 + 8, 4), (x0 + 4, 4), (x0 + 4, 8), (x0, 8))

    def floors(*rows):
        return shapes.with_shape(spark.createDataFrame([("P", i, p, 0.0, 3.0, "C", "D", ("U", 0)) for i, p in rows], (
            f"project_id string, unit_id string, parts {PARTS}, lower_limit double, upper_limit double, crs string, "
            "vertical_datum string, attributes struct<parent_ulpin_14:string,floor_index:int>")))

    def plans(*rows):
        return shapes.with_shape(spark.createDataFrame([(f, i, ["S"], None, p) for f, i, p in rows], (
            f"floor_id string, plan_id string, source_ids array<string>, confidence double, parts {PARTS}")))

    def areas(made):
        return sorted((r.parent_id, r.plan_id, round(r.area, 6)) for r in made.select(
            "parent_id", "plan_id", shapes.area(F.col("parts")).alias("area")).collect())

    square, corner = ("F1", box(0, 0, 8, 8)), ("F2", bent(0))
    straight = [(f, f"{f}/{i}", b) for f in ("F1", "F2") for i, b in enumerate(
        [box(2, 2, 6, 6), box(-4, 0, 2, 8), box(8, 0, 12, 4)])]
    skew = [(f, f"{f}/L", bent(2)) for f in ("F1", "F2")]
    made = units.apartments(floors(square, corner), plans(*straight, *skew))
    assert areas(made) == [("F1", "F1/0", 16.0), ("F1", "F1/1", 16.0), ("F1", "F1/L", 40.0),
                           ("F2", "F2/0", 12.0), ("F2", "F2/1", 16.0), ("F2", "F2/L", 32.0)]
    plain = units.apartments(floors(square), plans(*straight))
    assert areas(plain) == [("F1", "F1/0", 16.0), ("F1", "F1/1", 16.0)]
    rows = plain.select("plan_id", "parts")
    assert len(rows.collect()) == 2
    assert python_rows(rows) == 0


def test_apartments_are_made_without_storing_units(spark, monkeypatch):
    from testbed import queries
    monkeypatch.setattr(queries, "_BEDS", {})
    QUERIES["apartments_from_plan"](spark, SMOKE)
    assert "units" not in queries.bed(spark, SMOKE)._kept


def test_siblings_move_once_and_units_that_hold_their_parent_do_not_meet_edges(spark, monkeypatch):
    units_, edges, sources, settings = tables(spark, UNITS)
    up = edges.filter("rel_type = 'contains'").select(
        "project_id", F.col("to_unit_id").alias("unit_id"), F.col("from_unit_id").alias("above"))
    held = stored(shapes.with_shape(units_).join(up, ["project_id", "unit_id"], "left"))
    met, own = (rules.Context.of(held, edges, sources, settings, nested=n) for n in (None, "above"))
    assert "Aggregate" not in plan(own.family())
    cols = ["unit_id", "parent_id", "unit_type", "acc_h", *shapes.BOX]
    assert sorted(own.family().select(*cols).collect(), key=str) == sorted(
        met.family().select(*cols).collect(), key=str)
    wrote = []
    monkeypatch.setattr(spatial, "stored", lambda df: wrote.append(df) or stored(df))
    spatial.sibling_overlaps(own.family())
    static = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in static}
    try:
        for k, v in static.items():
            spark.conf.set(k, v)
        pairs = plan(wrote[-1].select("*"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert "ReusedExchange [project_id" in pairs
    assert pairs.count("REPARTITION_BY_COL, [plan_id") == 1 + pairs.count("ReusedExchange [project_id")


@pytest.mark.parametrize("heights", [[180.0] * 8, [3.0, 3.0, 180.0, 2.0, 4.0, 3.0, 0.0, 90.0]])
def test_large_families_are_cut_into_bins_as_high_as_their_members(spark, monkeypatch, heights):
    home = ("P", "land_parcel", (0, 0, 300, 300), (800.0, 1100.0), ["SRC-005"], None, None, None)
    kids = [(f"B{i}", "building", (10 * i, 0, 10 * i + 26, 8), (880.0 + 2 * i, 880.0 + 2 * i + h),
             ["SRC-005"], "P", None, None) for i, h in enumerate(heights)]
    ctx = rules.Context.of(*tables(spark, [home, *kids]))
    bins, real = [], spatial.candidates

    def cut(left, right, **known):
        bins.extend(r[0] for r in left.select(known["split_z"]).distinct().collect())
        return real(left, right, **known)

    monkeypatch.setattr(spatial, "candidates", cut)
    got = []
    for family in (64, 2):
        monkeypatch.setattr(spatial, "FAMILY", family)
        got.append({(r.unit_id, r.related_unit_ids[0]) for r in rules.sibling_overlap(ctx).collect()})
    assert bins == [max(8.0, 2 * sum(heights) / len(heights))]
    assert got[0] == got[1] and got[0]
