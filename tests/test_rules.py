import pytest

from strata3d.operators import rules

from .golden import EXPECTED, UNITS, tables


def found(spark, units=UNITS, turn=False):
    ctx = rules.Context.of(*tables(spark, units, turn=turn))
    out = {}
    for name, rule in rules.RULES:
        for r in rule(ctx).collect():
            out[(r.rule_id, r.unit_id, ",".join(r.related_unit_ids))] = r.measured_value
    return out


@pytest.mark.parametrize("turn", [False, True])
def test_golden_project_gives_exactly_five_findings(spark, turn):
    got = found(spark, turn=turn)
    assert {k for k in got} == {e[:3] for e in EXPECTED}
    for rule, unit, other, measured in EXPECTED:
        value = got[(rule, unit, other)]
        assert value == (None if measured is None else pytest.approx(measured, abs=1e-9))


def test_missing_heights_are_reported_and_nothing_else_guesses(spark):
    units = [u if u[0] != "BLD-001" else (*u[:3], None, *u[4:]) for u in UNITS]
    got = found(spark, units)
    assert ("HEIGHTS_UNAVAILABLE", "BLD-001", "") in got
    assert not any(k[0] == "ESCAPES_PARENT" for k in got)


def test_sizes_far_apart_still_meet(spark):
    """A continent-sized root and a hut meet whatever their cell sizes."""
    huge = ("BIG", "building", (-90000, -90000, 90000, 90000), (900.0, 950.0), ["SRC-005"],
            None, None, None)
    hut = ("HUT", "building", (100, 100, 104, 104), (910.0, 915.0), ["SRC-005"], None, None, None)
    got = found(spark, [huge, hut])
    assert got[("OVERLAP_SIBLING", "BIG", "HUT")] == 16.0


def test_shared_wall_of_units_smaller_than_their_error_is_no_overlap(spark):
    a = ("A", "building", (0, 0, 1, 1), (900.0, 905.0), ["SRC-006"], None, None, None)
    b = ("B", "building", (1, 0, 2, 1), (900.0, 905.0), ["SRC-006"], None, None, None)
    assert not any(k[0] == "OVERLAP_SIBLING" for k in found(spark, [a, b]))
    assert not any(k[0] == "OVERLAP_SIBLING" for k in found(spark, [a, b], turn=True))


def test_gap_with_many_children_uses_tiles_and_counts_exactly(spark):
    floor = ("F", "floor", (0, 0, 40, 40), (0.0, 3.0), ["SRC-005"], None, 0, True)
    kids = [(f"K{i}-{j}", "apartment", (i * 2, j * 2, i * 2 + 2, j * 2 + 2), (0.0, 3.0),
             ["SRC-005"], "F", 0, None) for i in range(20) for j in range(20)
            if not (i == 7 and 3 <= j < 6)]
    got = found(spark, [floor, *kids])
    gap = [v for k, v in got.items() if k[0] == "GAP_SIBLING"]
    t = 0.05 * 2 ** 0.5
    # the widened neighbours close a rim of width t all round, corners included
    assert gap == [pytest.approx((2 - 2 * t) * (6 - 2 * t), abs=0.01)]
