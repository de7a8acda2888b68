from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata3d.functions import scalars as S
from strata3d.operators import identity, ordered
from strata3d.schemas import LEDGER, SEQUENCE

GOLDEN = ["KA05B012345678-V1-S00-000-S", "KA05B012345679-V1-S00-000-O",
          "KA05B012345678-V1-S00-001-Q", "KA05B012345678-V1-B01-000-R",
          "KA05B012345678-V1-A00-000-X", "KA05B012345678-V1-A01-001-F",
          "KA05B012345678-V1-B00-002-2", "KA05B012345678-V1-A02-001-0"]


def test_golden_identifiers_pass_and_every_substitution_is_caught(spark):
    rows = [(g, True) for g in GOLDEN]
    for g in GOLDEN[:3]:
        for i, ch in enumerate(g):
            if ch != "-":
                rows.append((g[:i] + ("7" if ch != "7" else "8") + g[i + 1:], False))
    df = spark.createDataFrame(rows, "u string, ok boolean")
    got = df.select("u", "ok", S.is_identifier(F.col("u")).alias("v")).collect()
    assert [r.u for r in got if r.v != r.ok] == []


def test_format_round_trip(spark):
    df = spark.createDataFrame([("ka05b012345678", "A", 7, 3), ("short", "A", 0, 0),
                                ("KA05B012345678", "A", 100, 0), ("KA05B012345678", "A", 1, 1000)],
                               "p string, s string, l int, q int")
    got = [r[0] for r in df.select(S.format_identifier(
        F.col("p"), F.lit(1), F.col("s"), F.col("l"), F.col("q"))).collect()]
    assert got[0].startswith("KA05B012345678-V1-A07-003-") and got[1:] == [None, None, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30))
def test_positions_count_up_inside_each_group(spark, groups):
    df = spark.createDataFrame([(g, i * 40000) for i, g in enumerate(groups)], "g int, o bigint")
    got = {(r.g, r.o): r.at for r in ordered.position_in_group(df, ["g"], "o", "at").collect()}
    seen = {}
    for i, g in enumerate(groups):
        assert got[(g, i * 40000)] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_numbers_once_given_are_kept_and_never_given_again(spark):
    held = spark.createDataFrame([("P", "KA05B012345678", "A", 0, "old", 4)], SEQUENCE)
    asked = spark.createDataFrame(
        [("P", "KA05B012345678", "A", 0, u, i) for i, u in enumerate(["new1", "old", "new2"])],
        "project_id string, parent_ulpin_14 string, stratum string, level int, "
        "unit_id string, ord bigint")
    got = {r.unit_id: r.sequence for r in identity.allocate(asked, held).collect()}
    assert got == {"old": 4, "new1": 5, "new2": 6}


def test_freeze_never_reissues(spark):
    ledger = spark.createDataFrame([("P", GOLDEN[0], "x", None, "v1", "closed")], LEDGER)
    rows = [("P", "a", 1, "building", None, None, GOLDEN[0]),
            ("P", "b", 2, "building", None, None, GOLDEN[2]),
            ("P", "c", 3, "building", None, None, GOLDEN[2]),
            ("P", "d", 4, "building", None, None, None),
            ("P", "e", 5, "building", None, "KA05B012345678", None),
            ("P", "f", 6, "building", None, None, "nonsense")]
    df = spark.createDataFrame(rows, "project_id string, unit_id string, ord bigint, unit_type "
                               "string, floor_index int, parent_ulpin_14 string, "
                               "ulpin_provisional string")
    out, _ = identity.freeze(df, spark.createDataFrame([], SEQUENCE), ledger, F.lit(1))
    got = {r.unit_id: r.outcome for r in out.collect()}
    assert got == {"a": "already_issued", "b": "issued", "c": "already_issued",
                   "d": "unknown_parcel", "e": "issued", "f": "malformed_identifier"}
