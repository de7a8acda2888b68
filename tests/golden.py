"""The golden project: two parcels, one tower with a basement, three flats, two easements."""

from pyspark.sql import functions as F

from strata3d.functions import shapes
from strata3d.operators.units import both_directions, complete
from strata3d.schemas import SOURCE, UNIT
from strata3d.sources.register import settings_row

E0, N0 = 445000.0, 1434000.0
ACCURACY = {"SRC-001": (0.30, 0.50), "SRC-002": (0.15, 0.10), "SRC-003": (0.20, 0.10),
            "SRC-004": (0.20, 0.10), "SRC-005": (0.05, 0.05), "SRC-006": (0.50, 1.00),
            "SRC-007": (None, None)}
TOWER = ["SRC-002", "SRC-003", "SRC-004"]
#: unit, type, box, z, sources, parent, floor index, subdivided
UNITS = [
    ("PCL-001", "land_parcel", (0, 0, 40, 30), (882.4, 1062.4), ["SRC-001"], None, None, None),
    ("PCL-002", "land_parcel", (40, 0, 80, 30), (882.4, 1062.4), ["SRC-001"], None, None, None),
    ("BLD-001", "building", (8, 6, 32, 24), (909.4, 936.5), TOWER, "PCL-001", None, None),
    *[(f"FLR-{n}", "floor", (8, 6, 32, 24), z, TOWER, "BLD-001", i, i == 1) for n, i, z in (
        ("B01", -1, (909.4, 913.0)), ("000", 0, (913.0, 918.5)), ("001", 1, (918.5, 921.5)),
        ("002", 2, (921.5, 924.5)), ("003", 3, (924.5, 927.5)), ("004", 4, (927.5, 930.5)),
        ("005", 5, (930.9, 933.5)), ("006", 6, (933.5, 936.5)))],
    ("APT-101", "apartment", (8, 6, 16, 24), (918.5, 921.5), ["SRC-005"], "FLR-001", 1, None),
    ("APT-102", "apartment", (16, 6, 24, 24), (918.5, 921.5), ["SRC-005"], "FLR-001", 1, None),
    ("APT-103", "apartment", (23.6, 6, 32, 24), (918.5, 921.5), ["SRC-005"], "FLR-001", 1,
     None),
    ("UGF-001", "underground_feature", (-5, 14, 85, 16), (910.4, 911.9), ["SRC-006"],
     "PCL-001", None, None),
    ("ELV-001", "elevated_structure", (30, 26, 70, 29), (920.0, 923.0), ["SRC-007"],
     "PCL-001", None, None),
]
EXPECTED = {("OVERLAP_SIBLING", "APT-102", "APT-103", 7.2),
            ("FLOOR_SEQUENCE", "FLR-005", "FLR-004", 0.4),
            ("UTILITY_CROSSES_BUILDING", "UGF-001", "FLR-B01", 48.0),
            ("FLOOR_HEIGHT_IMPLAUSIBLE", "FLR-000", "", 5.5),
            ("PROVENANCE_MISSING", "ELV-001", "", None)}


def tables(spark, units=UNITS, odd_shape=False, turn=False):
    """units, relationships, sources, settings. `turn` adds a needless vertex to every ring,
    so nothing counts as a rectangle and every shape takes the general path."""
    rows = [("P", u, i, t, float(b[0]), float(b[1]), float(b[2]), float(b[3]),
             None if z is None else z[0], None if z is None else z[1], s, p, f, sub)
            for i, (u, t, b, z, s, p, f, sub) in enumerate(units)]
    df = spark.createDataFrame(rows, (
        "project_id string, unit_id string, ord bigint, unit_type string, a double, b double, "
        "c double, d double, lower_limit double, upper_limit double, source_ids array<string>, "
        "parent string, floor_index int, subdivided boolean"))
    x0, y0, x1, y1 = (F.col(k) + o for k, o in zip("abcd", (E0, N0, E0, N0)))
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    if turn:
        ring.insert(1, ((x0 + x1) / 2, y0))
    df = df.withColumn("parts", F.array(F.array(F.array(*[shapes.point(*p) for p in ring]))))
    df = df.withColumn("attributes", F.struct(
        F.col("floor_index"), F.col("subdivided"),
        F.lit(None).cast("string").alias("utility_kind"),
        F.lit(None).cast("string").alias("heights_unavailable")))
    for k, v in (("crs", "EPSG:32643"), ("vertical_datum", "EGM2008"), ("status", "needs_review"),
                 ("created_by", "derived")):
        df = df.withColumn(k, F.lit(v))
    df = df.withColumn("confidence_score", F.lit(None).cast("double"))
    edges = both_directions(df.filter("parent is not null").select(
        "project_id", F.col("parent").alias("from_unit_id"),
        F.col("unit_id").alias("to_unit_id"), "ord"))
    sources = complete(spark.createDataFrame(
        [("P", k, h, v) for k, (h, v) in ACCURACY.items()],
        "project_id string, source_id string, horizontal_accuracy_m double, "
        "vertical_accuracy_m double"), SOURCE)
    df = df.drop("a", "b", "c", "d", "parent", "floor_index", "subdivided")
    return df, edges, sources, settings_row(spark, "P")


def unit_layout(df):
    from strata3d.operators.units import attributes
    return complete(df.withColumn("attributes", attributes(
        floor_index=F.col("attributes.floor_index"),
        subdivided=F.col("attributes.subdivided"))), UNIT)
