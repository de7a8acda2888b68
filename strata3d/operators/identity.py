"""Identifiers: sequence allocation, minting, audit, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import MAX_LEVEL, MAX_SEQUENCE
from . import ordered

LEVEL_KEYS = ["project_id", "parent_ulpin_14", "stratum", "level"]


class SequenceExhausted(ValueError):
    """A level of a parcel holds more units than three digits can number."""


def stratum(unit_type: Column, floor_index: Column) -> Column:
    """S for a parcel at index 0, B below ground, A otherwise."""
    index = F.coalesce(floor_index, F.lit(0))
    return (F.when(index < 0, "B")
            .when((index == 0) & (unit_type == "land_parcel"), "S").otherwise("A"))


def level(floor_index: Column) -> Column:
    return F.abs(F.coalesce(floor_index, F.lit(0))).cast("int")


def allocate(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Add `sequence`: the number a unit already holds, else the next free one by `ord`.

    `requests`: LEVEL_KEYS, unit_id, ord. Numbers run on beyond 999 here so that the caller
    can see which levels overflow; see `exhausted`.
    """
    own = held.select(*LEVEL_KEYS, "unit_id", F.col("sequence").alias("_held"))
    top = held.groupBy(*LEVEL_KEYS).agg(F.max("sequence").alias("_top"))
    known = requests.join(own, [*LEVEL_KEYS, "unit_id"], "left")
    kept = known.filter("_held is not null").withColumn("sequence", F.col("_held"))
    fresh = ordered.position_in_group(known.filter("_held is null"), LEVEL_KEYS, "ord", "_at",
                                      among=requests)
    fresh = (fresh.join(top, LEVEL_KEYS, "left")
             .withColumn("sequence", F.coalesce("_top", F.lit(-1)) + 1 + F.col("_at")))
    cols = [*requests.columns, F.col("sequence").cast("int").alias("sequence"),
            F.col("_held").isNull().alias("is_new")]
    return kept.select(*cols).unionByName(fresh.select(*cols))


def exhausted(allocated: DataFrame) -> DataFrame:
    """Levels whose numbers ran out, with how many units found none."""
    return (allocated.filter(F.col("sequence") > MAX_SEQUENCE)
            .groupBy(*LEVEL_KEYS).agg(F.count("*").alias("refused")))


def refuse_exhausted(allocated: DataFrame) -> None:
    worst = exhausted(allocated).orderBy(F.desc("refused")).limit(5).collect()
    if worst:
        raise SequenceExhausted("; ".join(
            f"parent {r.parent_ulpin_14}, stratum {r.stratum}, level {r.level:02d}: "
            f"{r.refused} over" for r in worst))


def mint(units: DataFrame, held: DataFrame, version: Column | DataFrame) -> tuple[
        DataFrame, DataFrame]:
    """Provisional identifiers for `units` and the sequence rows they add.

    `units`: project_id, unit_id, ord, unit_type, floor_index, parent_ulpin_14. A unit
    without a parent, or beyond level 99 or number 999, gets none. `version` is a number for all,
    or a table project_id, ulpin_version; the ids then carry `ulpin_version` where they have one.
    """
    asked = (units.filter("parent_ulpin_14 is not null and parent_ulpin_14 <> ''")
             .withColumn("stratum", stratum(F.col("unit_type"), F.col("floor_index")))
             .withColumn("level", level(F.col("floor_index")))
             .filter(F.col("level") <= MAX_LEVEL)
             .select(*LEVEL_KEYS, "unit_id", "ord"))
    given = allocate(asked, held)
    many = isinstance(version, DataFrame)
    numbered = given.join(version, "project_id") if many else given
    text = S.format_identifier(F.col("parent_ulpin_14"), S.version_number(F.col("ulpin_version"))
                               if many else version, F.col("stratum"),
                               F.col("level"), F.col("sequence"))
    ids = numbered.select("project_id", "unit_id", "stratum", "level", "sequence",
                          text.alias("ulpin_provisional"), *(["ulpin_version"] if many else []))
    if many:
        ids = ids.withColumn("ulpin_version", F.when(F.col("ulpin_provisional").isNotNull(),
                                                     F.col("ulpin_version")))
    rows = (given.filter(F.col("is_new") & (F.col("sequence") <= MAX_SEQUENCE))
            .select(*LEVEL_KEYS, "unit_id", "sequence"))
    return ids, rows


def reserve(units: DataFrame, held: DataFrame) -> DataFrame:
    """Sequence rows for numbers that provisional identifiers already spent."""
    p = S.identifier_parts(F.col("ulpin_provisional"))
    spent = (units.withColumn("_p", p).filter("_p is not null")
             .select("project_id", F.col("_p.parent_ulpin_14").alias("parent_ulpin_14"),
                     F.col("_p.stratum").alias("stratum"), F.col("_p.level").alias("level"),
                     "unit_id", F.col("_p.sequence").alias("sequence")))
    return spent.join(held, [*LEVEL_KEYS, "unit_id"], "left_anti")


def audit(df: DataFrame, column: str) -> DataFrame:
    """Add well_formed, valid, the identifier's fields and its URN."""
    c = F.col(column)
    p = S.identifier_parts(c)
    return df.select("*", F.coalesce(c.rlike(S.IDENTIFIER), F.lit(False)).alias("well_formed"),
                     S.is_identifier(c).alias("valid"),
                     *[p[f].alias(f) for f in ("parent_ulpin_14", "version", "stratum",
                                               "level", "sequence")],
                     S.identifier_urn(c).alias("urn"))


def repeated(df: DataFrame, column: str) -> DataFrame:
    return (df.filter(F.col(column).isNotNull()).groupBy("project_id", column)
            .agg(F.count("*").alias("n")).filter("n > 1"))


def ledger_mismatches(units: DataFrame, ledger: DataFrame) -> DataFrame:
    """Issued identifiers that register and ledger disagree on."""
    u = units.filter("ulpin is not null").select("project_id", "ulpin", "unit_id")
    led = ledger.select("project_id", "ulpin", F.col("unit_id").alias("ledger_unit_id"))
    both = u.join(led, ["project_id", "ulpin"], "full")
    return (both.withColumn("problem", F
                            .when(F.col("ledger_unit_id").isNull(), "not_in_ledger")
                            .when(F.col("unit_id").isNull(), "not_in_register")
                            .when(F.col("unit_id") != F.col("ledger_unit_id"), "other_unit"))
            .filter("problem is not null"))


def freeze(approved: DataFrame, held: DataFrame, ledger: DataFrame,
           version: Column) -> tuple[DataFrame, DataFrame]:
    """Bind identifiers for approved units; never one that was ever issued.

    `approved`: project_id, unit_id, ord (request order), unit_type, floor_index,
    parent_ulpin_14, ulpin_provisional. Returns (unit_id -> ulpin, outcome) and new
    sequence rows. Numbers spent by provisional identifiers are reserved before any new
    number is given, and the first request for an identifier wins.
    """
    has = F.col("ulpin_provisional").isNotNull() & (F.col("ulpin_provisional") != "")
    spent = reserve(approved.filter(has), held)
    rest = approved.filter(~has)
    minted, rows = mint(rest, held.select(*LEVEL_KEYS, "unit_id", "sequence")
                        .unionByName(spent), version)
    wanted = (approved.filter(has)
              .select("project_id", "unit_id", "ord", "parent_ulpin_14", F.when(
                  S.is_identifier(F.col("ulpin_provisional")), F.col("ulpin_provisional"))
                  .alias("ulpin"), F.lit("malformed_identifier").alias("none"))
              .unionByName(rest.join(minted.select("project_id", "unit_id",
                                                   F.col("ulpin_provisional").alias("ulpin")),
                                     ["project_id", "unit_id"], "left")
                           .drop("ulpin_provisional")
                           .select("project_id", "unit_id", "ord", "parent_ulpin_14", "ulpin",
                                   F.when(F.coalesce("parent_ulpin_14", F.lit("")) == "",
                                          "unknown_parcel").otherwise("sequence_exhausted")
                                   .alias("none"))))
    first = (wanted.filter("ulpin is not null").groupBy("project_id", "ulpin")
             .agg(F.min_by("unit_id", "ord").alias("winner")))
    old = ledger.select("project_id", "ulpin", F.lit(True).alias("issued"))
    out = (wanted.join(first, ["project_id", "ulpin"], "left")
           .join(old, ["project_id", "ulpin"], "left")
           .select("project_id", "unit_id", "ord", F
                   .when(F.col("ulpin").isNull(), F.col("none"))
                   .when(F.col("issued") | (F.col("winner") != F.col("unit_id")),
                         "already_issued").otherwise("issued").alias("outcome"), "ulpin"))
    return (out.withColumn("ulpin", F.when(F.col("outcome") == "issued", F.col("ulpin"))),
            spent.unionByName(rows))


def mark(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest state per identifier; rows change state, none ever leaves."""
    last = changes.groupBy("project_id", "ulpin").agg(F.max_by("state", "ord").alias("_s"))
    return (ledger.join(last, ["project_id", "ulpin"], "left")
            .withColumn("state", F.coalesce("_s", "state")).drop("_s"))


def resolve(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Look identifiers up; replaced and closed ones still answer."""
    p = S.identifier_parts(F.col("ulpin"))
    row = ledger.select("project_id", "ulpin", "unit_id", "state", "issued_at")
    return (requests.join(row, ["project_id", "ulpin"], "left")
            .select("*", F.when(p.isNull(), "malformed")
                    .when(F.col("unit_id").isNull(), "never_issued").otherwise("found")
                    .alias("outcome"), S.identifier_urn(F.col("ulpin")).alias("urn"),
                    *[p[f].alias(f) for f in ("parent_ulpin_14", "stratum", "level",
                                              "sequence")]))
