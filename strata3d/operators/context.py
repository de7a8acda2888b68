"""What the rules share: accuracy, parents, children, settings, shape columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..schemas import UNKNOWN_ACCURACY_M
from ..session import stored

SETTING_COLUMNS = ("tolerance_k", "project_crs", "project_datum", "min_floor_height_m",
                   "max_floor_height_m", "confidence_warn_below")


def contains_edges(relationships: DataFrame) -> DataFrame:
    return relationships.filter("rel_type = 'contains'")


def parents(relationships: DataFrame) -> DataFrame:
    """unit_id -> parent_id; the last `contains` edge wins."""
    return (contains_edges(relationships)
            .groupBy("project_id", F.col("to_unit_id").alias("unit_id"))
            .agg(F.max_by("from_unit_id", "ord").alias("parent_id")))


def accuracy(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct source lists -> worst accuracy and whether every source states one.

    Units share a handful of source lists, so the lists are reduced before the join; the
    large unit table is never exploded.
    """
    lists = units.select("project_id", "source_ids").distinct()
    known = (sources.filter("horizontal_accuracy_m is not null and "
                            "vertical_accuracy_m is not null")
             .select("project_id", "source_id", "horizontal_accuracy_m",
                     "vertical_accuracy_m"))
    return (lists.select("project_id", "source_ids",
                         F.explode_outer("source_ids").alias("source_id"))
            .join(known, ["project_id", "source_id"], "left")
            .groupBy("project_id", "source_ids")
            .agg(F.max("horizontal_accuracy_m").alias("acc_h"),
                 F.max("vertical_accuracy_m").alias("acc_v"),
                 F.count("horizontal_accuracy_m").alias("n_known"))
            .select("project_id", "source_ids",
                    F.coalesce("acc_h", F.lit(UNKNOWN_ACCURACY_M)).alias("acc_h"),
                    F.coalesce("acc_v", F.lit(UNKNOWN_ACCURACY_M)).alias("acc_v"),
                    F.coalesce((F.size("source_ids") > 0)
                               & (F.col("n_known") == F.size("source_ids")), F.lit(False))
                    .alias("acc_known")))


def with_project(units: DataFrame, settings: DataFrame) -> DataFrame:
    """Units with settings and shape columns, but without accuracy: these meet one small table.

    Settings are written first: read back, their size is known before the units move.
    """
    s = stored(settings.select("project_id", "tolerance_k", "project_crs",
                               F.col("vertical_datum").alias("project_datum"),
                               "min_floor_height_m", "max_floor_height_m",
                               "confidence_warn_below"))
    # a unit of a project without settings still meets every rule
    out = units.join(s, "project_id", "left").select(
        "*", F.col("attributes.utility_kind").alias("utility_kind"),
        F.col("attributes.floor_index").alias("floor_index"))
    return out if "is_rect" in units.columns else shapes.with_shape(out)


def with_accuracy(rows: DataFrame, lists: DataFrame, of: str = "source_ids",
                  **named: str) -> DataFrame:
    """Rows with the columns of `lists` (all, or those `named`: new name = column) that belong to
    their source list `of`; a row without a list keeps its place."""
    named = named or {c: c for c in lists.columns if c not in ("project_id", "source_ids")}
    a = lists.select(F.col("project_id").alias("_p"), F.col("source_ids").alias("_s"),
                     *[F.col(c).alias(n) for n, c in named.items()])
    return rows.join(a, F.col("project_id").eqNullSafe(F.col("_p"))
                     & F.col(of).eqNullSafe(F.col("_s")), "left").drop("_p", "_s")


def enriched(units: DataFrame, sources: DataFrame, settings: DataFrame) -> DataFrame:
    """Units with acc_h, acc_v, acc_known, settings and shape columns.

    Source lists are written first, as settings are, so that units do not move for as long as Spark
    finds them small.
    """
    return with_accuracy(with_project(units, settings), stored(accuracy(units, sources)))


def build(units: DataFrame, relationships: DataFrame, sources: DataFrame,
          settings: DataFrame) -> DataFrame:
    """Enriched units with parent_id."""
    return enriched(units, sources, settings).join(
        parents(relationships), ["project_id", "unit_id"], "left")
