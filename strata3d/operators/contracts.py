"""Row checks of the data contracts; each returns the rows' broken clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as X


class ContractViolation(ValueError):
    """A batch breaks its contract and is refused whole."""


def broken(df: DataFrame, clauses: dict[str, Column]) -> DataFrame:
    """Add `violations array<string>`: clauses that are false or unknown, sorted."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
             for name, ok in sorted(clauses.items())]
    return df.withColumn("violations", F.filter(F.array(*marks), lambda v: v.isNotNull()))


def _in(column: str, values) -> Column:
    return F.col(column).isin(*values)


def suggestion_clauses(project_crs: Column) -> dict[str, Column]:
    count = F.col("floor_count")
    return {
        "suggestion_id": F.col("suggestion_id").isNotNull(),
        "kind": _in("kind", X.SUGGESTION_KINDS),
        "geometry": F.col("parts").isNotNull(),
        "crs": F.col("crs").rlike("^EPSG:[0-9]+$"),
        "source_raster_ids": F.size("source_raster_ids") >= 1,
        "confidence": F.col("confidence").between(0, 1),
        "model": F.col("model.name").isNotNull() & F.col("model.version").isNotNull()
        & F.col("model.run_at").isNotNull(),
        "review": _in("review_state", X.REVIEW_STATES),
        "floor_count": count.isNull() | (count >= 1),
        "floor_count_method": F.col("floor_count_method").isNull()
        | _in("floor_count_method", X.FLOOR_METHODS),
        "project_crs": F.col("crs") == project_crs,
    }


SUGGESTION_KEYS = ("attributes", "confidence", "crs", "geometry", "kind", "model", "review",
                   "source_raster_ids", "suggestion_id")
REQUIRED_SUGGESTION_KEYS = tuple(k for k in SUGGESTION_KEYS if k != "attributes")


def suggestion_document_clauses(text: Column) -> dict[str, Column]:
    """Checks on the raw JSON text: required keys, no foreign key, typed fields."""
    keys = F.json_object_keys(text)

    def at(path):
        return F.get_json_object(text, f"$.{path}")

    number = at("confidence").try_cast("double")
    floors = at("attributes.floor_count")
    out = {f"has_{k}": F.array_contains(keys, k) for k in REQUIRED_SUGGESTION_KEYS}
    out |= {
        "no_other_key": F.size(F.array_except(keys, F.array(
            *[F.lit(k) for k in SUGGESTION_KEYS]))) == 0,
        "kind": at("kind").isin(*X.SUGGESTION_KINDS),
        "crs": at("crs").rlike("^EPSG:[0-9]+$"),
        "source_raster_ids": F.json_array_length(at("source_raster_ids")) >= 1,
        "confidence": number.between(0, 1),
        "floor_count": floors.isNull() | (floors.rlike("^[0-9]+$")
                                          & (floors.try_cast("int") >= 1)),
        "floor_count_method": at("attributes.floor_count_method").isNull()
        | at("attributes.floor_count_method").isin(*X.FLOOR_METHODS),
        "model": at("model.name").isNotNull() & at("model.version").isNotNull()
        & at("model.run_at").isNotNull(),
        "review": at("review.state").isin(*X.REVIEW_STATES),
    }
    return out


def unit_clauses() -> dict[str, Column]:
    rings = F.flatten("parts")
    return {
        "unit_id": F.length("unit_id") > 0,
        "unit_type": _in("unit_type", X.UNIT_TYPES), "status": _in("status", X.STATUSES),
        "validation_state": _in("validation_state", X.VALIDATION_STATES),
        "dispute_state": _in("dispute_state", X.DISPUTE_STATES),
        "representation": _in("representation", X.REPRESENTATIONS),
        "created_by": _in("created_by", X.CREATED_BY),
        "crs": F.col("crs").rlike("^EPSG:[0-9]+$"),
        "vertical_datum": F.col("vertical_datum").isNotNull(),
        "source_ids": F.size("source_ids") >= 1,
        "ring": (F.size(rings) > 0) & F.forall(rings, lambda r: F.size(r) >= 4),
        "confidence": F.col("confidence_score").isNull()
        | F.col("confidence_score").between(0, 1),
        "approved_has_identifier": (F.col("status") != "approved")
        | (F.col("ulpin").isNotNull() & F.col("ulpin_version").isNotNull()),
        "ai_has_model": (F.col("created_by") != "ai")
        | (F.col("confidence_score").isNotNull() & F.col("model").isNotNull()),
    }


def finding_clauses() -> dict[str, Column]:
    return {"finding_id": F.length("finding_id") > 0, "run_id": F.col("run_id").isNotNull(),
            "rule_id": _in("rule_id", X.RULE_IDS), "severity": _in("severity", X.SEVERITIES),
            "unit_id": F.col("unit_id").isNotNull(), "message": F.length("message") > 0,
            "detected_at": F.col("detected_at").isNotNull()}


def source_clauses() -> dict[str, Column]:
    known = [*X.VECTOR_SOURCES, *X.RASTER_SOURCES, *X.REGISTER_ONLY_SOURCES]
    return {"source_type": _in("source_type", known),
            "horizontal_accuracy_m": F.col("horizontal_accuracy_m") > 0,
            "vertical_accuracy_m": F.col("vertical_accuracy_m") > 0}


def source_types(spark) -> DataFrame:
    """Catalogue of accepted source types and what becomes of each."""
    rows = ([(t, "vector", layer) for t, layer in X.VECTOR_SOURCES.items()]
            + [(t, "raster", kind) for t, kind in X.RASTER_SOURCES.items()]
            + [(t, "register_only", None) for t in X.REGISTER_ONLY_SOURCES])
    return spark.createDataFrame(rows, "source_type string, family string, target string")


def unknown_source_types(sources: DataFrame) -> DataFrame:
    asked = sources.select("source_type").distinct()
    return asked.join(source_types(sources.sparkSession), "source_type", "left_anti")


def register_problems(units: DataFrame, edges: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Uniqueness, approval, decision and reference rules of the register, broken rows only."""
    def problem(df, name, key):
        return df.select("project_id", F.lit(name).alias("problem"),
                         F.col(key).cast("string").alias("subject"))

    def repeated(df, key):
        return (df.filter(F.col(key).isNotNull()).groupBy("project_id", key)
                .agg(F.count("*").alias("n")).filter("n > 1"))

    def dangling(end):
        ids = units.select("project_id", F.col("unit_id").alias(end))
        return edges.join(ids, ["project_id", end], "left_anti")

    known = F.col("review_state").isin(*X.REVIEW_STATES)
    found = [
        problem(repeated(units, "unit_id"), "unit_id_repeated", "unit_id"),
        problem(repeated(units, "ulpin"), "ulpin_repeated", "ulpin"),
        problem(units.filter("status = 'approved' and ulpin is null"),
                "approved_without_identifier", "unit_id"),
        problem(suggestions.filter(~F.coalesce(known, F.lit(False))), "review_state_unknown",
                "suggestion_id"),
        problem(suggestions.filter("review_state = 'edited' and edited_parts is null"),
                "edited_without_geometry", "suggestion_id"),
        problem(suggestions.filter("review_state <> 'pending' and reviewed_by is null"),
                "decision_unsigned", "suggestion_id"),
        problem(dangling("from_unit_id"), "edge_start_missing", "from_unit_id"),
        problem(dangling("to_unit_id"), "edge_end_missing", "to_unit_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def refuse_if_broken(checked: DataFrame, key: str) -> None:
    """Raise when any row breaks a clause, naming the first few."""
    bad = checked.filter(F.size("violations") > 0)
    few = bad.select(key, "violations").orderBy(key).limit(4).collect()
    if few:
        raise ContractViolation("; ".join(f"{r[0]}: {', '.join(r[1])}" for r in few))


def publish_gate(units: DataFrame, settings: DataFrame | None, live: bool) -> DataFrame:
    """One row: counts and the reason to refuse publishing, or NULL."""
    state = F.coalesce("validation_state", F.lit("unvalidated"))
    counts = units.agg(F.count("*").alias("units"),
                       F.count_if(state == "unvalidated").alias("unvalidated"))
    has = (F.lit(False) if settings is None
           else settings.agg(F.count("*")).scalar() > 0)
    reason = (F.when(F.col("units") == 0, "no units").when(~has, "no project settings")
              .when(F.lit(live) & (F.col("unvalidated") > 0), F.format_string(
                  "%d of %d units are not covered by a validation run", "unvalidated",
                  "units")))
    return counts.withColumn("refusal", reason)


def validation_label(kind: Column, run_id: Column, ruleset: Column) -> Column:
    """One line saying what produced the findings."""
    return (F.when((kind == "run") & run_id.isNotNull(),
                   F.concat(F.lit("run "), F.substring(run_id, 1, 8), F.lit(" · ruleset "),
                            F.coalesce(ruleset, F.lit("null"))))
            .when(kind == "fixture-expectations", "fixture expectations")
            .otherwise("provenance unavailable"))


def validation_kind(live: Column, run_id: Column) -> Column:
    return (F.when(~live, "fixture-expectations").when(run_id.isNotNull(), "run"))
