"""Column layouts and the fixed vocabularies of the register."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# --- fixed values: vocabularies the data contract names ---------------------------------
UNIT_TYPES = ("land_parcel", "building", "floor", "apartment",
              "underground_feature", "elevated_structure")
EASEMENT_TYPES = ("underground_feature", "elevated_structure")
STATUSES = ("draft", "processing", "needs_review", "approved", "replaced", "closed")
VALIDATION_STATES = ("unvalidated", "passed", "passed_with_warnings", "failed")
DISPUTE_STATES = ("undisputed", "contested")
REPRESENTATIONS = ("prism", "polyhedron")
CREATED_BY = ("human", "ai", "derived")
SEVERITIES = ("error", "warning", "info")
REL_TYPES = ("contains", "inside", "overlaps", "adjacent", "created_from", "replaced_by")
LEDGER_STATES = ("issued", "replaced", "closed")
SUGGESTION_KINDS = ("building_outline", "floor_estimate")
REVIEW_STATES = ("pending", "accepted", "edited", "rejected")
FLOOR_METHODS = ("ndsm_division", "facade_histogram", "manual")
RULE_IDS = ("GEOM_INVALID", "GEOM_DUPLICATE", "Z_IMPOSSIBLE", "HEIGHTS_UNAVAILABLE",
            "OVERLAP_SIBLING", "GAP_SIBLING", "ESCAPES_PARENT", "FLOOR_SEQUENCE",
            "FLOOR_HEIGHT_IMPLAUSIBLE", "UTILITY_CROSSES_BUILDING", "CRS_MISMATCH",
            "DATUM_MISMATCH", "CONFIDENCE_LOW", "PROVENANCE_MISSING")
#: Which layer a vector source lands in, which raster kind a surface source is, and the
#: source types that carry provenance only.
VECTOR_SOURCES = {"parcel_map": "parcel", "footprint": "building_footprint",
                  "utility": "utility_line"}
RASTER_SOURCES = {"dem": "DEM", "dsm": "DSM", "ortho": "ORTHO"}
REGISTER_ONLY_SOURCES = ("floorplan", "pointcloud", "survey_control")
TYPE_LABELS = {"land_parcel": "parcel", "building": "building", "floor": "floor",
               "apartment": "apartment", "underground_feature": "underground",
               "elevated_structure": "elevated"}
#: Status moves a record may make.
TRANSITIONS = (("draft", "processing"), ("processing", "needs_review"),
               ("processing", "draft"), ("needs_review", "approved"),
               ("needs_review", "draft"), ("approved", "replaced"), ("approved", "closed"))
# --- fixed values: thresholds and constants ---------------------------------------------
MAJORITY = 0.5                # share of a footprint one parcel must exceed
MIN_COVERAGE = 0.6            # valid-cell share below which no height is derived
ASSUMED_STOREY_M = 3.0
UNKNOWN_ACCURACY_M = 1.0      # used where no source states an accuracy
MIN_BUILDING_HEIGHT_M = 2.5
MIN_FOOTPRINT_M2 = 15.0
SIMPLIFY_M = 0.5
OUTLINE_CONFIDENCE = 0.80
MAX_SEQUENCE = 999
MAX_LEVEL = 99
# -----------------------------------------------------------------------------------------

PARTS = "array<array<array<struct<x:double,y:double>>>>"
PARTS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
EDGES = "array<struct<xa:double,ya:double,xb:double,yb:double,s:double>>"

SETTINGS_DEFAULTS = {
    "project_crs": "EPSG:32643", "vertical_datum": "EGM2008",
    "stratum_below_limit_m": -30.0, "stratum_above_limit_m": 150.0,
    "default_plinth_offset_m": 0.6, "default_parapet_deduction_m": 0.0,
    "ulpin_version": "v1", "ruleset_version": "r1",
    "min_floor_height_m": 2.4, "max_floor_height_m": 5.0,
    "confidence_warn_below": 0.6, "tolerance_k": 1.0,
}
SETTINGS = ("project_id string, project_crs string, vertical_datum string, "
            "stratum_below_limit_m double, stratum_above_limit_m double, "
            "default_plinth_offset_m double, default_parapet_deduction_m double, "
            "ulpin_version string, ruleset_version string, min_floor_height_m double, "
            "max_floor_height_m double, confidence_warn_below double, tolerance_k double")

#: Attribute keys the register knows; anything else a caller sends stays in `extra`.
ATTRIBUTES = (
    "local_id string, parent_ulpin_14 string, parcel_share double, "
    "parcel_unresolved string, floor_count int, floor_count_method string, "
    "assumed_storey_m double, heights_unavailable string, easement boolean, "
    "utility_kind string, depth_top_m double, depth_bottom_m double, "
    "corridor_width_m double, ground_level_m double, roof_level_m double, "
    "plinth_offset_m double, raster_coverage double, "
    "stratum_is_relative_to_ground boolean, floor_index int, floor_height_m double, "
    "subdivided boolean, suggestion_id string, source_raster_ids array<string>, "
    "extra map<string,string>")

UNIT = (
    "project_id string, unit_id string, ord bigint, unit_type string, status string, "
    "validation_state string, dispute_state string, representation string, crs string, "
    f"vertical_datum string, parts {PARTS}, lower_limit double, upper_limit double, "
    "source_ids array<string>, created_by string, confidence_score double, "
    "model struct<name:string,version:string,run_at:timestamp>, ulpin string, "
    "ulpin_provisional string, ulpin_version string, valid_from date, valid_to date, "
    "recorded_from timestamp, recorded_to timestamp, "
    "attributes struct<" + re.sub(r"(\w+) (\w)", r"\1:\2", ATTRIBUTES) + ">")

RELATIONSHIP = ("project_id string, from_unit_id string, to_unit_id string, "
                "rel_type string, created_at timestamp, ord bigint")
SOURCE = ("project_id string, source_id string, source_type string, name string, "
          "provider string, capture_date date, crs string, vertical_datum string, "
          "horizontal_accuracy_m double, vertical_accuracy_m double, "
          "coverage_wkt string, processing_status string")
RASTER = ("project_id string, raster_id string, kind string, path string, crs string, "
          "vertical_datum string, resolution_m double, source_id string, ord bigint")
TILE = ("raster_id string, tile_row int, tile_col int, x0 double, y0 double, "
        "res_x double, res_y double, ncols int, nrows int, nodata float, "
        "values array<float>")
FINDING = ("project_id string, finding_id string, run_id string, rule_id string, "
           "severity string, unit_id string, related_unit_ids array<string>, "
           "message string, suggested_action string, "
           f"affected_geometry {PARTS}, measured_value double, tolerance double, "
           "detected_at timestamp, acknowledged_by string, acknowledged_at timestamp, "
           "resolved_by string, resolution_note string")
RUN = ("project_id string, run_id string, started_at timestamp, finished_at timestamp, "
       "ruleset_version string, scope string, ord bigint")
SUGGESTION = (
    f"project_id string, suggestion_id string, ord bigint, kind string, parts {PARTS}, "
    "crs string, source_raster_ids array<string>, confidence double, "
    "model struct<name:string,version:string,run_at:timestamp>, floor_count int, "
    "floor_count_method string, ground_level_m double, roof_level_m double, "
    "review_state string, reviewed_by string, reviewed_at timestamp, "
    f"edited_parts {PARTS}, unit_id string, received_at timestamp")
SEQUENCE = ("project_id string, parent_ulpin_14 string, stratum string, level int, "
            "unit_id string, sequence int")
LEDGER = ("project_id string, ulpin string, unit_id string, issued_at timestamp, "
          "ulpin_version string, state string")


def struct(ddl: str) -> T.StructType:
    """The StructType of one of the layouts above."""
    return T.StructType.fromDDL(ddl)


def names(ddl: str) -> list[str]:
    return struct(ddl).names
