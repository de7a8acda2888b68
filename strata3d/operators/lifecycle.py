"""Findings per unit, approval guard, status changes, acknowledgements, review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STATUSES, TRANSITIONS

REQUEST_BITS = 12


def per_unit(findings: DataFrame) -> DataFrame:
    """One row per (finding, unit it names), as subject or as related."""
    named = F.array_distinct(F.concat(F.array("unit_id"), "related_unit_ids"))
    return (findings.withColumn("named_unit_id", F.explode(named)))


def validation_states(units: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst severity naming the unit; a unit nothing names has passed."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1)
    worst = (per_unit(findings).withColumn("_r", rank)
             .groupBy("project_id", F.col("named_unit_id").alias("unit_id"))
             .agg(F.max("_r").alias("_r")))
    return (units.select("project_id", "unit_id")
            .join(worst, ["project_id", "unit_id"], "left")
            .select("project_id", "unit_id",
                    F.when(F.col("_r") == 2, "failed")
                    .when(F.col("_r") == 1, "passed_with_warnings").otherwise("passed")
                    .alias("validation_state")))


def approvable(units: DataFrame, findings: DataFrame) -> DataFrame:
    """approvable flag and what blocks it: errors, and warnings nobody acknowledged."""
    open_ = per_unit(findings).filter(
        "severity = 'error' or (severity = 'warning' and acknowledged_by is null)")
    blocked = open_.groupBy("project_id", F.col("named_unit_id").alias("unit_id")).agg(
        F.count("*").alias("blocking"),
        F.sort_array(F.collect_set(F.concat_ws(" ", "severity", "rule_id")))
        .alias("blockers"))
    return (units.select("project_id", "unit_id")
            .join(blocked, ["project_id", "unit_id"], "left")
            .select("project_id", "unit_id", F.col("blocking").isNull().alias("approvable"),
                    F.coalesce("blocking", F.lit(0)).alias("blocking"),
                    F.coalesce("blockers", F.array().cast("array<string>"))
                    .alias("blockers")))


def allowed(current: Column, target: Column) -> Column:
    return F.concat_ws(">", current, target).isin([f"{a}>{b}" for a, b in TRANSITIONS])


def _index(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status).cast("int")


def _step(state: Column, target: Column, guard: Column) -> Column:
    """Next state index of one request: the target if the move is allowed, else no move."""
    ok = F.lit(False)
    for a, b in TRANSITIONS:
        move = (state == STATUSES.index(a) + 1) & (target == STATUSES.index(b) + 1)
        ok = ok | ((move & guard) if b == "approved" else move)
    return F.when(ok, target).otherwise(state)


def transitions(units: DataFrame, requests: DataFrame, guard: DataFrame) -> DataFrame:
    """Fold status requests per unit in `ord` order; one row per request with its outcome.

    `requests`: project_id, unit_id, ord, target. `guard`: project_id, unit_id, approvable,
    has_run (false refuses: no recorded run means nothing was verified). A request is a
    function on six states and functions compose, so a unit with any number of requests is
    folded in pieces of at most 4,096, the pieces are chained, and each piece is replayed
    from its entry state.
    """
    asked = (requests.join(units.select("project_id", "unit_id", "status"),
                           ["project_id", "unit_id"], "left")
             .join(guard, ["project_id", "unit_id"], "left"))
    unknown = asked.filter("status is null").select(
        "project_id", "unit_id", "ord", "target", F.lit(None).cast("string").alias("before"),
        F.lit(None).cast("string").alias("after"), F.lit("not_found").alias("outcome"))
    ok = F.coalesce("approvable", F.lit(False)) & F.coalesce("has_run", F.lit(False))
    rows = asked.filter("status is not null").select(
        "project_id", "unit_id", F.shiftright("ord", REQUEST_BITS).alias("piece"),
        _index(F.col("status")).alias("start"), ok.alias("ok"),
        F.coalesce("has_run", F.lit(False)).alias("has_run"),
        F.struct("ord", F.coalesce(_index(F.col("target")), F.lit(0)).alias("t"), "target")
        .alias("q"))
    keys = ["project_id", "unit_id"]
    pieces = rows.groupBy(*keys, "piece").agg(
        F.array_sort(F.collect_list("q")).alias("qs"),
        *[F.first(c).alias(c) for c in ("start", "ok", "has_run")])
    effect = F.transform(F.sequence(F.lit(1), F.lit(len(STATUSES))), lambda s: F.aggregate(
        F.col("qs"), s, lambda acc, q: _step(acc, q["t"], F.col("ok"))))
    chain = (pieces.select(*keys, "piece", "start", effect.alias("effect"))
             .groupBy(*keys).agg(F.first("start").alias("start"), F.array_sort(F.collect_list(
                 F.struct("piece", "effect"))).alias("ps")))
    entries = F.aggregate(
        "ps", F.struct(F.col("start").alias("at"),
                       F.array().cast("array<struct<piece:bigint,entry:int>>").alias("log")),
        lambda acc, p: F.struct(
            F.element_at(p["effect"], acc["at"]).alias("at"),
            F.concat(acc["log"], F.array(F.struct(p["piece"].alias("piece"),
                                                  acc["at"].alias("entry")))).alias("log")))
    entry = chain.select(*keys, F.inline(entries["log"]))
    played = F.aggregate(
        "qs", F.struct(F.col("entry").alias("at"), F.array().cast(
            "array<struct<ord:bigint,target:string,before:int,after:int>>").alias("log")),
        lambda acc, q: F.struct(
            _step(acc["at"], q["t"], F.col("ok")).alias("at"),
            F.concat(acc["log"], F.array(F.struct(
                q["ord"].alias("ord"), q["target"].alias("target"), acc["at"].alias("before"),
                _step(acc["at"], q["t"], F.col("ok")).alias("after")))).alias("log")))
    names = F.array(*[F.lit(s) for s in STATUSES])
    done = (pieces.join(entry, [*keys, "piece"])
            .select(*keys, "has_run", F.inline(played["log"]))
            .withColumn("before", F.element_at(names, F.col("before")))
            .withColumn("after", F.element_at(names, F.col("after"))))
    outcome = (F.when(F.col("before") != F.col("after"), "applied")
               .when(~allowed(F.col("before"), F.col("target")), "not_allowed")
               .when(~F.col("has_run"), "no_validation_run").otherwise("blocked"))
    return done.select(*keys, "ord", "target", "before", "after",
                       outcome.alias("outcome")).unionByName(unknown)


def acknowledge(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome per acknowledgement (finding_id, ord, actor): errors cannot be waved through."""
    f = findings.select("project_id", "finding_id", "severity", "acknowledged_by")
    return (requests.join(f, ["project_id", "finding_id"], "left")
            .withColumn("outcome", F.when(F.col("severity").isNull(), "not_found")
                        .when(F.col("severity") == "error", "refused_error")
                        .otherwise("acknowledged")))


def stamp(findings: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Findings with the last accepted acknowledgement written in."""
    last = (outcomes.filter("outcome = 'acknowledged'").groupBy("project_id", "finding_id")
            .agg(F.max_by("actor", "ord").alias("_who")))
    return (findings.join(last, ["project_id", "finding_id"], "left")
            .withColumn("acknowledged_at", F.when(F.col("_who").isNotNull(), at)
                        .otherwise(F.col("acknowledged_at")))
            .withColumn("acknowledged_by", F.coalesce("_who", "acknowledged_by"))
            .drop("_who"))


def decide(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome per review decision, in the order the checks are made."""
    s = suggestions.select("project_id", "suggestion_id",
                           F.lit(True).alias("_known"), F.col("unit_id").alias("_unit"))
    return (decisions.join(s, ["project_id", "suggestion_id"], "left")
            .withColumn("outcome", F
                        .when(~F.coalesce(F.col("state").isin("accepted", "edited",
                                                              "rejected"), F.lit(False)),
                              "bad_decision")
                        .when(F.coalesce("actor", F.lit("")) == "", "unsigned")
                        .when(F.col("_known").isNull(), "not_found")
                        .when(F.col("_unit").isNotNull(), "already_applied")
                        .when((F.col("state") == "edited") & F.col("edited_parts").isNull(),
                              "edit_without_geometry").otherwise("applied"))
            .drop("_known", "_unit"))


def record_decisions(suggestions: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Suggestions with the last applied decision written in."""
    last = (outcomes.filter("outcome = 'applied'").groupBy("project_id", "suggestion_id")
            .agg(F.max_by(F.struct("state", "actor", "edited_parts"), "ord").alias("_d")))
    hit = F.col("_d").isNotNull()
    return (suggestions.join(last, ["project_id", "suggestion_id"], "left")
            .withColumn("review_state", F.coalesce("_d.state", "review_state"))
            .withColumn("reviewed_by", F.coalesce("_d.actor", "reviewed_by"))
            .withColumn("reviewed_at", F.when(hit, at).otherwise(F.col("reviewed_at")))
            .withColumn("edited_parts", F.when(hit, F.col("_d.edited_parts"))
                        .otherwise(F.col("edited_parts"))).drop("_d"))
