"""Run the rules over a register and store what they found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.rules import RULES, Context
from ..operators.units import complete
from ..schemas import FINDING
from ..sources.register import Register


def findings(ctx: Context, run_id: Column, at: Column, rules=RULES) -> DataFrame:
    """Union of all rules in the finding layout; ids repeat for the same finding and run."""
    found = reduce(DataFrame.unionByName, [rule(ctx) for _, rule in rules])
    key = F.md5(F.concat_ws("|", run_id, "rule_id", "unit_id",
                            F.array_join("related_unit_ids", ",")))
    return complete(found.withColumn("run_id", run_id).withColumn("finding_id", key)
                    .withColumn("detected_at", at), FINDING)


def run(register: Register, run_id: str, rules=RULES, covered: DataFrame | None = None) -> None:
    """Validate, append run and findings, and write states back for the covered units."""
    units, edges, sources, settings = register.project()
    at = F.current_timestamp()
    ctx = Context.of(units, edges, sources, settings)
    register.append("finding", findings(ctx, F.lit(run_id), at, rules), run_id)
    done = register.read("finding").filter(F.col("run_id") == run_id)
    order = F.unix_micros(at)
    register.append("validation_run", settings.select(
        "project_id", F.lit(run_id).alias("run_id"), at.alias("started_at"),
        F.current_timestamp().alias("finished_at"), "ruleset_version",
        F.lit(None if covered is None else "scoped").cast("string").alias("scope"),
        order.alias("ord")), run_id)
    register.replace("unit", write_states(units, done, covered), run_id)


def write_states(units: DataFrame, found: DataFrame, covered: DataFrame | None) -> DataFrame:
    """New states for covered units (all when None); the others keep theirs."""
    states = lifecycle.validation_states(units, found).withColumnRenamed("validation_state",
                                                                         "_new")
    if covered is not None:
        states = states.join(covered, ["project_id", "unit_id"], "left_semi")
    return (units.join(states, ["project_id", "unit_id"], "left")
            .withColumn("validation_state", F.coalesce("_new", "validation_state"))
            .drop("_new").select(*units.columns))
