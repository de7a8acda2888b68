"""Review decisions, acknowledgements and status requests as an append-only stream.

Each micro-batch is applied with the batch operators in request order. The register tables a
batch writes carry its id, so a batch that is replayed after a failure replaces its own
output instead of adding to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import identity, lifecycle
from ..schemas import LEDGER, PARTS, SEQUENCE
from ..session import stored
from ..sources.register import Register

REQUEST = (f"request_id string, ord bigint, kind string, project_id string, subject string, "
           f"target string, actor string, edited_parts {PARTS}")


def apply_batch(register: Register, batch: DataFrame, batch_id: str) -> DataFrame:
    """Apply one batch of requests; one outcome row per request."""
    now = F.current_timestamp()
    outcomes = None

    def add(df, subject):
        nonlocal outcomes
        df = df.select("project_id", F.col(subject).alias("subject"), "ord", "outcome")
        outcomes = df if outcomes is None else outcomes.unionByName(df)

    mine = {k: batch.filter(F.col("kind") == k) for k in ("decision", "acknowledge",
                                                          "transition")}
    if register.has("ai_suggestion"):
        queue = register.read("ai_suggestion")
        d = lifecycle.decide(queue, mine["decision"].withColumnsRenamed(
            {"subject": "suggestion_id", "target": "state"}))
        register.replace("ai_suggestion", lifecycle.record_decisions(queue, d, now).select(
            *queue.columns), batch_id)
        add(d, "suggestion_id")
    units = register.read("unit")
    runs = register.read("validation_run") if register.has("validation_run") else None
    if runs is not None:
        latest = runs.groupBy("project_id").agg(F.max_by("run_id", F.struct(
            "started_at", "ord")).alias("run_id"))
        found = register.read("finding").join(latest, ["project_id", "run_id"], "left_semi")
        a = lifecycle.acknowledge(found, mine["acknowledge"].withColumnRenamed("subject",
                                                                              "finding_id"))
        add(a, "finding_id")
        acks = a.filter("outcome = 'acknowledged'").select("project_id", "finding_id", "actor",
                                                           "ord")
        register.append("acknowledgement", acks, batch_id)
        every = register.read("acknowledgement").withColumn("outcome", F.lit("acknowledged"))
        guard = lifecycle.approvable(units, lifecycle.stamp(found, every, now)).join(
            latest.select("project_id", F.lit(True).alias("has_run")), "project_id", "left")
    else:
        guard = units.select("project_id", "unit_id", F.lit(False).alias("approvable"),
                             F.lit(False).alias("has_run"))
    asked = mine["transition"].withColumnRenamed("subject", "unit_id")
    t = lifecycle.transitions(units, asked, guard)
    spark = register.spark
    led = register.read("ulpin_ledger", without_batch=batch_id) if register.has(
        "ulpin_ledger") else spark.createDataFrame([], LEDGER)
    held = register.read("ulpin_sequence") if register.has("ulpin_sequence") else \
        spark.createDataFrame([], SEQUENCE)
    # an identifier is bound at a unit's first approval; where that is refused, so is the approval,
    # and what the unit was asked next is judged from the status it still has
    approved = (t.filter("outcome = 'applied' and target = 'approved'")
                .groupBy("project_id", "unit_id").agg(F.min("ord").alias("at"))
                .join(units, ["project_id", "unit_id"])
                .select("project_id", "unit_id", F.col("at").alias("ord"), "unit_type",
                        F.col("attributes.floor_index").alias("floor_index"),
                        F.col("attributes.parent_ulpin_14").alias("parent_ulpin_14"),
                        "ulpin_provisional"))
    frozen, rows = identity.freeze(approved, held, led, F.lit(1))
    frozen = stored(frozen)
    refused = frozen.filter("outcome <> 'issued'").select(
        "project_id", "unit_id", F.col("outcome").alias("_refusal"))
    t = lifecycle.transitions(units, asked, guard.join(
        refused, ["project_id", "unit_id"], "left").withColumn(
            "approvable", F.col("approvable") & F.col("_refusal").isNull()).drop("_refusal"))
    t = t.join(refused, ["project_id", "unit_id"], "left").withColumn("outcome", F.when(
        (F.col("outcome") == "blocked") & (F.col("target") == "approved"),
        F.coalesce("_refusal", "outcome")).otherwise(F.col("outcome"))).drop("_refusal")
    # ledger before units: an identifier is recorded as spent before anyone can read it
    issued = frozen.filter("outcome = 'issued'").join(
        units.select("project_id", "unit_id", F.coalesce("ulpin_version", F.lit("v1"))
                     .alias("ulpin_version")), ["project_id", "unit_id"])
    register.append("ulpin_sequence", rows, batch_id)
    register.append("ulpin_ledger", issued.select(
        "project_id", "ulpin", "unit_id", now.alias("issued_at"), "ulpin_version",
        F.lit("issued").alias("state")), batch_id)
    last = (t.filter("outcome = 'applied'").groupBy("project_id", "unit_id")
            .agg(F.max_by("after", "ord").alias("_s")))
    given = register.read("ulpin_ledger").filter("state = 'issued'").select(
        "project_id", "unit_id", F.col("ulpin").alias("_ulpin"))
    given = given.groupBy("project_id", "unit_id").agg(F.max("_ulpin").alias("_ulpin"))
    add(t, "unit_id")
    register.append("request_outcome", outcomes, batch_id)
    # last, so that a replayed batch still starts from the units it started from
    register.replace("unit", units.join(last, ["project_id", "unit_id"], "left")
                     .join(given, ["project_id", "unit_id"], "left")
                     .withColumn("status", F.coalesce("_s", "status"))
                     .withColumn("ulpin", F.coalesce("ulpin", "_ulpin"))
                     .withColumn("ulpin_provisional", F.when(F.col("ulpin").isNull(),
                                                             F.col("ulpin_provisional")))
                     .select(*units.columns), batch_id)
    return register.read("request_outcome")


def start(register: Register, folder: str, checkpoint: str,
          available_now: bool = False) -> StreamingQuery:
    """Follow a folder of JSON request files; order inside a batch is the explicit `ord`."""
    stream = register.spark.readStream.schema(REQUEST).json(folder)
    writer = (stream.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, n: apply_batch(register, df, f"stream-{n}") and None))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
