"""The stored register: Parquet tables of one or many projects.

A replaced table is written beside the old one and a line is added to its pointer last, so a
reader never sees half a table; the line with the highest number counts, and no line is ever
overwritten, so a crash at any moment leaves the table as it was. Appended tables are partitioned
by batch, and writing a batch again replaces only that batch.

An upserted table is cut into buckets by a hash of its keys. A batch writes the buckets its keys
fall in and no other; the pointer names the version of each bucket. Of the rows of one key within
a batch all stay.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import ordered
from ..schemas import SETTINGS, SETTINGS_DEFAULTS


#: Buckets of an upserted table; take so many that one holds a few GB.
BUCKETS = 16


class ProjectIncomplete(RuntimeError):
    """A table that another step must have written is absent or empty."""


class ProjectExists(RuntimeError):
    """Creating here would drop units and the proof of their identifiers."""


class Register:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        """`buckets` holds for tables not yet upserted; each is written by one task."""
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    # --- read ---------------------------------------------------------------------------
    def _pointer(self, table: str) -> dict | None:
        """Where the current rows lie and their schema (empty tables have no files)."""
        try:
            rows = self.spark.read.text(f"{self.base}/{table}/_pointer_").collect()  # one a change
        except AnalysisException:
            return None
        return max((json.loads(r[0]) for r in rows), key=lambda line: line["n"], default=None)

    def has(self, table: str) -> bool:
        return self._pointer(table) is not None

    def read(self, table: str, without_batch: str | None = None) -> DataFrame:
        """Current rows; `without_batch` leaves out what that batch itself appended."""
        found = self._pointer(table)
        if found is None:
            raise ProjectIncomplete(f"table `{table}` has not been written under {self.base}")
        df = self._rows(table, found)
        log = found["at"].startswith("log")
        if log and without_batch is not None:
            df = df.filter(F.col("batch_id") != without_batch)
        return df.drop("batch_id") if log else df

    def _rows(self, table: str, found: dict, only: set[int] | None = None) -> DataFrame:
        """Rows a pointer line stands for; of a bucketed table all or `only` some buckets."""
        schema, held = StructType.fromJson(found["schema"]), found.get("buckets")
        if held is None:
            paths = [f"{self.base}/{table}/{found['at']}"]
        else:
            paths = [f"{self.base}/{table}/{at}/_bucket={k}" for k, at in held.items()
                     if only is None or int(k) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def project(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """units, relationships, sources, settings; refuses a project that lacks one."""
        out = tuple(self.read(t) for t in ("unit", "unit_relationship", "source",
                                           "project_settings"))
        if out[3].limit(1).count() == 0:
            raise ProjectIncomplete("table `project_settings` is empty")
        bare = out[0].select("project_id").distinct().join(
            out[3].select("project_id"), "project_id", "left_anti").limit(5).collect()
        if bare:
            raise ProjectIncomplete("no `project_settings` row for " + ", ".join(
                str(r[0]) for r in bare))
        return out

    def unit(self, unit_id: str) -> DataFrame:
        """One unit without its geometry; the filter reaches the Parquet scan."""
        return self.read("unit").filter(F.col("unit_id") == unit_id).drop("parts")

    def units_by_id(self, ids: DataFrame) -> DataFrame:
        return self.read("unit").join(ids, "unit_id", "left_semi")

    def latest_run(self, project_id: str) -> DataFrame:
        return latest_run(self.read("validation_run").filter(F.col("project_id") == project_id))

    def units_held(self, project_id: str) -> int:
        return self.read("unit").filter(F.col("project_id") == project_id).count() if self.has(
            "unit") else 0

    # --- write --------------------------------------------------------------------------
    def replace(self, table: str, df: DataFrame, batch_id: str,
                sort_by: tuple[str, ...] = ()) -> None:
        if (self._pointer(table) or {}).get("at") == f"v-{batch_id}":
            return                       # this batch already replaced the table
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/v-{batch_id}")
        self._move(table, f"v-{batch_id}", df.schema)

    def append(self, table: str, df: DataFrame, batch_id: str) -> None:
        df = df.withColumn("batch_id", F.lit(batch_id))
        found = self._pointer(table)
        at = "log" if found is None else found["at"]
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
         .parquet(f"{self.base}/{table}/{at}"))
        held = StructType() if found is None else StructType.fromJson(found["schema"])
        fresh = [f for f in df.schema if f.name not in held.names]
        if found is None or fresh:          # columns a later batch brings are null in older rows
            self._move(table, at, StructType([*held.fields, *fresh]))

    def forget(self, table: str, project_id: str, batch_id: str) -> None:
        """Leave one project's rows out of a table from now on; the others' stay as they are."""
        found = self._pointer(table)
        if found is None:
            return
        schema = StructType.fromJson(found["schema"])
        rest = self._rows(table, found).filter(
            ~F.col("project_id").eqNullSafe(F.lit(project_id)))
        log = found["at"].startswith("log")
        to = f"{'log' if log else 'v'}-{batch_id}-forget"
        if to == found["at"]:
            return                       # this batch already did
        write = rest.write.mode("overwrite")
        (write.partitionBy("batch_id") if log else write).parquet(f"{self.base}/{table}/{to}")
        self._move(table, to, schema)

    def replace_project(self, table: str, df: DataFrame, project_id: str, batch_id: str) -> None:
        """One project's rows of a table; the others' stay."""
        if self.has(table):
            df = self.read(table).filter(~F.col("project_id").eqNullSafe(
                F.lit(project_id))).unionByName(df, allowMissingColumns=True)
        self.replace(table, df, batch_id)

    def _move(self, table: str, to: str, schema: StructType, **more) -> None:
        n = (self._pointer(table) or {"n": 0})["n"] + 1
        line = json.dumps({"n": n, "at": to, "schema": schema.jsonValue(), **more})
        (self.spark.createDataFrame([(line,)], "value string").coalesce(1).write
         .mode("append").text(f"{self.base}/{table}/_pointer_"))

    def upsert(self, table: str, new: DataFrame, keys: list[str], batch_id: str,
               sort_by: tuple[str, ...] = ()) -> None:
        """Last write wins per key; only the buckets that `new` has keys in are written."""
        found = self._pointer(table)
        if found is not None and found.get("batch") == batch_id:
            return                       # this batch is in the table already
        many = (found or {}).get("of", self.buckets)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(many)).cast("int")
        if found is None:
            old, kept = None, {}
        else:
            held = StructType.fromJson(found["schema"])
            old = self.read(table)
            types = {f.name: f.dataType for f in old.unionByName(
                new, allowMissingColumns=True).schema}
            whole = found.get("buckets") is None or found.get("keys") != keys or any(
                f.name in types and types[f.name] != f.dataType for f in held)
            kept = {} if whole else found["buckets"]
            if not whole:
                hit = {r[0] for r in new.select(bucket).distinct().collect()}   # at most `many`
                if not hit:
                    return
                old = self._rows(table, found, hit)
        merged = upserted(old, new, keys)
        to = f"b-{(found or {'n': 0})['n'] + 1}-{batch_id}"
        rows = merged.withColumn("_bucket", bucket).repartition(many, "_bucket")
        (rows.sortWithinPartitions("_bucket", *sort_by).write.mode("overwrite")
         .partitionBy("_bucket").parquet(f"{self.base}/{table}/{to}"))
        written = self.spark.read.parquet(f"{self.base}/{table}/{to}").select(
            "_bucket").distinct().collect() if self._filled(table, to) else []
        self._move(table, to, merged.schema, batch=batch_id, of=many, keys=keys, buckets={
            **kept, **{str(r[0]): to for r in written}})

    def _filled(self, table: str, at: str) -> bool:
        """Whether anything was written there: an empty result leaves no bucket."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.parquet").load(f"{self.base}/{table}/{at}").limit(1).count() > 0


def upserted(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins per key: new rows over old ones."""
    if old is None:
        return new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(
        new, allowMissingColumns=True)


def latest_per_key(batches: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Several batches in one frame: the latest row per key."""
    return ordered.first_per_key(batches, keys, order, last=True)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("ord")).limit(1)


def settings_row(spark: SparkSession, project_id: str, **given) -> DataFrame:
    """Project settings with defaults for whatever is not given."""
    return spark.createDataFrame([{"project_id": project_id, **SETTINGS_DEFAULTS, **given}],
                                 SETTINGS)
