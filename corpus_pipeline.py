"""Training-corpus pipeline: five stages over `documents`, each calling one corpus operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read
again as the next one's input. All but the last return the columns of `documents`.

1. language_id: documents without a letter, or with an unsure guess, go.
2. line_dedup: lines of recurring templates are cut; documents left without a word go.
3. near_dedup: of every group of near copies, repeated rows too, one document stays.
4. decontamination: documents that hold a benchmark item within the edit budget go.
5. encoding: what is left is cut into pieces of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata3d.llm import decontaminate, language, linetemplates, pieces, simhash
from strata3d.llm.queries import VOCABULARY, fold, table
from strata3d.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: An ambiguous guess under this score rejects the document.
UNSURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language.fit(docs, fold(5) != 0)
    told = docs.select(*COLUMNS, language.verdict(F.col("text"), model).alias("v"))
    unsure = F.col("v.ambiguous") & (F.col("v.score") < UNSURE)
    return told.where((F.col("v.lang_pred") != language.UNKNOWN) & ~unsure).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linetemplates.cleaned(docs.select(*COLUMNS), "rest", "gone")
    left = out.where(F.col("gone").isNull() | F.col("rest").rlike(r"\S"))
    return left.select("doc_id", F.col("rest").alias("text"), "lang", "source",
                       F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(
                           F.length("rest").cast("long")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    gone = stored(simhash.copies(docs).withColumnRenamed("row", "_row"))
    left = keyed.join(gone, "_row", "left_anti")
    # of rows equal in id and text one stays; few rows are repeated, so only these are grouped
    again = stored(keyed.groupBy("_row").count().where("count > 1").select("_row"))
    one = left.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return left.join(again, "_row", "left_anti").unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    hit = decontaminate.contaminated(
        keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = stored(hit.select(F.col("doc_id").alias("_row")).distinct())
    return keyed.join(hit, "_row", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.read_model(VOCABULARY))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]

#: No SQL: the stages rest on trained classifiers and alignments; tests/llm checks them instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written once and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
