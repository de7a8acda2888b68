"""Line dedup by a log-template tree of fixed depth.

A line is parsed by its number of words, then by its LEADING first words; words with a digit are
variable fields. In the leaf so reached a line stands for its exact template and, if long enough,
for BLOCKS templates that each leave one block of the remaining words variable, so lines that agree
in all but one block share a template. A template held by at least `min_docs` documents recurs:
its lines are dropped from all documents but one, the least by a hash of id and text, which keeps
the text once. The line as it is, its numbers too, is one more template if it is long, which recurs
from LONG_DOCS documents on, and the only one of lines of fewer than FEWEST_WORDS words, which need
`SHORT_TIMES` times as many documents as others.

Only leaves that enough lines share are looked at further; they and the recurring templates grow
with the corpus, so both are merge-joined at every size. Counts are partial aggregates; a join on
a crowded template can be split, as its other side is a written table; no template's lines are
gathered anywhere.

Defined cases: a null text stays null and an empty one empty; lines without a word
are kept; repeated rows (equal id and text) count as one document and are cleaned alike; rows with a
null id or a shared one are told apart by their text; an empty table gives an empty result. Documents
and templates are known by 64-bit hashes. Only `doc_id` and `text` are read; `clean` returns the other columns as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored

FEWEST_WORDS = 3
LEADING = 3
BLOCKS = 5
#: Words from which a line stands for templates with a variable block as well.
GENERAL_FROM = 8
MIN_DOCS = 3
#: Documents from which a line of GENERAL_FROM words or more recurs as it is.
LONG_DOCS = 2
SHORT_TIMES = 2
#: What the two low bits of a key say of its template; 0 is any other.
LONG, SHORT = 1, 2
#: A word that holds a digit; possessive, so long words cost no more than their length.
FIELD = r"(?<!\S)[^\s\d]*+\d\S*"


def row_key() -> Column:
    """Names a document; never null."""
    return F.xxhash64("doc_id", "text")


def _key(hashed: Column, kind: Column | int = 0) -> Column:
    return F.shiftleft(hashed, 2).bitwiseOR(F.lit(kind).cast("long"))


def parsed(docs: DataFrame) -> DataFrame:
    """`row`, `at`, `leaf`, template `keys` and key as it is (`raw`, null if none) of every line
    with a word."""
    lines = docs.select(row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias(
        "at", "line"))
    split = F.split(F.trim(F.regexp_replace("line", FIELD, "<*>")), r"\s+")
    ws = F.col("ws")
    worded = lines.where(F.col("line").rlike(r"\S")).select("row", "at", F.xxhash64(
        F.lit(-2), F.trim("line")).alias("whole"), split.alias("ws")).select(
        "*", F.size(ws).alias("n"))
    kind = F.when(F.col("n") >= GENERAL_FROM, LONG).when(F.col("n") < FEWEST_WORDS, SHORT)
    leaf = F.xxhash64("n", F.slice(ws, 1, LEADING))
    rest = F.col("n") - LEADING
    general = []
    for b in range(BLOCKS):
        start = F.floor(rest * b / BLOCKS).cast("int") + LEADING
        after = F.floor(rest * (b + 1) / BLOCKS).cast("int") + LEADING
        general.append(_key(F.xxhash64(F.lit(b), "leaf", F.slice(ws, F.lit(1), start),
                                       F.slice(ws, after + 1, F.col("n") - after))))
    exact = _key(F.xxhash64(F.lit(-1), "leaf", ws))
    return worded.withColumn("leaf", leaf).select(
        "row", "at", "leaf", F.when(F.col("n") >= GENERAL_FROM, F.array(exact, *general)).when(
            F.col("n") >= FEWEST_WORDS, F.array(exact)).otherwise(
            F.array().cast("array<bigint>")).alias("keys"), _key(F.col("whole"), kind).alias("raw"))


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`row` and `lines`, the numbers of the lines to drop, of every document with some."""
    lines = stored(parsed(docs))
    leaves = stored(lines.groupBy("leaf").agg(F.count("*").alias("n"))
                    .where(F.col("n") >= min(min_docs, LONG_DOCS))
                    .select("leaf", (F.col("n") >= min_docs).alias("many"))).hint("merge")
    raw = F.when(F.col("raw").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("raw"))
    held = stored(lines.join(leaves, "leaf").select("row", "at", F.explode(
        F.when(F.col("many"), F.concat("keys", raw)).otherwise(raw)).alias("key")))
    kind = F.col("key").bitwiseAND(F.lit(3))
    enough = F.when(kind == LONG, min(min_docs, LONG_DOCS)).when(
        kind == SHORT, SHORT_TIMES * min_docs).otherwise(min_docs)
    # a document's rows of one template lie in one task, so the first aggregate is nearly done there
    recurring = stored(held.groupBy("key", "row").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.count("*").alias("docs"), F.min("row").alias("first")).where(F.col("docs") >= enough))
    gone = held.join(recurring.select("key", "first").hint("merge"), "key").where(F.col("row") != F.col("first"))
    return gone.groupBy("row").agg(F.collect_set("at").alias("lines"))


def _rest(text: Column, gone: Column) -> Column:
    """The text without the numbered lines; the split lines are bound once by the outer array."""
    def keep(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), keep), F.lit(0))


def cleaned(docs: DataFrame, text: str, lines: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of `docs` plus the shortened text and the dropped line numbers (null if none),
    under the two names given, which must be free."""
    gone = dropped(docs, min_docs).select(F.col("row").alias("_row"), F.col("lines").alias("_lines"))
    joined = docs.alias("d").join(
        gone, F.xxhash64("d.doc_id", "d.text") == F.col("_row"), "left")
    short = F.when(F.col("_lines").isNull(), F.col("d.text")).otherwise(
        _rest(F.col("d.text"), F.col("_lines")))
    return joined.select("d.*", short.alias(text), F.col("_lines").alias(lines))
