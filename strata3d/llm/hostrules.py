"""Quality rules judged by host: failures are counted by domain, shrunk, and joined back.

Native throughout: column functions inside one row, two small aggregates, one join. A document
fails the base rules on its own words; a host's failure rate is drawn towards the rate of all by a
beta prior whose mean and strength come from the hosts themselves (method of moments, each host
weighted by its documents); documents of a host whose shrunk rate passes `max_rate` go as well.

Defined cases: a null text has no words (all counts 0, base rules failed); a source that is no
address is its own host; a null source has none, so `host_rate` is null and only the base rules
speak; null ids and repeated rows are counted and returned each; equal host rates (or one host) leave every host at the common rate; an empty
table gives an empty result. Only `doc_id`, `text` and `source` are read. Equal windows of five
words are recognised by a 64-bit hash inside one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata3d.session import stored

WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED = 20               # percent of the words
MAX_RATE = 0.5
#: White space between words, and the symbols counted.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once, also where `body` uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACES}]+"))


def repeated_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that the text holds more than once."""
    def keys(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["key"] == F.get(s, i - 1)["key"])
                        | (x["key"] == F.get(s, i + 1)["key"]))

    def covered(ks: Column) -> Column:
        placed = F.sort_array(F.transform(
            ks, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        starts = F.sort_array(F.transform(let(placed, twice), lambda x: x["at"]))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"),
                                  i.alias("last")), lambda a: a["n"])

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    found = let(let(hashes, keys), lambda ks: F.when(       # most texts repeat nothing
        F.size(F.array_distinct(ks)) < F.size(ks), covered(ks)).otherwise(0))
    return F.when(F.size(ws) > WINDOW, found).otherwise(0)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def measures(docs: DataFrame) -> DataFrame:
    """Counts and base verdict of every row, with its host."""
    text = F.coalesce("text", F.lit(""))
    named = F.lower(F.coalesce(F.try_parse_url(F.when(F.col("source").contains("://"), F.col("source")),
                                           F.lit("HOST")), "source"))
    counted = docs.select("doc_id", named.alias("host"), text.alias("text")).select(
        "doc_id", "host",
        let(words(F.col("text")), lambda ws: F.struct(
            F.size(ws).alias("n"), F.length(F.array_join(ws, "")).alias("chars"),
            repeated_words(ws).alias("again"))).alias("w"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"))
    n, again = F.col("w.n").cast("long"), F.col("w.again").cast("long")
    return counted.select(
        "doc_id", "host", n.alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"), F.col("n_dup_lines").cast("long"),
        again.alias("n_repeat_words"),
        ((n < FEWEST_WORDS) | (100 * again > MOST_REPEATED * n)).alias("base_failed"))


def host_rates(measured: DataFrame) -> DataFrame:
    """`host`, `n`, `failed` and the shrunk `host_rate` of every host."""
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    n, failed = F.col("n"), F.col("failed")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                      F.sum(failed * failed / n).alias("squares")).first()
    if not total["n"]:
        return hosts.withColumn("host_rate", F.lit(None).cast("double"))
    mean = total["failed"] / total["n"]
    var = total["squares"] / total["n"] - mean * mean      # of the rates, weighted by documents
    if var <= 1e-12:
        return hosts.withColumn("host_rate", F.lit(mean))
    strength = max(mean * (1 - mean) / var - 1, 0.0)
    return hosts.withColumn("host_rate", (failed + strength * mean) / (n + strength))


def judged(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, `host_rate` and `kept` of every row."""
    measured = stored(measures(docs))
    rates = stored(host_rates(measured).select("host", "host_rate"))
    bad = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return measured.join(rates, "host", "left").withColumn("kept", ~F.col("base_failed") & ~bad)
