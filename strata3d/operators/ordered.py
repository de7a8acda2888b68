"""Ordering inside groups without ever putting one whole group into one task.

A window partitioned by the group alone would sort a parcel or building that holds a third
of all rows on one executor. Here rows are first cut by their dense ordinal into buckets of
at most 65,536, worked on per (group, bucket), and only one summary row per bucket meets the
rest of its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BUCKET_BITS = 16
#: Rows up to which a group is ordered whole: as many as a bucket holds.
WHOLE_GROUP = 1 << BUCKET_BITS
#: Bits below the partition in `monotonically_increasing_id`.
RANGE_BITS = 33


def position_in_group(df: DataFrame, keys: list[str], ord_col: str, out: str,
                      among: DataFrame | None = None) -> DataFrame:
    """Add `out`: 0-based position of the row in its group by unique bigint `ord_col`.

    Groups no larger than a bucket are numbered in one exchange on their keys; only larger ones
    are cut by ordinal. Large groups are counted in `among` (`df` by default), which has at least
    the rows of `df` and may be cheaper to read.
    """
    crowd, crowded = _crowd(df if among is None else among, keys), _same(keys)
    whole = df.join(crowd, crowded, "left_anti").withColumn(
        out, F.row_number().over(Window.partitionBy(*keys).orderBy(ord_col)).cast("bigint") - 1)
    large = df.join(crowd, crowded, "left_semi").withColumn(
        "_bucket", F.shiftright(F.col(ord_col), BUCKET_BITS))
    offset = (large.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(
                  Window.partitionBy(*keys).orderBy("_bucket")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select(*[F.col(c).alias(f"_{c}") for c in (*keys, "_bucket")], "_before"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(ord_col)
    cut = (large.withColumn("_local", F.row_number().over(local) - 1)
           .join(offset, _same([*keys, "_bucket"]))
           .withColumn(out, F.col("_before") + F.col("_local")))
    return whole.unionByName(cut.select(*whole.columns))


def _crowd(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, after an underscore each, of the groups larger than a bucket: written, so that Spark
    knows how few they are before rows move."""
    return stored(df.groupBy(*keys).agg(F.count("*").alias("_n"))
                  .filter(F.col("_n") > WHOLE_GROUP)
                  .select(*[F.col(k).alias(f"_{k}") for k in keys]))


def _same(columns: list[str]) -> Column:
    """Null-safe equality of each column with its namesake after an underscore."""
    return reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def place_by_text(df: DataFrame, keys: list[str], text: str, out: str,
                  lead: tuple[Column, ...] = ()) -> DataFrame:
    """Add `out`: dense 0-based place in the group by `lead`, then by the unique string `text`.

    Rows are cut into ranges of (keys, lead, text) and numbered inside each; a group then only sums
    the counts of the ranges it lies in. The ranges come from a sample, so numbered rows are written
    once: a task run again must not see other ranges.
    """
    named = [f"_lead{i}" for i in range(len(lead))]
    order = [*keys, *named, text]
    cut = df.select("*", *[c.alias(n) for c, n in zip(lead, named)])
    number = F.monotonically_increasing_id()
    ranged = stored(cut.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", number).withColumn("_range", F.shiftright("_at", RANGE_BITS)))
    starts = ranged.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)) - F.col("_first"))
    starts = starts.select(*[F.col(c).alias(f"{c}_b") for c in (*keys, "_range")], "_before")
    same = F.col("_range") == F.col("_range_b")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return ranged.join(starts, same).select(*[F.col(c) for c in df.columns if c != out],
                                            (F.col("_before") + F.col("_at")).alias(out))


def first_per_key(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """Whole row that comes first (or last) per key, by partial aggregation, not a window."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), order)
    return (df.groupBy(*keys).agg(pick.alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
            .select(*df.columns))


def neighbours(df: DataFrame, keys: list[str], index: str, ord_col: str,
               payload: list[str]) -> DataFrame:
    """Consecutive rows of each group by (int `index`, bigint `ord_col`): structs prev, cur.

    Groups no larger than a bucket are ordered in one exchange on their keys. Larger ones take
    three bounded steps: rows of one index value cut by ordinal; the pieces of one index
    range (256 values); the ranges of one group. Each step hands only its first and last
    row upwards, each once, so copies piled on one index and very tall groups both stay spread out.
    """
    crowd, crowded = _crowd(df, keys), _same(keys)
    row = F.struct(*payload)
    base = df.select(*keys, F.col(index).alias("_i"), F.col(ord_col).alias("_o"),
                     F.shiftright(F.col(ord_col), BUCKET_BITS).alias("_b"), row.alias("_r"),
                     F.lit(True).alias("_starts"))

    def step(rows, part, order):
        """Pairs that end at a row where a lower piece starts, and the ends of each part."""
        w = Window.partitionBy(*keys, *part).orderBy(*order)
        # both uses read this one exchange
        seen = (rows.repartition(*keys, *part).withColumn("_p", F.lag("_r").over(w))
                .withColumn("_n", F.lead("_r").over(w)))
        pairs = seen.filter("_starts and _p is not null").select(
            *keys, F.col("_p").alias("prev"), F.col("_r").alias("cur"))
        ends = seen.filter("_p is null or _n is null").withColumn(
            "_starts", F.col("_starts") & F.col("_p").isNull())
        return pairs, ends.drop("_p", "_n")

    # a number leads the sort: texts are compared only where it ties
    whole = (base.join(crowd, crowded, "left_anti").withColumn("_p", F.lag("_r").over(
        Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("_i", "_o")))
        .filter("_p is not null").select(*keys, F.col("_p").alias("prev"), F.col("_r").alias("cur")))
    inner, ends = step(base.join(crowd, crowded, "left_semi"), ["_i", "_b"], ["_o"])
    ends = ends.withColumn("_g", F.floor(F.col("_i") / 256))
    middle, ends = step(ends, ["_g"], ["_i", "_o"])
    outer, _ = step(ends, [], ["_i", "_o"])
    return whole.unionByName(inner).unionByName(middle).unionByName(outer)
