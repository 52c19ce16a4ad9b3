"""Exact medians and other order statistics of groups of any size, by histograms that close in on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a histogram, and histograms before what is left is gathered: a value lies among a 16 millionth of its group's range by then.
BUCKETS, ROUNDS = 4096, 2

_KEYS = ["subject_id", "channel"]
#: SQL: of sorted (value, count) pairs ``own``, the value at a rank from 0.
_AT = "aggregate(own, struct(CAST(NULL AS DOUBLE) AS v, {rank} AS left), (a, x) -> if(a.v IS NULL AND x.n > a.left, struct(x.v AS v, a.left AS left), struct(a.v AS v, a.left - x.n AS left)), a -> a.v)"


def medians(long: DataFrame) -> DataFrame:
    """(subject_id, channel, median) of (subject_id, channel, value), missing values left out."""
    return between_ranks(long, F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)).select(*_KEYS, F.col("mean").alias("median"))


def mean_of_largest(long: DataFrame, percent: float) -> DataFrame:
    """(subject_id, channel, mean) of the largest values, so many per cent of a group's, rounded down, and one at least."""
    top = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))
    edge = between_ranks(long, F.col("n") - top, F.col("n") - top).select(*_KEYS, F.col("mean").alias("edge"), top.alias("top"))
    both = long.where("value IS NOT NULL").alias("rows").join(edge.alias("edges"), F.col("rows.subject_id").eqNullSafe(F.col("edges.subject_id")) & (F.col("rows.channel") == F.col("edges.channel")))
    more = F.when(F.col("value") > F.col("edge"), F.col("value"))
    sums = both.select("rows.subject_id", "rows.channel", "value", "edge", "top").groupBy(*_KEYS).agg(F.coalesce(F.sum(more), F.lit(0.0)).alias("s"), F.count(more).alias("k"), F.first("edge").alias("edge"), F.first("top").alias("top"))
    # What equals the edge fills up.
    return sums.select(*_KEYS, ((F.col("s") + (F.col("top") - F.col("k")) * F.col("edge")) / F.col("top")).alias("mean"))


def between_ranks(long: DataFrame, first: Column, second: Column) -> DataFrame:
    """(subject_id, channel, n, mean): the mean of the values at two ranks, from 0, given in terms of the group's size n; the second is at most one more.

    Each round counts values by bucket of the range that is left, with partial sums before the shuffle, and keeps the buckets with the
    two ranks. In the end distinct values of these are gathered with their counts: few, and never a group's rows.
    """
    rows = long.where("value IS NOT NULL").withColumnRenamed("value", "v")
    ranges = rows.groupBy(*_KEYS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    sizes = ranges.select(*_KEYS, "n")
    ranges = ranges.select(*_KEYS, "lo", "hi", first.alias("r1"), second.alias("r2"))

    def held(df: DataFrame) -> DataFrame:
        both = df.alias("rows").join(ranges.alias("ranges"), F.col("rows.subject_id").eqNullSafe(F.col("ranges.subject_id")) & (F.col("rows.channel") == F.col("ranges.channel")))
        return both.where("v BETWEEN lo AND hi").select("rows.subject_id", "rows.channel", "v", "lo", "hi", "r1", "r2")

    for _ in range(ROUNDS):
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(F.lit(0)).cast("int")
        counts = held(rows).groupBy(*_KEYS, place.alias("bucket")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
        upto = counts.withColumn("upto", F.sum("k").over(W.partitionBy(*_KEYS).orderBy("bucket")))
        chosen = upto.where("upto - k <= r2 AND upto > r1")
        below = F.min(F.col("upto") - F.col("k"))
        ranges = chosen.groupBy(*_KEYS).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.first("r1") - below).alias("r1"), (F.first("r2") - below).alias("r2"))
    values = held(rows).groupBy(*_KEYS, "v").agg(F.count("*").alias("n"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
    own = values.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("own"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
    found = own.select(*_KEYS, F.expr(f"({_AT.format(rank='r1')} + {_AT.format(rank='r2')}) / 2").alias("mean")).alias("found")
    return found.join(sizes.alias("sizes"), F.col("found.subject_id").eqNullSafe(F.col("sizes.subject_id")) & (F.col("found.channel") == F.col("sizes.channel"))).select("found.subject_id", "found.channel", "n", "mean")
