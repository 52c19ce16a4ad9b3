"""Panels: collections of multichannel series as a table of subject, time and one double column per channel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    """``df`` has ``subject_id``, ``t`` (1, 2, ... within a subject) and the channels as doubles; missing values are null, never NaN.

    ``whole``: each partition of ``df`` has all rows of its subjects, as after a window over them, so no shuffle need bring them together.
    """

    df: DataFrame
    channels: tuple[str, ...]
    whole: bool = False

    def with_df(self, df: DataFrame, whole: bool = False) -> Panel:
        """The same channels over another table; ``whole`` where only columns of the same rows are new."""
        return Panel(df, self.channels, whole and self.whole)

    def in_order(self, *columns) -> DataFrame:
        """The columns, subject by subject in partitions that have all of a subject's rows, in time order."""
        kept = self.df.select("subject_id", "t", *columns)
        return (kept if self.whole else kept.repartition("subject_id")).sortWithinPartitions("subject_id", "t")

    def by_time(self):
        """The window of a subject's rows in time order."""
        return W.partitionBy("subject_id").orderBy("t")

    def long(self) -> DataFrame:
        """(subject_id, t, channel, value)."""
        return self.df.unpivot(["subject_id", "t"], list(self.channels), "channel", "value")


def as_number(col: Column) -> Column:
    """A double; NaN becomes null, so that aggregates skip it."""
    x = col.cast("double")
    return F.when(~F.isnan(x), x)


def bind(df: DataFrame, subject: str, order: list[str], channels: dict[str, Column | str]) -> Panel:
    """A panel from any table. ``order`` must be total within a subject: times are row numbers over it."""
    picked = [as_number(F.col(x) if isinstance(x, str) else x).alias(name) for name, x in channels.items()]
    t = F.row_number().over(W.partitionBy("subject_id").orderBy(*order)).alias("t")
    keyed = df.withColumn("subject_id", F.col(subject).cast("long"))
    return Panel(keyed.select("subject_id", t, *picked), tuple(channels), True)


#: Buckets of time that ``bind_spread`` cuts all rows into.
BUCKETS = 256


def bind_spread(df: DataFrame, subject: str, order: list[str], channels: dict[str, Column | str], buckets: int = BUCKETS) -> Panel:
    """``bind`` for panels in which one subject may have a large share of all rows: no window and no task has a subject's rows together.

    Rows fall into buckets by quantiles of the first column of ``order``, a number or a time that is never null. Rows are numbered within subject
    and bucket, after the number of the subject's rows in the buckets before. Rows that are equal in that column stay in one bucket.
    """
    first = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    number = first.cast("timestamp").cast("double") if kind.startswith("timestamp") or kind == "date" else first.cast("double")
    edges = df.agg(F.percentile_approx(number, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] or []
    edges = sorted(set(edges))
    place = F.size(F.filter(F.lit(edges), lambda x: x < number)) if edges else F.lit(0)
    picked = [as_number(F.col(x) if isinstance(x, str) else x).alias(name) for name, x in channels.items()]
    keyed = df.withColumn("subject_id", F.col(subject).cast("long")).withColumn("bucket__", place)
    counts = keyed.groupBy("subject_id", "bucket__").agg(F.count("*").alias("n__"))
    earlier = F.coalesce(F.sum("n__").over(W.partitionBy("subject_id").orderBy("bucket__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("subject_id").alias("s__"), F.col("bucket__").alias("o__"), earlier.alias("before__"))
    within = F.row_number().over(W.partitionBy("subject_id", "bucket__").orderBy(*order))
    numbered = keyed.withColumn("at__", within).join(offsets, F.col("subject_id").eqNullSafe(F.col("s__")) & (F.col("bucket__") == F.col("o__")))
    return Panel(numbered.select("subject_id", (F.col("before__") + F.col("at__")).cast("int").alias("t"), *picked), tuple(channels))


def bind_unordered(df: DataFrame, subject: str, channels: dict[str, Column | str]) -> Panel:
    """A panel for operators that don't look at time: without ``t``, and without the sort that it costs."""
    picked = [as_number(F.col(x) if isinstance(x, str) else x).alias(name) for name, x in channels.items()]
    return Panel(df.select(F.col(subject).cast("long").alias("subject_id"), *picked), tuple(channels))


def events_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """One channel: the value of each user's events."""
    return bind(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], {"x": "value"})


def embeddings_panel(spark: SparkSession, sf_dir: str, width: int = 8) -> Panel:
    """The first components of the vectors of each label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return bind(df, "label", ["vec_id"], {f"ch_{k + 1}": F.col("embedding")[k] for k in range(width)})


#: Channels of the supplier panel, and what makes its order total.
LINE_CHANNELS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def lines_panel(spark: SparkSession, sf_dir: str, ordered: bool = True) -> Panel:
    """Quantity, price, discount and tax of each supplier's order lines."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return bind(df, "l_suppkey", LINE_ORDER, LINE_CHANNELS) if ordered else bind_unordered(df, "l_suppkey", LINE_CHANNELS)


def check_panel(panel: Panel, min_subjects: int = 1) -> DataFrame:
    """One row per subject with its rows and missing values; ValueError for too few subjects or channels that aren't numbers."""
    if not panel.channels:
        raise ValueError("a panel needs at least one channel")
    kinds = dict(panel.df.dtypes)
    if wrong := [c for c in panel.channels if kinds.get(c) != "double"]:
        raise ValueError(f"channels that aren't numbers: {', '.join(wrong)}")
    if min_subjects > 0 and panel.df.select("subject_id").distinct().limit(min_subjects).count() < min_subjects:
        raise ValueError(f"at least {min_subjects} subjects are needed")
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in panel.channels), F.lit(0))
    return panel.df.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum(missing).cast("long").alias("n_missing"))
