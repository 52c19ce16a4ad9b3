"""Streams of panel rows: per-subject statistics in event-time windows, sessions, and scoring without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmix.operators.mixture import Fit
from strandmix.operators.project import linear
from strandmix.operators.project import fa_scorer, ppca_scorer


def read_panel_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 0) -> DataFrame:
    """New Parquet files of a folder, or of a pattern of paths, as a stream; in batches of so many files, or (0) all at once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def windowed_moments(rows: DataFrame, subject: str, time: str, channels: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """n, sums and sums of products per subject and window; sums combine before the shuffle, state is one row per open window and subject."""
    sums = [F.sum(c).alias(f"s_{c}") for c in channels] + [F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for i, a in enumerate(channels) for b in channels[i:]]
    return rows.withWatermark(time, late).groupBy(F.window(time, width), F.col(subject).alias("subject_id")).agg(F.count("*").alias("n"), *sums).select("subject_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", *(s for s in [f"s_{c}" for c in channels] + [f"q_{a}_{b}" for i, a in enumerate(channels) for b in channels[i:]]))


def sessions(rows: DataFrame, subject: str, time: str, value: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows per subject without a longer pause: start, end, number and mean value."""
    found = rows.withWatermark(time, late).groupBy(F.session_window(time, gap), F.col(subject).alias("subject_id")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return found.select("subject_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "mean")


def score_rows(rows: DataFrame, fit: Fit, cluster: int = 1) -> DataFrame:
    """Each row with its factor scores under one cluster; nothing is kept between rows."""
    c = fit.components[cluster - 1]
    scorer = fa_scorer(c) if fit.kind == "mfa" else ppca_scorer(c)
    return rows.select("*", *(x.alias(f"f_{j + 1}") for j, x in enumerate(linear(fit.channels, scorer, c.mean))))
