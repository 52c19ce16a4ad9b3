"""Tables of experiment results: writing, reading back many files, counting finished tasks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, csv: bool = True) -> list[str]:
    """Write as Parquet, and as CSV beside it; the paths written."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return [f"{path}/parquet"] + [f"{path}/csv"] * csv


def read_all_results(spark: SparkSession, *paths: str) -> DataFrame:
    """All result tables of some folders, by the names of their columns, with ``file`` naming where each row is from.

    Columns that a table lacks are null. A folder that can't be read is left out with a warning.
    """
    frames = []
    for path in paths:
        try:
            frames.append(spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path).withColumn("file", F.col("_metadata.file_path")))
        except Exception as e:  # Spark's analysis errors differ by what is wrong with the folder
            spark._jvm.org.apache.log4j.LogManager.getLogger("strandmix").warn(f"left out {path}: {type(e).__name__}")
    if not frames:
        raise ValueError("no result table could be read")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def remove_files(spark: SparkSession, files: list[str]) -> None:
    """Delete files in any store that Spark reads."""
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def completed_tasks(done: DataFrame, n_total: int, id_col: str = "run_id") -> DataFrame:
    """One row: tasks with a result, all tasks, per cent with one decimal."""
    n = F.countDistinct(id_col)
    return done.agg(n.alias("n_completed"), F.lit(n_total).cast("long").alias("n_total"), F.round(100 * n / F.lit(float(max(1, n_total))), 1).alias("pct"))
