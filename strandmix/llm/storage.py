"""Tables written to the shared folder of the cluster, which cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which driver and executors must share.

    Where it is unset and everything runs in the driver, as in tests, a local folder of its own. ValueError where it is unset on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^-]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="strandmix-")
    return found.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted when it ends, not when the driver's garbage happens to be collected."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def _place(df: DataFrame, path: str):
    found = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, which goes when the driver ends, or before by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandmix/{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    place, system = _place(df, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandmix_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave. What is still to be computed must not read them."""
    for df in tables:
        place, system = _place(df, df._strandmix_path)
        system.delete(place, True)
