"""Series cut into blocks of time, so that no task need have a whole series.

Times are row numbers, so a row's block is its number divided by the block's size. Windows need a few rows of the blocks beside; these are
copied there, and only a block's own rows are kept. Where a panel's partitions have whole series already, Spark sees that blocks lie within
and shuffles nothing; else subjects and blocks are dealt out together, and a subject with most rows is on all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.sources.panel import Panel

#: Rows of a block.
SIZE = 1 << 16


def with_blocks(df: DataFrame, back: int, ahead: int, size: int = SIZE) -> DataFrame:
    """The rows with their block, and copies of rows that the block behind or before needs: block__, and own__ for a block's own rows."""
    size = max(size, 4 * max(back, ahead))
    at, place = F.floor((F.col("t") - 1) / size).cast("long"), F.pmod(F.col("t") - 1, F.lit(size))
    copies = [at]
    if back:
        copies.append(F.when(place >= size - back, at + 1))
    if ahead:
        copies.append(F.when((place < ahead) & (at > 0), at - 1))
    cut = df.withColumn("block__", F.explode(F.array_compact(F.array(*copies))) if len(copies) > 1 else at)
    return cut.withColumn("own__", F.col("block__") == at)


def over_neighbours(panel: Panel, back: int, ahead: int, columns: Callable[[W], list[Column]], size: int = SIZE) -> DataFrame:
    """(subject_id, t, ...) with ``columns`` over a window of a subject's rows in time order; they look at no more than ``back`` and ``ahead`` rows."""
    cut = with_blocks(panel.df, back, ahead, size)
    time = W.partitionBy("subject_id", "block__").orderBy("t")
    return cut.select("subject_id", "t", *columns(time), "own__").where("own__").drop("own__")
