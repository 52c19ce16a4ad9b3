"""Joins with a side that is broadcast only when it has been counted and is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.llm.storage import written

#: Rows of a few short columns that may be broadcast: some tens of MB.
SMALL = 500_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The frame as a table in the shared folder, and its number of rows, which the table's footers have."""
    kept = written(df)
    return kept, kept.count()


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join by broadcast when ``right`` has at most SMALL rows, else by shuffle, where adaptive execution splits hot keys."""
    return left.join(F.broadcast(right) if rows <= SMALL else right.hint("merge"), on, how)
