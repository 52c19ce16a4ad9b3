"""Bounded samples of labelled rows for fitting; nothing but fits uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that hashes are compared in.
PARTS = 1 << 30


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of a number as text, modulo; null where the number is null."""
    return F.crc32(F.col(col).cast("long").cast("string").cast("binary")) % mod


def hashed_share(df: DataFrame, id_col: str, label_col: str, per_label: int) -> tuple[DataFrame, dict]:
    """The rows, and the number of rows of each label in all. The rows: about ``per_label`` rows of each label, by a hash of the id; all rows of a label with fewer.

    One aggregation counts the labels; no row is sorted or sent anywhere. Labels are classes, so there are few.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect() if r[0] is not None}
    keep = F.lit(False)
    for label, n in sorted(counts.items()):
        keep = keep | ((F.col(label_col) == F.lit(label)) & (F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(PARTS)) < int(PARTS * min(1.0, per_label / n))))
    return df.where(keep), counts
