"""Kendall's tau-b without pairs as rows.

Values are cut into blocks by quantiles, in x and in y. A pair is discordant if x rises and y falls. If both blocks differ, the numbers of rows
by block of x and of y tell; within a block of x, and within a block of y among different blocks of x, tasks count by sorting. Ties are
counts of equal values. So n rows cost n log n, and a task holds a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of each side.
BLOCKS = 64


def inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], from the highest bit of the ranks down: within equal higher bits, a one before a zero."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1) if len(rank) else ():
        order = np.argsort(rank >> (bit + 1), kind="stable")
        own = rank[order]
        ones = (own >> bit) & 1
        before = np.cumsum(ones) - ones
        first = np.concatenate([[True], (own[1:] >> (bit + 1)) != (own[:-1] >> (bit + 1))])
        start = before[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        total += int(((before - start) * (1 - ones)).sum())
    return total


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x[i] < x[j] and y[i] > y[j]."""
    return inversions(y[np.lexsort((y, x))])


def kendall(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", blocks: int = BLOCKS) -> DataFrame:
    """(keys, corr): tau-b of x and y over the rows of each group, null where x or y doesn't vary. Rows with a null value are left out."""
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    shares = [k / blocks for k in range(1, blocks)]
    edges = rows.groupBy(*keys).agg(*(F.array_distinct(F.percentile_approx(c, shares, 20 * blocks)).alias(f"e_{c}") for c in ("x", "y")))
    at = lambda c: F.size(F.filter(f"e_{c}", lambda e: e < F.col(c))).alias(f"b_{c}")
    placed = rows.join(edges, keys).select(*keys, "x", "y", at("x"), at("y"))
    out = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys) + ", d long"

    def counted(key, value):
        return pd.DataFrame([[*key[: len(keys)], value]], columns=[*keys, "d"])

    within = placed.groupBy(*keys, "b_x").applyInPandas(lambda key, part: counted(key, discordant(part["x"].to_numpy(), part["y"].to_numpy())), out)
    beside = placed.groupBy(*keys, "b_y").applyInPandas(lambda key, part: counted(key, discordant(part["b_x"].to_numpy(), part["y"].to_numpy())), out)

    def apart(key, part):
        table = np.zeros((blocks, blocks), dtype=object)
        for i, j, n in zip(part["b_x"], part["b_y"], part["n"]):
            table[i, j] = int(n)
        lower = np.cumsum(np.cumsum(table, axis=0), axis=1)  # rows of blocks up to i of x and j of y
        total = sum(table[i, j] * (lower[i - 1, -1] - lower[i - 1, j]) for i in range(1, blocks) for j in range(blocks) if table[i, j])
        return counted(key, int(total))

    cells = placed.groupBy(*keys, "b_x", "b_y").agg(F.count("*").alias("n")).groupBy(*keys).applyInPandas(apart, out)
    falls = within.unionByName(beside).unionByName(cells).groupBy(*keys).agg(F.sum("d").alias("d"))
    pairs = lambda n: F.sum((F.col(n).cast("double") * (F.col(n) - 1)) / 2)
    ties = lambda columns, name: rows.groupBy(*keys, *columns).agg(F.count("*").alias("n")).groupBy(*keys).agg(pairs("n").alias(name))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, (F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("all"))
    joined = whole.join(ties(["x"], "tx"), keys).join(ties(["y"], "ty"), keys).join(ties(["x", "y"], "txy"), keys).join(falls, keys)
    score = F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    return joined.select(*keys, F.try_divide(score, F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))).alias("corr"))
