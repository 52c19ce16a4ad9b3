"""Queries by name, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Decimals of doubles in results; sums differ beyond them by the order of their terms.
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to DECIMALS."""
    return df.select(*(F.round(c, DECIMALS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, its doubles rounded; ``sql`` rounds by itself."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return register


def r(expression: str, name: str) -> str:
    """SQL: rounded, without a negative zero."""
    return f"round({expression}, {DECIMALS}) + 0.0 AS {name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The panels as SQL. The factor keeps figures off the halves at which engines round apart.
EV = "ev AS (SELECT user_id AS subject_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS t, value * 1.0123457 AS x FROM events)"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice"
LI = f"li AS (SELECT l_suppkey AS subject_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS INTEGER) AS t, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax FROM lineitem)"
LS = f"ls AS (SELECT l_suppkey AS subject_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) AS INTEGER) AS t, l_quantity / 50 AS qty, l_extendedprice / 99991 AS price, l_discount * 10 AS disc, l_tax * 10 AS tax FROM lineitem)"
CHANNELS = ("qty", "price", "disc", "tax")
