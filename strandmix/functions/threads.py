"""Threads of numerical libraries: fits run many to a machine, so each should keep to few threads of its own."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What the libraries beneath numpy read when they are loaded.
VARIABLES = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "VECLIB_MAXIMUM_THREADS", "NUMEXPR_NUM_THREADS")


@contextmanager
def internal_threads(n: int, spark: SparkSession | None = None) -> Iterator[None]:
    """Within, libraries that are loaded get ``n`` threads, here and in Python workers that the session starts; before and after is as it was.

    Workers that run already keep their threads, as libraries read the variables once. ValueError for fewer than one thread.
    """
    if n != int(n) or n < 1:
        raise ValueError(f"threads must be a positive whole number, not {n!r}")
    places = [os.environ] + ([spark.sparkContext.environment] if spark is not None else [])
    before = [{k: place.get(k) for k in VARIABLES} for place in places]
    for place in places:
        place.update(dict.fromkeys(VARIABLES, str(int(n))))
    try:
        yield
    finally:
        for place, old in zip(places, before):
            for k, v in old.items():
                place.pop(k, None)
                if v is not None:
                    place[k] = v
