"""Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes that a worker turns into Python objects at once.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch between the JVM and a worker. Documents differ in length by orders of magnitude, so rows don't bound a batch.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame, in a session that bounds Arrow batches by BATCH_BYTES, unless it has a tighter bound."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name, None)).rstrip("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; in the end the memory that it freed goes back to the system, as workers outlive their tasks."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def chunks(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, id_col: str, text_col: str, rows: Callable[[list, list], dict], schema: str, id_type: str = "long") -> DataFrame:
    """``rows(ids, texts)`` over slices of the table; null texts reach it as None.

    The result has the id column first, as ``id_type``, then what ``rows`` returns: a dict of columns by the names in ``schema``.
    """
    kept = df.select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).cast("string").alias("text"))
    full = f"{id_col} {id_type}, {schema}"
    names = [id_col, *(part.split()[0] for part in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            ids = part.column(0)
            found = rows(ids.to_pylist(), part.column(1).to_pylist())
            columns = [ids, *(found[name] for name in names[1:])]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns], names=names)

    return bounded(kept).mapInArrow(tidied(run), full)


def byte_signs() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]
