"""Hard negatives by a pivot table.

A vector x is augmented by sqrt(R² - |x|²), R the greatest length of all, an anchor q by 0. Then |q' - x'|² = |q|² + R² - 2 q·x, so
the greatest inner product is the least Euclidean distance, and the triangle inequality holds. A table stores each row's distances to a
few pivots. For an anchor, |d(q, p) - d(x, p)| and d(q, p) + d(x, p) over the pivots p bracket d(q, x), and with it the score. Rows
whose bracket can't matter go; the others' scores are computed exactly, as integers.

Rows are dealt out in blocks by nearest pivot, a large cell in several by hash, so a vector that repeats fills no task. Each anchor meets
each block once to find its positives, and once more, with the scores that it looks for, to find negatives; a block returns its first
few alone, and those of all blocks are ranked.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows with one id the one with the least (label,
vector) counts, so repeated rows count once. Ties go to the smaller id. Shorter vectors are filled up with zeros. Components beyond
±2^27 after scaling count as that, so that scores of up to 2^8 components stay within 63 bits. Labels are compared as text. An anchor
without positives, and a positive without negatives, have no rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmix.llm.batches import bounded, tidied
from strandmix.llm.storage import discard, written

#: Pivots; anchors that a task looks at together; rows of a block: ROWS times the root of all rows, within bounds.
PIVOTS, ANCHORS = 16, 32
ROWS, FEWEST, MOST = 8, 512, 65_536
#: Components are clipped to this.
LARGEST = 1 << 27


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component; null where a component is null or not finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(F.least(F.greatest(v * float(factor), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) from lists of numbers, filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Pivots:
    """The pivots, and brackets by them."""

    def __init__(self, vectors: np.ndarray, longest: float) -> None:
        self.vectors, self.squares, self.longest = vectors, (vectors**2).sum(axis=1), longest
        self.rest = np.sqrt(np.maximum(longest - self.squares, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """(rows, pivots): distances of augmented rows."""
        squares = (x**2).sum(axis=1)
        rest = np.sqrt(np.maximum(self.longest - squares, 0))
        return np.sqrt(np.maximum(squares[:, None] + self.squares - 2 * x @ self.vectors.T, 0) + (rest[:, None] - self.rest) ** 2)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        """(anchors, pivots): distances of augmented anchors."""
        return np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + self.squares - 2 * q @ self.vectors.T, 0) + self.rest**2)

    def brackets(self, q: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows) least and greatest possible scores, from the rows' stored distances; rounding is allowed for."""
        own = self.of_anchors(q)
        near, far = np.zeros((len(q), len(distances))), np.full((len(q), len(distances)), np.inf)
        for k in range(len(self.vectors)):
            column = distances[:, k]
            np.maximum(near, np.abs(own[:, k : k + 1] - column), out=near)
            np.minimum(far, own[:, k : k + 1] + column, out=far)
        both = ((q**2).sum(axis=1) + self.longest)[:, None]
        slack = 0.5 + 1e-9 * both
        return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def _exact(x: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """(anchors, rows) inner products of whole numbers, as integers."""
    if longest < 1 << 52:
        return np.rint(q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _first(scores: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows of the highest scores and those; of equals the first rows, which have the smaller ids."""
    if len(scores) > 4 * n:
        kept = scores >= np.partition(scores, len(scores) - n)[len(scores) - n]
        scores, rows = scores[kept], rows[kept]
    order = np.argsort(-scores, kind="stable")[:n]
    return rows[order], scores[order]


def _at_least(bounds: np.ndarray, n: int) -> float:
    """A score that n rows reach for certain, by their least scores."""
    return float(np.partition(bounds, len(bounds) - n)[len(bounds) - n]) if len(bounds) >= n else -np.inf


class _Block:
    """Rows of a block in the order of their ids, and what anchors find among them."""

    def __init__(self, pivots: _Pivots, batches: list[pa.RecordBatch], width: int) -> None:
        ids = np.concatenate([np.asarray(b.column("id")) for b in batches])
        order = np.argsort(ids)
        self.pivots, self.ids = pivots, ids[order]
        self.labels = np.concatenate([np.asarray(b.column("label"), dtype=object) for b in batches])[order]
        self.x = np.concatenate([_matrix(b.column("v"), width) for b in batches])[order]
        self.distances = np.concatenate([_matrix(b.column("distances"), len(pivots.vectors)) for b in batches])[order]

    def positives(self, ids, labels, q: np.ndarray, n: int) -> Iterator[tuple]:
        least, most = self.pivots.brackets(q, self.distances)
        chosen = []
        for i, (own, label) in enumerate(zip(ids, labels)):
            same = (self.labels == label) & (self.ids != own)
            chosen.append(same & (most[i] >= _at_least(least[i][same], n)))
        yield from ((i, *found) for i, found in self._check(chosen, q, n))

    def _check(self, chosen: list[np.ndarray], q: np.ndarray, n: int) -> Iterator[tuple[int, tuple]]:
        some = np.flatnonzero(np.logical_or.reduce(chosen))
        scores = _exact(self.x[some], q, self.pivots.longest)
        for i, mask in enumerate(chosen):
            own = np.flatnonzero(mask[some])
            if len(own):
                rows, found = _first(scores[i][own], some[own], n)
                yield i, (self.ids[rows], found)

    def negatives(self, labels, q: np.ndarray, bands: list[list[tuple[int, int]]], n: int) -> Iterator[tuple]:
        """(anchor's place, positive's place, ids, scores) of the first n rows of another label within each band."""
        least, most = self.pivots.brackets(q, self.distances)
        chosen = []
        for i, label in enumerate(labels):
            other = self.labels != label
            needed = np.zeros(len(self.ids), dtype=bool)
            for low, high in bands[i]:
                possible = other & (most[i] >= low) & (least[i] <= high)
                certain = least[i][possible & (least[i] >= low) & (most[i] <= high)]
                needed |= possible & (most[i] >= _at_least(certain, n))
            chosen.append(needed)
        some = np.flatnonzero(np.logical_or.reduce(chosen))
        scores = _exact(self.x[some], q, self.pivots.longest)
        for i, mask in enumerate(chosen):
            own = np.flatnonzero(mask[some])
            values = scores[i][own]
            for k, (low, high) in enumerate(bands[i]):
                within = (values >= low) & (values <= high)
                if within.any():
                    rows, found = _first(values[within], some[own][within], n)
                    yield i, k, self.ids[rows], found


def _band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``anchor`` holds (an expression over ``id``)
    and each of its first rows of the same label, the first rows of other labels whose score is ``low`` to ``high`` per cent of the positive's.

    ``vector_col`` has arrays of whole numbers, as ``scaled`` gives.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).dropna()
    rows = written(taken.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one")).select("id", "one.label", "one.v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    count, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    width, longest = width or 0, longest or 0.0
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
    pivots = _Pivots(np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in picked], dtype=float).reshape(len(picked), width), longest)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.of_rows(_matrix(batch.column("v"), width))
            flat = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(d.argmin(axis=1), pa.int32())], names=["id", "label", "v", "distances", "cell"])

    shape = "id long, label string, v array<int>, distances array<double>, cell int"
    table = written(bounded(rows).mapInArrow(tidied(measure), shape)) if count else written(spark.createDataFrame([], shape))
    sizes = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}
    most = min(MOST, max(FEWEST, int(ROWS * count**0.5)))
    parts = [-(-sizes.get(k, 0) // most) for k in range(PIVOTS)]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    by_cell = lambda numbers: F.element_at(F.array(*(F.lit(int(x)) for x in numbers)), F.col("cell") + 1)
    blocks = table.withColumn("block", (by_cell(first[:-1]) + F.pmod(F.xxhash64("id"), F.greatest(by_cell(parts), F.lit(1)))).cast("int")).withColumn("kind", F.lit(0)).drop("cell")
    anchors = table.where(anchor).select("id", "label", "v")

    def meet(df: DataFrame, run, schema: str) -> DataFrame:
        """Every row of ``df`` with every block."""
        copies = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(first[-1] - 1, 0))))).withColumn("kind", F.lit(1))
        both = blocks.unionByName(copies, allowMissingColumns=True).repartition(max(first[-1], 1), "block").sortWithinPartitions("block", "kind")

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts, block = None, [], None
            for batch in batches:
                numbers, kinds = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
                edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                    if b <= a:
                        continue
                    if numbers[a] != now:
                        now, parts, block = numbers[a], [], None
                    if kinds[a] == 0:
                        parts.append(batch.slice(a, b - a))
                        continue
                    block = block or _Block(pivots, parts, width)
                    parts = []
                    for at in range(a, b, ANCHORS):
                        own = batch.slice(at, min(ANCHORS, b - at))
                        found = list(run(block, own, _matrix(own.column("v"), width)))
                        if found:
                            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*found)], names=[x.split()[0] for x in schema.split(", ")])

        return bounded(both).mapInArrow(tidied(over), schema)

    def near(block: _Block, own: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
        ids = own.column("id").to_pylist()
        for i, found, scores in block.positives(ids, own.column("label").to_pylist(), q, positives):
            yield np.full(len(found), ids[i]), found, scores

    def hard(block: _Block, own: pa.RecordBatch, q: np.ndarray) -> Iterator[tuple]:
        ids, known = own.column("id").to_pylist(), own.column("positives").to_pylist()
        bands = [[_band(p["score"], low, high) for p in row] for row in known]
        for i, k, found, scores in block.negatives(own.column("label").to_pylist(), q, bands, negatives):
            yield np.full(len(found), ids[i]), np.full(len(found), known[i][k]["id"]), np.full(len(found), known[i][k]["score"]), found, scores

    best = lambda keys, score, other: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
    nearest = meet(anchors, near, "id long, positive_id long, score long").withColumn("rank", best(["id"], "score", "positive_id")).where(f"rank <= {int(positives)}")
    with_positives = anchors.join(nearest.groupBy("id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives")), "id")
    asked = written(with_positives)
    found = meet(asked, hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = found.withColumn("rank", best(["anchor_id", "positive_id"], "negative_score", "negative_id")).where(f"rank <= {int(negatives)}")
    out = written(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(rows, table, asked)
    return out


#: The contract's figures: every 7th row's label is moved by one, every 100th row is an anchor, components are whole 256ths.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 10
"""
