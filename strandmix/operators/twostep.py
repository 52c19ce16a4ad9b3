"""The two-step baseline on the cluster: each subject's own loadings, clusters of these, and a vote per subject.

Loadings are eigenvectors of all correlation matrices of a block at once, computed from the subjects' statistics, ordered and signed like
a reference subject's. Their N x r vectors stay where they are: k-means sends centres out and gets sums back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import baselines as B
from strandmix.operators import fits as T
from strandmix.operators import suffstats as S
from strandmix.operators.suffstats import Stats


@dataclass(frozen=True)
class TwoStep:
    """Bases of the clusters (None without subjects), error and VAF of all subjects, and the assignments (subject_id, z from 1)."""

    bases: tuple[np.ndarray | None, ...]
    sse: float
    vaf: float
    assignments: DataFrame


def _stats(ids: np.ndarray, x: np.ndarray, m: int, centre: np.ndarray) -> Stats:
    return Stats(ids, x[:, 0], x[:, 1 : m + 1], S.upper_to_full(x[:, m + 1 : 1 + m + m * (m + 1) // 2], m), centre)


def unit_loadings(stats: Stats, r: int, method: str = "PCA") -> np.ndarray:
    """(N, M, r): unit loadings of each subject's standardised rows, an axis's largest entry positive."""
    corr, _ = B.standardised(stats)
    if method == "PCA":
        top = np.linalg.eigh(corr)[1][:, :, ::-1][:, :, :r]
        largest = np.take_along_axis(top, np.abs(top).argmax(axis=1)[:, None, :], axis=1)
        return top * np.where(largest < 0, -1.0, 1.0)
    found = L.fa_loadings(corr, r, 30)
    return found / np.maximum(np.sqrt((found**2).sum(axis=1, keepdims=True)), 1e-12)


@contextmanager
def bases(table: T.Table, sets: list[tuple[int, str]], align: bool = True) -> Iterator[T.Table]:
    """The table with each subject's loadings of each (r, method), column by column, behind its statistics; kept while the block runs. The subject with the least number is the reference."""
    m, centre = table.width, table.centre
    first = table.df.orderBy("subject_id").select("subject_id", "x").first()
    one = _stats(np.array([first[0]]), np.array([first[1]]), m, centre)
    targets = [unit_loadings(one, r, method) for r, method in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in T._blocks(batches):
            parts = [x]
            for (r, method), target in zip(sets, targets):
                own = unit_loadings(_stats(ids, x, m, centre), r, method)
                if align:
                    own = B.align_bases(np.concatenate([target, own]))[1:]
                parts.append(own.transpose(0, 2, 1).reshape(len(ids), -1))
            wide = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(np.arange(0, wide.size + 1, wide.shape[1], dtype=np.int32), pa.array(wide.ravel()))], names=["subject_id", "x"])

    kept = table.df.select("subject_id", "x").mapInArrow(run, "subject_id long, x array<double>").persist()
    try:
        yield replace(table, df=kept)
    finally:
        kept.unpersist()


def _votes(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(N, r) nearest centres of each subject's vectors and (N,) the subject's label by ``baselines.majority``."""
    apart = np.stack([((vectors - c) ** 2).sum(axis=2) for c in centres], axis=2)
    labels, distance = apart.argmin(axis=2), np.sqrt(apart.min(axis=2))
    counts = np.stack([(labels == k).sum(axis=1) for k in range(len(centres))], axis=1)
    mean = np.stack([np.where(labels == k, distance, 0).sum(axis=1) for k in range(len(centres))], axis=1) / np.maximum(counts, 1)
    tied = counts == counts.max(axis=1, keepdims=True)
    return labels, np.where(tied, mean, np.inf).argmin(axis=1)


def two_step(table: T.Table, r: int, k: int, method: str = "PCA", seed: int = 0, refine: bool = False, align: bool = True) -> TwoStep:
    """``baselines.two_step`` for any number of subjects.

    The first centres come from k-means over at most ``fits.SAMPLE`` subjects, the first by a hash; then all vectors count until no centre
    moves, or for ``fits.KMEANS_ROUNDS`` rounds.
    """
    return two_steps(table, [(r, k, method)], seed, refine, align)[0]


def two_steps(table: T.Table, jobs: list[tuple[int, int, str]], seed: int = 0, refine: bool = False, align: bool = True) -> list[TwoStep]:
    """``two_step`` for each (r, K, method): loadings of all in one scan, and one scan a round for all of them."""
    m, centre = table.width, table.centre
    size = 1 + m + m * (m + 1) // 2
    sets = list(dict.fromkeys((r, method) for r, _, method in jobs))
    starts = dict(zip(sets, size + m * np.cumsum([0, *(r for r, _ in sets)])))
    columns = [slice(int(starts[r, method]), int(starts[r, method]) + r * m) for r, _, method in jobs]
    ends = np.cumsum([0, *(k for _, k, _ in jobs)]).tolist()
    with bases(table, sets, align) as own:
        sample = np.array([row[0] for row in own.df.orderBy(F.xxhash64("subject_id"), "subject_id").limit(T.SAMPLE).select("x").collect()])
        centres = []
        for (_, k, _), at in zip(jobs, columns):
            points = sample[:, at].reshape(-1, m)
            labels = L.kmeans(points, k, starts=20, seed=seed)
            centres.append(np.stack([points[labels == j].mean(axis=0) if (labels == j).any() else np.zeros(m) for j in range(k)]))
        live = list(range(len(jobs))) if table.subjects > T.SAMPLE else []
        for _ in range(T.KMEANS_ROUNDS):
            if not live:
                break

            def sums(ids, x, z0, now=tuple((columns[i], centres[i]) for i in live)):
                out = []
                for at, own_centres in now:
                    v = x[:, at].reshape(-1, m)
                    near = np.stack([((v - c) ** 2).sum(axis=1) for c in own_centres], axis=1).argmin(axis=1)
                    marks = np.eye(len(own_centres))[near]
                    out.append(np.column_stack([marks.sum(axis=0), marks.T @ v]))
                return np.concatenate(out)

            found = iter(T._summed(own, sums, sum(jobs[i][1] for i in live)))
            moved = []
            for i in live:
                sums_of = np.stack([next(found) for _ in range(jobs[i][1])])
                new = np.where(sums_of[:, :1] > 0, sums_of[:, 1:] / np.maximum(sums_of[:, :1], 1), centres[i])
                if not np.allclose(new, centres[i], rtol=0, atol=1e-9):
                    moved.append(i)
                centres[i] = new
            live = moved

        width = m * max(r for r, _, _ in jobs)

        def mean_basis(ids, x, z0):
            out = np.zeros((ends[-1], 1 + width))
            for (r, k, _), at, own_centres, row in zip(jobs, columns, centres, ends):
                marks = np.eye(k)[_votes(x[:, at].reshape(len(ids), r, m), own_centres)[1]]
                out[row : row + k, 0] = marks.sum(axis=0)
                out[row : row + k, 1 : 1 + r * m] = marks.T @ x[:, at]
            return out

        total, found = T._summed(own, mean_basis, ends[-1]), []
        for (r, k, _), row in zip(jobs, ends):
            means = [(v[1 : 1 + r * m] / v[0]).reshape(r, m).T if v[0] > 0 else None for v in total[row : row + k]]
            found.append(tuple(L.top_eigen(b @ b.T, r)[1] if b is not None else None for b in means))
        told = list(zip([r for r, _, _ in jobs], columns, centres, found))

        def labelled(ids: np.ndarray, x: np.ndarray, r: int, at: slice, own_centres: np.ndarray, own_bases: tuple) -> tuple[np.ndarray, np.ndarray]:
            """Labels from 0, and the squared errors of their bases."""
            z = _votes(x[:, at].reshape(len(ids), r, m), own_centres)[1]
            stats = _stats(ids, x, m, centre)
            corr, sd = B.standardised(stats)
            errors = np.full((len(ids), len(own_bases)), np.inf)
            for j, basis in enumerate(own_bases):
                if basis is not None:
                    a = sd[:, :, None] * (np.eye(m) - basis @ np.linalg.pinv(basis))
                    errors[:, j] = ((a @ (corr * np.maximum(stats.n - 1, 0)[:, None, None])) * a).sum(axis=(1, 2))
            z = errors.argmin(axis=1) if refine else z
            return z, errors[np.arange(len(ids)), z]

        sse = T._summed(own, lambda ids, x, z0: np.array([[labelled(ids, x, *one)[1].sum() for one in told]]), 1)[0]
        _, mean, cov = T._pooled(table)
        sst = float(np.trace(cov)) * table.rows

        def assigned(one: tuple) -> DataFrame:
            def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for ids, x, _ in T._blocks(batches):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((labelled(ids, x, *one)[0] + 1).astype(np.int32))], names=["subject_id", "z"])

            return own.df.mapInArrow(assign, "subject_id long, z int")

        return [TwoStep(one[3], float(e), 1 - float(e) / sst if sst else float("nan"), assigned(one)) for one, e in zip(told, sse)]
