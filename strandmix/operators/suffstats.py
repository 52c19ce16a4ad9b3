"""Per-subject sufficient statistics: one aggregation that every fit, likelihood and error works from.

A subject is (n, s, Q): rows, sums and sums of products. Sums are taken about a common centre, the panel's means, so that covariances
don't cancel. Rows with a missing channel are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmix.operators.blocks import over_neighbours
from strandmix.sources.panel import Panel

#: Channels up to which sums of products are single aggregates; more are summed as matrices of a partition.
WIDE = 20


def moments(panel: Panel, centre: list[float] | None = None) -> DataFrame:
    """(subject_id, n, s array, q array): q is the upper triangle, row by row. Partial sums combine before the shuffle."""
    m = len(panel.channels)
    centre = centre or [0.0] * m
    whole = panel.df.dropna(subset=list(panel.channels))
    if m > WIDE:
        return _moments_by_matrix(panel.with_df(whole), centre)
    x = [F.col(c) - F.lit(float(v)) for c, v in zip(panel.channels, centre)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(m) for j in range(i, m)]
    table = whole.groupBy("subject_id").agg(F.count("*").alias("n"), *sums)
    return table.select("subject_id", "n", F.array(*(f"s{i}" for i in range(m))).alias("s"), F.array(*(f"q{i}_{j}" for i in range(m) for j in range(i, m))).alias("q"))


def _moments_by_matrix(panel: Panel, centre: list[float]) -> DataFrame:
    m, channels = len(panel.channels), list(panel.channels)
    upper, about = np.triu_indices(m), np.array(centre)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            order = np.argsort(ids, kind="stable")
            x = np.column_stack([np.asarray(batch.column(k + 1), dtype=float) for k in range(m)])[order] - about
            cuts = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]])) if len(ids) else order
            sums = [np.concatenate([[b - a], x[a:b].sum(axis=0), (x[a:b].T @ x[a:b])[upper]]) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][cuts]), pa.array(sums, type=pa.list_(pa.float64()))], names=["subject_id", "v"])

    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    parts = panel.df.select("subject_id", *channels).mapInArrow(partial, "subject_id long, v array<double>")
    total = parts.groupBy("subject_id").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))
    return total.select("subject_id", F.col("v")[0].cast("long").alias("n"), F.slice("v", 2, m).alias("s"), F.slice("v", m + 2, len(upper[0])).alias("q"))


@dataclass(frozen=True)
class Stats:
    """The statistics of all subjects as arrays: n (N), s (N, M), Q (N, M, M), about ``centre``."""

    ids: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    centre: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def width(self) -> int:
        """Number of channels."""
        return self.s.shape[1]

    def pick(self, index) -> Stats:
        """Some subjects, also repeatedly."""
        return Stats(self.ids[index], self.n[index], self.s[index], self.q[index], self.centre)

    def pooled(self, weights: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, mean and covariance (over n) of all rows, a subject's rows weighted alike; the mean is in the channels' own units."""
        w = np.ones(len(self)) if weights is None else np.asarray(weights, dtype=float)
        n = float((w * self.n).sum())
        if n <= 0:
            return 0.0, self.centre.copy(), np.zeros((self.width, self.width))
        mean = (w[:, None] * self.s).sum(axis=0) / n
        cov = np.einsum("i,ijk->jk", w, self.q) / n - np.outer(mean, mean)
        return n, mean + self.centre, (cov + cov.T) / 2

    def scatter(self, mean: np.ndarray) -> np.ndarray:
        """(N, M, M): each subject's sum of (x - mean)(x - mean)'."""
        mu = np.asarray(mean) - self.centre
        cross = np.einsum("ij,k->ijk", self.s, mu)
        return self.q - cross - cross.transpose(0, 2, 1) + self.n[:, None, None] * np.outer(mu, mu)

    def raw_squares(self) -> np.ndarray:
        """(N,): each subject's sum of squares about 0."""
        return np.trace(self.scatter(np.zeros(self.width)), axis1=1, axis2=2)


def upper_to_full(q: np.ndarray, m: int) -> np.ndarray:
    """(N, M, M) from rows of upper triangles."""
    out = np.zeros((len(q), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = q
    out[:, j, i] = q
    return out


#: Bytes of statistics that may come to the driver, as matrices.
DRIVER_BYTES = 1 << 30


def collectable(width: int, limit: int = DRIVER_BYTES) -> int:
    """Subjects of so many channels whose statistics fit into ``limit`` bytes."""
    return max(1, limit // (8 * (width * width + width + 2)))


def collect(panel: Panel, limit: int = DRIVER_BYTES) -> Stats:
    """The statistics on the driver, by subject. ValueError beyond ``limit`` bytes: larger panels stay on the cluster, in ``fits.statistics``.

    Two passes: the panel's means as centre, then the sums about them.
    """
    max_subjects = collectable(len(panel.channels), limit)
    means = panel.df.dropna(subset=list(panel.channels)).agg(*(F.avg(c).alias(c) for c in panel.channels)).first()
    centre = np.array([x if x is not None else 0.0 for x in means], dtype=float)
    table = moments(panel, centre.tolist())
    rows = table.limit(max_subjects + 1).collect()
    if len(rows) > max_subjects:
        raise ValueError(f"more than {max_subjects} subjects of {len(panel.channels)} channels: use operators.fits, where they stay on the cluster")
    rows.sort(key=lambda r: r[0])
    m = len(panel.channels)
    s = np.array([r[2] for r in rows], dtype=float).reshape(-1, m)
    q = np.array([r[3] for r in rows], dtype=float).reshape(-1, m * (m + 1) // 2)
    return Stats(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float), s, upper_to_full(q, m), centre)


def from_arrays(series: list[np.ndarray]) -> Stats:
    """The statistics of series in memory, numbered from 1."""
    centre = np.concatenate(series).mean(axis=0)
    moved = [x - centre for x in series]
    return Stats(np.arange(1, len(series) + 1), np.array([len(x) for x in series], dtype=float), np.stack([x.sum(axis=0) for x in moved]), np.stack([x.T @ x for x in moved]), centre)


def subject_moments(panel: Panel) -> DataFrame:
    """(subject_id, n, mean and population variance and covariance per channel) in named columns."""
    c = panel.channels
    pairs = [(a, b) for k, a in enumerate(c) for b in c[k:]]
    return panel.df.groupBy("subject_id").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"mean_{x}") for x in c), *(F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs))


def pooled_covariance(panel: Panel) -> DataFrame:
    """(row_channel, col_channel, value) of the population covariance over all rows, one aggregation."""
    c = panel.channels
    pairs = [(a, b) for k, a in enumerate(c) for b in c[k:]]
    one = panel.df.agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "value")
    return long.select(F.split("pair", r"\|")[0].alias("row_channel"), F.split("pair", r"\|")[1].alias("col_channel"), "value")


def total_squares(panel: Panel, kind: str = "raw", clusters: DataFrame | None = None) -> DataFrame:
    """One row (one per cluster): the sum of squares about 0, about the means of all rows, or about the means of each cluster (subject_id, z)."""
    cells = lambda x: sum(x, F.lit(0.0))
    if kind == "raw":
        return panel.df.agg(cells(F.sum(F.col(c) * F.col(c)) for c in panel.channels).alias("sst"))
    about = cells(F.var_pop(c) * F.count(c) for c in panel.channels).alias("sst")
    if kind == "global":
        return panel.df.agg(about)
    if kind == "cluster":
        return panel.df.join(clusters, "subject_id").groupBy("z").agg(F.count("*").alias("n"), about)
    raise ValueError(f"unknown kind {kind!r}")


def mean_variance_features(panel: Panel) -> DataFrame:
    """Per subject: mean and sample variance of each channel."""
    return panel.df.groupBy("subject_id").agg(*(F.avg(c).alias(f"mean_{c}") for c in panel.channels), *(F.var_samp(c).alias(f"var_{c}") for c in panel.channels))


def second_differences(panel: Panel) -> DataFrame:
    """The panel with each channel replaced by its second difference in time; the first two rows of a subject are null."""
    second = lambda w: [(F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)).alias(c) for c in panel.channels]
    return over_neighbours(panel, 2, 0, second)


def smoothness(panel: Panel) -> DataFrame:
    """(subject_id, penalty): sum of squared second differences over channels; 0 for fewer than three rows."""
    d = second_differences(panel)
    return d.groupBy("subject_id").agg(F.coalesce(F.sum(sum((F.coalesce(F.col(c) * F.col(c), F.lit(0.0)) for c in panel.channels), F.lit(0.0))), F.lit(0.0)).alias("penalty"))


def to_frame(spark: SparkSession, stats: Stats) -> DataFrame:
    """The statistics as a table again."""
    i, j = np.triu_indices(stats.width)
    return spark.createDataFrame([(int(a), float(n), s.tolist(), q[i, j].tolist()) for a, n, s, q in zip(stats.ids, stats.n, stats.s, stats.q)], "subject_id long, n double, s array<double>, q array<double>")
