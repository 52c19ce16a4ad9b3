"""Mixtures of factor analysers and of probabilistic PCAs over whole series, fitted on sufficient statistics.

A series belongs to one cluster; given it, its rows are independent Gaussians. Hard fits assign each series to its best cluster, soft
fits weight all clusters. Every step needs only each series' (n, s, Q).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmix.functions import checks
from strandmix.functions import linalg as L
from strandmix.operators import suffstats as S
from strandmix.operators.suffstats import Stats
from strandmix.sources.panel import Panel

#: Added to priors before their logarithm is taken.
TINY = 1e-16


@dataclass(frozen=True)
class Fit:
    """A fitted mixture. ``z`` counts clusters from 1; ``resp`` is (N, K)."""

    kind: str
    ids: np.ndarray
    z: np.ndarray
    resp: np.ndarray
    pi: np.ndarray
    components: tuple[L.Component, ...]
    loglik: float
    rounds: int
    channels: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @property
    def n_clusters(self) -> int:
        """Number of clusters, empty ones too."""
        return len(self.components)

    @property
    def n_factors(self) -> int:
        """Number of factors."""
        return self.components[0].loadings.shape[1]

    def assignments(self, spark: SparkSession) -> DataFrame:
        """(subject_id, z)."""
        return spark.createDataFrame([(int(a), int(b)) for a, b in zip(self.ids, self.z)], "subject_id long, z int")

    def responsibilities(self, spark: SparkSession) -> DataFrame:
        """(subject_id, k, p)."""
        return spark.createDataFrame([(int(a), k + 1, float(p)) for a, row in zip(self.ids, self.resp) for k, p in enumerate(row)], "subject_id long, k int, p double")

    def loadings(self, spark: SparkSession) -> DataFrame:
        """(k, channel, factor, value), channels and factors from 1."""
        return spark.createDataFrame([(k + 1, i + 1, j + 1, float(v)) for k, c in enumerate(self.components) for i, row in enumerate(c.loadings) for j, v in enumerate(row)], "k int, channel int, factor int, value double")

    def parameters(self, spark: SparkSession) -> DataFrame:
        """(k, pi, mean array, noise array)."""
        return spark.createDataFrame([(k + 1, float(p), c.mean.tolist(), c.noise.tolist()) for k, (p, c) in enumerate(zip(self.pi, self.components))], "k int, pi double, mean array<double>, noise array<double>")


def round_robin(n: int, k: int) -> np.ndarray:
    """Labels 0, 1, ..., k-1, 0, 1, ..."""
    return np.arange(n) % k


def pca_features(stats: Stats, r: int) -> np.ndarray:
    """(N, r): each subject's mean in the axes of the pooled covariance."""
    _, mean, cov = stats.pooled()
    _, axes, _ = L.top_eigen(cov, r)
    return (stats.s / np.maximum(stats.n, 1)[:, None] + stats.centre - mean) @ axes


def kmeans_start(stats: Stats, k: int, r: int, seed: int = 0) -> np.ndarray:
    """Labels by k-means over pca_features."""
    return L.kmeans(pca_features(stats, r), k, seed=seed)


def _log_joint(stats: Stats, components, pi: np.ndarray, jitter: float = 0.0, tiny: float = TINY) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.stack([np.log(p + tiny) + L.log_likelihoods(stats.n, stats.scatter(c.mean), c.cov, jitter) for p, c in zip(pi, components)], axis=1)


def _posterior(joint: np.ndarray) -> tuple[np.ndarray, float]:
    total = L.log_sum_exp(joint)
    return np.exp(joint - total[:, None]), float(total.sum())


def _component(kind: str, stats: Stats, weights: np.ndarray, r: int, inner: int, method: str, estep: str) -> L.Component:
    n, mean, cov = stats.pooled(weights)
    if kind == "mfa":
        return L.fa_em(n, mean, cov, r, inner, estep)
    return L.ppca_closed(mean, cov, r) if method == "closed_form" else L.ppca_em(mean, cov, r, inner, estep)


def fit_once(stats: Stats, kind: str, n_clusters: int, n_factors: int, z_init: np.ndarray | None = None, em: str = "hard", max_iter: int = 50, inner: int = 20, tol: float = 1e-3, method: str = "EM", estep: str = "textbook", progress: Callable[[int, float], None] | None = None) -> Fit:
    """One start. From round 5 on, it ends when labels stay (hard) or the log likelihood moves by less than ``tol``.

    An empty cluster keeps its parameters, or starts from the pooled data. Ties go to the first cluster. The returned likelihood and
    responsibilities belong to the returned parameters.
    """
    checks.model_params(n_clusters, n_factors, 1, max_iter, tol)
    checks.fits_data(n_clusters, len(stats), n_factors, stats.width)
    z = round_robin(len(stats), n_clusters) if z_init is None else np.asarray(z_init, dtype=int)
    weights = np.eye(n_clusters)[z]
    components: list[L.Component | None] = [None] * n_clusters
    pi, last, rounds = np.full(n_clusters, 1 / n_clusters), -np.inf, 0
    for rounds in range(1, max_iter + 1):
        for k in range(n_clusters):
            if weights[:, k].sum() > 1e-10:
                components[k] = _component(kind, stats, weights[:, k], n_factors, inner, method, estep)
            elif components[k] is None:
                components[k] = _component(kind, stats, np.ones(len(stats)), n_factors, inner, method, estep)
        if em == "soft":
            pi = weights.mean(axis=0)
        joint = _log_joint(stats, components, pi, L.JITTER)
        if em == "hard":
            new = joint.argmax(axis=1)
            now = float(joint[np.arange(len(new)), new].sum())
            pi = np.bincount(new, minlength=n_clusters) / len(new)
            same, z, weights = bool((new == z).all()), new, np.eye(n_clusters)[new]
        else:
            weights, now = _posterior(joint)
            same = False
        if progress:
            progress(rounds, now)
        if rounds >= 5 and (same or abs(now - last) < tol):
            break
        last = now
    resp, loglik = _posterior(_log_joint(stats, components, pi))
    labels = resp.argmax(axis=1) if em == "soft" else z
    return Fit(kind, stats.ids, labels + 1, resp, pi, tuple(components), loglik, rounds)


def fit(stats: Stats, kind: str, n_clusters: int, n_factors: int, n_init: int = 1, use_kmeans: bool = True, kmeans_rdim: int | None = None, seed: int = 0, **options) -> Fit:
    """The best of several starts by likelihood, the first of equals: k-means, then ``n_init`` random ones; without k-means and with one start, round robin."""
    kind = checks.model_type(kind)
    checks.model_params(n_clusters, n_factors, n_init)
    rng = np.random.default_rng(seed)
    if use_kmeans:
        starts = [kmeans_start(stats, n_clusters, min(kmeans_rdim or n_factors, stats.width), seed)]
        starts += [rng.integers(0, n_clusters, len(stats)) for _ in range(n_init)]
    else:
        starts = [None] if n_init == 1 else [rng.integers(0, n_clusters, len(stats)) for _ in range(n_init)]
    best = None
    for start in starts:
        got = fit_once(stats, kind, n_clusters, n_factors, start, **options)
        if best is None or got.loglik > best.loglik:
            best = got
    return best


def fit_panel(panel: Panel, kind: str, n_clusters: int, n_factors: int, **options) -> Fit:
    """Fit a panel: its statistics are aggregated on the cluster, and only they come to the driver."""
    return replace(fit(S.collect(panel), kind, n_clusters, n_factors, **options), channels=panel.channels)


def canonical(found: Fit) -> Fit:
    """The same fit with clusters by size, then by smallest subject, so that output doesn't depend on the start's labels."""
    sizes = np.bincount(found.z - 1, minlength=found.n_clusters)
    smallest = [found.ids[found.z == k + 1].min() if sizes[k] else np.iinfo(np.int64).max for k in range(found.n_clusters)]
    order = sorted(range(found.n_clusters), key=lambda k: (-sizes[k], smallest[k], k))
    new = np.empty(found.n_clusters, dtype=int)
    new[order] = np.arange(1, found.n_clusters + 1)
    return replace(found, z=new[found.z - 1], resp=found.resp[:, order], pi=found.pi[order], components=tuple(found.components[k] for k in order))


def unit_axes(component: L.Component) -> tuple[np.ndarray, np.ndarray]:
    """Loadings as unit columns and their lengths."""
    length = np.sqrt((component.loadings**2).sum(axis=0))
    return component.loadings / np.where(length > 0, length, 1), length


def _centre(panel: Panel) -> np.ndarray:
    means = panel.df.dropna(subset=list(panel.channels)).agg(*(F.avg(c).alias(c) for c in panel.channels)).first()
    return np.array([x or 0.0 for x in means])


def fit_distributed(
    panel: Panel, kind: str, n_clusters: int, n_factors: int, z_init: DataFrame | None = None, max_iter: int = 20, inner: int = 20, tol: float = 1e-3, method: str = "closed_form", estep: str = "textbook", em: str = "hard", start: str = "kmeans", seed: int = 0
) -> tuple[Fit, DataFrame]:
    """One fit by ``fits.fit_many``, for panels of any number of subjects: the statistics stay on the cluster, a round sends K pooled ones to the driver.

    Returns the parameters (ids and labels empty) and the assignments (subject_id, z, loglik), recomputed from them whenever they are
    read. The start is ``z_init`` (subject_id, z from 1), k-means over subjects' means, or (``start="modulo"``) the subject's number modulo K.
    """
    from strandmix.operators import fits as T

    if em not in ("hard", "soft") or start not in ("kmeans", "modulo"):
        raise ValueError(f"em is hard or soft, start kmeans or modulo, not {em!r}, {start!r}")
    spec = T.Spec(checks.model_type(kind), n_clusters, n_factors, start if z_init is None else "given", seed, em=em, max_iter=max_iter, inner=inner, tol=tol, method=method, estep=estep)
    with T.statistics(panel, z_init) as table:
        found = T.fit_many(table, [spec])[0]
    return found, T.assignments(table, [found]).drop("model")


def grid_distributed(panel: Panel, kind: str, ks=range(1, 6), rs=range(1, 6), **options) -> list[dict]:
    """K, r, logLik, BIC, entropy and ICL of fits from k-means on the cluster, the smallest BIC first; all of them advance together."""
    from strandmix.operators import fits as T

    with T.statistics(panel) as table:
        return T.grid(table, kind, ks, rs, **({"n_init": 0, "method": "closed_form"} | options)).summary


def log_joint_columns(components, pi: np.ndarray, centre: np.ndarray, jitter: float = 0.0):
    """One expression per cluster over the columns n, s and q: log prior plus the log likelihood of a subject's rows."""
    out = []
    for p, c in zip(pi, components):
        m = len(c.mean)
        cov = c.cov + jitter * np.eye(m)
        inv, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        mu = np.asarray(c.mean) - centre
        a = inv @ mu
        terms, at = [], 0
        for i in range(m):
            for j in range(i, m):
                terms.append(float(inv[i, j] * (1 if i == j else 2)) * F.col("q")[at])
                at += 1
        quad = sum(terms, F.lit(0.0)) - 2 * sum((float(a[i]) * F.col("s")[i] for i in range(m)), F.lit(0.0)) + float(mu @ a) * F.col("n")
        out.append(F.lit(float(np.log(p + TINY))) - 0.5 * (F.col("n") * float(m * L.LOG_2PI + logdet) + quad))
    return out


def assigned(table: DataFrame, components, pi: np.ndarray, centre: np.ndarray) -> DataFrame:
    """Moments with z, the best cluster of each subject, the first of equals, and loglik, its joint log likelihood; nothing is shuffled."""
    joint = log_joint_columns(components, pi, centre, L.JITTER)
    best = F.greatest(*joint) if len(joint) > 1 else joint[0]
    z = F.coalesce(*(F.when(x == F.col("loglik"), F.lit(k + 1)) for k, x in enumerate(joint)))
    return table.withColumn("loglik", best).withColumn("z", z.cast("int"))


def assign_frame(table: DataFrame, components, pi: np.ndarray, centre: np.ndarray) -> DataFrame:
    """(subject_id, z, loglik) of each subject."""
    return assigned(table, components, pi, centre).select("subject_id", "z", "loglik")
