"""Scores, reconstructions and their errors: literal coefficients in projections over rows, or traces over statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import suffstats as S
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats
from strandmix.sources.panel import Panel


def fa_scorer(c: L.Component) -> np.ndarray:
    """(r, M): posterior mean scores of a factor analyser."""
    return c.projector()


def ppca_scorer(c: L.Component) -> np.ndarray:
    """(r, M): posterior mean scores of a probabilistic PCA, by its own r x r form."""
    w, noise = c.loadings, float(c.noise.mean())
    return np.linalg.solve(w.T @ w + noise * np.eye(w.shape[1]), w.T)


def regression_scorer(c: L.Component) -> np.ndarray:
    """(r, M): regression scores shrunk a second time, as single factor analyses use them."""
    b = c.loadings.T @ np.linalg.inv(c.cov)
    return np.linalg.solve(np.eye(c.loadings.shape[1]) + b @ c.loadings, b)


def axes_projection(c: L.Component) -> np.ndarray:
    """(M, M): orthogonal projection on the directions of the loadings as unit columns."""
    length = np.sqrt((c.loadings**2).sum(axis=0))
    p = c.loadings / np.where(length > 0, length, 1)
    return p @ p.T


def hat(kind: str, c: L.Component) -> np.ndarray:
    """(M, M): what turns centred rows into their reconstruction: mfa, mpca, pca (unit axes) or single_fa."""
    if kind == "pca":
        return axes_projection(c)
    scorer = {"mfa": fa_scorer, "mpca": ppca_scorer, "single_fa": regression_scorer}[kind](c)
    return c.loadings @ scorer


def linear(channels, coefficients: np.ndarray, mean: np.ndarray, offset: np.ndarray | None = None) -> list[Column]:
    """Expressions of coefficients @ (x - mean) + offset with literals."""
    rows = []
    for k, row in enumerate(coefficients):
        total = F.lit(float(offset[k]) if offset is not None else 0.0)
        for c, v, mu in zip(channels, row, mean):
            total = total + float(v) * (F.col(c) - float(mu))
        rows.append(total)
    return rows


def _by_cluster(panel: Panel, assignments: DataFrame, per_cluster: list[list[Column]], names: list[str]) -> DataFrame:
    """Rows with their cluster's expressions; rows of subjects without a cluster are left out."""
    joined = panel.df.join(assignments.select("subject_id", "z"), "subject_id")
    columns = []
    for j, name in enumerate(names):
        value = F.lit(None).cast("double")
        for k, expressions in enumerate(per_cluster):
            value = F.when(F.col("z") == k + 1, expressions[j]).otherwise(value)
        columns.append(value.alias(name))
    return joined.select("subject_id", "t", "z", *columns)


def scores(panel: Panel, fit: Fit, assignments: DataFrame) -> DataFrame:
    """(subject_id, t, z, f_1 ...): factor scores of each row under its subject's cluster."""
    scorer = fa_scorer if fit.kind == "mfa" else ppca_scorer
    return _by_cluster(panel, assignments, [linear(panel.channels, scorer(c), c.mean) for c in fit.components], [f"f_{j + 1}" for j in range(fit.n_factors)])


def reconstruct(panel: Panel, fit: Fit, assignments: DataFrame, kind: str | None = None) -> DataFrame:
    """(subject_id, t, z, channels): each row's reconstruction under its subject's cluster."""
    return _by_cluster(panel, assignments, [linear(panel.channels, hat(kind or fit.kind, c), c.mean, c.mean) for c in fit.components], list(panel.channels))


def row_errors(panel: Panel, fit: Fit, assignments: DataFrame, kind: str | None = None) -> DataFrame:
    """(subject_id, t, z, sq_error) of each row."""
    rest = [np.eye(len(c.mean)) - hat(kind or fit.kind, c) for c in fit.components]
    squares = [[sum((e * e for e in linear(panel.channels, a, c.mean)), F.lit(0.0))] for a, c in zip(rest, fit.components)]
    return _by_cluster(panel, assignments, squares, ["sq_error"])


def row_log_densities(panel: Panel, fit: Fit) -> DataFrame:
    """(subject_id, t, log_density_1 ...): each row's Gaussian log density under every cluster, as an expression with literal coefficients.

    Null where a channel is missing. Densities of a subject's rows sum to its log likelihood.
    """
    columns = []
    for k, c in enumerate(fit.components):
        # The squared length of the whitened row: one linear form for each channel.
        white, logdet = np.linalg.cholesky(np.linalg.inv(c.cov)).T, float(np.linalg.slogdet(c.cov)[1])
        quad = sum((x * x for x in linear(panel.channels, white, c.mean)), F.lit(0.0))
        columns.append((-0.5 * (F.lit(float(len(c.mean) * L.LOG_2PI + logdet)) + quad)).alias(f"log_density_{k + 1}"))
    return panel.df.select("subject_id", "t", *columns)


def subject_sse(stats: Stats, fit: Fit, z: np.ndarray | None = None, kind: str | None = None) -> np.ndarray:
    """(N,): squared reconstruction error of each subject, from statistics alone."""
    z = fit.z if z is None else z
    out = np.zeros(len(stats))
    for k, c in enumerate(fit.components):
        own = np.flatnonzero(z == k + 1)
        if len(own):
            a = np.eye(stats.width) - hat(kind or fit.kind, c)
            out[own] = np.einsum("jk,ikl,jl->i", a, stats.pick(own).scatter(c.mean), a)
    return out


def vaf(stats: Stats, fit: Fit, z: np.ndarray | None = None, sst: str = "raw", kind: str | None = None) -> float:
    """1 - SSE / SST, with sums of squares about 0, about the means of all rows, or about the means of each cluster."""
    z = fit.z if z is None else z
    if sst == "raw":
        total = float(stats.raw_squares().sum())
    elif sst == "global":
        total = float(np.trace(stats.scatter(stats.pooled()[1]), axis1=1, axis2=2).sum())
    elif sst == "cluster":
        total = sum(float(np.trace(p.scatter(p.pooled()[1]), axis1=1, axis2=2).sum()) for k in np.unique(z) for p in [stats.pick(z == k)])
    else:
        raise ValueError(f"unknown kind {sst!r}")
    return 1 - float(subject_sse(stats, fit, z, kind).sum()) / total if total > 0 else float("nan")


def reconstruction_error(stats: Stats, fit: Fit, metric: str = "sse") -> float:
    """SST (1 - VAF), or its root per cell."""
    sse = float(subject_sse(stats, fit).sum())
    if metric == "sse":
        return sse
    if metric == "rmse":
        return float(np.sqrt(sse / (stats.n.sum() * stats.width)))
    raise ValueError(f"unknown metric {metric!r}")


def summarize_clusters(panel: Panel, fit: Fit, assignments: DataFrame) -> DataFrame:
    """Per cluster: SSE, rows, SSE per row, and VAF about the cluster's own means; one aggregation over rows."""
    errors = row_errors(panel, fit, assignments).groupBy("z").agg(F.sum("sq_error").alias("sse"), F.count("*").alias("n"))
    about = S.total_squares(panel, "cluster", assignments).select("z", "sst")
    return errors.join(about, "z").select("z", "sse", "n", (F.col("sse") / F.col("n")).alias("sse_per_row"), (1 - F.try_divide("sse", "sst")).alias("vaf"))


def score_smoothness(panel: Panel, fit: Fit, assignments: DataFrame) -> DataFrame:
    """One row: the sum of squared second differences of all factor scores."""
    table = scores(panel, fit, assignments)
    names = tuple(f"f_{j + 1}" for j in range(fit.n_factors))
    return S.smoothness(Panel(table.select("subject_id", "t", *names), names)).agg(F.sum("penalty").alias("penalty"))
