"""Models to compare mixtures with: one factor analysis or PCA for all, and loadings per subject clustered in a second step."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import criteria as C
from strandmix.operators import project as P
from strandmix.operators.suffstats import Stats


@dataclass(frozen=True)
class Single:
    """One component for all subjects."""

    kind: str
    component: L.Component
    loglik: float
    bic: float
    sse: float


def _single(stats: Stats, kind: str, c: L.Component, params: int) -> Single:
    n = float(stats.n.sum())
    ll = float(L.log_likelihoods(stats.n, stats.scatter(c.mean), c.cov).sum())
    a = np.eye(stats.width) - P.hat(kind, c)
    sse = float(np.einsum("jk,kl,jl->", a, stats.scatter(c.mean).sum(axis=0), a))
    return Single(kind, c, ll, -2 * ll + params * float(np.log(n)), sse)


def single_fa(stats: Stats, r: int = 2) -> Single:
    """Loadings from the pooled covariance's eigenvectors, noise from what its diagonal has left."""
    _, mean, cov = stats.pooled()
    return _single(stats, "single_fa", L.principal_axes(mean, cov, r), stats.width * r + stats.width)


def single_pca(stats: Stats, r: int = 2) -> Single:
    """Principal axes with the mean of the other eigenvalues as noise."""
    _, mean, cov = stats.pooled()
    return _single(stats, "pca", L.ppca_closed(mean, cov, r), stats.width * r + stats.width + 1)


@dataclass(frozen=True)
class TwoStep:
    """Clusters of subjects by their own loadings; ``bases`` are the clusters' mean loadings."""

    ids: np.ndarray
    z: np.ndarray
    bases: tuple[np.ndarray, ...]
    own: np.ndarray
    sse: float
    vaf: float


def standardised(stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """(N, M, M) correlation and (N, M) deviation (over n - 1) of each subject."""
    mean = stats.s / stats.n[:, None]
    cov = (stats.q - stats.n[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(stats.n - 1, 1)[:, None, None]
    sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
    scale = np.where(sd > 0, sd, 1)
    return cov / scale[:, :, None] / scale[:, None, :], sd


def subject_bases(stats: Stats, r: int, method: str = "PCA", align: bool = True) -> np.ndarray:
    """(N, M, r): unit loadings of each subject's standardised rows, aligned with the first subject's."""
    corr, _ = standardised(stats)
    out = np.zeros((len(stats), stats.width, r))
    for i, c in enumerate(corr):
        found = L.top_eigen(c, r)[1] if method == "PCA" else L.fa_em(stats.n[i], np.zeros(stats.width), c, r, 30).loadings
        out[i] = found / np.maximum(np.sqrt((found**2).sum(axis=0)), 1e-12)
    return align_bases(out) if align else out


def align_bases(bases: np.ndarray, reference: int = 0) -> np.ndarray:
    """Columns of each basis ordered and signed like the reference's, by correlation."""
    target, r = bases[reference], bases.shape[2]
    za, zb = target - target.mean(axis=0), bases - bases.mean(axis=1, keepdims=True)
    size = np.sqrt((za**2).sum(axis=0))[:, None] * np.sqrt((zb**2).sum(axis=1))[:, None, :]
    corr = np.where(size > 0, za.T @ zb / np.where(size > 0, size, 1), 0.0)
    gain = np.nan_to_num((corr + 1) / 2)
    if r <= 4:  # all orders at once
        orders = np.array(list(permutations(range(r))))
        order = orders[gain[:, np.arange(r), orders].sum(axis=2).argmax(axis=1)]
    else:
        order = np.stack([L.assign(-g) for g in gain])
    signs = np.where(np.take_along_axis(corr, order[:, :, None], axis=2)[:, :, 0] < 0, -1.0, 1.0)
    return np.take_along_axis(bases, order[:, None, :], axis=2) * signs[:, None, :]


def majority(labels: np.ndarray, distance: np.ndarray) -> int:
    """The most frequent label; among equals the one with the smallest mean distance, then the smallest."""
    names, counts = np.unique(labels, return_counts=True)
    return int(min(names[counts == counts.max()], key=lambda k: (distance[labels == k].mean(), k)))


def majority_frame(votes: DataFrame) -> DataFrame:
    """(subject_id, z) from votes (subject_id, z, distance) by the same rule."""
    per = votes.groupBy("subject_id", "z").agg(F.count("*").alias("votes"), F.avg("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("subject_id").orderBy(F.desc("votes"), "distance", "z"))
    return per.withColumn("rank", rank).where("rank = 1").select("subject_id", "z")


def basis_sse(corr: np.ndarray, sd: np.ndarray, n: float, basis: np.ndarray) -> float:
    """A subject's squared error when its standardised rows are projected on a basis, in the channels' own units."""
    a = np.diag(sd) @ (np.eye(len(sd)) - basis @ np.linalg.pinv(basis))
    return float(np.einsum("jk,kl,jl->", a, corr * max(n - 1, 0), a))


def two_step(stats: Stats, r: int, k: int, method: str = "PCA", seed: int = 0, refine: bool = False, align: bool = True) -> TwoStep:
    """k-means over all subjects' loading vectors, a vote per subject, mean bases per cluster; ``refine`` moves subjects to the basis with the least error."""
    own = subject_bases(stats, r, method, align)
    points = own.transpose(0, 2, 1).reshape(-1, stats.width)
    labels = L.kmeans(points, k, starts=20, seed=seed)
    centres = np.stack([points[labels == j].mean(axis=0) if (labels == j).any() else np.zeros(stats.width) for j in range(k)])
    distance = np.sqrt(((points - centres[labels]) ** 2).sum(axis=1)).reshape(len(stats), r)
    z = np.array([majority(a, d) for a, d in zip(labels.reshape(len(stats), r), distance)])
    bases = [own[z == j].mean(axis=0) if (z == j).any() else None for j in range(k)]
    bases = [L.top_eigen(b @ b.T, r)[1] if b is not None else None for b in bases]
    corr, sd = standardised(stats)
    error = lambda i, j: basis_sse(corr[i], sd[i], stats.n[i], bases[j] if bases[j] is not None else own[i])
    if refine:
        z = np.array([min((j for j in range(k) if bases[j] is not None), key=lambda j: (error(i, j), j)) for i in range(len(stats))])
    sse = sum(error(i, z[i]) for i in range(len(stats)))
    total = float(np.trace(stats.scatter(stats.pooled()[1]), axis1=1, axis2=2).sum())
    return TwoStep(stats.ids, z + 1, tuple(b if b is not None else np.zeros((stats.width, r)) for b in bases), own, float(sse), 1 - float(sse) / total if total else float("nan"))


def compare_all(stats: Stats, k: int, r: int, z_true: np.ndarray | None = None, seed: int = 0, true_bases: list[np.ndarray] | None = None) -> list[dict]:
    """The six methods on one panel: a row each with BIC (over subjects), ARI, SSE, VAF and subspace similarity; None where a method has none."""
    from strandmix.operators import evaluate as E
    from strandmix.operators import mixture as M

    total = float(np.trace(stats.scatter(stats.pooled()[1]), axis1=1, axis2=2).sum())
    ari = lambda z: E.ari(z_true, z) if z_true is not None else None
    space = lambda z, bases: E.clusterwise_similarity(true_bases, bases, z_true, z) if true_bases is not None and z_true is not None else None
    rows = []

    def one_space(loadings):
        """Similarity of one basis with each true cluster's, weighted by the cluster's subjects."""
        if true_bases is None or z_true is None:
            return None
        shares = [(np.asarray(z_true) == k).mean() for k in range(1, len(true_bases) + 1)]
        return float(sum(w * (L.subspace_similarity(b, loadings) or 0.0) for w, b in zip(shares, true_bases)))

    for name, got in (("SingleFA", single_fa(stats, r)), ("SinglePCA", single_pca(stats, r))):
        rows.append({"Method": name, "BIC": got.bic, "ARI": None, "SSE": got.sse, "VAF": 1 - got.sse / total, "subspace_similarity": one_space(got.component.loadings)})
    for name, method in (("TwoStep_FA", "FA"), ("TwoStep_PCA", "PCA")):
        got = two_step(stats, r, k, method, seed)
        rows.append({"Method": name, "BIC": None, "ARI": ari(got.z), "SSE": got.sse, "VAF": got.vaf, "subspace_similarity": space(got.z, list(got.bases))})
    for name, kind in (("MixtureFA", "mfa"), ("MixturePCA", "mpca")):
        got = M.fit(stats, kind, k, r, n_init=1, seed=seed)
        sse = float(P.subject_sse(stats, got, kind="pca" if kind == "mpca" else None).sum())
        rows.append({"Method": name, "BIC": C.bic(kind, C.loglik(stats, got), k, r, stats.width, len(stats)), "ARI": ari(got.z), "SSE": sse, "VAF": 1 - sse / total, "subspace_similarity": space(got.z, [c.loadings for c in got.components])})
    return rows
