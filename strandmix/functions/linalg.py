"""Dense kernels over covariances: factor analysis and probabilistic PCA, Gaussian likelihoods, rotations, assignments, subspaces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOG_2PI = float(np.log(2 * np.pi))
JITTER = 1e-8


@dataclass(frozen=True)
class Component:
    """One Gaussian: mean, loadings (M, r) and noise variances (M)."""

    mean: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        """Loadings and noise together."""
        return self.loadings @ self.loadings.T + np.diag(self.noise)

    def projector(self) -> np.ndarray:
        """(r, M): scores are its product with centred rows."""
        scaled = self.loadings.T / self.noise
        return np.linalg.solve(np.eye(self.loadings.shape[1]) + scaled @ self.loadings, scaled)


def top_eigen(cov: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The r largest eigenvalues with their vectors, and the other eigenvalues; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = vectors[:, :r]
    signs = np.sign(top[np.argmax(np.abs(top), axis=0), np.arange(top.shape[1])])
    return values[:r], top * np.where(signs == 0, 1, signs), values[r:]


def fa_em(n: float, mean: np.ndarray, cov: np.ndarray, r: int, rounds: int = 20, estep: str = "textbook", start: Component | None = None) -> Component:
    """Factor analysis by EM on a covariance.

    ``textbook`` is maximum likelihood. ``shrunk`` multiplies the expected factors by their posterior covariance a second time and
    adds only that covariance's diagonal: an estimator that isn't maximum likelihood, for comparisons with fits made that way.
    """
    m = len(mean)
    values, vectors, rest = top_eigen(cov, r)
    floor = 1e-6 if estep == "textbook" else 1e-12
    if start is not None:
        lam, psi = start.loadings.copy(), start.noise.copy()
    elif estep == "textbook":
        lam, psi = vectors * np.sqrt(np.maximum(values, floor)), np.maximum(np.diag(cov) - ((vectors * np.sqrt(np.maximum(values, floor))) ** 2).sum(axis=1), floor)
    else:
        single = np.sqrt(np.maximum(np.concatenate([values, rest]), 0) * n)
        lam = vectors * single[:r] / np.sqrt(n)
        psi = np.full(m, max(single[r:].sum() / (max(1, m - r) * n), floor))
    eye = np.eye(r)
    for _ in range(rounds):
        inv = np.linalg.inv(lam @ lam.T + np.diag(psi) + (0 if estep == "textbook" else JITTER) * np.eye(m))
        b = lam.T @ inv
        if estep == "textbook":
            ezz = eye - b @ lam + b @ cov @ b.T
        else:
            v = np.linalg.inv(eye + b @ lam)
            b = v @ b
            ezz = np.diag(np.diag(v)) + b @ cov @ b.T
        cross = cov @ b.T
        lam = cross @ np.linalg.inv(ezz + 1e-12 * eye)
        psi = np.maximum(np.diag(cov - lam @ cross.T), floor)
    return Component(mean, lam, psi)


def fa_loadings(cov: np.ndarray, r: int, rounds: int = 20) -> np.ndarray:
    """(N, M, r): the loadings of ``fa_em`` by its textbook rounds, for many covariances at once."""
    values, vectors = np.linalg.eigh(cov)
    values, top = np.maximum(values[:, None, ::-1][:, :, :r], 1e-6), vectors[:, :, ::-1][:, :, :r]
    largest = np.take_along_axis(top, np.abs(top).argmax(axis=1)[:, None, :], axis=1)
    lam = top * np.where(largest < 0, -1.0, 1.0) * np.sqrt(values)
    diagonal = np.diagonal(cov, axis1=1, axis2=2)
    psi, eye, own = np.maximum(diagonal - (lam**2).sum(axis=2), 1e-6), np.eye(r), np.eye(cov.shape[1])
    for _ in range(rounds):
        b = lam.transpose(0, 2, 1) @ np.linalg.inv(lam @ lam.transpose(0, 2, 1) + psi[:, :, None] * own)
        cross = cov @ b.transpose(0, 2, 1)
        ezz = eye - b @ lam + b @ cross
        lam = cross @ np.linalg.inv(ezz + 1e-12 * eye)
        psi = np.maximum(diagonal - (lam * cross).sum(axis=2), 1e-6)
    return lam


def ppca_closed(mean: np.ndarray, cov: np.ndarray, r: int) -> Component:
    """Probabilistic PCA at its maximum: noise is the mean of the eigenvalues left out."""
    values, vectors, rest = top_eigen(cov, r)
    noise = max(float(rest.mean()) if len(rest) else 1e-12, 1e-12)
    return Component(mean, vectors * np.sqrt(np.maximum(values - noise, 1e-12)), np.full(len(mean), noise))


def ppca_em(mean: np.ndarray, cov: np.ndarray, r: int, rounds: int = 20, estep: str = "textbook") -> Component:
    """Probabilistic PCA by EM on a covariance; ``shrunk`` as in fa_em."""
    m = len(mean)
    values, vectors, rest = top_eigen(cov, r)
    w, noise = vectors * np.sqrt(np.maximum(values, 1e-12)), max(float(rest.mean()) if len(rest) else 1e-12, 1e-12)
    eye = np.eye(r)
    for _ in range(rounds):
        inv = np.linalg.inv(w.T @ w + noise * eye)
        b = inv @ w.T
        if estep == "shrunk":
            b = noise * inv @ b
        ezz = noise * inv + b @ cov @ b.T
        cross = cov @ b.T
        w = cross @ np.linalg.inv(ezz + 1e-12 * eye)
        noise = max(float(np.trace(cov - w @ cross.T)) / m, 1e-12) if estep == "textbook" else max(float(np.trace(cov - 2 * w @ cross.T + w @ ezz @ w.T)) / m, 1e-12)
    return Component(mean, w, np.full(m, noise))


def principal_axes(mean: np.ndarray, cov: np.ndarray, r: int) -> Component:
    """Factor loadings from eigenvectors, noise from what the diagonal has left."""
    values, vectors, _ = top_eigen(cov, r)
    lam = vectors * np.sqrt(np.maximum(values, 0))
    return Component(mean, lam, np.maximum(np.diag(cov) - (lam * lam).sum(axis=1), 1e-12))


def log_likelihoods(n: np.ndarray, scatter: np.ndarray, cov: np.ndarray, jitter: float = 0.0) -> np.ndarray:
    """(N,): the Gaussian log likelihood of each subject's rows, from its scatter about the mean; -inf where the covariance isn't positive."""
    m = cov.shape[0]
    try:
        chol = np.linalg.cholesky(cov + jitter * np.eye(m))
    except np.linalg.LinAlgError:
        return np.full(len(n), -np.inf)
    half = np.linalg.inv(chol)
    inv = half.T @ half
    return -0.5 * (n * (m * LOG_2PI + 2 * np.log(np.diag(chol)).sum()) + np.einsum("jk,ijk->i", inv, scatter))


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    top = x.max(axis=-1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=-1)) + top[..., 0]


def varimax(loadings: np.ndarray, rounds: int = 1000, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Rotated loadings and the rotation, rows scaled to unit length for the search. One factor stays as it is."""
    p, r = loadings.shape
    if r < 2:
        return loadings, np.eye(r)
    length = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    x = loadings / np.where(length > 0, length, 1)
    rotation, last = np.eye(r), 0.0
    for _ in range(rounds):
        z = x @ rotation
        u, d, v = np.linalg.svd(x.T @ (z**3 - z * ((z**2).sum(axis=0) / p)))
        rotation, now = u @ v, d.sum()
        if now < last * (1 + tol):
            break
        last = now
    return loadings @ rotation, rotation


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a cheapest one-to-one assignment of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], at = row, 0
        dist, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[at]:
            done[at] = True
            reduced = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = ~done[1:] & (reduced < dist[1:])
            dist[1:][better], came[1:][better] = reduced[better], at
            after = int(np.argmin(np.where(done[1:], np.inf, dist[1:]))) + 1
            step = dist[after]
            u[match[done]] += step
            v[done] -= step
            dist[~done] -= step
            at = after
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = np.zeros(n, dtype=int)
    out[match[1:] - 1] = np.arange(n)
    return out


def procrustes(a: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rotation that brings ``a`` closest to ``target``."""
    u, _, vt = np.linalg.svd(a.T @ target)
    return u @ vt


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> float | None:
    """Mean squared cosine of the canonical angles of two column spaces; None for shapes that don't fit or missing values."""
    if a is None or b is None or a.ndim != 2 or b.ndim != 2 or a.shape[0] != b.shape[0] or not min(a.shape[1], b.shape[1]) or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    cosines = np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0, 1)
    return float((cosines**2)[: min(a.shape[1], b.shape[1])].mean())


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of columns; 0 where a column is constant."""
    za, zb = a - a.mean(axis=0), b - b.mean(axis=0)
    size = np.sqrt((za**2).sum(axis=0))[:, None] * np.sqrt((zb**2).sum(axis=0))
    return np.where(size > 0, za.T @ zb / np.where(size > 0, size, 1), 0.0)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(N, K) squared distances, a centre at a time."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def exchange(x: np.ndarray, labels: np.ndarray, centres: np.ndarray, passes: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres after moving single points wherever that lowers the sum of squares, until no move does.

    Leaving a cluster of n points lowers its sum by d n / (n - 1), joining one of n raises it by d n / (n + 1), so a point may move although its own
    centre is the nearest. Points of a cluster that hasn't changed since the last pass are compared with clusters that have.
    """
    labels, centres, k = labels.copy(), centres.astype(float).copy(), len(centres)
    sizes = np.bincount(labels, minlength=k).astype(float)
    live = np.ones(k, dtype=bool)
    for _ in range(passes):
        changed = np.zeros(k, dtype=bool)
        for i, v in enumerate(x):
            own = labels[i]
            if sizes[own] < 2:
                continue
            others = np.flatnonzero((live | changed) if not (live[own] or changed[own]) else np.ones(k, dtype=bool))
            others = others[others != own]
            if not len(others):
                continue
            d = ((centres[others] - v) ** 2).sum(axis=1) * sizes[others] / (sizes[others] + 1)
            best = int(d.argmin())
            leaves = ((centres[own] - v) ** 2).sum() * sizes[own] / (sizes[own] - 1)
            if d[best] < leaves * (1 - 1e-12) - 1e-15:
                to = int(others[best])
                centres[own] -= (v - centres[own]) / (sizes[own] - 1)
                centres[to] += (v - centres[to]) / (sizes[to] + 1)
                sizes[own], sizes[to], labels[i] = sizes[own] - 1, sizes[to] + 1, to
                changed[own] = changed[to] = True
        live = changed
        if not changed.any():
            break
    return labels, centres


def kmeans(x: np.ndarray, k: int, starts: int = 10, rounds: int = 100, seed: int = 0, exchanges: bool = True) -> np.ndarray:
    """Labels 0..k-1 of the best of several runs from distinct rows over all points, and (with ``exchanges``) what moves of single points make of it."""
    rng, best, labels, found = np.random.default_rng(seed), np.inf, np.zeros(len(x), dtype=int), None
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    for _ in range(starts):
        centres = distinct[rng.choice(len(distinct), k, replace=False)]
        own = None
        for _ in range(rounds):
            new = _apart(x, centres).argmin(axis=1)
            if own is not None and (new == own).all():
                break
            own = new
            for j in range(k):
                if (own == j).any():
                    centres[j] = x[own == j].mean(axis=0)
        total = float(((x - centres[own]) ** 2).sum())
        if total < best - 1e-12:
            best, labels, found = total, own, centres
    return exchange(x, labels, found)[0] if exchanges and found is not None else labels
