"""Many mixture fits in one scan a round, over statistics that stay on the cluster.

Under a Gaussian the log likelihood of a subject's rows is linear in its statistics x = (1, n, s, q), so the joint log likelihoods of all
clusters of all models are one matrix product over a batch of subjects, and the pooled statistics of all clusters are another one. A round
of all models together, whatever their K, r, start and weights, is one pass that returns a row per cluster. Models that have ended
drop out of the next round. The driver holds nothing that grows with the panel: pooled statistics in, parameters out.

Resampling is weighting: the draws of a bootstrap, its subsamples and the folds of a cross-validation are weights of subjects, computed in
the task from a hash of the subject's number, so that no subject is sent anywhere and draws are models like others.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.functions import checks
from strandmix.functions import linalg as L
from strandmix.operators import criteria as C
from strandmix.operators import mixture as M
from strandmix.operators import suffstats as S
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats
from strandmix.sources.panel import Panel

#: Subjects that k-means draws its first centres from, by a hash; its rounds over all subjects.
SAMPLE, KMEANS_ROUNDS = 1000, 20
#: Subjects of a block in a task.
BLOCK = 4096
#: Bytes of statistics from which a scan has one more task while there are cores, and from which it has one more in any case.
SOME_BYTES, MANY_BYTES = 1 << 18, 1 << 23


# --- draws --------------------------------------------------------------------------------------------------------------------------

#: The prime that draws are taken modulo, and the fixed numbers that mix a subject's number with the draw's.
PRIME = 2147483647
_MIX = (48271, 69621, 1013904223, 630360016, 742938285, 1226874159)
#: Shares of Poisson counts with mean 1 up to 0, 1, 2, ...; what lies beyond the last is its number.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def uniform(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """A number from 0 to PRIME - 1 for each subject, by polynomials modulo PRIME; ``uniform_sql`` is the same in SQL."""
    a, b, c, d, e, f = _MIX
    x = (ids % PRIME * a + draw % PRIME * b + seed % PRIME * c) % PRIME
    for scale in (d, e, f):
        x = (x * x % PRIME + 7 * x + draw % PRIME) % PRIME * scale % PRIME
    return x


def uniform_sql(subject: str, seed: int, draw: str) -> str:
    """SQL for ``uniform`` of a column and a draw's number, itself a column or a literal."""
    a, b, c, d, e, f = _MIX
    x = f"((({subject} % {PRIME} + {PRIME}) % {PRIME} * {a} + {draw} * {b} + CAST({seed % PRIME} AS BIGINT) * {c}) % {PRIME})"
    for scale in (d, e, f):
        x = f"(({x} * {x} % {PRIME} + 7 * {x} + {draw}) % {PRIME} * {scale} % {PRIME})"
    return x


@dataclass(frozen=True)
class Weight:
    """How often a model counts each subject: ``all`` once; ``poisson`` as drawn with replacement; ``part`` a share of them; ``fold`` those out of a fold, ``inside`` those in it."""

    how: str = "all"
    seed: int = 0
    draw: int = 0
    share: float = 0.8
    folds: int = 5

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.how == "all":
            return np.ones(len(ids))
        if self.how in ("fold", "inside"):
            own = uniform(ids, self.seed, 0) * self.folds // PRIME == self.draw
            return (own if self.how == "inside" else ~own).astype(float)
        u = uniform(ids, self.seed, self.draw) / PRIME
        return (u < self.share).astype(float) if self.how == "part" else np.searchsorted(np.array(POISSON), u, side="right").astype(float)


ALL = Weight()


# --- statistics on the cluster ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """The statistics of a panel: ``df`` has (subject_id, x) with x = (n, s, q), and z0 where labels to start from were given."""

    df: DataFrame
    channels: tuple[str, ...]
    centre: np.ndarray
    subjects: int
    rows: float

    @property
    def width(self) -> int:
        """Number of channels."""
        return len(self.channels)

    def one(self, v: np.ndarray) -> Stats:
        """Pooled statistics (n, s, q) as those of one subject."""
        m = self.width
        return Stats(np.array([0]), v[:1].copy(), v[None, 1 : m + 1].copy(), S.upper_to_full(v[None, m + 1 : 1 + m + m * (m + 1) // 2], m), self.centre)


@contextmanager
def statistics(panel: Panel, given: DataFrame | None = None) -> Iterator[Table]:
    """A panel's statistics, kept while the block runs. ``given`` (subject_id, z from 1) are labels that fits may start from.

    They come from a shuffle, in many more partitions than their bytes are worth a task; scans read several of these in a task.
    """
    centre = M._centre(panel)
    table = S.moments(panel, centre.tolist()).select("subject_id", F.concat(F.array(F.col("n").cast("double")), "s", "q").alias("x"))
    if given is not None:
        table = table.join(given.select("subject_id", F.col("z").alias("z0")), "subject_id")
    table = table.persist()
    try:
        subjects, rows = table.agg(F.count("*"), F.sum(F.col("x")[0])).first()
        yield Table(table.coalesce(_scan_tasks(subjects, len(panel.channels), table.sparkSession.sparkContext.defaultParallelism)), panel.channels, centre, subjects, float(rows or 0))
    finally:
        table.unpersist()


def _scan_tasks(subjects: int, width: int, cores: int) -> int:
    """Tasks of a scan over so many subjects' statistics."""
    size = 8 * subjects * (2 + width + width * (width + 1) // 2)
    return max(1, -(-size // MANY_BYTES), min(-(-size // SOME_BYTES), cores))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
            yield np.asarray(part.column(0)), x, np.asarray(part.column(2)) if part.num_columns > 2 else None


def _summed(table: Table, block: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], cells: int) -> np.ndarray:
    """(cells, width): what ``block`` makes of each block of subjects, summed over all. Tasks return a row per cell; rows are summed before the driver sees them."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _blocks(batches):
            v = block(*part)
            total = v if total is None else total + v
        if total is not None:
            lists = pa.ListArray.from_arrays(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], names=["cell", "v"])

    parts = table.df.mapInArrow(run, "cell int, v array<double>").select("cell", array_to_vector("v").alias("v"))
    found = {r["cell"]: r["v"].toArray() for r in parts.groupBy("cell").agg(Summarizer.sum(F.col("v")).alias("v")).collect()}
    return np.stack([found[k] for k in range(cells)]) if found else np.zeros((cells, 0))


# --- labels in a task ---------------------------------------------------------------------------------------------------------------


def coefficients(components, pi: np.ndarray, centre: np.ndarray, jitter: float = 0.0, tiny: float = M.TINY) -> tuple[np.ndarray, np.ndarray]:
    """(D, K) and (K): x @ them plus the constants are the joint log likelihoods; -inf where a covariance isn't positive."""
    m = len(centre)
    i, j = np.triu_indices(m)
    out, constant = np.zeros((1 + m + len(i), len(components))), np.zeros(len(components))
    for k, (p, c) in enumerate(zip(pi, components)):
        with np.errstate(divide="ignore"):
            constant[k] = np.log(p + tiny)
        try:
            half = np.linalg.inv(np.linalg.cholesky(c.cov + jitter * np.eye(m)))
        except np.linalg.LinAlgError:
            constant[k] = -np.inf
            continue
        inv, mu = half.T @ half, np.asarray(c.mean) - centre
        a = inv @ mu
        out[0, k] = -0.5 * (m * L.LOG_2PI - 2 * np.log(np.diag(half)).sum() + mu @ a)
        out[1 : m + 1, k] = a
        out[m + 1 :, k] = -0.5 * inv[i, j] * np.where(i == j, 1, 2)
    return out, constant


@dataclass(frozen=True)
class Labeller:
    """What gives a block's subjects their labels: joint likelihoods, distances from centres (which are linear in s / n), a hash, the number modulo K, or given ones."""

    how: str
    k: int
    matrix: np.ndarray | None = None
    constant: np.ndarray | None = None
    seed: int = 0

    def joint(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix + self.constant

    def hard(self, ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        if self.how == "joint":
            return self.joint(x).argmax(axis=1)
        if self.how == "centres":
            return (x / np.maximum(x[:, :1], 1e-300) @ self.matrix + self.constant).argmax(axis=1)
        if self.how == "hash":
            return uniform(ids, self.seed, 1) * self.k // PRIME
        if self.how == "modulo":
            return np.mod(ids, self.k)
        if self.how == "given":
            return np.asarray(z0, dtype=np.int64) - 1
        raise ValueError(f"unknown start {self.how!r}")


def hash_labels(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The labels from 0 of a random start."""
    return Labeller("hash", k, seed=seed).hard(np.asarray(ids, dtype=np.int64), np.zeros((0, 0)), None)


# --- fits ---------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """One fit: its kind, K, r, start (kmeans, hash, modulo, given or a Labeller) and options, as ``mixture.fit_once`` has them."""

    kind: str
    k: int
    r: int
    start: str | Labeller = "kmeans"
    seed: int = 0
    weight: Weight = ALL
    em: str = "hard"
    max_iter: int = 50
    inner: int = 20
    tol: float = 1e-3
    method: str = "EM"
    estep: str = "textbook"
    kmeans_rdim: int | None = None


class _State:
    """A fit under way."""

    def __init__(self, spec: Spec, start: Labeller) -> None:
        self.spec, self.labels, self.components = spec, start, [None] * spec.k
        self.pi, self.label_pi, self.last, self.rounds, self.done = np.full(spec.k, 1 / spec.k), None, -np.inf, 0, False

    def update(self, table: Table, pooled: np.ndarray, whole: np.ndarray) -> None:
        """Parameters from the pooled statistics (subjects, n, s, q) of each cluster; an empty one keeps its own, or starts from all."""
        spec = self.spec
        if spec.em == "soft" or self.rounds:
            self.pi = pooled[:, 0] / max(pooled[:, 0].sum(), 1e-300)
        for k in range(spec.k):
            if pooled[k, 0] > 1e-10 or self.components[k] is None:
                v = pooled[k] if pooled[k, 0] > 1e-10 else whole
                self.components[k] = M._component(spec.kind, table.one(v[1:]), np.ones(1), spec.r, spec.inner, spec.method, spec.estep)
        self.rounds += 1
        self.label_pi = self.pi
        self.before, self.labels = self.labels, Labeller("joint", spec.k, *coefficients(self.components, self.pi, table.centre, L.JITTER))

    def told(self, pooled: np.ndarray, loglik: float, moves: float) -> None:
        """What a pass says about the labels by the present parameters."""
        if self.spec.em == "hard":
            self.pi = pooled[:, 0] / max(pooled[:, 0].sum(), 1e-300)
        same = self.spec.em == "hard" and moves == 0
        self.done = self.rounds >= self.spec.max_iter or (self.rounds >= 5 and (same or abs(loglik - self.last) < self.spec.tol))
        self.last = loglik

    def fit(self, table: Table) -> Fit:
        empty = np.zeros(0, np.int64)
        extra = {"label_pi": self.label_pi, "spec": self.spec, "hard": self.spec.em == "hard"}
        return Fit(self.spec.kind, empty, empty, np.zeros((0, self.spec.k)), self.pi, tuple(self.components), self.last, self.rounds, table.channels, extra)


def _pass(table: Table, states: list[_State], first: bool) -> list[tuple[np.ndarray, float, float]]:
    """One scan for all: per model the pooled statistics by its labels, the joint likelihood of those and how many subjects moved."""
    plans = [(s.labels, None if first else s.before, s.spec.weight, s.spec.em == "soft" and not first) for s in states]
    ends = np.cumsum([0, *(s.spec.k for s in states)]).tolist()
    width = table.width

    def block(ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        marks, scores = np.zeros((len(ids), ends[-1])), np.zeros((ends[-1], 2))
        weights: dict[Weight, np.ndarray] = {}
        every = np.arange(len(ids))
        for (labels, before, weight, soft), at in zip(plans, ends):
            w = weights[weight] if weight in weights else weights.setdefault(weight, weight.of(ids))
            if soft:
                joint = labels.joint(x)
                total = L.log_sum_exp(joint)
                marks[:, at : at + labels.k] = np.exp(joint - total[:, None]) * w[:, None]
                scores[at, 0] += (w * total)[w > 0].sum()
                continue
            if labels.how == "joint":
                joint = labels.joint(x)
                own = joint.argmax(axis=1)
                scores[at, 0] += (w * joint[every, own])[w > 0].sum()
            else:
                own = labels.hard(ids, x, z0)
            if before is not None:
                scores[at, 1] += w[own != before.hard(ids, x, z0)].sum()
            marks[every, at + own] = w
        return np.column_stack([marks.sum(axis=0), marks.T @ x, scores])

    found = _summed(table, block, ends[-1])
    if not found.size:
        found = np.zeros((ends[-1], 4 + width + width * (width + 1) // 2))
    return [(found[a:b, :-2], float(found[a, -2]), float(found[a, -1])) for a, b in zip(ends, ends[1:])]


def fit_many(table: Table, specs: list[Spec], progress: Callable[[int, dict[int, float]], None] | None = None) -> list[Fit]:
    """All fits, in as many passes as the longest of them has rounds. ``progress`` is told each round and the likelihoods by the number of the fit.

    Each fit goes as ``mixture.fit_once`` would from the same labels. Fits have no ids and labels: ``assignments`` and
    ``responsibilities`` give them as tables.
    """
    for spec in specs:
        checks.model_params(spec.k, spec.r, 1, spec.max_iter, spec.tol)
        checks.fits_data(spec.k, table.subjects, spec.r, table.width)
        if spec.em not in ("hard", "soft"):
            raise ValueError(f"em is hard or soft, not {spec.em!r}")
    if not specs:
        return []
    centres = kmeans_many(table, [x for x in specs if x.start == "kmeans"])
    starts = [centres.pop(0) if x.start == "kmeans" else x.start if isinstance(x.start, Labeller) else Labeller(x.start, x.k, seed=x.seed) for x in specs]
    states = [_State(x, s) for x, s in zip(specs, starts)]
    found = _pass(table, states, True)
    live = list(states)
    number = 0
    while live:
        for s, (pooled, _, _) in zip(live, found):
            s.update(table, pooled, pooled.sum(axis=0))
        number += 1
        found = _pass(table, live, False)
        for s, got in zip(live, found):
            s.told(*got)
        if progress:
            progress(number, {k: s.last for k, s in enumerate(states) if s in live})
        found = [x for s, x in zip(live, found) if not s.done]
        live = [s for s in live if not s.done]
    fits = [s.fit(table) for s in states]
    return [replace(f, loglik=e["loglik"], extra=f.extra | e) for f, e in zip(fits, evaluate(table, fits, [s.spec.weight for s in states]))]


def evaluate(table: Table, fits: list[Fit], weights: list[Weight] | None = None, held_out: bool = False, temperature: float = 1.0) -> list[dict]:
    """Per fit, in one scan: the mixture's likelihood, the entropy of its responsibilities, the subjects and rows counted, and the clusters' sizes.

    ``held_out`` adds nothing to priors and leaves out subjects without a finite likelihood.
    """
    weights = weights or [ALL] * len(fits)
    plans = [(coefficients(f.components, f.pi, table.centre, 0.0, 0.0 if held_out else M.TINY), _labeller(f, table), w) for f, w in zip(fits, weights)]
    width = 4 + max(f.n_clusters for f in fits)

    def block(ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(plans), width))
        for row, ((matrix, constant), labels, weight) in zip(out, plans):
            w = weight.of(ids)
            joint = x @ matrix + constant
            total = L.log_sum_exp(joint)
            kept = (w > 0) & np.isfinite(total) if held_out else w > 0
            w, p = w[kept], np.exp(joint[kept] - total[kept, None])
            if temperature != 1:
                p = C.tempered(p, temperature)
            p += M.TINY
            row[:4] = (w * total[kept]).sum(), -(w[:, None] * p * np.log(p)).sum(), w.sum(), (w * x[kept, 0]).sum()
            row[4 : 4 + labels.k] = np.bincount(labels.hard(ids[kept], x[kept], None), w, labels.k)
        return out

    found = _summed(table, block, len(plans))
    return [{"loglik": float(v[0]), "entropy": float(v[1]), "subjects": float(v[2]), "rows": float(v[3]), "sizes": v[4 : 4 + f.n_clusters].tolist()} for v, f in zip(found, fits)]


def _labeller(fit: Fit, table: Table) -> Labeller:
    """What labelled subjects in the fit's last round: a hard fit's parameters with the priors of the round before, else the responsibilities."""
    if fit.extra.get("hard", True):
        return Labeller("joint", fit.n_clusters, *coefficients(fit.components, fit.extra.get("label_pi", fit.pi), table.centre, L.JITTER))
    return Labeller("joint", fit.n_clusters, *coefficients(fit.components, fit.pi, table.centre))


def assignments(table: Table, fits: list[Fit], weights: list[Weight] | None = None) -> DataFrame:
    """(model, subject_id, z, loglik): each fit's labels of the subjects that it counts, with their joint likelihood; models are numbered from 0."""
    plans = [(_labeller(f, table), w) for f, w in zip(fits, weights or [ALL] * len(fits))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _blocks(batches):
            for k, (labels, weight) in enumerate(plans):
                kept = weight.of(ids) > 0
                joint = labels.joint(x[kept])
                z = joint.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), k, np.int32)), pa.array(ids[kept]), pa.array((z + 1).astype(np.int32)), pa.array(joint[np.arange(len(z)), z])], names=["model", "subject_id", "z", "loglik"])

    return table.df.mapInArrow(run, "model int, subject_id long, z int, loglik double")


def responsibilities(table: Table, fit: Fit) -> DataFrame:
    """(subject_id, k, p)."""
    matrix, constant = coefficients(fit.components, fit.pi, table.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _blocks(batches):
            joint = x @ matrix + constant
            p = np.exp(joint - L.log_sum_exp(joint)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, p.shape[1])), pa.array(np.tile(np.arange(1, p.shape[1] + 1, dtype=np.int32), len(ids))), pa.array(p.ravel())], names=["subject_id", "k", "p"])

    return table.df.mapInArrow(run, "subject_id long, k int, p double")


# --- k-means ------------------------------------------------------------------------------------------------------------------------


def kmeans_many(table: Table, specs: list[Spec]) -> list[Labeller]:
    """Starts by k-means over subjects' means in the axes of the pooled covariance, all of them in one scan a round.

    The first centres come from a k-means over at most SAMPLE subjects, the first by a hash; then all subjects count, until none moves
    or after KMEANS_ROUNDS. Subjects count as often as the spec's weight says.
    """
    if not specs:
        return []
    m = table.width
    _, mean, cov = _pooled(table)
    sample = table.df.orderBy(F.xxhash64("subject_id"), "subject_id").limit(SAMPLE).select("subject_id", "x").collect()
    ids = np.array([r["subject_id"] for r in sample], dtype=np.int64)
    x = np.array([r["x"] for r in sample])
    own = x[:, 1 : m + 1] / np.maximum(x[:, :1], 1) + table.centre - mean
    dims = [min(s.kmeans_rdim or s.r, m) for s in specs]
    alike = [(s.k, d, s.seed, s.weight) for s, d in zip(specs, dims)]
    if len(set(alike)) < len(alike):  # kinds of models share their starts
        found = dict(zip(alike, specs))
        own = dict(zip(found, kmeans_many(table, list(found.values()))))
        return [own[x] for x in alike]
    axes = L.top_eigen(cov, max(dims))[1]
    centres, moving = [], []
    for s, d in zip(specs, dims):
        points = own[np.repeat(np.arange(len(ids)), s.weight.of(ids).astype(int))] @ axes[:, :d]
        labels = L.kmeans(points, s.k, seed=s.seed) if len(points) else np.zeros(0, int)
        centres.append(np.stack([points[labels == j].mean(axis=0) if (labels == j).any() else np.zeros(d) for j in range(s.k)]))
        moving.append(table.subjects > SAMPLE)
    shift = table.centre - mean

    def labeller(i: int) -> Labeller:
        """-|f - c|²/2 + |f|²/2 = f·c - |c|²/2 with f = (s / n + shift) @ axes, so linear in s / n."""
        matrix = np.zeros((1 + m + m * (m + 1) // 2, specs[i].k))
        directions = axes[:, : dims[i]] @ centres[i].T
        matrix[1 : m + 1] = directions
        return Labeller("centres", specs[i].k, matrix, shift @ directions - (centres[i] ** 2).sum(axis=1) / 2)

    for _ in range(KMEANS_ROUNDS):
        live = [i for i, more in enumerate(moving) if more]
        if not live:
            break
        plans, weights = [labeller(i) for i in live], [specs[i].weight for i in live]
        ends = np.cumsum([0, *(p.k for p in plans)]).tolist()

        def block(ids, x, z0, plans=plans, weights=weights, ends=ends):
            marks = np.zeros((len(ids), ends[-1]))
            for p, w, at in zip(plans, weights, ends):
                marks[np.arange(len(ids)), at + p.hard(ids, x, None)] = w.of(ids)
            return np.column_stack([marks.sum(axis=0), marks.T @ (x[:, 1 : m + 1] / np.maximum(x[:, :1], 1))])

        found = _summed(table, block, ends[-1])
        for i, a, b in zip(live, ends, ends[1:]):
            filled = found[a:b, 0] > 0
            new = centres[i].copy()
            new[filled] = (found[a:b][filled, 1:] / found[a:b][filled, :1] + shift) @ axes[:, : dims[i]]
            moving[i] = not np.allclose(new, centres[i], rtol=0, atol=1e-9 * max(1.0, float(np.abs(centres[i]).max())))
            centres[i] = new
    return [labeller(i) for i in range(len(specs))]


def _pooled(table: Table) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of all rows."""
    return table.one(_summed(table, lambda ids, x, z0: x.sum(axis=0)[None], 1)[0]).pooled()


# --- what users call ----------------------------------------------------------------------------------------------------------------


def _starts(kind: str, k: int, r: int, n_init: int, use_kmeans: bool, seed: int, options: dict) -> list[Spec]:
    """As ``mixture.fit`` starts: k-means and ``n_init`` random ones; without k-means and with one start, by the number modulo K."""
    if use_kmeans:
        return [Spec(kind, k, r, "kmeans", seed, **options), *(Spec(kind, k, r, "hash", seed * 1000 + i + 1, **options) for i in range(n_init))]
    return [Spec(kind, k, r, "modulo", seed, **options)] if n_init == 1 else [Spec(kind, k, r, "hash", seed * 1000 + i + 1, **options) for i in range(n_init)]


def fit_best(table: Table, cells: list[tuple[int, int]], kind: str, n_init: int = 1, use_kmeans: bool = True, seed: int = 0, progress=None, **options) -> list[Fit]:
    """For each (K, r) the best of several starts by likelihood, the first of equals; all starts of all cells advance together."""
    return fit_wanted(table, [wanted(kind, *cell, n_init, use_kmeans, seed, **options) for cell in cells], progress)


def wanted(kind: str, k: int, r: int, n_init: int = 1, use_kmeans: bool = True, seed: int = 0, **options) -> tuple[Spec, ...]:
    """The starts of a fit of which the best is wanted."""
    return tuple(_starts(checks.model_type(kind), k, r, n_init, use_kmeans, seed, options))


def fit_wanted(table: Table, wants: list[tuple[Spec, ...]], progress=None) -> list[Fit]:
    """The best of each of several fits' starts, of any kinds; all advance together, and what is wanted twice is fitted once."""
    specs = list(dict.fromkeys(s for starts in wants for s in starts))
    found = dict(zip(specs, fit_many(table, specs, progress)))
    return [max((found[s] for s in starts), key=lambda f: f.loglik) for starts in wants]


def together(table: Table, plans: list[Generator], progress=None) -> list:
    """What several plans return. A plan yields lists of ``wanted`` fits and is sent them; the fits of a step of all plans advance together."""
    out, asked = [None] * len(plans), {}

    def step(i, fits=None):
        try:
            asked[i] = plans[i].send(fits)
        except StopIteration as end:
            out[i] = end.value

    for i in range(len(plans)):
        step(i)
    while asked:
        now, asked = asked, {}
        fits = iter(fit_wanted(table, [w for wants in now.values() for w in wants], progress))
        for i, wants in now.items():
            step(i, [next(fits) for _ in wants])
    return out


def fit_panel(panel: Panel, kind: str, n_clusters: int, n_factors: int, **options) -> tuple[Fit, DataFrame]:
    """A fit and its assignments (subject_id, z, loglik), which are recomputed from the parameters whenever they are read."""
    with statistics(panel) as table:
        found = fit_best(table, [(n_clusters, n_factors)], kind, **options)[0]
    return found, assignments(table, [found]).drop("model")


def canonical(table: Table, fit: Fit) -> Fit:
    """The same fit with clusters by size, then by smallest subject; K rows come to the driver."""
    own = {r["z"]: (-r["n"], r["low"]) for r in assignments(table, [fit]).groupBy("z").agg(F.count("*").alias("n"), F.min("subject_id").alias("low")).collect()}
    order = sorted(range(fit.n_clusters), key=lambda k: (*own.get(k + 1, (0, 0)), k))
    extra = fit.extra | {"label_pi": fit.extra["label_pi"][order], "sizes": [fit.extra["sizes"][k] for k in order]}
    return replace(fit, pi=fit.pi[order], components=tuple(fit.components[k] for k in order), extra=extra)


def summarize(table: Table, fit: Fit) -> list[tuple]:
    """(z, sse, n, sse_per_row, vaf) of each cluster's reconstruction, from its pooled statistics: one scan, whatever the number of channels."""
    from strandmix.operators import project as P

    labels = _labeller(fit, table)

    def block(ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        marks = np.eye(labels.k)[labels.hard(ids, x, None)]
        return marks.T @ x

    rows = []
    for k, (v, c) in enumerate(zip(_summed(table, block, labels.k), fit.components)):
        if v[0] > 0:
            one = table.one(v)
            a = np.eye(table.width) - P.hat(fit.kind, c)
            sse, total = float(np.einsum("jk,kl,jl->", a, one.scatter(c.mean)[0], a)), float(np.trace(one.scatter(one.pooled()[1])[0]))
            rows.append((k + 1, sse, int(v[0]), sse / float(v[0]), 1 - sse / total if total else float("nan")))
    return rows


def _row(table: Table, fit: Fit, **more) -> dict:
    return {"K": fit.n_clusters, "r": fit.n_factors, "logLik": fit.loglik, "BIC": C.bic(fit.kind, fit.loglik, fit.n_clusters, fit.n_factors, table.width, table.rows)} | more


def grid(table: Table, kind: str, ks=range(1, 6), rs=range(1, 6), **options):
    """``selection.grid`` over statistics on the cluster: all cells and starts advance together, the smallest BIC over all rows wins."""
    progress = options.pop("progress", None)
    return together(table, [grid_plan(table, kind, ks, rs, **options)], progress)[0]


def grid_plan(table: Table, kind: str, ks=range(1, 6), rs=range(1, 6), **options) -> Generator:
    """``grid`` as a plan for ``together``."""
    from strandmix.operators.selection import Selection

    cells = [(k, r) for r in rs for k in ks if k <= table.subjects and r <= table.width]
    models = dict(zip(cells, (yield [wanted(kind, *cell, **options) for cell in cells])))
    rows = [_row(table, x, entropy=x.extra["entropy"]) for x in models.values()]
    summary = sorted((row | {"ICL": row["BIC"] + 2 * row["entropy"]} for row in rows), key=lambda row: (row["BIC"], row["K"], row["r"]))
    best = (summary[0]["K"], summary[0]["r"])
    return Selection(*best, models[best], summary, models, {"strategy": "grid", "criterion": "BIC"})


def two_stage(table: Table, kind: str, ks=range(1, 6), rs=range(1, 6), r_fixed: int = 2, criterion: str = "ICL", temperature: float = 1.0, seed: int = 0, **options):
    """``selection.two_stage`` over statistics on the cluster: K at a fixed r by ICL (of short fits from three random starts) or BIC, then r at that K by BIC."""
    progress = options.pop("progress", None)
    return together(table, [two_stage_plan(table, kind, ks, rs, r_fixed, criterion, temperature, seed, **options)], progress)[0]


def two_stage_plan(table: Table, kind: str, ks=range(1, 6), rs=range(1, 6), r_fixed: int = 2, criterion: str = "ICL", temperature: float = 1.0, seed: int = 0, **options) -> Generator:
    """``two_stage`` as a plan for ``together``."""
    from strandmix.operators.selection import Selection

    if criterion not in ("ICL", "BIC"):
        raise ValueError(f"unknown criterion {criterion!r}")
    ks, rs, r0 = [k for k in ks if k <= table.subjects], [r for r in rs if r <= table.width], min(r_fixed, table.width)
    long = [wanted(kind, k, r0, seed=seed, **options) for k in ks]
    short = [wanted(kind, k, r0, n_init=3, use_kmeans=False, seed=seed + 1, **(options | {"max_iter": 10, "tol": 1e-10})) for k in ks if criterion == "ICL"]
    found = yield long + short
    first, short = found[: len(ks)], found[len(ks) :]
    models = {(k, r0): f for k, f in zip(ks, first)}
    summary = [_row(table, f, stage="K") for f in first]
    if criterion == "ICL":
        for row, f, e in zip(summary, short, evaluate(table, short, temperature=temperature)):
            row |= {"entropy": e["entropy"], "ICL": C.bic(f.kind, f.loglik, f.n_clusters, r0, table.width, table.rows) + 2 * e["entropy"]}
    best_k = min(summary, key=lambda row: (row[criterion], row["K"]))["K"]
    missing = [r for r in rs if (best_k, r) not in models]
    if missing:
        models |= dict(zip([(best_k, r) for r in missing], (yield [wanted(kind, best_k, r, seed=seed, **options) for r in missing])))
    second = [_row(table, models[best_k, r], stage="r") for r in rs]
    best_r = min(second, key=lambda row: (row["BIC"], row["r"]))["r"]
    return Selection(best_k, best_r, models[best_k, best_r], summary + second, models, {"strategy": "twostage", "criterion": criterion, "temperature": temperature})


def evaluation(selection, spark) -> DataFrame:
    """Per model by BIC: K, r, likelihood, BIC, smallest and largest cluster that has subjects."""
    rows = []
    for (k, r), fit in selection.models.items():
        sizes = [int(round(x)) for x in fit.extra["sizes"] if x > 0]
        bic = next(row["BIC"] for row in selection.summary if (row["K"], row["r"]) == (k, r))
        rows.append((k, r, fit.loglik, bic, min(sizes), max(sizes)))
    return spark.createDataFrame(rows, "K int, r int, logLik double, BIC double, min_size int, max_size int").orderBy("BIC")


# --- resampling ---------------------------------------------------------------------------------------------------------------------


def subsample_draws(table: Table, kind: str, ks=range(2, 6), r: int = 2, n_boot: int = 50, ratio: float = 0.8, seed: int = 0, **options) -> DataFrame:
    """(K, b, subject_id, z) of fits to subsamples without replacement, for ``selection.stability``; all draws of all K in one scan a round.

    Each subject is in a draw with probability ``ratio``, by a hash. The table must be kept while the result is read.
    """
    jobs = [(k, b) for k in ks if k <= table.subjects for b in range(n_boot)]
    weights = [Weight("part", seed, b, ratio) for _, b in jobs]
    found = fit_many(table, [Spec(checks.model_type(kind), k, r, "kmeans", seed + b, w, **options) for (k, b), w in zip(jobs, weights)])
    names = table.df.sparkSession.createDataFrame([(i, k, b) for i, (k, b) in enumerate(jobs)], "model int, K int, b int")
    return assignments(table, found, weights).join(F.broadcast(names), "model").select("K", "b", "subject_id", "z")


def bootstrap_loadings(table: Table, kind: str, k: int, r: int, n_boot: int = 200, seed: int = 0, base: Fit | None = None, **options) -> list[tuple]:
    """(b, k, channel, factor, value): aligned loadings of fits to subjects drawn with replacement, each from the labels of the fit to all.

    So a draw's clusters are those of that fit, and only their columns are turned towards it. Draws are Poisson counts by a hash of subject and draw. Draws without subjects are left out.
    """
    from strandmix.operators import evaluate as E

    kind = checks.model_type(kind)
    base = base or fit_best(table, [(k, r)], kind, seed=seed, **options)[0]
    start = _labeller(base, table)
    target = np.stack([c.loadings for c in base.components])
    found = fit_many(table, [Spec(kind, k, r, start, 0, Weight("poisson", seed, b), **options) for b in range(n_boot)])
    out = []
    for b, got in enumerate(found):
        if got.extra["subjects"] > 0:
            turned = E.align_bootstrap(target, np.stack([c.loadings for c in got.components]), in_order=True)
            out += [(b, i + 1, j + 1, f + 1, float(turned[i, j, f])) for i, j, f in np.ndindex(turned.shape)]
    return out


def draw_sums(table: Table, weights: list[Weight]) -> list[np.ndarray]:
    """Per draw (subjects, n, s, q) of what it counts, all draws in one scan."""

    def block(ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        w = np.stack([weight.of(ids) for weight in weights])
        return np.column_stack([w.sum(axis=1), w @ x])

    return list(_summed(table, block, len(weights)))


def cross_validate_k(table: Table, kind: str, ks=range(2, 6), r: int = 2, folds: int = 5, seed: int = 0, **options) -> list[tuple]:
    """(K, fold, score): log likelihood per row of subjects held out in turn, by folds of a hash; all folds of all K in one scan a round."""
    jobs = [(k, f) for k in ks if k <= table.subjects for f in range(folds)]
    inside = [Weight("inside", seed, f, folds=folds) for f in range(folds)]
    sizes = [v[0] for v in draw_sums(table, inside)]
    jobs = [(k, f) for k, f in jobs if sizes[f] > 0 and table.subjects - sizes[f] >= k]
    found = fit_many(table, [Spec(checks.model_type(kind), k, r, "kmeans", seed, Weight("fold", seed, f, folds=folds), **options) for k, f in jobs])
    scored = evaluate(table, found, [inside[f] for _, f in jobs], held_out=True) if jobs else []
    return [(k, f, e["loglik"] / e["rows"]) for (k, f), e in zip(jobs, scored) if e["rows"] > 0]


def cross_validate_r(table: Table, rs, model: str = "FA", folds: int = 5, metric: str = "negLogLik", seed: int = 0) -> list[tuple]:
    """(r, fold, score) of one component for all, lower is better: one scan gives the sums of each fold; training sums are the total less the fold's."""
    from strandmix.operators import project as P

    model = {"MFA": "FA", "MPCA": "PPCA"}.get(model.upper(), model.upper())
    parts = draw_sums(table, [Weight("inside", seed, f, folds=folds) for f in range(folds)])
    total = sum(parts)
    rows = []
    for r in rs:
        for f, own in enumerate(parts):
            if own[0] <= 0 or total[0] - own[0] <= 0:
                continue
            train, test = table.one((total - own)[1:]), table.one(own[1:])
            n, mean, cov = train.pooled()
            c = L.fa_em(n, mean, cov, r, 50) if model == "FA" else L.ppca_closed(mean, cov, r)
            if metric == "negLogLik":
                score = -float(L.log_likelihoods(test.n, test.scatter(c.mean), c.cov).sum()) / float(test.n.sum())
            else:
                a = np.eye(table.width) - P.hat("mfa" if model == "FA" else "mpca", c)
                score = float(np.sqrt(np.einsum("jk,kl,jl->", a, test.scatter(c.mean).sum(axis=0), a)))
            rows.append((int(r), f, score))
    return rows
