"""The number of factors, single models and the comparison of methods, over statistics that stay on the cluster.

Errors, likelihoods of one component and variances explained are linear in the statistics. So a cluster's pooled ones, as those of a single
subject, say all that a cluster's subjects would: one scan pools them for all fits, and the figures are those of the operators in memory.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmix.functions import checks
from strandmix.operators import baselines as B
from strandmix.operators import criteria as C
from strandmix.operators import evaluate as E
from strandmix.operators import fits as T
from strandmix.operators import project as P
from strandmix.operators import selection as Q
from strandmix.operators import suffstats as S
from strandmix.operators import twostep as Two
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats
from strandmix.sources.panel import Panel


def by_cluster(table: T.Table, fits: list[Fit]) -> list[tuple[Stats, Fit]]:
    """Per fit its clusters that have subjects, each as one subject with their pooled statistics, and the fit with these as its subjects; one scan for all."""
    labels = [T._labeller(f, table) for f in fits]
    ends = np.cumsum([0, *(x.k for x in labels)]).tolist()

    def block(ids: np.ndarray, x: np.ndarray, z0: np.ndarray | None) -> np.ndarray:
        marks = np.zeros((len(ids), ends[-1]))
        for one, at in zip(labels, ends):
            marks[np.arange(len(ids)), at + one.hard(ids, x, None)] = 1
        return marks.T @ x

    found, out, m = T._summed(table, block, ends[-1]), [], table.width
    for fit, a, b in zip(fits, ends, ends[1:]):
        k = np.flatnonzero(found[a:b, 0] > 0)
        v = found[a:b][k]
        stats = Stats(k + 1, v[:, 0], v[:, 1 : m + 1], S.upper_to_full(v[:, m + 1 :], m), table.centre)
        out.append((stats, replace(fit, ids=k + 1, z=k + 1)))
    return out


def smoothness(table: T.Table, squares: DataFrame, fits: list[Fit]) -> list[float]:
    """Per fit the sum of squared second differences of all scores, from ``selection.difference_squares``; one scan for all."""
    m = table.width
    joined = replace(table, df=table.df.select("subject_id", "x").join(squares, "subject_id"))
    labels = [T._labeller(f, table) for f in fits]
    forms = []
    i, j = np.triu_indices(m)
    for f in fits:
        scorer = P.fa_scorer if f.kind == "mfa" else P.ppca_scorer
        b = [scorer(c) for c in f.components]
        forms.append(np.stack([(x.T @ x)[i, j] * np.where(i == j, 1, 2) for x in b]))

    def block(ids: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        d = np.stack(list(d))
        return np.array([[(form[own.hard(ids, x, None)] * d).sum() for own, form in zip(labels, forms)]])

    return T._summed(joined, block, 1)[0].tolist()


def criteria_table(table: T.Table, kind: str, k: int, rs=range(1, 6), rotate: bool = False, squares: DataFrame | None = None, **options) -> list[dict]:
    """``selection.criteria_table`` for any number of subjects: fits of all r advance together."""
    rs = [r for r in rs if r <= table.width]
    fits = T.fit_best(table, [(k, r) for r in rs], kind, **options)
    smooth = smoothness(table, squares, fits) if squares is not None else [None] * len(fits)
    return [T._row(table, f, VAF=P.vaf(stats, own), VSS=Q.vss([c.loadings for c in f.components], rotate=rotate), smoothness=s) for f, (stats, own), s in zip(fits, by_cluster(table, fits), smooth)]


def clusterwise(table: T.Table, kind: str, k: int, rs=range(1, 6), how: str = "max", criteria=("VAF", "VSS"), r_init: int | None = None, seed: int = 0) -> dict:
    """``selection.clusterwise`` for any number of subjects: a fit at a middle r, then r for each cluster by one-cluster fits to its pooled statistics, and both combined."""
    rs = [r for r in rs if r <= table.width]
    base = T.fit_best(table, [(k, r_init or int(np.round(np.median(rs))))], kind, seed=seed)[0]
    stats, _ = by_cluster(table, [base])[0]
    per, tables = {c: min(rs) for c in range(1, k + 1)}, {}
    for at, c in enumerate(stats.ids.tolist()):
        if base.extra["sizes"][c - 1] >= 2:
            tables[c] = Q.criteria_table(stats.pick([at]), checks.model_type(kind), 1, rs, seed=seed)
            per[c] = Q._best_of(tables[c], criteria)
    values = list(per.values())
    r = {"max": max(values), "min": min(values), "mean": int(np.round(np.mean(values))), "majority": min(values, key=lambda x: (-values.count(x), x))}[how]
    return {"r": int(r), "per_cluster": per, "tables": tables, "fit": base}


def select_r(panel: Panel, table: T.Table, kind: str, k: int, rs=range(1, 6), method: str = "bic", scope: str = "global", how: str = "max", threshold: float = 0.9, folds: int = 5, seed: int = 0, criteria=("VAF", "VSS")) -> dict:
    """``selection.select_r`` for any number of subjects."""
    rs = [r for r in rs if r <= table.width]
    if scope == "clusterwise":
        return clusterwise(table, kind, k, rs, how, criteria, seed=seed)
    if scope in ("global-first", "hybrid"):
        first = select_r(panel, table, kind, k, rs, "cv", folds=folds, seed=seed)["r"]
        if scope == "global-first":
            return {"r": first, "fit": T.fit_best(table, [(k, first)], kind, seed=seed)[0]}
        return clusterwise(table, kind, k, rs, how, criteria, first, seed) | {"r_global": first}
    if method == "pa":
        return Q.parallel_analysis(panel, rs, seed=seed)
    if method == "cv":
        rows = T.cross_validate_r(table, rs, kind, folds, seed=seed)
        mean = {r: np.mean([s for q, _, s in rows if q == r]) for r in rs}
        best = min(mean, key=lambda r: (mean[r], r))
        own = [s for q, _, s in rows if q == best]
        edge = mean[best] + (np.std(own, ddof=1) / np.sqrt(len(own)) if len(own) > 1 else 0.0)
        return {"r": min(r for r in rs if mean[r] <= edge), "summary": rows}
    squares = Q.difference_squares(panel) if method in ("smoothness", "multicriteria") else None
    rows = criteria_table(table, kind, k, rs, squares=squares, seed=seed)
    return {"r": Q.choose_r(rows, method, rs, threshold), "summary": rows}


def singles(table: T.Table, r: int = 2) -> tuple[B.Single, B.Single]:
    """One factor analysis and one PCA of all rows, from their pooled statistics."""
    one = table.one(T._summed(table, lambda ids, x, z0: x.sum(axis=0)[None], 1)[0])
    return B.single_fa(one, r), B.single_pca(one, r)


def compare_all(table: T.Table, k: int, r: int, truth: DataFrame | None = None, seed: int = 0, **options) -> list[dict]:
    """The six methods on one panel: a row each with BIC (over subjects), ARI against ``truth`` (subject_id, z_true), SSE and VAF; None where a method has none."""
    return compare_cells(table, [(k, r)], truth, seed, **options)[0]


def compare_cells(table: T.Table, cells: list[tuple[int, int]], truth: DataFrame | None = None, seed: int = 0, **options) -> list[list[dict]]:
    """``compare_all`` for each (K, r): the two-step baselines of all cells advance together, and so do all mixtures."""
    one = table.one(T._summed(table, lambda ids, x, z0: x.sum(axis=0)[None], 1)[0])
    total = float(np.trace(one.scatter(one.pooled()[1])[0]))

    def ari(labels: DataFrame) -> float | None:
        return None if truth is None else E.ari_frame(labels.join(truth, "subject_id"), "z_true", "z").first()[0]

    methods, kinds = (("TwoStep_FA", "FA"), ("TwoStep_PCA", "PCA")), (("MixtureFA", "mfa"), ("MixturePCA", "mpca"))
    steps = iter(Two.two_steps(table, [(r, k, method) for k, r in cells for _, method in methods], seed))
    fits = T.fit_wanted(table, [T.wanted(kind, k, r, seed=seed, **options) for k, r in cells for _, kind in kinds])
    pooled = iter(zip(fits, by_cluster(table, fits)))
    out = []
    for k, r in cells:
        rows = [{"Method": name, "BIC": x.bic, "ARI": None, "SSE": x.sse, "VAF": 1 - x.sse / total} for name, x in zip(("SingleFA", "SinglePCA"), (B.single_fa(one, r), B.single_pca(one, r)))]
        for name, _ in methods:
            got = next(steps)
            rows.append({"Method": name, "BIC": None, "ARI": ari(got.assignments), "SSE": got.sse, "VAF": got.vaf})
        for name, kind in kinds:
            got, (stats, own) = next(pooled)
            sse = float(P.subject_sse(stats, own, kind="pca" if kind == "mpca" else None).sum())
            rows.append({"Method": name, "BIC": C.bic(kind, got.loglik, k, r, table.width, table.subjects), "ARI": ari(T.assignments(table, [got])), "SSE": sse, "VAF": 1 - sse / total})
        out.append(rows)
    return out


def modelsel_rows(table: T.Table, truth: dict, mode: str = "modelsel", ks=range(1, 6), rs=range(1, 6), strategies=("grid", "twostage"), methods=("mfa", "mpca"), criterion: str = "ICL", temperature: float = 2.0, seed: int = 0, **options) -> list[dict]:
    """``sweeps.modelsel_run`` on a given panel with ``truth`` (K, r): each mixture under each strategy, in any of its modes; all of them advance together."""
    from strandmix.operators.sweeps import MODES

    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    k, r, out = int(truth["K"]), int(truth["r"]), []
    ks, rs = [k] if mode == "oracle_Kr" else list(ks), [r] if mode != "modelsel" else list(rs)
    runs, r_fixed = [(kind, strategy) for kind in methods for strategy in strategies], rs[0] if len(rs) == 1 else 2
    plans = [T.grid_plan(table, kind, ks, rs, seed=seed, **options) if strategy == "grid" else T.two_stage_plan(table, kind, ks, rs, r_fixed, criterion, temperature, seed, **options) for kind, strategy in runs]
    found = T.together(table, plans)
    for (kind, strategy), got, (stats, own) in zip(runs, found, by_cluster(table, [x.best for x in found])):
        best = got.best
        bic = C.bic(best.kind, best.loglik, got.best_k, got.best_r, table.width, table.rows)
        right = {"K_correct": got.best_k == k, "r_correct": got.best_r == r, "Kr_correct": (got.best_k, got.best_r) == (k, r)}
        names = {"method": kind, "selection_strategy": strategy, "mode": mode, "r_mode": "select" if mode == "modelsel" else "oracle", "seed": seed}
        out.append(names | {"N": table.subjects, "M": table.width, "K_true": k, "r_true": r, "K_hat": got.best_k, "r_hat": got.best_r, "VAF": P.vaf(stats, own), "logLik": best.loglik, "BIC": bic} | right)
    return out


def kselect_rows(table: T.Table, k_true: int, ks=range(2, 7), r: int = 2, seed: int = 0, **options) -> list[dict]:
    """``sweeps.kselect_run`` on a given panel: K by BIC, by ICL at three temperatures, and by the vote of BIC and two of these."""
    from strandmix.operators.sweeps import vote

    ks = [k for k in ks if k <= table.subjects]
    fits = T.fit_best(table, [(k, min(r, table.width)) for k in ks], "mfa", seed=seed, **options)
    bic = {k: T._row(table, f)["BIC"] for k, f in zip(ks, fits)}
    scores = {"BIC": bic}
    for t in (1, 2, 3):
        scores[f"ICL_T{t}"] = {k: bic[k] + 2 * e["entropy"] for k, e in zip(ks, T.evaluate(table, fits, temperature=t))}
    best = {name: min(x, key=lambda k, x=x: (x[k], k)) for name, x in scores.items()}
    best["Ensemble"] = vote([best[x] for x in ("BIC", "ICL_T1", "ICL_T2")])
    return [{"method": name, "K_hat": k, "K_correct": k == k_true} for name, k in best.items()]
