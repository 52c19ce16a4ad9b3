"""Choosing the number of clusters K and of factors r."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import criteria as C
from strandmix.operators import mixture as M
from strandmix.operators import project as P
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats
from strandmix.sources.panel import Panel


@dataclass(frozen=True)
class Selection:
    """What was chosen, the table of what was tried, and the models by (K, r)."""

    best_k: int
    best_r: int
    best: Fit | None
    summary: list[dict]
    models: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table as a DataFrame; columns that a stage lacks are null."""
        names = list(dict.fromkeys(k for row in self.summary for k in row))
        kinds = {n: next(("string" if isinstance(v, str) else "int" if isinstance(v, (int, np.integer)) else "double") for v in [*(row[n] for row in self.summary if row.get(n) is not None), 0.0]) for n in names}
        cast = {"string": str, "int": int, "double": float}
        return spark.createDataFrame([tuple(None if row.get(n) is None else cast[kinds[n]](row[n]) for n in names) for row in self.summary], ", ".join(f"{n} {kinds[n]}" for n in names))


def _row(stats: Stats, fit: Fit, **more) -> dict:
    n = float(stats.n.sum())
    return {"K": fit.n_clusters, "r": fit.n_factors, "logLik": fit.loglik, "BIC": C.bic(fit.kind, fit.loglik, fit.n_clusters, fit.n_factors, stats.width, n)} | more


def grid(stats: Stats, kind: str, ks=range(1, 6), rs=range(1, 6), spark: SparkSession | None = None, **options) -> Selection:
    """All (K, r): the smallest BIC over all rows wins. With a session, each cell is a task of its own over broadcast statistics."""
    cells = [(k, r) for r in rs for k in ks if k <= len(stats) and r <= stats.width]
    models = dict(zip(cells, _fits(spark, stats, [(kind, k, r, options) for k, r in cells])))
    summary = sorted((_row(stats, x) for x in models.values()), key=lambda row: (row["BIC"], row["K"], row["r"]))
    best = (summary[0]["K"], summary[0]["r"])
    return Selection(*best, models[best], summary, models, {"strategy": "grid", "criterion": "BIC"})


def _spread(spark: SparkSession, stats: Stats, jobs: list[tuple]) -> list:
    """Fits (kind, k, r, options) by tasks; only their parameters and labels come back."""
    rows = _tasks(spark, stats, jobs, lambda given, job: [(pickle.dumps(M.fit(given, *job[:3], **job[3])),)], "model binary")
    return [pickle.loads(row.model) for row in sorted(rows.collect(), key=lambda row: row.job)]


def _tasks(spark: SparkSession, stats: Stats, jobs: list[tuple], run, schema: str) -> DataFrame:
    """The rows of ``run(stats, job)`` for each job, as a table with the job's number; each job is a task's, over broadcast statistics."""
    sent, names = spark.sparkContext.broadcast(stats), [x.split()[0] for x in schema.split(", ")]

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(int(i), *row) for i, job in zip(rows["job"], rows["what"]) for row in run(sent.value, pickle.loads(job))]
        return pd.DataFrame(out, columns=["job", *names])

    table = spark.createDataFrame([(i, pickle.dumps(x)) for i, x in enumerate(jobs)], "job int, what binary")
    return table.repartition(max(1, min(len(jobs), spark.sparkContext.defaultParallelism)), "job").groupBy("job").applyInPandas(each, f"job int, {schema}")


def _fits(spark: SparkSession | None, stats: Stats, jobs: list[tuple]) -> list[Fit]:
    """Fits (kind, k, r, options), by tasks where there is a session."""
    return [M.fit(stats, *job[:3], **job[3]) for job in jobs] if spark is None else _spread(spark, stats, jobs)


def two_stage(stats: Stats, kind: str, ks=range(1, 6), rs=range(1, 6), r_fixed: int = 2, criterion: str = "ICL", temperature: float = 1.0, seed: int = 0, spark: SparkSession | None = None, **options) -> Selection:
    """First K at a fixed r, by ICL (of a short fit from three random starts) or BIC; then r at that K by BIC. With a session, fits are tasks."""
    if criterion not in ("ICL", "BIC"):
        raise ValueError(f"unknown criterion {criterion!r}")
    summary, models, r0 = [], {}, min(r_fixed, stats.width)
    ks, rs = [k for k in ks if k <= len(stats)], [r for r in rs if r <= stats.width]
    short = {"n_init": 3, "use_kmeans": False, "seed": seed + 1, "max_iter": 10, "tol": 1e-10}
    jobs = [(kind, k, r0, {"seed": seed} | options) for k in ks] + [(kind, k, r0, short) for k in ks if criterion == "ICL"]
    found = _fits(spark, stats, jobs)
    for at, k in enumerate(ks):
        models[k, r0] = found[at]
        row = _row(stats, found[at], stage="K")
        if criterion == "ICL":
            extra = found[len(ks) + at]
            resp = C.tempered(extra.resp, temperature) if temperature != 1 else extra.resp
            bic = C.bic(kind, extra.loglik, k, r0, stats.width, float(stats.n.sum()))
            row |= {"entropy": C.entropy(resp), "ICL": C.icl(bic, resp)}
        summary.append(row)
    best_k = min(summary, key=lambda row: (row[criterion], row["K"]))["K"]
    missing = [r for r in rs if (best_k, r) not in models]
    models |= {(best_k, r): x for r, x in zip(missing, _fits(spark, stats, [(kind, best_k, r, {"seed": seed} | options) for r in missing]))}
    second = [_row(stats, models[best_k, r], stage="r") for r in rs]
    best_r = min(second, key=lambda row: (row["BIC"], row["r"]))["r"]
    return Selection(best_k, best_r, models[best_k, best_r], summary + second, models, {"strategy": "twostage", "criterion": criterion, "temperature": temperature})


def select_k_r(stats: Stats | Panel, kind: str, strategy: str = "grid", criterion: str = "ICL", **options) -> Selection:
    """Either strategy by name; the grid always goes by BIC. A panel's statistics stay on the cluster, whatever its size."""
    if isinstance(stats, Panel):
        from strandmix.operators import fits as T

        if strategy not in ("grid", "twostage"):
            raise ValueError(f"unknown strategy {strategy!r}")
        with T.statistics(stats) as table:
            return T.grid(table, kind, **options) if strategy == "grid" else T.two_stage(table, kind, criterion=criterion, **options)
    if strategy == "grid":
        return grid(stats, kind, **options)
    if strategy == "twostage":
        return two_stage(stats, kind, criterion=criterion, **options)
    raise ValueError(f"unknown strategy {strategy!r}")


def evaluation(selection: Selection, spark: SparkSession) -> DataFrame:
    """Per model by BIC: K, r, likelihood, BIC, smallest and largest cluster."""
    rows = []
    for (k, r), fit in selection.models.items():
        sizes = np.unique(fit.z, return_counts=True)[1]
        bic = next(row["BIC"] for row in selection.summary if (row["K"], row["r"]) == (k, r))
        rows.append((k, r, fit.loglik, bic, int(sizes.min()), int(sizes.max())))
    return spark.createDataFrame(rows, "K int, r int, logLik double, BIC double, min_size int, max_size int").orderBy("BIC")


def r_summary(found: dict, spark: SparkSession, kind: str = "", scope: str = "", how: str = "") -> DataFrame:
    """(item, cluster, value, text) of what ``select_r`` found: model type, scope, the r chosen, r of all data and of each cluster, fit."""
    rows = [("model_type", None, None, kind or None), ("scope", None, None, scope or None), ("r", None, float(found["r"]), None)]
    if "r_global" in found:
        rows.append(("r_global", None, float(found["r_global"]), None))
    rows += [("r_cluster", int(k), float(v), how or None) for k, v in sorted(found.get("per_cluster", {}).items())]
    if (fit := found.get("fit")) is not None:
        rows.append(("logLik", None, float(fit.loglik), f"{fit.n_clusters} clusters, {fit.n_factors} factors"))
    rows += [("limit", j + 1, float(v), None) for j, v in enumerate(found.get("limits", []))]
    return spark.createDataFrame(rows, "item string, cluster int, value double, text string")


def model_by(selection: Selection, k: int, r: int) -> Fit | None:
    """The model of (K, r), if it was tried."""
    return selection.models.get((k, r))


def _draw(stats: Stats, kind: str, k: int, r: int, b: int, ratio: float, seed: int, options: dict) -> list[tuple]:
    """(K, b, subject_id, z) of a fit to a subsample without replacement."""
    chosen = np.sort(np.random.default_rng([seed, k, b]).choice(len(stats), max(k, int(ratio * len(stats))), replace=False))
    got = M.fit(stats.pick(chosen), kind, k, r, seed=seed + b, **options)
    return [(k, b, int(i), int(z)) for i, z in zip(got.ids, got.z)]


def bootstrap_draws(spark: SparkSession, stats: Stats, kind: str, ks=range(2, 6), r: int = 2, n_boot: int = 50, ratio: float = 0.8, seed: int = 0, **options) -> DataFrame:
    """(K, b, subject_id, z) of fits to subsamples without replacement; each draw is a task's."""
    jobs = [(k, b) for k in ks if k <= len(stats) for b in range(n_boot)]
    return _tasks(spark, stats, jobs, lambda given, job: _draw(given, kind, job[0], r, job[1], ratio, seed, options), "K int, b int, subject_id long, z int").drop("job")


#: Subjects of a block, which is a row of its own when blocks meet; subjects of two blocks whose pairs are counted at once.
PAIR_BLOCK, PAIR_SLAB = 8192, 1024


def _bits(marks: np.ndarray) -> np.ndarray:
    """(words, N): rows of marks as bits of 64-bit words."""
    packed = np.packbits(np.pad(marks, ((0, 0), (0, -marks.shape[1] % 64))), axis=1)
    return np.ascontiguousarray(packed.view(np.uint64).T)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(N, N'): bits that two sets of rows have in common."""
    out = np.zeros((x.shape[1], y.shape[1]), dtype=np.intp)
    for a, b in zip(x, y):
        out += np.bitwise_count(a[:, None] & b)
    return out


def stability(labels: DataFrame, min_joint: int = 5, block: int = PAIR_BLOCK) -> DataFrame:
    """(K, stability, n_pairs) from labels (K, b, subject_id, z): 1 - 4 mean(p (1 - p)) over pairs of subjects drawn together often enough.

    A subject is two sets of bits: the draws that it is in, and its labels there. A block of subjects is one row; blocks meet in tasks, which
    count their pairs by common bits, a slab at a time, and tell how many pairs have so many draws and labels in common. So pairs are never
    rows, and a subject is sent once for each block of others. Time grows with the square of the subjects, memory doesn't.
    """
    sizes = labels.groupBy("K").agg(F.approx_count_distinct("subject_id").alias("n"), F.collect_set("b").alias("b"), F.collect_set("z").alias("z")).collect()
    most = max((row["n"] for row in sizes), default=0)
    all_b, all_z = (np.array(sorted({x for row in sizes for x in row[c]})) for c in ("b", "z"))
    draws = len(all_b)
    # At least so many blocks that their meetings keep all cores busy, unless these would be smaller than a slab.
    cores = labels.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-most // block), min(-(-most // PAIR_SLAB), int(np.ceil(np.sqrt(4 * cores)))), 1)
    own = labels.groupBy("K", "subject_id").agg(F.collect_list("b").alias("b"), F.collect_list("z").alias("z"))
    placed = own.select("K", F.pmod(F.xxhash64("subject_id"), F.lit(blocks)).cast("int").alias("at"), "b", "z")

    def pack(key, x: pd.DataFrame) -> pd.DataFrame:
        there, chosen = np.zeros((len(x), draws), bool), np.zeros((len(x), draws, len(all_z)), bool)
        at, b, z = np.repeat(np.arange(len(x)), x["b"].map(len)), np.searchsorted(all_b, np.concatenate(x["b"].to_numpy())), np.searchsorted(all_z, np.concatenate(x["z"].to_numpy()))
        there[at, b] = chosen[at, b, z] = True
        return pd.DataFrame({"K": [key[0]], "at": [key[1]], "n": [len(x)], "there": [_bits(there).tobytes()], "chosen": [_bits(chosen.reshape(len(x), -1)).tobytes()]})

    packed = placed.groupBy("K", "at").applyInPandas(pack, "K int, at int, n long, there binary, chosen binary")
    # Both blocks of a meeting come as rows of its own group; i <= j.
    row = F.struct("at", "n", "there", "chosen")
    meetings = packed.select("K", row.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select("K", F.least("own.at", "other").alias("i"), F.greatest("own.at", "other").alias("j"), "own.*")

    def count(key, x: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        if not same and len(x) < 2:
            return pd.DataFrame({"K": [], "joint": [], "same": [], "pairs": []})
        sides = [[np.frombuffer(data, np.uint64).reshape(-1, n) for data in both] for n, *both in zip(x["n"], x["there"], x["chosen"])]
        (p, a), (q, b) = sides[0], sides[-1]
        table, slab = np.zeros((draws + 1) ** 2, dtype=np.int64), PAIR_SLAB
        for i in range(0, p.shape[1], slab):
            for j in range(i if same else 0, q.shape[1], slab):
                code = _common(p[:, i : i + slab], q[:, j : j + slab]) * (draws + 1) + _common(a[:, i : i + slab], b[:, j : j + slab])
                table += np.bincount(code[np.triu_indices(len(code), 1)] if same and i == j else code.ravel(), minlength=len(table))
        found = np.flatnonzero(table)
        return pd.DataFrame({"K": np.full(len(found), key[0], np.int32), "joint": found // (draws + 1), "same": found % (draws + 1), "pairs": table[found]})

    counted = meetings.groupBy("K", "i", "j").applyInPandas(count, "K int, joint long, same long, pairs long").where(F.col("joint") >= min_joint)
    share = F.col("same") / F.col("joint")
    total = counted.groupBy("K").agg(F.sum(share * (1 - share) * F.col("pairs")).alias("total"), F.sum("pairs").alias("n_pairs")).where("n_pairs > 0")
    return total.select("K", (1 - 4 * F.col("total") / F.col("n_pairs")).alias("stability"), "n_pairs")


def best_k_by_stability(table: DataFrame) -> DataFrame:
    """One row: the K with most stability, the smallest of equals."""
    return table.orderBy(F.desc("stability"), "K").limit(1)


def _folds(stats: Stats, folds: int, seed: int) -> np.ndarray:
    """The fold of each subject."""
    return np.random.default_rng(seed).permutation(len(stats)) % folds


def cross_validate_k(spark: SparkSession, stats: Stats, kind: str, ks=range(2, 6), r: int = 2, folds: int = 5, seed: int = 0, **options) -> DataFrame:
    """(K, fold, score): log likelihood per row of subjects held out in turn; each fold is a task's."""

    def run(given, job):
        k, f = job
        fold = _folds(given, folds, seed)
        train, test = given.pick(fold != f), given.pick(fold == f)
        if len(train) < k or not len(test):
            return []
        got = M.fit(train, kind, k, r, seed=seed, **options)
        return [(k, f, C.loglik(test, got, held_out=True) / float(test.n.sum()))]

    return _tasks(spark, stats, [(k, f) for k in ks for f in range(folds)], run, "K int, fold int, score double").drop("job")


def one_se_rule(scores: DataFrame, key: str, value: str, higher: bool = True) -> DataFrame:
    """Per key the mean and standard error over folds, and whether it is the smallest key within one standard error of the best."""
    n = F.count(value)
    table = scores.groupBy(key).agg(F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(n)).alias("se"), n.alias("folds"))
    best = table.select(F.col("mean").alias("best_mean"), F.col("se").alias("best_se")).orderBy(F.desc("best_mean") if higher else F.asc("best_mean")).limit(1)
    joined = table.join(F.broadcast(best))
    edge = F.coalesce("best_se", F.lit(0.0))
    within = (F.col("mean") >= F.col("best_mean") - edge) if higher else (F.col("mean") <= F.col("best_mean") + edge)
    chosen = joined.where(within).agg(F.min(key).alias("chosen"))
    return table.join(F.broadcast(chosen)).select(key, "mean", "se", "folds", (F.col(key) == F.col("chosen")).alias("selected"))


def vaf_rule(table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row: the smallest r with enough VAF, else the largest r; and the r with the smallest BIC."""
    return table.agg(F.coalesce(F.min(F.when(F.col("VAF") >= threshold, F.col("r"))), F.max("r")).alias("r_vaf"), F.min_by("r", F.struct("BIC", "r")).alias("r_bic"))


def criteria_table(stats: Stats, kind: str, k: int, rs=range(1, 6), rotate: bool = False, smooth=None, spark: SparkSession | None = None, **options) -> list[dict]:
    """Per r at one K: likelihood, BIC, VAF, VSS and, with ``smooth`` (N, M, M: summed squares of second differences), smoothness. With a session, fits are tasks."""
    rows = []
    for got in _fits(spark, stats, [(kind, k, r, options) for r in rs if r <= stats.width]):
        rows.append(_row(stats, got, VAF=P.vaf(stats, got), VSS=vss([c.loadings for c in got.components], rotate=rotate), smoothness=smoothness(got, smooth) if smooth is not None else None))
    return rows


def difference_squares(panel: Panel) -> DataFrame:
    """(subject_id, d array): upper triangles of each subject's sum of products of second differences; smoothness of any scores follows from it."""
    from strandmix.operators import suffstats as S

    d = S.second_differences(panel)
    m = panel.channels
    return d.groupBy("subject_id").agg(F.array(*(F.coalesce(F.sum(F.col(m[i]) * F.col(m[j])), F.lit(0.0)) for i in range(len(m)) for j in range(i, len(m)))).alias("d"))


def smoothness(fit: Fit, squares: np.ndarray) -> float:
    """Sum over subjects of tr(B D B'), B being the cluster's scorer."""
    scorer = P.fa_scorer if fit.kind == "mfa" else P.ppca_scorer
    b = [scorer(c) for c in fit.components]
    return float(sum(np.trace(b[z - 1] @ d @ b[z - 1].T) for z, d in zip(fit.z, squares)))


def vss(loadings: list[np.ndarray], threshold: float = 0.5, method: str = "threshold", rotate: bool = False) -> float:
    """Share of channels with exactly one absolute loading over the threshold, or mean share of the largest squared loading."""
    if rotate:
        loadings = [L.varimax(x)[0] for x in loadings]
    if method == "threshold":
        simple = [np.ones(len(x), bool) if x.shape[1] < 2 else (np.abs(x) > threshold).sum(axis=1) == 1 for x in loadings]
        return float(np.concatenate(simple).mean()) if simple else 0.0
    squares = np.concatenate([np.stack([(x**2).max(axis=1), (x**2).sum(axis=1)], axis=1) for x in loadings])
    squares = squares[squares[:, 1] > 0]
    return float((squares[:, 0] / squares[:, 1]).mean()) if len(squares) else float("nan")


def vss_frame(loadings: DataFrame, threshold: float = 0.5, method: str = "threshold") -> DataFrame:
    """One row: the same from (k, channel, factor, value)."""
    square = F.col("value") * F.col("value")
    per = loadings.groupBy("k", "channel").agg(F.sum((F.abs("value") > threshold).cast("int")).alias("strong"), F.count("*").alias("r"), F.max(square).alias("top"), F.sum(square).alias("total"))
    if method == "threshold":
        return per.agg(F.avg(((F.col("strong") == 1) | (F.col("r") < 2)).cast("double")).alias("vss"))
    return per.where("total > 0").agg(F.avg(F.col("top") / F.col("total")).alias("vss"))


def _scaled(col: str) -> Column:
    """Min-max over all rows of a table of candidates; 0.5 where all are equal."""
    w = W.partitionBy()
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(low == high, F.lit(0.5)).otherwise(F.try_divide(F.col(col) - low, high - low))


def multicriteria(table: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.9) -> DataFrame:
    """Candidates (r, BIC, VAF, smoothness, VSS) with their composite score and whether they are chosen: the least score among those with enough VAF, else the most VAF."""
    w = weights or {"BIC": 1.0, "VAF": 1.0, "smoothness": 1.0, "VSS": 1.0}
    score = w["BIC"] * _scaled("BIC") + w["VAF"] * (1 - _scaled("VAF")) + w["smoothness"] * _scaled("smoothness") + w["VSS"] * (1 - _scaled("VSS"))
    scored = table.withColumn("score", score)
    order = W.orderBy(F.desc(F.col("VAF") >= threshold), F.when(F.col("VAF") >= threshold, F.col("score")).otherwise(-F.col("VAF")), "r")
    return scored.withColumn("selected", F.row_number().over(order) == 1)


def by_smoothness(rows: list[dict], threshold: float = 0.9, weight: float = 1e-3) -> int:
    """The r with the least BIC plus weighted smoothness among those with enough VAF, else with the most VAF."""
    good = [x for x in rows if x["VAF"] >= threshold]
    return (min(good, key=lambda x: (x["BIC"] + weight * x["smoothness"], x["r"])) if good else max(rows, key=lambda x: (x["VAF"], -x["r"])))["r"]


def by_vss(rows: list[dict], threshold: float = 0.9) -> int:
    """The r with the most VSS among those with enough VAF, else with the most VAF."""
    good = [x for x in rows if x["VAF"] >= threshold]
    return (max(good, key=lambda x: (x["VSS"], -x["r"])) if good else max(rows, key=lambda x: (x["VAF"], -x["r"])))["r"]


def best_r(table: DataFrame, criteria=("VAF", "VSS", "smoothness"), weights: dict[str, float] | None = None, adjust: str = "logr", w_elbow: float = 0.0, w_r: float = 0.0) -> DataFrame:
    """Candidates (r, VAF, VSS, smoothness) with score and choice: the largest score, the smallest r of equals within 1e-10.

    With several criteria each is scaled to 0..1 and weighted. If all but VAF are flat, the step in VAF (0.5) and r (0.2) take their place.
    """
    weights = weights or {"VAF": 0.4, "VSS": 0.4, "smoothness": 0.2}
    every = W.partitionBy()
    if len(criteria) == 1:
        score = -F.col("smoothness") if criteria[0] == "smoothness" else F.col(criteria[0])
        scored = table.withColumn("score", score)
    else:
        r = F.col("r").cast("double")
        scale = {"logr": F.ln(F.greatest(r, F.lit(2.0))), "r": F.greatest(r, F.lit(1.0)), "r2": F.greatest(r * r, F.lit(1.0)), "max": F.greatest(F.max("VSS").over(every), F.lit(1e-300)), "none": F.lit(1.0)}[adjust]
        flat = F.lit("VAF" in criteria)
        for c in ("VSS", "smoothness"):
            if c in criteria:
                flat = flat & (F.coalesce(F.max(c).over(every) - F.min(c).over(every), F.lit(0.0)) < 1e-10)
        t = table.withColumns({"vss_": F.col("VSS") / scale, "step_": F.coalesce(F.col("VAF") - F.lag("VAF").over(W.orderBy("r")), F.lit(0.0)), "r_": r, "flat_": flat})
        score = F.lit(0.0)
        for c, name, sign in (("VAF", "VAF", 1.0), ("VSS", "vss_", 1.0), ("smoothness", "smoothness", -1.0)):
            if c in criteria:
                score = score + sign * weights[c] * F.coalesce(_scaled(name), F.lit(0.0))
        elbow = F.when(F.col("flat_") & F.lit(w_elbow == 0), F.lit(0.5)).otherwise(F.lit(float(w_elbow)))
        small = F.when(F.col("flat_") & F.lit(w_r == 0), F.lit(0.2)).otherwise(F.lit(float(w_r)))
        scored = t.withColumn("score", score + elbow * _scaled("step_") - small * _scaled("r_")).drop("vss_", "step_", "r_", "flat_")
    tied = F.abs(F.col("score") - F.max("score").over(every)) < 1e-10
    return scored.withColumn("tied_", tied).withColumn("selected", F.row_number().over(W.orderBy(F.desc("tied_"), "r")) == 1).drop("tied_")


def combine_r(per_cluster: DataFrame, method: str = "max") -> DataFrame:
    """One row: r of all clusters from (k, r): max, min, mean rounded half to even, or the most frequent, the smallest of equals."""
    if method == "majority":
        return per_cluster.groupBy("r").agg(F.count("*").alias("n")).agg(F.max_by("r", F.struct(F.col("n"), -F.col("r"))).cast("int").alias("r"))
    how = {"max": F.max("r"), "min": F.min("r"), "mean": F.bround(F.avg("r"), 0)}[method]
    return per_cluster.agg(how.cast("int").alias("r"))


def cross_validate_r(stats: Stats, rs, model: str = "FA", folds: int = 5, metric: str = "negLogLik", seed: int = 0) -> list[tuple]:
    """(r, fold, score) of one component for all, subjects held out in turn; lower is better. Models by their mixture names count too."""
    model = {"MFA": "FA", "MPCA": "PPCA"}.get(model.upper(), model.upper())
    fold = np.random.default_rng(seed).permutation(len(stats)) % folds
    rows = []
    for r in rs:
        for f in range(folds):
            train, test = stats.pick(fold != f), stats.pick(fold == f)
            if not len(train) or not len(test):
                continue
            n, mean, cov = train.pooled()
            c = L.fa_em(n, mean, cov, r, 50) if model == "FA" else L.ppca_closed(mean, cov, r)
            if metric == "negLogLik":
                score = -float(L.log_likelihoods(test.n, test.scatter(c.mean), c.cov).sum()) / float(test.n.sum())
            else:
                a = np.eye(stats.width) - P.hat("mfa" if model == "FA" else "mpca", c)
                score = float(np.sqrt(np.einsum("jk,kl,jl->", a, test.scatter(c.mean).sum(axis=0), a)))
            rows.append((int(r), f, score))
    return rows


#: Places of a chunk, whose permutations a task draws by itself.
CHUNK = 1 << 16
#: Rows that a task deals out at once.
DEALT = 1 << 18


def _dealt_place(i: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """Where row i of n goes under a permutation drawn by ``key``: rounds that mix two halves of the number, until it lies below n."""
    half = max(1, -(-(n - 1).bit_length() // 2)) if n > 1 else 1
    mask, keys = np.uint64((1 << half) - 1), np.random.default_rng(key).integers(1, 1 << 62, 6, dtype=np.uint64)

    def mixed(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (h >> np.uint64(32)) & mask
        return left << np.uint64(half) | right

    out = mixed(i.astype(np.uint64))
    while (late := out >= n).any():
        out[late] = mixed(out[late])
    return out.astype(np.int64)


def _within(chunk: int, n: int, key: tuple[int, int, int], size: int) -> np.ndarray:
    """The permutation of a chunk's places under (seed, permutation, channel)."""
    return np.random.default_rng((*key, chunk)).permutation(min(size, n - chunk * size))


def _shuffled_place(i: np.ndarray, n: int, key: tuple[int, int, int], size: int | None = None) -> np.ndarray:
    """Where row i of n goes under the permutation of (seed, permutation, channel): dealt over all places by seed and channel, then permuted within its chunk.

    The deal is a permutation of all rows, so each of these is one as well; those of a channel differ within chunks.
    """
    size = size or CHUNK
    dealt = _dealt_place(i, n, (key[0], key[2]))
    chunk = dealt // size
    out = np.empty_like(dealt)
    for c in np.unique(chunk).tolist():
        own = chunk == c
        out[own] = c * size + _within(c, n, key, size)[dealt[own] - c * size]
    return out


#: Places that a task puts together at once.
PLACES = 1 << 16


def permuted_eigenvalues(rows: DataFrame, channels: list[str], permutations, seed: int = 0, places: int = PLACES) -> np.ndarray:
    """(permutations, channels): eigenvalues of the covariance when each channel's values are shuffled by themselves, over all rows.

    Rows are numbered, and each channel's values are dealt over chunks of places, in one shuffle whatever the number of permutations. A task
    then permutes a chunk's channels for each permutation and sums their products, ``places`` rows at a time. What all permutations of
    two channels share is which values meet in a chunk: 1 / CHUNK of the variance of their covariance. ``rows`` must come in the same
    partitions each time, as tables and kept frames do.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    m, numbers, size = len(channels), list(permutations), CHUNK
    kept = rows.select(*channels)
    counts = {row[0]: row[1] for row in kept.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    means = kept.agg(*(F.avg(c) for c in channels)).first()
    centre = np.array([x or 0.0 for x in means])
    offsets, n = {}, 0
    for part in sorted(counts):
        offsets[part], n = n, n + counts[part]
    chunks = max(1, -(-n // size))
    upper = np.triu_indices(m)

    def deal(batches):
        at, waiting = offsets.get(TaskContext.get().partitionId(), 0), []

        def dealt():
            nonlocal at
            x = np.concatenate(waiting)
            i = np.arange(at, at + len(x))
            at += len(x)
            waiting.clear()
            for j in range(m):
                to = _dealt_place(i, n, (seed, j))
                order = np.argsort(to)
                to, v = to[order], x[order, j]
                cuts = np.searchsorted(to // size, np.arange(chunks + 1))
                some = np.flatnonzero(np.diff(cuts))
                local = (to % size).astype("<i4")
                parts = [(cuts[c], cuts[c + 1]) for c in some]
                columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), j, np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([local[a:b].tobytes() for a, b in parts]), pa.array([v[a:b].tobytes() for a, b in parts])], names=["chunk", "j", "places", "v"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(np.column_stack([np.asarray(batch.column(j), dtype=float) - centre[j] for j in range(m)]))
            if sum(map(len, waiting)) >= DEALT:
                yield from dealt()
        if waiting:
            yield from dealt()

    def products(batches):
        now, x, total = None, None, np.zeros((len(numbers), m + len(upper[0])))

        def add():
            mixed = np.empty_like(x)
            for row, p in enumerate(numbers):
                for j in range(m):
                    mixed[j, _within(now, n, (seed, int(p), j), size)] = x[j]
                for a in range(0, x.shape[1], places):
                    part = mixed[:, a : a + places]
                    total[row] += np.concatenate([part.sum(axis=1), (part @ part.T)[upper]])

        for batch in batches:
            for c, j, to, v in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if c != now:
                    if now is not None:
                        add()
                    now, x = c, np.zeros((m, min(size, n - c * size)))
                x[j, np.frombuffer(to, "<i4")] = np.frombuffer(v)
        if now is not None:
            add()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, dtype=np.int64)), pa.array(list(total), pa.list_(pa.float64()))], names=["p", "s"])

    sent = kept.mapInArrow(deal, "chunk int, j int, places binary, v binary").repartition("chunk").sortWithinPartitions("chunk")
    found = sent.mapInArrow(products, "p long, s array<double>").groupBy("p").agg(Summarizer.sum(array_to_vector("s")).alias("s")).collect()
    out = np.zeros((len(numbers), m))
    for row in found:
        s = row["s"].toArray() / n
        out[numbers.index(row["p"])] = _eigenvalues(s[m:] - np.outer(s[:m], s[:m])[upper], m)
    return out


def _eigenvalues(upper, m: int) -> np.ndarray:
    cov = np.zeros((m, m))
    cov[np.triu_indices(m)] = upper
    return np.linalg.eigvalsh(cov + np.triu(cov, 1).T)[::-1]


def parallel_analysis(panel: Panel, rs, n_perm: int = 100, quantile: float = 0.95, seed: int = 0) -> dict:
    """Eigenvalues of the covariance against those of panels with each channel shuffled by itself; leading ones above the quantile count.

    All rows count in both, and draws are the same whatever the number of rows.
    """
    channels = list(panel.channels)
    m = len(channels)
    kept = panel.df.dropna(subset=channels).select(*channels).persist()
    try:
        one = kept.agg(*(F.covar_pop(channels[i], channels[j]) for i in range(m) for j in range(i, m))).first()
        observed = _eigenvalues([x or 0.0 for x in one], m)
        table = permuted_eigenvalues(kept, channels, range(n_perm), seed)
    finally:
        kept.unpersist()
    limits = {j + 1: float(np.quantile(table[:, j], quantile)) for j in range(m)}
    above = 0
    while above < len(observed) and observed[above] > limits[above + 1]:
        above += 1
    return {"r": int(min(max(above, min(rs)), max(rs))), "observed": observed.tolist(), "limits": [limits[j + 1] for j in range(len(observed))], "n_above": above}


def clusterwise(stats: Stats, kind: str, k: int, rs=range(1, 6), how: str = "max", criteria=("VAF", "VSS"), smooth: np.ndarray | None = None, r_init: int | None = None, seed: int = 0) -> dict:
    """Fit at a middle r, then choose r for each cluster by its own one-cluster fits, and combine. Clusters of one subject get the least r."""
    rs = list(rs)
    base = M.fit(stats, kind, k, r_init or int(np.round(np.median(rs))), seed=seed)
    per, tables = {}, {}
    for c in range(1, k + 1):
        own = np.flatnonzero(base.z == c)
        if len(own) < 2:
            per[c] = min(rs)
            continue
        tables[c] = criteria_table(stats.pick(own), kind, 1, rs, smooth=None if smooth is None else smooth[own], seed=seed)
        per[c] = _best_of(tables[c], criteria)
    values = list(per.values())
    r = {"max": max(values), "min": min(values), "mean": int(np.round(np.mean(values))), "majority": min(values, key=lambda x: (-values.count(x), x))}[how]
    return {"r": int(r), "per_cluster": per, "tables": tables, "fit": base}


def _best_of(rows: list[dict], criteria, weights: dict[str, float] | None = None) -> int:
    """best_r for a small table on the driver."""
    weights = weights or {"VAF": 0.4, "VSS": 0.4, "smoothness": 0.2}
    r = np.array([x["r"] for x in rows], dtype=float)
    get = lambda c: np.array([np.nan if x.get(c) is None else x[c] for x in rows], dtype=float)
    scaled = lambda x: np.full(len(x), 0.5) if np.nanmax(x) == np.nanmin(x) else (x - np.nanmin(x)) / (np.nanmax(x) - np.nanmin(x))
    if len(criteria) == 1:
        score = get(criteria[0]) * (-1 if criteria[0] == "smoothness" else 1)
    else:
        score, flat = np.zeros(len(rows)), "VAF" in criteria
        for c in criteria:
            x = get(c)
            if c != "VAF":
                flat = flat and (np.isnan(x).all() or np.nanmax(x) - np.nanmin(x) < 1e-10)
            if not np.isnan(x).all():
                x = x / np.log(np.maximum(r, 2)) if c == "VSS" else x
                score += (-1 if c == "smoothness" else 1) * weights[c] * scaled(x)
        if flat:
            score += 0.5 * scaled(np.concatenate([[0.0], np.diff(get("VAF"))])) - 0.2 * scaled(r)
    return int(r[np.flatnonzero(np.abs(score - np.nanmax(score)) < 1e-10)].min())


def choose_r(rows: list[dict], method: str, rs, threshold: float = 0.9) -> int:
    """r by a method from a table of criteria: bic, vaf, vss, smoothness or multicriteria."""
    if method == "bic":
        r = min(rows, key=lambda x: (x["BIC"], x["r"]))["r"]
    elif method == "vaf":
        r = min((x["r"] for x in rows if x["VAF"] >= threshold), default=max(rs))
    elif method == "vss":
        r = by_vss(rows, threshold)
    elif method == "smoothness":
        r = by_smoothness(rows, threshold)
    elif method == "multicriteria":
        scaled = lambda c: (lambda x: np.full(len(x), 0.5) if x.max() == x.min() else (x - x.min()) / (x.max() - x.min()))(np.array([x[c] if x[c] is not None else 0.0 for x in rows], dtype=float))
        score = scaled("BIC") + 1 - scaled("VAF") + scaled("smoothness") + 1 - scaled("VSS")
        good = [j for j, x in enumerate(rows) if x["VAF"] >= threshold]
        r = rows[min(good, key=lambda j: (score[j], rows[j]["r"])) if good else int(np.argmax([x["VAF"] for x in rows]))]["r"]
    else:
        raise ValueError(f"unknown method {method!r}")
    return int(r)


def select_r(panel: Panel, stats: Stats, kind: str, k: int, rs=range(1, 6), method: str = "bic", scope: str = "global", how: str = "max", threshold: float = 0.9, folds: int = 5, seed: int = 0, smooth: np.ndarray | None = None, criteria=("VAF", "VSS")) -> dict:
    """r by any method: bic, vaf, vss, smoothness, multicriteria, cv or pa, over the mixture or (scope) per cluster, global-first or hybrid."""
    rs = [r for r in rs if r <= stats.width]
    if scope == "clusterwise":
        return clusterwise(stats, kind, k, rs, how, criteria, smooth, seed=seed)
    if scope in ("global-first", "hybrid"):
        first = select_r(panel, stats, kind, k, rs, "cv", "global", folds=folds, seed=seed)["r"]
        if scope == "global-first":
            return {"r": first, "fit": M.fit(stats, kind, k, first, seed=seed)}
        return clusterwise(stats, kind, k, rs, how, criteria, smooth, r_init=first, seed=seed) | {"r_global": first}
    if method == "cv":
        rows = cross_validate_r(stats, rs, kind, folds, seed=seed)
        mean = {r: np.mean([s for q, _, s in rows if q == r]) for r in rs}
        best = min(mean, key=lambda r: (mean[r], r))
        own = [s for q, _, s in rows if q == best]
        edge = mean[best] + (np.std(own, ddof=1) / np.sqrt(len(own)) if len(own) > 1 else 0.0)
        return {"r": min(r for r in rs if mean[r] <= edge), "summary": rows}
    if method == "pa":
        return parallel_analysis(panel, rs, seed=seed)
    rows = criteria_table(stats, kind, k, rs, smooth=smooth, seed=seed)
    return {"r": choose_r(rows, method, rs, threshold), "summary": rows}
