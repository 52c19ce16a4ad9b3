"""Agreement, calibration, alignment and uncertainty of fits."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats

# Fixed values, in order of priority.
#: Columns that may hold hard labels, in the order in which they are looked for.
LABEL_COLUMNS = ("z", "cluster", "clusters", "class", "z_hat", "cl", "hard_cluster", "labels")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over rows that have both labels."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def ari_frame(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two label columns, from their contingency table. Rows of any number meet in one aggregation."""
    table = contingency(df, a, b)
    pairs = lambda n: n * (n - 1) / 2.0
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rows"))
    columns = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("columns"))
    one = cells.join(rows).join(columns)
    expected = F.try_divide(F.col("rows") * F.col("columns"), pairs(F.col("n")))
    top = (F.col("rows") + F.col("columns")) / 2
    return one.select(F.when(top == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("cells") - expected, top - expected)).alias("ari"))


def ari(a, b) -> float | None:
    """The adjusted Rand index of two label vectors; None for other lengths, empty vectors or missing labels."""
    if a is None or b is None or len(a) != len(b) or not len(a) or any(x is None or x != x for x in [*a, *b]):
        return None
    _, i = np.unique(a, return_inverse=True)
    _, j = np.unique(b, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), 1)
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    cells, rows, columns = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0))
    expected, top = rows * columns / max(len(a) * (len(a) - 1) / 2, 1e-300), (rows + columns) / 2
    return 1.0 if top == expected else (cells - expected) / (top - expected)


def confusion(df: DataFrame, truth: str, pred: str, normalize: str = "none") -> DataFrame:
    """(truth, pred, value): counts, or shares of each true or predicted label."""
    table = contingency(df, truth, pred).withColumnsRenamed({"a": "truth", "b": "pred"})
    if normalize == "none":
        return table.select("truth", "pred", F.col("n").cast("double").alias("value"))
    if normalize not in ("true", "pred"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    side = "truth" if normalize == "true" else "pred"
    totals = table.groupBy(side).agg(F.sum("n").alias("total"))
    return table.join(totals, side).select("truth", "pred", (F.col("n") / F.col("total")).alias("value"))


def extract_labels(df: DataFrame) -> DataFrame:
    """``df`` with ``label``: the first label column that it has, else the largest of an array column ``resp``, else null."""
    present = [c for c in LABEL_COLUMNS if c in df.columns]
    if present:
        return df.withColumn("label", F.coalesce(*(F.col(c).cast("string") for c in present)))
    if "resp" in df.columns:
        return df.withColumn("label", F.array_position("resp", F.array_max("resp")).cast("string"))
    return df.withColumn("label", F.lit(None).cast("string"))


def _bin(p: Column, n_bins: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(n_bins), F.ceil(F.round(p * n_bins, 9)))).cast("int")


def calibration(resp: DataFrame, truth: DataFrame, n_bins: int = 10) -> DataFrame:
    """(cluster, bin, bin_midpoint, mean_predicted, mean_observed, n_samples) for every cluster and bin; empty bins have nulls and 0.

    ``resp`` is (subject_id, k, p), ``truth`` (subject_id, z_true). Bins are closed on the right, the first on both sides.
    """
    spark = resp.sparkSession
    joined = resp.join(truth, "subject_id").select(F.col("k").cast("int").alias("cluster"), "p", (F.col("z_true") == F.col("k")).cast("double").alias("hit"), _bin(F.col("p"), n_bins).alias("bin"))
    found = joined.groupBy("cluster", "bin").agg(F.avg("p").alias("mean_predicted"), F.avg("hit").alias("mean_observed"), F.count("*").alias("n_samples"))
    bins = spark.range(1, n_bins + 1).select(F.col("id").cast("int").alias("bin"))
    grid = found.select("cluster").distinct().select("cluster", F.explode(F.sequence(F.lit(1), F.lit(n_bins))).alias("bin"))
    return grid.join(bins, "bin", "left_semi").join(found, ["cluster", "bin"], "left").select("cluster", "bin", ((F.col("bin") - 0.5) / n_bins).alias("bin_midpoint"), "mean_predicted", "mean_observed", F.coalesce("n_samples", F.lit(0)).alias("n_samples"))


def calibration_errors(table: DataFrame) -> DataFrame:
    """One row: the mean (by samples) and largest distance of predicted and observed, from a calibration table."""
    gap = F.abs(F.col("mean_predicted") - F.col("mean_observed"))
    return table.agg(F.try_divide(F.sum(F.col("n_samples") * gap), F.sum("n_samples")).alias("ece"), F.max(gap).alias("mce"))


def calibration_pooled(table: DataFrame) -> DataFrame:
    """(bin, mean_predicted, mean_observed, n_samples) of all clusters together, weighted by samples."""
    n = F.col("n_samples")
    return table.groupBy("bin").agg(F.try_divide(F.sum(F.col("mean_predicted") * n), F.sum(n).cast("double")).alias("mean_predicted"), F.try_divide(F.sum(F.col("mean_observed") * n), F.sum(n).cast("double")).alias("mean_observed"), F.sum(n).alias("n_samples"))


def sign_table(loadings: DataFrame) -> DataFrame:
    """(k, factor, sign): -1 where the first of a column's largest absolute loadings is negative. ``loadings`` is (k, channel, factor, value)."""
    w = W.partitionBy("k", "factor").orderBy(F.desc(F.abs("value")), "channel")
    top = loadings.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return top.select("k", "factor", F.when(F.col("value") < 0, -1.0).otherwise(1.0).alias("sign"))


def align_signs_frame(loadings: DataFrame) -> DataFrame:
    """The loadings with each column's sign turned so that its largest absolute entry is positive."""
    return loadings.join(sign_table(loadings), ["k", "factor"]).select("k", "channel", "factor", (F.col("value") * F.col("sign")).alias("value"))


def align_signs(fit: Fit, clusters: list[int] | None = None) -> Fit:
    """The same for a fit's clusters (all, or some from 1)."""
    def turned(c: L.Component) -> L.Component:
        top = c.loadings[np.argmax(np.abs(c.loadings), axis=0), np.arange(c.loadings.shape[1])]
        return replace(c, loadings=c.loadings * np.where(top < 0, -1.0, 1.0))

    return replace(fit, components=tuple(turned(c) if clusters is None or k + 1 in clusters else c for k, c in enumerate(fit.components)))


def rotate(fit: Fit, clusters: list[int] | None = None) -> Fit:
    """Loadings of clusters rotated by varimax; rotations are kept in ``extra`` and leave covariances as they are."""
    new, kept = [], {}
    for k, c in enumerate(fit.components):
        if clusters is None or k + 1 in clusters:
            loadings, kept[k + 1] = L.varimax(c.loadings)
            c = replace(c, loadings=loadings)
        new.append(c)
    return replace(fit, components=tuple(new), extra=fit.extra | {"rotations": kept})


def rotate_scores(scores: DataFrame, fit: Fit) -> DataFrame:
    """Factor scores (subject_id, t, z, f_1 ...) of a fit before ``rotate``, turned like its loadings; clusters that weren't rotated keep theirs.

    ValueError for a fit without rotations or scores of another number of factors.
    """
    turned, r = fit.extra.get("rotations"), fit.n_factors
    names = [f"f_{j + 1}" for j in range(r)]
    if turned is None:
        raise ValueError("a fit that has not been rotated")
    if [c for c in scores.columns if c.startswith("f_")] != names:
        raise ValueError(f"scores need the columns {', '.join(names)}")
    columns = []
    for j, name in enumerate(names):
        value = F.col(name)
        for k, m in sorted(turned.items()):
            value = F.when(F.col("z") == k, sum((float(m[i, j]) * F.col(x) for i, x in enumerate(names)), F.lit(0.0))).otherwise(value)
        columns.append(value.alias(name))
    return scores.select(*(c for c in scores.columns if c not in names), *columns)


def align_to_truth(z_true: np.ndarray, z_hat: np.ndarray) -> dict:
    """The mapping of estimated on true clusters with most agreement, aligned labels and accuracy.

    With more estimated clusters than true ones, each left over goes to the true label that most of its subjects have.
    """
    truths, found = np.unique(z_true), np.unique(z_hat)
    size = max(len(truths), len(found))
    table = np.zeros((size, size))
    for i, a in enumerate(found):
        for j, b in enumerate(truths):
            table[i, j] = ((z_hat == a) & (z_true == b)).sum()
    match = L.assign(table.max() - table)
    mapping = {a: truths[match[i]] if match[i] < len(truths) else truths[int(table[i, : len(truths)].argmax())] for i, a in enumerate(found)}
    aligned = np.array([mapping[x] for x in z_hat])
    return {"mapping": mapping, "z_aligned": aligned, "accuracy": float((aligned == z_true).mean())}


def clusterwise_similarity(true_bases: list[np.ndarray], bases: list[np.ndarray], z_true: np.ndarray, z_hat: np.ndarray) -> float | None:
    """Mean subspace similarity of each true cluster with the first estimated one that maps on it."""
    mapping = align_to_truth(np.asarray(z_true), np.asarray(z_hat))["mapping"]
    found = []
    for k, a in enumerate(true_bases, 1):
        match = next((h for h in sorted(mapping) if mapping[h] == k), None)
        if match is not None and (s := L.subspace_similarity(a, bases[int(match) - 1])) is not None:
            found.append(s)
    return float(np.mean(found)) if found else None


def align_bootstrap(reference: np.ndarray, loadings: np.ndarray, exact: bool = True, in_order: bool = False) -> np.ndarray:
    """Clusters of a resampled fit (K, M, r) ordered like the reference's, their columns rotated towards it and signed by correlation.

    ``in_order``: the clusters are the reference's already, as in a fit that starts from its labels.
    """
    unit = lambda x: x / np.maximum(np.sqrt((x**2).sum(axis=-2, keepdims=True)), 1e-12)
    close = np.array([[np.abs(unit(a).T @ unit(b)).sum() for b in loadings] for a in reference])
    if in_order:
        match = np.arange(len(close))
    elif exact:
        match = L.assign(close.max() - close)
    else:
        match, left = np.zeros(len(close), dtype=int), set(range(len(close)))
        for k in range(len(close)):
            match[k] = max(left, key=lambda j: (close[k, j], -j))
            left.discard(match[k])
    out = []
    for k, target in enumerate(reference):
        turned = loadings[match[k]] @ L.procrustes(loadings[match[k]], target)
        signs = np.sign(np.diag(L.correlation(target, turned)))
        out.append(turned * np.where(signs == 0, 1, signs))
    return np.stack(out)


def bootstrap_loadings(spark: SparkSession, stats: Stats, kind: str, k: int, r: int, n_boot: int = 200, seed: int = 0, **options) -> DataFrame:
    """(b, k, channel, factor, value): aligned loadings of fits to subjects drawn with replacement; fits that fail are left out.

    Statistics, of a size that ``collect`` bounds, go out once; each draw is a weighting of them and is fitted by a task of its own.
    """
    import pandas as pd

    from strandmix.operators import mixture as M

    base = M.fit(stats, kind, k, r, seed=seed, **options)
    reference = np.stack([c.loadings for c in base.components])
    sent = spark.sparkContext.broadcast((stats, reference, base.z - 1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from strandmix.operators import mixture as M

        given, target, start = sent.value
        out = []
        for b in rows["b"]:
            draw = np.random.default_rng([seed, int(b)]).integers(0, len(given), len(given))
            try:
                got = M.fit_once(given.pick(draw), kind, k, r, start[draw], **options)
            except (np.linalg.LinAlgError, ValueError):
                continue
            found = align_bootstrap(target, np.stack([c.loadings for c in got.components]))
            out += [(int(b), i + 1, j + 1, f + 1, float(found[i, j, f])) for i, j, f in np.ndindex(found.shape)]
        return pd.DataFrame(out, columns=["b", "k", "channel", "factor", "value"])

    draws = spark.range(n_boot).select(F.col("id").alias("b")).repartition(max(1, min(n_boot, spark.sparkContext.defaultParallelism)))
    return draws.groupBy("b").applyInPandas(run, "b long, k int, channel int, factor int, value double")


def bootstrap_summary(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(k, channel, factor, median, lower, upper, sd, n_boot): quantiles between order statistics."""
    return draws.groupBy("k", "channel", "factor").agg(F.median("value").alias("median"), F.percentile("value", alpha / 2).alias("lower"), F.percentile("value", 1 - alpha / 2).alias("upper"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n_boot"))


def model_selection_row(truth: dict, fit: Fit, stats: Stats, runtime_sec: float, n_obs: float | None = None) -> dict:
    """K and r found and whether they are right, with agreement and fit figures."""
    from strandmix.operators import criteria as C
    from strandmix.operators import project as P

    k, r = fit.n_clusters, fit.n_factors
    right = lambda a, b: None if b is None else a == b
    k_ok, r_ok = right(k, truth.get("K")), right(r, truth.get("r"))
    return {"K_hat": k, "r_hat": r, "K_correct": k_ok, "r_correct": r_ok, "Kr_correct": None if k_ok is None or r_ok is None else k_ok and r_ok, "ARI": ari(truth.get("z"), fit.z) if truth.get("z") is not None else None, "VAF": P.vaf(stats, fit), "logLik": fit.loglik, "BIC": C.bic(fit.kind, fit.loglik, k, r, stats.width, n_obs or float(stats.n.sum())), "runtime_sec": runtime_sec}


def sse_diagnostics(fits: DataFrame, sizes: DataFrame, n_subjects: int, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """One row per model: empty and small (under 5 %) clusters, non-finite likelihood, noise outside its range.

    ``fits`` is (model, loglik, min_noise, max_noise, vaf, sse); ``sizes`` (model, z, n) with rows for empty clusters.
    """
    small = sizes.groupBy("model").agg(F.sum((F.col("n") == 0).cast("int")).alias("n_empty"), F.sum((F.col("n") < 0.05 * n_subjects).cast("int")).alias("n_small"))
    bad = F.col("loglik").isNull() | F.isnan("loglik") | (F.abs("loglik") == float("inf"))
    return fits.join(small, "model", "left").select("model", F.coalesce("n_empty", F.lit(0)).alias("n_empty"), F.coalesce("n_small", F.lit(0)).alias("n_small"), bad.alias("loglik_bad"), ((F.col("min_noise") < low) | (F.col("max_noise") > high)).alias("noise_odd"))


def vaf_sse_correlation(fits: DataFrame) -> DataFrame:
    """One row: the correlation of VAF and SSE over models, and whether it is as negative as it should be."""
    return fits.agg(F.corr("vaf", "sse").alias("corr")).withColumn("ok", F.coalesce(F.col("corr") <= -0.9, F.lit(True)))
