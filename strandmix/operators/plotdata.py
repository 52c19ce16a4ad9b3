"""The tables behind plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators.kendall import kendall
from strandmix.sources.panel import Panel


def loadings_long(df: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """One row per key and factor: (keys, Factor, Loading)."""
    return df.unpivot(keys, factors, "Factor", "Loading")


def mean_waveform(panel: Panel, assignments: DataFrame) -> DataFrame:
    """(z, t, channel, value): mean over a cluster's subjects at each time."""
    rows = panel.df.join(assignments.select("subject_id", "z"), "subject_id")
    wide = rows.groupBy("z", "t").agg(*(F.avg(c).alias(c) for c in panel.channels))
    return wide.unpivot(["z", "t"], list(panel.channels), "channel", "value")


def first_per_cluster(assignments: DataFrame, n: int) -> DataFrame:
    """(subject_id, z) of the first ``n`` subjects of each cluster."""
    rank = F.row_number().over(W.partitionBy("z").orderBy("subject_id"))
    return assignments.withColumn("rank", rank).where(F.col("rank") <= n).select("subject_id", "z")


def compare_waveforms(panel: Panel, rebuilt: DataFrame, subject_id: int, channel: str) -> DataFrame:
    """(t, kind, value): one subject's channel and its reconstruction."""
    own = panel.df.where(F.col("subject_id") == subject_id).select("t", F.lit("original").alias("kind"), F.col(channel).alias("value"))
    return own.unionByName(rebuilt.where(F.col("subject_id") == subject_id).select("t", F.lit("reconstructed").alias("kind"), F.col(channel).alias("value")))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks within keys, equals sharing the mean of theirs."""
    w = W.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0)


def loading_correlation(loadings: DataFrame, a: int, b: int, method: str = "pearson") -> DataFrame:
    """(factor_a, factor_b, corr) of the loading columns of clusters a and b: pearson, spearman or kendall (tau-b). Channels pair up, not rows of data."""
    left = loadings.where(F.col("k") == a).select("channel", F.col("factor").alias("factor_a"), F.col("value").alias("x"))
    right = loadings.where(F.col("k") == b).select("channel", F.col("factor").alias("factor_b"), F.col("value").alias("y"))
    if method == "spearman":
        left = average_rank(left, ["factor_a"], "x", "rx").select("channel", "factor_a", F.col("rx").alias("x"))
        right = average_rank(right, ["factor_b"], "y", "ry").select("channel", "factor_b", F.col("ry").alias("y"))
    both = left.join(right, "channel")
    if method in ("pearson", "spearman"):
        return both.groupBy("factor_a", "factor_b").agg(F.corr("x", "y").alias("corr"))
    if method != "kendall":
        raise ValueError(f"unknown method {method!r}")
    return kendall(both, ["factor_a", "factor_b"])


def sse_heatmap(errors: DataFrame, methods: list[str]) -> DataFrame:
    """(subject_id, method, sse, log_sse) from a column of errors per method."""
    return errors.unpivot(["subject_id"], methods, "method", "sse").withColumn("log_sse", F.log10(F.col("sse") + 1e-10))


def minmax(panel: Panel) -> DataFrame:
    """(subject_id, t, channels scaled to 0..1 within the subject); 0 where a channel is constant."""
    stats = panel.df.groupBy("subject_id").agg(*(f(c).alias(f"{c}_{n}") for c in panel.channels for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.nullif(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(0.0))), F.lit(0.0))
    return panel.df.join(stats, "subject_id").select("subject_id", "t", *(scaled(c).alias(c) for c in panel.channels))


def neural_command(panel: Panel, clusters: DataFrame, dims: int = 2) -> DataFrame:
    """(subject_id, t, z, dim_1 ...): activations scaled to 0..1 within each subject, in the principal axes of all rows together.

    One aggregation gives means and covariances; the projection is an expression.
    """
    scaled = Panel(minmax(panel), panel.channels)
    return embedding(scaled.df.join(clusters.select("subject_id", "z"), "subject_id"), list(panel.channels), dims, keys=("subject_id", "t", "z"))


def embedding(features: DataFrame, columns: list[str], dims: int = 2, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Rows by their keys in the leading principal axes of their features, as a projection with literal coefficients; an axis's largest entry is positive."""
    clean = features.dropna(subset=columns)
    m = len(columns)
    one = clean.agg(*(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i in range(m) for j in range(i, m))).first()
    mean = np.array([x or 0.0 for x in one[:m]])
    cov = np.zeros((m, m))
    cov[np.triu_indices(m)] = [x or 0.0 for x in one[m:]]
    _, axes, _ = L.top_eigen(cov + np.triu(cov, 1).T, dims)
    project = lambda j: sum((float(axes[i, j]) * (F.col(c) - float(mean[i])) for i, c in enumerate(columns)), F.lit(0.0))
    return clean.select(*keys, *(project(j).alias(f"dim_{j + 1}") for j in range(dims)))


def mean_basis(bases: DataFrame, assignments: DataFrame) -> DataFrame:
    """(k, channel, factor, value): mean over the subjects of each cluster of (subject_id, channel, factor, value)."""
    return bases.join(assignments.select("subject_id", F.col("z").alias("k")), "subject_id").groupBy("k", "channel", "factor").agg(F.avg("value").alias("value"))


def common_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    """(subject_id) in both tables."""
    return a.select("subject_id").intersect(b.select("subject_id"))


def metric_by_axis(df: DataFrame, axis: str, metric: str) -> DataFrame:
    """(axis, Method, mean, sd, min, max, n) of a metric."""
    x = F.col(metric)
    return df.groupBy(axis, "Method").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n_values"))


def method_kind(df: DataFrame, method: str = "Method") -> DataFrame:
    """``df`` with method_type: what a method's name says about it."""
    m = F.col(method)
    return df.withColumn("method_type", F.when(m.rlike("^Single"), "Single model").when(m.rlike("^TwoStep"), "Two-step").when(m.rlike("^Mixture"), "Mixture").otherwise("Other"))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value), values that aren't finite left out."""
    long = df.unpivot(keys, metrics, "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def bic_line(table: DataFrame) -> DataFrame:
    """(K, r, BIC, best): the smallest BIC marked."""
    best = table.agg(F.min("BIC").alias("low"))
    return table.join(F.broadcast(best)).select("K", "r", "BIC", (F.col("BIC") == F.col("low")).alias("best"))


def noise_profile(panel: Panel, rebuilt: DataFrame) -> DataFrame:
    """(z, t, channel, sd, n): spread of what a reconstruction (subject_id, t, z, channels) leaves, over a cluster's subjects at each time."""
    back = rebuilt.select("subject_id", "t", "z", *(F.col(c).alias(f"{c}__r") for c in panel.channels))
    both = panel.df.join(back, ["subject_id", "t"])
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), (F.col(c) - F.col(f"{c}__r")).alias("e")) for c in panel.channels))).alias("x")
    return both.select("z", "t", cells).groupBy("z", "t", "x.channel").agg(F.stddev_samp("x.e").alias("sd"), F.count("x.e").alias("n"))
