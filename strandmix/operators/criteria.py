"""Likelihoods, information criteria and responsibilities, over statistics and as DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import mixture as M
from strandmix.operators.mixture import Fit
from strandmix.operators.suffstats import Stats


def loglik(stats: Stats, fit: Fit, legacy: bool = False, held_out: bool = False) -> float:
    """Mixture log likelihood. ``legacy`` takes a PCA mixture's loadings as unit columns; ``held_out`` adds nothing to priors and leaves out subjects without a finite value."""
    components = fit.components
    if legacy and fit.kind == "mpca":
        components = tuple(L.Component(c.mean, M.unit_axes(c)[0], c.noise) for c in components)
    total = L.log_sum_exp(M._log_joint(stats, components, fit.pi, 0.0, 0.0 if held_out else M.TINY))
    return float(total[np.isfinite(total)].sum() if held_out else total.sum())


def n_parameters(kind: str, k: int, r: int, m: int, rotation: bool = True) -> int:
    """Free parameters: loadings (less their rotations), means, noise and priors."""
    free = r * (r - 1) // 2 if rotation else 0
    return k * (m * r + free + (2 * m if kind == "mfa" else m + 1)) + k - 1


def bic(kind: str, ll: float, k: int, r: int, m: int, n_obs: float, rotation: bool = True) -> float:
    """-2 log likelihood plus parameters times the log of ``n_obs``."""
    return -2 * ll + n_parameters(kind, k, r, m, rotation) * float(np.log(n_obs))


def entropy(resp: np.ndarray) -> float:
    """-sum (p + 1e-16) log(p + 1e-16)."""
    p = np.asarray(resp) + M.TINY
    return float(-(p * np.log(p)).sum())


def icl(bic_value: float, resp: np.ndarray) -> float:
    """BIC plus twice the entropy."""
    return bic_value + 2 * entropy(resp)


def tempered(resp: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Responsibilities to a power, scaled to sum to one again; above 1 they get sharper."""
    p = np.power(np.maximum(resp, 1e-300), temperature)
    return p / p.sum(axis=1, keepdims=True)


def bic_column(ll: Column, kind: str, k: Column, r: Column, m: Column, n_obs: Column, rotation: bool = True) -> Column:
    """BIC as an expression over a table of fits."""
    free = F.try_divide(r * (r - 1), F.lit(2)) if rotation else F.lit(0)
    own = 2 * m if kind == "mfa" else m + 1
    return -2 * ll + (k * (m * r + free + own) + k - 1) * F.ln(n_obs)


def log_sum_exp(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: log of the sum of exponentials, about the group's largest value."""
    top = F.max(value).over(W.partitionBy(*keys))
    return df.withColumn("top", top).groupBy(*keys).agg((F.max("top") + F.ln(F.sum(F.exp(F.col(value) - F.col("top"))))).alias("lse"))


def responsibilities(joint: DataFrame) -> DataFrame:
    """(subject_id, k, p) from (subject_id, k, value) log joints: a subject has few rows, one per cluster."""
    w = W.partitionBy("subject_id")
    shifted = joint.withColumn("e", F.exp(F.col("value") - F.max("value").over(w)))
    return shifted.select("subject_id", "k", (F.col("e") / F.sum("e").over(w)).alias("p"))


def joint_frame(moments: DataFrame, components, pi: np.ndarray, centre: np.ndarray) -> DataFrame:
    """(subject_id, k, value): log joints from a table of moments, as literal expressions."""
    columns = M.log_joint_columns(components, pi, centre)
    return moments.select("subject_id", F.posexplode(F.array(*columns)).alias("pos", "value")).select("subject_id", (F.col("pos") + 1).alias("k"), "value")


def hard_labels(resp: DataFrame) -> DataFrame:
    """(subject_id, z): the most probable cluster, the first of equals; one aggregation."""
    return resp.groupBy("subject_id").agg(F.max(F.struct(F.col("p"), -F.col("k"))).alias("best")).select("subject_id", (-F.col("best.col2")).cast("int").alias("z"))


def entropy_frame(resp: DataFrame) -> DataFrame:
    """One row: the entropy of (subject_id, k, p)."""
    p = F.col("p") + M.TINY
    return resp.agg((-F.sum(p * F.ln(p))).alias("entropy"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """(z, n) of clusters that have subjects."""
    return assignments.groupBy("z").agg(F.count("*").alias("n"))
