"""Simulated panels: clusters of subjects with non-negative loadings and oscillating activations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmix.sources.panel import Panel


@dataclass(frozen=True)
class Design:
    """Sizes and separations. Separations of 0 make clusters alike in loadings, in activations, and in noise."""

    n_subjects: int = 30
    n_clusters: int = 3
    n_factors: int = 3
    n_channels: int = 8
    length: int = 200
    spatial: float = 1.0
    temporal: float = 1.0
    stability: float = 1.0
    freq_range: tuple[float, float] = (1.0, 5.0)
    amp_range: tuple[float, float] = (0.5, 1.5)
    base_level: float = 0.2
    rectify: bool = False
    seed: int = 123


def spatial_bias(d: Design, k: int, rng: np.random.Generator) -> np.ndarray:
    """(M, r): what cluster k, from 0, adds to the common loadings.

    One cluster has none. Of two, the first leans towards the first half of the channels, the second towards the other half. Of more, the first
    leans towards the first third, the second towards the last third, and each other one has a wave over the channels with a phase of its own.
    """
    # Strengths for two clusters (0.3 and -0.2) and for more (0.4 and -0.15), of the wave (0.15) and of its noise (0.1).
    shape, first = (d.n_channels, d.n_factors), np.arange(d.n_channels)[:, None]
    step = lambda edge, low, high: d.spatial * np.where(first < edge, low, high) * np.ones(shape)
    if d.n_clusters == 1:
        return np.zeros(shape)
    if d.n_clusters == 2:
        half = -(-d.n_channels // 2)
        return step(half, 0.3, -0.2) if k == 0 else step(half, -0.2, 0.3)
    if k == 0:
        return step(-(-d.n_channels // 3), 0.4, -0.15)
    if k == 1:
        return step(-(-2 * d.n_channels // 3), -0.15, 0.4)
    wave = np.sin(2 * np.pi * ((first + 1) / d.n_channels + (k - 2) / (d.n_clusters - 2)))
    return d.spatial * (0.15 * wave + 0.1 * rng.normal(size=shape))


def cluster_parameters(d: Design) -> dict:
    """Loadings (K, M, r) with columns of sum 1, and per cluster and factor frequency, phase, amplitude; noise level and memory per cluster."""
    rng = np.random.default_rng([d.seed, 0])
    shared = rng.uniform(0.3, 0.7, (d.n_channels, d.n_factors))
    loadings, freq, phase, noise, memory = [], [], [], [], []
    base_f, base_p = rng.uniform(*d.freq_range, d.n_factors), rng.uniform(0, 2 * np.pi, d.n_factors)
    for k in range(d.n_clusters):
        raw = np.maximum(shared + spatial_bias(d, k, rng) + rng.normal(0, 0.1 * d.spatial, shared.shape), 0)
        loadings.append(raw / np.maximum(raw.sum(axis=0), 1e-12))
        shift = k / max(1, d.n_clusters - 1) if d.n_clusters > 1 else 0.0
        freq.append(base_f * (1 + 0.5 * d.temporal * shift))
        phase.append(base_p + np.pi * d.temporal * shift)
        noise.append(0.05 * (1 + 2 * d.stability * shift))
        memory.append(max(3, min(int(3 + 8 * d.stability * shift), d.length // 10)))
    return {"loadings": np.stack(loadings), "freq": np.stack(freq), "phase": np.stack(phase), "noise": np.array(noise), "memory": np.array(memory), "amp": rng.uniform(*d.amp_range, (d.n_clusters, d.n_factors))}


def subject_cluster(d: Design, subject: int) -> int:
    """The cluster, from 0, of a subject: the first ones in turn, so that none is empty, the others at random."""
    return subject % d.n_clusters if subject < d.n_clusters else int(np.random.default_rng([d.seed, 1, subject]).integers(0, d.n_clusters))


def subject_series(d: Design, params: dict, subject: int) -> np.ndarray:
    """(T, M) of one subject, from a generator of its own."""
    rng, k = np.random.default_rng([d.seed, 2, subject]), subject_cluster(d, subject)
    t = np.linspace(0, 1, d.length)[:, None]
    amp = params["amp"][k] * rng.uniform(0.9, 1.1, d.n_factors)
    wave = amp * np.sin(2 * np.pi * params["freq"][k] * t + params["phase"][k] + rng.normal(0, 0.1, d.n_factors)) + rng.normal(0, 0.1, (d.length, d.n_factors)) * amp
    active = d.base_level + np.maximum(wave, 0)
    x = active @ params["loadings"][k].T
    white = rng.normal(0, params["noise"][k], (d.length + params["memory"][k], d.n_channels))
    smooth = np.stack([np.convolve(white[:, j], np.ones(params["memory"][k]) / params["memory"][k], "full")[params["memory"][k] - 1 : params["memory"][k] - 1 + d.length] for j in range(d.n_channels)], axis=1)
    x = x + white[: d.length] * 0.5 + smooth
    return np.abs(x) if d.rectify else x


def arrays(d: Design) -> tuple[list[np.ndarray], np.ndarray, dict]:
    """All series, true clusters from 1, and the clusters' parameters, in memory."""
    params = cluster_parameters(d)
    return [subject_series(d, params, i) for i in range(d.n_subjects)], np.array([subject_cluster(d, i) + 1 for i in range(d.n_subjects)]), params


def simulate(spark: SparkSession, d: Design) -> tuple[Panel, DataFrame]:
    """The panel, made by tasks subject by subject, and (subject_id, z_true)."""
    params, channels = cluster_parameters(d), tuple(f"ch_{j + 1}" for j in range(d.n_channels))

    def run(batches):
        for part in batches:
            for i in part["id"]:
                x = subject_series(d, params, int(i))
                yield pd.DataFrame(x, columns=list(channels)).assign(subject_id=int(i) + 1, t=np.arange(1, len(x) + 1, dtype=np.int32))[["subject_id", "t", *channels]]

    df = spark.range(d.n_subjects).mapInPandas(run, "subject_id long, t int, " + ", ".join(f"{c} double" for c in channels))
    truth = spark.createDataFrame([(i + 1, subject_cluster(d, i) + 1) for i in range(d.n_subjects)], "subject_id long, z_true int")
    return Panel(df, channels), truth


def generate(spark: SparkSession, seed: int | None = None, **sizes) -> tuple[Panel, DataFrame]:
    """simulate, with a seed that must be given."""
    if seed is None:
        raise ValueError("a seed is needed")
    return simulate(spark, Design(seed=seed, **sizes))


def squares_frame(panel: Panel) -> DataFrame:
    """Mean square per channel, for a look at simulated power."""
    return panel.df.agg(*(F.avg(F.col(c) * F.col(c)).alias(c) for c in panel.channels))
