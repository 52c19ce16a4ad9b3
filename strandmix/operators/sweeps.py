"""Parameter grids, experiments over them, and the relational summaries of their results."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmix.sources.panel import Panel

# The axes of each grid, the first varying fastest.
_SEPARATIONS = ("cluster_sep_spatial", "cluster_sep_temporal", "cluster_sep_stability")


def _axes(n, k, r, t, separations, seeds) -> dict[str, tuple]:
    return {"N": n, "K": k, "r": r, "M": (8,), "T_each": (t,)} | dict(zip(_SEPARATIONS, separations)) | {"seed": seeds}


GRIDS = {
    "full": _axes((20, 30, 50), (2, 3), (2, 3), 200, [(0.3, 0.6, 1.0)] * 3, (1, 2, 3, 4, 5)),
    "test": _axes((20,), (2,), (2,), 100, [(0.5, 1.0)] * 3, (1, 2)),
    "modelsel_full": _axes((20, 30, 50), (2, 3), (2, 3), 200, [(0.5, 1.0, 1.5)] * 3, (1, 2, 3, 4, 5)),
    "modelsel_test": _axes((20,), (2,), (2,), 100, [(0.5, 1.0), (1.0,), (1.0,)], (1, 2)),
    "baselines_test": _axes((20,), (2,), (2,), 100, [(0.5, 1.0)] * 3, (1, 2)),
    "k_selection": {"N": (40, 60), "K_true": (2, 3, 4, 5), "r_true": (2,), "M": (8,), "T_each": (100,), "cluster_sep_spatial": (0.3, 0.6, 1.0), "cluster_sep_temporal": (0.6,), "cluster_sep_stability": (0.6,), "seed": (1, 2, 3, 4, 5)},
}

# The study's parameters as its first table lists them.
TABLE1 = (
    ("True cluster number (K)", "3, 4"),
    ("True factor (PC) number (r)", "3, 5"),
    ("Number of subjects (N)", "50, 100"),
    ("Channels (M)", "8, 12"),
    ("Time length (T_each)", "100"),
    ("Separation parameter (sep)", "0.5, 1.0"),
    ("Noise scale (noise)", "1.0, 2.0"),
)

CONFIG = ["model_type", "N", "K", "r", "M", "T_each", *_SEPARATIONS]
MODELSEL_CONFIG = ["N", "K_true", "r_true", "M", "T_each", *_SEPARATIONS, "mode", "r_mode"]
MODELSEL_METRICS = {"ARI": ("ARI_mean", True), "VAF": ("VAF_mean", True), "subspace_similarity": ("subspace_similarity_mean", True), "Kr_accuracy": ("Kr_correct_rate", True), "BIC": ("BIC_mean", False), "runtime": ("runtime_mean", False)}


def param_grid(spark: SparkSession, name: str = "full") -> DataFrame:
    """Every combination of a grid's axes with run_id from 1. A run's number is worked out from its place on each axis."""
    axes = GRIDS[name]
    size = int(np.prod([len(v) for v in axes.values()]))
    columns, step = [], 1
    for axis, values in axes.items():
        place = F.pmod(F.floor(F.col("id") / step), F.lit(len(values))).cast("int")
        kind = "double" if any(isinstance(v, float) for v in values) else "int"
        columns.append(F.array(*(F.lit(v).cast(kind) for v in values))[place].alias(axis))
        step *= len(values)
    return spark.range(size).select(*columns, (F.col("id") + 1).cast("int").alias("run_id"))


def progress(grid: DataFrame, results: DataFrame) -> DataFrame:
    """The grid with n_results, the rows that each run has in a table of results (run_id, ...); their counts combine before they are shuffled."""
    counts = results.groupBy("run_id").agg(F.count("*").alias("n_results"))
    return grid.join(counts, "run_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def table1(spark: SparkSession, panel: Panel | None = None) -> DataFrame:
    """The study's parameters, and beside them what a panel has of each: subjects, channels and the longest series; null for the others."""
    listed = spark.createDataFrame(list(TABLE1), "Parameter string, Values string")
    if panel is None:
        return listed
    sizes = panel.df.groupBy("subject_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("subjects"), F.max("n").alias("longest"))
    of = lambda start, value: F.when(F.startswith("Parameter", F.lit(start)), value)
    observed = F.coalesce(of("Number of subjects", F.col("subjects")), of("Channels", F.lit(len(panel.channels)).cast("long")), of("Time length", F.col("longest")))
    return listed.join(F.broadcast(sizes)).select("Parameter", "Values", observed.alias("observed"))


def finite(name: str):
    """True for a number that is neither missing nor infinite."""
    x = F.col(name).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def require_columns(df: DataFrame, names) -> None:
    """ValueError where columns are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _figures(metrics: dict[str, str]):
    # NaN counts as missing, as in the means over repetitions.
    clean = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m))
    return [x for m, out in metrics.items() for x in (F.avg(clean(m)).alias(f"{out}_mean"), F.stddev_samp(clean(m)).alias(f"{out}_sd"))]


def aggregate_results(df: DataFrame) -> DataFrame:
    """Means and deviations of ARI, BIC, VAF and SSE over repetitions of each configuration and method; rows without a finite VAF or SSE are left out."""
    for metric in ("VAF", "SSE"):
        if metric in df.columns:
            df = df.where(finite(metric))
    keys = [c for c in ["model_type", "Method", *CONFIG[1:]] if c in df.columns]
    return df.groupBy(*keys).agg(*_figures({m: m for m in ("ARI", "BIC", "VAF", "SSE")}), F.count("*").alias("n_reps"))


def summary_table(agg: DataFrame, metric: str = "ARI") -> DataFrame:
    """Mean, deviation and range of a metric's means by model type and method."""
    require_columns(agg, [f"{metric}_mean"])
    x = F.col(f"{metric}_mean")
    return agg.where(finite(f"{metric}_mean")).groupBy("model_type", "Method").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))


def best_method(agg: DataFrame, metric: str = "ARI", maximize: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The rows with the best mean of a metric in each configuration, all of equals. One aggregation, joined back."""
    col = f"{metric}_mean"
    require_columns(agg, [col])
    keys = keys or [c for c in CONFIG if c in agg.columns]
    return _best(agg, keys, col, maximize)


def _best(agg: DataFrame, keys: list[str], col: str, maximize: bool) -> DataFrame:
    top = agg.groupBy(*keys).agg((F.max if maximize else F.min)(col).alias("best__"))
    same = reduce(lambda a, b: a & b, (agg[k].eqNullSafe(top[k]) for k in keys))
    return agg.join(top, same & (agg[col] == top["best__"]), "left_semi")


def win_rates(agg: DataFrame, metric: str = "ARI", maximize: bool = True) -> DataFrame:
    """Configurations that each method wins, and their share in per cent; ties count for all, so shares can sum to more than 100."""
    keys = [c for c in CONFIG if c in agg.columns]
    total = agg.select(*keys).distinct().agg(F.count("*").alias("total__"))
    wins = best_method(agg, metric, maximize).groupBy("model_type", "Method").agg(F.count("*").alias("n_wins"))
    return wins.join(F.broadcast(total)).select("model_type", "Method", "n_wins", (F.col("n_wins") / F.col("total__") * 100).alias("win_rate"))


def aggregate_modelsel(df: DataFrame) -> DataFrame:
    """The same for model selection runs: means and deviations of five metrics, rates of right K and r, runs and errors."""
    keys = [c for c in [*MODELSEL_CONFIG[:8], "method", "selection_strategy", "mode", "r_mode"] if c in df.columns]
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    errors = F.sum(F.when(F.col("error_msg") != "", 1).otherwise(0)).cast("long").alias("n_errors")
    metrics = {"ARI": "ARI", "VAF": "VAF", "BIC": "BIC", "subspace_similarity": "subspace_similarity", "runtime_sec": "runtime"}
    return df.groupBy(*keys).agg(*_figures(metrics), rate("K_correct"), rate("r_correct"), rate("Kr_correct"), F.count("*").alias("n_reps"), errors)


def modelsel_win_rates(agg: DataFrame) -> DataFrame:
    """(metric, method, selection_strategy, n_wins, total_conditions, win_rate) for six metrics, from one table of values by metric."""
    keys = [c for c in MODELSEL_CONFIG if c in agg.columns]
    there = {m: x for m, x in MODELSEL_METRICS.items() if x[0] in agg.columns}
    # Metrics that are better when small are turned round.
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(col) if up else -F.col(col)).alias("value")) for m, (col, up) in there.items()))).alias("x")
    long = agg.select(*keys, "method", "selection_strategy", values).select(*keys, "method", "selection_strategy", "x.*")
    won = _best(long, [*keys, "metric"], "value", True).groupBy("metric", "method", "selection_strategy").agg(F.count("*").alias("n_wins"))
    total = agg.select(*keys).distinct().agg(F.count("*").alias("total_conditions"))
    return won.join(F.broadcast(total)).select("metric", "method", "selection_strategy", "n_wins", "total_conditions", (F.col("n_wins") / F.col("total_conditions") * 100).alias("win_rate"))


def table2(df: DataFrame) -> DataFrame:
    """Means and deviations of ARI and BIC at separation 1 and noise 1, by K, r, N and M."""
    kept = df.where((F.abs(F.col("sep") - 1) < 1e-9) & (F.abs(F.col("noise") - 1) < 1e-9))
    return kept.groupBy("K_true", "r_true", "N", "M").agg(F.avg("ARI_MFA").alias("ARI_MFA_mean"), F.stddev_samp("ARI_MFA").alias("ARI_MFA_sd"), F.avg("BIC_MFA").alias("BIC_MFA_mean"), F.avg("ARI_PCA").alias("ARI_PCA_mean"), F.stddev_samp("ARI_PCA").alias("ARI_PCA_sd"), F.avg("BIC_PCA").alias("BIC_PCA_mean"))


def join_vaf(results: DataFrame, vaf: DataFrame) -> DataFrame:
    """Results with the VAF of the file that they are from; null where there is none."""
    return results.join(vaf, "file", "left")


def accuracy(df: DataFrame) -> DataFrame:
    """Per method: runs and per cent with the right K."""
    return df.groupBy("method").agg(F.count("*").alias("n"), (100 * F.avg(F.col("K_correct").cast("double"))).alias("accuracy"))


def run_grid(grid: DataFrame, run: Callable[[dict], list[dict]], schema: str, partitions: int | None = None) -> DataFrame:
    """The rows that ``run`` returns for each row of a grid; a run that fails gives one row with the configuration and ``error_msg``.

    Runs are spread over tasks by run_id; a lost task repeats only its own runs.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    n = partitions or grid.sparkSession.sparkContext.defaultParallelism * 4

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for config in rows.to_dict("records"):
            try:
                out += [config | {"error_msg": ""} | x for x in run(config)]
            except Exception as e:  # any failure of a run is a result
                out.append(config | {"error_msg": f"{type(e).__name__}: {e}"})
        return pd.DataFrame([{k: row.get(k) for k in names} for row in out], columns=names)

    return grid.repartition(n, "run_id").groupBy("run_id").applyInPandas(one, schema)


def resumed_grid(grid: DataFrame, run: Callable[[dict], list[dict]], schema: str, path: str, partitions: int | None = None, chunk: int = 200, attempts: int = 3) -> DataFrame:
    """``run_grid`` whose results stay under ``path``, run by run, so that a sweep that was stopped goes on where it was.

    Runs go in chunks of their numbers; a chunk's results are written to a folder for each run, which only its own run ever overwrites. A
    later call leaves out the runs that have results, by an anti-join, and tries failed ones again until they have failed ``attempts`` times.
    Returns all results so far, with ``attempt``, the number of the try that made them.
    """
    spark = grid.sparkSession
    full = f"{schema.replace('run_id int, ', '', 1) if schema.startswith('run_id int, ') else schema.replace(', run_id int', '', 1)}, attempt int, run_id int"
    spark.createDataFrame([], full).write.mode("append").partitionBy("run_id").parquet(path)  # makes the folder, adds nothing
    there = lambda: spark.read.schema(full).parquet(path)
    tries = there().groupBy("run_id").agg(F.max("attempt").alias("tried"), F.max((F.coalesce("error_msg", F.lit("")) != "").cast("int")).alias("failed"))
    open_runs = grid.join(tries, "run_id", "left").where(F.col("tried").isNull() | ((F.col("failed") == 1) & (F.col("tried") < attempts)))
    # Numbers of runs come to the driver, as many as a grid has rows; what is read from the folder must not be looked at again once it is written to.
    left = sorted((r[0], (r[1] or 0) + 1) for r in open_runs.select("run_id", "tried").collect())
    for at in range(0, len(left), chunk):
        own = F.broadcast(spark.createDataFrame(left[at : at + chunk], "run_id int, attempt int"))
        found = run_grid(grid.join(own.drop("attempt"), "run_id"), run, schema, partitions).join(own, "run_id")
        found.select(*(x.split()[0] for x in full.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return there()


CONFIG_SCHEMA = "N int, K int, r int, M int, T_each int, cluster_sep_spatial double, cluster_sep_temporal double, cluster_sep_stability double, seed int, run_id int"
BASELINE_SCHEMA = f"{CONFIG_SCHEMA}, model_type string, Method string, BIC double, ARI double, SSE double, VAF double, subspace_similarity double, error_msg string"
MODELSEL_SCHEMA = "run_id int, seed int, N int, K_true int, r_true int, M int, T_each int, cluster_sep_spatial double, cluster_sep_temporal double, cluster_sep_stability double, method string, selection_strategy string, mode string, r_mode string, K_hat int, r_hat int, K_correct boolean, r_correct boolean, Kr_correct boolean, ARI double, VAF double, logLik double, BIC double, subspace_similarity double, runtime_sec double, error_msg string"
KSELECT_SCHEMA = "run_id int, seed int, N int, K_true int, r_true int, cluster_sep_spatial double, method string, K_hat int, K_correct boolean, runtime_sec double, error_msg string"


def _simulated(config: dict):
    from strandmix.operators.suffstats import from_arrays
    from strandmix.sources.simulate import Design, arrays

    get = lambda *names: next(config[n] for n in names if n in config)
    series, z, params = arrays(Design(int(get("N")), int(get("K", "K_true")), int(get("r", "r_true")), int(get("M")), int(get("T_each")), *(float(config[s]) for s in _SEPARATIONS), seed=int(config["seed"])))
    return from_arrays(series), z, params


def baselines_run(config: dict) -> list[dict]:
    """The six methods on one simulated panel."""
    from strandmix.operators.baselines import compare_all

    stats, z, params = _simulated(config)
    return [{"model_type": "dynamic"} | row for row in compare_all(stats, int(config["K"]), int(config["r"]), z, int(config["seed"]), list(params["loadings"]))]


#: Candidates that selection runs try, whatever the truth: K and r of model selection, K of the comparison of criteria.
K_CANDIDATES, R_CANDIDATES, K_COMPARED = range(1, 6), range(1, 6), range(2, 7)
MODES = ("modelsel", "oracle_r", "oracle_Kr")


def modelsel_run(config: dict, mode: str = "modelsel", ks=K_CANDIDATES, rs=R_CANDIDATES, strategies=("grid", "twostage"), methods=("mfa", "mpca"), criterion: str = "ICL", temperature: float = 2.0) -> list[dict]:
    """Each mixture under each strategy on one simulated panel.

    Candidates don't depend on the truth, but for the modes that are told of it: ``oracle_r`` knows r, ``oracle_Kr`` K and r.
    """
    from strandmix.operators import evaluate as E
    from strandmix.operators import selection as Q

    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    stats, z, params = _simulated(config)
    k, r, out = int(config["K"]), int(config["r"]), []
    ks, rs = [k] if mode == "oracle_Kr" else ks, [r] if mode != "modelsel" else rs
    for kind in methods:
        for strategy in strategies:
            begun = time.perf_counter()
            options = {"criterion": criterion, "temperature": temperature, "r_fixed": rs[0] if len(rs) == 1 else 2} if strategy == "twostage" else {}
            got = Q.select_k_r(stats, kind, strategy, ks=ks, rs=rs, seed=int(config["seed"]), **options)
            row = E.model_selection_row({"K": k, "r": r, "z": z}, got.best, stats, time.perf_counter() - begun)
            space = E.clusterwise_similarity(list(params["loadings"]), [c.loadings for c in got.best.components], z, got.best.z)
            out.append(row | {"K_true": k, "r_true": r, "method": kind, "selection_strategy": strategy, "mode": mode, "r_mode": "select" if mode == "modelsel" else "oracle", "subspace_similarity": space})
    return out


def vote(choices: list[int]) -> int:
    """The most frequent choice, the smallest of equals."""
    return min(choices, key=lambda x: (-choices.count(x), x))


def kselect_run(config: dict, ks=K_COMPARED, r: int = 2) -> list[dict]:
    """K by BIC, by ICL at three temperatures, and by the vote of BIC and two of these, on one simulated panel; candidates don't depend on the truth."""
    from strandmix.operators import criteria as C
    from strandmix.operators import mixture as M

    stats, _, _ = _simulated(config)
    k_true, begun = int(config["K_true"]), time.perf_counter()
    fits = {k: M.fit(stats, "mfa", k, r, seed=int(config["seed"])) for k in ks if k <= len(stats)}
    bic = {k: C.bic("mfa", f.loglik, k, r, stats.width, float(stats.n.sum())) for k, f in fits.items()}
    scores = {"BIC": bic} | {f"ICL_T{t}": {k: C.icl(bic[k], C.tempered(f.resp, t)) for k, f in fits.items()} for t in (1, 2, 3)}
    spent = time.perf_counter() - begun
    best = {name: min(s, key=lambda k: (s[k], k)) for name, s in scores.items()}
    best["Ensemble"] = vote([best[x] for x in ("BIC", "ICL_T1", "ICL_T2")])
    return [{"method": name, "K_hat": k, "K_correct": k == k_true, "runtime_sec": spent} for name, k in best.items()]


def sweep(spark: SparkSession, what: str = "baselines", grid: str | DataFrame = "test", path: str | None = None, **options) -> DataFrame:
    """An experiment over a grid, by name or as a table: baselines, modelsel or kselect, with the options of its runs. With ``path`` it goes on where it was stopped."""
    run, schema = {"baselines": (baselines_run, BASELINE_SCHEMA), "modelsel": (modelsel_run, MODELSEL_SCHEMA), "kselect": (kselect_run, KSELECT_SCHEMA)}[what]
    table, call = param_grid(spark, grid) if isinstance(grid, str) else grid, partial(run, **options) if options else run
    return resumed_grid(table, call, schema, path) if path else run_grid(table, call, schema)


def compare_simulated(spark: SparkSession, model_types=("dynamic",), n: int = 30, k: int = 3, r: int = 3, m: int = 8, length: int = 200, separations=(1.0, 1.0, 1.0), seeds=(123,)) -> DataFrame:
    """The six methods on simulated panels of each model type and seed, as a table. ValueError for a type that can't be simulated."""
    if unknown := [x for x in model_types if x != "dynamic"]:
        raise ValueError(f"unknown model types: {', '.join(map(str, unknown))}")
    rows = [(n, k, r, m, length, *map(float, separations), int(seed), j + 1) for j, seed in enumerate(seeds)]
    return sweep(spark, "baselines", spark.createDataFrame(rows, CONFIG_SCHEMA))


def finish(raw: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The end of a sweep: aggregates over finite rows, and win rates of each metric; written under ``path`` where one is given.

    Model selection runs are told by their columns. With a path, aggregates are computed from the written rows, so no run is made twice.
    """
    from strandmix.sources.results import save_results

    if path:
        raw = raw.sparkSession.read.parquet(save_results(raw, f"{path}/raw")[0])
    ok = raw.where(F.coalesce(F.col("error_msg"), F.lit("")) == "") if "error_msg" in raw.columns else raw
    if "selection_strategy" in raw.columns:
        agg = aggregate_modelsel(raw)
        out = {"aggregated": agg, "win_rates": modelsel_win_rates(agg)}
    else:
        agg = aggregate_results(ok)
        rates = [win_rates(agg, x, x in ("ARI", "VAF")).select(F.lit(x).alias("metric"), "*") for x in ("ARI", "BIC", "VAF", "SSE") if f"{x}_mean" in agg.columns]
        out = {"aggregated": agg, "win_rates": reduce(DataFrame.unionByName, rates)}
    if path:
        out = {name: raw.sparkSession.read.parquet(save_results(df, f"{path}/{name}")[0]) for name, df in out.items()}
    return {"raw": raw} | out


def aggregate_partial_results(spark: SparkSession, folder: str, pattern: str = "*.parquet", path: str | None = None, remove_partial: bool = False) -> dict[str, DataFrame]:
    """``finish`` over the results that tasks left in a folder, by the names of their columns.

    ``remove_partial`` deletes the files that were read, once the results stand under ``path``, which it therefore needs.
    """
    from strandmix.sources.results import read_all_results, remove_files

    if remove_partial and not path:
        raise ValueError("remove_partial needs a path to write to first")
    raw = read_all_results(spark, f"{folder}/{pattern}")
    files = [row[0] for row in raw.select("file").distinct().collect()] if remove_partial else []
    out = finish(raw.drop("file"), path)
    remove_files(spark, files)
    return out


def aggregate_partial(df: DataFrame) -> DataFrame:
    """Results of tasks, summarised by the kind that their columns show."""
    return aggregate_modelsel(df) if "selection_strategy" in df.columns else aggregate_results(df)
