"""Queries over experiment results, grids, plot tables, simulations and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandmix.operators import plotdata as D
from strandmix.operators import sweeps as W
from strandmix.operators import suffstats as S
from strandmix.plans.models import _LOAD, fixed, loadings
from strandmix.plans.registry import CHANNELS, EV, LS, query, r, table
from strandmix.plans.signal import events, parity, scaled_lines
from strandmix.sources import panel as A
from strandmix.sources import results as R
from strandmix.sources import simulate as G


def _grid_sql(name: str) -> str:
    """SQL: the grid as a product of its axes, numbered with the first axis fastest."""
    axes, step, out = W.GRIDS[name], 1, []
    size = 1
    for values in axes.values():
        size *= len(values)
    for axis, values in axes.items():
        kind = "DOUBLE" if any(isinstance(v, float) for v in values) else "INTEGER"
        listed = ", ".join(str(v) for v in values)
        value = f"CAST(([{listed}])[CAST((i // {step}) % {len(values)} AS INTEGER) + 1] AS {kind})"
        out.append(r(value, axis) if kind == "DOUBLE" else f"{value} AS {axis}")
        step *= len(values)
    return f"SELECT {', '.join(out)}, CAST(i + 1 AS INTEGER) AS run_id FROM range(0, {size}) t(i)"


def _grid_size(name: str) -> int:
    return math.prod(len(v) for v in W.GRIDS[name].values())


# Each grid with the results that its runs have: orders stand for results.
for _name in W.GRIDS:
    query(f"agg_param_grid_{_name}", f"WITH g AS ({_grid_sql(_name)}), c AS (SELECT CAST(o_orderkey % {_grid_size(_name)} + 1 AS INTEGER) AS run_id, count(*) AS found FROM orders GROUP BY 1) SELECT g.*, coalesce(found, 0) AS n_results FROM g LEFT JOIN c USING (run_id)")(
        lambda s, d, n=_name: W.progress(W.param_grid(s, n), table(s, d, "orders").select((F.col("o_orderkey") % _grid_size(n) + 1).cast("int").alias("run_id")))
    )
_OBSERVED = {"Number of subjects (N)": "subjects", "Channels (M)": "4", "Time length (T_each)": "longest"}
query("agg_table1", f"WITH {LS}, z AS (SELECT count(*) AS subjects, max(n) AS longest FROM (SELECT count(*) AS n FROM ls GROUP BY subject_id)) " + " UNION ALL ".join(f"SELECT '{a}' AS Parameter, '{b}' AS \"Values\", CAST({_OBSERVED.get(a, 'NULL')} AS BIGINT) AS observed FROM z" for a, b in W.TABLE1))(
    lambda s, d: W.table1(s, scaled_lines(s, d, False))
)

# Results of a study, one row for each order line. Factors with many decimals keep means off the halves at which engines round apart.
_CONFIG = "CAST(20 + 10 * (l_suppkey % 3) AS INTEGER) AS N, CAST(2 + l_partkey % 2 AS INTEGER) AS K, 2 AS r, 8 AS M, 100 AS T_each, 0.5::DOUBLE * (1 + l_orderkey % 2) AS cluster_sep_spatial, 1.0::DOUBLE AS cluster_sep_temporal, 1.0::DOUBLE AS cluster_sep_stability"
_RES = f"res AS (SELECT l_linestatus AS model_type, l_returnflag AS Method, {_CONFIG}, l_discount * 9.7123457 AS ARI, l_extendedprice / 997.123457 AS BIC, CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE 1 - l_tax * 1.0123457 END AS VAF, l_quantity * 1.0123457 AS SSE FROM lineitem)"
_KEYS = "model_type, Method, N, K, r, M, T_each, cluster_sep_spatial, cluster_sep_temporal, cluster_sep_stability"
_METRICS = ("ARI", "BIC", "VAF", "SSE")
_AGG = f"{_RES}, agg AS (SELECT {_KEYS}, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd' for m in _METRICS)}, count(*) AS n_reps FROM res WHERE NOT isnan(VAF) GROUP BY ALL)"
_AGG_OUT = f"model_type, Method, N, K, r, M, T_each, {', '.join(r(c, c) for c in ('cluster_sep_spatial', 'cluster_sep_temporal', 'cluster_sep_stability'))}, {', '.join(r(f'{m}_{f}', f'{m}_{f}') for m in _METRICS for f in ('mean', 'sd'))}, n_reps"


def _config(li):
    return {
        "N": (20 + 10 * (F.col("l_suppkey") % 3)).cast("int"),
        "K": (2 + F.col("l_partkey") % 2).cast("int"),
        "r": F.lit(2),
        "M": F.lit(8),
        "T_each": F.lit(100),
        "cluster_sep_spatial": 0.5 * (1 + F.col("l_orderkey") % 2),
        "cluster_sep_temporal": F.lit(1.0),
        "cluster_sep_stability": F.lit(1.0),
    }


def _results(s, d):
    li = table(s, d, "lineitem")
    vaf = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(1 - F.col("l_tax") * 1.0123457)
    more = {"model_type": F.col("l_linestatus"), "Method": F.col("l_returnflag"), **_config(li), "ARI": F.col("l_discount") * 9.7123457, "BIC": F.col("l_extendedprice") / 997.123457, "VAF": vaf, "SSE": F.col("l_quantity") * 1.0123457}
    return li.select(*(x.alias(n) for n, x in more.items()))


query("agg_aggregate_results", f"WITH {_AGG} SELECT {_AGG_OUT} FROM agg")(lambda s, d: W.aggregate_results(_results(s, d)))
query("agg_summary_table", f"WITH {_AGG} SELECT model_type, Method, {r('avg(ARI_mean)', 'mean')}, {r('stddev_samp(ARI_mean)', 'sd')}, {r('min(ARI_mean)', 'min')}, {r('max(ARI_mean)', 'max')} FROM agg GROUP BY 1, 2")(lambda s, d: W.summary_table(W.aggregate_results(_results(s, d))))
_PART = "PARTITION BY model_type, N, K, r, M, T_each, cluster_sep_spatial, cluster_sep_temporal, cluster_sep_stability"
# Means are compared at twelve decimals, so that both engines see the same ties.
_EXACT = f"ex AS (SELECT * REPLACE (round(ARI_mean, 12) AS ARI_mean, round(BIC_mean, 12) AS BIC_mean) FROM agg)"


def _aggregated(s, d):
    a = W.aggregate_results(_results(s, d))
    return a.withColumns({c: F.round(c, 12) for c in ("ARI_mean", "BIC_mean")})


query("agg_best_method", f"WITH {_AGG}, {_EXACT}, w AS (SELECT *, max(ARI_mean) OVER ({_PART}) AS top FROM ex) SELECT {_AGG_OUT} FROM w WHERE ARI_mean = top")(lambda s, d: W.best_method(_aggregated(s, d)))
query("agg_best_method_bic", f"WITH {_AGG}, {_EXACT}, w AS (SELECT *, min(BIC_mean) OVER ({_PART}) AS top FROM ex) SELECT {_AGG_OUT} FROM w WHERE BIC_mean = top")(lambda s, d: W.best_method(_aggregated(s, d), "BIC", False))
query(
    "agg_win_rates",
    f"WITH {_AGG}, {_EXACT}, w AS (SELECT *, max(ARI_mean) OVER ({_PART}) AS top FROM ex), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT model_type, N, K, r, M, T_each, cluster_sep_spatial, cluster_sep_temporal, cluster_sep_stability FROM ex)) SELECT model_type, Method, count(*) AS n_wins, {r('count(*) / any_value(n.n) * 100', 'win_rate')} FROM w, n WHERE ARI_mean = top GROUP BY 1, 2",
)(lambda s, d: W.win_rates(_aggregated(s, d)))
_MS = "ms AS (SELECT CAST(20 + 10 * (l_suppkey % 3) AS INTEGER) AS N, CAST(2 + l_partkey % 2 AS INTEGER) AS K_true, 2 AS r_true, l_returnflag AS method, l_linestatus AS selection_strategy, 'modelsel' AS mode, 'select' AS r_mode, l_discount * 9.7123457 AS ARI, 1 - l_tax * 1.0123457 AS VAF, l_extendedprice / 997.123457 AS BIC, l_discount * 1.0123457 AS subspace_similarity, l_quantity * 1.0123457 AS runtime_sec, l_linenumber < 4 AS K_correct, l_linenumber < 5 AS r_correct, l_linenumber < 3 AS Kr_correct, CASE WHEN l_linenumber = 7 THEN 'failed' ELSE '' END AS error_msg FROM lineitem)"
_MSM = {"ARI": "ARI", "VAF": "VAF", "BIC": "BIC", "subspace_similarity": "subspace_similarity", "runtime_sec": "runtime"}
_MSA = f"{_MS}, msa AS (SELECT N, K_true, r_true, method, selection_strategy, mode, r_mode, {', '.join(f'avg({m}) AS {o}_mean, stddev_samp({m}) AS {o}_sd' for m, o in _MSM.items())}, {', '.join(f'avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {c}_rate' for c in ('K_correct', 'r_correct', 'Kr_correct'))}, count(*) AS n_reps, CAST(sum(CASE WHEN error_msg <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM ms GROUP BY ALL)"


def _modelsel(s, d):
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    columns = {
        "N": (20 + 10 * (F.col("l_suppkey") % 3)).cast("int"), "K_true": (2 + F.col("l_partkey") % 2).cast("int"), "r_true": F.lit(2), "method": F.col("l_returnflag"), "selection_strategy": F.col("l_linestatus"), "mode": F.lit("modelsel"), "r_mode": F.lit("select"),
        "ARI": F.col("l_discount") * 9.7123457, "VAF": 1 - F.col("l_tax") * 1.0123457, "BIC": F.col("l_extendedprice") / 997.123457, "subspace_similarity": F.col("l_discount") * 1.0123457, "runtime_sec": F.col("l_quantity") * 1.0123457, "K_correct": n < 4, "r_correct": n < 5, "Kr_correct": n < 3, "error_msg": F.when(n == 7, "failed").otherwise(""),
    }
    return li.select(*(x.alias(k) for k, x in columns.items()))


_MSC = [f"{o}_{f}" for o in _MSM.values() for f in ("mean", "sd")] + [f"{c}_rate" for c in ("K_correct", "r_correct", "Kr_correct")]
query("agg_modelsel_aggregate", f"WITH {_MSA} SELECT N, K_true, r_true, method, selection_strategy, mode, r_mode, {', '.join(r(c, c) for c in _MSC)}, n_reps, n_errors FROM msa")(lambda s, d: W.aggregate_modelsel(_modelsel(s, d)))
_VALUES = " UNION ALL ".join(f"SELECT N, K_true, r_true, mode, r_mode, method, selection_strategy, '{m}' AS metric, round({'' if up else '-'}{c}, 12) AS v FROM msa" for m, (c, up) in W.MODELSEL_METRICS.items())
query(
    "agg_modelsel_win_rates",
    f"WITH {_MSA}, v AS ({_VALUES}), w AS (SELECT *, max(v) OVER (PARTITION BY N, K_true, r_true, mode, r_mode, metric) AS top FROM v), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT N, K_true, r_true, mode, r_mode FROM msa)) SELECT metric, method, selection_strategy, count(*) AS n_wins, any_value(n.n) AS total_conditions, {r('count(*) / any_value(n.n) * 100', 'win_rate')} FROM w, n WHERE v = top GROUP BY 1, 2, 3",
)(lambda s, d: W.modelsel_win_rates((lambda a: a.withColumns({c: F.round(c, 12) for c, _ in W.MODELSEL_METRICS.values()}))(W.aggregate_modelsel(_modelsel(s, d)))))
query(
    "agg_table2",
    f"WITH t AS (SELECT CAST(l_linenumber AS INTEGER) AS K_true, CAST(l_suppkey % 2 AS INTEGER) AS r_true, CAST(l_partkey % 3 AS INTEGER) AS N, 8 AS M, CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE 1.0 END AS sep, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 2.0 END AS noise, l_discount * 1.0123457 AS a, l_tax * 1.0123457 AS b, l_quantity * 1.0123457 AS c, l_extendedprice / 997.123457 AS e FROM lineitem) "
    f"SELECT K_true, r_true, N, M, {r('avg(a)', 'ARI_MFA_mean')}, {r('stddev_samp(a)', 'ARI_MFA_sd')}, {r('avg(c)', 'BIC_MFA_mean')}, {r('avg(b)', 'ARI_PCA_mean')}, {r('stddev_samp(b)', 'ARI_PCA_sd')}, {r('avg(e)', 'BIC_PCA_mean')} FROM t WHERE abs(sep - 1) < 1e-9 AND abs(noise - 1) < 1e-9 GROUP BY 1, 2, 3, 4",
)(
    lambda s, d: W.table2(
        table(s, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("K_true"), (F.col("l_suppkey") % 2).cast("int").alias("r_true"), (F.col("l_partkey") % 3).cast("int").alias("N"), F.lit(8).alias("M"), F.when(F.col("l_returnflag") == "A", 0.5).otherwise(1.0).alias("sep"), F.when(F.col("l_linestatus") == "F", 1.0).otherwise(2.0).alias("noise"), (F.col("l_discount") * 1.0123457).alias("ARI_MFA"), (F.col("l_tax") * 1.0123457).alias("ARI_PCA"), (F.col("l_quantity") * 1.0123457).alias("BIC_MFA"), (F.col("l_extendedprice") / 997.123457).alias("BIC_PCA"))
    )
)
query("agg_ari_vaf_table", f"WITH v AS (SELECT s_nationkey AS file, avg(s_acctbal) / 997.123457 AS vaf FROM supplier GROUP BY 1) SELECT c_custkey, v.file IS NOT NULL AS found, {r('vaf', 'vaf')} FROM customer LEFT JOIN v ON c_nationkey = v.file")(
    lambda s, d: W.join_vaf(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("file")), table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg((F.avg("s_acctbal") / 997.123457).alias("vaf"))).select("c_custkey", F.col("vaf").isNotNull().alias("found"), "vaf")
)
query("agg_k_selection_accuracy", f"WITH {_MS} SELECT method, count(*) AS n, {r('100 * avg(CASE WHEN K_correct THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM ms GROUP BY 1")(lambda s, d: W.accuracy(_modelsel(s, d)))
query("agg_completed_tasks", f"SELECT count(DISTINCT o_custkey) AS n_completed, CAST(2000 AS BIGINT) AS n_total, {r('round(100 * count(DISTINCT o_custkey) / 2000.0, 1)', 'pct')} FROM orders")(lambda s, d: R.completed_tasks(table(s, d, "orders"), 2000, "o_custkey"))
query("agg_partial_dispatch", f"WITH {_MSA} SELECT N, K_true, r_true, method, selection_strategy, n_reps, n_errors FROM msa")(lambda s, d: W.aggregate_partial(_modelsel(s, d)).select("N", "K_true", "r_true", "method", "selection_strategy", "n_reps", "n_errors"))

# Simulated panels of as many subjects as there are suppliers; random, so SQL tells their shape only.
query("src_simulate")(lambda s, d: G.generate(s, seed=7, n_subjects=table(s, d, "supplier").count(), length=60)[0].df)

# Tables behind plots.
_FACTORS = [f"f{k}" for k in range(1, 5)]


def _wide(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("k"), *(F.col("embedding")[k].cast("double").alias(f"f{k + 1}") for k in range(4)))


_WIDE = "WITH w AS (SELECT vec_id, CAST(label AS INTEGER) AS k, " + ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS f{k}" for k in range(1, 5)) + " FROM embeddings) "
query("pl_loadings_long", _WIDE + " UNION ALL ".join(f"SELECT vec_id, k, '{f}' AS Factor, {r(f, 'Loading')} FROM w" for f in _FACTORS))(lambda s, d: D.loadings_long(_wide(s, d), ["vec_id", "k"], _FACTORS))
_ZLS = f"WITH {LS}, zz AS (SELECT *, CAST(subject_id % 2 + 1 AS INTEGER) AS z FROM ls)"
query("pl_mean_waveform", f"{_ZLS} " + " UNION ALL ".join(f"SELECT z, t, '{c}' AS channel, {r(f'avg({c})', 'value')} FROM zz GROUP BY 1, 2" for c in CHANNELS))(lambda s, d: D.mean_waveform(scaled_lines(s, d), parity(s, d)))
query("pl_first_n_per_cluster", "WITH s AS (SELECT DISTINCT l_suppkey AS subject_id, CAST(l_suppkey % 2 + 1 AS INTEGER) AS z FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY subject_id) AS rk FROM s) SELECT subject_id, z FROM k WHERE rk <= 5")(lambda s, d: D.first_per_cluster(parity(s, d), 5))


def _mean_loadings(s, d):
    """Loadings of two groups of order lines: mean prices by part class (channel) and supplier class (factor)."""
    li = table(s, d, "lineitem")
    keys = {"k": F.when(F.col("l_returnflag") == "A", 0).otherwise(1), "channel": F.col("l_partkey") % 24, "factor": (F.col("l_suppkey") % 2 + 1).cast("int")}
    return li.groupBy(*(x.alias(n) for n, x in keys.items())).agg((F.avg("l_extendedprice") / 997.123457).alias("value"))


_RANKED = "lo AS (SELECT CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS k, l_partkey % 24 AS c, CAST(l_suppkey % 2 + 1 AS INTEGER) AS factor, avg(l_extendedprice) / 997.123457 AS value FROM lineitem GROUP BY 1, 2, 3), ab AS (SELECT x.factor AS fa, y.factor AS fb, x.c, x.value AS x, y.value AS y FROM lo x JOIN lo y ON x.c = y.c WHERE x.k = 0 AND y.k = 1)"
query("pl_loading_correlation_pearson", f"WITH {_RANKED} SELECT fa AS factor_a, fb AS factor_b, {r('corr(x, y)', 'corr')} FROM ab GROUP BY 1, 2")(lambda s, d: D.loading_correlation(_mean_loadings(s, d), 0, 1))
query("pl_loading_correlation_spearman", f"WITH {_RANKED}, rk AS (SELECT fa, fb, rank() OVER (PARTITION BY fa, fb ORDER BY x) + (count(*) OVER (PARTITION BY fa, fb, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY fa, fb ORDER BY y) + (count(*) OVER (PARTITION BY fa, fb, y) - 1) / 2.0 AS ry FROM ab) SELECT fa AS factor_a, fb AS factor_b, {r('corr(rx, ry)', 'corr')} FROM rk GROUP BY 1, 2")(lambda s, d: D.loading_correlation(_mean_loadings(s, d), 0, 1, "spearman"))
query("pl_loading_correlation_kendall", f"WITH {_RANKED} SELECT p.fa AS factor_a, p.fb AS factor_b, {r('sum(sign(q.x - p.x) * sign(q.y - p.y)) / sqrt(sum(sign(q.x - p.x) ** 2) * sum(sign(q.y - p.y) ** 2))', 'corr')} FROM ab p JOIN ab q ON p.fa = q.fa AND p.fb = q.fb AND p.c < q.c GROUP BY 1, 2")(lambda s, d: D.loading_correlation(_mean_loadings(s, d), 0, 1, "kendall"))
query("pl_sse_heatmap", f"WITH e AS (SELECT l_suppkey AS subject_id, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1) SELECT subject_id, 'a' AS method, {r('a', 'sse')}, {r('log10(a + 1e-10)', 'log_sse')} FROM e UNION ALL SELECT subject_id, 'b', {r('b', 'sse')}, {r('log10(b + 1e-10)', 'log_sse')} FROM e")(
    lambda s, d: D.sse_heatmap(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject_id")).agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b")), ["a", "b"])
)
query("pl_minmax_activations", f"WITH {EV} SELECT subject_id, t, {r('coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0)', 'x')} FROM ev WINDOW w AS (PARTITION BY subject_id)")(lambda s, d: D.minmax(events(s, d)))
_MM = "mr AS MATERIALIZED (SELECT subject_id, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("qty", "price")) + " FROM ls GROUP BY 1), mm AS MATERIALIZED (SELECT subject_id, t, CAST(subject_id % 2 + 1 AS INTEGER) AS z, " + ", ".join(f"coalesce(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), 0) AS {c}" for c in ("qty", "price")) + " FROM ls JOIN mr USING (subject_id))"
# Two channels have their axes in closed form: an angle, and the axis at right angles to it.
_AXES = "ax AS (SELECT avg(qty) AS mx, avg(price) AS my, 0.5 * atan2(2 * covar_pop(qty, price), var_pop(qty) - var_pop(price)) AS a FROM mm), un AS (SELECT mx, my, cos(a) AS c1, sin(a) AS s1, -sin(a) AS c2, cos(a) AS s2 FROM ax), sg AS (SELECT *, CASE WHEN (CASE WHEN abs(c1) >= abs(s1) THEN c1 ELSE s1 END) < 0 THEN -1 ELSE 1 END AS g1, CASE WHEN (CASE WHEN abs(c2) >= abs(s2) THEN c2 ELSE s2 END) < 0 THEN -1 ELSE 1 END AS g2 FROM un)"
query("pl_neural_command", f"WITH {LS}, {_MM}, {_AXES} SELECT subject_id, t, z, {r('g1 * (c1 * (qty - mx) + s1 * (price - my))', 'dim_1')}, {r('g2 * (c2 * (qty - mx) + s2 * (price - my))', 'dim_2')} FROM mm, sg")(
    lambda s, d: D.neural_command(A.Panel(scaled_lines(s, d).df.select("subject_id", "t", "qty", "price"), ("qty", "price")), parity(s, d))
)
_TWO = f"{LS}, mm AS (SELECT subject_id, avg(qty) AS qty, var_samp(price) AS price FROM ls GROUP BY 1), {_AXES}"
query("pl_cluster_embedding_of_two", f"WITH {_TWO} SELECT subject_id, {r('g1 * (c1 * (qty - mx) + s1 * (price - my))', 'dim_1')}, {r('g2 * (c2 * (qty - mx) + s2 * (price - my))', 'dim_2')} FROM mm, sg")(lambda s, d: D.embedding(S.mean_variance_features(scaled_lines(s, d, False)), ["mean_qty", "var_price"]))
query("src_read_all_results", "SELECT * FROM (SELECT * FROM region UNION ALL BY NAME SELECT * FROM nation)")(lambda s, d: R.read_all_results(s, f"{d}/region.parquet", f"{d}/nation.parquet").drop("file"))
query("src_simulate_shape", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS subject_id, CAST(40 AS BIGINT) AS n, 1 AS first, 40 AS last, true AS has_cluster FROM supplier")(
    lambda s, d: (lambda p, z: p.df.groupBy("subject_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).join(z, "subject_id").select("subject_id", "n", "first", "last", F.col("z_true").between(1, 2).alias("has_cluster")))(*G.simulate(s, G.Design(table(s, d, "supplier").count(), 2, 2, 5, 40, seed=9)))
)
query("pl_cluster_embedding")(lambda s, d: D.embedding(S.mean_variance_features(scaled_lines(s, d, False)), [f"{f}_{c}" for f in ("mean", "var") for c in CHANNELS]))
query("pl_mean_basis", f"WITH {_LOAD}, m AS (SELECT CAST(channel % 2 + 1 AS INTEGER) AS k, CAST(k AS BIGINT) AS ch, factor, avg(value) AS v FROM lo GROUP BY ALL) SELECT k, ch AS channel, factor, {r('v', 'value')} FROM m")(
    lambda s, d: (lambda b: D.mean_basis(b, b.select("subject_id").distinct().withColumn("z", (F.col("subject_id") % 2 + 1).cast("int"))))(loadings(s, d).select(F.col("channel").alias("subject_id"), F.col("k").cast("long").alias("channel"), "factor", "value"))
)
query("pl_common_subjects", "SELECT l_suppkey AS subject_id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")(
    lambda s, d: D.common_subjects(*(table(s, d, "lineitem").where(w).select(F.col("l_suppkey").alias("subject_id")) for w in ("l_returnflag = 'A'", "l_linestatus = 'O'")))
)
query("pl_metric_by_axis", f"WITH {_RES} SELECT N, Method, {r('avg(ARI)', 'mean')}, {r('stddev_samp(ARI)', 'sd')}, {r('min(ARI)', 'min')}, {r('max(ARI)', 'max')}, count(ARI) AS n_values FROM res GROUP BY 1, 2")(lambda s, d: D.metric_by_axis(_results(s, d), "N", "ARI"))
query("pl_method_kind", "SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, '^Single') THEN 'Single model' WHEN regexp_matches(p_name, '^TwoStep') THEN 'Two-step' WHEN regexp_matches(p_name, '^Mixture') THEN 'Mixture' ELSE 'Other' END AS method_type FROM part")(lambda s, d: D.method_kind(table(s, d, "part").select("p_partkey", "p_name"), "p_name"))
query("pl_long_metrics", f"WITH x AS (SELECT l_suppkey, l_linenumber, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, 'a' AS metric, {r('a', 'value')} FROM x UNION ALL SELECT l_suppkey, l_linenumber, 'b', {r('b', 'value')} FROM x")(
    lambda s, d: D.long_metrics(table(s, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b")), ["l_suppkey", "l_linenumber"], ["a", "b"])
)
query("pl_bic_line", f"WITH f AS (SELECT CAST(1 + l_linenumber % 5 AS INTEGER) AS K, CAST(1 + l_suppkey % 4 AS INTEGER) AS r, round(sum(l_extendedprice), 2) AS BIC FROM lineitem GROUP BY 1, 2) SELECT K, r, {r('BIC', 'BIC')}, BIC = min(BIC) OVER () AS best FROM f")(
    lambda s, d: D.bic_line(table(s, d, "lineitem").groupBy((1 + F.col("l_linenumber") % 5).cast("int").alias("K"), (1 + F.col("l_suppkey") % 4).cast("int").alias("r")).agg(F.round(F.sum("l_extendedprice"), 2).alias("BIC")))
)


@query("st_windowed_moments", f"SELECT user_id AS subject_id, time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS \"end\", count(*) AS n, {r('sum(value)', 's_value')}, {r('sum(value * value)', 'q_value_value')} FROM events GROUP BY ALL")
def _windowed(s, d):
    from strandmix.streaming.panels import windowed_moments

    return windowed_moments(table(s, d, "events"), "user_id", "ts", ["value"])


def _first_scores() -> str:
    """SQL: a row's scores under the first cluster."""
    from strandmix.operators.project import fa_scorer
    from strandmix.plans.models import linear_sql

    c = fixed("mfa").components[0]
    return ", ".join(r(x, f"f_{k + 1}") for k, x in enumerate(linear_sql(fa_scorer(c), c.mean)))


@query("st_score_rows", f"WITH {LS} SELECT subject_id, t, {', '.join(r(c, c) for c in CHANNELS)}, {_first_scores()} FROM ls")
def _scored(s, d):
    from strandmix.streaming.panels import score_rows

    return score_rows(scaled_lines(s, d).df, fixed("mfa"))


@query("st_sessions", f"WITH g AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS subject_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n, {r('avg(value)', 'mean')} FROM n GROUP BY user_id, k")
def _sessions(s, d):
    from strandmix.streaming.panels import sessions

    return sessions(table(s, d, "events"), "user_id", "ts", "value")


# Scores and reconstructions under the fixed parameters, as plots take them.
def _scores(s, d):
    from strandmix.operators import project as P

    p = scaled_lines(s, d)
    return p, P.scores(p, fixed("mfa"), parity(s, d)), P.reconstruct(p, fixed("mfa"), parity(s, d))


def _fixed_rows(what: str) -> str:
    """SQL: the rows of a query over fixed parameters, before they are rounded."""
    from strandmix.plans.registry import ORACLE

    return ORACLE[what].replace("round(", "(").replace(", 6) + 0.0", ")")


query(
    "pl_factor_scores_mean",
    f"SELECT z, t, 'f_1' AS channel, {r('avg(f_1)', 'value')} FROM ({_fixed_rows('pj_scores_mfa')}) GROUP BY 1, 2 UNION ALL SELECT z, t, 'f_2', {r('avg(f_2)', 'value')} FROM ({_fixed_rows('pj_scores_mfa')}) GROUP BY 1, 2",
)(lambda s, d: D.mean_waveform(A.Panel(_scores(s, d)[1].drop("z"), ("f_1", "f_2")), parity(s, d)))
query("pl_factor_scores_long", f"SELECT subject_id, t, z, 'f_1' AS Factor, {r('f_1', 'Loading')} FROM ({_fixed_rows('pj_scores_mfa')}) UNION ALL SELECT subject_id, t, z, 'f_2', {r('f_2', 'Loading')} FROM ({_fixed_rows('pj_scores_mfa')})")(
    lambda s, d: D.loadings_long(_scores(s, d)[1], ["subject_id", "t", "z"], ["f_1", "f_2"])
)
query(
    "pl_waveform_comparison",
    f"WITH {LS} SELECT t, 'original' AS kind, {r('qty', 'value')} FROM ls WHERE subject_id = 3 UNION ALL SELECT t, 'reconstructed', {r('qty', 'value')} FROM ({_fixed_rows('pj_reconstruct_mfa')}) WHERE subject_id = 3",
)(lambda s, d: (lambda p, _, back: D.compare_waveforms(p, back, 3, "qty"))(*_scores(s, d)))
query(
    "pl_noise_profiles",
    f"WITH {LS}, b AS ({_fixed_rows('pj_reconstruct_mfa')}), e AS ("
    + " UNION ALL ".join(f"SELECT b.z, b.t, '{c}' AS channel, ls.{c} - b.{c} AS e FROM ls JOIN b ON ls.subject_id = b.subject_id AND ls.t = b.t" for c in CHANNELS)
    + f") SELECT z, t, channel, {r('stddev_samp(e)', 'sd')}, count(e) AS n FROM e GROUP BY 1, 2, 3",
)(lambda s, d: (lambda p, _, back: D.noise_profile(p, back))(*_scores(s, d)))
_LAGGED = "({c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w)"
query("ss_second_differences", f"WITH {LS} SELECT subject_id, t, {', '.join(r(_LAGGED.format(c=c), c) for c in CHANNELS)} FROM ls WINDOW w AS (PARTITION BY subject_id ORDER BY t)")(lambda s, d: S.second_differences(scaled_lines(s, d)))
