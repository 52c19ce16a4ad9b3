"""Queries over fitted mixtures, projections, likelihoods, selection and evaluation."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmix.functions import linalg as L
from strandmix.operators import baselines as B
from strandmix.operators import criteria as C
from strandmix.operators import evaluate as E
from strandmix.operators import mixture as M
from strandmix.operators import project as P
from strandmix.operators import selection as Q
from strandmix.operators import suffstats as S
from strandmix.plans.registry import CHANNELS, LS, query, r, table
from strandmix.plans.signal import parity, scaled_lines
from strandmix.sources import panel as A
from strandmix.sources import simulate as G

# Fixed parameters, so that projections and likelihoods are the same expressions in SQL.
MEANS = ((0.50, 0.38, 0.50, 0.40), (0.60, 0.30, 0.40, 0.50))
LOADINGS = (((0.20, 0.05), (0.15, -0.05), (0.02, 0.25), (0.01, 0.10)), ((0.10, -0.15), (0.22, 0.04), (-0.05, 0.20), (0.12, 0.02)))
NOISE = ((0.05, 0.04, 0.06, 0.05), (0.04, 0.05, 0.05, 0.06))
PRIORS = (0.6, 0.4)


def fixed(kind: str) -> M.Fit:
    """A mixture with the fixed parameters; a PCA mixture has equal noise."""
    parts = tuple(L.Component(np.array(m), np.array(w), np.array(n) if kind == "mfa" else np.full(4, 0.05)) for m, w, n in zip(MEANS, LOADINGS, NOISE))
    return M.Fit(kind, np.zeros(0, np.int64), np.zeros(0, int), np.zeros((0, 2)), np.array(PRIORS), parts, 0.0, 0, CHANNELS)


def linear_sql(coefficients, mean, offset=None) -> list[str]:
    return [" + ".join([repr(float(offset[k]) if offset is not None else 0.0), *(f"({float(v)!r}) * ({c} - ({float(m)!r}))" for v, c, m in zip(row, CHANNELS, mean))]) for k, row in enumerate(coefficients)]


def _case(per_cluster: list[list[str]], names) -> str:
    return ", ".join(r("CASE " + " ".join(f"WHEN z = {k + 1} THEN {x[j]}" for k, x in enumerate(per_cluster)) + " END", name) for j, name in enumerate(names))


_Z = f"WITH {LS}, zz AS (SELECT *, CAST(subject_id % 2 + 1 AS INTEGER) AS z FROM ls)"


def _rows_query(name, kind, make, per_cluster, names):
    query(name, f"{_Z} SELECT subject_id, t, z, {_case(per_cluster, names)} FROM zz")(lambda s, d: make(scaled_lines(s, d), fixed(kind), parity(s, d)))


for _kind, _scorer in (("mfa", P.fa_scorer), ("mpca", P.ppca_scorer)):
    _fit = fixed(_kind)
    _rows_query(f"pj_scores_{_kind}", _kind, P.scores, [linear_sql(_scorer(c), c.mean) for c in _fit.components], ["f_1", "f_2"])
    _rows_query(f"pj_reconstruct_{_kind}", _kind, P.reconstruct, [linear_sql(P.hat(_kind, c), c.mean, c.mean) for c in _fit.components], CHANNELS)
for _name in ("pca", "single_fa"):
    _rows_query(f"pj_reconstruct_{_name}", "mfa", lambda p, f, a, k=_name: P.reconstruct(p, f, a, k), [linear_sql(P.hat(_name, c), c.mean, c.mean) for c in fixed("mfa").components], CHANNELS)


def _squares(kind: str) -> str:
    out = []
    for k, c in enumerate(fixed(kind).components):
        out.append(f"WHEN z = {k + 1} THEN " + " + ".join(f"({x}) ** 2" for x in linear_sql(np.eye(4) - P.hat(kind, c), c.mean)))
    return "CASE " + " ".join(out) + " END"


_ABOUT = " + ".join(f"var_pop({c}) * count({c})" for c in CHANNELS)
for _kind in ("mfa", "mpca"):
    query(
        f"pj_sse_by_cluster_{_kind}",
        f"{_Z}, e AS (SELECT z, {_squares(_kind)} AS e, qty, price, disc, tax FROM zz) SELECT z, {r('sum(e)', 'sse')}, count(*) AS n, {r('sum(e) / count(*)', 'sse_per_row')}, {r(f'1 - sum(e) / nullif({_ABOUT}, 0)', 'vaf')} FROM e GROUP BY z",
    )(lambda s, d, k=_kind: P.summarize_clusters(scaled_lines(s, d), fixed(k), parity(s, d)))
    query(
        f"pj_vaf_{_kind}",
        f"{_Z} SELECT {r(f'1 - sum({_squares(_kind)}) / sum(qty*qty + price*price + disc*disc + tax*tax)', 'vaf')} FROM zz",
    )(lambda s, d, k=_kind: P.row_errors(scaled_lines(s, d), fixed(k), parity(s, d)).agg(F.sum("sq_error").alias("sse")).join(S.total_squares(scaled_lines(s, d, False), "raw")).select((1 - F.col("sse") / F.col("sst")).alias("vaf")))
query(
    "pj_score_smoothness",
    f"{_Z}, f AS (SELECT subject_id, t, {_case([linear_sql(P.fa_scorer(c), c.mean) for c in fixed('mfa').components], ['f_1', 'f_2']).replace('round(', '(').replace(', 6)', ')')} FROM zz), "
    "dd AS (SELECT f_1 - 2 * lag(f_1, 1) OVER w + lag(f_1, 2) OVER w AS a, f_2 - 2 * lag(f_2, 1) OVER w + lag(f_2, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY subject_id ORDER BY t)) "
    f"SELECT {r('coalesce(sum(a * a), 0) + coalesce(sum(b * b), 0)', 'penalty')} FROM dd",
)(lambda s, d: P.score_smoothness(scaled_lines(s, d), fixed("mfa"), parity(s, d)))


def _log_density(kind: str, k: int) -> str:
    """SQL: log prior plus the sum of the rows' log densities, row by row."""
    c = fixed(kind).components[k]
    inv, logdet = np.linalg.inv(c.cov), float(np.linalg.slogdet(c.cov)[1])
    quad = " + ".join(f"({float(inv[i, j])!r}) * ({CHANNELS[i]} - ({float(c.mean[i])!r})) * ({CHANNELS[j]} - ({float(c.mean[j])!r}))" for i in range(4) for j in range(4))
    return f"ln({PRIORS[k]} + 1e-16) + sum(-0.5 * ({float(4 * L.LOG_2PI + logdet)!r} + {quad}))"


def _row_density(kind: str, k: int) -> str:
    """SQL: the log density of a row under a cluster."""
    c = fixed(kind).components[k]
    inv, logdet = np.linalg.inv(c.cov), float(np.linalg.slogdet(c.cov)[1])
    quad = " + ".join(f"({float(inv[i, j])!r}) * ({CHANNELS[i]} - ({float(c.mean[i])!r})) * ({CHANNELS[j]} - ({float(c.mean[j])!r}))" for i in range(4) for j in range(4))
    return f"-0.5 * ({float(4 * L.LOG_2PI + logdet)!r} + {quad})"


for _kind in ("mfa", "mpca"):
    query(f"pj_row_log_density_{_kind}", f"WITH {LS} SELECT subject_id, t, {', '.join(r(_row_density(_kind, k), f'log_density_{k + 1}') for k in range(2))} FROM ls")(lambda s, d, k=_kind: P.row_log_densities(scaled_lines(s, d), fixed(k)))


def _rotated_scores(s, d):
    fit = E.rotate(fixed("mfa"))
    return E.rotate_scores(P.scores(scaled_lines(s, d), fixed("mfa"), parity(s, d)), fit)


def _rotated_sql() -> str:
    turned = E.rotate(fixed("mfa")).extra["rotations"]
    plain = [linear_sql(P.fa_scorer(c), c.mean) for c in fixed("mfa").components]
    new = [[" + ".join(f"({float(turned[k + 1][i, j])!r}) * ({plain[k][i]})" for i in range(2)) for j in range(2)] for k in range(2)]
    return _case(new, ["f_1", "f_2"])


query("pj_rotated_scores", f"{_Z} SELECT subject_id, t, z, {_rotated_sql()} FROM zz")(_rotated_scores)
_JOINT = "WITH {ls}, j AS ({rows})"


def _joint_sql(kind: str) -> str:
    rows = " UNION ALL ".join(f"SELECT subject_id, {k + 1} AS k, {_log_density(kind, k)} AS v FROM ls GROUP BY 1" for k in range(2))
    return _JOINT.format(ls=LS, rows=rows)


def _joint(s, d, kind):
    fit = fixed(kind)
    return C.joint_frame(S.moments(scaled_lines(s, d, False)), fit.components, fit.pi, np.zeros(4))


for _kind in ("mfa", "mpca"):
    _lse = f"{_joint_sql(_kind)}, m AS (SELECT subject_id, k, v, max(v) OVER (PARTITION BY subject_id) AS top FROM j)"
    query(f"ic_loglik_{_kind}", f"{_lse} SELECT subject_id, {r('max(top) + ln(sum(exp(v - top)))', 'lse')} FROM m GROUP BY 1")(lambda s, d, k=_kind: C.log_sum_exp(_joint(s, d, k), ["subject_id"], "value"))
    query(f"ic_responsibilities_{_kind}", f"{_lse} SELECT subject_id, CAST(k AS INTEGER) AS k, {r('exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY subject_id)', 'p')} FROM m")(lambda s, d, k=_kind: C.responsibilities(_joint(s, d, k)))
    query(f"mx_assign_given_params_{_kind}", f"{_lse}, k AS (SELECT subject_id, k, v, row_number() OVER (PARTITION BY subject_id ORDER BY v DESC, k) AS rk FROM m) SELECT subject_id, CAST(k AS INTEGER) AS z, {r('v', 'loglik')} FROM k WHERE rk = 1")(
        lambda s, d, k=_kind: M.assign_frame(S.moments(scaled_lines(s, d, False)), [L.Component(c.mean, c.loadings, c.noise - L.JITTER) for c in fixed(k).components], fixed(k).pi, np.zeros(4))
    )
# Each candidate fit of a table, by its own K, r and likelihood.
_FITS = "fits AS (SELECT CAST(1 + l_linenumber % 5 AS INTEGER) AS k, CAST(1 + l_suppkey % 4 AS INTEGER) AS r, -sum(l_extendedprice) / 1e6 AS ll, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _fits(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy((1 + F.col("l_linenumber") % 5).cast("int").alias("k"), (1 + F.col("l_suppkey") % 4).cast("int").alias("r")).agg((-F.sum("l_extendedprice") / 1e6).alias("ll"), F.count("*").alias("n"))


for _kind, _own in (("mfa", "2 * 8"), ("mpca", "8 + 1")):
    query(f"ic_bic_{_kind}", f"WITH {_FITS} SELECT k, r, {r(f'-2 * ll + (k * (8 * r + r * (r - 1) / 2 + {_own}) + k - 1) * ln(n)', 'bic')} FROM fits")(lambda s, d, kind=_kind: _fits(s, d).select("k", "r", C.bic_column(F.col("ll"), kind, F.col("k"), F.col("r"), F.lit(8), F.col("n")).alias("bic")))

# Two-cluster responsibilities from prices.
_RESP = "resp AS (SELECT o_orderkey AS subject_id, CAST(1 AS INTEGER) AS k, (o_totalprice % 1000) / 1000 AS p FROM orders UNION ALL SELECT o_orderkey, 2, 1 - (o_totalprice % 1000) / 1000 FROM orders)"
_TRUTH = "truth AS (SELECT o_orderkey AS subject_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS z_true FROM orders)"


def _resp(s, d):
    o, p = table(s, d, "orders"), (F.col("o_totalprice") % 1000) / 1000
    return o.select(F.col("o_orderkey").alias("subject_id"), F.posexplode(F.array(p, 1 - p)).alias("k", "p")).select("subject_id", (F.col("k") + 1).cast("int").alias("k"), "p")


def _truth(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("z_true"))


query("ic_entropy", f"WITH {_RESP} SELECT {r('-sum((p + 1e-16) * ln(p + 1e-16))', 'entropy')} FROM resp")(lambda s, d: C.entropy_frame(_resp(s, d)))
query("ic_icl", f"WITH {_RESP} SELECT {r('1000.0 + 2 * -sum((p + 1e-16) * ln(p + 1e-16))', 'icl')} FROM resp")(lambda s, d: C.entropy_frame(_resp(s, d)).select((F.lit(1000.0) + 2 * F.col("entropy")).alias("icl")))
query("ic_hard_labels", f"WITH {_RESP}, x AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY p DESC, k) AS rk FROM resp) SELECT subject_id, k AS z FROM x WHERE rk = 1")(lambda s, d: C.hard_labels(_resp(s, d)))
query("ic_cluster_sizes", f"WITH {_RESP}, x AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY p DESC, k) AS rk FROM resp) SELECT k AS z, count(*) AS n FROM x WHERE rk = 1 GROUP BY 1")(lambda s, d: C.cluster_sizes(C.hard_labels(_resp(s, d))))
_BINS = "b AS (SELECT k AS cluster, p, CASE WHEN z_true = k THEN 1.0 ELSE 0.0 END AS hit, CAST(greatest(1, least(10, ceil(round(p * 10, 9)))) AS INTEGER) AS bin FROM resp JOIN truth USING (subject_id)), c AS (SELECT cluster, bin, avg(p) AS mp, avg(hit) AS mo, count(*) AS n FROM b GROUP BY 1, 2), g AS (SELECT DISTINCT cluster, CAST(i AS INTEGER) AS bin FROM b, range(1, 11) t(i)), cal AS (SELECT g.cluster, g.bin, mp, mo, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.cluster = c.cluster AND g.bin = c.bin)"
query("ev_calibration", f"WITH {_RESP}, {_TRUTH}, {_BINS} SELECT cluster, bin, {r('(bin - 0.5) / 10', 'bin_midpoint')}, {r('mp', 'mean_predicted')}, {r('mo', 'mean_observed')}, n AS n_samples FROM cal")(lambda s, d: E.calibration(_resp(s, d), _truth(s, d)))
query("ev_ece_mce", f"WITH {_RESP}, {_TRUTH}, {_BINS} SELECT {r('sum(n * abs(mp - mo)) / sum(n)', 'ece')}, {r('max(abs(mp - mo))', 'mce')} FROM cal")(lambda s, d: E.calibration_errors(E.calibration(_resp(s, d), _truth(s, d))))
query("ev_calibration_pooled", f"WITH {_RESP}, {_TRUTH}, {_BINS} SELECT bin, {r('sum(mp * n) / sum(n)', 'mean_predicted')}, {r('sum(mo * n) / sum(n)', 'mean_observed')}, CAST(sum(n) AS BIGINT) AS n_samples FROM cal GROUP BY 1")(lambda s, d: E.calibration_pooled(E.calibration(_resp(s, d), _truth(s, d))))
_CT = "ct AS (SELECT o_orderstatus AS truth, o_orderpriority AS pred, count(*) AS n FROM orders GROUP BY 1, 2)"
query(
    "ev_ari",
    f"WITH {_CT}, p AS (SELECT (SELECT sum(n*(n-1)/2.0) FROM ct) AS c, (SELECT sum(n*(n-1)/2.0) FROM (SELECT sum(n) AS n FROM ct GROUP BY truth)) AS a, (SELECT sum(n*(n-1)/2.0) FROM (SELECT sum(n) AS n FROM ct GROUP BY pred)) AS b, (SELECT sum(n) FROM ct) AS n) "
    f"SELECT {r('(c - a*b/(n*(n-1)/2.0)) / ((a+b)/2 - a*b/(n*(n-1)/2.0))', 'ari')} FROM p",
)(lambda s, d: E.ari_frame(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"))
for _norm, _value in (("none", "CAST(n AS DOUBLE)"), ("true", "n / sum(n) OVER (PARTITION BY truth)"), ("pred", "n / sum(n) OVER (PARTITION BY pred)")):
    query(f"ev_confusion_{_norm}", f"WITH {_CT} SELECT truth, pred, {r(_value, 'value')} FROM ct")(lambda s, d, n=_norm: E.confusion(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", n))
query("ev_extract_labels", "SELECT o_orderkey, o_orderstatus AS cluster, coalesce(o_orderstatus, o_orderpriority) AS label FROM orders")(
    lambda s, d: E.extract_labels(table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("cluster"), F.col("o_orderpriority").alias("labels"))).drop("labels")
)
# Loadings by label: each vector is a channel, four of its components are factors.
_LOAD = "lo AS (SELECT CAST(label AS INTEGER) AS k, vec_id AS channel, CAST(f AS INTEGER) AS factor, CAST(embedding[f] AS DOUBLE) AS value FROM embeddings, range(1, 5) t(f))"


def loadings(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.col("label").cast("int").alias("k"), F.col("vec_id").alias("channel"), F.posexplode(F.slice("embedding", 1, 4)).alias("factor", "value")).select("k", "channel", (F.col("factor") + 1).cast("int").alias("factor"), F.col("value").cast("double").alias("value"))


query("ev_sign_alignment", f"WITH {_LOAD}, s AS (SELECT *, first_value(value) OVER (PARTITION BY k, factor ORDER BY abs(value) DESC, channel) AS top FROM lo) SELECT k, channel, factor, {r('CASE WHEN top < 0 THEN -value ELSE value END', 'value')} FROM s")(lambda s, d: E.align_signs_frame(loadings(s, d)))
query("ev_bootstrap_ci_summary", f"WITH x AS (SELECT CAST(l_linenumber AS INTEGER) AS k, CAST(l_suppkey % 4 + 1 AS INTEGER) AS channel, CAST(l_partkey % 2 + 1 AS INTEGER) AS factor, l_extendedprice / 997.123457 AS value FROM lineitem) SELECT k, channel, factor, {r('median(value)', 'median')}, {r('quantile_cont(value, 0.025)', 'lower')}, {r('quantile_cont(value, 0.975)', 'upper')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_boot FROM x GROUP BY 1, 2, 3")(
    lambda s, d: E.bootstrap_summary(table(s, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("k"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("channel"), (F.col("l_partkey") % 2 + 1).cast("int").alias("factor"), (F.col("l_extendedprice") / 997.123457).alias("value")))
)
query("sel_vss_threshold", f"WITH {_LOAD}, c AS (SELECT k, channel, sum(CASE WHEN abs(value) > 0.5 THEN 1 ELSE 0 END) AS strong, count(*) AS r FROM lo GROUP BY 1, 2) SELECT {r('avg(CASE WHEN strong = 1 OR r < 2 THEN 1.0 ELSE 0.0 END)', 'vss')} FROM c")(lambda s, d: Q.vss_frame(loadings(s, d)))
query("sel_vss_ratio", f"WITH {_LOAD}, c AS (SELECT max(value * value) AS top, sum(value * value) AS total FROM lo GROUP BY k, channel) SELECT {r('avg(top / total)', 'vss')} FROM c WHERE total > 0")(lambda s, d: Q.vss_frame(loadings(s, d), method="ratio"))
_FOLDS = "sc AS (SELECT CAST(l_linenumber AS INTEGER) AS k, l_suppkey % 5 AS fold, avg(l_extendedprice) / 997.123457 AS score FROM lineitem GROUP BY 1, 2)"
query("sel_one_se_rule", f"WITH {_FOLDS}, t AS (SELECT k, avg(score) AS m, stddev_samp(score) / sqrt(count(*)) AS se, count(*) AS n FROM sc GROUP BY k), b AS (SELECT m, se FROM t ORDER BY m DESC LIMIT 1), c AS (SELECT min(k) AS k FROM t WHERE t.m >= (SELECT m - coalesce(se, 0) FROM b)) SELECT t.k, {r('t.m', 'mean')}, {r('t.se', 'se')}, t.n AS folds, t.k = (SELECT k FROM c) AS selected FROM t")(
    lambda s, d: Q.one_se_rule(table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("k"), (F.col("l_suppkey") % 5).alias("fold")).agg((F.avg("l_extendedprice") / 997.123457).alias("score")), "k", "score")
)
_CAND = "cand AS (SELECT CAST(l_linenumber AS INTEGER) AS r, avg(l_extendedprice) / 997.123457 AS BIC, 1 - avg(l_tax) * 1.0123457 AS VAF, avg(l_quantity) * 1.0123457 AS smoothness, avg(l_discount) * 1.0123457 AS VSS FROM lineitem GROUP BY 1)"


def _candidates(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("r")).agg((F.avg("l_extendedprice") / 997.123457).alias("BIC"), (1 - F.avg("l_tax") * 1.0123457).alias("VAF"), (F.avg("l_quantity") * 1.0123457).alias("smoothness"), (F.avg("l_discount") * 1.0123457).alias("VSS"))


_mm = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
query("sel_vaf_threshold_rule", f"WITH {_CAND} SELECT coalesce(min(CASE WHEN VAF >= 0.96 THEN r END), max(r)) AS r_vaf, arg_min(r, BIC) AS r_bic FROM cand")(lambda s, d: Q.vaf_rule(_candidates(s, d), 0.96))
query(
    "sel_multicriteria_score",
    f"WITH {_CAND}, sc AS (SELECT *, ({_mm('BIC')}) + (1 - ({_mm('VAF')})) + ({_mm('smoothness')}) + (1 - ({_mm('VSS')})) AS s FROM cand), k AS (SELECT *, row_number() OVER (ORDER BY (VAF >= 0.9) DESC, CASE WHEN VAF >= 0.9 THEN s ELSE -VAF END, r) AS rk FROM sc) "
    f"SELECT r, {r('BIC', 'BIC')}, {r('VAF', 'VAF')}, {r('smoothness', 'smoothness')}, {r('VSS', 'VSS')}, {r('s', 'score')}, rk = 1 AS selected FROM k",
)(lambda s, d: Q.multicriteria(_candidates(s, d)))
query(
    "sel_best_r",
    f"WITH {_CAND}, a AS (SELECT *, VSS / ln(greatest(r, 2)) AS v FROM cand), sc AS (SELECT *, 0.4 * ({_mm('VAF')}) + 0.4 * ({_mm('v')}) - 0.2 * ({_mm('smoothness')}) AS s FROM a), k AS (SELECT *, row_number() OVER (ORDER BY (abs(s - (SELECT max(s) FROM sc)) < 1e-10) DESC, r) AS rk FROM sc) "
    f"SELECT r, {r('VAF', 'VAF')}, {r('VSS', 'VSS')}, {r('smoothness', 'smoothness')}, {r('s', 'score')}, rk = 1 AS selected FROM k",
)(lambda s, d: Q.best_r(_candidates(s, d).drop("BIC")))
_CR = "cr AS (SELECT l_suppkey AS k, CAST(1 + max(l_partkey) % 4 AS INTEGER) AS r FROM lineitem GROUP BY 1)"
for _how, _sql in (("max", "max(r)"), ("min", "min(r)"), ("mean", "round_even(avg(r), 0)"), ("majority", "(SELECT r FROM cr GROUP BY r ORDER BY count(*) DESC, r LIMIT 1)")):
    query(f"sel_aggregate_r_{_how}", f"WITH {_CR} SELECT CAST({'any_value(' + _sql + ')' if _how == 'majority' else _sql} AS INTEGER) AS r FROM cr")(
        lambda s, d, h=_how: Q.combine_r(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((1 + F.max("l_partkey") % 4).cast("int").alias("r")), h)
    )
_DRAWS = "dr AS (SELECT CAST(2 + o_orderkey % 3 AS INTEGER) AS K, o_orderkey % 20 AS b, o_custkey % 40 AS subject_id, min(o_custkey * 7 + o_orderkey) % (2 + o_orderkey % 3) AS z FROM orders GROUP BY 1, 2, 3, o_orderkey % 3), d AS (SELECT K, b, subject_id, min(z) AS z FROM dr GROUP BY 1, 2, 3)"
query(
    "sel_cocluster_stability",
    f"WITH {_DRAWS}, p AS (SELECT x.K, x.subject_id AS i, y.subject_id AS j, avg(CASE WHEN x.z = y.z THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM d x JOIN d y ON x.K = y.K AND x.b = y.b AND x.subject_id < y.subject_id GROUP BY 1, 2, 3) SELECT K, {r('1 - 4 * avg(p * (1 - p))', 'stability')}, count(*) AS n_pairs FROM p WHERE n >= 5 GROUP BY 1",
)(
    lambda s, d: Q.stability(
        table(s, d, "orders").groupBy((2 + F.col("o_orderkey") % 3).cast("int").alias("K"), (F.col("o_orderkey") % 20).alias("b"), (F.col("o_custkey") % 40).alias("subject_id")).agg((F.min(F.col("o_custkey") * 7 + F.col("o_orderkey")) % (2 + F.min(F.col("o_orderkey") % 3))).alias("z"))
    )
)


# Fits have their SQL where the truth is planted: suppliers with odd numbers lie far from the others, and any right fit tells them apart.
_PLANTED = f"{LS}, pl AS (SELECT subject_id, qty + CASE WHEN subject_id % 2 = 1 THEN 3 ELSE 0 END AS qty, price - CASE WHEN subject_id % 2 = 1 THEN 2 ELSE 0 END AS price, disc, tax FROM ls)"
#: Clusters as ``canonical`` numbers them: by size, then by smallest subject.
_TRUE = f"{_PLANTED}, sz AS (SELECT subject_id % 2 AS odd, count(DISTINCT subject_id) AS n, min(subject_id) AS low FROM pl GROUP BY 1), tr AS (SELECT odd, n, CAST(row_number() OVER (ORDER BY n DESC, low) AS INTEGER) AS z FROM sz)"


def planted(s, d) -> A.Panel:
    """The supplier panel with the suppliers of odd numbers moved."""
    p = scaled_lines(s, d, False)
    odd = F.pmod("subject_id", F.lit(2)) == 1
    return p.with_df(p.df.withColumns({"qty": F.col("qty") + F.when(odd, 3.0).otherwise(0.0), "price": F.col("price") - F.when(odd, 2.0).otherwise(0.0)}))


def _stats(s, d, panel="emb"):
    return S.collect({"emb": lambda: A.embeddings_panel(s, d), "wide": lambda: A.embeddings_panel(s, d, 64), "planted": lambda: planted(s, d), "li": lambda: scaled_lines(s, d, False)}[panel]())


def _labels(s, d, kind, panel="planted", **options):
    got = M.canonical(M.fit(_stats(s, d, panel), kind, 2, 2, **options))
    return got.assignments(s).join(got.responsibilities(s).where("k = 1").select("subject_id", F.col("p").alias("p_1")), "subject_id")


_FORMS = (
    ("fa_hard", "mfa", {}),
    ("fa_soft", "mfa", {"em": "soft"}),
    ("fa_hard_shrunk", "mfa", {"estep": "shrunk"}),
    ("pca_hard_em", "mpca", {"method": "EM"}),
    ("pca_hard_closed", "mpca", {"method": "closed_form"}),
    ("pca_soft", "mpca", {"em": "soft"}),
)
_LABELS_SQL = f"WITH {_TRUE} SELECT DISTINCT subject_id, z{{p}} FROM pl JOIN tr ON tr.odd = pl.subject_id % 2"
for _name, _kind, _options in _FORMS:
    query(f"mx_{_name}", _LABELS_SQL.format(p=", CAST(z = 1 AS DOUBLE) AS p_1"))(lambda s, d, k=_kind, o=_options: _labels(s, d, k, **o))
# Without a planted truth: the embeddings' subjects, over all their channels.
query("mx_fa_hard_wide")(lambda s, d: _labels(s, d, "mfa", "wide"))


def _parameters(s, d, kind, **options):
    """(k, channel, pi, mean, variance) of a fit; a closed form's variances sum to those of its cluster."""
    got = M.canonical(M.fit(_stats(s, d, "planted"), kind, 2, 2, **options))
    rows = [(k + 1, c, float(p), float(x.mean[j]), float(np.trace(x.cov))) for k, (p, x) in enumerate(zip(got.pi, got.components)) for j, c in enumerate(CHANNELS)]
    return s.createDataFrame(rows, "k int, channel string, pi double, mean double, variance double")


_CLUSTER = ", ".join(f"avg({c}) AS m_{c}" for c in CHANNELS) + ", " + " + ".join(f"var_pop({c})" for c in CHANNELS) + " AS v"
_PARAMS_SQL = f"WITH {_TRUE}, cl AS (SELECT subject_id % 2 AS odd, {_CLUSTER} FROM pl GROUP BY 1), al AS (SELECT z, n, sum(n) OVER () AS total, cl.* FROM cl JOIN tr USING (odd)) " + " UNION ALL ".join(f"SELECT z AS k, '{c}' AS channel, {r('n / total', 'pi')}, {r(f'm_{c}', 'mean')}{{v}} FROM al" for c in CHANNELS)
query("mx_fa_parameters", _PARAMS_SQL.format(v=""))(lambda s, d: _parameters(s, d, "mfa").drop("variance"))
query("mx_pca_parameters", _PARAMS_SQL.format(v=f", {r('v', 'variance')}"))(lambda s, d: _parameters(s, d, "mpca", method="closed_form"))
query("mx_fa_loadings")(lambda s, d: M.fit(_stats(s, d), "mfa", 2, 2).loadings(s))
def _distributed(s, d, **options):
    """(subject_id, z) of a distributed fit, clusters by size, then by smallest subject."""
    found = M.fit_distributed(planted(s, d), "mpca", 2, 2, **options)[1].select("subject_id", "z")
    order = found.groupBy("z").agg(F.count("*").alias("n"), F.min("subject_id").alias("low")).withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "low")))
    return found.join(F.broadcast(order), "z").select("subject_id", F.col("new").alias("z"))


for _em in ("hard", "soft"):
    query(f"mx_distributed{'' if _em == 'hard' else '_soft'}", _LABELS_SQL.format(p=""))(lambda s, d, e=_em: _distributed(s, d, em=e))
query("sel_grid_distributed", "SELECT 2 AS K")(lambda s, d: s.createDataFrame([(M.grid_distributed(planted(s, d), "mpca", (1, 2), (1,))[0]["K"],)], "K int"))


# Two channels have their eigenvalues in closed form, and with them the likelihood and the error of one principal axis.
_EIGEN = f"WITH {LS}, c AS (SELECT count(*) AS n, var_pop(qty) AS a, var_pop(price) AS b, covar_pop(qty, price) AS c FROM ls), e AS (SELECT n, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS v, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS w FROM c), l AS (SELECT n, w, -n / 2.0 * (2 * ln(2 * pi()) + ln(v) + ln(w) + 2) AS ll FROM e)"


@query("mx_single_pca", f"{_EIGEN} SELECT {r('ll / n', 'loglik_per_row')}, {r('(-2 * ll + 5 * ln(n)) / n', 'bic_per_row')}, {r('w', 'sse_per_row')} FROM l")
def _single_pca(s, d):
    p = scaled_lines(s, d, False)
    st = S.collect(A.Panel(p.df.select("subject_id", "qty", "price"), ("qty", "price")))
    x, n = B.single_pca(st, 1), float(st.n.sum())
    return s.createDataFrame([(x.loglik / n, x.bic / n, x.sse / n)], "loglik_per_row double, bic_per_row double, sse_per_row double")


@query("mx_vote", "WITH v AS (SELECT l_suppkey AS subject_id, CAST(l_linenumber % 3 AS INTEGER) AS z, l_discount AS distance FROM lineitem), g AS (SELECT subject_id, z, count(*) AS n, avg(distance) AS m FROM v GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, m, z) AS rk FROM g) SELECT subject_id, z FROM k WHERE rk = 1")
def _vote(s, d):
    return B.majority_frame(table(s, d, "lineitem").select(F.col("l_suppkey").alias("subject_id"), (F.col("l_linenumber") % 3).cast("int").alias("z"), F.col("l_discount").alias("distance")))


query("sel_k_bootstrap_planted", f"WITH {_TRUE} SELECT 2 AS K, 1.0::DOUBLE AS stability, CAST(count(DISTINCT subject_id) * (count(DISTINCT subject_id) - 1) / 2 AS BIGINT) AS n_pairs FROM pl")(
    lambda s, d: Q.stability(Q.bootstrap_draws(s, _stats(s, d, "planted"), "mpca", (2,), method="closed_form"))
)


def two_rank(s, d) -> A.Panel:
    """Four channels that two others make, but for a trace of noise: any right way finds two factors."""
    p = scaled_lines(s, d)
    noise = lambda salt: F.pmod(F.xxhash64("subject_id", "t", F.lit(salt)), F.lit(1000)) / 1000 - 0.5
    f, g = F.col("qty") - 0.51, (F.col("disc") - 0.5) / 1.1
    return p.with_df(p.df.select("subject_id", "t", f.alias("qty"), (f + 0.01 * noise(1)).alias("price"), g.alias("disc"), (g + 0.01 * noise(2)).alias("tax")), True)


def _of_two(s, d, **options):
    p = two_rank(s, d)
    if options.get("method") == "pa":  # rows alone, no subject's statistics
        return s.createDataFrame([(Q.parallel_analysis(p, range(1, 4))["r"],)], "r int")
    return s.createDataFrame([(int(Q.select_r(p, S.collect(p), "mfa", 1, range(1, 4), **options)["r"]),)], "r int")


for _name, _options in (("parallel_analysis", {"method": "pa"}), ("vaf", {"method": "vaf", "threshold": 0.9})):
    query(f"sel_r_{_name}", "SELECT 2 AS r")(lambda s, d, o=_options: _of_two(s, d, **o))
@query("ev_subspace_similarity")
def _similarity(s, d):
    got = M.fit(_stats(s, d), "mfa", 2, 2)
    rows = [(i + 1, j + 1, L.subspace_similarity(a.loadings, b.loadings)) for i, a in enumerate(got.components) for j, b in enumerate(got.components)]
    return s.createDataFrame(rows, "a int, b int, similarity double")


query("ev_rotated_loadings")(lambda s, d: E.align_signs(E.rotate(M.fit(_stats(s, d), "mfa", 2, 2))).loadings(s))


@query("ev_align_to_truth", f"WITH {_PLANTED} SELECT DISTINCT subject_id, CAST(subject_id % 2 + 1 AS INTEGER) AS z_true, CAST(subject_id % 2 + 1 AS INTEGER) AS z_aligned FROM pl")
def _aligned(s, d):
    st = _stats(s, d, "planted")
    truth = st.ids % 2 + 1
    back = E.align_to_truth(truth, M.fit(st, "mfa", 2, 2).z)
    return s.createDataFrame([(int(i), int(a), int(b)) for i, a, b in zip(st.ids, truth, back["z_aligned"])], "subject_id long, z_true int, z_aligned int")


@query("ev_sse_diagnostics", "WITH f AS (SELECT l_returnflag AS model, sum(l_extendedprice) AS loglik, min(l_discount) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag AS model, l_suppkey AS z, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT f.model, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_empty, CAST(sum(CASE WHEN n < 0.05 * 4000 THEN 1 ELSE 0 END) AS BIGINT) AS n_small, any_value(loglik IS NULL OR isinf(loglik)) AS loglik_bad, any_value(lo < 0.01 OR hi > 100) AS noise_odd FROM f JOIN z ON f.model = z.model GROUP BY 1")
def _diagnostics(s, d):
    li = table(s, d, "lineitem").withColumn("model", F.col("l_returnflag"))
    fits = li.groupBy("model").agg(F.sum("l_extendedprice").alias("loglik"), F.min("l_discount").alias("min_noise"), F.max("l_quantity").alias("max_noise"))
    return E.sse_diagnostics(fits, li.groupBy("model", F.col("l_suppkey").alias("z")).agg(F.count("*").alias("n")), 4000)


query("ev_vaf_sse_correlation", f"WITH v AS (SELECT 1 - avg(l_tax) AS vaf, avg(l_discount) AS sse FROM lineitem GROUP BY l_suppkey) SELECT {r('corr(vaf, sse)', 'corr')}, coalesce(corr(vaf, sse) <= -0.9, true) AS ok FROM v")(
    lambda s, d: E.vaf_sse_correlation(table(s, d, "lineitem").groupBy("l_suppkey").agg((1 - F.avg("l_tax")).alias("vaf"), F.avg("l_discount").alias("sse")))
)


# What else has a truth in SQL.
query("mx_kmeans_start", _LABELS_SQL.format(p=""))(lambda s, d: _start_labels(s, d))


def _start_labels(s, d):
    """(subject_id, z) of k-means over subjects' features, clusters by size, then by smallest subject."""
    st = _stats(s, d, "planted")
    z = M.kmeans_start(st, 2, 2)
    order = sorted(set(z), key=lambda k: (-(z == k).sum(), st.ids[z == k].min()))
    return s.createDataFrame([(int(i), order.index(k) + 1) for i, k in zip(st.ids, z)], "subject_id long, z int")


_SINGLE = fixed("mfa").components[0]
query("pj_scores_single_fa", f"WITH {LS} SELECT subject_id, t, {', '.join(r(x, f'f_{j + 1}') for j, x in enumerate(linear_sql(P.regression_scorer(_SINGLE), _SINGLE.mean)))} FROM ls")(
    lambda s, d: scaled_lines(s, d).df.select("subject_id", "t", *(x.alias(f"f_{j + 1}") for j, x in enumerate(P.linear(CHANNELS, P.regression_scorer(_SINGLE), _SINGLE.mean))))
)


def _with_parity(s, d, kind):
    st = S.collect(scaled_lines(s, d, False))
    return st, replace(fixed(kind), ids=st.ids, z=st.ids % 2 + 1)


for _kind in ("mfa", "mpca"):
    query(f"pj_reconstruction_error_{_kind}", f"{_Z} SELECT {r(f'sum({_squares(_kind)})', 'sse')}, {r(f'sqrt(sum({_squares(_kind)}) / (4 * count(*)))', 'rmse')} FROM zz")(
        lambda s, d, k=_kind: s.createDataFrame([tuple(P.reconstruction_error(*_with_parity(s, d, k), metric) for metric in ("sse", "rmse"))], "sse double, rmse double")
    )
    query(f"ic_loglik_held_out_{_kind}", f"{_joint_sql(_kind).replace(' + 1e-16)', ')')}, m AS (SELECT subject_id, k, v, max(v) OVER (PARTITION BY subject_id) AS top FROM j), l AS (SELECT max(top) + ln(sum(exp(v - top))) AS lse FROM m GROUP BY subject_id) SELECT {r('sum(lse)', 'loglik')} FROM l")(
        lambda s, d, k=_kind: s.createDataFrame([(C.loglik(*_with_parity(s, d, k), held_out=True),)], "loglik double")
    )


def _checked(n: int) -> list[tuple[str, int, bool]]:
    """What the argument checks let pass, for a panel of n subjects."""
    from strandmix.functions import checks

    def passes(call) -> bool:
        try:
            call()
        except ValueError:
            return False
        return True

    fit = fixed("mfa")
    calls = {
        "model_type MFA": lambda: checks.model_type("MFA"),
        "model_type other": lambda: checks.model_type("other"),
        "params 2 2": lambda: checks.model_params(2, 2),
        "params 0 2": lambda: checks.model_params(0, 2),
        "params 2 1.5": lambda: checks.model_params(2, 1.5),
        "params tol 0": lambda: checks.model_params(2, 2, tol=0),
        "more clusters than subjects": lambda: checks.fits_data(n + 1, n, 2, 8),
        "as many clusters as subjects": lambda: checks.fits_data(n, n, 2, 8),
        "9 factors of 8 channels": lambda: checks.fits_data(2, n, 9, 8),
        "fit": lambda: checks.fit_object(fit, "mfa", ("pi",)),
        "fit without components": lambda: checks.fit_object(replace(fit, components=())),
        "no fit": lambda: checks.fit_object({}),
        "fit that lacks a field": lambda: checks.fit_object(fit, required=("nothing",)),
    }
    return [(name, n, passes(call)) for name, call in calls.items()]


_PASS = {"model_type MFA", "params 2 2", "as many clusters as subjects", "fit"}
query("ck_arguments", "SELECT check_name, n, passes FROM (SELECT count(*) AS n FROM supplier), (VALUES " + ", ".join(f"('{name}', {str(name in _PASS).lower()})" for name, _, _ in _checked(4)) + ") t(check_name, passes)")(
    lambda s, d: s.createDataFrame(_checked(table(s, d, "supplier").count()), "check_name string, n long, passes boolean")
)
query("ck_renamed_arguments", "SELECT unnest(['iter_fa', 'kmeans_rdim', 'tol']) AS argument, unnest([max(l_linenumber), min(l_linenumber), count(DISTINCT l_returnflag)])::INTEGER AS value FROM lineitem")(
    lambda s, d: s.createDataFrame(sorted(_renamed(*table(s, d, "lineitem").agg(F.max("l_linenumber"), F.min("l_linenumber"), F.count_distinct("l_returnflag")).first()).items()), "argument string, value int")
)


def _renamed(rounds: int, dims: int, tol: int) -> dict:
    import warnings

    from strandmix.functions import checks

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        return checks.renamed({"nIterFA": rounds, "subject_rdim_for_kmeans": dims, "tol": tol})


for _name, _options in (("cv", {"method": "cv"}), ("global_first", {"scope": "global-first"}), ("vss", {"method": "vss", "threshold": 0.9}), ("multicriteria", {"method": "multicriteria"})):
    query(f"sel_r_{_name}_of_two", "SELECT 2 AS r")(lambda s, d, o=_options: _of_two(s, d, **o))
