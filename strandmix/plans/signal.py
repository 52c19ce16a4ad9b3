"""Queries over preprocessing and per-subject statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmix.operators import preprocess as P
from strandmix.operators import suffstats as S
from strandmix.plans.filter_sql import both_ways_sql, run_sql
from strandmix.plans.registry import CHANNELS, EV, LI, LS, query, r, table
from strandmix.sources import panel as A


def scaled_lines(spark, sf_dir, ordered=True) -> A.Panel:
    """The supplier panel with channels of about unit size."""
    p = A.lines_panel(spark, sf_dir, ordered)
    size = {"qty": F.col("qty") / 50, "price": F.col("price") / 99991, "disc": F.col("disc") * 10, "tax": F.col("tax") * 10}
    return p.with_df(p.df.withColumns(size), True)


def events(spark, sf_dir) -> A.Panel:
    """The event panel, times the factor of its SQL."""
    p = A.events_panel(spark, sf_dir)
    return p.with_df(p.df.withColumn("x", F.col("x") * 1.0123457), True)


def _ev(name: str, expression: str, make, extra: str = ""):
    query(name, f"WITH {EV}{extra} SELECT ev.subject_id, t, {r(expression, 'x')} FROM ev")(lambda s, d: make(events(s, d)).df.select("subject_id", "t", "x"))


_OVER = "OVER (PARTITION BY subject_id)"
_NEAR = "OVER (PARTITION BY subject_id ORDER BY t ROWS BETWEEN {} AND {})"
_ev("pp_dc_mean", f"x - avg(x) {_OVER}", lambda p: P.remove_offset(p, "mean"))
_ev("pp_dc_median", f"x - median(x) {_OVER}", lambda p: P.remove_offset(p, "median"))
_ev("pp_dc_linear", f"x - (regr_intercept(x, t) {_OVER} + regr_slope(x, t) {_OVER} * t)", lambda p: P.remove_offset(p, "linear"))
_ev("pp_dc_poly1", f"x - (regr_intercept(x, t) {_OVER} + regr_slope(x, t) {_OVER} * t)", lambda p: P.remove_offset(p, "polynomial", 1))
_ev("pp_rectify_full", "abs(x)", lambda p: P.rectify(p, "full_wave"))
_ev("pp_rectify_half", "greatest(x - 50, 0.0)", lambda p: P.rectify(p.with_df(p.df.withColumn("x", F.col("x") - 50)), "half_wave"))
# At 100 rows a second, 50 ms are 5 rows and 60 ms are 6.
_ev("pp_envelope_rms", f"sqrt(avg(x * x) {_NEAR.format('2 PRECEDING', '2 FOLLOWING')})", lambda p: P.envelope_rms(p, 50, 100))
_ev("pp_envelope_ma", f"CASE WHEN count(x) {_NEAR.format('2 PRECEDING', '3 FOLLOWING')} = 6 THEN avg(x) {_NEAR.format('2 PRECEDING', '3 FOLLOWING')} ELSE avg(x) {_NEAR.format('3 PRECEDING', '3 FOLLOWING')} END", lambda p: P.envelope_moving_average(p, 60, 100))
_ev("pp_norm_max", f"x / nullif(max(abs(x)) {_OVER}, 0)", lambda p: P.normalize(p, "max"))
_ev("pp_norm_mean", f"x / nullif(avg(abs(x)) {_OVER}, 0)", lambda p: P.normalize(p, "mean"))
_ev("pp_norm_median", f"x / nullif(median(abs(x)) {_OVER}, 0)", lambda p: P.normalize(p, "median"))
_ev("pp_norm_zscore", f"(x - avg(x) {_OVER}) / nullif(stddev_samp(x) {_OVER}, 0)", lambda p: P.normalize(p, "zscore"))
_ev("pp_norm_range", f"CASE WHEN max(x) {_OVER} = min(x) {_OVER} THEN 0 ELSE (x - min(x) {_OVER}) / (max(x) {_OVER} - min(x) {_OVER}) END", lambda p: P.normalize(p, "range"))


def _purchases(s, d):
    """The largest value of each user's purchases, as a reference; users without any have none."""
    bought = table(s, d, "events").where("event_type = 'purchase'")
    return bought.groupBy(F.col("user_id").alias("subject_id")).agg(F.max(F.abs(F.col("value") * 1.0123457)).alias("reference")).withColumn("channel", F.lit("x"))


query(
    "pp_norm_mvc",
    f"WITH {EV}, ref AS (SELECT user_id AS subject_id, max(abs(value * 1.0123457)) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) "
    f"SELECT ev.subject_id, t, {r(f'CASE WHEN coalesce(m, 0) <> 0 THEN 100 * x / m ELSE x / nullif(max(abs(x)) OVER (PARTITION BY ev.subject_id), 0) END', 'x')} FROM ev LEFT JOIN ref ON ev.subject_id = ref.subject_id",
)(lambda s, d: P.normalize(events(s, d), "mvc", _purchases(s, d)).df.select("subject_id", "t", "x"))

_poly2 = (
    f"WITH {EV}, u AS (SELECT subject_id, t, x, CASE WHEN n > 1 THEN (2.0 * t - n - 1) / (n - 1) ELSE 0 END AS u FROM (SELECT *, count(*) {_OVER} AS n FROM ev)), "
    "m AS (SELECT subject_id, CAST(count(*) AS DOUBLE) AS s0, sum(u) AS s1, sum(u**2) AS s2, sum(u**3) AS s3, sum(u**4) AS s4, sum(x) AS y0, sum(x*u) AS y1, sum(x*u*u) AS y2 FROM u GROUP BY 1), "
    "k AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM m), "
    "c AS (SELECT subject_id, (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2)) / det AS a0, (s0*(y1*s4-s3*y2) - y0*(s1*s4-s3*s2) + s2*(s1*y2-y1*s2)) / det AS a1, "
    "(s0*(s2*y2-y1*s3) - s1*(s1*y2-y1*s2) + y0*(s1*s3-s2*s2)) / det AS a2 FROM k) "
    f"SELECT u.subject_id, t, {r('x - (a0 + a1*u + a2*u*u)', 'x')} FROM u JOIN c ON u.subject_id = c.subject_id"
)
query("pp_dc_poly2", _poly2)(lambda s, d: P.remove_offset(events(s, d), "polynomial", 2).df.select("subject_id", "t", "x"))

_long = " UNION ALL ".join(f"SELECT subject_id, t, '{c}' AS channel, {c} AS v FROM li" for c in CHANNELS)
_pooled = {
    "max": ("max(abs(v)) AS a, 0 AS b", "{c} / nullif(a, 0)"),
    "mean": ("avg(abs(v)) AS a, 0 AS b", "{c} / nullif(a, 0)"),
    "median": ("median(abs(v)) AS a, 0 AS b", "{c} / nullif(a, 0)"),
    "zscore": ("avg(v) AS a, stddev_samp(v) AS b", "({c} - a) / nullif(b, 0)"),
    "range": ("min(v) AS a, max(v) AS b", "CASE WHEN a = b THEN 0 ELSE ({c} - a) / (b - a) END"),
}
for _method, (_stats, _value) in _pooled.items():
    query(
        f"pp_norm_{_method}_pooled",
        f"WITH {LI}, lo AS ({_long}), st AS (SELECT subject_id, {_stats} FROM lo GROUP BY 1) SELECT li.subject_id, t, {', '.join(r(_value.format(c=c), c) for c in CHANNELS)} FROM li JOIN st ON li.subject_id = st.subject_id",
    )(lambda s, d, m=_method: P.normalize_pooled(A.lines_panel(s, d), m).df.select("subject_id", "t", *CHANNELS))

query(
    "pp_norm_mvc_pooled",
    f"WITH {LS}, lo AS ({_long.replace('FROM li', 'FROM ls')}), st AS (SELECT subject_id, max(abs(v)) AS m FROM lo GROUP BY 1), ref AS (SELECT s_suppkey AS subject_id, s_acctbal / 997.123457 AS ref FROM supplier WHERE s_acctbal > 0) "
    f"SELECT ls.subject_id, t, {', '.join(r(f'CASE WHEN coalesce(ref, 0) <> 0 THEN 100 * {c} / ref ELSE {c} / nullif(m, 0) END', c) for c in CHANNELS)} FROM ls JOIN st ON ls.subject_id = st.subject_id LEFT JOIN ref ON ls.subject_id = ref.subject_id",
)(lambda s, d: P.normalize_pooled(scaled_lines(s, d), "mvc", table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("subject_id"), (F.col("s_acctbal") / 997.123457).alias("reference"))).df.select("subject_id", "t", *CHANNELS))

query("pp_mvc_peak", f"WITH {LI}, lo AS ({_long}) SELECT subject_id, channel, {r('max(abs(v))', 'reference')} FROM lo GROUP BY 1, 2")(lambda s, d: P.mvc_reference(A.lines_panel(s, d), "peak"))
query(
    "pp_mvc_mean_peak",
    f"WITH {LS}, lo AS ({_long.replace('FROM li', 'FROM ls')}), k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, channel ORDER BY abs(v) DESC) AS rk, count(*) OVER (PARTITION BY subject_id, channel) AS n FROM lo) "
    f"SELECT subject_id, channel, {r('avg(abs(v))', 'reference')} FROM k WHERE rk <= greatest(1, floor(n * 5 / 100)) GROUP BY 1, 2",
)(lambda s, d: P.mvc_reference(scaled_lines(s, d), "mean_peak"))
query(
    "pp_mvc_rms_peak",
    f"WITH {EV}, w AS (SELECT subject_id, count(x) OVER p AS n, sqrt(avg(x * x) OVER p) AS v FROM ev WINDOW p AS (PARTITION BY subject_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) "
    f"SELECT subject_id, 'x' AS channel, {r('max(CASE WHEN n = 10 THEN v END)', 'reference')} FROM w GROUP BY 1",
)(lambda s, d: P.mvc_reference(events(s, d), "rms_peak", 100, 100))
query(
    "pp_channel_summary",
    f"WITH {LI}, lo AS ({_long}) SELECT channel, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, {r('min(v)', 'min')}, {r('max(v)', 'max')} FROM lo GROUP BY 1",
)(lambda s, d: P.channel_summary(A.lines_panel(s, d, False)))
#: Decimals of filtered values: engines sum a filter's terms in other orders.
FILTERED = 4
_bp, _notched, _smooth, _gentle = P.bandpass_sections(1000), P.notch_sections(1000), P.lowpass_sections(1000, 6), P.lowpass_sections(1000, 4)
_first = "src AS (SELECT subject_id, t, x FROM ev)"


def _filtered(name: str, ctes: str, make) -> None:
    """A query with its SQL, whose CTEs end in one called ``done``."""
    query(name, f"WITH RECURSIVE {EV}, {ctes} SELECT subject_id, t, round(x, {FILTERED}) + 0.0 AS x FROM done")(lambda s, d: make(s, d).df.select("subject_id", "t", F.round("x", FILTERED).alias("x")))


_filtered("pp_bandpass", f"{_first}, {both_ways_sql('done', 'src', _bp)}", lambda s, d: P.bandpass(events(s, d), 1000))
for _kind in ("chebyshev1", "chebyshev2"):
    _filtered(f"pp_bandpass_{_kind}", f"{_first}, {both_ways_sql('done', 'src', P.bandpass_sections(1000, kind=_kind))}", lambda s, d, k=_kind: P.bandpass(events(s, d), 1000, kind=k))
_filtered("pp_bandpass_one_way", f"{_first}, one AS (SELECT subject_id, t AS p, x AS v FROM src), {run_sql('runs', 'one', _bp)}, done AS (SELECT subject_id, p AS t, y AS x FROM runs)", lambda s, d: P.bandpass(events(s, d), 1000, zero_phase=False))
_filtered("pp_notch", f"{_first}, {both_ways_sql('done', 'src', _notched)}", lambda s, d: P.notch(events(s, d), 1000, 50))
_filtered("pp_envelope_lowpass", f"{_first}, {both_ways_sql('done', 'src', _smooth)}", lambda s, d: P.envelope_lowpass(events(s, d), 1000))
_rest = "{bp}, {notch}, rect AS (SELECT subject_id, t, abs(x) AS x FROM nt), {env}"
_filtered(
    "pp_pipeline_default",
    f"src AS (SELECT subject_id, t, x - avg(x) {_OVER} AS x FROM ev), " + _rest.format(bp=both_ways_sql("bp", "src", _bp), notch=both_ways_sql("nt", "bp", _notched), env=both_ways_sql("en", "rect", _smooth)) + f", done AS (SELECT subject_id, t, x / nullif(max(abs(x)) {_OVER}, 0) AS x FROM en)",
    lambda s, d: P.preprocess(events(s, d), 1000, P.preset("default")).panel,
)
_filtered(
    "pp_pipeline_gait",
    f"src AS (SELECT subject_id, t, x - (regr_intercept(x, t) {_OVER} + regr_slope(x, t) {_OVER} * t) AS x FROM ev), "
    + _rest.format(bp=both_ways_sql("bp", "src", _bp), notch=both_ways_sql("nt", "bp", _notched), env=both_ways_sql("en", "rect", _gentle))
    + ", ref AS (SELECT subject_id, max(abs(x)) AS m FROM ev GROUP BY 1), done AS (SELECT en.subject_id, t, 100 * x / nullif(m, 0) AS x FROM en JOIN ref ON ref.subject_id = en.subject_id)",
    lambda s, d: P.preprocess(events(s, d), 1000, P.preset("gait"), P.mvc_reference(events(s, d))).panel,
)

_pairs = [(a, b) for k, a in enumerate(CHANNELS) for b in CHANNELS[k:]]
query(
    "ss_subject_moments",
    f"WITH {LS} SELECT subject_id, count(*) AS n, {', '.join(r(f'avg({c})', f'mean_{c}') for c in CHANNELS)}, {', '.join(r(f'covar_pop({a}, {b})', f'cov_{a}_{b}') for a, b in _pairs)} FROM ls GROUP BY 1",
)(lambda s, d: S.subject_moments(scaled_lines(s, d, False)))


def _named_moments(s, d):
    """The arrays of sums and products as columns by name."""
    m = S.moments(scaled_lines(s, d, False))
    return m.select("subject_id", "n", *(F.col("s")[k].alias(f"s_{c}") for k, c in enumerate(CHANNELS)), *(F.col("q")[k].alias(f"q_{a}_{b}") for k, (a, b) in enumerate(_pairs)))


query(
    "ss_sufficient_statistics",
    f"WITH {LS} SELECT subject_id, count(*) AS n, {', '.join(r(f'sum({c})', f's_{c}') for c in CHANNELS)}, {', '.join(r(f'sum({a} * {b})', f'q_{a}_{b}') for a, b in _pairs)} FROM ls WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CHANNELS)} GROUP BY 1",
)(_named_moments)
query(
    "ss_pooled_covariance",
    f"WITH {LS} " + " UNION ALL ".join(f"SELECT '{a}' AS row_channel, '{b}' AS col_channel, {r(f'covar_pop({a}, {b})', 'value')} FROM ls" for a, b in _pairs),
)(lambda s, d: S.pooled_covariance(scaled_lines(s, d, False)))
_cells = lambda f: " + ".join(f.format(c=c) for c in CHANNELS)
query("ss_sst_raw", f"WITH {LS} SELECT {r(_cells('sum({c} * {c})'), 'sst')} FROM ls")(lambda s, d: S.total_squares(scaled_lines(s, d, False), "raw"))
query("ss_sst_global", f"WITH {LS} SELECT {r(_cells('var_pop({c}) * count({c})'), 'sst')} FROM ls")(lambda s, d: S.total_squares(scaled_lines(s, d, False), "global"))


def parity(spark, sf_dir):
    """Clusters by the subject's parity."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject_id")).distinct().withColumn("z", (F.pmod("subject_id", F.lit(2)) + 1).cast("int"))


query("ss_sst_cluster", f"WITH {LS} SELECT CAST(subject_id % 2 + 1 AS INTEGER) AS z, count(*) AS n, {r(_cells('var_pop({c}) * count({c})'), 'sst')} FROM ls GROUP BY 1")(lambda s, d: S.total_squares(scaled_lines(s, d, False), "cluster", parity(s, d)))
query(
    "ss_mean_variance_features",
    f"WITH {LS} SELECT subject_id, {', '.join(r(f'avg({c})', f'mean_{c}') for c in CHANNELS)}, {', '.join(r(f'var_samp({c})', f'var_{c}') for c in CHANNELS)} FROM ls GROUP BY 1",
)(lambda s, d: S.mean_variance_features(scaled_lines(s, d, False)))
_second = "({c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w) AS {c}"
query(
    "ss_smoothness",
    f"WITH {LS}, dd AS (SELECT subject_id, {', '.join(_second.format(c=c) for c in CHANNELS)} FROM ls WINDOW w AS (PARTITION BY subject_id ORDER BY t)) SELECT subject_id, {r(_cells('coalesce(sum({c} * {c}), 0)'), 'penalty')} FROM dd GROUP BY 1",
)(lambda s, d: S.smoothness(scaled_lines(s, d)))
query("ss_panel_check", "SELECT user_id AS subject_id, count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM events GROUP BY 1")(lambda s, d: A.check_panel(events(s, d)))
