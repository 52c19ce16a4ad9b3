"""Queries over fits whose statistics stay on the cluster, against SQL that goes through the same rounds.

A probabilistic PCA of two channels with one factor is the full Gaussian of its cluster: noise is the smaller eigenvalue. So a round is a
few aggregates, and SQL can follow a fit from its first labels through its rounds, without a planted truth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmix.operators import choices as H
from strandmix.operators import evaluate as E
from strandmix.operators import fits as T
from strandmix.operators import selection as Q
from strandmix.operators import sweeps as W
from strandmix.operators import twostep as Two
from strandmix.plans.models import planted
from strandmix.plans.registry import LS, query, r
from strandmix.plans.signal import scaled_lines
from strandmix.sources import panel as A

ROUNDS, CHANNELS = 3, ("qty", "price")


def two_channels(s, d) -> A.Panel:
    """Quantity and price of each supplier's lines."""
    p = scaled_lines(s, d, False)
    return A.Panel(p.df.select("subject_id", *CHANNELS), CHANNELS)


_STATS = f"{LS}, st AS (SELECT subject_id, count(*) AS n, sum(qty) AS sx, sum(price) AS sy, sum(qty * qty) AS xx, sum(qty * price) AS xy, sum(price * price) AS yy FROM ls GROUP BY 1)"


def _joint(jitter: float, tiny: str, pi: str) -> str:
    """SQL: the joint log likelihood of a subject (st) under a cluster (its mean mx, my and covariance a, b, c)."""
    det = f"((a + {jitter}) * (c + {jitter}) - b * b)"
    quad = f"((c + {jitter}) * (xx - 2 * mx * sx + n * mx * mx) - 2 * b * (xy - mx * sy - my * sx + n * mx * my) + (a + {jitter}) * (yy - 2 * my * sy + n * my * my)) / {det}"
    return f"ln({pi} + {tiny}) - 0.5 * (n * (2 * ln(2 * pi()) + ln({det})) + {quad})"


def em_sql(name: str, k: int, rounds: int, em: str = "hard", weight: str = "1") -> str:
    """CTEs {name}_f (z, pi, mx, my, a, b, c): the fit after so many rounds from labels subject_id % K, subjects counted ``weight`` times."""
    out = [f"{name}_w AS (SELECT *, {weight} AS w FROM st)", f"{name}_l0 AS (SELECT *, subject_id % {k} AS z, CAST(w AS DOUBLE) AS p, {1 / k!r} AS pi FROM {name}_w WHERE w > 0)"]
    for i in range(1, rounds + 1):
        share = "any_value(pi)" if em == "hard" else f"sum(p) / (SELECT sum(w) FROM {name}_w)"
        out.append(f"{name}_q{i} AS (SELECT z, {share} AS pi, sum(p * n) AS nn, sum(p * sx) / sum(p * n) AS mx, sum(p * sy) / sum(p * n) AS my, sum(p * xx) / sum(p * n) AS ax, sum(p * xy) / sum(p * n) AS bx, sum(p * yy) / sum(p * n) AS cx FROM {name}_l{i - 1} GROUP BY z)")
        out.append(f"{name}_p{i} AS (SELECT z, pi, mx, my, ax - mx * mx AS a, bx - mx * my AS b, cx - my * my AS c FROM {name}_q{i})")
        out.append(f"{name}_j{i} AS (SELECT s.*, z, {_joint(1e-8, '1e-16', 'pi')} AS v FROM {name}_w s, {name}_p{i} WHERE w > 0)")
        if em == "hard":
            out.append(f"{name}_k{i} AS (SELECT * FROM {name}_j{i} QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY v DESC, z) = 1)")
            out.append(f"{name}_l{i} AS (SELECT subject_id, n, sx, sy, xx, xy, yy, w, z, CAST(w AS DOUBLE) AS p, sum(w) OVER (PARTITION BY z) / (SELECT sum(w) FROM {name}_w) AS pi FROM {name}_k{i})")
        else:
            out.append(f"{name}_t{i} AS (SELECT *, max(v) OVER (PARTITION BY subject_id) AS top FROM {name}_j{i})")
            out.append(f"{name}_l{i} AS (SELECT *, w * exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY subject_id) AS p FROM {name}_t{i})")
    last = f"SELECT {name}_p{rounds}.* REPLACE (coalesce(x.pi, 0) AS pi) FROM {name}_p{rounds} LEFT JOIN (SELECT z, any_value(pi) AS pi FROM {name}_l{rounds} GROUP BY z) x USING (z)" if em == "hard" else f"SELECT * FROM {name}_p{rounds}"
    return ", ".join([*out, f"{name}_f AS ({last})"])


def score_sql(name: str, subjects: str, tiny: str = "1e-16") -> str:
    """CTE {name}_s (subject_id, n, z, lse, p): the fit's mixture likelihood and responsibilities of each subject of a table."""
    return f"{name}_x AS (SELECT s.subject_id, s.n, z, {_joint(0.0, tiny, 'pi')} AS v FROM {subjects} s, {name}_f), {name}_y AS (SELECT *, max(v) OVER (PARTITION BY subject_id) AS top FROM {name}_x), {name}_z AS (SELECT *, top + ln(sum(exp(v - top)) OVER (PARTITION BY subject_id)) AS lse FROM {name}_y), {name}_s AS (SELECT subject_id, n, z, lse, exp(v - lse) AS p FROM {name}_z)"


def _spec(k: int, em: str = "hard", weight: T.Weight = T.ALL) -> T.Spec:
    return T.Spec("mpca", k, 1, "modulo", weight=weight, em=em, max_iter=ROUNDS, method="closed_form")


def _parameters(s, d, em: str):
    with T.statistics(two_channels(s, d)) as table:
        got = T.fit_many(table, [_spec(2, em)])[0]
        rows = [(k + 1, float(p), *map(float, c.mean), float(c.cov[0, 0]), float(c.cov[0, 1]), float(c.cov[1, 1]), got.loglik / table.rows, got.extra["entropy"] / table.subjects) for k, (p, c) in enumerate(zip(got.pi, got.components))]
    return s.createDataFrame(rows, "k int, pi double, mean_qty double, mean_price double, var_qty double, cov double, var_price double, loglik_per_row double, entropy double")


for _em in ("hard", "soft"):
    query(
        f"mx_rounds_{_em}",
        f"WITH {_STATS}, {em_sql('m', 2, ROUNDS, _em)}, {score_sql('m', 'st')}, t AS (SELECT sum(CASE WHEN z = 0 THEN lse END) / sum(CASE WHEN z = 0 THEN n END) AS ll, -sum((p + 1e-16) * ln(p + 1e-16)) / count(DISTINCT subject_id) AS e FROM m_s) "
        f"SELECT CAST(z + 1 AS INTEGER) AS k, {r('pi', 'pi')}, {r('mx', 'mean_qty')}, {r('my', 'mean_price')}, {r('a', 'var_qty')}, {r('b', 'cov')}, {r('c', 'var_price')}, {r('ll', 'loglik_per_row')}, {r('e', 'entropy')} FROM m_f, t",
    )(lambda s, d, e=_em: _parameters(s, d, e))


def _grid(s, d):
    with T.statistics(two_channels(s, d)) as table:
        rows = T.grid(table, "mpca", (1, 2, 3), (1,), use_kmeans=False, max_iter=ROUNDS, method="closed_form").summary
        return s.createDataFrame([(x["K"], x["logLik"] / table.rows, x["BIC"] / table.rows, x["entropy"] / table.subjects, x["ICL"] / table.rows) for x in rows], "K int, loglik double, bic double, entropy double, icl double")


def _grid_sql(k: int) -> str:
    return f"SELECT {k} AS K, sum(CASE WHEN z = 0 THEN lse END) AS ll, -sum((p + 1e-16) * ln(p + 1e-16)) AS e, {k} * (2 * 1 + 2 + 1) + {k} - 1 AS parameters FROM g{k}_s"


query(
    "sel_grid_rounds",
    f"WITH {_STATS}, {', '.join(em_sql(f'g{k}', k, ROUNDS) + ', ' + score_sql(f'g{k}', 'st') for k in (1, 2, 3))}, u AS ({' UNION ALL '.join(_grid_sql(k) for k in (1, 2, 3))}), t AS (SELECT sum(n) AS n, count(*) AS subjects FROM st) "
    f"SELECT CAST(K AS INTEGER) AS K, {r('ll / n', 'loglik')}, {r('(-2 * ll + parameters * ln(n)) / n', 'bic')}, {r('e / subjects', 'entropy')}, {r('(-2 * ll + parameters * ln(n) + 2 * e) / n', 'icl')} FROM u, t",
)(_grid)

FOLDS, SEED = 3, 11
_FOLD = f"({T.uniform_sql('subject_id', SEED, '0')} * {FOLDS} // {T.PRIME})"


def _cv_k(s, d):
    with T.statistics(two_channels(s, d)) as table:
        jobs = [(k, f) for k in (1, 2) for f in range(FOLDS)]
        found = T.fit_many(table, [_spec(k, weight=T.Weight("fold", SEED, f, folds=FOLDS)) for k, f in jobs])
        scored = T.evaluate(table, found, [T.Weight("inside", SEED, f, folds=FOLDS) for _, f in jobs], held_out=True)
    return s.createDataFrame([(k, f, e["loglik"] / e["rows"]) for (k, f), e in zip(jobs, scored)], "K int, fold int, score double")


_CV = [(k, f, f"c{k}_{f}") for k in (1, 2) for f in range(FOLDS)]
query(
    "sel_k_cv_rounds",
    f"WITH {_STATS}, {', '.join(f'h{f} AS (SELECT * FROM st WHERE {_FOLD} = {f})' for f in range(FOLDS))}, "
    + ", ".join(em_sql(n, k, ROUNDS, weight=f"CASE WHEN {_FOLD} = {f} THEN 0 ELSE 1 END") + ", " + score_sql(n, f"h{f}", "0") for k, f, n in _CV)
    + " "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS K, CAST({f} AS INTEGER) AS fold, {r('sum(lse) / sum(n)', 'score')} FROM (SELECT DISTINCT subject_id, n, lse FROM {n}_s)" for k, f, n in _CV),
)(_cv_k)


def _cv_r(s, d):
    with T.statistics(two_channels(s, d)) as table:
        return s.createDataFrame(T.cross_validate_r(table, (1,), "PPCA", FOLDS, seed=SEED), "r int, fold int, score double")


query(
    "sel_r_cv_folds",
    f"WITH {_STATS}, f AS (SELECT {_FOLD} AS fold, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM st GROUP BY 1), "
    "o AS (SELECT g.fold, sum(f.n) AS m, sum(f.sx) / sum(f.n) AS mx, sum(f.sy) / sum(f.n) AS my, sum(f.xx) / sum(f.n) AS ax, sum(f.xy) / sum(f.n) AS bx, sum(f.yy) / sum(f.n) AS cx FROM f, f g WHERE f.fold != g.fold GROUP BY 1), "
    f"p AS (SELECT f.*, mx, my, ax - mx * mx AS a, bx - mx * my AS b, cx - my * my AS c FROM f JOIN o USING (fold)) SELECT CAST(1 AS INTEGER) AS r, CAST(fold AS INTEGER) AS fold, {r(f'-({_joint(0.0, "0", "1")}) / n', 'score')} FROM p",
)(_cv_r)

DRAWS = 40
_DRAWN = f"dr AS (SELECT CAST(b AS INTEGER) AS b, st.*, {' + '.join(f'CASE WHEN u >= {x!r} THEN 1 ELSE 0 END' for x in T.POISSON)} AS w FROM (SELECT b, subject_id AS sid, CAST({T.uniform_sql('subject_id', SEED, 'b')} AS DOUBLE) / {T.PRIME} AS u FROM st, range(0, {DRAWS}) t(b)) JOIN st ON st.subject_id = sid)"


def _sums(s, d):
    with T.statistics(two_channels(s, d)) as table:
        found = T.draw_sums(table, [T.Weight("poisson", SEED, b) for b in range(DRAWS)])
        rows = [(b, int(round(n)), int(round(rows)), *((x + rows * c) / max(rows, 1) for x, c in zip(sums, table.centre.tolist()))) for b, (n, rows, *sums, _, _, _) in enumerate(v.tolist() for v in found)]
    return s.createDataFrame(rows, "b int, subjects long, n long, mean_qty double, mean_price double")


query("ev_bootstrap_sums", f"WITH {_STATS}, {_DRAWN} SELECT b, CAST(sum(w) AS BIGINT) AS subjects, CAST(sum(w * n) AS BIGINT) AS n, {r('sum(w * sx) / greatest(sum(w * n), 1)', 'mean_qty')}, {r('sum(w * sy) / greatest(sum(w * n), 1)', 'mean_price')} FROM dr GROUP BY b")(_sums)


def _axis(s, d):
    with T.statistics(two_channels(s, d)) as table:
        base = T.fit_best(table, [(1, 1)], "mpca", use_kmeans=False, method="closed_form")[0]
        rows = T.bootstrap_loadings(table, "mpca", 1, 1, DRAWS, SEED, base, method="closed_form")
    return E.bootstrap_summary(s.createDataFrame(rows, "b long, k int, channel int, factor int, value double"))


#: The loading of one principal axis: its direction by the greater eigenvalue e, times the root of what it exceeds the other one by; signed like the axis of all.
_AXIS = "sqrt(greatest((a + c) / 2 + g - ((a + c) / 2 - g), 1e-12))"
query(
    "ev_bootstrap_ci_axis",
    f"WITH {_STATS}, {_DRAWN}, al AS (SELECT b, w, n, sx, sy, xx, xy, yy FROM dr WHERE w > 0 UNION ALL SELECT -1, 1, n, sx, sy, xx, xy, yy FROM st), q AS (SELECT b, sum(w * sx) / sum(w * n) AS mx, sum(w * sy) / sum(w * n) AS my, sum(w * xx) / sum(w * n) AS ax, sum(w * xy) / sum(w * n) AS bx, sum(w * yy) / sum(w * n) AS cx FROM al GROUP BY b), "
    "v AS (SELECT b, ax - mx * mx AS a, bx - mx * my AS o, cx - my * my AS c FROM q), e AS (SELECT *, sqrt(((a - c) / 2) ** 2 + o * o) AS g FROM v), "
    f"u AS (SELECT b, CASE WHEN abs(o) > 0 THEN o ELSE 1 END AS x, (a + c) / 2 + g - a AS y, {_AXIS} AS l FROM e), w2 AS (SELECT b, l * x / sqrt(x * x + y * y) AS x, l * y / sqrt(x * x + y * y) AS y FROM u), "
    "ref AS (SELECT CASE WHEN abs(x) > abs(y) THEN sign(x) ELSE sign(y) END * x AS rx, CASE WHEN abs(x) > abs(y) THEN sign(x) ELSE sign(y) END * y AS ry FROM w2 WHERE b = -1), "
    "sg AS (SELECT b, CASE WHEN x * rx + y * ry < 0 THEN -x ELSE x END AS x, CASE WHEN x * rx + y * ry < 0 THEN -y ELSE y END AS y FROM w2, ref WHERE b >= 0), lo AS (SELECT 1 AS channel, x AS value FROM sg UNION ALL SELECT 2, y FROM sg) "
    f"SELECT CAST(1 AS INTEGER) AS k, CAST(channel AS INTEGER) AS channel, CAST(1 AS INTEGER) AS factor, {r('median(value)', 'median')}, {r('quantile_cont(value, 0.025)', 'lower')}, {r('quantile_cont(value, 0.975)', 'upper')}, {r('stddev_samp(value)', 'sd')}, count(*) AS n_boot FROM lo GROUP BY channel",
)(_axis)


def _stability(s, d):
    with T.statistics(two_channels(s, d)) as table:
        draws = T.subsample_draws(table, "mpca", (2, 3), 1, 10, seed=SEED, method="closed_form")
        return s.createDataFrame(Q.stability(draws).collect(), "K int, stability double, n_pairs long")


_PART = f"pd AS (SELECT CAST(b AS INTEGER) AS b, subject_id FROM st, range(0, 10) t(b) WHERE CAST({T.uniform_sql('subject_id', SEED, 'b')} AS DOUBLE) / {T.PRIME} < 0.8)"
query(
    "sel_k_draws_joint",
    f"WITH {_STATS}, {_PART}, pr AS (SELECT x.subject_id AS i, y.subject_id AS j, count(*) AS n FROM pd x JOIN pd y ON x.b = y.b AND x.subject_id < y.subject_id GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS K, (SELECT count(*) FROM pr WHERE n >= 5) AS n_pairs FROM range(2, 4) t(k)",
)(lambda s, d: _stability(s, d).select("K", "n_pairs"))


def two_shapes(s, d) -> A.Panel:
    """Suppliers with odd numbers move their first two channels together, the others their last two."""
    p = scaled_lines(s, d, False)
    odd, noise = F.pmod("subject_id", F.lit(2)) == 1, F.pmod(F.xxhash64("qty", "disc", "subject_id"), F.lit(1000)) / 5000.0
    return p.with_df(p.df.withColumns({"price": F.when(odd, F.col("qty") + noise).otherwise(F.col("price")), "tax": F.when(odd, F.col("tax")).otherwise(F.col("disc") + noise)}))


_SHAPES = f"{LS}, sz AS (SELECT subject_id % 2 AS odd, count(DISTINCT subject_id) AS n, min(subject_id) AS low FROM ls GROUP BY 1), tr AS (SELECT odd, CAST(row_number() OVER (ORDER BY n DESC, low) AS INTEGER) AS z FROM sz)"


@query("mx_two_step", f"WITH {_SHAPES} SELECT DISTINCT subject_id, z FROM ls JOIN tr ON tr.odd = ls.subject_id % 2")
def _two_step(s, d):
    with T.statistics(two_shapes(s, d)) as table:
        found = Two.two_step(table, 1, 2).assignments
        order = found.groupBy("z").agg(F.count("*").alias("n"), F.min("subject_id").alias("low")).orderBy(F.desc("n"), "low").collect()
    return found.join(F.broadcast(s.createDataFrame([(r.z, k + 1) for k, r in enumerate(order)], "z int, new int")), "z").select("subject_id", F.col("new").alias("z"))


def flagship(s, sf_dir):
    """Cluster the embedding panel over all its components, and summarise each cluster's reconstruction."""
    df = s.read.parquet(f"{sf_dir}/embeddings.parquet")
    width = len(df.select("embedding").first()[0])
    p = A.bind_unordered(df, "label", {f"ch_{k + 1}": df["embedding"][k] for k in range(width)})
    with T.statistics(p) as table:
        got = T.canonical(table, T.fit_best(table, [(2, 2)], "mfa", use_kmeans=False)[0])
        return s.createDataFrame(T.summarize(table, got), "z int, sse double, n long, sse_per_row double, vaf double")


query("flagship")(flagship)


def _panel_of(s, d) -> A.Panel:
    return scaled_lines(s, d, False)


@query("sel_grid_bic")
def _grid_bic(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        return T.grid(table, "mfa", range(1, 4), range(1, 4), max_iter=20).frame(s)


@query("sel_twostage_icl")
def _two_stage(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        return T.two_stage(table, "mpca", range(1, 4), range(1, 4), method="closed_form", max_iter=20).frame(s)


@query("sel_posthoc")
def _posthoc(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        return T.evaluation(T.grid(table, "mpca", range(1, 4), range(1, 3), method="closed_form", max_iter=20), s)


@query("sel_k_bootstrap")
def _k_bootstrap(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        found = Q.stability(T.subsample_draws(table, "mpca", (2, 3, 4), n_boot=20, method="closed_form", max_iter=20)).collect()
    return s.createDataFrame(found, "K int, stability double, n_pairs long")


@query("sel_k_cv")
def _k_cv(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        rows = T.cross_validate_k(table, "mpca", (2, 3, 4), method="closed_form", max_iter=20)
    return Q.one_se_rule(s.createDataFrame(rows, "K int, fold int, score double"), "K", "score")


@query("sel_r_cv")
def _r_cv(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        rows = T.cross_validate_r(table, range(1, 4), "FA")
    return Q.one_se_rule(s.createDataFrame(rows, "r int, fold int, score double"), "r", "score", higher=False)


@query("ev_bootstrap_ci")
def _bootstrap_ci(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        rows = T.bootstrap_loadings(table, "mpca", 2, 2, 100, method="closed_form", max_iter=20)
    return E.bootstrap_summary(s.createDataFrame(rows, "b long, k int, channel int, factor int, value double"))


def _chosen(s, d, **options):
    p = scaled_lines(s, d)
    with T.statistics(p) as table:
        return s.createDataFrame([(H.select_r(p, table, "mfa", 2, range(1, 4), **options)["r"],)], "r int")


for _name, _options in (("vss", {"method": "vss", "threshold": 0.3}), ("clusterwise", {"scope": "clusterwise"}), ("hybrid", {"scope": "hybrid"}), ("smoothness", {"method": "smoothness", "threshold": 0.3})):
    query(f"sel_r_{_name}")(lambda s, d, o=_options: _chosen(s, d, **o))


@query("mx_single_models")
def _single_models(s, d):
    with T.statistics(_panel_of(s, d)) as table:
        return s.createDataFrame([(x.kind, x.loglik, x.bic, x.sse) for x in H.singles(table)], "kind string, loglik double, bic double, sse double")


@query("mx_compare_methods")
def _compare(s, d):
    with T.statistics(two_shapes(s, d)) as table:
        rows = H.compare_all(table, 2, 1, max_iter=20)
    return s.createDataFrame([(x["Method"], x["BIC"], x["SSE"], x["VAF"]) for x in rows], "Method string, BIC double, SSE double, VAF double")


def _truth(s, d):
    """ARI of each method that clusters, on panels whose two kinds of subjects differ in shape."""
    p = two_shapes(s, d)
    truth = p.df.select("subject_id", (F.pmod("subject_id", F.lit(2)) + 1).cast("int").alias("z_true")).distinct()
    with T.statistics(p) as table:
        rows = H.compare_all(table, 2, 1, truth, max_iter=20)
    return s.createDataFrame([(x["Method"], x["ARI"]) for x in rows if x["ARI"] is not None], "Method string, ari double")


query("mx_compare_ari", "SELECT * FROM (VALUES ('TwoStep_FA', 1.0::DOUBLE), ('TwoStep_PCA', 1.0::DOUBLE), ('MixtureFA', 1.0::DOUBLE), ('MixturePCA', 1.0::DOUBLE)) t(Method, ari)")(_truth)


# Experiments on the given panel, with the suppliers of odd numbers moved: two clusters.
_TOLD = "(VALUES ('mfa'), ('mpca')) m(method), (VALUES ('grid'), ('twostage')) st(selection_strategy)"
_SUBJECTS = "n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)"


def _modelsel(s, d, mode: str, columns: list[str], panel=None):
    with T.statistics(panel or planted(s, d)) as table:
        rows = H.modelsel_rows(table, {"K": 2, "r": 1}, mode, (1, 2), (1, 2), method="closed_form", max_iter=10)
    kinds = dict(x.split() for x in W.MODELSEL_SCHEMA.split(", "))
    return s.createDataFrame([tuple(x.get(c) for c in columns) for x in rows], ", ".join(f"{c} {kinds[c]}" for c in columns))


_FREE = ["method", "selection_strategy", "mode", "r_mode", "N", "K_true", "r_true", "K_hat", "r_hat", "K_correct", "r_correct", "Kr_correct", "VAF", "logLik", "BIC"]
query("sw_modelsel")(lambda s, d: _modelsel(s, d, "modelsel", _FREE))
query(
    "sw_modelsel_oracle_kr",
    f"WITH {_SUBJECTS} SELECT method, selection_strategy, 'oracle_Kr' AS mode, 'oracle' AS r_mode, CAST(n AS INTEGER) AS N, 2 AS K_true, 1 AS r_true, 2 AS K_hat, 1 AS r_hat, true AS K_correct, true AS r_correct, true AS Kr_correct FROM n, {_TOLD}",
)(lambda s, d: _modelsel(s, d, "oracle_Kr", _FREE[:-3]))
query(
    "sw_modelsel_oracle_r",
    f"WITH {_SUBJECTS} SELECT method, selection_strategy, 'oracle_r' AS mode, 'oracle' AS r_mode, CAST(n AS INTEGER) AS N, 2 AS K_true, 1 AS r_true, 2 AS K_hat, 1 AS r_hat, true AS K_correct, true AS r_correct, true AS Kr_correct FROM n, {_TOLD}",
)(lambda s, d: _modelsel(s, d, "oracle_r", _FREE[:-3]))


@query(
    "sw_finish_modelsel",
    f"WITH {_SUBJECTS} SELECT CAST(n AS INTEGER) AS N, 2 AS K_true, 1 AS r_true, method, selection_strategy, 1.0::DOUBLE AS K_correct_rate, 1.0::DOUBLE AS r_correct_rate, 1.0::DOUBLE AS Kr_correct_rate, CAST(2 AS BIGINT) AS n_reps, CAST(0 AS BIGINT) AS n_errors FROM n, {_TOLD}",
)
def _finish(s, d):
    """Two repetitions: the panel, and its first half of each series."""
    whole = planted(s, d)
    half = whole.with_df(whole.df.where(F.pmod(F.xxhash64(*CHANNELS), F.lit(2)) == 0))
    names = [x.split()[0] for x in W.MODELSEL_SCHEMA.split(", ")]
    raw = _modelsel(s, d, "oracle_r", names, whole).unionByName(_modelsel(s, d, "oracle_r", names, half))
    return W.finish(raw)["aggregated"].select("N", "K_true", "r_true", "method", "selection_strategy", "K_correct_rate", "r_correct_rate", "Kr_correct_rate", "n_reps", "n_errors")


@query("sw_baselines")
def _baselines(s, d):
    with T.statistics(planted(s, d)) as table:
        cells = [(k, r) for k in (2, 3) for r in (1, 2)]
        rows = [(k, r, x["Method"], x["BIC"], x["SSE"], x["VAF"]) for (k, r), found in zip(cells, H.compare_cells(table, cells, max_iter=10)) for x in found]
    return s.createDataFrame(rows, "K int, r int, Method string, BIC double, SSE double, VAF double")


@query("sw_kselect")
def _kselect(s, d):
    with T.statistics(planted(s, d)) as table:
        rows = H.kselect_rows(table, 2, (2, 3, 4), 1, max_iter=20)
    return s.createDataFrame([(x["method"], x["K_hat"], x["K_correct"]) for x in rows], "method string, K_hat int, K_correct boolean")
