"""Fits over statistics on the cluster: like those in memory from the same labels, draws like their SQL, folds like plain ones."""

import duckdb
import numpy as np
import pytest

from strandmix.operators import criteria as C
from strandmix.operators import evaluate as E
from strandmix.operators import fits as T
from strandmix.operators import mixture as M
from strandmix.operators import selection as Q
from strandmix.operators import suffstats as S
from strandmix.sources.panel import Panel
from strandmix.sources.simulate import Design, arrays


@pytest.fixture(scope="module")
def data():
    series, truth, _ = arrays(Design(40, 3, 2, 5, 60, seed=4))
    return series, np.asarray(truth)


@pytest.fixture(scope="module")
def panel(spark, data):
    rows = [(i + 1, t + 1, *map(float, x)) for i, y in enumerate(data[0]) for t, x in enumerate(y)]
    names = tuple(f"c{j}" for j in range(5))
    return Panel(spark.createDataFrame(rows, "subject_id long, t int, " + ", ".join(f"{n} double" for n in names)).repartition(5).persist(), names)


@pytest.fixture(scope="module")
def stats(panel):
    return S.collect(panel)


@pytest.fixture(scope="module")
def table(panel):
    with T.statistics(panel) as found:
        yield found


def same(got, want, tol=1e-8):
    assert got.rounds == want.rounds and got.loglik == pytest.approx(want.loglik, abs=1e-6, rel=1e-11)
    assert np.allclose(got.pi, want.pi, atol=tol)
    for a, b in zip(got.components, want.components):
        assert np.allclose(a.mean, b.mean, atol=tol) and np.allclose(a.cov, b.cov, atol=tol)


FORMS = [("mfa", {}), ("mfa", {"em": "soft"}), ("mfa", {"estep": "shrunk"}), ("mpca", {"method": "EM"}), ("mpca", {"method": "closed_form"}), ("mpca", {"em": "soft", "method": "closed_form"})]


@pytest.mark.parametrize("kind,options", FORMS)
def test_like_fits_in_memory(table, stats, kind, options):
    """25 cells in the rounds of one, from random labels and round robin, each like its fit in memory."""
    specs = [T.Spec(kind, k, r, start, seed=k + r, max_iter=12, **options) for k in (1, 2, 3, 4) for r in (1, 2, 3) for start in ("hash", "modulo")]
    seen = []
    for spec, got in zip(specs, T.fit_many(table, specs, lambda n, ll: seen.append((n, len(ll))))):
        z = T.hash_labels(stats.ids, spec.k, spec.seed) if spec.start == "hash" else stats.ids % spec.k
        want = M.fit_once(stats, kind, spec.k, spec.r, z, max_iter=12, **options)
        same(got, want)
        assert got.extra["entropy"] == pytest.approx(C.entropy(want.resp), abs=1e-6)
        assert got.extra["sizes"] == [int((want.z == k + 1).sum()) for k in range(spec.k)]
    assert [n for n, _ in seen] == list(range(1, len(seen) + 1)) and len(seen) <= 12 and seen[0][1] == len(specs) >= seen[-1][1]


def test_jobs_do_not_grow_with_the_models(spark, table):
    def jobs(specs):
        spark.sparkContext.setJobGroup(f"fits {len(specs)}", "x")
        T.fit_many(table, specs)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits {len(specs)}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    specs = [T.Spec("mpca", k, r, "hash", seed=s, max_iter=6, tol=1e-300, method="closed_form") for k in (2, 3, 4, 5) for r in (1, 2, 3) for s in range(3)]
    assert jobs(specs) <= jobs(specs[:1]) + 2 * 6


def test_kmeans_starts_like_those_in_memory(table, stats, monkeypatch):
    for seed in range(3):
        found = T.kmeans_many(table, [T.Spec("mfa", k, 2, seed=seed) for k in (1, 2, 3)])
        for k, one in zip((1, 2, 3), found):
            x = np.column_stack([stats.n, stats.s, stats.q[:, *np.triu_indices(5)]])
            assert E.ari(one.hard(stats.ids, x, None), M.kmeans_start(stats, k, 2, seed)) == 1
    monkeypatch.setattr(T, "SAMPLE", 12)  # most subjects are met in rounds over all
    one = T.kmeans_many(table, [T.Spec("mfa", 3, 2, seed=1)])[0]
    x = np.column_stack([stats.n, stats.s, stats.q[:, *np.triu_indices(5)]])
    z, f = one.hard(stats.ids, x, None), M.pca_features(stats, 2)
    centres = np.stack([f[z == k].mean(axis=0) for k in range(3)])
    assert (((f[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == z).all()


def test_best_of_starts_and_assignments(panel, stats, data):
    fit, labels = T.fit_panel(panel, "mfa", 3, 2, n_init=2)
    rows = {r.subject_id: r for r in labels.collect()}
    assert E.ari(data[1], np.array([rows[i].z for i in stats.ids])) == 1
    assert fit.loglik >= M.fit(stats, "mfa", 3, 2).loglik - 1e-6
    own = replace_labels(fit, stats, rows)
    assert C.loglik(stats, own) == pytest.approx(fit.loglik, abs=1e-6)
    with T.statistics(panel) as table:
        p = {(r.subject_id, r.k): r.p for r in T.responsibilities(table, fit).collect()}
    joint = M._log_joint(stats, fit.components, fit.pi)
    assert np.allclose([[p[i, k + 1] for k in range(3)] for i in stats.ids], M._posterior(joint)[0])


def replace_labels(fit, stats, rows):
    from dataclasses import replace

    return replace(fit, ids=stats.ids, z=np.array([rows[i].z for i in stats.ids]))


def test_given_labels(spark, panel, stats):
    given = spark.createDataFrame([(int(i), int(i % 7 % 3 + 1)) for i in stats.ids], "subject_id long, z int")
    with T.statistics(panel, given) as table:
        got = T.fit_many(table, [T.Spec("mpca", 3, 2, "given")])[0]
    same(got, M.fit_once(stats, "mpca", 3, 2, stats.ids % 7 % 3))


def test_grid_and_two_stages(spark, table, stats, data):
    got = T.grid(table, "mpca", range(1, 5), range(1, 4), method="closed_form")
    assert got.best_k == 3 and len(got.summary) == 12
    for row in got.summary:
        fit = got.models[row["K"], row["r"]]
        assert row["BIC"] == pytest.approx(C.bic("mpca", C.loglik(stats, fit), row["K"], row["r"], 5, stats.n.sum()), abs=1e-5)
    two = T.two_stage(table, "mpca", range(1, 5), range(1, 4), method="closed_form")
    assert two.best_k == 3 and {x["stage"] for x in two.summary} == {"K", "r"} and two.best is two.models[3, two.best_r]
    sizes = T.evaluation(got, spark).where("K = 3").collect()
    assert all(r.min_size == min(np.bincount(data[1])[1:]) for r in sizes)
    with pytest.raises(ValueError):
        T.two_stage(table, "mfa", criterion="x")


def test_empty_and_too_small_panels(spark, panel):
    with T.statistics(panel.with_df(panel.df.where("subject_id < 0"))) as none, pytest.raises(ValueError):
        T.fit_many(none, [T.Spec("mfa", 1, 1)])
    with T.statistics(panel.with_df(panel.df.where("subject_id < 3"))) as two, pytest.raises(ValueError):
        T.fit_many(two, [T.Spec("mfa", 3, 1)])


# --- draws --------------------------------------------------------------------------------------------------------------------------


def test_draws_like_their_sql():
    ids = np.concatenate([np.arange(-50, 3000), [2**62, -(2**62), T.PRIME, T.PRIME + 5]])
    con = duckdb.connect()
    con.execute("CREATE TABLE s AS SELECT unnest(?::BIGINT[]) AS id", [ids.tolist()])
    for seed, b in ((0, 0), (1, 7), (12345, 199)):
        want = dict(con.execute(f"SELECT id, {T.uniform_sql('id', seed, str(b))} FROM s").fetchall())
        assert T.uniform(ids, seed, b).tolist() == [want[int(i)] for i in ids]


def test_draws_are_fair():
    ids, draws = np.arange(1, 2001), range(200)
    counts = np.stack([T.Weight("poisson", 3, b).of(ids) for b in draws])
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert np.abs(np.corrcoef(counts)[np.triu_indices(200, 1)]).max() < 0.13  # draws have nothing to do with one another
    assert np.abs(np.corrcoef(counts[:, :200].T)[np.triu_indices(200, 1)]).max() < 0.45  # nor have subjects
    part = np.stack([T.Weight("part", 3, b, 0.8).of(ids) for b in draws])
    assert abs(part.mean() - 0.8) < 0.01
    folds = np.stack([T.Weight("inside", 5, f, folds=4).of(ids) for f in range(4)])
    assert (folds.sum(axis=0) == 1).all() and folds.sum(axis=1).min() > 400
    assert (T.Weight("fold", 5, 2, folds=4).of(ids) == 1 - folds[2]).all()


def test_weighted_fits_like_repeated_subjects(table, stats):
    weight = T.Weight("poisson", 9, 4)
    w = weight.of(stats.ids).astype(int)
    got = T.fit_many(table, [T.Spec("mfa", 2, 2, "modulo", weight=weight)])[0]
    picked = stats.pick(np.repeat(np.arange(len(stats)), w))
    same(got, M.fit_once(picked, "mfa", 2, 2, picked.ids % 2))


def test_bootstrap_intervals_hold_the_loadings(spark, table):
    base = T.fit_best(table, [(3, 2)], "mpca", method="closed_form")[0]
    rows = T.bootstrap_loadings(table, "mpca", 3, 2, n_boot=60, base=base, method="closed_form")
    assert len({x[0] for x in rows}) == 60 and len(rows) == 60 * 3 * 5 * 2
    found = E.bootstrap_summary(spark.createDataFrame(rows, "b long, k int, channel int, factor int, value double")).collect()
    inside = [r.lower - 1e-9 <= base.components[r.k - 1].loadings[r.channel - 1, r.factor - 1] <= r.upper + 1e-9 for r in found]
    assert np.mean(inside) > 0.8


def test_subsamples_for_stability(table):
    draws = T.subsample_draws(table, "mpca", (2, 3), n_boot=10, method="closed_form").persist()
    assert {(r.K, r.b) for r in draws.select("K", "b").distinct().collect()} == {(k, b) for k in (2, 3) for b in range(10)}
    for b in range(10):
        want = np.flatnonzero(T.Weight("part", 0, b, 0.8).of(np.arange(1, 41))) + 1
        assert sorted(r.subject_id for r in draws.where(f"b = {b} AND K = 2").collect()) == want.tolist()
    assert {r.K: round(r.stability, 6) for r in Q.stability(draws).collect()}[3] == 1.0


def test_folds_like_plain_ones(spark, table, stats):
    fold = np.array([next(f for f in range(4) if T.Weight("inside", 2, f, folds=4).of(np.array([i]))[0]) for i in stats.ids])
    rows = {(k, f): s for k, f, s in T.cross_validate_k(table, "mpca", (1, 3), folds=4, seed=2, method="closed_form")}
    for (k, f), got in rows.items():
        train, test = stats.pick(fold != f), stats.pick(fold == f)
        want = M.fit_once(train, "mpca", k, 2, M.kmeans_start(train, k, 2, 2), method="closed_form")
        assert got == pytest.approx(C.loglik(test, want, held_out=True) / test.n.sum(), rel=1e-6)
    assert len(rows) == 8 and min(rows[3, f] for f in range(4)) > max(rows[1, f] for f in range(4))
    from strandmix.functions import linalg as L

    for r, f, got in T.cross_validate_r(table, (1, 2), folds=4, seed=2):
        n, mean, cov = stats.pick(fold != f).pooled()
        c, test = L.fa_em(n, mean, cov, r, 50), stats.pick(fold == f)
        assert got == pytest.approx(-L.log_likelihoods(test.n, test.scatter(c.mean), c.cov).sum() / test.n.sum(), rel=1e-9)
    assert all(s > 0 for _, _, s in T.cross_validate_r(table, (1, 2), "PPCA", folds=3, metric="recon"))


def test_wide_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 30))
    rows = [(int(i % 7), *map(float, v)) for i, v in enumerate(x)]
    p = Panel(spark.createDataFrame(rows, "subject_id long, " + ", ".join(f"c{j} double" for j in range(30))).repartition(3), tuple(f"c{j}" for j in range(30)))
    st = S.collect(p)
    for i in range(7):
        own = x[np.arange(90) % 7 == i] - st.centre
        assert st.n[i] == len(own) and np.allclose(st.s[i], own.sum(axis=0)) and np.allclose(st.q[i], own.T @ own)
    with T.statistics(p) as table:
        same(T.fit_many(table, [T.Spec("mfa", 2, 3, "modulo", max_iter=6)])[0], M.fit_once(st, "mfa", 2, 3, st.ids % 2, max_iter=6), 1e-6)


# --- choices ------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def smooth(panel, stats):
    rows = {r[0]: r[1] for r in Q.difference_squares(panel).collect()}
    return S.upper_to_full(np.array([rows[int(i)] for i in stats.ids]), 5)


def test_clusters_stand_for_their_subjects(panel, table, stats, smooth):
    from strandmix.operators import choices as H
    from strandmix.operators import project as P

    fits = T.fit_best(table, [(3, 1), (3, 2), (2, 2)], "mfa")
    squares = H.smoothness(table, Q.difference_squares(panel), fits)
    for fit, (own, told), got in zip(fits, H.by_cluster(table, fits), squares):
        z = {r.subject_id: r.z for r in T.assignments(table, [fit]).collect()}
        whole = replace_labels(fit, stats, {i: type("R", (), {"z": k}) for i, k in z.items()})
        for kind in ("raw", "global", "cluster"):
            assert P.vaf(own, told, sst=kind) == pytest.approx(P.vaf(stats, whole, sst=kind), rel=1e-9)
        assert P.subject_sse(own, told).sum() == pytest.approx(P.subject_sse(stats, whole).sum(), rel=1e-9)
        assert got == pytest.approx(Q.smoothness(whole, smooth), rel=1e-9)


WAYS = [{"method": m} for m in ("bic", "vaf", "vss", "smoothness", "multicriteria", "cv")] + [{"scope": x} for x in ("clusterwise", "hybrid", "global-first")]


@pytest.mark.parametrize("way", WAYS, ids=lambda w: next(iter(w.values())))
def test_every_way_to_choose_r_like_in_memory(panel, table, stats, smooth, way):
    from strandmix.operators import choices as H

    got = H.select_r(panel, table, "mfa", 3, range(1, 4), threshold=0.5, **way)
    want = Q.select_r(panel, stats, "mfa", 3, range(1, 4), threshold=0.5, smooth=smooth if way.get("method") in ("smoothness", "multicriteria") else None, **way)
    assert got["r"] == want["r"]
    if "per_cluster" in got:
        assert sorted(got["per_cluster"].values()) == sorted(want["per_cluster"].values())


def test_six_methods_like_in_memory(spark, table, stats, data):
    from strandmix.operators import baselines as B
    from strandmix.operators import choices as H

    truth = spark.createDataFrame([(int(i), int(z)) for i, z in zip(stats.ids, data[1])], "subject_id long, z_true int")
    got, want = H.compare_all(table, 3, 2, truth), B.compare_all(stats, 3, 2, data[1])
    for a, b in zip(got, want):
        assert a["Method"] == b["Method"]
        for key in ("BIC", "SSE", "VAF", "ARI"):
            assert (a[key] is None) == (b[key] is None) and (a[key] is None or a[key] == pytest.approx(b[key], rel=1e-6)), (a["Method"], key)


def jobs_of(spark, name, run):
    """What ``run`` returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, "x")
    got = run()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, found


def test_cells_of_a_comparison_advance_together(spark, table, monkeypatch):
    """Four cells take about the jobs of one, in rounds over all subjects too, and give the rows that each gives alone."""
    from strandmix.operators import choices as H

    monkeypatch.setattr(T, "SAMPLE", 12)
    cells = [(2, 1), (2, 2), (3, 1), (3, 2)]
    alone = [jobs_of(spark, f"cell {cell}", lambda cell=cell: H.compare_all(table, *cell, max_iter=6)) for cell in cells]
    got, jobs = jobs_of(spark, "cells", lambda: H.compare_cells(table, cells, max_iter=6))
    assert jobs < 2 * max(n for _, n in alone) < sum(n for _, n in alone)
    for rows, (want, _) in zip(got, alone):
        for a, b in zip(rows, want):
            assert a["Method"] == b["Method"] and all(a[c] == (b[c] if b[c] is None else pytest.approx(b[c], rel=1e-9)) for c in ("BIC", "SSE", "VAF"))


def test_small_statistics_are_read_by_few_tasks(spark, panel):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        with T.statistics(panel) as table:
            assert table.df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert T._scan_tasks(60_000, 4, 12) == 12 and T._scan_tasks(10_000_000, 4, 12) > 100


def test_loadings_of_many_subjects_at_once(stats):
    """As one by one: factor analysis by its rounds, and alignment by an assignment of columns."""
    from strandmix.functions import linalg as L
    from strandmix.operators import baselines as B

    corr, _ = B.standardised(stats)
    for r in (1, 2, 3):
        want = np.stack([L.fa_em(n, np.zeros(5), c, r, 30).loadings for n, c in zip(stats.n, corr)])
        assert np.allclose(L.fa_loadings(corr, r, 30), want, atol=1e-9)
        assert L.fa_loadings(corr[:0], r, 30).shape == (0, 5, r)
    for r in (1, 2, 3, 5):
        bases = np.random.default_rng(r).normal(size=(40, 5, r))
        for got, own in zip(B.align_bases(bases), bases):
            c = L.correlation(bases[0], own)
            order = L.assign(-(c + 1) / 2)
            assert np.allclose(got, own[:, order] * np.where(c[np.arange(r), order] < 0, -1, 1))


def test_plans_advance_together(spark, table):
    """Both strategies for both kinds take fewer jobs than apart, and choose and score alike."""
    plans = lambda: [p(table, kind, (1, 2), (1, 2), max_iter=6, method="closed_form") for kind in ("mfa", "mpca") for p in (T.grid_plan, T.two_stage_plan)]
    got, jobs = jobs_of(spark, "plans", lambda: T.together(table, plans()))
    apart = [jobs_of(spark, f"plan {i}", lambda p=p: T.together(table, [p])[0]) for i, p in enumerate(plans())]
    assert jobs < 0.6 * sum(n for _, n in apart)
    for a, (b, _) in zip(got, apart):
        assert (a.best_k, a.best_r) == (b.best_k, b.best_r) and a.best.loglik == pytest.approx(b.best.loglik, rel=1e-9)
