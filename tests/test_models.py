import itertools

import numpy as np
import pytest

from strandmix.functions import linalg as L
from strandmix.operators import baselines as B
from strandmix.operators import criteria as C
from strandmix.operators import evaluate as E
from strandmix.operators import mixture as M
from strandmix.operators import project as P
from strandmix.operators import selection as Q
from strandmix.operators import suffstats as S
from strandmix.sources import simulate as G
from tests.test_preprocess import panel


@pytest.fixture(scope="module")
def planted():
    """Two clusters of subjects that differ in means and loadings."""
    rng, series, z = np.random.default_rng(11), [], []
    lam = rng.normal(size=(2, 5, 2))
    for i in range(24):
        k = i % 2
        z.append(k + 1)
        series.append(rng.normal(size=(60, 2)) @ lam[k].T + (-1) ** k * 0.7 + rng.normal(0, 0.4, (60, 5)))
    return series, np.array(z), lam


@pytest.fixture(scope="module")
def stats(planted):
    return S.from_arrays(planted[0])


def test_statistics_of_a_panel_like_those_in_memory(spark, planted):
    series = {k + 1: x for k, x in enumerate(planted[0][:6])}
    got, want = S.collect(panel(spark, series)), S.from_arrays(planted[0][:6])
    for mean in (np.zeros(5), np.arange(5.0)):
        assert np.allclose(got.scatter(mean), want.scatter(mean))
    assert np.allclose(got.pooled()[2], want.pooled()[2]) and (got.n == want.n).all()
    with pytest.raises(ValueError):
        S.collect(panel(spark, series), limit=3 * 8 * (25 + 7))
    assert len(S.collect(panel(spark, series), limit=6 * 8 * (25 + 7))) == 6
    assert S.collectable(8) > 1_000_000 and S.collectable(64) < 40_000


def test_matrix_sums_like_single_sums(spark, planted, monkeypatch):
    series = {k + 1: x for k, x in enumerate(planted[0][:4])}
    one = S.collect(panel(spark, series))
    monkeypatch.setattr(S, "WIDE", 2)
    two = S.collect(panel(spark, series))
    assert np.allclose(one.s, two.s) and np.allclose(one.q, two.q)


def test_rows_with_missing_channels_are_left_out(spark):
    x = np.array([[1.0, 2.0], [np.nan, 3.0], [2.0, 5.0]])
    assert S.collect(panel(spark, {1: x})).n.tolist() == [2.0]


def test_likelihood_like_row_by_row(planted, stats):
    c = L.fa_em(*stats.pooled(), 2)
    inv, logdet = np.linalg.inv(c.cov), np.linalg.slogdet(c.cov)[1]
    got = L.log_likelihoods(stats.n, stats.scatter(c.mean), c.cov)
    for x, ll in zip(planted[0], got):
        d = x - c.mean
        assert np.isclose(ll, -0.5 * (len(x) * (5 * L.LOG_2PI + logdet) + np.einsum("ij,jk,ik->", d, inv, d)))
    assert np.isinf(L.log_likelihoods(stats.n, stats.scatter(c.mean), -np.eye(5))).all()


def test_em_raises_the_likelihood(stats):
    n, mean, cov = stats.pooled()
    ll = lambda c: float(L.log_likelihoods(stats.n, stats.scatter(c.mean), c.cov).sum())
    fa = [ll(L.fa_em(n, mean, cov, 2, k)) for k in (0, 1, 2, 5, 20, 100)]
    assert all(b >= a - 1e-6 for a, b in zip(fa, fa[1:]))
    closed = ll(L.ppca_closed(mean, cov, 2))
    assert np.isclose(ll(L.ppca_em(mean, cov, 2, 500)), closed, rtol=1e-6)
    assert ll(L.ppca_em(mean, cov, 2, 200, "shrunk")) < closed and ll(L.fa_em(n, mean, cov, 2, 200, "shrunk")) < fa[-1]


@pytest.mark.parametrize("kind,options", [("mfa", {}), ("mfa", {"em": "soft"}), ("mpca", {"method": "closed_form"}), ("mpca", {}), ("mpca", {"em": "soft"}), ("mfa", {"estep": "shrunk"}), ("mpca", {"estep": "shrunk"})])
def test_mixtures_find_planted_clusters(planted, stats, kind, options):
    fit = M.fit(stats, kind, 2, 2, seed=1, **options)
    assert E.ari(planted[1], fit.z) > 0.9
    assert np.allclose(fit.resp.sum(axis=1), 1) and np.isclose(fit.pi.sum(), 1)
    assert all((c.noise > 0).all() for c in fit.components)
    again = M.fit(stats, kind, 2, 2, seed=1, **options)
    assert (again.z == fit.z).all() and again.loglik == fit.loglik


def test_more_starts_never_lose(stats):
    assert M.fit(stats, "mpca", 3, 2, n_init=4, method="closed_form").loglik >= M.fit(stats, "mpca", 3, 2, n_init=1, method="closed_form").loglik


def test_empty_clusters_survive(stats):
    fit = M.fit_once(stats, "mpca", 3, 1, np.zeros(len(stats), int), method="closed_form")
    assert len(fit.components) == 3 and np.isfinite(fit.loglik)


def test_progress_is_told(stats):
    seen = []
    M.fit_once(stats, "mpca", 2, 1, progress=lambda k, ll: seen.append((k, ll)))
    assert [k for k, _ in seen] == list(range(1, len(seen) + 1))


def test_arguments_are_checked(stats):
    for bad in (dict(n_clusters=0, n_factors=1), dict(n_clusters=99, n_factors=1), dict(n_clusters=2, n_factors=9)):
        with pytest.raises(ValueError):
            M.fit(stats, "mfa", use_kmeans=False, **bad)
    with pytest.raises(ValueError):
        M.fit(stats, "other", 2, 2)


def test_canonical_order(stats):
    fit = M.fit(stats, "mfa", 2, 2)
    a = M.canonical(fit)
    swapped = M.Fit(fit.kind, fit.ids, 3 - fit.z, fit.resp[:, ::-1], fit.pi[::-1], fit.components[::-1], fit.loglik, fit.rounds)
    b = M.canonical(swapped)
    assert (a.z == b.z).all() and np.allclose(a.resp, b.resp)


def test_distributed_fit_like_the_one_in_memory(spark, planted):
    series = {k + 1: x for k, x in enumerate(planted[0])}
    p = panel(spark, series)
    start = spark.createDataFrame([(k + 1, k // 12 + 1) for k in range(24)], "subject_id long, z int")
    fit, labels = M.fit_distributed(p, "mpca", 2, 2, start, max_iter=12)
    local = M.fit_once(S.collect(p), "mpca", 2, 2, np.arange(24) // 12, max_iter=12, method="closed_form")
    got = {r.subject_id: r.z for r in labels.collect()}
    assert E.ari(local.z, [got[int(i)] for i in local.ids]) == 1 and E.ari(planted[1], [got[k + 1] for k in range(24)]) > 0.9


def test_errors_from_statistics_like_rows(spark, planted, stats):
    for kind in ("mfa", "mpca"):
        fit = M.fit(stats, kind, 2, 2)
        sse = P.subject_sse(stats, fit)
        for i, x in enumerate(planted[0][:5]):
            c = fit.components[fit.z[i] - 1]
            rebuilt = c.mean + (x - c.mean) @ P.hat(kind, c).T
            assert np.isclose(sse[i], ((x - rebuilt) ** 2).sum())
        total = sum((x**2).sum() for x in planted[0])
        assert np.isclose(P.vaf(stats, fit), 1 - sse.sum() / total)
        assert np.isclose(P.reconstruction_error(stats, fit, "rmse"), np.sqrt(sse.sum() / (24 * 60 * 5)))


def test_scores_like_numpy(spark, planted, stats):
    from dataclasses import replace

    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0][:3])})
    fit = replace(M.fit(stats, "mfa", 2, 2), channels=p.channels)
    z = spark.createDataFrame([(int(i), int(a)) for i, a in zip(fit.ids, fit.z)], "subject_id long, z int")
    rows = {(r.subject_id, r.t): r for r in P.scores(p, fit, z).collect()}
    back = {(r.subject_id, r.t): r for r in P.reconstruct(p, fit, z).collect()}
    for i, x in enumerate(planted[0][:3]):
        c = fit.components[fit.z[i] - 1]
        b = c.loadings.T @ np.linalg.inv(c.cov)  # the posterior mean in its other form
        for t in (0, 30):
            r = rows[i + 1, t + 1]
            assert np.allclose([r.f_1, r.f_2], b @ (x[t] - c.mean))
            assert np.allclose([back[i + 1, t + 1][n] for n in p.channels], c.mean + c.loadings @ (b @ (x[t] - c.mean)))


def test_information_criteria():
    assert C.n_parameters("mfa", 2, 2, 5) == 2 * (10 + 1 + 10) + 1 and C.n_parameters("mpca", 3, 2, 4) == 3 * (8 + 1 + 4 + 1) + 2
    assert C.n_parameters("mfa", 2, 3, 5, rotation=False) == 2 * (15 + 10) + 1
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    assert np.isclose(C.entropy(p), np.log(2)) and np.isclose(C.icl(10, p), 10 + 2 * np.log(2))
    sharp = C.tempered(np.array([[0.6, 0.4]]), 3)
    assert sharp[0, 0] > 0.6 and np.isclose(sharp.sum(), 1) and np.allclose(C.tempered(p, 1.0), p)


def test_legacy_likelihood_differs_only_for_pca(stats):
    fa, pca = M.fit(stats, "mfa", 2, 2), M.fit(stats, "mpca", 2, 2)
    assert C.loglik(stats, fa, legacy=True) == C.loglik(stats, fa)
    assert C.loglik(stats, pca, legacy=True) != C.loglik(stats, pca) and np.isclose(C.loglik(stats, pca), pca.loglik)


def test_varimax_keeps_what_loadings_span():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 3))
    b, r = L.varimax(a)
    assert np.allclose(b @ b.T, a @ a.T) and np.allclose(r @ r.T, np.eye(3)) and np.allclose(a @ r, b)
    size = lambda x: ((x / np.sqrt((x**2).sum(axis=1, keepdims=True))) ** 2).var(axis=0).sum()
    assert size(b) >= size(a) - 1e-9
    one = rng.normal(size=(4, 1))
    assert L.varimax(one)[0] is one


def test_assignment_is_cheapest():
    rng = np.random.default_rng(5)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            cost = rng.integers(-5, 9, (n, n)).astype(float)
            got = L.assign(cost)
            assert sorted(got) == list(range(n))
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_subspaces():
    rng = np.random.default_rng(6)
    a, turn = rng.normal(size=(6, 2)), np.linalg.qr(rng.normal(size=(2, 2)))[0]
    assert np.isclose(L.subspace_similarity(a, a @ turn), 1)
    assert np.isclose(L.subspace_similarity(np.eye(4)[:, :2], np.eye(4)[:, 2:]), 0)
    assert L.subspace_similarity(a, rng.normal(size=(5, 2))) is None and L.subspace_similarity(a * np.nan, a) is None and L.subspace_similarity(None, a) is None


def test_agreement():
    assert E.ari([1, 1, 2, 2], [5, 5, 7, 7]) == 1 and E.ari([1], [1, 2]) is None and E.ari([], []) is None and E.ari([1, None], [1, 2]) is None
    assert np.isclose(E.ari([1, 1, 2, 2], [1, 2, 1, 2]), -0.5)
    got = E.align_to_truth(np.array([1, 1, 2, 2, 2]), np.array([2, 2, 1, 1, 3]))
    assert got["mapping"] == {1: 2, 2: 1, 3: 2} and got["accuracy"] == 1


def test_signs_and_bootstrap_alignment(stats):
    fit = E.align_signs(M.fit(stats, "mfa", 2, 2))
    again = E.align_signs(fit)
    for c, d in zip(fit.components, again.components):
        top = c.loadings[np.abs(c.loadings).argmax(axis=0), range(2)]
        assert (top > 0).all() and (c.loadings == d.loadings).all()
    ref = np.stack([c.loadings for c in fit.components])
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(2, 2)))[0]
    for exact in (True, False):
        assert np.allclose(E.align_bootstrap(ref, (ref @ turn)[::-1], exact), ref)


def test_rotation_leaves_covariances(stats):
    fit = M.fit(stats, "mfa", 2, 2)
    for a, b in zip(fit.components, E.rotate(fit).components):
        assert np.allclose(a.cov, b.cov)


def test_bootstrap_intervals(spark, stats):
    draws = E.bootstrap_loadings(spark, stats, "mpca", 2, 2, n_boot=12, method="closed_form")
    got = E.bootstrap_summary(draws).collect()
    assert len(got) == 20 and all(r.lower <= r.median <= r.upper and 0 < r.n_boot <= 12 for r in got)


def test_selection_finds_planted_clusters(spark, stats):
    grid = Q.grid(stats, "mfa", range(1, 4), range(1, 4))
    assert (grid.best_k, grid.best_r) == (2, 2) and len(grid.summary) == 9
    assert [x["BIC"] for x in grid.summary] == sorted(x["BIC"] for x in grid.summary)
    spread = Q.grid(stats, "mfa", range(1, 4), range(1, 4), spark=spark)
    assert (spread.best_k, spread.best_r) == (2, 2) and np.isclose(spread.best.loglik, grid.best.loglik)
    for criterion in ("ICL", "BIC"):
        two = Q.two_stage(stats, "mpca", range(1, 4), range(1, 4), criterion=criterion, temperature=2.0)
        assert two.best_k == 2 and {x["stage"] for x in two.summary} == {"K", "r"}
        assert two.frame(spark).count() == 6
    assert Q.evaluation(grid, spark).count() == 9 and Q.model_by(grid, 2, 2) is grid.best and Q.model_by(grid, 9, 9) is None
    with pytest.raises(ValueError):
        Q.select_k_r(stats, "mfa", "other")


def test_stability_and_cross_validation(spark, stats):
    draws = Q.bootstrap_draws(spark, stats, "mpca", (2, 3), n_boot=12, method="closed_form")
    assert sorted((r.K, r.b, r["count"]) for r in draws.groupBy("K", "b").count().collect()) == [(k, b, 19) for k in (2, 3) for b in range(12)]
    assert Q.best_k_by_stability(Q.stability(draws)).first().K == 2
    rows = Q.cross_validate_k(spark, stats, "mpca", (1, 2, 3), folds=4, method="closed_form")
    assert [r.K for r in Q.one_se_rule(rows, "K", "score").where("selected").collect()] == [2]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_pairs_in_blocks_like_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, b, i, int(rng.integers(1, k + 1))) for k in (2, 3, 4) for b in range(9) for i in range(20) if rng.random() < (0.8 if k < 4 else 0.3)]
    got = {r.K: (r.stability, r.n_pairs) for r in Q.stability(spark.createDataFrame(rows, "K int, b int, subject_id long, z int"), block=block).collect()}
    for k in (2, 3, 4):
        label = {(b, i): z for kk, b, i, z in rows if kk == k}
        shares = []
        for i, j in itertools.combinations(range(20), 2):
            both = [label[b, i] == label[b, j] for b in range(9) if (b, i) in label and (b, j) in label]
            if len(both) >= 5:
                shares.append(np.mean(both))
        if shares:
            assert got[k][1] == len(shares) and np.isclose(got[k][0], 1 - 4 * np.mean([p * (1 - p) for p in shares]))
        else:
            assert k not in got
    assert Q.stability(spark.createDataFrame([], "K int, b int, subject_id long, z int")).count() == 0


def test_two_stages_by_tasks_like_one_after_another(spark, stats):
    a, b = (Q.two_stage(stats, "mpca", range(1, 4), range(1, 4), temperature=2.0, spark=x) for x in (None, spark))
    assert (a.best_k, a.best_r) == (b.best_k, b.best_r) and all(np.isclose(x["BIC"], y["BIC"]) for x, y in zip(a.summary, b.summary))
    one, two = (Q.criteria_table(stats, "mfa", 2, range(1, 4), spark=x) for x in (None, spark))
    assert all(np.isclose(x["VAF"], y["VAF"]) and x["r"] == y["r"] for x, y in zip(one, two))


def test_pairs_travel_as_blocks(spark, monkeypatch):
    """What blocks send to meet each other are their subjects' bits, in one row a block, whatever the labels' numbers; counts are those of all pairs."""
    monkeypatch.setattr(Q, "PAIR_SLAB", 50)
    rng = np.random.default_rng(8)
    z = rng.choice([-7, 3, 1000], (300, 70))
    there = rng.random((300, 70)) < 0.3
    rows = spark.createDataFrame([(2, 10 * int(b) - 5, int(i), int(z[i, b])) for i, b in zip(*np.nonzero(there))], "K int, b int, subject_id long, z int")
    met, real = [], type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *keys: (met.append(self) if keys == ("K", "i", "j") else None) or real(self, *keys))
    got = Q.stability(rows, 15, block=100).first()
    monkeypatch.undo()
    joint = there.astype(int) @ there.T
    same = sum(((z == v) & there).astype(int) @ ((z == v) & there).T for v in (-7, 3, 1000))
    enough = np.triu(joint >= 15, 1)
    share = same[enough] / joint[enough]
    assert got.n_pairs == enough.sum() and np.isclose(got.stability, 1 - 4 * np.mean(share * (1 - share)))
    assert len(met) == 1 and met[0].count() <= 49 and met[0].selectExpr("sum(length(there) + length(chosen))").first()[0] < 100 * 7 * 300


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_shuffled_places_are_a_permutation(n):
    places = [Q._shuffled_place(np.arange(n), n, (0, p, j)) for p in range(2) for j in range(2)]
    assert all(sorted(x.tolist()) == list(range(n)) for x in places)
    assert n < 64 or len({tuple(x) for x in places}) == 4
    if n >= 1000:
        x, y = places[0], places[1]
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.1 and abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.1


def test_permutations_like_shuffled_columns(spark, planted):
    """All permutations in one job, in blocks of any size, each like its channels put in their places one by one."""
    rows = panel(spark, {k + 1: x for k, x in enumerate(planted[0])}).df.select("c0", "c1", "c2").persist()
    data = np.array([tuple(r) for r in rows.collect()])  # partition by partition, as rows are numbered
    n = len(data)
    got = {size: Q.permuted_eigenvalues(rows, ["c0", "c1", "c2"], range(5), 3, size) for size in (100, 1 << 16)}
    for p in range(5):
        mixed = np.zeros_like(data)
        for j in range(3):
            mixed[Q._shuffled_place(np.arange(n), n, (3, p, j)), j] = data[:, j]
        want = np.linalg.eigvalsh(np.cov(mixed.T, bias=True))[::-1]
        assert all(np.allclose(x[p], want, atol=1e-10) for x in got.values())
    rows.unpersist()


def test_permutations_share_one_shuffle(spark, monkeypatch):
    """Rows are dealt once, however many permutations there are; over several chunks they are those of the definition, and spread like independent ones."""
    monkeypatch.setattr(Q, "CHUNK", 128)
    monkeypatch.setattr(Q, "DEALT", 300)
    rng = np.random.default_rng(4)
    data = np.column_stack([x := rng.normal(size=1000), x + 0.1 * rng.normal(size=1000)])
    rows = spark.createDataFrame([tuple(map(float, v)) for v in data], "a double, b double").repartition(3).persist()
    data, n = np.array([tuple(r) for r in rows.collect()]), 1000
    dealt = []
    real = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: dealt.append(real(self, *a)) or dealt[-1])
    got = Q.permuted_eigenvalues(rows, ["a", "b"], range(60), 3)
    assert len(dealt) == 1 and sum(len(r.v) for r in dealt[0].collect()) == 8 * 2 * n
    places = {(p, j): Q._shuffled_place(np.arange(n), n, (3, p, j)) for p in range(60) for j in range(2)}
    assert all(sorted(x.tolist()) == list(range(n)) for x in places.values())
    for p in range(3):
        mixed = np.zeros_like(data)
        for j in range(2):
            mixed[places[p, j], j] = data[:, j]
        assert np.allclose(got[p], np.linalg.eigvalsh(np.cov(mixed.T, bias=True))[::-1], atol=1e-10)
    spread = [np.corrcoef(data[np.argsort(places[p, 0]), 0], data[np.argsort(places[p, 1]), 1])[0, 1] for p in range(60)]
    assert abs(np.mean(spread)) < 4 / np.sqrt(n) and 0.7 < np.std(spread) * np.sqrt(n) < 1.3
    rows.unpersist()


def test_exchanges_never_lose():
    rng = np.random.default_rng(0)
    better = 0
    for seed in range(30):
        x = rng.normal(size=(60, 2)) + rng.integers(0, 3, (60, 1)) * rng.uniform(0, 3)
        spread = lambda z: sum(((x[z == k] - x[z == k].mean(axis=0)) ** 2).sum() for k in np.unique(z))  # noqa: E731, B023
        plain, found = (L.kmeans(x, 4, starts=1, seed=seed, exchanges=e) for e in (False, True))
        assert spread(found) <= spread(plain) + 1e-9
        better += spread(found) < spread(plain) - 1e-9
        centres = np.stack([x[found == k].mean(axis=0) for k in range(4)])
        sizes = np.bincount(found)
        for i, v in enumerate(x):  # no single move lowers the sum
            own = found[i]
            if sizes[own] > 1:
                leaves = ((centres[own] - v) ** 2).sum() * sizes[own] / (sizes[own] - 1)
                assert all(((centres[k] - v) ** 2).sum() * sizes[k] / (sizes[k] + 1) >= leaves - 1e-9 for k in range(4) if k != own)
    assert better > 3


def test_kendall_without_pairs(spark):
    from strandmix.operators import kendall as K

    rng = np.random.default_rng(1)
    for values in ([], [5], rng.integers(0, 4, 50), rng.normal(size=333), np.arange(64)[::-1], np.zeros(9)):
        values = np.asarray(values)
        assert K.inversions(values) == sum(int((values[i + 1 :] < v).sum()) for i, v in enumerate(values))
    rows, want = [], {}
    for g, (n, levels) in enumerate([(1, 5), (2, 5), (40, 3), (200, 1000), (150, 7), (30, 1)]):
        x, y = rng.integers(0, levels, n), rng.integers(0, levels, n) if g % 2 else np.arange(n) % max(1, levels // 2)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)] + [(g, None, 1.0), (g, 1.0, None)]
        dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        bottom = np.sqrt((dx**2).sum() * (dy**2).sum())
        want[g] = (dx * dy).sum() / bottom if bottom else None
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(3)
    for blocks in (2, 5, 64):
        got = {r.g: r["corr"] for r in K.kendall(df, ["g"], blocks=blocks).collect()}
        assert got.keys() == want.keys() and all((got[g] is None) == (want[g] is None) and (want[g] is None or np.isclose(got[g], want[g])) for g in want)


@pytest.mark.parametrize("method,refine", [("PCA", False), ("PCA", True), ("FA", False)])
def test_two_steps_on_the_cluster_like_those_in_memory(spark, planted, method, refine):
    from strandmix.operators import fits as T
    from strandmix.operators import twostep as Two

    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0])})
    st = S.collect(p)
    with T.statistics(p) as table:
        got = Two.two_step(table, 2, 2, method, refine=refine)
    want = B.two_step(st, 2, 2, method, refine=refine)
    z = {r.subject_id: r.z for r in got.assignments.collect()}
    assert E.ari(want.z, [z[int(i)] for i in st.ids]) == 1
    assert np.isclose(got.sse, want.sse, rtol=1e-9) and np.isclose(got.vaf, want.vaf, rtol=1e-9)


def test_two_steps_over_more_subjects_than_the_sample(spark, planted, monkeypatch):
    from strandmix.operators import fits as T
    from strandmix.operators import twostep as Two

    monkeypatch.setattr(T, "SAMPLE", 8)
    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0])})
    st = S.collect(p)
    with T.statistics(p) as table:
        got = Two.two_step(table, 1, 2)
    z = {r.subject_id: r.z for r in got.assignments.collect()}
    assert E.ari(B.two_step(st, 1, 2).z, [z[int(i)] for i in st.ids]) == 1


@pytest.mark.parametrize("em", ["hard", "soft"])
def test_distributed_fits_from_kmeans(spark, planted, em):
    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0])})
    fit, labels = M.fit_distributed(p, "mpca", 2, 2, em=em, max_iter=10)
    got = {r.subject_id: r.z for r in labels.collect()}
    assert E.ari(planted[1], [got[k + 1] for k in range(24)]) == 1
    local = M.fit_once(S.collect(p), "mpca", 2, 2, planted[1] - 1, em=em, max_iter=10, method="closed_form")
    assert np.isclose(sorted(fit.pi)[0], sorted(local.pi)[0], atol=1e-6)
    assert np.allclose(sorted(c.mean.sum() for c in fit.components), sorted(c.mean.sum() for c in local.components), atol=1e-4)
    with pytest.raises(ValueError):
        M.fit_distributed(p, "mpca", 2, 2, em="other")


def test_criteria_of_distributed_fits(spark, planted):
    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0])})
    rows = M.grid_distributed(p, "mpca", (1, 2), (1, 2), max_iter=8)
    assert rows[0]["K"] == 2 and [x["BIC"] for x in rows] == sorted(x["BIC"] for x in rows)
    stats = S.collect(p)
    for row in rows:
        local = M.fit_once(stats, "mpca", row["K"], row["r"], planted[1] - 1 if row["K"] == 2 else None, max_iter=8, method="closed_form")
        assert np.isclose(row["logLik"], local.loglik, rtol=1e-6) and np.isclose(row["entropy"], C.entropy(local.resp), atol=1e-3)


def test_densities_of_rows_sum_to_a_subject_s(spark, planted, stats):
    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0][:3])})
    for kind in ("mfa", "mpca"):
        fit = M.fit(stats, kind, 2, 2)
        got = P.row_log_densities(p, fit).groupBy("subject_id").sum("log_density_1", "log_density_2").collect()
        own = S.from_arrays(planted[0][:3])
        for k, c in enumerate(fit.components):
            want = L.log_likelihoods(own.n, own.scatter(c.mean), c.cov)
            assert np.allclose([r[k + 1] for r in sorted(got, key=lambda r: r[0])], want)
    gone = p.with_df(p.df.selectExpr("subject_id", "t", *(f"CASE WHEN t > 1 THEN {c} END AS {c}" if c == p.channels[0] else c for c in p.channels)))
    assert P.row_log_densities(gone, fit).where("log_density_1 IS NULL").count() == 3


def test_rotated_scores_give_the_same_reconstruction(spark, planted, stats):
    from dataclasses import replace

    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0])})
    fit = replace(M.fit(stats, "mfa", 2, 2), channels=p.channels)
    z = fit.assignments(spark)
    plain = P.scores(p, fit, z)
    turned = E.rotate(fit, clusters=[1])
    got = {(r.subject_id, r.t): r for r in E.rotate_scores(plain, turned).collect()}
    for r in plain.collect()[:200]:
        a, b = fit.components[r.z - 1].loadings @ [r.f_1, r.f_2], turned.components[r.z - 1].loadings @ [got[r.subject_id, r.t].f_1, got[r.subject_id, r.t].f_2]
        assert np.allclose(a, b)
    for call in (lambda: E.rotate_scores(plain, fit), lambda: E.rotate_scores(plain.drop("f_2"), turned)):
        with pytest.raises(ValueError):
            call()


def test_checks_of_fits(stats):
    from dataclasses import replace

    from strandmix.functions import checks

    fit = M.fit(stats, "mfa", 2, 2)
    assert checks.fit_object(fit) == "mfa" == checks.fit_object(fit, "MFA", ("z", "resp"))
    with pytest.warns(UserWarning):
        assert checks.fit_object(fit, "mpca") == "mpca"
    for bad in ([], replace(fit, components=()), replace(fit, pi=np.ones(3)), replace(fit, kind="other"), replace(fit, components=(fit.components[0], replace(fit.components[1], mean=np.zeros(2))))):
        with pytest.raises(ValueError):
            checks.fit_object(bad)
    with pytest.raises(ValueError):
        checks.fit_object(fit, required=("nothing",))


def test_summary_of_a_choice_of_r(spark, stats):
    found = Q.select_r(None, stats, "mfa", 2, range(1, 4), scope="hybrid")
    rows = Q.r_summary(found, spark, "mfa", "hybrid", "max").collect()
    items = [r.item for r in rows]
    assert items.count("r_cluster") == 2 and {"model_type", "scope", "r", "r_global", "logLik"} <= set(items)
    assert next(r.value for r in rows if r.item == "r") == found["r"]


def test_threads_of_libraries(spark):
    import os

    from strandmix.functions import threads

    before = {k: os.environ.get(k) for k in threads.VARIABLES}
    with threads.internal_threads(2, spark):
        assert all(os.environ[k] == "2" == spark.sparkContext.environment[k] for k in threads.VARIABLES)
    assert before == {k: os.environ.get(k) for k in threads.VARIABLES} and "OMP_NUM_THREADS" not in spark.sparkContext.environment or before["OMP_NUM_THREADS"]
    with pytest.raises(ValueError):
        with threads.internal_threads(0):
            pass


@pytest.mark.parametrize("how", [dict(method=m) for m in ("bic", "vaf", "vss", "multicriteria", "cv")] + [dict(scope=s) for s in ("clusterwise", "hybrid", "global-first")] + [dict(scope="clusterwise", how=h) for h in ("mean", "majority", "min")])
def test_every_way_to_choose_r(spark, planted, stats, how):
    assert 1 <= Q.select_r(None, stats, "mfa", 2, range(1, 4), **how)["r"] <= 3


@pytest.mark.parametrize("scope", ["global", "global-first"])
def test_two_factors_are_found_where_only_a_scope_is_told(spark, monkeypatch, scope):
    from strandmix.plans import models
    from tests.conftest import DATA

    monkeypatch.setattr(Q, "parallel_analysis", None)  # neither takes it
    assert [tuple(x) for x in models._of_two(spark, f"{DATA}/sf0.001", scope=scope).collect()] == [(2,)]


def test_parallel_analysis(spark, planted):
    got = Q.parallel_analysis(panel(spark, {k + 1: x for k, x in enumerate(planted[0][:8])}), range(1, 5), n_perm=20)
    assert 1 <= got["r"] <= 4 and len(got["limits"]) == 5
    noise = np.random.default_rng(0).normal(size=(400, 4))
    assert Q.parallel_analysis(panel(spark, {1: noise}), range(1, 5), n_perm=20)["n_above"] <= 1


def test_best_r_on_the_driver_like_the_frame(spark):
    rng = np.random.default_rng(8)
    for flat in (False, True):
        rows = [{"r": r, "VAF": float(rng.random()), "VSS": 0.5 * np.log(max(r, 2)) if flat else float(rng.random()), "smoothness": 1.0 if flat else float(rng.random())} for r in range(1, 6)]
        if flat:
            rows = [x | {"VSS": 0.5} for x in rows]
        frame = spark.createDataFrame([tuple(x.values()) for x in rows], "r int, VAF double, VSS double, smoothness double")
        for criteria in (("VAF", "VSS", "smoothness"), ("VAF", "smoothness"), ("VAF",), ("smoothness",)):
            (chosen,) = Q.best_r(frame, criteria).where("selected").collect()
            assert chosen.r == Q._best_of(rows, criteria)


def test_vss():
    a = np.array([[0.9, 0.1], [0.6, 0.7], [0.2, 0.1], [0.1, 0.8]])
    assert Q.vss([a]) == 0.5 and Q.vss([a[:, :1]]) == 1
    assert np.isclose(Q.vss([a], method="ratio"), np.mean([0.81 / 0.82, 0.49 / 0.85, 0.8, 0.64 / 0.65]))
    assert Q.vss([]) == 0


def test_smoothness_from_statistics(spark, planted, stats):
    p = panel(spark, {k + 1: x for k, x in enumerate(planted[0][:4])})
    rows = {r[0]: r[1] for r in Q.difference_squares(p).collect()}
    d = S.upper_to_full(np.array([rows[k + 1] for k in range(4)]), 5)
    from dataclasses import replace

    fit = replace(M.fit(stats.pick(np.arange(4)), "mfa", 2, 2), channels=p.channels)
    z = spark.createDataFrame([(int(i), int(a)) for i, a in zip(fit.ids, fit.z)], "subject_id long, z int")
    assert np.isclose(Q.smoothness(fit, d), P.score_smoothness(p, fit, z).first().penalty)


def test_baselines(planted, stats):
    got = B.two_step(stats, 2, 2)
    assert set(got.z) <= {1, 2} and 0 < got.vaf <= 1
    refined = B.two_step(stats, 2, 2, refine=True)
    assert refined.sse <= got.sse + 1e-6
    rows = B.compare_all(stats, 2, 2, planted[1], true_bases=list(planted[2]))
    assert [x["Method"] for x in rows] == ["SingleFA", "SinglePCA", "TwoStep_FA", "TwoStep_PCA", "MixtureFA", "MixturePCA"]
    assert rows[0]["ARI"] is None and rows[2]["BIC"] is None and rows[4]["ARI"] > 0.9
    assert B.majority(np.array([0, 1, 1, 0]), np.array([3.0, 1, 1, 3])) == 1


def test_simulation(spark):
    d = G.Design(n_subjects=9, n_clusters=3, length=50, seed=4)
    series, z, params = G.arrays(d)
    p, truth = G.simulate(spark, d)
    rows = {(r.subject_id, r.t): r for r in p.df.collect()}
    assert len(rows) == 450 and np.isclose(rows[5, 7].ch_2, series[4][6, 1])
    assert [r.z_true for r in truth.orderBy("subject_id").collect()] == z.tolist() and set(z) == {1, 2, 3}
    assert np.allclose(params["loadings"].sum(axis=1), 1) and (params["loadings"] >= 0).all()
    with pytest.raises(ValueError):
        G.generate(spark)


def test_simulated_clusters_are_found():
    series, z, _ = G.arrays(G.Design(n_subjects=30, n_clusters=2, n_factors=2, length=150, seed=9))
    fit = M.fit(S.from_arrays(series), "mfa", 2, 2, n_init=3, seed=2)
    assert E.ari(z, fit.z) > 0.7
