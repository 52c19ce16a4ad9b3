from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmix.functions import checks, iir
from strandmix.operators import preprocess as P
from strandmix.sources.panel import Panel, bind, bind_spread, check_panel


def panel(spark, series: dict) -> Panel:
    rows = [(int(k), t + 1, *map(lambda v: None if np.isnan(v) else float(v), row)) for k, x in series.items() for t, row in enumerate(np.atleast_2d(np.asarray(x, dtype=float).T).T)]
    width = len(rows[0]) - 2
    names = tuple(f"c{j}" for j in range(width))
    return Panel(spark.createDataFrame(rows, "subject_id long, t int, " + ", ".join(f"{n} double" for n in names)).repartition(3), names)


def back(p: Panel) -> dict:
    out = {}
    for r in sorted(p.df.collect(), key=lambda r: (r.subject_id, r.t)):
        out.setdefault(r.subject_id, []).append([np.nan if r[c] is None else r[c] for c in p.channels])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture
def series():
    rng = np.random.default_rng(3)
    return {1: rng.normal(size=(40, 2)) + 5, 2: rng.normal(size=(7, 2)), 3: rng.normal(size=(1, 2))}


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_polynomials_like_numpy(spark, series, degree):
    del series[3]
    got = back(P.remove_offset(panel(spark, series), "polynomial", degree))
    for k, x in series.items():
        t = np.arange(1, len(x) + 1)
        for j in range(2):
            assert np.allclose(got[k][:, j], x[:, j] - np.polyval(np.polyfit(t, x[:, j], degree), t), atol=1e-8)


def test_offsets(spark, series):
    for method, f in (("mean", np.mean), ("median", np.median)):
        got = back(P.remove_offset(panel(spark, series), method))
        assert all(np.allclose(got[k], x - f(x, axis=0)) for k, x in series.items())
    line = back(P.remove_offset(panel(spark, {1: 3 + 2 * np.arange(9.0)}), "linear"))[1]
    assert np.allclose(line, 0, atol=1e-9)
    with pytest.raises(ValueError):
        P.remove_offset(panel(spark, series), "mode")


def test_envelopes_like_loops(spark, series):
    x = series[1][:, 0]
    rms = back(P.envelope_rms(panel(spark, {1: x}), 60, 100))[1][:, 0]
    mean = back(P.envelope_moving_average(panel(spark, {1: x}), 60, 100))[1][:, 0]
    n, w, h = len(x), 6, 3
    for i in range(n):
        near = x[max(0, i - h) : i + h + 1]
        assert np.isclose(rms[i], np.sqrt((near**2).mean()))
        whole = x[i - (w - 1 - h) : i + h + 1] if i - (w - 1 - h) >= 0 and i + h < n else near
        assert np.isclose(mean[i], whole.mean())


def test_window_widths_round_half_to_even():
    assert [P.window_width(m, 100) for m in (25, 35, 45, 1)] == [2, 4, 4, 1]


def test_normalisations(spark):
    x = {1: [[1.0, -4.0], [2.0, 0.0], [3.0, 2.0]], 2: [[0.0, 1.0], [0.0, 1.0], [0.0, 1.0]]}
    got = back(P.normalize(panel(spark, x), "max"))
    assert np.allclose(got[1][:, 1], [-1, 0, 0.5]) and np.isnan(got[2][:, 0]).all()
    assert np.allclose(back(P.normalize(panel(spark, x), "range"))[2], 0)
    z = back(P.normalize(panel(spark, x), "zscore"))[1][:, 0]
    assert np.allclose(z, [-1, 0, 1])
    pooled = back(P.normalize_pooled(panel(spark, x), "max"))
    assert np.allclose(pooled[1], np.array(x[1]) / 4)
    reference = spark.createDataFrame([(1, "c0", 2.0), (1, "c1", 0.0)], "subject_id long, channel string, reference double")
    mvc = back(P.normalize(panel(spark, x), "mvc", reference))
    assert np.allclose(mvc[1][:, 0], [50, 100, 150]) and np.allclose(mvc[1][:, 1], [-1, 0, 0.5])
    for scale in (P.normalize, P.normalize_pooled):
        with pytest.raises(ValueError):
            scale(panel(spark, x), "mvc")
    pooled = back(P.normalize_pooled(panel(spark, x), "mvc", spark.createDataFrame([(1, 2.0)], "subject_id long, reference double")))
    assert np.allclose(pooled[1], np.array(x[1]) * 50) and np.allclose(pooled[2], np.array(x[2]))


def test_notches(spark):
    t = np.arange(2000) / 1000
    x = sum(np.sin(2 * np.pi * f * t) for f in (50, 100, 110))
    one, all_ = (back(P.notch(panel(spark, {1: x}), 1000, 50, harmonics=h))[1][500:-500, 0] for h in (False, True))
    power = lambda y, f: np.abs(np.exp(-2j * np.pi * f * t[500:-500]) @ y) / len(y)
    assert power(one, 50) < 0.05 < 0.4 < power(one, 100) and power(all_, 100) < 0.05 and power(all_, 110) > 0.4
    with pytest.raises(ValueError):
        P.notch(panel(spark, {1: x}), 1000, 600)


def test_references(spark):
    x = np.arange(-50.0, 50)
    ref = lambda method, **o: P.mvc_reference(panel(spark, {1: x}), method, **o).first().reference
    assert ref("peak") == 50 and ref("mean_peak") == np.sort(np.abs(x))[-5:].mean()
    assert np.isclose(ref("rms_peak", window_ms=100, fs=100), max(np.sqrt((x[i : i + 10] ** 2).mean()) for i in range(91)))


def test_reference_of_a_series_shorter_than_its_window(spark):
    got = P.mvc_reference(panel(spark, {1: [3.0, 4.0]}), "rms_peak", window_ms=500, fs=100).first().reference
    assert np.isclose(got, np.sqrt(12.5))


def test_rectification_and_nulls(spark):
    x = {1: [1.0, -2.0, np.nan]}
    assert np.allclose(back(P.rectify(panel(spark, x)))[1][:2, 0], [1, 2])
    half = back(P.rectify(panel(spark, x), "half_wave"))[1][:, 0]
    assert half[1] == 0 and np.isnan(half[2])
    nan = spark.createDataFrame([(1, 1, float("nan")), (1, 2, 3.0)], "s long, k int, v double")
    bound = bind(nan, "s", ["k"], {"x": "v"})
    assert [r.x for r in bound.df.orderBy("t").collect()] == [None, 3.0]
    assert check_panel(bound).first().n_missing == 1


@pytest.mark.parametrize("kind", ["butterworth", "chebyshev1", "chebyshev2"])
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_filters_by_their_response(kind, order):
    fs = 1000
    for band, cut, passed, stopped in (("low", (50,), [1, 5], [400, 480]), ("band", (50, 200), [100], [1, 490]), ("stop", (50, 200), [1, 495], [100])):
        sos = iir.design(kind, order, band, cut, fs)
        gain = lambda f: np.abs(iir.response(sos, np.array(f, dtype=float), fs))
        if order >= 3:
            assert (gain(passed) > 0.9).all() and (gain(stopped) < 0.15).all()
        edge = {"butterworth": np.sqrt(0.5), "chebyshev1": 10 ** (-iir.RIPPLE_DB / 20), "chebyshev2": 10 ** (-iir.DEPTH_DB / 20)}[kind]
        assert np.allclose(gain(cut), edge, rtol=1e-6)


def test_filter_runs_like_its_response():
    fs, t = 1000, np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 100 * t)
    sos = iir.design("butterworth", 4, "band", (20, 450), fs)
    y = iir.filtfilt(sos, x)
    assert np.abs(y[500:-500] - np.sin(2 * np.pi * 100 * t)[500:-500]).max() < 0.02
    assert len(iir.filtfilt(sos, np.zeros(0))) == 0 and len(iir.filtfilt(sos, np.ones(3))) == 3
    assert np.isnan(iir.sosfilt(sos, np.array([1.0, np.nan, 2.0]))).tolist() == [False, True, False]


@pytest.mark.parametrize("n", [0, 1, 5, 128, 129, 1000])
def test_blocks_like_one_row_after_another(n):
    x = np.random.default_rng(n).normal(size=n)
    for sos in (iir.design("butterworth", 4, "band", (20, 450), 1000), iir.design("chebyshev1", 3, "low", (6,), 1000)):
        y = x.copy()
        for b0, b1, b2, a1, a2 in sos:
            s1 = s2 = 0.0
            for k, v in enumerate(y):
                w = b0 * v + s1
                s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
                y[k] = w
        assert np.allclose(iir.sosfilt(sos, x), y, atol=1e-9)


def test_filters_check_their_cutoffs(spark, series):
    for low, high in ((0, 10), (20, 600), (30, 20)):
        with pytest.raises(ValueError):
            P.bandpass(panel(spark, series), 1000, low, high)


def test_pipeline_steps(spark):
    rng = np.random.default_rng(0)
    p = panel(spark, {1: rng.normal(size=(200, 2)) + 3, 2: rng.normal(size=(150, 2))})
    got = P.preprocess(p, 1000, P.preset("default"))
    assert got.steps == ("dc_removal", "bandpass", "notch", "rectify", "envelope", "normalize")
    assert {k: x.shape for k, x in back(got.panel).items()} == {1: (200, 2), 2: (150, 2)}
    assert np.isclose(max(np.abs(x).max() for x in back(got.panel).values()), 1)
    skip = P.preprocess(p, 1000, {"rectify": False, "dc_removal": {"method": "median"}})
    assert skip.steps == ("dc_removal",)
    with pytest.raises(ValueError):
        P.preprocess(p, 1000, P.preset("gait"))
    assert P.preset("unknown") is None and set(P.PRESETS) == {"default", "gait", "isometric", "fine_motor"}


def uneven(seed=0):
    """Series of several lengths, two channels, some values missing."""
    rng, out = np.random.default_rng(seed), {}
    for k, n in enumerate([1, 2, 5, 30, 131, 400, 77]):
        x = rng.normal(size=(n, 2)) * [1, 3] + [2, -1]
        x[rng.random((n, 2)) < 0.1] = np.nan
        out[k] = x
    out[7] = np.full((6, 2), 4.0)
    out[8] = np.full((3, 2), np.nan)
    return out


@pytest.mark.parametrize("name", ["default", "gait", "isometric", "fine_motor", "other", "plain"])
def test_one_pass_like_one_step_after_another(spark, monkeypatch, name):
    from strandmix.operators import preprocess

    p = panel(spark, uneven())
    more = {"other": {"dc_removal": {"method": "polynomial", "degree": 2}, "envelope": {"method": "moving_average", "window_ms": 6}, "normalize": {"method": "zscore"}}, "plain": {"dc_removal": {"method": "median"}, "rectify": {"method": "half_wave"}, "normalize": {"method": "range"}}}
    steps = P.preset(name) or more[name]
    steps = {k: v | {"high": 450} if k == "bandpass" else v for k, v in steps.items()}
    reference = P.mvc_reference(panel(spark, {k: x for k, x in uneven(1).items() if k % 2}))
    whole = back(P.preprocess(p, 1000, steps, reference).panel)
    monkeypatch.setattr(preprocess, "WHOLE", 0)
    parts = back(P.preprocess(p, 1000, steps, reference).panel)
    assert set(whole) == set(parts) == set(uneven())
    for k in whole:
        assert np.allclose(whole[k], parts[k], atol=1e-9, equal_nan=True), (k, whole[k][:5], parts[k][:5])


@pytest.mark.parametrize("zero_phase,size", [(True, 1), (True, 40), (True, 10_000), (False, 7), (False, 100)])
def test_filters_in_blocks_like_whole_series(spark, zero_phase, size):
    from strandmix.operators import series as R

    given = uneven(3)
    for sections in (iir.design("butterworth", 4, "band", (20, 450), 1000), P.notch_sections(1000)[:4]):
        got = back(R.filtered_in_blocks(panel(spark, given), sections, zero_phase, size))
        for k, x in given.items():
            want = (iir.filtfilt if zero_phase else iir.sosfilt)(sections, x)
            assert got[k].shape == want.shape and np.allclose(got[k], want, atol=1e-9, equal_nan=True), k


def test_long_series_go_by_blocks(spark, monkeypatch):
    from strandmix.operators import series as R

    p, sections = panel(spark, uneven(2)), P.lowpass_sections(1000)
    want = back(R.filtered(p, sections, True))
    monkeypatch.setattr(R, "WHOLE", 0)
    got = back(R.filtered(p, sections, True))
    assert all(np.allclose(got[k], want[k], atol=1e-9, equal_nan=True) for k in want)


def rows_by_task(df):
    return sorted(df.withColumn("task", F.spark_partition_id()).toPandas()["task"].value_counts())  # whole rows, so that nothing is pruned


def test_one_hot_subject_is_on_all_tasks(spark):
    """A subject with all rows: numbered, filtered and smoothed with no task that has twice the usual rows."""
    from strandmix.operators import blocks
    from strandmix.operators import series as R

    n = 24_000
    raw = spark.range(n, numPartitions=4).select((F.col("id") % 1 + 7).alias("s"), F.col("id").alias("k"), F.sin(F.col("id") / 9).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tasks are counted as planned
    try:
        p = bind_spread(raw, "s", ["k"], {"x": "v"}, 64)
        numbered = rows_by_task(p.df)
        smooth = blocks.over_neighbours(p, 5, 5, lambda w: [F.avg("x").over(w.rowsBetween(-5, 5)).alias("x")], size=200)
        filtered = R.filtered_in_blocks(p, P.lowpass_sections(1000), True, 200).df
        for found in (numbered, rows_by_task(smooth), rows_by_task(filtered)):
            assert sum(found) == n and len(found) == 4 and found[-1] < 2 * np.median(found), found
        x = np.sin(np.arange(n) / 9)
        got = np.array([r.x for r in filtered.orderBy("t").collect()])
        assert np.allclose(got, iir.filtfilt(P.lowpass_sections(1000), x[:, None])[:, 0], atol=1e-9)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_windows_with_halos_like_windows_of_whole_series(spark, size):
    from pyspark.sql import Window as W

    from strandmix.operators import blocks

    p = panel(spark, uneven(2))
    whole = W.partitionBy("subject_id").orderBy("t")
    for behind, ahead in ((3, 3), (2, 0), (0, 4), (0, 0), (50, 1)):
        columns = lambda w, a=behind, b=ahead: [F.sum(c).over(w.rowsBetween(-a, b)).alias(c) for c in p.channels] + [F.count(p.channels[0]).over(w.rowsBetween(-a, b)).alias("n")]
        got = blocks.over_neighbours(p, behind, ahead, columns, size)
        want = p.df.select("subject_id", "t", *columns(whole))
        key = lambda df: sorted((r.subject_id, r.t, r.n, *(None if v is None else round(v, 9) + 0.0 for v in r[2:-1])) for r in df.collect())
        assert key(got) == key(want)


@pytest.mark.parametrize("buckets", [1, 5, 300])
def test_spread_row_numbers_like_those_of_a_window(spark, buckets):
    rows = [(k % 4 if k % 11 else None, datetime(2024, 1, 1 + (k * 7) % 20, k % 24), k, float(k)) for k in range(500)] + [(1, datetime(2024, 1, 5), 900 + k, 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "s long, ts timestamp, e long, v double").repartition(3)
    key = lambda p: sorted((r.subject_id or -1, r.t, r.x) for r in p.df.collect())
    assert key(bind_spread(df, "s", ["ts", "e"], {"x": "v"}, buckets)) == key(bind(df, "s", ["ts", "e"], {"x": "v"}))
    assert bind_spread(df.limit(0), "s", ["ts", "e"], {"x": "v"}).df.count() == 0


def test_series_without_a_subject_or_rows(spark):
    from strandmix.operators import series as R

    rows = [(None, 1, 1.0), (None, 2, None), (3, 1, 2.0)]
    p = Panel(spark.createDataFrame(rows, "subject_id long, t int, x double"), ("x",))
    sections = iir.design("butterworth", 2, "low", (50,), 1000)
    for got in (R.filtered(p, sections, True), R.filtered_in_blocks(p, sections, True)):
        assert sorted((r.subject_id or 0, r.t, r.x is None) for r in got.df.collect()) == [(0, 1, False), (0, 2, True), (3, 1, False)]
        assert got.df.schema == p.df.schema
    none = p.with_df(p.df.limit(0))
    assert R.filtered(none, sections, True).df.count() == R.filtered_in_blocks(none, sections, True).df.count() == 0


def test_a_pipeline_shuffles_a_bound_panel_once(spark):
    rows = spark.createDataFrame([(k % 3, k, float(k)) for k in range(90)], "s long, k int, v double")
    got = P.preprocess(bind(rows, "s", ["k"], {"x": "v"}), 1000, P.preset("default")).panel.df
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(subject_id") == 1 and plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
    assert got.count() == 90


@pytest.mark.parametrize("buckets", [4096, 3])
def test_medians_like_sorted_values(spark, monkeypatch, buckets):
    from strandmix.operators import medians as Q

    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(5)
    groups = {(1, "a"): rng.normal(size=501), (1, "b"): rng.integers(0, 3, 400).astype(float), (2, "a"): np.array([4.0]), (2, "b"): np.full(50, -1.5), (3, "a"): np.exp(rng.normal(0, 20, 300)), (3, "b"): np.array([1.0, 2.0])}
    rows = [(k, c, float(v)) for (k, c), x in groups.items() for v in x] + [(1, "a", None), (4, "a", None)] + [(None, "a", float(v)) for v in (5, 1, 9)]
    got = {(r.subject_id, r.channel): r.median for r in Q.medians(spark.createDataFrame(rows, "subject_id long, channel string, value double").repartition(3)).collect()}
    assert set(got) == {*groups, (None, "a")} and got[None, "a"] == 5
    assert all(np.isclose(got[k], np.median(x), rtol=1e-12) for k, x in groups.items())


def test_medians_of_long_series_like_those_of_short_ones(spark, monkeypatch):
    from strandmix.operators import preprocess

    p = panel(spark, uneven(7))
    short = [back(P.remove_offset(p, "median")), back(P.normalize(p, "median"))]
    monkeypatch.setattr(preprocess, "WHOLE", 0)
    for a, b in zip(short, [back(P.remove_offset(p, "median")), back(P.normalize(p, "median"))]):
        assert all(np.allclose(a[k], b[k], atol=1e-12, equal_nan=True) for k in a) and set(a) == set(b)


@pytest.mark.parametrize("percent", [5, 40, 100])
def test_largest_of_long_series_like_those_of_short_ones(spark, monkeypatch, percent):
    from strandmix.operators import preprocess

    p = panel(spark, {k: np.round(x, 1) for k, x in uneven(9).items()})
    key = lambda df: {(r.subject_id, r.channel): r.reference for r in df.collect()}
    short = key(P.mvc_reference(p, "mean_peak", top_percent=percent))
    monkeypatch.setattr(preprocess, "WHOLE", 0)
    long = key(P.mvc_reference(p, "mean_peak", top_percent=percent))
    assert set(short) == set(long) and all(np.isclose(short[k], long[k]) for k in short)


def test_checks():
    assert checks.renamed({"nIterFA": 3, "tol": 1}) == {"iter_fa": 3, "tol": 1}
    assert checks.model_type("MFA") == "mfa"
    for call in (lambda: checks.model_type("x"), lambda: checks.model_params(0, 1), lambda: checks.model_params(1, 1.5), lambda: checks.model_params(1, 1, tol=0), lambda: checks.fits_data(3, 2, 1, 1), lambda: checks.fits_data(1, 2, 3, 2)):
        with pytest.raises(ValueError):
            call()


def test_panels_without_channels_or_subjects(spark):
    p = panel(spark, {1: [1.0]})
    with pytest.raises(ValueError):
        check_panel(Panel(p.df, ()))
    with pytest.raises(ValueError):
        check_panel(p, min_subjects=2)
    with pytest.raises(ValueError):
        check_panel(Panel(p.df, ("subject_id",)))
