"""Every query against its SQL, runs of sweeps, streams, and the entry points."""

import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__
from strandmix.operators import sweeps as W
from strandmix.plans import catalog
from tests.conftest import DATA, ROOT

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, records):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None or v != v else f"{v:+.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert df.columns and got
    if name in catalog.oracle_sql():
        want = db.execute(catalog.oracle_sql()[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2


def test_without_the_text_operators(tmp_path):
    """The library and its entry points work when that subpackage and the pipeline are gone."""
    import shutil

    for x in ("strandmix", "jobs", "__spark_entry__.py"):
        (shutil.copy if x.endswith(".py") else shutil.copytree)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "strandmix/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)


def test_text_operators_that_lack_a_module_are_left_out(tmp_path):
    """What is there but can't be imported doesn't take the other queries down; a warning says why."""
    import shutil

    shutil.copytree(f"{ROOT}/strandmix", tmp_path / "strandmix")
    shutil.copytree(f"{ROOT}/jobs", tmp_path / "jobs")
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("run = ORACLE_SQL = None\n")
    (tmp_path / "strandmix/llm").mkdir(exist_ok=True)
    (tmp_path / "strandmix/llm/__init__.py").write_text("")
    (tmp_path / "strandmix/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e\nq = e.queries()\nassert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120, capture_output=True, text=True)
    assert done.returncode == 0 and "a_module_that_is_not_there" in done.stderr


def test_failed_runs_are_rows(spark):
    def run(config):
        if config["seed"] == 2:
            raise RuntimeError("no")
        return [{"model_type": "x", "Method": "m", "BIC": 1.0}]

    got = W.run_grid(W.param_grid(spark, "test"), run, W.BASELINE_SCHEMA, 3).collect()
    assert len(got) == 16 and sum(r.error_msg == "RuntimeError: no" for r in got) == 8 and all(r.N == 20 for r in got)


def test_a_sweep_goes_on_where_it_was_stopped(spark, tmp_path):
    """Runs leave files that say they were made, so what was made again shows."""
    made, path = str(tmp_path / "made"), str(tmp_path / "out")
    import os

    os.mkdir(made)

    def run(config, stop=None, bad=()):
        number = config["run_id"]
        if stop and number >= stop:
            os._exit(3)  # the worker dies
        with open(f"{made}/{number}", "a") as f:
            f.write("x")
        if number in bad:
            raise ValueError("no")
        return [{"model_type": "x", "Method": m, "BIC": float(number)} for m in ("a", "b")]

    grid = W.param_grid(spark, "test")
    from functools import partial

    with pytest.raises(Exception):  # noqa: B017
        W.resumed_grid(grid, partial(run, stop=9), W.BASELINE_SCHEMA, path, 2, chunk=4)
    first = spark.read.parquet(path)
    assert sorted({r.run_id for r in first.collect()}) == list(range(1, 9))
    times = lambda: {int(k): len(open(f"{made}/{k}").read()) for k in os.listdir(made)}
    before = {k: v for k, v in times().items() if k <= 8}
    got = W.resumed_grid(grid, partial(run, bad=(11, 12)), W.BASELINE_SCHEMA, path, 2, chunk=4)
    assert got.where("error_msg = ''").count() == 28 and {r.run_id for r in got.where("error_msg != ''").collect()} == {11, 12}
    assert {k: v for k, v in times().items() if k <= 8} == before  # finished runs aren't made again
    again = W.resumed_grid(grid, partial(run, bad=(12,)), W.BASELINE_SCHEMA, path, 2, chunk=4, attempts=2)
    rows = {(r.run_id, r.Method): (r.error_msg, r.attempt) for r in again.collect()}
    assert rows[11, "a"] == ("", 2) and rows[12, None] == ("ValueError: no", 2) and len(rows) == 31
    W.resumed_grid(grid, run, W.BASELINE_SCHEMA, path, 2, attempts=2)
    assert times()[12] == 2  # it has failed twice
    assert W.resumed_grid(grid, run, W.BASELINE_SCHEMA, path, 2).where("error_msg != ''").count() == 0 and times()[12] == 3
    plain = W.run_grid(grid, run, W.BASELINE_SCHEMA, 2).drop("attempt")
    key = lambda df: sorted((r.run_id, r.Method, r.BIC, r.N, r.seed) for r in df.collect())
    assert key(spark.read.parquet(path)) == key(plain)


def test_grids_number_the_first_axis_fastest(spark):
    got = W.param_grid(spark, "full").orderBy("run_id").limit(4).collect()
    assert [(r.N, r.K) for r in got] == [(20, 2), (30, 2), (50, 2), (20, 3)]


def test_results_round_trip(spark, tmp_path):
    from strandmix.sources import results as R

    a = spark.createDataFrame([(1, 0.5)], "run_id int, ARI double")
    b = spark.createDataFrame([(2, "x")], "run_id int, note string")
    R.save_results(a, str(tmp_path / "a"))
    R.save_results(b, str(tmp_path / "b"), csv=False)
    got = R.read_all_results(spark, str(tmp_path / "a/parquet"), str(tmp_path / "b/parquet"), str(tmp_path / "none"))
    assert {(r.run_id, r.ARI, r.note) for r in got.collect()} == {(1, 0.5, None), (2, None, "x")} and "file" in got.columns
    with pytest.raises(ValueError):
        R.read_all_results(spark, str(tmp_path / "none"))


def test_modes_and_candidates_of_selection_runs(spark):
    config = {"N": 12, "K": 2, "r": 2, "M": 6, "T_each": 60, "cluster_sep_spatial": 1.0, "cluster_sep_temporal": 1.0, "cluster_sep_stability": 1.0, "seed": 3}
    free = W.modelsel_run(config, methods=("mpca",), strategies=("grid",), ks=(1, 3), rs=(1,))
    assert free[0]["K_hat"] in (1, 3) and free[0]["r_hat"] == 1 and not free[0]["K_correct"] and free[0]["r_mode"] == "select"
    told = W.modelsel_run(config, "oracle_r", methods=("mpca",), ks=(1, 2))
    assert all(x["r_hat"] == 2 and x["r_correct"] and x["mode"] == "oracle_r" for x in told) and len(told) == 2
    assert all(x["Kr_correct"] for x in W.modelsel_run(config, "oracle_Kr", methods=("mpca",)))
    with pytest.raises(ValueError):
        W.modelsel_run(config, "other")
    # The same panel with another truth in its configuration has the same candidates.
    rows = W.kselect_run({"N": 12, "K_true": 4, "r_true": 2, "M": 6, "T_each": 40, "cluster_sep_spatial": 1.0, "cluster_sep_temporal": 1.0, "cluster_sep_stability": 1.0, "seed": 3}, ks=(2, 3))
    assert {x["method"] for x in rows} == {"BIC", "ICL_T1", "ICL_T2", "ICL_T3", "Ensemble"} and all(x["K_hat"] in (2, 3) and not x["K_correct"] for x in rows)
    assert W.vote([3, 2, 3]) == 3 and W.vote([4, 2, 3]) == 2


def test_end_of_a_sweep(spark, tmp_path):
    with pytest.raises(ValueError):
        W.compare_simulated(spark, ("static",))
    raw = W.compare_simulated(spark, n=8, k=2, r=1, m=4, length=30, seeds=(1, 2)).persist()
    out = W.finish(raw, str(tmp_path / "out"))
    assert out["raw"].count() == raw.count() == 12 and {r.n_reps for r in out["aggregated"].collect()} <= {1, 2}
    assert {r.metric for r in out["win_rates"].collect()} == {"ARI", "BIC", "VAF", "SSE"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/aggregated/csv")).count() == out["aggregated"].count()
    # What tasks left in a folder, one file a run.
    for k, seed in enumerate((1, 2)):
        raw.where(f"seed = {seed}").coalesce(1).write.parquet(str(tmp_path / f"part/task{k}.parquet"))
    with pytest.raises(ValueError):
        W.aggregate_partial_results(spark, str(tmp_path / "part"), remove_partial=True)
    again = W.aggregate_partial_results(spark, str(tmp_path / "part"), path=str(tmp_path / "all"), remove_partial=True)
    key = lambda df: sorted((r.Method, r.n_reps, round(r.SSE_mean, 6)) for r in df.collect())
    assert key(again["aggregated"]) == key(out["aggregated"])
    assert not list((tmp_path / "part").glob("*/*.parquet"))
    failed = spark.createDataFrame([(1, "x")], "run_id int, error_msg string").join(raw.drop("run_id", "error_msg").limit(1))
    assert W.finish(raw.unionByName(failed.select(raw.columns)))["aggregated"].count() == out["aggregated"].count()


def test_streams_like_batches(spark, tmp_path):
    from strandmix.streaming import panels as T

    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "user_id long, ts timestamp, value double"
    for name, make in (("moments", lambda df: T.windowed_moments(df, "user_id", "ts", ["value"])), ("sessions", lambda df: T.sessions(df, "user_id", "ts", "value"))):
        stream = T.read_panel_stream(spark, str(tmp_path / "in"), schema)
        q = make(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        key = lambda r: (r.subject_id, r.start, r.n)
        assert sorted(map(key, spark.table(name).collect())) == sorted(map(key, make(events).collect()))


def test_compute_win_rates_counts_ties_for_all(spark):
    agg = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "y", 1, 0.5), ("a", "x", 2, 0.9), ("a", "y", 2, None)], "model_type string, Method string, N int, ARI_mean double")
    got = {r.Method: (r.n_wins, r.win_rate) for r in W.win_rates(agg).collect()}
    assert got == {"x": (2, 100.0), "y": (1, 50.0)}
    with pytest.raises(ValueError):
        W.win_rates(agg, "BIC")


def test_projection_reads_only_its_columns(spark):
    from strandmix.operators import suffstats as S
    from strandmix.sources import panel as A

    plan = S.subject_moments(A.lines_panel(spark, SF, False))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan
    assert np.isfinite(plan.count("Exchange hashpartitioning")) and plan.count("Window") == 0
