"""Both jobs: against their SQL, over growing input, after failures, and from the command line."""

import json
import math
import os
import subprocess
import sys
from collections import defaultdict
from datetime import datetime

import duckdb
import pytest

from jobs import common, conversation_report, daily_amplitudes
from jobs.queries import ORACLE, QUERIES
from tests.conftest import DATA, ROOT
from tests.test_queries import rows as shown

SF = f"{DATA}/sf0.001"
SCHEMA = "user_id long, ts timestamp_ntz, value double, more string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns) and spark.conf.get("spark.sql.session.timeZone") == before
    assert shown(got.columns, [tuple(x) for x in got.collect()]) == shown(names, want.fetchall())


def record(spark, folder, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(folder)


def signal(first, n, days=3, subjects=4):
    return [(i % subjects, datetime(2024, 3, 1 + i % days, i % 24, i % 60), ((i * 37) % 101 - 50) / 7, "x") for i in range(first, first + n)]


def plainly(rows):
    own = defaultdict(list)
    for subject, time, value, _ in rows:
        if subject is not None and time is not None:
            own[f"{time:%Y-%m-%d}", subject].append(value)
    out = {}
    for key, values in own.items():
        x = [round(v, 6) for v in values if v is not None and math.isfinite(v) and abs(v) < 1e12]
        mean = lambda y: sum(y) / len(y) if y else None
        m, q = mean(x), mean([v * v for v in x])
        out[key] = (len(values), len(values) - len(x), *(None if v is None else round(v, 6) for v in (mean([abs(v) for v in x]), q and math.sqrt(q), None if m is None else max(q - m * m, 0))))
    return out


def stored(spark, out):
    t = spark.read.schema(daily_amplitudes.AMPLITUDES).parquet(f"{out}/amplitudes").collect()
    found = {(r.day, r.subject_id): (r.n, r.n_missing, *(None if v is None else round(v, 6) for v in (r.mean_abs, r.rms, r.variance))) for r in t}
    assert len(found) == len(t)
    return found


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert all((x is None and y is None) or x == pytest.approx(y, abs=2e-6) for x, y in zip(a[k], b[k])), (k, a[k], b[k])


def test_growing_recordings(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first, second, late = signal(0, 300), signal(300, 100, days=5), [(9, datetime(2024, 2, 1), 3.5, "x")]
    run = lambda **config: daily_amplitudes.run(spark, source, out, mark, config)
    record(spark, source, first, 3)
    assert run(files_per_batch=1) == {"rows_read": 300, "days_written": 3}
    close(stored(spark, out), plainly(first))
    record(spark, source, second, 2)
    assert run() == {"rows_read": 100, "days_written": 5}
    close(stored(spark, out), plainly(first + second))
    files = lambda day: sorted(os.listdir(f"{out}/amplitudes/day={day}"))
    before = files("2024-03-02")
    assert run() == {"rows_read": 0, "days_written": 0}
    record(spark, source, late)
    assert run() == {"rows_read": 1, "days_written": 1}  # a late file costs its own day
    close(stored(spark, out), plainly(first + second + late))
    assert files("2024-03-02") == before


def test_values_that_are_none(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    day = datetime(2024, 1, 2, 3)
    rows = [(1, day, None, None), (1, day, float("nan"), None), (1, day, 1e300, None), (1, day, float("-inf"), None), (2, day, None, None), (None, day, 1.0, None), (3, None, 1.0, None), (4, day, -2.0, None), (4, day, -2.0, None)]
    record(spark, source, rows)
    daily_amplitudes.run(spark, source, out, mark)
    close(stored(spark, out), plainly(rows))
    assert stored(spark, out)["2024-01-02", 2] == (1, 1, None, None, None)


def test_a_run_that_was_killed_is_completed(spark, tmp_path, monkeypatch):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = signal(0, 200)
    record(spark, source, rows[:150])
    daily_amplitudes.run(spark, source, out, mark)
    record(spark, source, rows[150:])
    monkeypatch.setattr(daily_amplitudes, "amplitudes", lambda parts: 1 / 0)  # sums are written, amplitudes not
    with pytest.raises(ZeroDivisionError):
        daily_amplitudes.run(spark, source, out, mark)
    monkeypatch.undo()
    assert daily_amplitudes.run(spark, source, out, mark) == {"rows_read": 0, "days_written": 3}
    close(stored(spark, out), plainly(rows))
    # A batch whose sums were written but not yet marked is run again, into the same partitions.
    done = f"{mark}/commits/1"
    for name in (done, f"{mark}/commits/.1.crc"):
        os.remove(name)
    daily_amplitudes.run(spark, source, out, mark)
    close(stored(spark, out), plainly(rows))


def test_unknown_configuration(spark, tmp_path):
    with pytest.raises(ValueError, match="subjct"):
        daily_amplitudes.run(spark, "in", "out", "mark", {"subjct": "x"})
    with pytest.raises(ValueError, match="profiles"):
        conversation_report.run(spark, "in", "out", {"profiles": {"a": [1.0]}})


TURNS = "conv_id long, turn long, role string, text string, extra int, subject_id int, profile string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in rows], TURNS)


def test_conversations_of_any_kind(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, 0, "user", "what is 2 + 2?"), (1, 1, "assistant", "4"), (1, 2, "user", "really?!"), (2, 0, "user", None), (3, 0, "user", ""), (None, 0, "user", "lost"), (4, 0, "user", "long " * 50_000), (4, 0, "user", "long " * 50_000), (5, None, None, "x")]
    turns(spark, rows).write.parquet(source)
    got = conversation_report.run(spark, source, out, {"limit": 1.4})
    assert got["conversations"] == 5 and got["turns"] == 8
    first = {r.subject_id: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert first[1].turns == 3 and first[1].penalty > 0 and first[4].flagged and first[2].mean_chars is None and first[2].profile == "plain"
    conversation_report.run(spark, source, out, {"limit": 1.4})
    assert {r.subject_id: r for r in spark.read.parquet(f"{out}/report").collect()} == first
    summary = spark.read.json(f"{out}/summary").collect()
    assert sum(r.conversations for r in summary) == 5 and {r.profile for r in summary} == {r.profile for r in first.values()}
    turns(spark, []).write.parquet(str(tmp_path / "none"))
    assert conversation_report.run(spark, str(tmp_path / "none"), str(tmp_path / "empty")) == {"conversations": 0, "turns": 0, "flagged": 0}


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    with pytest.raises(RuntimeError), common.settings(spark, spark__sql__session__timeZone="Asia/Tokyo", strandmix__nothing="1"):
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        raise RuntimeError
    assert spark.conf.get("spark.sql.session.timeZone") == before and spark.conf.get("strandmix.nothing", None) is None


@pytest.mark.parametrize("job,paths", [("daily_amplitudes", ["source", "output", "checkpoint"]), ("conversation_report", ["source", "output"])])
def test_command_line(spark, tmp_path, job, paths):
    if job == "daily_amplitudes":
        record(spark, str(tmp_path / "source"), signal(0, 50))
    else:
        turns(spark, [(1, 0, "user", "a b"), (2, 0, "user", "c?")]).write.parquet(str(tmp_path / "source"))
    call = [sys.executable, "-m", f"jobs.{job}", "--config", f"{ROOT}/jobs/{job}.json", *(x for p in paths for x in (f"--{p}", str(tmp_path / p)))]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=240, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path / "local")})
    assert done.returncode == 0, done.stderr[-2000:]
    figures = json.loads(done.stdout.strip().splitlines()[-1])
    assert figures == ({"rows_read": 50, "days_written": 3} if job == "daily_amplitudes" else {"conversations": 2, "turns": 2, "flagged": 0})
    assert "read" in done.stderr and "wrote" in done.stderr


def test_jobs_know_nothing_of_the_text_operators():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            text = open(f"{ROOT}/jobs/{name}").read()
            assert "llm" not in text and "corpus_pipeline" not in text
