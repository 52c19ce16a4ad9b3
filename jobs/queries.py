"""The jobs as queries: each runs its job twice into a new folder and returns the output as it stands then."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import conversation_report, daily_amplitudes
from strandmix.plans.registry import r, rounded


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that the session names in spark.checkpoint.dir; where that is unset, as in tests, a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="strandmix-jobs-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_daily_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        daily_amplitudes.run(spark, f"{sf_dir}/events.parque[t]", f"{folder}/out", f"{folder}/mark")
    return rounded(spark.read.schema(daily_amplitudes.AMPLITUDES).parquet(f"{folder}/out/amplitudes"))


def job2_conversation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        conversation_report.run(spark, f"{sf_dir}/conversations.parquet", folder)
    return rounded(spark.read.parquet(f"{folder}/report"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_daily_amplitudes": job1_daily_amplitudes, "job2_conversation_report": job2_conversation_report}

_VALUES = "WITH v AS (SELECT user_id AS subject_id, strftime(ts, '%Y-%m-%d') AS day, CAST(CASE WHEN NOT isnan(value) THEN value END AS DECIMAL(18, 6)) AS x FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_SUMS = "s AS (SELECT subject_id, day, count(*) AS n, count(x) AS present, CAST(sum(x) AS DOUBLE) AS s, CAST(sum(abs(x)) AS DOUBLE) AS a, CAST(sum(CAST(x * x AS DECIMAL(38, 12))) AS DOUBLE) AS q FROM v GROUP BY ALL)"
_TURNS = (
    "WITH c AS (SELECT conv_id AS subject_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t, ln(1 + CAST(length(text) AS DOUBLE)) AS chars, "
    "ln(1 + CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w != '')) AS DOUBLE)) AS words, "
    "ln(1 + CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE)) AS digits, ln(1 + CAST(length(text) - length(regexp_replace(text, '[?!]', '', 'g')) AS DOUBLE)) AS marks FROM conversations WHERE conv_id IS NOT NULL)"
)
_C = conversation_report.CHANNELS
_SCALED = "z AS (SELECT subject_id, t, " + ", ".join(f"({c} - (SELECT avg({c}) FROM c)) / (SELECT CASE WHEN coalesce(stddev_samp({c}), 0) = 0 THEN 1 ELSE stddev_samp({c}) END FROM c) AS {c}" for c in _C) + " FROM c)"
_SECOND = "d AS (SELECT *, " + ", ".join(f"{c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w AS d_{c}" for c in _C) + " FROM z WINDOW w AS (PARTITION BY subject_id ORDER BY t))"
_FIGURES = "f AS (SELECT subject_id, count(*) AS turns, " + ", ".join(f"avg({c}) AS mean_{c}, var_samp({c}) AS var_{c}" for c in _C) + ", coalesce(sum(" + " + ".join(f"coalesce(d_{c} * d_{c}, 0)" for c in _C) + "), 0) AS penalty FROM d GROUP BY 1)"
_PROFILES = conversation_report.DEFAULTS["profiles"]
_APART = {name: " + ".join(f"(coalesce(mean_{c}, 0) - ({v})) ** 2" for c, v in zip(_C, centre)) for name, centre in _PROFILES.items()}
_NEAREST = f"n AS (SELECT *, least({', '.join(_APART.values())}) AS nearest FROM f)"
_CASES = " ".join(f"WHEN {x} = nearest THEN '{name}'" for name, x in _APART.items())

ORACLE: dict[str, str] = {
    "job1_daily_amplitudes": f"{_VALUES}, {_SUMS} SELECT subject_id, n, n - present AS n_missing, {r('a / nullif(present, 0)', 'mean_abs')}, {r('sqrt(q / nullif(present, 0))', 'rms')}, "
    f"{r('greatest(q / nullif(present, 0) - (s / nullif(present, 0)) * (s / nullif(present, 0)), 0.0)', 'variance')}, CAST(0 AS BIGINT) AS through, day FROM s",
    "job2_conversation_report": f"{_TURNS}, {_SCALED}, {_SECOND}, {_FIGURES}, {_NEAREST} SELECT subject_id, turns, {', '.join(r(f'{f}_{c}', f'{f}_{c}') for f in ('mean', 'var') for c in _C)}, {r('penalty', 'penalty')}, "
    f"greatest({', '.join(f'abs(coalesce(mean_{c}, 0))' for c in _C)}) > {conversation_report.DEFAULTS['limit']} AS flagged, CASE {_CASES} END AS profile FROM n",
}
