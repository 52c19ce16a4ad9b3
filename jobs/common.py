"""What both jobs share: their command line, their log, and settings that are put back."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

log = logging.getLogger("strandmix.jobs")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (underscores for dots) that hold within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def with_defaults(config: dict | None, defaults: dict) -> dict:
    """The configuration with defaults for what it lacks; ValueError for names that mean nothing."""
    if unknown := sorted(set(config or {}) - set(defaults)):
        raise ValueError(f"unknown configuration: {', '.join(unknown)}")
    return defaults | (config or {})


def command_line(run: Callable, description: str, paths: list[str], argv: list[str] | None = None) -> int:
    """Run a job with paths from the command line, in a session of its own."""
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help="a path that Spark can reach")
    parser.add_argument("--config", help="a JSON file; what it lacks has defaults")
    given = vars(parser.parse_args(argv))
    config = given.pop("config")
    if config:
        with open(config) as f:
            config = json.load(f)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        print(json.dumps(run(spark, **given, config=config)))
    finally:
        spark.stop()
    return 0
