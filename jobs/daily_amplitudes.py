"""Amplitudes of each subject's signal by day, kept up to date as recordings arrive.

Recordings come as Parquet files in a folder (or by a pattern of paths), in any order and for any day. A file stream with a checkpoint takes each file once. Every
micro-batch adds its sums by day and subject to ``sums/batch=N/day=D``; a batch that is run again after a failure overwrites just its own
partitions. Then the days with sums newer than their amplitudes are summed up over all batches and overwrite ``amplitudes/day=D``. So
a run that was killed anywhere is completed by the next one, a run without new files changes nothing, and a late file costs its own days.

Sums are decimals, so they don't depend on the order of rows or batches. Rows without subject or time are left out; a value that is
null, not a number or beyond ``DECIMAL(18, 6)`` counts as missing. A file that is there twice counts twice.

    python -m jobs.daily_amplitudes --source IN --output OUT --checkpoint MARK --config jobs/daily_amplitudes.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, settings, with_defaults
from strandmix.streaming.panels import read_panel_stream, windowed_moments

#: Names of columns in the recordings; files of a micro-batch, 0 for all that are new.
DEFAULTS = {"subject": "user_id", "time": "ts", "value": "value", "files_per_batch": 0}

VALUE = "decimal(18,6)"
SUMS = "subject_id long, n long, present long, s decimal(38,6), a decimal(38,6), q decimal(38,12), batch long, day string"
AMPLITUDES = "subject_id long, n long, n_missing long, mean_abs double, rms double, variance double, through long, day string"


def sums(rows: DataFrame, config: dict) -> DataFrame:
    """(subject_id, day, n, present, s, a, q): rows, values, and sums of values, sizes and squares."""
    x = F.when(~F.isnan(F.col(config["value"]).cast("double")), F.col(config["value"])).try_cast(VALUE)
    kept = rows.select(F.col(config["subject"]).cast("long").alias("subject"), F.col(config["time"]).alias("time"), x.alias("x")).where("subject IS NOT NULL AND time IS NOT NULL")
    kept = kept.withColumn("a", F.abs("x")).withColumn("c", F.col("x").isNotNull().cast("long"))
    day = F.date_format("start", "yyyy-MM-dd").alias("day")
    found = windowed_moments(kept, "subject", "time", ["x", "a", "c"])
    zero = lambda name, kind: F.coalesce(F.col(name), F.lit(0)).cast(kind)
    return found.select("subject_id", day, "n", zero("s_c", "long").alias("present"), zero("s_x", "decimal(38,6)").alias("s"), zero("s_a", "decimal(38,6)").alias("a"), zero("q_x_x", "decimal(38,12)").alias("q"))


def amplitudes(parts: DataFrame) -> DataFrame:
    """Per subject and day, over the sums of all batches: mean size, root mean square, variance, and the last batch that the subject has rows of."""
    total = parts.groupBy("day", "subject_id").agg(F.sum("n").alias("n"), F.sum("present").alias("present"), *(F.sum(c).cast("double").alias(c) for c in ("s", "a", "q")), F.max("batch").alias("through"))
    mean = lambda c: F.try_divide(F.col(c), F.col("present"))
    variance = F.greatest(mean("q") - mean("s") * mean("s"), F.when(F.col("present") > 0, 0.0))
    return total.select("subject_id", "n", (F.col("n") - F.col("present")).alias("n_missing"), mean("a").alias("mean_abs"), F.sqrt(mean("q")).alias("rms"), variance.alias("variance"), "through", "day")


def stale_days(parts: DataFrame, out: DataFrame) -> list[str]:
    """Days with sums of a batch that their amplitudes don't have yet; one string a day comes to the driver."""
    have = parts.groupBy("day").agg(F.max("batch").alias("last"))
    done = out.groupBy("day").agg(F.max("through").alias("through"))
    found = have.join(done, "day", "left").where("through IS NULL OR through < last")
    return sorted(row.day for row in found.select("day").collect())


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, an empty one at first."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.schema(schema).parquet(path)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new in ``source``; the figures that were logged."""
    config = with_defaults(config, DEFAULTS)

    def take(batch: DataFrame, number: int) -> None:
        found = sums(batch, config).withColumn("batch", F.lit(number).cast("long"))
        kept = found.select(*(F.col(x.split()[0]).cast(x.split(" ", 1)[1]) for x in SUMS.split(", ")))
        kept.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{output}/sums")

    with settings(spark, spark__sql__session__timeZone="UTC"):
        rows = read_panel_stream(spark, source, spark.read.parquet(source).schema, config["files_per_batch"])
        stream = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        read = sum(x["numInputRows"] for x in stream.recentProgress)
        log.info("read %d rows of %s in %d batches", read, source, sum(x["numInputRows"] > 0 for x in stream.recentProgress))
        parts, out = _table(spark, f"{output}/sums", SUMS), _table(spark, f"{output}/amplitudes", AMPLITUDES)
        days = stale_days(parts, out)
        if days:
            amplitudes(parts.where(F.col("day").isin(days))).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/amplitudes")
        log.info("wrote %d days to %s/amplitudes%s", len(days), output, f", from {days[0]} to {days[-1]}" if days else "")
    return {"rows_read": read, "days_written": len(days)}


def main(argv: list[str] | None = None) -> int:
    return command_line(run, __doc__.splitlines()[0], ["source", "output", "checkpoint"], argv)


if __name__ == "__main__":
    raise SystemExit(main())
