"""A report on conversations as multichannel series: one channel value a turn, standardised over all turns.

Each turn gives four channels, logarithms of its characters, words, digits and question or exclamation marks. A conversation's figures
are its channels' means and variances, and the smoothness penalty (the sum of squared second differences over turns), as for any other
panel. Its profile is the nearest of the configured ones by its means; conversations with a mean beyond the limit are flagged. The report is
written by profile, a summary of the profiles as JSON beside it.

A run overwrites report and summary as wholes, so a run again gives the same. Turns are ordered by turn, role and text, so the order is
total but for equal rows. A null text has null channels, which the figures leave out; a conversation without any text has null figures
and the first profile. Rows without a conversation are left out.

    python -m jobs.conversation_report --source IN --output OUT --config jobs/conversation_report.json
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log, with_defaults
from strandmix.operators import suffstats as S
from strandmix.sources import panel as A

CHANNELS = ("chars", "words", "digits", "marks")

#: Columns of the turns; deviations from which on a mean is flagged; profiles as means of the standardised channels, in their order.
DEFAULTS = {
    "conversation": "conv_id",
    "order": ["turn", "role", "text"],
    "text": "text",
    "limit": 1.5,
    "profiles": {"plain": [0.0, 0.0, 0.0, 0.0], "brief": [-1.0, -1.0, -0.5, -0.5], "long": [1.0, 1.0, 0.0, 0.0], "numeric": [0.0, 0.0, 1.5, 0.0], "asking": [0.0, 0.0, 0.0, 1.5]},
}


def channels(text: Column) -> dict[str, Column]:
    """Of one turn."""
    left = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    words = F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != ""))
    return dict(zip(CHANNELS, (F.log1p(x.cast("double")) for x in (F.length(text), F.when(text.isNotNull(), words), left("[0-9]"), left("[?!]")))))


def standardised(panel: A.Panel) -> A.Panel:
    """Channels less their mean over all rows, in standard deviations; 0 where they don't differ. One row of figures comes to the driver."""
    figures = panel.df.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in panel.channels for f in (F.avg, F.stddev_samp))).first()
    scaled = lambda c: (F.col(c) - F.lit(figures[f"{c}_avg"] or 0.0)) / F.lit(figures[f"{c}_stddev_samp"] or 1.0)
    return panel.with_df(panel.df.withColumns({c: scaled(c) for c in panel.channels}), True)


def report(turns: DataFrame, config: dict) -> DataFrame:
    """A row per conversation."""
    text = F.col(config["text"]).cast("string")
    panel = standardised(A.bind(turns.where(F.col(config["conversation"]).isNotNull()), config["conversation"], config["order"], channels(text)))
    figures = panel.df.groupBy("subject_id").agg(F.count("*").alias("turns")).join(S.mean_variance_features(panel), "subject_id").join(S.smoothness(panel), "subject_id")
    means = [F.coalesce(F.col(f"mean_{c}"), F.lit(0.0)) for c in CHANNELS]
    apart = F.array(*(F.struct(sum(((m - F.lit(float(v))) * (m - F.lit(float(v))) for m, v in zip(means, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, centre) in enumerate(config["profiles"].items())))
    flagged = F.greatest(*(F.abs(m) for m in means)) > config["limit"]
    return figures.select("subject_id", "turns", *(f"{f}_{c}" for f in ("mean", "var") for c in CHANNELS), F.col("penalty"), flagged.alias("flagged"), F.array_min(apart)["name"].alias("profile"))


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Write the report on the turns at ``source``; the figures that were logged."""
    config = with_defaults(config, DEFAULTS)
    if any(len(x) != len(CHANNELS) for x in config["profiles"].values()) or not config["profiles"]:
        raise ValueError(f"profiles need {len(CHANNELS)} means each")
    found = report(spark.read.parquet(source), config)
    found.hint("rebalance", "profile").write.mode("overwrite").partitionBy("profile").parquet(f"{output}/report")
    written = spark.read.schema(found.schema).parquet(f"{output}/report")
    counts = written.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.count_if("flagged").alias("flagged")).first().asDict()
    log.info("read %d turns of %d conversations from %s", counts["turns"], counts["conversations"], source)
    summary = written.groupBy("profile").agg(F.count("*").alias("conversations"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg("turns").alias("turns"), F.avg("penalty").alias("penalty"))
    summary.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    log.info("wrote %s/report and %s/summary, %d flagged", output, output, counts["flagged"])
    return counts


def main(argv: list[str] | None = None) -> int:
    return command_line(run, __doc__.splitlines()[0], ["source", "output"], argv)


if __name__ == "__main__":
    raise SystemExit(main())
