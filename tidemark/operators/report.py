"""Reports over runs: outcome rates, usage, failures, the newest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dashboard(runs: DataFrame) -> DataFrame:
    """One row: counts and rates of outcomes, mean time of runs that weren't cached, translation and audio usage."""
    n = lambda test: F.count_if(test).cast("long")
    prepared, failed = n(F.col("outcome") != "cached"), n(F.col("outcome") == "failed")
    return runs.agg(
        F.count("*").alias("runs"), prepared.alias("prepared"), failed.alias("failed"), F.round((prepared - failed) / prepared, 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("outcome") != "cached", F.col("total_ms"))), 6).alias("cold_ms"),
        n((F.col("outcome") == "translated") & F.col("cues").isNotNull()).alias("translations"), F.sum(F.when(F.col("outcome") == "translated", F.col("cues"))).cast("long").alias("cues"),
        F.sum("transcripts").cast("long").alias("transcripts"), n(F.col("transcripts") == 0).alias("reused"))


def failure_reasons(runs: DataFrame) -> DataFrame:
    """(reason, n, position): most frequent first, ties by first occurrence."""
    reasons = runs.where("outcome = 'failed'").groupBy(F.coalesce("failure", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"), F.min(F.struct("at_ms", "run_id")).alias("first"))
    order = Window.orderBy(F.desc("n"), "first")  # one row for each reason
    return reasons.select("reason", "n", F.row_number().over(order).alias("position"))


def newest_runs(runs: DataFrame, keep: int = 25) -> DataFrame:
    """The ring buffer's content: the newest runs."""
    return runs.orderBy(F.desc("at_ms"), F.desc("run_id")).limit(keep).select("run_id", "at_ms", "outcome", "total_ms")
