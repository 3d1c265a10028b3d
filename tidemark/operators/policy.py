"""Small policies as expressions: sample lengths, waiting times, banners over cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest sample in seconds; first and longest wait; where a banner stands, its least length and its distance from the first cue, in ms.
SHORTEST_SAMPLE = 8
FIRST_WAIT, LONGEST_WAIT = 250, 30_000
BANNER_START, BANNER_END, BANNER_LEAST, BANNER_CLEAR = 300, 6300, 1500, 200


def sample_seconds(wanted: int, windows: int, budget_bytes: int, rate: Column) -> Column:
    """Seconds per window that the byte budget allows; the wanted length where the rate (bytes per second) is unknown."""
    return F.when(rate > 0, F.greatest(F.lit(SHORTEST_SAMPLE), F.least(F.lit(wanted), F.floor(F.lit(budget_bytes / windows) / rate)))).otherwise(wanted).cast("int")


def wait_ms(attempt: Column) -> Column:
    """Before the next try, without its random part: doubles with every attempt."""
    return F.least(F.lit(LONGEST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def banners(cues: DataFrame) -> DataFrame:
    """(track_id, start_ms, end_ms): where a banner fits before a track's first cue."""
    first = cues.groupBy("track_id").agg(F.min("start_ms").alias("first"))
    end = F.least(F.lit(BANNER_END), F.col("first") - BANNER_CLEAR)
    return first.where(end - BANNER_START >= BANNER_LEAST).select("track_id", F.lit(BANNER_START).cast("long").alias("start_ms"), end.cast("long").alias("end_ms"))
