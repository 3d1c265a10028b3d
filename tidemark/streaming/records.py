"""A registry of found streams, and shared jobs, as streams with keyed state: values and maps that outlive micro-batches, and timers that end them.

They need the RocksDB state store (spark.sql.streaming.stateStore.providerClass), event times with a watermark, and give a row
for each change. Rows of one micro-batch are taken in order of time; what comes later than the watermark allows is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REFRESH_MS, TTL_MS = 60_000, 6 * 3_600_000
RECORDS = "title string, url string, seen_ms long, hint long, refreshed int, change string"
JOBS = "key string, event_id long, job_id long"


def ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at_ms", "event_id"], kind="stable")


class Records(StatefulProcessor):
    """A title's records by address: a listing refreshes its record, and its hint where it brings one, only if the last refresh is over refresh_ms ago; a record unseen for ttl_ms goes."""

    def __init__(self, refresh_ms: int, ttl_ms: int):
        self.refresh_ms, self.ttl_ms = refresh_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "url string", "seen_ms long, hint long, refreshed int")

    def put(self, url: str, seen: int, hint: int | None, refreshed: int) -> None:
        self.records.updateValue((url,), (seen, hint, refreshed))
        self.handle.registerTimer(seen + self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for url, at, hint in ordered(rows)[["url", "at_ms", "hint"]].astype(object).itertuples(index=False):
            hint = None if pd.isna(hint) else int(hint)
            old = self.records.getValue((url,)) if self.records.containsKey((url,)) else None
            if old is None or at - old[0] >= self.ttl_ms:
                new, change = (int(at), hint, 0), "found"
            elif at - old[0] > self.refresh_ms:
                new, change = (int(at), old[1] if hint is None else hint, old[2] + 1), "refreshed"
            else:
                continue
            self.put(url, *new)
            out.append((key[0], url, *new, change))
        yield self.changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(url[0], *record) for url, record in self.records.iterator() if record[0] + self.ttl_ms <= now]
        for url, *_ in gone:
            self.records.removeKey((url,))
        yield self.changes([(key[0], *g, "expired") for g in gone])

    def changes(self, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
        return frame.astype({"seen_ms": "int64", "hint": "Int64", "refreshed": "int32"})

    def close(self) -> None:
        pass


class Jobs(StatefulProcessor):
    """A key's job: requests share it until one finds it failed, or finished and older than the retention; that one starts the next. A job's outcome comes with the request that starts it."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "job_id long, created_ms long, done_ms long, failed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, out = tuple(self.job.get()) if self.job.exists() else None, []
        for event, at, done, fails in ordered(rows)[["event_id", "at_ms", "done_ms", "fails"]].itertuples(index=False):
            if job is None or (job[2] <= at and (job[3] or at - job[1] > self.retention_ms)):
                job = (int(event), int(at), int(done), bool(fails))
            out.append((key[0], event, job[0]))
        self.job.update(job)
        self.handle.registerTimer(max(job[1] + self.retention_ms, job[2]) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in JOBS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else None
        if job and max(job[1] + self.retention_ms, job[2]) < expiredTimerInfo.getExpiryTimeInMs():
            self.job.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "job_id": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)


def records(listings: DataFrame, late: str = "1 minute", refresh_ms: int = REFRESH_MS, ttl_ms: int = TTL_MS) -> DataFrame:
    """A stream of listings (title, url, at_ms, event_id, hint) to the changes of the registry."""
    return timed(listings, late).groupBy("title").transformWithStateInPandas(Records(refresh_ms, ttl_ms), RECORDS, "Append", "EventTime")


def shared_jobs(asked: DataFrame, late: str = "1 minute", retention_ms: int = TTL_MS) -> DataFrame:
    """A stream of requests (key, event_id, at_ms, done_ms, fails) to the job that serves each of them."""
    return timed(asked, late).groupBy("key").transformWithStateInPandas(Jobs(retention_ms), JOBS, "Append", "EventTime")


def waited_for(requests: DataFrame, selections: DataFrame, wait_ms: int = 12_000, ttl_ms: int = TTL_MS, late: str = "1 minute") -> DataFrame:
    """Streams of requests (request_id, client, at_ms) and selections (client, item, at_ms) to (request_id, item, waited_ms): the selection that stands at the request, else the first within the wait. An interval join of two streams: what neither side can need any more leaves its state."""
    asked = timed(requests, late)
    made = timed(selections.select(F.col("client").alias("of"), "item", "at_ms"), late).select("of", "item", F.col("at_ms").alias("made_ms"), F.col("at").alias("made"))
    ms = lambda n: F.expr(f"INTERVAL {n} MILLISECONDS")
    inside = (F.col("client") == F.col("of")) & (F.col("made") >= F.col("at") - ms(ttl_ms)) & (F.col("made") <= F.col("at") + ms(wait_ms))
    met = asked.join(made, inside)
    one = F.struct("made_ms", "item")
    best = met.groupBy("request_id", "at").agg(F.max(F.when(F.col("made_ms") <= F.col("at_ms"), one)).alias("old"), F.min(F.when(F.col("made_ms") > F.col("at_ms"), one)).alias("new"), F.first("at_ms").alias("at_ms"))
    waited = F.when(F.col("old").isNull(), F.col("new.made_ms") - F.col("at_ms")).otherwise(0)
    return best.select("request_id", F.coalesce("old.item", "new.item").alias("item"), waited.alias("waited_ms"))
