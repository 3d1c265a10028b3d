"""Streams with keyed state and interval joins against their batch twins, replayed in several micro-batches."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.operators import flow
from tidemark.plans import deep, dialect, registry
from tidemark.streaming import records


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", records.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, folder, make, *tables):
    """Rows of the query that make() builds of one stream for each table (cut into parts by time, each a micro-batch of its own), and of its state."""
    streams = []
    for k, (frame, parts) in enumerate(tables):
        path = folder / f"in{k}"
        path.mkdir()
        streams.append(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path)))
    ask = make(*streams).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True)
    for i in range(len(tables[0][1])):
        for k, (frame, parts) in enumerate(tables):
            frame.where(parts[i]).coalesce(1).write.mode("append").parquet(str(folder / f"in{k}"))
        query = ask.start()
        query.awaitTermination()
    return spark.read.parquet(str(folder / "out")), query.lastProgress


def thirds(frame):
    a, b, last = frame.agg(F.percentile("at_ms", 0.3), F.percentile("at_ms", 0.6), F.max("at_ms")).first()
    at = F.col("at_ms")
    return [at <= a, (at > a) & (at <= b), (at > b) & (at <= last), at > last]


def test_registry_replayed(spark, tmp_path):
    """Changes, replayed, end where the batch ends; long after the last one no record is left in state."""
    seen = registry.adapter(spark, SMALL, dialect.visits)
    rows = seen.select((F.col("item") % 5).cast("string").alias("title"), (F.col("client") % 4).cast("string").alias("url"), "at_ms", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("item")).alias("hint"))
    cuts = thirds(rows)
    late = spark.createDataFrame([("end", "x", 4 * 10**12, 10**9, None)], rows.schema)
    out, _ = replay(spark, tmp_path, lambda s: records.records(s, "1 second", 4000, 60_000), (rows.union(late), cuts))
    want = flow.wrapped(rows.select(F.concat_ws("|", "title", "url").alias("key"), "at_ms", "event_id", "hint"), 4000, 60_000)
    changes = out.where("title <> 'end' and change <> 'expired'").withColumn("key", F.concat_ws("|", "title", "url"))
    last = changes.groupBy("key").agg(F.max_by(F.struct("seen_ms", "hint", "refreshed"), "seen_ms").alias("r")).select("key", "r.*")
    assert sorted(map(tuple, last.collect())) == sorted((r.key, r.seen_ms, r.hint, r.refreshed) for r in want.collect())
    open_ = out.where("title <> 'end'").groupBy("title", "url").agg(F.max_by("change", F.struct("seen_ms", (F.col("change") == "expired"))).alias("c"))
    assert {r.c for r in open_.collect()} == {"expired"}


def test_jobs_replayed(spark, tmp_path):
    rows = deep.asked_jobs(spark, SMALL)
    out, _ = replay(spark, tmp_path, lambda s: records.shared_jobs(s, "1 second", 90_000), (rows, thirds(rows)[:3]))
    want = flow.retained_jobs(rows, 90_000)
    assert sorted((r.event_id, r.job_id) for r in out.collect()) == sorted((r.event_id, r.job_id) for r in want.collect())


def test_waits_replayed(spark, tmp_path):
    """The interval join of two streams equals the ordered pass over both, with rows out of order inside each part; rows later than the watermark are left out."""
    seen = registry.adapter(spark, SMALL, dialect.visits).withColumn("client", F.col("client") % 40)
    asked = seen.where("kind <> 'purchase'").select(F.col("event_id").alias("request_id"), "client", "at_ms")
    made = seen.where("kind = 'purchase'").select("client", "item", "at_ms").dropDuplicates(["client", "at_ms"])
    end = 4 * 10**12
    cuts = thirds(asked)
    asked_all = asked.union(spark.createDataFrame([(-1, -1, end)], asked.schema))
    made_all = made.union(spark.createDataFrame([(-1, 0, end)], made.schema))
    out, progress = replay(spark, tmp_path, lambda a, b: records.waited_for(a, b, 12_000, 10**9, "1 second"), (asked_all, cuts), (made_all, cuts))
    want = flow.waited_for(asked, made, 12_000)
    got = {(r.request_id, r.item, r.waited_ms) for r in out.where("request_id >= 0").collect()}
    assert got == {(r.request_id, r.item, r.waited_ms) for r in want.collect()} and len(got) > 100
    assert sum(o.numRowsTotal for o in progress.stateOperators) < 20
