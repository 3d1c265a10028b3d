"""Jobs, registries and reports of a service, as queries over their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_jobs(jobs: DataFrame) -> DataFrame:
    """(release, job_id): each release's latest job that isn't a translation."""
    return jobs.where(~F.col("translates")).groupBy("release").agg(F.max_by("job_id", F.struct("created_ms", "job_id")).alias("job_id"))


def retained(jobs: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Without jobs that are done and older than keep_ms."""
    return jobs.where((F.col("created_ms") >= now - keep_ms) | (F.col("state") == "preparing"))


def registry_rows(records: DataFrame, now: int, keep_ms: int, most: int) -> DataFrame:
    """Live records, of these the last `most` put in; a refresh keeps a record's place."""
    return records.where(F.col("seen_ms") > now - keep_ms).orderBy(F.desc("inserted"), F.desc("record_id")).limit(most)


def stage_timings(steps: DataFrame) -> DataFrame:
    """(run_id, stage, last_ms, sum_ms, most_ms): a stage's last value (of equal places the larger), and its counters."""
    return steps.groupBy("run_id", "stage").agg(F.max_by("ms", F.struct("ordinal", "ms")).alias("last_ms"), F.sum("ms").alias("sum_ms"), F.max("ms").alias("most_ms"))


def health(jobs: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return jobs.agg(F.count("*").alias("jobs"), is_("preparing").alias("preparing"), is_("ready").alias("ready"), is_("failed").alias("failed"))


def without(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates that their release hasn't rejected."""
    return candidates.join(rejected.select("request_id", "provider_id").distinct(), ["request_id", "provider_id"], "left_anti")


def valid_keys(key: Column) -> Column:
    return F.coalesce(key.rlike("^[0-9a-f]{64}$"), F.lit(False))


def smoke(cues: DataFrame, first: int = 6) -> DataFrame:
    """(track_id, n, at_zero, head, last_ms): a quick look at each track."""
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") < first, F.struct("k", "start_ms")))), lambda c: c["start_ms"].cast("string")), ",")
    return cues.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.col("start_ms") == 0).alias("at_zero"), head.alias("head"), F.max_by("start_ms", "k").alias("last_ms"))


def retry_chain(candidates: DataFrame, most: int = 20) -> DataFrame:
    """candidates (request_id, position, candidate_id, content, which may be null) to (request_id, attempt, position, candidate_id): what a viewer gets who rejects every delivery, up to `most` times. A rejection excludes the delivered id and its content, so a candidate is delivered unless one before it that was delivered has its id or its content.

    Whether an earlier candidate counts depends on whether it was delivered itself, so this is a fold over a request's candidates, in the JVM; these are one title's, so their number is bounded.
    """
    none = F.array().cast("array<string>")
    each = F.struct("position", F.col("candidate_id").cast("string").alias("id"), F.col("content").cast("string").alias("content"))
    listed = candidates.groupBy("request_id").agg(F.array_sort(F.collect_list(each)).alias("listed"))
    start = F.struct(none.alias("ids"), none.alias("contents"), F.array().cast("array<int>").alias("taken"))

    def deliver(so_far, one):
        known = F.array_contains(so_far["ids"], one["id"]) | F.coalesce(F.array_contains(so_far["contents"], one["content"]), F.lit(False))
        told = F.struct(
            F.array_append(so_far["ids"], one["id"]).alias("ids"),
            F.when(one["content"].isNull(), so_far["contents"]).otherwise(F.array_append(so_far["contents"], one["content"])).alias("contents"),
            F.array_append(so_far["taken"], one["position"].cast("int")).alias("taken"),
        )
        return F.when(known, so_far).otherwise(told)

    chain = listed.select("request_id", F.aggregate("listed", start, deliver).alias("c"))
    each = chain.select("request_id", F.posexplode(F.arrays_zip(F.slice("c.taken", 1, most + 1).alias("position"), F.slice("c.ids", 1, most + 1).alias("id"))).alias("attempt", "d"))
    return each.select("request_id", "attempt", "d.position", F.col("d.id").alias("candidate_id"))
