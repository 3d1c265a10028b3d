"""Queries of onsets, mapped cues, settings, keys, jobs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import service, timing
from . import dialect
from .registry import CANDIDATES, PLAIN, TIMES, VISITS, adapter, query

ONSETS = f"""s AS (SELECT track_id, k, start_ms - 1000 AS s, start_ms + length_ms - 1000 AS e FROM ({TIMES})), b AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
on_ AS (SELECT track_id, 5000 + s AS at_ms FROM b WHERE s >= 150 AND (p IS NULL OR s - p > 400))"""


def heard(spark, sf_dir):
    times = adapter(spark, sf_dir, dialect.cue_times)
    return timing.onsets(times.select("track_id", F.lit(5000).cast("long").alias("from_ms"), F.col("k").alias("ordinal"), (F.col("start_ms") - 1000).alias("start_ms"), (F.col("start_ms") + F.col("length_ms") - 1000).alias("end_ms")))


@query("V12_onsets", f"WITH {ONSETS} SELECT track_id, at_ms FROM on_")
def onsets(spark, sf_dir):
    return heard(spark, sf_dir)


@query("X16_speech_error", f"""WITH {ONSETS}, c AS (SELECT track_id, start_ms + 3400 + (k * 131) % 500 AS at_ms FROM ({TIMES})),
p AS (SELECT c.*, o.at_ms - c.at_ms AS l FROM c ASOF LEFT JOIN on_ o ON c.track_id = o.track_id AND c.at_ms >= o.at_ms), n AS (SELECT p.*, o.at_ms - p.at_ms AS a FROM p ASOF LEFT JOIN on_ o ON p.track_id = o.track_id AND p.at_ms <= o.at_ms),
r AS (SELECT track_id, CASE WHEN a IS NULL OR -l <= a THEN l ELSE a END AS r FROM n) SELECT track_id, count(*) AS pairs, CAST(floor(median(r) - 200 + 0.5) AS BIGINT) AS error_ms FROM r WHERE abs(r) <= 4000 GROUP BY track_id HAVING count(*) >= 6""")
def speech_error(spark, sf_dir):
    """Cues planted some 600 ms before their speech."""
    cues = adapter(spark, sf_dir, dialect.cue_times).select("track_id", (F.col("start_ms") + 3400 + (F.col("k") * 131) % 500).alias("at_ms"))
    return timing.speech_error(cues, heard(spark, sf_dir)).where("error_ms is not null")


@query("X14_mapped_cues", f"SELECT track_id, k, round(greatest(0, start_ms * 1.0625 - 9000), 3) AS start_ms, round(greatest(start_ms * 1.0625 - 8750, (start_ms + length_ms) * 1.0625 - 9000), 3) AS end_ms FROM (SELECT track_id, k, start_ms::DOUBLE AS start_ms, length_ms FROM ({TIMES}))")
def mapped(spark, sf_dir):
    start, end = timing.mapped(F.col("start_ms"), F.col("start_ms") + F.col("length_ms"), F.lit(1.0625), F.lit(-9000.0))
    return adapter(spark, sf_dir, dialect.cue_times).select("track_id", "k", F.round(start, 3).alias("start_ms"), F.round(end, 3).alias("end_ms"))


@query("W18_notices", "SELECT track_id, CAST((s - 1000) / 30000 + 1 AS INT) AS id, s AS start_ms, s + 5000 AS end_ms FROM (SELECT o_orderkey AS track_id, unnest(range(1000, CAST(floor(o_totalprice) AS BIGINT), 30000)) AS s FROM orders)")
def notices(spark, sf_dir):
    return timing.notices(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("track_id"), F.floor("o_totalprice").cast("long").alias("duration_ms")))


@query("V6_replacement_windows", """WITH p AS (SELECT o_orderkey AS probe_id, [0.0::DOUBLE, o_custkey % 7 * 10000.0::DOUBLE + 1.0, 200000.0::DOUBLE] AS s FROM orders)
SELECT probe_id, array_to_string(list_transform((list_filter([36000.0, 96000.0, 152000.0], lambda x: len(list_filter(s, lambda y: abs(y - x) <= 30000)) = 0))[1:2], lambda x: CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR)), ',') AS starts FROM p""")
def replacements(spark, sf_dir):
    starts = F.array(F.lit(0.0), (F.col("o_custkey") % 7 * 10000.0 + 1.0), F.lit(200000.0))
    found = F.transform(timing.replacements(starts, 15), lambda x: F.floor(x + 0.5).cast("long").cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("probe_id"), F.array_join(found, ",").alias("starts"))


@query("F9_keys", """SELECT o_orderkey, sha256(to_json([o_orderkey::VARCHAR, o_orderstatus, o_orderpriority])::VARCHAR) AS key, substr(sha256(to_json([o_orderkey::VARCHAR, o_orderstatus, o_orderpriority])::VARCHAR), 1, 24) AS entry_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'h' || o_custkey WHEN o_orderkey % 3 = 1 THEN o_orderpriority || ':' || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE o_custkey::VARCHAR END ELSE sha256('"u' || o_custkey || '"') END AS fingerprint FROM orders""")
def keys(spark, sf_dir):
    """keys of entries and fingerprints of streams."""
    orders, n = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey") % 3
    key = values.stable_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    customer = F.col("o_custkey").cast("string")
    print_ = values.stream_fingerprint(F.when(n == 0, F.concat(F.lit("h"), customer)), F.when(n == 1, F.col("o_orderpriority")), F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey")), F.concat(F.lit("u"), customer))
    return orders.select("o_orderkey", key.alias("key"), F.substring(key, 1, 24).alias("entry_id"), print_.alias("fingerprint"))


@query("F18_settings", """WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_acctbal::VARCHAR || 'px' WHEN 2 THEN 'none' ELSE ' 12.5 ,' || c_mktsegment || ', ,B' END AS v FROM customer)
SELECT c_custkey, coalesce(least(500.0, greatest(-100.0, TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE))), 7.0) AS number, array_to_string(list_filter(list_transform(string_split(coalesce(v, ''), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS parts,
  rtrim(substr(c_mktsegment || ' ' || c_custkey::VARCHAR, 1, 12)) || ' - ' || right('00' || (c_custkey % 100)::VARCHAR, 3) AS label FROM c JOIN customer USING (c_custkey)""")
def settings(spark, sf_dir):
    """numbers and lists out of settings, labels of a width."""
    key = F.col("c_custkey")
    value = F.when(key % 4 == 0, None).when(key % 4 == 1, F.concat(F.col("c_acctbal").cast("string"), F.lit("px"))).when(key % 4 == 2, "none").otherwise(F.concat(F.lit(" 12.5 ,"), F.col("c_mktsegment"), F.lit(", ,B")))
    suffix = F.concat(F.lit(" - "), F.expr("right(concat('00', cast(c_custkey % 100 as string)), 3)"))
    label = values.menu_label(F.concat_ws(" ", "c_mktsegment", key.cast("string")), suffix)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", values.number_setting(value, 7.0, -100.0, 500.0).alias("number"), F.array_join(values.list_setting(value), "|").alias("parts"), label.alias("label"))


MESSAGES = "fetch failed,read ETIMEDOUT,bad request,got 503 back,Timed  out,id 5030"


@query("S12b_passing_faults", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (400 + event_id % 110) IN (408, 425, 429, 500, 502, 503, 504) ELSE regexp_matches((string_split('{MESSAGES}', ','))[1 + event_id % 6], '{values.PASSING_MESSAGE}') END AS again FROM events""")
def faults(spark, sf_dir):
    status = F.when(F.col("event_id") % 2 == 0, 400 + F.col("event_id") % 110)
    message = F.element_at(F.split(F.lit(MESSAGES), ","), (1 + F.col("event_id") % 6).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", values.passes(status, message).alias("again"))


@query("D5_decoding_score", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ar' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN replace(text, 'a', chr(65533)) WHEN doc_id % 4 = 1 THEN replace(text, 'e', chr(1576)) ELSE text END AS t FROM documents),
n AS (SELECT *, len(regexp_extract_all(t, '\\p{L}')) AS l, len(regexp_extract_all(t, '\\p{Arabic}')) AS a FROM t)
SELECT doc_id, round((length(t) - length(replace(t, chr(65533), ''))) / greatest(1, length(t))::DOUBLE + CASE WHEN lang = 'ar' AND l >= 10 THEN (1 - a / l::DOUBLE) * 0.25 ELSE 0 END, 6) AS score FROM n""")
def decoding(spark, sf_dir):
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.replace("text", F.lit("a"), F.lit("�"))).when(n == 1, F.replace("text", F.lit("e"), F.lit("ب"))).otherwise(F.col("text"))
    language = F.when(F.col("doc_id") % 3 == 0, "ar").otherwise(F.col("lang"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.round(values.decoding_score(text, language), 6).alias("score"))


JOBS = lambda d: f"SELECT event_id AS job_id, item AS release, at_ms AS created_ms, kind = 'purchase' AS translates, CASE WHEN event_id % 5 = 0 THEN 'preparing' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS state FROM ({dialect.visits(d)}) v"


@query("W4_current_jobs", f"SELECT release, max_by(job_id, (created_ms, job_id)) AS job_id FROM ({JOBS(PLAIN)}) WHERE NOT translates GROUP BY release")
def current(spark, sf_dir):
    return service.current_jobs(adapter(spark, sf_dir, JOBS))


@query("G10_health", f"SELECT count(*) AS jobs, count(*) FILTER (WHERE state = 'preparing') AS preparing, count(*) FILTER (WHERE state = 'ready') AS ready, count(*) FILTER (WHERE state = 'failed') AS failed FROM ({JOBS(PLAIN)})")
def health(spark, sf_dir):
    return service.health(adapter(spark, sf_dir, JOBS))


@query("W7_retained_jobs", f"WITH j AS ({JOBS(PLAIN)}) SELECT job_id, state FROM j WHERE created_ms >= (SELECT max(created_ms) FROM j) - 30000 OR state = 'preparing'")
def retained(spark, sf_dir):
    jobs = adapter(spark, sf_dir, JOBS)
    now = jobs.agg(F.max("created_ms")).first()[0] or 0
    return service.retained(jobs, now, 30_000).select("job_id", "state")


@query("W11_registry", f"WITH v AS ({VISITS}), r AS (SELECT client AS record_id, min(event_id) AS inserted, max(at_ms) AS seen_ms FROM v GROUP BY ALL) SELECT * FROM r WHERE seen_ms > (SELECT max(at_ms) FROM v) - 600000 ORDER BY inserted DESC, record_id DESC LIMIT 4000")
def registry_rows(spark, sf_dir):
    """The registry's live records, of which it holds 4,000."""
    seen = adapter(spark, sf_dir, dialect.visits)
    now = seen.agg(F.max("at_ms")).first()[0] or 0
    return service.registry_rows(seen.groupBy(F.col("client").alias("record_id")).agg(F.min("event_id").alias("inserted"), F.max("at_ms").alias("seen_ms")), now, 600_000, 4000)


@query("G8_stage_timings", "WITH s AS (SELECT l_orderkey AS run_id, l_returnflag AS stage, CAST(floor(l_extendedprice) AS BIGINT) AS ms, l_linenumber AS n FROM lineitem) SELECT run_id, stage, max_by(ms, (n, ms)) AS last_ms, CAST(sum(ms) AS BIGINT) AS sum_ms, max(ms) AS most_ms FROM s GROUP BY run_id, stage")
def stages(spark, sf_dir):
    """Stage timings of runs."""
    steps = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return service.stage_timings(steps.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("stage"), F.floor("l_extendedprice").cast("long").alias("ms"), F.col("l_linenumber").alias("ordinal")))


@query("R4_not_rejected", f"WITH c AS ({CANDIDATES}) SELECT request_id, provider, provider_id, ordinal FROM c ANTI JOIN (SELECT DISTINCT request_id, provider_id FROM c WHERE machine_translated OR downloads % 9 = 0) r USING (request_id, provider_id)")
def not_rejected(spark, sf_dir):
    found = adapter(spark, sf_dir, dialect.candidates)
    return service.without(found, found.where("machine_translated or downloads % 9 = 0")).select("request_id", "provider", "provider_id", "ordinal")


@query("G11_smoke", f"SELECT track_id, count(*) AS n, count(*) FILTER (WHERE start_ms = 0) AS at_zero, array_to_string(list(start_ms::VARCHAR ORDER BY k) FILTER (WHERE k < 6), ',') AS head, max_by(start_ms, k) AS last_ms FROM ({TIMES}) GROUP BY track_id")
def smoke(spark, sf_dir):
    return service.smoke(adapter(spark, sf_dir, dialect.cue_times))
