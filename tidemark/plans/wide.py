"""Queries of names, requests, routes, caches, registries and waits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, values
from ..operators import align, flow, refine, search, text, transcripts
from ..session import stored
from . import dialect
from .registry import CANDIDATES, FILES, PLAIN, PLANTED, REQUESTS, RUNS, SQL, TAGS, TIMES, VISITS, adapter, planted, query, reference_of, tracks_of

NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.LANGUAGES.items())


@query("F8_language_names", f"SELECT doc_id, CASE code {NAMES} ELSE code END AS name FROM ({SQL['F6_language_codes']})")
def names(spark, sf_dir):
    return adapter(spark, sf_dir, TAGS).select("doc_id", labels.language_name(text.language(F.col("tag"))).alias("name"))


@query("F10_variants", f"SELECT request_id, ordinal, provider || ':' || provider_id AS variant, regexp_replace(CASE ordinal % 3 WHEN 0 THEN 'translated:' WHEN 1 THEN 'gemini:' ELSE '' END || provider_id, '^(translated|gemini):', '') AS source FROM ({CANDIDATES})")
def variants(spark, sf_dir):
    prefix = F.when(F.col("ordinal") % 3 == 0, "translated:").when(F.col("ordinal") % 3 == 1, "gemini:").otherwise("")
    found = adapter(spark, sf_dir, dialect.candidates)
    return found.select("request_id", "ordinal", F.concat_ws(":", "provider", "provider_id").alias("variant"), values.source_variant(F.concat(prefix, F.col("provider_id"))).alias("source"))


@query("F12_cache_keys", f"""WITH x AS (SELECT request_id, string_agg(provider_id, ',' ORDER BY provider_id) AS excluded FROM ({CANDIDATES}) WHERE downloads % 9 = 0 GROUP BY 1)
SELECT request_id, sha256(to_json(['7', (request_id % 2 = 0)::VARCHAR, coalesce(excluded, ''), 'movie', 'tt' || request_id, filename, 'ar', 'engine:model'])::VARCHAR) AS key,
  sha256(to_json(['3', 'movie', 'tt' || request_id, filename, 'ar'])::VARCHAR) AS release_key FROM ({REQUESTS}) LEFT JOIN x USING (request_id)""")
def cache_keys(spark, sf_dir):
    """a result's key knows what was rejected and asked for; a release's key doesn't."""
    excluded = adapter(spark, sf_dir, dialect.candidates).where("downloads % 9 = 0").groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("provider_id")), ",").alias("excluded"))
    all_ = adapter(spark, sf_dir, dialect.requests).join(excluded, "request_id", "left")
    ident, name = F.concat(F.lit("tt"), F.col("request_id").cast("string")), F.col("filename")
    key = values.stable_key(F.lit("7"), F.col("request_id") % 2 == 0, F.coalesce("excluded", F.lit("")), F.lit("movie"), ident, name, F.lit("ar"), F.lit("engine:model"))
    return all_.select("request_id", key.alias("key"), values.stable_key(F.lit("3"), F.lit("movie"), ident, name, F.lit("ar")).alias("release_key"))


@query("F14_language_sets", """WITH l AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['en-US', 'eng', 'und', 'fr'] WHEN 1 THEN ['ARA', 'ar', 'pt_BR'] WHEN 2 THEN ['unknown'] ELSE ['de', 'ger', 'xyz', 'de'] END AS l FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'en,fr' WHEN 1 THEN 'ar,pt' WHEN 2 THEN '' ELSE 'de,xyz' END AS languages FROM l""")
def language_sets(spark, sf_dir):
    lists = [["en-US", "eng", "und", "fr"], ["ARA", "ar", "pt_BR"], ["unknown"], ["de", "ger", "xyz", "de"]]
    given = F.element_at(F.array(*[F.array(*[F.lit(x) for x in v]) for v in lists]), (F.col("c_custkey") % 4 + 1).cast("int"))
    kept = F.array_distinct(F.array_compact(F.transform(given, text.language)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(kept, ",").alias("languages"))


@query("F15_labels", f"""WITH r AS (SELECT run_id, outcome = 'translated' AS t, CASE run_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' ELSE 'xx' END AS l, 'catalogue-number-' || run_id % 9 AS p, total_ms % 101 AS c, run_id % 4 AS n FROM ({RUNS})),
m AS (SELECT *, ' ' || c || '%' AS s1, ' - Next' || CASE WHEN n > 1 THEN ' ' || n ELSE '' END AS s2, CASE l {NAMES} ELSE l END AS name FROM r)
SELECT run_id, rtrim(substr(CASE WHEN t THEN 'AI ' || name ELSE p END, 1, 18 - length(s1))) || s1 AS label, rtrim(substr(name, 1, 18 - length(s2))) || s2 AS retry FROM m""")
def menu_labels(spark, sf_dir):
    runs = adapter(spark, sf_dir, dialect.runs)
    language = F.when(F.col("run_id") % 3 == 0, "en").when(F.col("run_id") % 3 == 1, "pt").otherwise("xx")
    provider = F.concat(F.lit("catalogue-number-"), (F.col("run_id") % 9).cast("string"))
    return runs.select("run_id", labels.result_label(F.col("outcome") == "translated", language, provider, F.col("total_ms") % 101).alias("label"), labels.retry_label(language, F.col("run_id") % 4).alias("retry"))


@query("F17_formats", f"""SELECT run_id, CASE WHEN v < 1000 THEN v || ' ms' WHEN v < 60000 THEN printf('%.1f', floor(v / 1000.0::DOUBLE * 10 + 0.5) / 10) || ' s' ELSE printf('%.1f', floor(v / 60000.0::DOUBLE * 10 + 0.5) / 10) || ' min' END AS duration,
CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN printf('%.1f', floor(v / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(v / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size, CAST(floor((v % 997) / 997.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS share FROM (SELECT run_id, CASE run_id % 3 WHEN 0 THEN total_ms % 1500 WHEN 1 THEN total_ms ELSE total_ms * 10 END AS v FROM ({RUNS}))""")
def formats(spark, sf_dir):
    v = F.when(F.col("run_id") % 3 == 0, F.col("total_ms") % 1500).when(F.col("run_id") % 3 == 1, F.col("total_ms")).otherwise(F.col("total_ms") * 10)
    return adapter(spark, sf_dir, dialect.runs).select("run_id", labels.duration(v).alias("duration"), labels.size(v).alias("size"), labels.percent(v % 997 / 997.0).alias("share"))


@query("D12_requests", """WITH p AS (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'series' ELSE 'other' END AS t FROM part)
SELECT k AS request_id, CASE WHEN t = 'series' THEN 'series' ELSE 'movie' END AS kind, CASE WHEN k % 7 = 0 THEN 'kitsu:' || k || ':%ZZ' ELSE 'tt' || k || ':2:' || k % 12 END AS content_id, CASE WHEN k % 7 <> 0 THEN 'tt' || k END AS imdb_id,
coalesce(CASE WHEN t = 'series' THEN CASE WHEN k % 7 = 0 THEN k ELSE 2 END END, -1)::INT AS season, coalesce(CASE WHEN t = 'series' AND k % 7 <> 0 THEN k % 12 END, -1)::INT AS episode, CASE WHEN k % 5 > 0 THEN 'h' || k END AS video_hash, CASE WHEN k % 3 > 0 THEN k * 1000 ELSE -1 END AS video_size, 'A B & ' || k || '.mkv' AS filename FROM p""")
def parsed_requests(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    ident = F.when(k % 7 == 0, F.concat(F.lit("kitsu:"), n, F.lit(":%ZZ"))).otherwise(F.concat(F.lit("tt"), n, F.lit("%3A2%3A"), (k % 12).cast("string")))
    extra = F.concat(F.lit("videoHash="), F.when(k % 5 > 0, F.concat(F.lit("h"), n)).otherwise(""), F.lit("&videoSize="), F.when(k % 3 > 0, F.concat(n, F.lit("000x"))).otherwise("none"), F.lit("&filename=A+B+%2526+"), n, F.lit(".mkv"))
    kind = F.when(F.col("p_size") % 3 == 0, "movie").when(F.col("p_size") % 3 == 1, "series").otherwise("other")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("request_id"), labels.request_parts(kind, ident, extra).alias("r")).select("request_id", "r.*").fillna(-1, ["season", "episode", "video_size"])


@query("D14_headers", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'A: ' || c_name || chr(13) || chr(10) ELSE '' END || 'C: x' || chr(13) || chr(10) AS headers FROM customer")
def headers(spark, sf_dir):
    given = F.create_map(F.lit("A"), F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "\nEvil: 1").otherwise("")), F.lit("B\r"), F.lit("y"), F.lit("C"), F.lit("x"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", labels.safe_headers(given).alias("headers"))


@query("D15_escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS html FROM pages")
def escaped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", labels.escaped(F.col("html")).alias("html"))


@query("D11_write_srt", f"""WITH c AS ({SQL['D8_parse_srt']}), t AS (SELECT track_id, id, text, unnest([start_ms, end_ms]) AS ms, unnest([0, 1]) AS w FROM c),
f AS (SELECT track_id, id, w, text, lpad((ms // 3600000)::VARCHAR, greatest(2, length((ms // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS s FROM t),
b AS (SELECT track_id, id, any_value(text) AS text, max(s) FILTER (WHERE w = 0) || ' --> ' || max(s) FILTER (WHERE w = 1) AS line FROM f GROUP BY 1, 2)
SELECT track_id, string_agg(id || chr(10) || line || chr(10) || text, chr(10) || chr(10) ORDER BY id) || chr(10) AS content FROM b GROUP BY track_id""")
def written(spark, sf_dir):
    return text.write_srt(text.parse_srt(adapter(spark, sf_dir, FILES)))


@query("S7_probes", """SELECT o_orderkey AS probe_id, CASE WHEN o_orderkey % 5 = 0 THEN 5400000 ELSE CAST(floor((CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE greatest(o_totalprice, 9000.5) END) * 1000 + 0.5) AS BIGINT) END AS duration_ms, o_orderkey % 5 > 0 AS known,
round(CASE WHEN o_custkey = 0 THEN -1 WHEN o_orderkey % 3 = 0 THEN o_custkey * 1000 / 8.0 WHEN o_orderkey % 3 = 1 THEN o_custkey * 1000000.0 / ((CASE WHEN o_orderkey % 5 = 0 THEN 5400000 ELSE floor((CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE greatest(o_totalprice, 9000.5) END) * 1000 + 0.5) END) / 1000.0) ELSE -1 END, 3) AS bytes_per_second FROM orders WHERE o_totalprice >= 60""")
def probes(spark, sf_dir):
    key, customer, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    container = F.struct(F.when(key % 5 > 0, price.cast("string")).otherwise("N/A").alias("duration"), F.when(key % 3 == 1, (customer * 1000000).cast("string")).alias("size"), F.when(key % 3 == 0, (customer * 1000).cast("string")).alias("bit_rate"))
    streams = F.array(F.struct(F.when((customer % 2 == 1) & (key % 5 > 0), "9000.5").otherwise("12").alias("duration")))
    body = F.to_json(F.struct(container.alias("format"), streams.alias("streams")))
    out = flow.probed(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice >= 60").select(key.alias("probe_id"), body.alias("body")))
    return out.withColumn("bytes_per_second", F.round(F.coalesce("bytes_per_second", F.lit(-1.0)), 3))


@query("S12a_retry_after", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 50 * 1000 WHEN 1 THEN 90000 WHEN 2 THEN 0 ELSE -1 END AS wait_ms FROM events""")
def retry_after(spark, sf_dir):
    n = F.col("event_id") % 4
    header = F.when(n == 0, (F.col("event_id") % 50).cast("string")).when(n == 1, "Fri, 05 Jan 2024 10:01:30 GMT").when(n == 2, "Fri, 05 Jan 2024 09:00:00 GMT").otherwise("soon")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce(labels.retry_after_ms(header, F.lit(1704448800000)), F.lit(-1)).alias("wait_ms"))


@query("K1_cached_results", "SELECT o_custkey AS key, CAST(epoch_us(max(o_orderdate)) // 1000 AS BIGINT) AS at_ms, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS ordinal, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS content FROM orders GROUP BY 1")
def cached_results(spark, sf_dir):
    return flow.upserted(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("content")))


@query("G7_inventory", "SELECT doc_id AS key, octet_length(encode(text))::BIGINT AS bytes, CASE WHEN doc_id % 4 = 0 THEN 5000 + doc_id ELSE doc_id * 10 END AS at_ms FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0")
def inventory(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return flow.inventory(docs.select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("content"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") * 10).alias("cached_at_ms"), (F.col("doc_id") + 5000).alias("modified_ms")))


@query("W15_removed_keys", """WITH a AS (SELECT event_id AS ordinal, CASE WHEN event_id % 6 = 0 THEN 'bad' ELSE sha256((event_id % 900)::VARCHAR) END AS key FROM events), d AS (SELECT key, min(ordinal) AS o FROM a WHERE length(key) = 64 GROUP BY 1 ORDER BY o LIMIT 200)
SELECT key FROM d WHERE key IN (SELECT sha256(c_custkey::VARCHAR) FROM customer WHERE c_custkey % 2 = 0)""")
def removed(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 6 == 0, "bad").otherwise(F.sha2((F.col("event_id") % 900).cast("string"), 256)).alias("key"))
    return flow.removals(asked, spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("key")))


STREAMS = lambda d: f"""SELECT l_orderkey AS probe_id, CAST(l_linenumber AS INT) AS ordinal, CAST(l_linenumber + 10 AS INT) AS index, CASE WHEN l_suppkey % 4 = 0 THEN 'video' ELSE 'audio' END AS codec_type, {d.at('en,ar,fr,,de', '1 + l_partkey % 5')} AS language,
  CASE WHEN l_suppkey % 9 = 1 THEN 'Original Mix' END AS title, CAST(l_suppkey % 3 % 2 AS INT) AS is_default FROM {d.table('lineitem')}"""  # noqa: E731


@query("V7_audio_streams", f"SELECT probe_id, min_by(index, (CASE WHEN language = 'ar' THEN 0 WHEN contains(lower(coalesce(title, '')), 'original') THEN 1 WHEN is_default = 1 THEN 2 ELSE 3 END, ordinal)) AS index FROM ({STREAMS(PLAIN)}) WHERE codec_type = 'audio' GROUP BY 1")
def audio_streams(spark, sf_dir):
    return flow.select_stream(adapter(spark, sf_dir, STREAMS), F.lit("ar"))


USAGE = lambda d: f"SELECT l_orderkey AS release, CAST(l_quantity AS DOUBLE) AS seconds, l_linenumber % 3 > 0 AS transcribed, CAST(l_suppkey % 3 AS BIGINT) AS requests, l_orderkey % 4 = 0 AS reused FROM {d.table('lineitem')}"


@query("P7_audio_usage", f"SELECT release, count(*) AS windows, round(sum(seconds), 2) AS sampled_seconds, count(*) FILTER (WHERE transcribed) AS transcripts, CAST(sum(CASE WHEN reused THEN 0 ELSE requests END) AS BIGINT) AS requests, round(sum(CASE WHEN reused THEN 0 ELSE seconds * requests END), 2) AS submitted_seconds FROM ({USAGE(PLAIN)}) GROUP BY 1")
def usage(spark, sf_dir):
    """What the analysis of each release used."""
    return flow.audio_usage(adapter(spark, sf_dir, USAGE))


@query("P5_translation_gate", f"SELECT run_id, CASE WHEN run_id % 4 = 0 OR (run_id % 4 = 1 AND run_id % 3 > 0) THEN 'not requested' WHEN run_id % 5 = run_id % 6 THEN 'same language' END AS refusal FROM ({RUNS})")
def gate(spark, sf_dir):
    n = F.col("run_id")
    mode = F.when(n % 4 == 0, "off").when(n % 4 == 1, "manual").otherwise("auto")
    return adapter(spark, sf_dir, dialect.runs).select("run_id", flow.translation_gate(mode, n % 3 == 0, (n % 5).cast("string"), (n % 6).cast("string")).alias("refusal"))


@query("W5_job_results", f"""WITH v AS ({VISITS}), j AS (SELECT event_id AS job_id, at_ms + item * 7000 AS done_ms, item % 5 = 0 AS failed FROM v WHERE event_id % 10 <> 3)
SELECT event_id AS ask_id, event_id - 1 AS job_id, CASE WHEN j.job_id IS NULL THEN 'unknown' WHEN done_ms <= at_ms + 120000 AND failed THEN 'failed' WHEN done_ms <= at_ms + 120000 THEN 'ready' ELSE 'preparing' END AS state FROM v LEFT JOIN j ON j.job_id = event_id - 1""")
def results(spark, sf_dir):
    seen = adapter(spark, sf_dir, dialect.visits)
    jobs = seen.where("event_id % 10 <> 3").select(F.col("event_id").alias("job_id"), (F.col("at_ms") + F.col("item") * 7000).alias("done_ms"), (F.col("item") % 5 == 0).alias("failed"))
    return flow.job_results(seen.select(F.col("event_id").alias("ask_id"), (F.col("event_id") - 1).alias("job_id"), "at_ms"), jobs, 120_000)


RECORDS = lambda d: f"SELECT o_orderkey AS record_id, o_custkey % 400 AS title, o_orderkey % 1000 AS seen_ms, o_orderkey AS ordinal, 'h' || CAST(o_orderkey % 50 AS STRING) AS video_hash, 'f' || CAST(o_orderkey % 30 AS STRING) AS filename, CAST(floor(o_totalprice) AS BIGINT) % 40 AS video_size FROM {d.table('orders')}"


@query("W13_found_streams", f"""WITH r AS (SELECT * FROM ({RECORDS(PLAIN)}) WHERE seen_ms > 900), q AS (SELECT c_custkey AS request_id, c_custkey % 400 AS title, 'h' || c_custkey % 60 AS vh, 'f' || c_custkey % 45 AS fn, c_custkey % 50 AS vs FROM customer),
s AS (SELECT title, max(record_id) AS sel FROM ({RECORDS(PLAIN)}) WHERE title % 3 = 0 GROUP BY 1), n AS (SELECT r.*, count(*) OVER (PARTITION BY title) AS n FROM r),
k AS (SELECT request_id, record_id, ordinal, CASE WHEN record_id = sel THEN 0 WHEN video_hash = vh THEN 1 WHEN filename = fn THEN 2 WHEN video_size = vs THEN 3 WHEN n = 1 THEN 4 END AS rank FROM q JOIN n USING (title) LEFT JOIN s USING (title))
SELECT request_id, min_by(record_id, (rank, ordinal)) AS record_id FROM k WHERE rank IS NOT NULL GROUP BY 1""")
def found_streams(spark, sf_dir):
    records = adapter(spark, sf_dir, RECORDS)
    k = F.col("c_custkey")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("request_id"), (k % 400).alias("title"), F.concat(F.lit("h"), (k % 60).cast("string")).alias("video_hash"), F.concat(F.lit("f"), (k % 45).cast("string")).alias("filename"), (k % 50).alias("video_size"))
    return flow.find_stream(asked, records, records.where("title % 3 = 0").groupBy("title").agg(F.max("record_id").alias("record_id")), 1000, 100)


@query("W14_waited_for", f"""WITH v AS ({VISITS}), q AS (SELECT event_id AS request_id, client, at_ms FROM v WHERE kind <> 'purchase'), s AS (SELECT client, at_ms AS t, max(item) AS hi, min(item) AS lo FROM v WHERE kind = 'purchase' GROUP BY ALL),
o AS (SELECT q.*, s.hi AS old FROM q ASOF LEFT JOIN s ON q.client = s.client AND q.at_ms >= s.t), n AS (SELECT o.*, s.t - o.at_ms AS w, s.lo AS new FROM o ASOF LEFT JOIN s ON o.client = s.client AND o.at_ms <= s.t)
SELECT request_id, coalesce(old, new) AS item, CASE WHEN old IS NOT NULL THEN 0 ELSE w END AS waited_ms FROM n WHERE old IS NOT NULL OR w <= 12000""")
def waits_for(spark, sf_dir):
    seen = adapter(spark, sf_dir, dialect.visits)
    return flow.waited_for(seen.where("kind <> 'purchase'").select(F.col("event_id").alias("request_id"), "client", "at_ms"), seen.where("kind = 'purchase'").select("client", "item", "at_ms"))


@query("W10_wrapped", f"""WITH RECURSIVE v AS (SELECT item AS key, at_ms, CASE WHEN event_id % 3 > 0 THEN client END AS hint, row_number() OVER (PARTITION BY item ORDER BY at_ms, event_id) AS i, count(*) OVER (PARTITION BY item) AS n FROM ({VISITS})),
f AS (SELECT key, i, n, at_ms AS seen_ms, hint, 0 AS refreshed FROM v WHERE i = 1 UNION ALL SELECT v.key, v.i, v.n, CASE WHEN v.at_ms - f.seen_ms > 60000 THEN v.at_ms ELSE f.seen_ms END, CASE WHEN v.at_ms - f.seen_ms > 60000 THEN coalesce(v.hint, f.hint) ELSE f.hint END, CASE WHEN v.at_ms - f.seen_ms > 60000 THEN f.refreshed + 1 ELSE f.refreshed END FROM f JOIN v ON v.key = f.key AND v.i = f.i + 1)
SELECT key, seen_ms, hint, refreshed FROM f WHERE i = n""")
def wrapped(spark, sf_dir):
    return flow.wrapped(adapter(spark, sf_dir, dialect.visits).select(F.col("item").alias("key"), "at_ms", "event_id", F.when(F.col("event_id") % 3 > 0, F.col("client")).alias("hint")))


@query("T6_collected", """WITH e AS (SELECT l_orderkey AS batch, l_linenumber AS id, CASE WHEN l_suppkey % 8 = 0 THEN ' ' WHEN l_suppkey % 9 > 0 THEN 'x' END AS t FROM lineitem), b AS (SELECT batch, id, max(CASE WHEN trim(t) <> '' THEN 1 END) AS ok FROM e GROUP BY ALL) SELECT batch, count(ok) AS n, count(ok) = count(*) AS complete FROM b GROUP BY batch""")
def collected(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"), F.monotonically_increasing_id().alias("pos"), F.when(F.col("l_suppkey") % 8 == 0, " ").when(F.col("l_suppkey") % 9 > 0, "x").alias("text"))
    return flow.collected(items.select("batch", "id").distinct(), items.where("text is not null"))


@query("T5_characters", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS cues FROM conversations GROUP BY 1")
def characters(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("characters"), F.count("*").alias("cues"))


@query("X10_reference_shift", f"""WITH t AS ({TIMES}), x AS (SELECT track_id, start_ms AS at_ms FROM t), y AS (SELECT track_id, start_ms + 400 + (k * 31) % 90 AS at_ms FROM t WHERE k % 7 <> 2),
p AS (SELECT x.*, y.at_ms - x.at_ms AS l FROM x ASOF LEFT JOIN y ON x.track_id = y.track_id AND x.at_ms >= y.at_ms), n AS (SELECT p.*, y.at_ms - p.at_ms AS a FROM p ASOF LEFT JOIN y ON p.track_id = y.track_id AND p.at_ms <= y.at_ms),
r AS (SELECT track_id, CASE WHEN a IS NULL OR -l <= a THEN l ELSE a END AS r FROM n), g AS (SELECT track_id, count(*) AS n, median(r) AS m FROM r WHERE abs(r) <= 600 GROUP BY 1)
SELECT track_id, CASE WHEN n < 15 OR abs(m) < 80 THEN 0.0 ELSE greatest(-600.0, least(600.0, m)) END::DOUBLE AS shift FROM g""")
def reference_shift(spark, sf_dir):
    times = adapter(spark, sf_dir, dialect.cue_times)
    return refine.reference_shift(times.select("track_id", F.col("start_ms").alias("at_ms")), reference_of(times))


@query("X17_snapped")
def snapped(spark, sf_dir):
    """Cues planted 900 ms early are moved onto their speech; the fixture tests compare them with planted truth."""
    cues, windows, _ = planted(spark, sf_dir)
    early = cues.select("track_id", F.col("start_ms").alias("k"), (F.col("start_ms") - 900).alias("start_ms"), (F.col("end_ms") - 900).alias("end_ms"))
    return refine.snap(early, windows)


@query("S1a_searches", f"""SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 'languages=ar,en&' || t || '&moviehash=h' || request_id ELSE '' END AS by_hash, 'languages=ar,en&' || t || CASE WHEN request_id % 2 = 0 THEN '&imdb_id=' || request_id ELSE '&query=' || lower(filename) END AS by_name
FROM (SELECT *, CASE WHEN season IS NOT NULL THEN 'season_number=' || season || '&episode_number=' || episode || '&type=episode' ELSE 'type=movie' END AS t FROM ({REQUESTS}))""")
def searches(spark, sf_dir):
    n, asked = F.col("request_id").cast("string"), adapter(spark, sf_dir, dialect.requests)
    ident = F.when(F.col("request_id") % 2 == 0, F.concat(F.lit("tt"), n))
    hash_ = F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("h"), n))
    found = flow.search_terms(F.array(F.lit("en"), F.lit("ar")), F.col("season"), F.col("episode"), hash_, ident, F.col("filename"))
    return asked.select("request_id", F.coalesce(found["by_hash"], F.lit("")).alias("by_hash"), found["by_name"].alias("by_name"))


@query("S2a_allowed_downloads", """SELECT event_id, event_id % 5 < 2 AS allowed FROM events""")
def allowed(spark, sf_dir):
    paths = ["https://dl.example.net/subtitle/{}.zip", "https://dl.example.net/mobile/{}", "https://dl.example.net/admin/{}", "https://dl.example.net.evil.org/subtitle/{}", "http://dl.example.net/subtitle/{}"]
    url = F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("event_id") % 5 + 1).cast("int"))
    url = F.replace(url, F.lit("{}"), F.col("event_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", flow.allowed_download(url, "https://dl.example.net", ["/subtitle/", "/mobile/"]).alias("allowed"))


@query("S3_titles", """SELECT l_orderkey AS request_id, coalesce(min_by(l_partkey, (l_linenumber, l_partkey)) FILTER (WHERE l_suppkey % 3 = 0), min_by(l_partkey, (l_linenumber, l_partkey))) AS title_id FROM lineitem GROUP BY 1""")
def titles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("title_id"), (F.col("l_suppkey") % 3 == 0).alias("exact"))
    return flow.titles(rows)


@query("S6_original_languages", "SELECT o_orderkey AS request_id, coalesce(CASE WHEN o_custkey % 3 > 0 THEN c_mktsegment END, 'unknown') AS language FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def original_languages(spark, sf_dir):
    """Advisory: what isn't known stays unknown."""
    dim = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").join(dim, "o_custkey", "left").select(F.col("o_orderkey").alias("request_id"), F.coalesce("c_mktsegment", F.lit("unknown")).alias("language"))


@query("G12_warnings", """SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'token unset' WHEN c_custkey % 3 = 1 THEN 'token short' END, CASE WHEN c_custkey % 2 = 0 THEN 'not https' END, CASE WHEN c_custkey % 5 = 0 THEN 'no audio' END, CASE WHEN c_custkey % 7 < 3 AND c_custkey % 4 = 0 THEN 'translation unconfigured' END) AS warnings FROM customer""")
def warnings(spark, sf_dir):
    k = F.col("c_custkey")
    token = F.when(k % 3 == 0, "").when(k % 3 == 1, "short").otherwise("x" * 32)
    found = flow.config_warnings(token, F.when(k % 2 == 0, "http://a").otherwise("https://a"), k % 5 != 0, F.when(k % 7 < 3, "auto").otherwise("off"), k % 4 != 0)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(found, ",").alias("warnings"))


@query("G9_run_rows", f"SELECT run_id, content_id, outcome, CASE WHEN outcome = 'failed' THEN coalesce(failure, 'unknown') ELSE '' END AS failure, CASE WHEN outcome IN ('direct', 'translated') THEN CASE WHEN run_id % 3 = 0 THEN 'source' WHEN run_id % 3 = 1 THEN 'reference' ELSE 'audio' END ELSE '' END AS route, CAST(total_ms // 1000 AS BIGINT) AS seconds FROM ({RUNS})")
def run_rows(spark, sf_dir):
    n = F.col("run_id") % 3
    route = F.when(n == 0, "source").when(n == 1, "reference").otherwise("audio")
    runs = adapter(spark, sf_dir, dialect.runs)
    return runs.select("run_id", "content_id", "outcome", F.when(F.col("outcome") == "failed", F.coalesce("failure", F.lit("unknown"))).otherwise("").alias("failure"), F.when(F.col("outcome").isin("direct", "translated"), route).otherwise("").alias("route"), F.floor(F.col("total_ms") / 1000).cast("long").alias("seconds"))


@query("K5_newest_first", f"SELECT run_id, CAST(row_number() OVER (PARTITION BY content_id ORDER BY at_ms DESC, run_id DESC) AS INT) AS position FROM ({RUNS})")
def newest_first(spark, sf_dir):
    """Each title's runs, newest first."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("content_id").orderBy(F.desc("at_ms"), F.desc("run_id"))
    return adapter(spark, sf_dir, dialect.runs).select("run_id", F.row_number().over(order).alias("position"))


@query("W2_deduplicated_jobs", f"""WITH v AS (SELECT item || '|' || (client % 3) || '|' || (kind = 'purchase') AS key, event_id, at_ms, event_id % 6 = 0 AS fails FROM ({VISITS})), s AS (SELECT *, coalesce(sum(fails::INT) OVER (PARTITION BY key ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM v)
SELECT event_id, min_by(event_id, (at_ms, event_id)) OVER (PARTITION BY key, run) AS job_id FROM s""")
def jobs(spark, sf_dir):
    seen = adapter(spark, sf_dir, dialect.visits)
    key = F.concat_ws("|", F.col("item").cast("string"), (F.col("client") % 3).cast("string"), (F.col("kind") == "purchase").cast("string"))
    return flow.shared_jobs(seen.select(key.alias("key"), "event_id", "at_ms", (F.col("event_id") % 6 == 0).alias("fails")))


@query("W8_rejected_for", f"WITH v AS ({VISITS}) SELECT q.event_id, count(r.event_id) AS rejected FROM v q LEFT JOIN v r ON q.item = r.item AND r.kind = 'error' AND r.at_ms <= q.at_ms GROUP BY 1")
def rejected_for(spark, sf_dir):
    """How many rejections of its item stand at each request."""
    seen = adapter(spark, sf_dir, dialect.visits)
    return flow.standing(seen, F.col("kind") == "error").select("event_id", F.col("n").alias("rejected"))


SAID = f"""{PLANTED}, cu AS (SELECT track_id, k, start_ms, start_ms + length_ms AS end_ms, 'alpha' || k % 37 AS a, 'beta' || k % 19 AS b FROM ({TIMES})), ct AS (SELECT track_id, k, start_ms + (track_id % 5) * 700 AS s, end_ms + (track_id % 5) * 700 AS e, unnest([a, b]) AS token FROM cu),
wd AS (SELECT w.track_id, window_ix, from_ms, 2 * k + j AS word_ix, token, start_ms + (w.track_id % 5) * 700 + 500 * j + (k * 131) % 900 - from_ms AS ws FROM w JOIN (SELECT track_id, k, start_ms, unnest([a, b]) AS token, unnest([0, 1]) AS j FROM cu) u USING (track_id) WHERE start_ms + (w.track_id % 5) * 700 BETWEEN from_ms AND from_ms + 22000 AND k % 10 > 1)"""
J4 = """wn AS (SELECT wd.track_id, window_ix, word_ix, max(CASE WHEN d <= 150 THEN 1 WHEN d <= 350 THEN 0.78 WHEN d <= 700 THEN 0.4 WHEN d <= 1200 THEN 0.12 END) AS best FROM (SELECT wd.*, greatest(0, s - (from_ms + ws + 200), from_ms + ws + 200 - e) AS d FROM wd JOIN ct USING (track_id, token) WHERE e >= from_ms - 2000 AND s <= from_ms + 26000) wd GROUP BY ALL),
wt AS (SELECT wd.track_id, wd.window_ix, count(*) AS n, avg(coalesce(best, 0)) AS mean FROM wd LEFT JOIN wn USING (track_id, window_ix, word_ix) GROUP BY ALL HAVING count(*) >= 3)"""


def said(spark, sf_dir):
    """(cues, windows, words, transcripts, maps): two words of each cue, spoken a little late; one cue in five is too unsure."""
    times, windows, maps = planted(spark, sf_dir)
    k = F.col("k")
    cues = adapter(spark, sf_dir, dialect.cue_times).select("track_id", "k", F.col("start_ms"), (F.col("start_ms") + F.col("length_ms")).alias("end_ms"), F.array(F.concat(F.lit("alpha"), (k % 37).cast("string")), F.concat(F.lit("beta"), (k % 19).cast("string"))).alias("tokens"))
    shift = (F.col("track_id") % 5) * 700
    spoken = windows.select("track_id", "window_ix", "from_ms").join(cues, "track_id").where((F.col("start_ms") + shift).between(F.col("from_ms"), F.col("from_ms") + 22000))
    each = spoken.select("track_id", "window_ix", "from_ms", "k", "start_ms", F.posexplode("tokens").alias("j", "token"))
    at = F.col("start_ms") + shift + 500 * F.col("j") + (k * 131) % 900 - F.col("from_ms")
    words = each.select("track_id", "window_ix", (2 * k + F.col("j")).alias("word_ix"), at.alias("start_ms"), (at + 400).alias("end_ms"), F.when(k % 10 > 5, None).otherwise(k % 10 / 4.0).alias("confidence"), F.array("token").alias("tokens"))
    told = words.where(F.coalesce("confidence", F.lit(1.0)) >= 0.45).groupBy("track_id", "window_ix").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return cues, windows, words, told, maps.where("map_id = 0")


@query("J4_word_timing", f"WITH {SAID}, {J4} SELECT track_id, window_ix, round(mean, 6) AS score FROM wt")
def word_timing(spark, sf_dir):
    """How near words stand to cues that hold them."""
    cues, windows, words, _, maps = said(spark, sf_dir)
    return transcripts.word_timing(cues, windows, words, maps).withColumn("score", F.round("score", 6))


@query("J9_word_anchors", f"""WITH {SAID}, d AS (SELECT wd.track_id, window_ix, word_ix, from_ms + ws AS t, k, s, greatest(0, s - (from_ms + ws), from_ms + ws - e) AS d FROM wd JOIN ct USING (track_id, token)),
o AS (SELECT * FROM d WHERE d <= 1500 QUALIFY row_number() OVER (PARTITION BY track_id, window_ix, word_ix ORDER BY d, CASE WHEN d = 0 THEN k ELSE -k END) = 1) SELECT track_id, k, CAST(min(t) - any_value(s) AS DOUBLE) AS residual FROM o GROUP BY ALL""")
def word_anchors(spark, sf_dir):
    cues, windows, words, _, maps = said(spark, sf_dir)
    return transcripts.word_anchors(cues, windows, words, maps)


@query("J3_transcript_scores", f"""WITH {SAID}, {J4}, tr AS (SELECT track_id, window_ix, list(DISTINCT token) AS l FROM wd GROUP BY ALL), sh AS (SELECT w.track_id, window_ix, list(DISTINCT token) AS r FROM w JOIN ct USING (track_id) WHERE s <= from_ms + length_ms AND e >= from_ms GROUP BY ALL), ac AS (SELECT track_id, window_ix, score FROM ({{J1}}) WHERE map_id = 0),
z AS (SELECT tr.track_id, tr.window_ix, CASE WHEN r IS NULL THEN 0 ELSE len(list_intersect(l, r)) / sqrt(len(l)::DOUBLE * len(r)) END AS a, coalesce(mean, 0) AS t, coalesce(score, 0) AS v FROM tr LEFT JOIN sh USING (track_id, window_ix) LEFT JOIN wt USING (track_id, window_ix) LEFT JOIN ac USING (track_id, window_ix))
SELECT track_id, window_ix, round(CASE WHEN t > 0 THEN 0.55 * a + 0.3 * t + 0.15 * v ELSE 0.76 * a + 0.24 * v END, 5) AS score FROM z""".replace("{J1}", SQL["J1_activity_score"]))
def transcript_scores(spark, sf_dir):
    cues, windows, words, told, maps = said(spark, sf_dir)
    active = align.activity_scores(cues, windows, maps).select("track_id", "window_ix", F.round("score", 6).alias("score"))
    return transcripts.transcript_scores(cues, windows, words, told, active, maps).withColumn("score", F.round("score", 5))


@query("X8_speech_shift", f"""WITH {SAID}, d AS (SELECT wd.track_id, window_ix, word_ix, from_ms + ws AS t, k, s, greatest(0, s - (from_ms + ws), from_ms + ws - e) AS d FROM wd JOIN ct USING (track_id, token)),
o AS (SELECT * FROM d WHERE d <= 1500 QUALIFY row_number() OVER (PARTITION BY track_id, window_ix, word_ix ORDER BY d, CASE WHEN d = 0 THEN k ELSE -k END) = 1), r AS (SELECT track_id, k, min(t) - any_value(s) AS r FROM o GROUP BY ALL), g AS (SELECT track_id, median(r) - 150 AS m FROM r GROUP BY 1 HAVING count(*) >= 6)
SELECT track_id, CASE WHEN abs(m) < 250 THEN 0 ELSE greatest(-900, least(900, m)) END::DOUBLE AS shift FROM g""")
def speech_shift(spark, sf_dir):
    """Of tracks with enough words: how far cues should move for their lines to begin just after them."""
    cues, windows, words, _, maps = said(spark, sf_dir)
    anchors = transcripts.word_anchors(cues, windows, words, maps)
    enough = anchors.groupBy("track_id").count().where("count >= 6").select("track_id")
    return refine.speech_shift(cues, windows, maps, anchors.select("track_id", "residual")).join(enough, "track_id", "left_semi")


@query("X12_align_transcript")
def by_transcript(spark, sf_dir):
    """The full search by what was said, for every track with two transcripts or more; by activity for the others."""
    cues, windows, words, told = map(stored, said(spark, sf_dir)[:4])  # the refinement joins them again and again
    lines = cues.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "tokens"))).alias("c")).select("track_id", F.col("c.start_ms").alias("starts"), F.col("c.end_ms").alias("ends"), F.col("c.tokens").alias("tokens"))
    heard = windows.join(told.withColumnRenamed("tokens", "heard"), ["track_id", "window_ix"], "left").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("window_ix", "from_ms", "length_ms", "speech", "heard"))).alias("windows"))
    at = F.col("from_ms") + (F.col("start_ms") + F.col("end_ms")) / 2
    sure = transcripts.heard_words(words).join(windows.select("track_id", "window_ix", "from_ms"), ["track_id", "window_ix"])
    spoken = sure.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("window_ix", at.alias("at_ms"), "tokens"))).alias("words"))
    tracks = lines.join(heard, "track_id").join(spoken, "track_id", "left")
    tracks = stored(tracks.withColumn("words", F.coalesce("words", F.array().cast(tracks.schema["words"].dataType))))
    found = refine.transcript_confidence(stored(search.align_to_transcript(tracks)), cues, windows, words, told)
    rest = tracks.where(F.size(F.filter("windows", lambda w: w["heard"].isNotNull())) < 2)
    return found.union(refine.activity_confidence(stored(search.align_to_activity(rest)), cues, windows))
