"""Queries of speech in sound, of retries, and of state over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, service, sound, state
from ..operators import text as spoken
from ..sources import timedtext
from . import dialect
from .registry import CANDIDATES, FILES, FRAMES, PLAIN, SQL, TIMES, VISITS, adapter, query

RATE = 133  # four samples a frame


def loud_words(d):
    """A sample for each word of a text, the louder the longer, in turn above and below zero."""
    words = f"split(text, ' ')" if d.folder else "string_split(text, ' ')"
    power = "pow(length(w), 4)"
    each = f"posexplode({words}) AS (i, w)" if d.folder else f"unnest(range(0, len({words}))) AS i, unnest({words}) AS w"
    return f"SELECT client, i, CAST(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * least(32767, {power}) AS INT) AS sample FROM (SELECT doc_id AS client, {each} FROM {d.table('documents')} WHERE text IS NOT NULL) t"


@query("V1_speech_in_sound", f"""WITH s AS ({loud_words(PLAIN)}), l AS (SELECT client, i // 4 AS k, sqrt(sum(sample * sample)::DOUBLE / 4) AS level FROM s GROUP BY ALL HAVING count(*) = 4),
b AS (SELECT client, greatest(380, 2.6 * (list(level ORDER BY level))[1 + CAST(floor(count(*) * 0.25) AS INT)]) AS bar FROM l GROUP BY client), f AS (SELECT client, k, level >= bar AS active FROM l JOIN b USING (client)),
v AS (SELECT client, k FROM (SELECT client, k, sum(active::INT) OVER (PARTITION BY client ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM f) WHERE near >= 2), g AS (SELECT client, k, k - row_number() OVER (PARTITION BY client ORDER BY k) AS g FROM v)
SELECT client, CAST(min(k) * 30 AS BIGINT) AS start_ms, CAST((max(k) + 1) * 30 AS BIGINT) AS end_ms FROM g GROUP BY client, g HAVING count(*) >= 3""")
def speech_in_sound(spark, sf_dir):
    """Raw sound of each text, framed, measured against its own noise floor, voted and joined to intervals."""
    samples = adapter(spark, sf_dir, loud_words)
    swapped = F.concat(F.substring(F.lpad(F.hex(F.col("sample").bitwiseAND(65535)), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.col("sample").bitwiseAND(65535)), 4, "0"), 1, 2))
    listed = samples.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("i", swapped.alias("h")))).alias("l"))
    return sound.speech(listed.select("client", F.unhex(F.array_join("l.h", "")).alias("pcm")), RATE)


@query("V2_hangover_islands", f"""WITH RECURSIVE f AS (SELECT client, n, active::INT AS active FROM ({FRAMES(PLAIN)})), z AS (SELECT client, max(n) AS size FROM f GROUP BY 1), x AS (FROM f UNION ALL SELECT client, size + k, 0 FROM z, (VALUES (1), (2), (3), (4), (5), (6)) v(k)),
w AS (SELECT client, n, sum(active) OVER (PARTITION BY client ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 2 AS a, coalesce(sum(active) OVER (PARTITION BY client ORDER BY n ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) = 0 AS quiet FROM x),
r AS (SELECT client, n, CASE WHEN a THEN n END AS begun, NULL::BIGINT AS ended FROM w WHERE n = 1 UNION ALL
  SELECT w.client, w.n, CASE WHEN begun IS NULL AND a THEN w.n WHEN NOT a AND quiet THEN NULL ELSE begun END, CASE WHEN NOT a AND quiet THEN begun END FROM r JOIN w ON w.client = r.client AND w.n = r.n + 1)
SELECT client, ended AS first, greatest(ended, n - 6) AS last FROM r WHERE ended IS NOT NULL AND greatest(ended, n - 6) - ended >= 2 UNION ALL SELECT r.client, begun, size FROM r JOIN z ON z.client = r.client AND r.n = size + 6 WHERE begun IS NOT NULL""")
def hangover(spark, sf_dir):
    return state.hangover_islands(adapter(spark, sf_dir, FRAMES))


@query("W6_retry_chain", f"""WITH RECURSIVE c AS (SELECT request_id, ordinal AS position, provider || (downloads % 11) AS id, CASE WHEN downloads % 5 > 0 THEN 'c' || (downloads % 7) END AS content FROM ({CANDIDATES})),
r AS (SELECT request_id, 0::BIGINT AS position, []::VARCHAR[] AS ids, []::VARCHAR[] AS contents, false AS taken FROM c GROUP BY 1 UNION ALL
  SELECT c.request_id, c.position, CASE WHEN t THEN list_append(ids, id) ELSE ids END, CASE WHEN t AND content IS NOT NULL THEN list_append(contents, content) ELSE contents END, t
  FROM (SELECT r.ids, r.contents, c.*, NOT list_contains(r.ids, c.id) AND NOT coalesce(list_contains(r.contents, c.content), false) AS t FROM r JOIN c ON c.request_id = r.request_id AND c.position = r.position + 1) c),
d AS (SELECT request_id, position, ids[-1] AS candidate_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY position) - 1 AS INT) AS attempt FROM r WHERE taken)
SELECT request_id, attempt, CAST(position AS INT) AS position, candidate_id FROM d WHERE attempt <= 20""")
def retries(spark, sf_dir):
    """What each request delivers at first and after each rejection; ids and contents recur among candidates."""
    found = adapter(spark, sf_dir, dialect.candidates)
    name = F.concat("provider", (F.col("downloads") % 11).cast("string"))
    content = F.when(F.col("downloads") % 5 > 0, F.concat(F.lit("c"), (F.col("downloads") % 7).cast("string")))
    return service.retry_chain(found.select("request_id", F.col("ordinal").alias("position"), name.alias("candidate_id"), content.alias("content")))


ASKED = f"SELECT item || '|' || (client % 3) || '|' || (kind = 'purchase') AS key, event_id, at_ms, at_ms + (event_id * 37) % 40000 AS done_ms, event_id % 6 = 0 AS fails FROM ({VISITS})"


@query("W2_retained_jobs", f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, event_id) AS i FROM ({ASKED})),
f AS (SELECT key, i, event_id, event_id AS job_id, at_ms AS created, done_ms AS done, fails AS failed FROM v WHERE i = 1 UNION ALL
  SELECT v.key, v.i, v.event_id, CASE WHEN n THEN v.event_id ELSE job_id END, CASE WHEN n THEN v.at_ms ELSE created END, CASE WHEN n THEN v.done_ms ELSE done END, CASE WHEN n THEN v.fails ELSE failed END
  FROM (SELECT f.job_id, f.created, f.done, f.failed, v.*, f.done <= v.at_ms AND (f.failed OR v.at_ms - f.created > 90000) AS n FROM f JOIN v ON v.key = f.key AND v.i = f.i + 1) v) SELECT event_id, job_id FROM f""")
def retained(spark, sf_dir):
    """Jobs with a time of completion, failures that free their key, and a retention."""
    return flow.retained_jobs(asked_jobs(spark, sf_dir), 90_000)


def asked_jobs(spark, sf_dir):
    seen = adapter(spark, sf_dir, dialect.visits)
    key = F.concat_ws("|", F.col("item").cast("string"), (F.col("client") % 3).cast("string"), (F.col("kind") == "purchase").cast("string"))
    return seen.select(key.alias("key"), "event_id", "at_ms", (F.col("at_ms") + F.col("event_id") * 37 % 40000).alias("done_ms"), (F.col("event_id") % 6 == 0).alias("fails"))


@query("D1_bytes_to_cues", SQL["D8_parse_srt"])
def cues_of_bytes(spark, sf_dir):
    """Files as bytes (UTF-8 with and without a mark, UTF-16, WebVTT), decoded, told apart, turned into SRT and parsed: the cues are those of the plain files."""
    files = adapter(spark, sf_dir, FILES)
    n, bytes_of = F.col("track_id") % 4, lambda c, e="UTF-8": F.encode(c, e)
    vtt = F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace("content", r"(\d\d:\d\d:\d\d),(\d{3})", "$1.$2"))
    content = F.when(n == 1, bytes_of(F.col("content"), "UTF-16")).when(n == 2, bytes_of(vtt)).when(n == 3, F.concat(F.unhex(F.lit("EFBBBF")), bytes_of(F.col("content")))).otherwise(bytes_of(F.col("content")))
    none = F.lit(None)
    raw = files.select(F.col("track_id").alias("file_id"), F.lit("file").alias("name"), content.alias("content"), none.cast("string").alias("language"), none.cast("int").alias("episode"))
    made = timedtext.prepared(raw).where("error is null")
    return spoken.parse_srt(made.select(F.col("file_id").alias("track_id"), "content"))


# The cleaning of cues as a loop: kept cues that can't be reached any more leave the state.
LOOP = f"""WITH RECURSIVE raw AS (SELECT track_id, k + 1 AS id, (start_ms - CASE WHEN k % 7 = 3 THEN 1200 ELSE 0 END)::DOUBLE AS s, (CASE WHEN k % 11 = 5 THEN 90 WHEN k % 13 = 4 THEN 300 ELSE length_ms END)::DOUBLE AS n, 'Line ' || (k - CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END) AS t FROM ({TIMES})),
c AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY s, s + n, id) AS i, {{'s': s, 'e': s + n, 't': t, 'key': lower(t)}} AS c FROM raw),
r AS (SELECT track_id, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR, key VARCHAR)[] AS kept, []::STRUCT(s DOUBLE, e DOUBLE, t VARCHAR, key VARCHAR)[] AS gone, 0 AS merges FROM c GROUP BY 1 UNION ALL
  SELECT track_id, i, CASE WHEN spot IS NULL THEN list_append(live, c) ELSE list_transform(live, lambda x, j: CASE WHEN j = spot THEN {{'s': least(x.s, c.s), 'e': greatest(x.e, c.e), 't': CASE WHEN fuller THEN c.t ELSE x.t END, 'key': CASE WHEN fuller THEN c.key ELSE x.key END}} ELSE x END) END, gone, CASE WHEN spot IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, coalesce(twin, CASE WHEN len(live) > 0 AND abs(live[-1].s - c.s) <= 250 AND (starts_with(live[-1].key, c.key) OR starts_with(c.key, live[-1].key)) THEN len(live) END) AS spot, twin IS NULL AND length(c.key) > length(live[-1].key) AS fuller
    FROM (SELECT *, list_max(list_filter(generate_series(1, len(live)), lambda j: live[j].key = c.key)) AS twin FROM (SELECT *, kept[early + 1:] AS live, kept[1:early] AS gone
      FROM (SELECT c.track_id, c.i, c.c, r.kept, coalesce(list_max(list_filter(generate_series(1, len(r.kept)), lambda j: r.kept[j].e + 250 < c.c.s)), 0) AS early FROM r JOIN c ON c.track_id = r.track_id AND c.i = r.i + 1))))),
m AS (SELECT track_id, sum(merges) AS merged, max(i) AS last FROM r GROUP BY 1),
k AS (SELECT track_id, i, generate_subscripts(gone, 1) AS j, unnest(gone) AS x FROM r UNION ALL SELECT r.track_id, i + 1, generate_subscripts(kept, 1), unnest(kept) FROM r JOIN m ON r.track_id = m.track_id AND i = last),
v AS (SELECT track_id, i, j, x.s AS s, x.e AS e, x.t AS t, x.e - x.s < 160 AS gone, least(x.s + 500, coalesce(lead(x.s) OVER (PARTITION BY track_id ORDER BY i, j) - 20, x.s + 500)) AS wanted FROM k),
h AS (SELECT *, NOT gone AND e - s < 500 AND wanted > e AS held, sum(gone::INT) OVER (PARTITION BY track_id) AS removed FROM v), y AS (SELECT track_id, i, j, s, CASE WHEN held THEN wanted ELSE e END AS e, t, held, removed FROM h WHERE NOT gone),
z AS (SELECT *, lead(s) OVER (PARTITION BY track_id ORDER BY i, j) AS after, row_number() OVER (PARTITION BY track_id ORDER BY i, j) AS id FROM y), q AS (SELECT *, coalesce(e > after AND e - after <= 180 AND after - s >= 500, false) AS cut FROM z)
SELECT track_id, CAST(id AS INT) AS id, s AS start_ms, CASE WHEN cut THEN after ELSE e END AS end_ms, t AS text, CAST(removed AS INT) AS removed, CAST(merged AS INT) AS merged, CAST(sum(held::INT + cut::INT) OVER (PARTITION BY track_id) AS INT) AS adjusted FROM q JOIN m USING (track_id)"""
SQL["C5_stabilise_cues"] = LOOP


# Batches as a loop over each track's cues, with the newest twelve of the open batch.
SQL["T1_batches"] = f"""WITH RECURSIVE c AS (SELECT track_id, k AS id, start_ms, start_ms + length_ms AS end_ms, 'Line ' || k AS text, row_number() OVER w - 1 AS i, length('Line ' || k)::INT AS size, coalesce(start_ms - lag(start_ms + length_ms) OVER w >= 2500, false) AS pause FROM ({TIMES}) WINDOW w AS (PARTITION BY track_id ORDER BY k)),
r AS (SELECT track_id, 0::BIGINT AS place, 0::BIGINT AS first, 0::BIGINT AS chars, []::STRUCT(size INT, pause BOOLEAN)[] AS newest FROM c GROUP BY 1 UNION ALL
  SELECT track_id, place + 1, CASE WHEN filled THEN place - len(tail) ELSE first END, CASE WHEN filled THEN coalesce(list_sum(list_transform(tail, lambda x: x.size)), 0) ELSE chars END + size, (list_append(tail, {{'size': size, 'pause': pause}}))[-12:]
  FROM (SELECT *, CASE WHEN NOT filled THEN newest WHEN spot IS NULL THEN newest[1:0] ELSE newest[spot:] END AS tail
    FROM (SELECT r.*, size, pause, place - first >= 40 OR (place > first AND chars + size > 400) AS filled, list_max(list_filter(generate_series(1, len(newest)), lambda p: newest[p].pause AND (p > 1 OR len(newest) < place - first))) AS spot FROM r JOIN c ON c.track_id = r.track_id AND c.i = r.place))),
s AS (SELECT DISTINCT track_id, first AS i, 1 AS opens FROM r)
SELECT track_id, id, start_ms, end_ms, text, CAST(sum(coalesce(opens, 0)) OVER (PARTITION BY track_id ORDER BY i) - 1 AS INT) AS batch FROM c LEFT JOIN s USING (track_id, i)"""
