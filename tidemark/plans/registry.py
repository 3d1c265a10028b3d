"""All queries of the engine by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values
from ..operators import align, batches, cues, policy, refine, release, report, search, state, text
from ..session import stored
from ..sources import formats
from . import dialect
from .dialect import Dialect

FLAGSHIP = "R1_rank_candidates"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAIN = Dialect()


def adapter(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    return spark.sql(build(Dialect(sf_dir)))


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            SQL[name] = oracle
        return run

    return register


REQUESTS, CANDIDATES, RUNS, VISITS, TIMES = (f(PLAIN) for f in (dialect.requests, dialect.candidates, dialect.runs, dialect.visits, dialect.cue_times))
NORMAL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\.[A-Za-z0-9]{{2,4}}$', ''), '[._-]+', ' ', 'g'), '[\[\](){{}}]', ' ', 'g'), '\s+', ' ', 'g')))"
IGNORED = ", ".join(f"'{x}'" for x in release.IGNORED)
SIGNED = lambda name, n: f"""{n} AS normalized, CASE {" ".join(f"WHEN regexp_matches({n}, '{p}') THEN '{k}'" for k, p in release.SOURCES.items())} END AS source,
  CASE {" ".join(f"WHEN contains({n}, '{e}') THEN '{e}'" for e in release.EDITIONS)} END AS edition, nullif(lower(regexp_extract(regexp_replace({name}, '\\.[A-Za-z0-9]{{2,4}}$', ''), '-([A-Za-z0-9]{{2,20}})$', 1)), '') AS grp,
  CAST(nullif(regexp_extract({n}, '{release.FPS}', 1), '') AS DOUBLE) AS fps, CAST(nullif(regexp_extract({n}, '\\bs(\\d{{1,3}})e(\\d{{1,3}})\\b', 1), '') AS INT) AS season, CAST(nullif(regexp_extract({n}, '\\bs(\\d{{1,3}})e(\\d{{1,3}})\\b', 2), '') AS INT) AS episode,
  list_distinct(list_filter(string_split({n}, ' '), lambda t: length(t) > 1 AND t NOT IN ({IGNORED}))) AS tokens"""  # noqa: E731
RANKED = f"""WITH rq AS ({REQUESTS}), ca AS ({CANDIDATES}),
v AS (SELECT request_id, season AS ws, episode AS we, {SIGNED("filename", NORMAL.format("filename"))} FROM rq),
c AS (SELECT request_id AS rid, ordinal, provider, provider_id, release, hash_match, machine_translated, rating, downloads, {SIGNED("release", NORMAL.format("release"))} FROM ca),
j AS (SELECT v.*, c.rid, c.ordinal, c.provider, c.provider_id, c.hash_match, c.machine_translated, c.rating, c.downloads, c.normalized AS cn, c.source AS cs, c.edition AS ce, c.grp AS cg, c.season AS cse, c.episode AS cep,
  CASE WHEN c.release IS NULL THEN NULL WHEN len(v.tokens) = 0 OR len(c.tokens) = 0 THEN 0.0 ELSE len(list_intersect(v.tokens, c.tokens))::DOUBLE / greatest(len(v.tokens), len(c.tokens)) END AS sim,
  regexp_matches(v.normalized, '{release.REMUX}') AS vr, coalesce(regexp_matches(c.normalized, '{release.REMUX}'), false) AS cr FROM v JOIN c ON v.request_id = c.rid),
p AS (SELECT *, 10 + CASE WHEN hash_match THEN 65 ELSE 0 END + coalesce(floor(sim * 30 + 0.5), 0) + CASE WHEN source = cs THEN 12 WHEN source <> cs THEN -18 ELSE 0 END
  + CASE WHEN vr THEN CASE WHEN cr THEN 15 ELSE -12 END ELSE 0 END + CASE WHEN grp = cg THEN 18 ELSE 0 END
  + CASE WHEN edition = ce THEN 18 WHEN edition <> ce THEN -35 WHEN edition IS NOT NULL OR ce IS NOT NULL THEN -15 ELSE 0 END
  - CASE WHEN ws <> cse THEN 100 ELSE 0 END - CASE WHEN we <> cep THEN 100 ELSE 0 END - CASE WHEN machine_translated THEN 8 ELSE 0 END
  + least(8, floor(rating + 0.5)) + CASE WHEN downloads > 0 THEN least(5, floor(log10(downloads + 1))) ELSE 0 END AS raw,
  concat_ws('; ', CASE WHEN hash_match THEN 'exact video hash' END, CASE WHEN sim >= 0.65 THEN 'strong release-name match' END, CASE WHEN source = cs THEN 'same ' || source || ' source' END, CASE WHEN vr AND cr THEN 'same remux cut family' END, CASE WHEN grp = cg THEN 'same release group' END) AS reasons FROM j),
r AS (SELECT request_id, ordinal, provider, provider_id, CAST(greatest(0, least(100, raw)) AS INT) AS score, reasons FROM p),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ordinal) AS INT) AS position FROM r)
"""


@query("R1_rank_candidates", f"{RANKED} SELECT * FROM ranked")
def rank(spark, sf_dir):
    """Which candidate ranks best for every request, and why."""
    return release.rank_candidates(adapter(spark, sf_dir, dialect.requests), adapter(spark, sf_dir, dialect.candidates))


@query("R5_top_candidates", f"{RANKED} SELECT * FROM ranked WHERE position <= 10")
def top(spark, sf_dir):
    return release.rank_candidates(adapter(spark, sf_dir, dialect.requests), adapter(spark, sf_dir, dialect.candidates), keep=10)


@query("F4_release_signature", f"SELECT request_id, normalized, source, edition, grp, coalesce(season, 0) AS season, coalesce(episode, 0) AS episode FROM (SELECT request_id, {SIGNED('filename', NORMAL.format('filename'))} FROM (SELECT request_id, filename FROM ({REQUESTS})))")
def signatures(spark, sf_dir):
    out = adapter(spark, sf_dir, dialect.requests).select("request_id", release.signature(F.col("filename")).alias("s"))
    return out.select("request_id", "s.normalized", "s.source", "s.edition", F.col("s.group").alias("grp"), "s.season", "s.episode").fillna(0, ["season", "episode"])


@query("R3_unite_candidates", f"WITH c AS (SELECT request_id, provider, CAST(downloads % 50 AS STRING) AS provider_id, ordinal, rating, release FROM ({CANDIDATES})) SELECT request_id, provider, provider_id, min(ordinal) AS ordinal, max_by(rating, ordinal) AS rating, arg_max_null(release, ordinal) AS release FROM c GROUP BY ALL")
def united(spark, sf_dir):
    found = adapter(spark, sf_dir, dialect.candidates).select("request_id", "provider", (F.col("downloads") % 50).cast("string").alias("provider_id"), "ordinal", "rating", "release")
    return release.unite(found)


@query("R8_select_winner")
def winner(spark, sf_dir):
    """Waves, early stop and winner, with a confidence planted for each candidate."""
    ranked = release.waves(rank(spark, sf_dir))
    return release.winners(ranked.withColumn("confidence", (F.col("ordinal") * 37 + F.col("request_id") * 11) % 101))


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: length(t) >= 3 AND t NOT IN (" + STOP + ")))"


@query("F2_token_similarity", f"WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS a FROM conversations), u AS (SELECT t.conv_id, t.turn, t.a, n.a AS b FROM t JOIN t n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1) SELECT conv_id, turn, len(a) AS n_left, len(b) AS n_right, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)) END, 6) AS similarity FROM u")
def similarity(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", values.nfkc(F.col("text")).alias("text")).select("conv_id", "turn", text.spoken_tokens(F.col("text")).alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size("a").cast("long").alias("n_left"), F.size("b").cast("long").alias("n_right"), F.round(text.token_cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


TAGS = lambda d: f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '-XX' WHEN 1 THEN {d.at('fre,ger,und,pt_BR,ARA,xyz', '1 + doc_id % 5')} WHEN 2 THEN 'spa' ELSE upper(lang) END AS tag FROM {d.table('documents')}"


@query("F6_language_codes", f"""WITH t AS (SELECT doc_id, string_split(replace(lower(trim(tag)), '_', '-'), '-')[1] AS s FROM ({TAGS(PLAIN)})), three(k, v) AS (VALUES {", ".join(str((v, k)) for k, v in (text.TWO_TO_THREE | {v: k for k, v in {}}).items())}, {", ".join(str(x) for x in text.BIBLIOGRAPHIC.items())}),
two AS (SELECT doc_id, CASE WHEN s IN ('und', 'unk', 'unknown', 'mul', 'zxx') THEN NULL WHEN length(s) = 2 THEN s ELSE coalesce(v, s) END AS code FROM t LEFT JOIN three ON k = s)
SELECT doc_id, code FROM two""")
def languages(spark, sf_dir):
    return adapter(spark, sf_dir, TAGS).select("doc_id", text.language(F.col("tag")).alias("code"))


FILES = lambda d: f"""SELECT doc_id AS track_id, '1' || chr(13) || chr(10) || '00:00:0' || CAST(doc_id % 10 AS STRING) || ',500 --> 00:00:12.250' || chr(10) || 'First ' || source || chr(10) || 'line' || chr(10) || chr(10)
  || '2' || chr(10) || '00:00:30,000 --> 00:00:29,000' || chr(10) || 'backwards' || chr(10) || chr(10) || chr(10) || 'no timing here' || chr(10) || chr(10)
  || '10:00:01,500 --> 10:0' || CAST(doc_id % 7 AS STRING) || ':04,000 align:start' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END || chr(10) AS content FROM {d.table('documents')}"""  # noqa: E731


@query("D8_parse_srt", f"""WITH b AS (SELECT track_id, generate_subscripts(x, 1) AS pos, unnest(x) AS block FROM (SELECT track_id, regexp_split_to_array(trim(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10) || ' '), '\\n{{2,}}') AS x FROM ({FILES(PLAIN)}))),
l AS (SELECT track_id, pos, string_split(block, chr(10)) AS lines FROM b), k AS (SELECT *, list_position(list_transform(lines, lambda x: contains(x, '-->')), true) AS ln FROM l),
g AS (SELECT track_id, pos, regexp_extract(lines[ln], '{text.TIMING}', ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h']) AS m, trim(array_to_string(lines[ln + 1:], chr(10)), ' ' || chr(10)) AS text FROM k WHERE ln > 0),
c AS (SELECT track_id, pos, ((m.a::BIGINT * 60 + m.b::BIGINT) * 60 + m.c::BIGINT) * 1000 + m.d::BIGINT AS start_ms, ((m.e::BIGINT * 60 + m.f::BIGINT) * 60 + m.g::BIGINT) * 1000 + m.h::BIGINT AS end_ms, text FROM g)
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY pos) AS INT) AS id, start_ms, end_ms, text FROM c WHERE end_ms > start_ms AND text <> ''""")
def parsed(spark, sf_dir):
    return text.parse_srt(adapter(spark, sf_dir, FILES))


@query("C5_stabilise_cues")
def stabilised(spark, sf_dir):
    """Cues with planted repeats, one-frame cues and overlaps, cleaned."""
    times = adapter(spark, sf_dir, dialect.cue_times)
    start = F.col("start_ms") - F.when(F.col("k") % 7 == 3, 1200).otherwise(0)
    length = F.when(F.col("k") % 11 == 5, 90).when(F.col("k") % 13 == 4, 300).otherwise(F.col("length_ms"))
    said = F.concat(F.lit("Line "), (F.col("k") - F.when(F.col("k") % 7 == 3, 1).otherwise(0)).cast("string"))
    return cues.stabilise(times.select("track_id", (F.col("k") + 1).cast("int").alias("id"), start.alias("start_ms"), (start + length).alias("end_ms"), said.alias("text")))


WINDOWS = "SELECT track_id, w AS window_ix, CAST(floor(last * w / 500.0) AS BIGINT) * 100 AS from_ms, 24000 AS length_ms FROM tracks, (VALUES (0), (1), (2), (3), (4)) x(w)"
PLANTED = f"""t AS (SELECT track_id, start_ms, start_ms + length_ms AS end_ms, (track_id % 5) * 700 AS shift FROM ({TIMES})), tracks AS (SELECT track_id, max(start_ms) AS last FROM t GROUP BY 1), w AS ({WINDOWS}),
x AS (SELECT w.track_id, window_ix, from_ms, start_ms + shift - from_ms AS s, end_ms + shift - from_ms AS e FROM w JOIN t USING (track_id) WHERE start_ms + shift <= from_ms + length_ms AND end_ms + shift >= from_ms)"""


def planted(spark, sf_dir):
    """(cues, windows, maps): speech is the cues shifted by a planted offset; five windows over each track's whole length."""
    times = adapter(spark, sf_dir, dialect.cue_times).select("track_id", "start_ms", (F.col("start_ms") + F.col("length_ms")).alias("end_ms"))
    shift = (F.col("track_id") % 5) * 700
    moved = times.select("track_id", (F.col("start_ms") + shift).alias("s"), (F.col("end_ms") + shift).alias("e"))
    tracks = times.groupBy("track_id").agg(F.max("start_ms").alias("last"))
    grid = tracks.select("track_id", "last", F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("window_ix"))
    grid = grid.select("track_id", "window_ix", (F.floor(F.col("last") * F.col("window_ix") / 500.0) * 100).alias("from_ms"), F.lit(24000).alias("length_ms"))
    spoken = grid.join(moved, "track_id").where("s <= from_ms + length_ms and e >= from_ms")
    speech = F.struct(F.greatest(F.lit(0), F.col("s") - F.col("from_ms")).alias("start_ms"), F.least(F.col("length_ms"), F.col("e") - F.col("from_ms")).alias("end_ms"))
    heard = spoken.groupBy("track_id", "window_ix").agg(F.array_sort(F.collect_list(speech)).alias("speech"))
    windows = grid.join(heard, ["track_id", "window_ix"], "left").withColumn("speech", F.coalesce("speech", F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")))
    maps = tracks.select("track_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("map_id")).select("track_id", "map_id", F.lit(1.0).alias("rate"), ((F.col("track_id") % 5) * 700 + F.col("map_id") * 900).alias("offset_ms"))
    return times, windows, maps


@query("J1_activity_score", f"""WITH {PLANTED}, mp AS (SELECT track_id, m AS map_id, (track_id % 5) * 700 + m * 900 AS o FROM tracks, (VALUES (0), (1)) x(m)),
sp AS (SELECT DISTINCT track_id, window_ix, unnest(range(CAST(floor(greatest(0, s) / 100.0) AS BIGINT), CAST(least(239, floor(least(24000, e) / 100.0)) AS BIGINT) + 1)) AS bin FROM x),
mc AS (SELECT w.track_id, window_ix, map_id, start_ms + o - from_ms AS s, end_ms + o - from_ms AS e FROM w JOIN mp USING (track_id) JOIN t USING (track_id) WHERE start_ms + o <= from_ms + length_ms AND end_ms + o >= from_ms),
me AS (SELECT DISTINCT track_id, window_ix, map_id, unnest(range(CAST(greatest(0, floor(s / 100.0)) AS BIGINT), CAST(least(239, floor(e / 100.0)) AS BIGINT) + 1)) AS bin FROM mc),
n AS (SELECT track_id, window_ix, map_id, count(*) AS nm, count(sp.bin) AS nb FROM me LEFT JOIN sp USING (track_id, window_ix, bin) GROUP BY ALL), a AS (SELECT track_id, window_ix, count(*) AS na FROM sp GROUP BY ALL)
SELECT track_id, window_ix, map_id, round(CASE WHEN nm >= 4 AND na >= 4 THEN 0.72 * nb / nm + 0.28 * nb / na ELSE 0 END, 6) AS score FROM w JOIN mp USING (track_id) LEFT JOIN n USING (track_id, window_ix, map_id) LEFT JOIN a USING (track_id, window_ix)""")
def activity(spark, sf_dir):
    return align.activity_scores(*planted(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("J2_overall_score", f"""WITH s AS ({{J1}}), u AS (SELECT track_id, map_id, count(*) AS n, avg(score) FILTER (WHERE score > 0) AS mean, list(score ORDER BY score) FILTER (WHERE score > 0) AS l FROM s GROUP BY ALL)
SELECT track_id, map_id, round(CASE WHEN l IS NULL OR len(l) < 3 THEN 0 ELSE (0.72 * mean + 0.28 * l[1 + CAST(floor((len(l) - 1) * 0.25) AS INT)]) * len(l) / n END, 5) AS score FROM u""")
def overall(spark, sf_dir):
    return align.overall(activity(spark, sf_dir)).withColumn("score", F.round("score", 5))


def reference_of(times: DataFrame) -> DataFrame:
    return times.where("k % 7 <> 2").select("track_id", (F.col("start_ms") + 400 + (F.col("k") * 31) % 90).alias("at_ms"))


@query("J6_nearest_events", f"""WITH t AS ({TIMES}), x AS (SELECT track_id, start_ms AS at_ms FROM t), y AS (SELECT track_id, start_ms + 400 + (k * 31) % 90 AS at_ms FROM t WHERE k % 7 <> 2),
n AS (SELECT track_id, max(at_ms) AS d FROM (FROM x UNION ALL FROM y) GROUP BY ALL), xs AS (SELECT track_id, at_ms, CAST(floor(at_ms * 6 / d) AS INT) AS section FROM x JOIN n USING (track_id) WHERE at_ms < d), ys AS (SELECT track_id, at_ms, CAST(floor(at_ms * 6 / d) AS INT) AS section FROM y JOIN n USING (track_id) WHERE at_ms < d),
f AS (SELECT 0 AS side, a.track_id, a.section, a.at_ms, a.at_ms - p.at_ms AS dp FROM xs a ASOF LEFT JOIN ys p ON a.track_id = p.track_id AND a.section = p.section AND a.at_ms >= p.at_ms UNION ALL SELECT 1, a.track_id, a.section, a.at_ms, a.at_ms - p.at_ms FROM ys a ASOF LEFT JOIN xs p ON a.track_id = p.track_id AND a.section = p.section AND a.at_ms >= p.at_ms),
g AS (SELECT f.*, q.at_ms - f.at_ms AS dn FROM f ASOF LEFT JOIN ys q ON f.track_id = q.track_id AND f.section = q.section AND f.at_ms <= q.at_ms WHERE side = 0 UNION ALL SELECT f.*, q.at_ms - f.at_ms FROM f ASOF LEFT JOIN xs q ON f.track_id = q.track_id AND f.section = q.section AND f.at_ms <= q.at_ms WHERE side = 1),
m AS (SELECT track_id, section, avg(greatest(0, 1 - coalesce(least(dp, dn), 1500) / 1500.0)) FILTER (WHERE side = 0) AS a, avg(greatest(0, 1 - coalesce(least(dp, dn), 1500) / 1500.0)) FILTER (WHERE side = 1) AS b, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM g GROUP BY ALL)
SELECT track_id, section, round(CASE WHEN na >= 3 AND nb >= 3 THEN (a + b) / 2 ELSE 0 END + 1e-9, 6) AS score FROM m""")
def nearest(spark, sf_dir):
    times = adapter(spark, sf_dir, dialect.cue_times)
    return align.proximity_scores(times.select("track_id", F.col("start_ms").alias("at_ms")), reference_of(times)).withColumn("score", F.round(F.col("score") + 1e-9, 6))  # a tie in the last place falls alike whatever the order of summing


def tracks_of(found: DataFrame, windows: DataFrame) -> DataFrame:
    arrays = found.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("c")).select("track_id", F.col("c.start_ms").alias("starts"), F.col("c.end_ms").alias("ends"))
    heard = windows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("window_ix", "from_ms", "length_ms", "speech"))).alias("windows"))
    return arrays.join(heard, "track_id")


@query("X11_align_activity")
def by_activity(spark, sf_dir):
    """The full search over rates and offsets up to 180 s, for every track and all its cues, with the shift onto speech."""
    found, windows = map(stored, planted(spark, sf_dir)[:2])  # the refinement joins them again and again
    return refine.activity_confidence(stored(search.align_to_activity(tracks_of(found, windows))), found, windows)


@query("X13_align_reference")
def by_reference(spark, sf_dir):
    times = stored(adapter(spark, sf_dir, dialect.cue_times))
    reference = stored(reference_of(times))
    starts = times.groupBy("track_id").agg(F.sort_array(F.collect_list("start_ms")).alias("starts"))
    there = reference.groupBy("track_id").agg(F.sort_array(F.collect_list("at_ms")).alias("reference"))
    found = stored(search.align_to_reference(starts.join(there, "track_id")))
    return refine.reference_confidence(found, times.select("track_id", F.col("start_ms").alias("at_ms")), reference)


@query("G1_dashboard", f"""WITH r AS ({RUNS}) SELECT count(*) AS runs, count(*) FILTER (WHERE outcome <> 'cached') AS prepared, count(*) FILTER (WHERE outcome = 'failed') AS failed, round((count(*) FILTER (WHERE outcome <> 'cached') - count(*) FILTER (WHERE outcome = 'failed'))::DOUBLE / count(*) FILTER (WHERE outcome <> 'cached'), 6) AS success_rate,
round(avg(total_ms) FILTER (WHERE outcome <> 'cached'), 6) AS cold_ms, count(*) FILTER (WHERE outcome = 'translated' AND cues IS NOT NULL) AS translations, CAST(sum(cues) FILTER (WHERE outcome = 'translated') AS BIGINT) AS cues, CAST(sum(transcripts) AS BIGINT) AS transcripts, count(*) FILTER (WHERE transcripts = 0) AS reused FROM r""")
def dashboard(spark, sf_dir):
    return report.dashboard(adapter(spark, sf_dir, dialect.runs))


@query("G5_failure_reasons", f"WITH r AS (SELECT coalesce(failure, 'unknown') AS reason, count(*) AS n, min((at_ms, run_id)) AS f FROM ({RUNS}) WHERE outcome = 'failed' GROUP BY 1) SELECT reason, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INT) AS position FROM r")
def failures(spark, sf_dir):
    return report.failure_reasons(adapter(spark, sf_dir, dialect.runs))


@query("K4_newest_runs", f"SELECT run_id, at_ms, outcome, total_ms FROM ({RUNS}) ORDER BY at_ms DESC, run_id DESC LIMIT 25")
def newest(spark, sf_dir):
    return report.newest_runs(adapter(spark, sf_dir, dialect.runs))


@query("W1_rate_limit", f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_ms, event_id) AS i FROM ({VISITS})),
f AS (SELECT client, event_id, at_ms, i, at_ms + 60000 AS reset, 1 AS n FROM v WHERE i = 1 UNION ALL
  SELECT v.client, v.event_id, v.at_ms, v.i, CASE WHEN f.reset <= v.at_ms THEN v.at_ms + 60000 ELSE f.reset END, CASE WHEN f.reset <= v.at_ms THEN 1 ELSE f.n + 1 END FROM f JOIN v ON v.client = f.client AND v.i = f.i + 1)
SELECT client, event_id, at_ms, n <= 6 AS allowed, CASE WHEN n > 6 THEN CAST(ceil((reset - at_ms) / 1000.0) AS BIGINT) ELSE 0 END AS retry_after FROM f""")
def limited(spark, sf_dir):
    return state.rate_limit(adapter(spark, sf_dir, dialect.visits), limit=6).fillna(0, ["retry_after"])


@query("W9_rejections", f"""WITH e AS ({VISITS}), f AS (SELECT client, item, min((at_ms, event_id)) AS t FROM e GROUP BY ALL), r AS (SELECT client, item, row_number() OVER (PARTITION BY client ORDER BY t DESC) AS n FROM f),
k AS (SELECT client FROM e GROUP BY client ORDER BY max((at_ms, event_id)) DESC LIMIT 100) SELECT client, item, CAST(n AS INT) AS n FROM r WHERE n <= 20 AND client IN (SELECT client FROM k)""")
def rejected(spark, sf_dir):
    return state.rejections(adapter(spark, sf_dir, dialect.visits), keys=100)


@query("W12_selections", f"WITH e AS ({VISITS}) SELECT client, max_by(item, (at_ms, event_id)) AS item, max(at_ms) AS at_ms FROM e WHERE kind = 'purchase' GROUP BY client HAVING max(at_ms) > (SELECT max(at_ms) FROM e) - 30000")
def selected(spark, sf_dir):
    seen = adapter(spark, sf_dir, dialect.visits)
    now = seen.agg(F.max("at_ms")).first()[0] or 0
    return state.selections(seen.where("kind = 'purchase'"), now, 30_000)


FRAMES = lambda d: f"SELECT user_id AS client, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n, value > 60 AS active FROM {d.table('events')}"


@query("V1_speech_islands", f"""WITH f AS ({FRAMES(PLAIN)}), v AS (SELECT a.client, a.n FROM f a JOIN f b ON a.client = b.client AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.active GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT client, n, CASE WHEN lag(n) OVER w = n - 1 THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY client ORDER BY n)), g AS (SELECT client, n, sum(fresh) OVER (PARTITION BY client ORDER BY n) AS g FROM s)
SELECT client, min(n) AS first, max(n) AS last, count(*) AS frames FROM g GROUP BY client, g HAVING count(*) >= 3""")
def speech(spark, sf_dir):
    return state.islands(adapter(spark, sf_dir, FRAMES))


@query("V5_sample_starts", """WITH t AS (SELECT o_orderkey AS probe_id, CAST(floor(o_totalprice) AS BIGINT) * 40 AS ms FROM orders), k AS (SELECT probe_id, ms, unnest(range(0, 4)) AS k FROM t WHERE ms >= 60000)
SELECT probe_id, CAST(k AS INT) AS k, CAST(floor(least(120000, ms * 0.04) + (ms * 0.92 - 15000 - least(120000, ms * 0.04)) * k / 3.0 + 0.5) AS BIGINT) AS start_ms FROM k""")
def starts(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("probe_id"), (F.floor("o_totalprice").cast("long") * 40).alias("ms"))
    first, last = F.least(F.lit(120000.0), F.col("ms") * 0.04), F.col("ms") * 0.92 - 15000
    each = probes.where("ms >= 60000").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return each.select("probe_id", "k", F.floor(first + (last - first) * F.col("k") / 3.0 + 0.5).cast("long").alias("start_ms"))


PLAINLY = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '[\p{{P}}\p{{S}}]+', ' ', 'g')), '\s+', ' ', 'g'))"


@query("T4_unchanged_share", f"""WITH p AS (SELECT conv_id % 25 AS track_id, text AS x, CASE WHEN (conv_id + turn) % 3 = 0 THEN '<i>' || text || '</i>!' ELSE text || ' x' END AS y FROM conversations WHERE regexp_matches(text, '\\p{{L}}{{4}}')),
c AS (SELECT track_id, count(*) AS n, count(*) FILTER (WHERE {PLAINLY.format("x")} = {PLAINLY.format("y")}) AS same FROM p GROUP BY 1) SELECT *, n >= 10 AND same > 0.25 * n AS refused FROM c""")
def unchanged(spark, sf_dir):
    """Share of cues that a translation left as they were."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    number = F.col("conv_id") * 100 + F.col("turn")
    cues = turns.select((F.col("conv_id") % 25).alias("track_id"), number.alias("id"), "text").dropDuplicates(["track_id", "id"])
    new = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("<i>"), F.col("text"), F.lit("</i>!"))).otherwise(F.concat("text", F.lit(" x")))
    return batches.unchanged(cues, turns.select((F.col("conv_id") % 25).alias("track_id"), number.alias("id"), new.alias("text")).dropDuplicates(["track_id", "id"]))


ENTRIES = lambda d: f"""SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS ordinal, CASE WHEN l_suppkey % 11 = 0 THEN '__MACOSX/' ELSE '' END || 'show.s01e0' || CAST(1 + l_partkey % 4 AS STRING)
  || CASE WHEN l_suppkey % 5 = 0 THEN '.Sample' ELSE '' END || {d.at('.en,.Arabic,.FRE-forced,,.pt-BR', '1 + CAST(l_quantity AS BIGINT) % 5')} || {d.at('.srt,.ass,.nfo,.VTT,.sub', '1 + l_partkey % 5')} AS name, CAST(floor(l_extendedprice * 80) AS BIGINT) AS bytes, CAST(1 + l_orderkey % 4 AS INT) AS episode, {d.at('en,ar,fra,pt,xx', '1 + l_orderkey % 5')} AS language FROM {d.table('lineitem')}"""  # noqa: E731


@query("D3_choose_file", """WITH e AS (SELECT * FROM ({ENTRIES}) WHERE regexp_matches(name, '\\.(srt|vtt|ass|ssa)$', 'i') AND NOT regexp_matches(name, '(^|/)(__MACOSX/|\\._)') AND bytes <= 5242880),
a AS (SELECT *, regexp_matches(name, '(s[0-9]{1,3}e|e|episode[ ._-]*)0?' || episode || '([^0-9]|$)', 'i') AS f1 FROM e), b AS (SELECT *, bool_or(f1) OVER (PARTITION BY file_id) AS any1 FROM a),
c AS (SELECT *, regexp_matches(name, '(^|[^\\p{L}\\p{N}])(' || CASE language WHEN 'en' THEN 'en|eng|english' WHEN 'ar' THEN 'ar|ara|arabic|العربية' WHEN 'fra' THEN 'fr|fra|fre|french' WHEN 'pt' THEN 'pt' ELSE 'xx' END || ')($|[^\\p{L}\\p{N}])', 'i') AS f2 FROM b WHERE f1 OR NOT any1),
d AS (SELECT *, bool_or(f2) OVER (PARTITION BY file_id) AS any2 FROM c), f AS (SELECT *, NOT regexp_matches(name, '\\b(sample|trailer|preview)\\b', 'i') AS f3 FROM d WHERE f2 OR NOT any2), g AS (SELECT *, bool_or(f3) OVER (PARTITION BY file_id) AS any3 FROM f)
SELECT file_id, ordinal, name, bytes FROM g WHERE f3 OR NOT any3 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY bytes DESC, ordinal) = 1""".replace("{ENTRIES}", ENTRIES(PLAIN)))
def chosen_file(spark, sf_dir):
    return formats.choose_file(adapter(spark, sf_dir, ENTRIES))


@query("T1_batches")
def batched(spark, sf_dir):
    """Batches of at most 40 cues and 400 characters."""
    times = adapter(spark, sf_dir, dialect.cue_times)
    return batches.batch_cues(times.select("track_id", F.col("k").alias("id"), "start_ms", (F.col("start_ms") + F.col("length_ms")).alias("end_ms"), F.concat(F.lit("Line "), F.col("k").cast("string")).alias("text")), 40, 400)


@query("G6_cache_search", """WITH c AS (SELECT o_orderkey AS key, 'tt' || CAST(o_custkey AS VARCHAR) AS content_id, o_orderpriority AS provider, o_orderstatus AS language, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS cached_at FROM orders)
SELECT key, content_id, provider, bytes, CAST(sum(bytes) OVER () AS BIGINT) AS shown_bytes FROM (SELECT * FROM c WHERE contains(lower(content_id || ' ' || provider || ' ' || language), 'urgent') ORDER BY cached_at DESC, key DESC LIMIT 200)""")
def cached(spark, sf_dir):
    """The newest 200 cache entries that a search word fits."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    entries = orders.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("tt"), F.col("o_custkey").cast("string")).alias("content_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("language"), F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("cached_at"))
    found = entries.where(F.lower(F.concat_ws(" ", "content_id", "provider", "language")).contains("urgent")).orderBy(F.desc("cached_at"), F.desc("key")).limit(200)
    total = found.agg(F.sum("bytes").cast("long").alias("shown_bytes"))
    return found.crossJoin(F.broadcast(total)).select("key", "content_id", "provider", "bytes", "shown_bytes")


@query("V4_sample_seconds", "SELECT o_orderkey AS probe_id, CAST(CASE WHEN o_custkey % 9 = 0 THEN 15 ELSE greatest(8, least(15, floor(62914560.0 / floor(o_totalprice * 40)))) END AS INT) AS seconds FROM orders")
def sample_lengths(spark, sf_dir):
    rate = F.when(F.col("o_custkey") % 9 != 0, F.floor(F.col("o_totalprice") * 40))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("probe_id"), policy.sample_seconds(15, 4, 240 << 20, rate).alias("seconds"))


@query("S12_wait_times", "SELECT event_id, CAST(least(30000, 250 * pow(2, event_id % 12)) AS BIGINT) AS wait_ms FROM events")
def waits(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", policy.wait_ms(F.col("event_id") % 12 + 1).alias("wait_ms"))


@query("W17_banners", f"SELECT track_id, 300::BIGINT AS start_ms, least(6300, f - 200)::BIGINT AS end_ms FROM (SELECT track_id, min(start_ms + (track_id % 9) * 400 - 600) AS f FROM ({TIMES}) GROUP BY 1) WHERE least(6300, f - 200) - 300 >= 1500")
def banner_places(spark, sf_dir):
    times = adapter(spark, sf_dir, dialect.cue_times)
    return policy.banners(times.select("track_id", (F.col("start_ms") + (F.col("track_id") % 9) * 400 - 600).alias("start_ms")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("{J1}", SQL["J1_activity_score"]) for k, v in SQL.items()}


from . import deep, more, routes, wide  # noqa: E402, F401 (they add their queries to the registry)
