"""Decisions over many releases at once: which route a subtitle comes by, what is kept, looked up, waited for and served."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sources tried, the bar over a rejecting reference and its distance from the usual one, the rank that goes with it and what it adds; how old a record may be before it is refreshed, how long a request waits for a selection, in ms; keys removed at once.
SOURCES, OVERRIDE_BAR, OVERRIDE_STEP, OVERRIDE_RANK, OVERRIDE_ADDS = 5, 75, 5, 35, 35
REFRESH_MS, WAIT_MS, REMOVED = 60_000, 12_000, 200


def translation_gate(mode: Column, asked: Column, source_language: Column, target_language: Column) -> Column:
    """null where a translation may go ahead, else why not."""
    return F.when((mode == "off") | ((mode == "manual") & ~F.coalesce(asked, F.lit(False))), "not requested").when(source_language == target_language, "same language")


def audio_usage(windows: DataFrame) -> DataFrame:
    """windows (release, seconds, transcribed, requests, reused) to (release, windows, sampled_seconds, transcripts, requests, submitted_seconds): requests are none where the analysis was reused."""
    own = lambda x: F.sum(F.when(F.col("reused"), 0).otherwise(x))
    return windows.groupBy("release").agg(F.count("*").alias("windows"), F.round(F.sum("seconds"), 2).alias("sampled_seconds"), F.count_if("transcribed").alias("transcripts"), own(F.col("requests")).cast("long").alias("requests"), F.round(own(F.col("seconds") * F.col("requests")), 2).alias("submitted_seconds"))


def upserted(writes: DataFrame, key: str = "key") -> DataFrame:
    """Of each key's writes (with `at_ms` and `ordinal`) the last."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("at_ms", "ordinal")).alias("w")).select(key, "w.*")


def inventory(entries: DataFrame) -> DataFrame:
    """entries (key, content, cached_at_ms, modified_ms) that can be read, with their bytes, newest first; where the time of caching is missing, the file's."""
    when = F.coalesce("cached_at_ms", "modified_ms").alias("at_ms")
    return entries.where("key is not null and content is not null").select("key", F.octet_length("content").cast("long").alias("bytes"), when).orderBy(F.desc("at_ms"), "key")


def removals(asked: DataFrame, entries: DataFrame, most: int = REMOVED) -> DataFrame:
    """(key) of entries to remove: the first `most` distinct valid keys asked for (key, ordinal) that exist."""
    first = asked.where(F.col("key").rlike("^[0-9a-f]{64}$")).groupBy("key").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal").limit(most)
    return first.join(entries.select("key").distinct(), "key", "left_semi").select("key")


def select_stream(streams: DataFrame, preferred: Column) -> DataFrame:
    """(probe_id, index): the audio stream in the preferred language, else one titled original, else the default one, else the first."""
    rank = F.when((F.col("language") == preferred) & (preferred != ""), 0).when(F.lower(F.coalesce("title", F.lit(""))).contains("original"), 1).when(F.col("is_default") == 1, 2).otherwise(3)
    return streams.where("codec_type = 'audio'").groupBy("probe_id").agg(F.min_by("index", F.struct(rank.alias("rank"), "ordinal")).alias("index"))


def probed(probes: DataFrame) -> DataFrame:
    """probes (probe_id, body): duration_ms (90 minutes where none of a minute or more is told), whether it is known, and bytes per second of the container."""
    shape = "struct<format:struct<duration:string,size:string,bit_rate:string>,streams:array<struct<duration:string>>>"
    j = probes.select("probe_id", F.from_json("body", shape).alias("j"))
    told = F.concat(F.array(F.col("j.format.duration")), F.coalesce(F.transform("j.streams", lambda s: s["duration"]), F.array().cast("array<string>")))
    longest = F.array_max(F.filter(F.transform(told, lambda x: x.try_cast("double")), lambda x: x >= 60))
    ms = F.when(longest.isNotNull(), F.floor(longest * 1000 + 0.5)).otherwise(5_400_000).cast("long")
    rate, bytes_ = F.col("j.format.bit_rate").try_cast("double"), F.col("j.format.size").try_cast("double")
    return j.select("probe_id", ms.alias("duration_ms"), longest.isNotNull().alias("known"), F.when(rate > 0, rate / 8).when(bytes_ > 0, bytes_ / (ms / 1000)).alias("bytes_per_second"))


def find_stream(requests: DataFrame, records: DataFrame, selections: DataFrame, now: int, ttl_ms: int) -> DataFrame:
    """(request_id, record_id): a title's selected record, else its record of the same hash, name or size (of several the first put in), else its only one; live records only. records: record_id, title, seen_ms, ordinal, video_hash, filename, video_size."""
    live = records.where(F.col("seen_ms") > now - ttl_ms)
    chosen = live.join(selections.select("title", F.col("record_id").alias("selected")).withColumnRenamed("title", "of"), (F.col("title") == F.col("of")) & (F.col("record_id") == F.col("selected")), "left").drop("of")
    asked = requests.select("request_id", "title", *[F.col(c).alias(f"want_{c}") for c in ("video_hash", "filename", "video_size")])
    counted = chosen.withColumn("alone", F.count("*").over(Window.partitionBy("title")) == 1)
    both = asked.join(counted, "title")
    same = lambda c: F.coalesce(F.col(f"want_{c}") == F.col(c), F.lit(False))
    rank = F.when(F.col("selected").isNotNull(), 0).when(same("video_hash"), 1).when(same("filename"), 2).when(same("video_size"), 3).when(F.col("alone"), 4)
    return both.withColumn("rank", rank).where("rank is not null").groupBy("request_id").agg(F.min_by("record_id", F.struct("rank", "ordinal")).alias("record_id"))


def waited_for(requests: DataFrame, selections: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """requests (request_id, client, at_ms), selections (client, item, at_ms): (request_id, item, waited_ms) of the selection that stands at the request, else of the first within the wait. One ordered pass over both."""
    none = F.lit(None)
    both = requests.select("client", F.col("at_ms").alias("t"), "request_id", none.cast("struct<at:bigint,item:bigint>").alias("s"))
    both = both.union(selections.select("client", F.col("at_ms").alias("t"), none.cast(requests.schema["request_id"].dataType).alias("request_id"), F.struct(F.col("at_ms").cast("long").alias("at"), F.col("item").cast("long").alias("item"))))
    before = Window.partitionBy("client").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("client").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    told = both.select("request_id", "t", F.max("s").over(before).alias("old"), F.min("s").over(after).alias("new")).where("request_id is not null")
    waited = F.col("new.at") - F.col("t")
    found = F.when(F.col("old").isNotNull(), F.struct(F.col("old.item").alias("item"), F.lit(0).cast("long").alias("w"))).when(waited <= wait_ms, F.struct(F.col("new.item").alias("item"), waited.alias("w")))
    return told.select("request_id", found.alias("f")).where("f is not null").select("request_id", "f.item", F.col("f.w").alias("waited_ms"))


def job_results(asked: DataFrame, jobs: DataFrame, wait_ms: int) -> DataFrame:
    """asked (ask_id, job_id, at_ms), jobs (job_id, done_ms, failed): the state that a bounded wait sees."""
    seen = F.coalesce(F.col("done_ms") <= F.col("at_ms") + wait_ms, F.lit(False))
    state = F.when(F.col("known").isNull(), "unknown").when(seen & F.col("failed"), "failed").when(seen, "ready").otherwise("preparing")
    return asked.join(jobs.withColumn("known", F.lit(True)), "job_id", "left").select("ask_id", "job_id", state.alias("state"))


def wrapped(listings: DataFrame, refresh_ms: int = REFRESH_MS, ttl_ms: int | None = None) -> DataFrame:
    """listings (key, at_ms, event_id, hint): each key's record as it stands after all of them, (key, seen_ms, hint, refreshed): a listing refreshes the record, and its hint where it brings one, only if the last refresh is over refresh_ms ago; after ttl_ms the record is a new one. Keys' listings stream past in order."""

    def run(batches):
        key, seen, hint, count = None, 0, None, 0
        for rows in batches:
            out = []
            for k, at, h in zip(rows["key"].tolist(), rows["at_ms"].tolist(), rows["hint"].astype(object).where(rows["hint"].notna(), None).tolist()):
                if k != key:
                    if key is not None:
                        out.append((key, seen, hint, count))
                    key, seen, hint, count = k, at, h, 0
                elif ttl_ms is not None and at - seen >= ttl_ms:
                    seen, hint, count = at, h, 0
                elif at - seen > refresh_ms:
                    seen, hint, count = at, hint if h is None else h, count + 1
            yield pd.DataFrame(out, columns=["key", "seen_ms", "hint", "refreshed"])
        if key is not None:
            yield pd.DataFrame([(key, seen, hint, count)], columns=["key", "seen_ms", "hint", "refreshed"])

    kinds = {f.name: f.dataType.simpleString() for f in listings.schema}
    ordered = listings.select("key", F.col("at_ms").cast("long").alias("at_ms"), "event_id", "hint").repartition("key").sortWithinPartitions("key", "at_ms", "event_id")
    return ordered.mapInPandas(run, f"key {kinds['key']}, seen_ms long, hint {kinds['hint']}, refreshed int")


def collected(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """expected (batch, id), rows (batch, pos, id, text): (batch, n, complete): how many cues of a batch got an answer that isn't blank, the first one counting."""
    good = rows.where("trim(text) <> ''").groupBy("batch", "id").agg(F.min_by("text", "pos").alias("text"))
    return expected.join(good, ["batch", "id"], "left").groupBy("batch").agg(F.count("text").alias("n"), (F.count("text") == F.count("*")).alias("complete"))


def search_terms(languages: Column, season: Column, episode: Column, video_hash: Column, imdb_id: Column, filename: Column) -> Column:
    """struct(by_hash, by_name): the parameters of up to two searches; null where there is no hash."""
    series = F.concat_ws("&", F.when(season != 0, F.concat(F.lit("season_number="), season.cast("string"))), F.when(episode != 0, F.concat(F.lit("episode_number="), episode.cast("string"))), F.lit("type=episode"))
    common = F.concat(F.lit("languages="), F.array_join(F.array_sort(languages), ","), F.lit("&"), F.when(season.isNotNull() | episode.isNotNull(), series).otherwise("type=movie"))
    named = F.when(imdb_id.isNotNull(), F.concat(F.lit("imdb_id="), F.regexp_replace(imdb_id, "^tt", ""))).when(filename.isNotNull(), F.concat(F.lit("query="), F.lower(filename)))
    return F.struct(F.when(video_hash.isNotNull(), F.concat(common, F.lit("&moviehash="), video_hash)).alias("by_hash"), F.concat_ws("&", common, named).alias("by_name"))


def allowed_download(url: Column, origin: str, paths: list[str]) -> Column:
    """Whether an address has the origin and one of the paths, and nothing else before them."""
    scheme, host = origin.split("://")
    path = F.parse_url(url, F.lit("PATH"))
    inside = F.lit(False)
    for p in paths:
        inside = inside | path.startswith(p)
    return F.coalesce((F.parse_url(url, F.lit("PROTOCOL")) == scheme) & (F.parse_url(url, F.lit("HOST")) == host) & inside, F.lit(False))


def titles(rows: DataFrame) -> DataFrame:
    """rows (request_id, ordinal, title_id, exact) to (request_id, title_id): the first exact title, else the first."""
    return rows.groupBy("request_id").agg(F.min_by("title_id", F.struct((~F.col("exact")).alias("other"), "ordinal", "title_id")).alias("title_id"))


def config_warnings(token: Column, public_url: Column, audio: Column, translation: Column, configured: Column) -> Column:
    """What to tell an operator about settings, in order."""
    token_said = F.when(token == "", "token unset").when(F.length(token) < 24, "token short")
    return F.array_compact(F.array(token_said, F.when(~public_url.startswith("https://"), "not https"), F.when(~audio, "no audio"), F.when((translation != "off") & ~configured, "translation unconfigured")))


def shared_jobs(asked: DataFrame) -> DataFrame:
    """asked (key, event_id, at_ms, fails) to (event_id, job_id): requests of one key share the first one's job until a request after which it has failed; the next one starts anew."""
    order = Window.partitionBy("key").orderBy("at_ms", "event_id")
    run = F.coalesce(F.sum(F.col("fails").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("event_id").over(Window.partitionBy("key", "run").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return asked.withColumn("run", run).select("event_id", first.alias("job_id"))


def standing(events: DataFrame, counted: Column) -> DataFrame:
    """events (item, at_ms, event_id) with n: how many counted events of the item there are up to each one's time, equal times included."""
    upto = Window.partitionBy("item").orderBy("at_ms").rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n", F.count(F.when(counted, 1)).over(upto))


def retained_jobs(asked: DataFrame, retention_ms: int = 6 * 3_600_000) -> DataFrame:
    """asked (key, event_id, at_ms, done_ms, fails) to (event_id, job_id): requests of a key share the job that the first one started, until one comes when it has failed, or when it is finished and older than the retention; that one starts the next. done_ms, fails: how the job ends that a request would start. Keys' requests stream past in order."""

    def run(batches):
        key, job = None, None
        for rows in batches:
            out = []
            for k, event, at, done, fails in rows.itertuples(index=False):
                if k != key or (job[2] <= at and (job[3] or at - job[1] > retention_ms)):
                    key, job = k, (event, at, done, fails)
                out.append(job[0])
            yield pd.DataFrame({"event_id": rows["event_id"], "job_id": out})

    kind = asked.schema["event_id"].dataType.simpleString()
    ordered = asked.select("key", "event_id", "at_ms", "done_ms", "fails").repartition("key").sortWithinPartitions("key", "at_ms", "event_id")
    return ordered.mapInPandas(run, f"event_id {kind}, job_id {kind}")
