"""Release names: normal form, signature, similarity; and the score of a candidate for a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sources by the first pattern that matches, editions by the first that is contained, words that say nothing about a release.
SOURCES = {
    "bluray": r"\b(?:blu[ ._-]?ray|b[dr]rip|(?:bd|uhd[ ._-]?bd)?remux|remux)\b",
    "web": r"\b(?:web[ ._-]?(?:dl|rip)?|webrip)\b",
    "hdtv": r"\bhdtv\b",
    "dvd": r"\b(?:dvd(?:rip)?|dvdrip)\b",
}
EDITIONS = ["extended", "directors cut", "director cut", "theatrical", "uncut", "remastered", "imax"]
IGNORED = ["1080p", "2160p", "720p", "x264", "x265", "h264", "h265", "hevc", "hdr", "dv", "uhd", "aac", "dts"]
FPS = r"\b(23\.976|24(?:\.000)?|25(?:\.000)?|29\.97|30(?:\.000)?)\s*fps\b"
REMUX = r"\b(?:bdremux|remux)\b"
EXTENSION = r"\.[A-Za-z0-9]{2,4}$"


def normal_name(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, EXTENSION, ""), r"[._-]+", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[\[\](){}]", " "), r"\s+", " "), "^ +| +$", ""))


def signature(name: Column) -> Column:
    """struct(normalized, source, edition, group, fps, season, episode); missing parts are null. The normal form is bound once for all parts that read it."""
    group = F.lower(F.nullif(F.regexp_extract(F.regexp_replace(name, EXTENSION, ""), "-([A-Za-z0-9]{2,20})$", 1), F.lit("")))
    episode = r"\bs(\d{1,3})e(\d{1,3})\b"

    def parts(normal: Column) -> Column:
        part = lambda pattern, k: F.nullif(F.regexp_extract(normal, pattern, k), F.lit(""))
        source = F.coalesce(*[F.when(normal.rlike(p), F.lit(k)) for k, p in SOURCES.items()])
        edition = F.coalesce(*[F.when(normal.contains(e), F.lit(e)) for e in EDITIONS])
        return F.struct(normal.alias("normalized"), source.alias("source"), edition.alias("edition"), group.alias("group"), part(FPS, 1).cast("double").alias("fps"), part(episode, 1).cast("int").alias("season"), part(episode, 2).cast("int").alias("episode"))

    return F.get(F.transform(F.array(normal_name(name)), parts), F.lit(0))


def name_tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: (F.length(t) > 1) & ~t.isin(IGNORED)))


def name_similarity(left: Column, right: Column) -> Column:
    """Shared tokens over the larger set's size, of two token sets."""
    most = F.greatest(F.size(left), F.size(right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / most)


def rank_candidates(requests: DataFrame, candidates: DataFrame, keep: int | None = None) -> DataFrame:
    """candidates may have filename, fps and ai_translated too. Every candidate with its score from 0 to 100, its reasons and its position; equal scores keep the order of `ordinal`."""
    video = requests.select("request_id", F.col("season").alias("want_season"), F.col("episode").alias("want_episode"), F.col("filename").alias("video_name"), F.explode(F.array(signature(F.col("filename")))).alias("v"))
    video = video.withColumn("video_tokens", name_tokens(F.col("v.normalized")))
    own = lambda c: F.nullif(F.col(c), F.lit("")) if c in candidates.columns else F.lit(None).cast("string")
    named = candidates.withColumn("release", F.coalesce(own("release"), own("filename")))
    # One row for each name: its parts are long expressions, which Spark would else repeat for every place that reads them.
    found = named.withColumn("s", F.explode(F.array(signature(F.col("release"))))).withColumn("tokens", name_tokens(F.col("s.normalized")))
    both = found.join(video, "request_id").withColumn("similarity", F.when(F.col("video_name").isNotNull() & F.col("release").isNotNull(), name_similarity(F.col("video_tokens"), F.col("tokens"))))
    v, s = (lambda c: F.col(f"v.{c}")), (lambda c: F.col(f"s.{c}"))
    if_ = lambda test, yes, no=0: F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)
    remux = v("normalized").rlike(REMUX)
    gap = F.abs(v("fps") - F.col("fps")) if "fps" in candidates.columns else F.lit(None).cast("double")
    wrong = lambda want, got: (want != 0) & (got != 0) & (want != got)
    whole = lambda x: F.floor(x + 0.5).cast("int")
    points = [
        if_(F.col("hash_match"), 65),
        F.coalesce(whole(F.col("similarity") * 30), F.lit(0)),
        if_(v("source") == s("source"), 12) + if_(v("source") != s("source"), -18),
        if_(remux, if_(s("normalized").rlike(REMUX), 15, -12)),
        if_(v("group") == s("group"), 18),
        F.when(v("edition").isNotNull() & s("edition").isNotNull(), if_(v("edition") == s("edition"), 18, -35)).otherwise(if_(v("edition").isNotNull() | s("edition").isNotNull(), -15)),
        if_((v("fps") != 0) & (gap < 0.01), 8) + if_((v("fps") != 0) & (gap > 0.5), -12),
        if_(wrong(F.col("want_season"), s("season")), -100) + if_(wrong(F.col("want_episode"), s("episode")), -100),
        if_(F.col("machine_translated") | (F.coalesce("ai_translated", F.lit(False)) if "ai_translated" in candidates.columns else F.lit(False)), -8),
        F.when(F.col("rating").isNotNull(), F.least(F.lit(8), whole(F.col("rating")))).otherwise(0),
        F.when(F.col("downloads") > 0, F.least(F.lit(5), F.floor(F.log10(F.col("downloads") + 1)).cast("int"))).otherwise(0),
    ]
    score = F.greatest(F.lit(0), F.least(F.lit(100), sum(points, F.lit(10))))
    reasons = F.array_compact(F.array(
        F.when(F.col("hash_match"), "exact video hash"), F.when(F.col("similarity") >= 0.65, "strong release-name match"), F.when(v("source") == s("source"), F.concat(F.lit("same "), v("source"), F.lit(" source"))),
        F.when(remux & s("normalized").rlike(REMUX), "same remux cut family"), F.when(v("group") == s("group"), "same release group")))
    out = both.select("request_id", "ordinal", "provider", "provider_id", score.cast("int").alias("score"), F.array_join(reasons, "; ").alias("reasons"))
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "ordinal")))
    return out.where(F.col("position") <= keep) if keep else out


def unite(candidates: DataFrame) -> DataFrame:
    """One row per (request, provider, id): the place of the first, the values of the last."""
    rest = [c for c in candidates.columns if c not in ("request_id", "provider", "provider_id", "ordinal")]
    out = candidates.groupBy("request_id", "provider", "provider_id").agg(F.min("ordinal").alias("ordinal"), F.max_by(F.struct(*rest), "ordinal").alias("last"))
    return out.select("request_id", "provider", "provider_id", "ordinal", *[F.col("last")[c].alias(c) for c in rest])


def seats(providers: list[str], size: int) -> list[tuple[int, int]]:
    """(wave, seat) of each of a ranked list's candidates."""
    rest, wave, places = list(range(len(providers))), 0, [(0, 0)] * len(providers)
    while rest:
        taken, seen = [], set()
        for i in rest:
            if len(taken) < size and providers[i] not in seen:
                taken.append(i)
                seen.add(providers[i])
        taken += [i for i in rest if i not in taken][: size - len(taken)]
        for seat, i in enumerate(taken):
            places[i] = (wave, seat)
        rest, wave = [i for i in rest if i not in taken], wave + 1
    return places


def waves(ranked: DataFrame, size: int = 3) -> DataFrame:
    """Adds wave and seat (from 0). A wave takes the best candidate of each of up to `size` providers, then fills up by rank. One request's ranked list is small (a candidate limit bounds it), and is one row here."""

    def run(batches):
        for rows in batches:
            rows["places"] = [[{"wave": w, "seat": s} for w, s in seats(list(p), size)] for p in rows["providers"]]
            yield rows[["request_id", "all", "places"]]

    rest = [c for c in ranked.columns if c not in ("request_id", "position")]
    lists = ranked.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("all"))
    lists = lists.select("request_id", "all", F.col("all.provider").alias("providers"))
    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    placed = lists.mapInPandas(run, f"request_id {kinds['request_id']}, all {kinds['all']}, places array<struct<wave:int,seat:int>>")
    each = placed.select("request_id", F.explode(F.arrays_zip("all", "places")).alias("x"))
    return each.select(*[F.col("request_id") if c == "request_id" else F.col(f"x.all.{c}") for c in ranked.columns], "x.places.wave", "x.places.seat")


def winners(tried: DataFrame, bar: int = 58) -> DataFrame:
    """Of candidates with `confidence`, wave and seat: the accepted one that wins. After the first wave with an accepted one the search stops if its best is strong, else one wave later."""
    ok = F.col("confidence") >= bar
    first = tried.where(ok).groupBy("request_id").agg(F.min("wave").alias("w"))
    best = tried.join(first, "request_id").where(F.col("wave") == F.col("w")).groupBy("request_id", "w").agg(F.max("confidence").alias("best"))
    stop = best.select("request_id", F.when(F.col("best") >= min(90, bar + 15), F.col("w")).otherwise(F.col("w") + 1).alias("stop"))
    value = 0.82 * F.col("confidence") + 0.18 * F.col("score")
    seen = tried.join(stop, "request_id").where(ok & (F.col("wave") <= F.col("stop")))
    order = Window.partitionBy("request_id").orderBy(F.desc(value), "wave", "seat")
    return seen.withColumn("n", F.row_number().over(order)).where("n = 1").select("request_id", "provider", "provider_id", "score", "confidence", "wave", "seat")
