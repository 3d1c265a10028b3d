"""Batches of cues for translation, and putting answers back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import nfkc

# How far back a batch looks for a pause to end at, and how long that is, in ms.
LOOK_BACK, PAUSE_MS = 12, 2500
# How many cues make a comparison, and the share of them that may stay unchanged.
COMPARABLE, UNCHANGED = 10, 0.25
NEWEST = "array<struct<size:int,pause:boolean>>"
ROWS = "array<struct<id:bigint,text:string>>"


def split_at(state: Column, cue: Column, most_cues: int, most_chars: int) -> Column:
    """The state of batching after one more cue: starts of batches so far, place, cues and characters of the open batch, and the size of its newest LOOK_BACK cues, each with whether a long pause comes before it."""
    n, newest = state["n"], state["newest"]
    m = F.size(newest)
    full = (n >= most_cues) | ((n > 0) & (state["chars"] + cue["size"] > most_chars))
    # A batch's own first cue is no place to end it.
    places = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    pause = F.array_max(F.filter(places, lambda p: F.element_at(newest, p)["pause"] & ((p > 1) | (m < n))))
    tail = F.when(pause.isNull(), F.array().cast(NEWEST)).otherwise(F.slice(newest, F.coalesce(pause, F.lit(1)), m))
    kept = F.when(full, tail).otherwise(newest)
    longer = F.array_append(kept, F.struct(cue["size"].alias("size"), cue["pause"].alias("pause")))
    return F.struct(
        F.when(full, F.array_append(state["starts"], state["at"] - F.size(tail))).otherwise(state["starts"]).alias("starts"),
        (state["at"] + 1).alias("at"),
        (F.when(full, F.size(tail)).otherwise(n) + 1).alias("n"),
        (F.when(full, F.aggregate(tail, F.lit(0), lambda x, c: x + c["size"])).otherwise(state["chars"]) + cue["size"]).alias("chars"),
        F.slice(longer, F.greatest(F.lit(1), F.size(longer) - LOOK_BACK + 1), LOOK_BACK).alias("newest"),
    )


def batch_cues(cues: DataFrame, most_cues: int, most_chars: int) -> DataFrame:
    """Adds batch (from 0) to a track's cues: full batches end at the last long pause among their newest cues, whose rest starts the next. A track's cues are one array, folded in the JVM; a track is one title, so its size is bounded."""
    before = F.lag("end_ms").over(Window.partitionBy("track_id").orderBy("id"))
    told = cues.withColumn("pause", F.coalesce(F.col("start_ms") - before >= PAUSE_MS, F.lit(False))).withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    rest = [c for c in cues.columns if c not in ("track_id", "id")]
    listed = told.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("id", *rest, "size", "pause"))).alias("listed"))
    start = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast(NEWEST).alias("newest"))
    folded = listed.select("track_id", "listed", F.aggregate("listed", start, lambda state, cue: split_at(state, cue, most_cues, most_chars))["starts"].alias("starts"))
    each = folded.select("track_id", "listed", "starts", F.posexplode("starts").alias("batch", "first"))
    end = F.coalesce(F.get("starts", F.col("batch") + 1), F.size("listed"))
    parts = each.select("track_id", "batch", F.explode(F.slice("listed", F.col("first") + 1, end - F.col("first"))).alias("c"))
    return parts.select(*[F.col("track_id") if c == "track_id" else F.col(f"c.{c}") for c in cues.columns], "batch")


def answer_rows(answers: DataFrame) -> DataFrame:
    """answers (track_id, batch, body) to (track_id, batch, pos, id, text): code fences and prose around the JSON are ignored; a bare list, or one under cues or translations."""
    body = F.regexp_replace("body", r"```(?:json)?", "")
    inner = F.coalesce(F.from_json(body, f"struct<cues:{ROWS},translations:{ROWS}>")["cues"], F.from_json(body, f"struct<cues:{ROWS},translations:{ROWS}>")["translations"], F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), ROWS))
    return answers.select("track_id", "batch", F.posexplode(inner).alias("pos", "r")).select("track_id", "batch", "pos", "r.id", "r.text")


def translated(cues: DataFrame, rows: DataFrame) -> DataFrame:
    """Cues with the first non-blank answer for their id as text, or their own."""
    good = rows.where("id is not null and trim(text) <> ''").groupBy("track_id", "id").agg(F.min_by("text", F.struct("batch", "pos")).alias("new"))
    return cues.join(good, ["track_id", "id"], "left").withColumn("text", F.coalesce("new", "text")).drop("new")


def plain_text(text: Column) -> Column:
    """Compatibility forms, without tags, punctuation and case, for a comparison."""
    bare = F.regexp_replace(F.regexp_replace(nfkc(text), "<[^>]+>", ""), r"[\p{P}\p{S}]+", " ")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), "^ | $", ""))


def unchanged(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """cues, answers (track_id, id, text) to (track_id, n, same, refused): how many cues with a run of four letters a translation left as they were; refused if over a quarter of COMPARABLE or more."""
    asked = cues.where(F.col("text").rlike(r"\p{L}{4}")).select("track_id", "id", plain_text(F.col("text")).alias("own"))
    both = asked.join(answers.select("track_id", "id", plain_text(F.col("text")).alias("new")), ["track_id", "id"], "left")
    out = both.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("own") == F.col("new"), F.lit(False))).alias("same"))
    return out.withColumn("refused", (F.col("n") >= COMPARABLE) & (F.col("same") > UNCHANGED * F.col("n")))
