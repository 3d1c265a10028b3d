"""Cleaning of timed cues. What a cue is merged with depends on cues kept before it, which later ones may widen: a fold, but only over stretches of a track that nothing reaches across, each an array that the JVM folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import nfkc

# Fixed values, in milliseconds.
VISIBLE, DROP, SAME_TEXT_GAP, SMALL_OVERLAP, CLEARANCE = 500, 160, 250, 180, 20
CONTROL, ZERO_WIDTH = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "[\u200b\u200c\u200d\u2060\ufeff]"


def text_key(text):
    """What two cues must share to be the same: compatibility forms, tags, invisible characters, case and spacing aside."""
    plain = F.regexp_replace(F.regexp_replace(nfkc(text), "<[^>]+>", ""), ZERO_WIDTH, "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), "^ +| +$", ""))


KEPT = "array<struct<start_ms:double,end_ms:double,text:string,key:string>>"


def merged(kept: Column, cue: Column) -> Column:
    """kept with the cue: in the last one of the same key since one that ended too early for it, or else in the last one if both begin together and one's key begins with the other's, or behind them all."""
    n = F.size(kept)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.element_at(kept, i)
    early = F.coalesce(F.array_max(F.filter(places, lambda i: at(i)["end_ms"] + SAME_TEXT_GAP < cue["start_ms"])), F.lit(0))
    twin = F.array_max(F.filter(places, lambda i: (i > early) & (at(i)["key"] == cue["key"])))
    last = F.try_element_at(kept, F.lit(-1))
    together = (F.abs(last["start_ms"] - cue["start_ms"]) <= SAME_TEXT_GAP) & (last["key"].startswith(cue["key"]) | cue["key"].startswith(last["key"]))
    target = F.coalesce(twin, F.when(together, n))
    longer = twin.isNull() & (F.length(cue["key"]) > F.length(last["key"]))
    own = F.struct(*[cue[c].alias(c) for c in ("start_ms", "end_ms", "text", "key")])

    def widened(x: Column, i: Column) -> Column:
        new = F.struct(F.least(x["start_ms"], cue["start_ms"]).alias("start_ms"), F.greatest(x["end_ms"], cue["end_ms"]).alias("end_ms"), *[F.when(longer, cue[c]).otherwise(x[c]).alias(c) for c in ("text", "key")])
        return F.when(i + 1 == target, new).otherwise(x)

    return F.when(target.isNull(), F.array_append(kept, own)).otherwise(F.transform(kept, widened))


def stabilise(cues: DataFrame) -> DataFrame:
    """cues (track_id, id, start_ms, end_ms, text) to cleaned ones, renumbered, with the track's counts of removed, merged and adjusted cues."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", CONTROL, ""), r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")
    keyed = cues.select("track_id", "id", F.col("start_ms").cast("double"), F.col("end_ms").cast("double"), F.regexp_replace(clean, r"^\s+|\s+$", "").alias("text"))
    keyed = keyed.withColumn("key", text_key(F.coalesce("text", F.lit(""))))
    track = Window.partitionBy("track_id")
    good = F.coalesce((F.col("key") != "") & (F.col("end_ms") > F.col("start_ms")), F.lit(False))
    told = keyed.withColumn("good", good).withColumn("bad", F.sum((~F.col("good")).cast("int")).over(track)).where("good")
    # A cue that begins later than any before it ends, and the gap, meets none of them, nor does any after it.
    order = track.orderBy("start_ms", "end_ms", "id")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("fresh", F.coalesce(before + SAME_TEXT_GAP < F.col("start_ms"), F.lit(True)).cast("int"))
    told = told.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = told.groupBy("track_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id", "text", "key"))).alias("listed"), F.first("bad").alias("bad"))
    folded = listed.select("track_id", "stretch", "bad", F.size("listed").alias("n"), F.aggregate("listed", F.array().cast(KEPT), merged).alias("kept"))
    each = folded.select("track_id", "stretch", "bad", F.posexplode("kept").alias("pos", "c"), F.when(F.col("pos") == 0, F.col("n") - F.size("kept")).otherwise(0).alias("merges"))
    each = each.select("track_id", "stretch", "pos", "bad", "merges", "c.start_ms", "c.end_ms", "c.text")
    # Too short ones go, short ones are held as long as the next one lets them, small overlaps are cut.
    order = track.orderBy("stretch", "pos")
    length = F.col("end_ms") - F.col("start_ms")
    wanted = F.least(F.col("start_ms") + VISIBLE, F.lead("start_ms").over(order) - CLEARANCE)  # without a next one the first counts
    each = each.withColumns({"drop": length < DROP, "wanted": wanted})
    each = each.withColumn("held", ~F.col("drop") & (length < VISIBLE) & (F.col("wanted") > F.col("end_ms")))
    each = each.withColumn("end_ms", F.when(F.col("held"), F.col("wanted")).otherwise(F.col("end_ms")))
    each = each.withColumns({"removed": (F.col("bad") + F.sum(F.col("drop").cast("int")).over(track)).cast("int"), "merged": F.sum("merges").over(track).cast("int")}).where("not drop")
    after = F.lead("start_ms").over(order)
    cut = F.coalesce((F.col("end_ms") > after) & (F.col("end_ms") - after <= SMALL_OVERLAP) & (after - F.col("start_ms") >= VISIBLE), F.lit(False))
    each = each.withColumns({"after": after, "cut": cut, "number": F.row_number().over(order)})
    adjusted = F.sum(F.col("held").cast("int") + F.col("cut").cast("int")).over(track).cast("int")
    end = F.when(F.col("cut"), F.col("after")).otherwise(F.col("end_ms"))
    return each.select("track_id", F.col("number").alias("id"), "start_ms", end.alias("end_ms"), "text", "removed", "merged", adjusted.alias("adjusted"))
