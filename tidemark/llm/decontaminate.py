"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A seed is the hash of the words that a fixed mask picks from a span of eight; the positions that it leaves out may differ.
Benchmark items give a seed at every word, documents at every second word, for each of three masks, so a seed can begin at
either parity; an item of just eight words begins at one place only, so where there is one, documents give seeds at every
word too. Items below eight words are their own only seed, without gaps: they must occur word by word. Equal seeds are
joined; each hit names a diagonal (document position less item position). Along it the words of document and item are
compared once, and a run that scores best (a match counts 1, a substitution -3) is an overlap if it has MIN_RUN words or
more (or the whole of a shorter item) and MIN_SAME of them agree.

Hits are (row, item, diagonal), by which texts are read again rather than shuffled. Seeds, items and hits are broadcast only
where their bytes, which are counted first, stay below BROADCAST_BYTES; beyond it they are joined by a shuffle, to which only
documents with a hit go.

Contract: null texts are empty; an item without words leaks nowhere; every row is compared by itself, whatever its doc_id,
and rows of one doc_id are reported once; null ids stay null and count as one doc_id in `leaks`; of equally good overlaps
the first in the document, then in the item, is told; repeated items are told each; empty tables give an empty result; other
columns stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, numbered, saved

MASKS = ((0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 2, 5, 7))
SPAN = 8
STRIDE = 2
MIN_RUN = 12
MIN_SAME = 0.8
SUBSTITUTION = -3
BROADCAST_BYTES = 64 << 20
#: Bytes of a seed (hash, item, place) and of a hit (row, item, diagonal) in a broadcast table, with what its index takes.
SEED_BYTES = HIT_BYTES = 64


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: str, stride: int) -> Column:
    """Every stride-th position's seeds: array of (seed, at)."""
    h = F.col(hashes)
    last = F.size(h) - SPAN
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))

    def under(number: int) -> Column:
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(number), *[F.get(h, i + o) for o in MASKS[number]]).alias("seed"), i.alias("at")))

    return F.concat(*[under(k) for k in range(len(MASKS))])


def best_run(doc: Column, item: Column, diagonal: Column) -> Column:
    """struct(first, last, same): the run of item positions that scores best on a diagonal, first and last inclusive."""
    first, last = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - 1
    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "begin", "same", "best", "first")], F.lit(-1).alias("last"), F.lit(0).alias("kept"))

    def step(a: Column, j: Column) -> Column:
        hit = F.get(doc, j + diagonal) == F.get(item, j)
        fresh = a["score"] <= 0
        score = F.when(fresh, 0).otherwise(a["score"]) + F.when(hit, 1).otherwise(SUBSTITUTION)
        begin = F.when(fresh, j).otherwise(a["begin"])
        same = F.when(fresh, 0).otherwise(a["same"]) + hit.cast("int")
        better = score > a["best"]
        return F.struct(score.alias("score"), begin.alias("begin"), same.alias("same"), F.when(better, score).otherwise(a["best"]).alias("best"), F.when(better, begin).otherwise(a["first"]).alias("first"), F.when(better, j).otherwise(a["last"]).alias("last"), F.when(better, same).otherwise(a["kept"]).alias("kept"))

    return F.when(last >= first, F.aggregate(F.sequence(first, last), zero, step))


def whole_seeds(hashes: str, sizes: list[int]) -> Column:
    """The seeds of all runs of so many words: array of (seed, at)."""
    h = F.col(hashes)

    def runs(n: int) -> Column:
        at = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(-n), *[F.get(h, i + k) for k in range(n)]).alias("seed"), i.alias("at")))

    return F.concat(*[runs(n) for n in sizes])


def overlaps(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rows (row, text; each row has its own number) to (row, item_id, doc_start, item_start, n_words, n_same), one for each overlap found."""
    items = benchmark.select("item_id", word_hashes("text").alias("item")).where(F.size("item") > 0)
    items = saved(items.select(F.monotonically_increasing_id().alias("no"), "item_id", "item"), "items")
    shape = items.agg(F.sum(F.size("item") * 8 + 64).alias("bytes"), F.collect_set(F.when(F.size("item") <= SPAN, F.size("item"))).alias("short")).first()
    sizes = sorted(n for n in shape["short"] if n < SPAN)
    each = F.when(F.size("item") < SPAN, F.array(F.struct(*[c.alias(n) for c, n in ((whole_item(SPAN), "seed"), (F.lit(0), "at"))]))).otherwise(seeds("item", 1))
    item_seeds = saved(items.select("no", F.explode(each).alias("s")).select("no", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")), "item-seeds")
    light = lambda df, most: F.broadcast(df) if most <= BROADCAST_BYTES else df
    words = rows.select("row", word_hashes("text").alias("doc"))
    own = seeds("doc", 1 if SPAN in shape["short"] else STRIDE)
    doc_seeds = words.select("row", F.explode(F.concat(own, whole_seeds("doc", sizes)) if sizes else own).alias("s")).select("row", F.col("s.seed").alias("seed"), F.col("s.at").alias("doc_at"))
    hits = doc_seeds.join(light(item_seeds, item_seeds.count() * SEED_BYTES), "seed")
    hits = saved(hits.select("row", "no", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct(), "leak-hits")
    most = hits.count() * HIT_BYTES
    if most > BROADCAST_BYTES:
        words = rows.join(hits.select("row").distinct(), "row", "left_semi").select("row", word_hashes("text").alias("doc"))
    near = words.join(light(hits, most), "row").join(light(items, shape["bytes"] or 0), "no")
    runs = near.select("row", "item_id", "diagonal", F.size("item").alias("size"), best_run(F.col("doc"), F.col("item"), F.col("diagonal")).alias("r"))
    n = F.col("r.last") - F.col("r.first") + 1
    found = runs.where((n >= F.least(F.lit(MIN_RUN), F.col("size"))) & (F.col("r.kept") >= MIN_SAME * n))
    return found.select("row", "item_id", (F.col("r.first") + F.col("diagonal")).alias("doc_start"), F.col("r.first").alias("item_start"), n.alias("n_words"), F.col("r.kept").alias("n_same"))


def whole_item(most: int) -> Column:
    """The seed of an item of fewer than `most` words, as whole_seeds() makes it for documents."""
    by_size = F.lit(None).cast("long")
    for n in range(1, most):
        by_size = F.when(F.size("item") == n, F.xxhash64(F.lit(-n), *[F.get("item", F.lit(k)) for k in range(n)])).otherwise(by_size)
    return by_size


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_same) for each document and item with an overlap: their best one. Positions count words."""
    rows = numbered(docs, ["doc_id", "text"])
    found = saved(overlaps(rows.select(F.col("__row").alias("row"), "text"), benchmark), "overlaps")
    ids = rows.select(F.col("__row").alias("row"), "doc_id")
    best = F.max(F.struct("n_same", (-F.col("n_words")).alias("n"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    told = found.join(ids, "row").groupBy("doc_id", "item_id").agg(best)
    return told.select("doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), (-F.col("b.n")).alias("n_words"), F.col("b.n_same").alias("n_same"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap a benchmark item, each row judged by its own text whatever its id; all columns stay."""
    rows = numbered(docs)
    bad = saved(overlaps(rows.select(F.col("__row").alias("row"), "text"), benchmark).select(F.col("row").alias("__row")).distinct(), "leaks")
    few = bad.count() * HIT_BYTES <= BROADCAST_BYTES
    return rows.join(F.broadcast(bad) if few else bad, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
