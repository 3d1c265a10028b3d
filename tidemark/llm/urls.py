"""URL filters by Bloom filter cascades.

A cascade holds a list of keys exactly, for one complete universe of keys: level 1 is a Bloom filter of the listed keys,
level 2 one of those other keys of the universe that pass level 1, level 3 one of the listed keys that pass level 2, and so
on until none is left. A key of the universe is listed if the first level that it fails is an even one (or if it fails none
of an odd number of levels). The universe here is every key that some rule could match in the corpus: the suffixes of each
host joined with the beginnings of its path. Level 1 lets through about 0.7 as many other keys as are listed, all others
half of what they are asked for, so the size follows the list, and only its logarithm the universe.

Keys are dealt over shards by hash; each shard's two cascades (keys that allow, keys that block) are built in one task from
the shard's part of the universe, SHARD_KEYS keys at most on average. Where all cascades together have at most
BROADCAST_BYTES, which are summed up first, they are broadcast; else keys go to the cascades: each url's keys to their
shards, of which hot ones are copied, and the answers back by row. Either way membership comes from cascades alone.

Of all keys that are listed the longest decides; a key listed both to allow and to block blocks. A url that no rule fits is
not listed, so the method allows it.

Contract: a null url, or one without "://", has an empty host and path and fits no rule; repeated rows are judged each on its
own; repeated rules count once; an empty table gives an empty table; an empty list fits nothing; other columns stay unread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, numbered, saved, shuffle_partitions

#: False positives of each level of a cascade but the first, for each key that it is asked for.
RATE = 0.5
SHARD_KEYS = 4_000_000
BROADCAST_BYTES = 64 << 20
#: Keys asked of one copy of a shard's cascades, where these aren't broadcast.
ASKED_KEYS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


class Level:
    """A Bloom filter over pairs of 64-bit hashes."""

    def __init__(self, number: int, keys: int, rate: float = RATE):
        self.number = number
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.size = 64 * max(1, math.ceil(keys * math.log2(1 / rate) / math.log(2) / 64))
        self.words = np.zeros(self.size // 64, dtype=np.uint64)

    def places(self, a: np.ndarray, b: np.ndarray):
        with np.errstate(over="ignore"):
            a = mix(a.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(self.number + 1))
            b = mix(b.view(np.uint64) ^ a) | np.uint64(1)
            for k in range(self.hashes):
                yield (a + np.uint64(k) * b) % np.uint64(self.size)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for p in self.places(a, b):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def put(self, a: np.ndarray, b: np.ndarray) -> Level:
        for p in self.places(a, b):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        return self


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def built(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> Cascade:
        """Of distinct keys, some of which are listed."""
        levels: list[Level] = []
        now, other = (a[listed], b[listed]), (a[~listed], b[~listed])
        while len(now[0]):
            first = min(RATE, max(1e-9, len(now[0]) / (math.sqrt(2) * max(1, len(other[0])))))
            levels.append(Level(len(levels), len(now[0]), RATE if levels else first).put(*now))
            passed = levels[-1].has(*other)
            now, other = (other[0][passed], other[1][passed]), now
        return Cascade(levels)

    def to_bytes(self) -> bytes:
        shape = np.array([[level.size, level.hashes] for level in self.levels], dtype=np.int64).reshape(-1, 2)
        return b"".join([np.int64(len(shape)).tobytes(), shape.tobytes(), *(level.words.tobytes() for level in self.levels)])

    @staticmethod
    def of_bytes(data: bytes) -> Cascade:
        n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
        levels, at = [], 8 + 16 * n
        for k, (size, hashes) in enumerate(np.frombuffer(data, dtype=np.int64, count=2 * n, offset=8).reshape(n, 2).tolist()):
            level = Level(k, 0)
            level.size, level.hashes, level.words = size, hashes, np.frombuffer(data, dtype=np.uint64, count=size // 64, offset=at)
            levels.append(level)
            at += size // 8
        return Cascade(levels)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), len(self.levels) % 2 == 1)
        open_ = np.ones(len(a), dtype=bool)
        for k, level in enumerate(self.levels):
            hit = level.has(a, b)
            out[open_ & ~hit] = k % 2 == 1
            open_ &= hit
        return out


def hashes(key: str | Column) -> list[Column]:
    """Two hashes of a key. Keys that agree in both count as one."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("tidemark"), key).alias("b")]


def build_cascades(keys: DataFrame, shards: int) -> DataFrame:
    """keys (a, b, allow, block), distinct, to (shard, allow, block): the cascades of each shard's keys."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)
        made = [Cascade.built(a, b, rows[v].to_numpy(bool)).to_bytes() for v in ("allow", "block")]
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "allow": made[:1], "block": made[1:]})

    return keys.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInPandas(run, "shard long, allow binary, block binary")


def verdicts(a: np.ndarray, b: np.ndarray, allow: Cascade, block: Cascade) -> np.ndarray:
    """0 for keys that aren't listed, 1 for those that allow, 2 for those that block."""
    return np.where(block.has(a, b), 2, np.where(allow.has(a, b), 1, 0)).astype(np.int8)


def split_url(url: str) -> tuple[Column, Column]:
    whole = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(whole, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(whole, "://[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, labels: int, sizes: list[int]) -> Column:
    """The keys that a rule could have: suffixes of up to so many labels, with the path's beginnings of these sizes; longest first."""
    parts = F.split(F.col(host), r"\.", -1)
    suffixes = F.transform(F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.concat(s, F.substring(F.col(path), F.lit(1), n)))))
    return F.array_sort(keys, lambda x, y: F.coalesce(F.nullif(F.length(y) - F.length(x), F.lit(0)), F.when(x < y, -1).when(x > y, 1).otherwise(0)))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def told_by_broadcast(asked: DataFrame, cascades: DataFrame, shards: int) -> DataFrame:
    """asked (row, a array, b array; longest key first) to (row, best, what): the place, from 1, of the first listed key, 0 for none, and its verdict. The cascades are small."""
    shared = asked.sparkSession.sparkContext.broadcast({r["shard"]: (bytes(r["allow"]), bytes(r["block"])) for r in cascades.collect()})

    def run(batches):
        made = {k: (Cascade.of_bytes(x), Cascade.of_bytes(y)) for k, (x, y) in shared.value.items()}
        for batch in batches:
            ends = np.asarray(batch.column("a").offsets, dtype=np.int64)
            a, b = (np.asarray(batch.column(c).values)[ends[0] : ends[-1]] for c in "ab")
            verdict, shard = np.zeros(len(a), dtype=np.int8), np.mod(a, shards)
            for k in np.unique(shard).tolist():
                if k in made:
                    here = shard == k
                    verdict[here] = verdicts(a[here], b[here], *made[k])
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            at = np.flatnonzero(verdict)[::-1]  # of a row's keys the first, which is the longest, is written last
            best, what = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int8)
            best[row[at]] = at - (ends[:-1] - ends[0])[row[at]] + 1
            what[row[at]] = verdict[at]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best), pa.array(what.astype(np.int32))], names=["row", "best", "what"])

    return asked.mapInArrow(run, "row long, best int, what int")


def told_by_shuffle(asked: DataFrame, cascades: DataFrame, shards: int) -> DataFrame:
    """As told_by_broadcast, for cascades of any size: keys go to their shards."""
    each = asked.select("row", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "k")).select("row", "pos", "k.a", "k.b", F.pmod("k.a", F.lit(shards)).alias("shard"))
    copies = saved(each.groupBy("shard").agg(F.ceil(F.count("*") / ASKED_KEYS).alias("copies")), "url-copies")
    keys = each.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")))
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
    parts = cascades.join(copies.toDF("part", "n"), F.col("shard") == F.col("part")).select("part", many, "allow", "block")

    def run(keys: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(parts):
            return pd.DataFrame({"row": [], "best": [], "what": []})
        made = [Cascade.of_bytes(parts[v].iloc[0]) for v in ("allow", "block")]
        what = verdicts(keys["a"].to_numpy(np.int64), keys["b"].to_numpy(np.int64), *made)
        hit = what > 0
        return pd.DataFrame({"row": keys["row"][hit], "best": keys["pos"][hit] + 1, "what": what[hit].astype(np.int32)})

    hits = keys.groupBy("shard", "copy").cogroup(parts.groupBy("part", "nth")).applyInPandas(run, "row long, best int, what int")
    first = hits.groupBy("row").agg(F.min(F.struct("best", "what")).alias("f")).select("row", "f.best", "f.what")
    return asked.select("row").join(first, "row", "left").fillna(0, ["best", "what"])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every row."""
    spark = pages.sparkSession
    host, path = split_url(url)
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict", F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars"))
    shape = listed.agg(F.max("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    keys = candidates("host", "path", shape["labels"] or 1, sorted(shape["chars"]) or [0])
    rows = numbered(pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")))
    tried = rows.select("host", "path").distinct().select(F.explode(keys).alias("key")).select(*hashes("key"), F.lit(0).alias("allow"), F.lit(0).alias("block"))
    given = listed.select(*hashes("key"), (F.col("verdict") == "allow").cast("int").alias("allow"), (F.col("verdict") == "block").cast("int").alias("block"))
    universe = saved(tried.union(given).groupBy("a", "b").agg(F.max("allow").alias("allow"), F.max("block").alias("block")), "url-keys")
    shards = max(shuffle_partitions(spark), -(-universe.count() // SHARD_KEYS))
    cascades = saved(build_cascades(universe, shards), "cascades")
    weight = cascades.agg(F.sum(F.length("allow") + F.length("block"))).first()[0] or 0
    asked = rows.select(F.col("__row").alias("row"), keys.alias("keys")).select("row", F.transform("keys", lambda k: hashes(k)[0]).alias("a"), F.transform("keys", lambda k: hashes(k)[1]).alias("b"))
    told = (told_by_broadcast if weight <= BROADCAST_BYTES else told_by_shuffle)(asked, cascades, shards)
    out = rows.join(told.withColumnRenamed("row", "__row"), "__row").withColumn("keys", keys)
    rule = F.when(F.col("best") > 0, F.get("keys", F.col("best") - 1))
    return out.select(F.col("page_id").alias(key), "host", "path", rule.alias("rule"), F.when(F.col("what") == 2, "block").otherwise("allow").alias("verdict"))


ORACLE = f"""
WITH r(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (n)
"""
