"""SimHash near-dedup by a binary trie self-join.

Fingerprints of four-word shingles (XXH64, majority of bits) are made in Arrow batches. Distinct fingerprints are then joined
with themselves: 64 bits are cut into m parts, and of two fingerprints that differ in at most k bits some m - k parts agree;
for each choice of m - k parts the fingerprints that agree there form a group (a subtree whose top has no error left to
spend). In each group pairs of trie nodes are walked down together, differing bits add up, and a pair of nodes is dropped
once its bits exceed the budget. A group only returns a spanning forest of its links, so no group's pairs are emitted.
Groups beyond a size are dealt over chunks, of which every two meet in one task. The forests are joined into components by
alternating star operations in Spark.

Contract: a null text is an empty one; a text without words has fingerprint zero, which links like any other; repeated rows
and equal texts share a fingerprint; rows with a null doc_id get their component but never name one; an empty table gives an
empty table; other columns stay unread.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, discard, saved, shuffle_partitions, text_array

SHINGLE = 4
SEED = 42
BUDGET = 4
CHUNK = 1024
#: Rows of one task of the join, and pairs of nodes or fingerprints looked at in one step of it.
TASK_ROWS = 40_000
STEP_PAIRS = 4_000_000
DIRECT = 128
#: Parts of a node's neighbours in a star step.
SALTS = 8


def shingle_spans(texts: pa.Array, width: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, shingles of each text): lower-cased words joined by single spaces, cut into shingles."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    joined = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    raw = np.frombuffer(view, dtype=np.uint8)
    spaces = np.flatnonzero(raw[offsets[0] : offsets[-1]] == 32) + offsets[0]
    full = np.diff(offsets) > 0
    starts = np.sort(np.concatenate([offsets[:-1][full], spaces + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], spaces]))
    n = np.zeros(len(offsets) - 1, dtype=np.int64)
    n[full] = 1
    n += np.searchsorted(spaces, offsets[1:]) - np.searchsorted(spaces, offsets[:-1])
    shingles = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    first = np.repeat(np.cumsum(n) - n, shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + width, np.repeat(np.cumsum(n), shingles)) - 1
    return view, starts[first], ends[last], shingles


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    view, starts, ends, shingles = shingle_spans(texts, SHINGLE)
    hashes = np.fromiter((xxh64_intdigest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    out = np.zeros(len(shingles), dtype=np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.cumsum(shingles[some]) - shingles[some]
        ones = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                values = fingerprints_of(text_array(part.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(values)], names=[key, "fp"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def masks(n: int, budget: int = BUDGET) -> list[int]:
    """For about n fingerprints: bit masks such that two of them within the budget agree on one mask at least.

    More parts make more masks with more bits each; the fewest parts are taken that leave random groups small.
    """
    for parts in range(budget + 1, budget + 5):
        edges = [64 * k // parts for k in range(parts + 1)]
        pieces = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        found = [sum(c) for c in combinations(pieces, parts - budget)]
        if n >> (64 * (parts - budget) // parts) <= 256:
            break
    return found


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pieces_of(bits: int, parts: int) -> list[int]:
    """The set bits of a mask, in so many masks."""
    places = [k for k in range(64) if bits >> k & 1]
    return [sum(1 << k for k in places[len(places) * i // parts : len(places) * (i + 1) // parts]) for i in range(parts)]


def trie_links(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the budget inside the ranges [lo, hi) of fps (unsigned, sorted in each range): walked down bit by bit from pairs of equal nodes."""
    left, right = [], []
    a, b, c, d = lo, hi, lo, hi
    errors, bit = np.zeros(len(lo), dtype=np.int64), 63
    while len(a):
        pairs = (b - a) * (d - c)
        now = (pairs <= DIRECT) | (bit < 0)
        if now.any():
            a1, c1, w, n = a[now], c[now], (d - c)[now], pairs[now]
            at = np.repeat(np.cumsum(n) - n, n)
            k = np.arange(len(at)) - at
            x, y = np.repeat(a1, n) + k // np.repeat(w, n), np.repeat(c1, n) + k % np.repeat(w, n)
            near = (x < y) & (np.bitwise_count(fps[x] ^ fps[y]) <= budget)
            left.append(x[near])
            right.append(y[near])
            a, b, c, d, errors = (v[~now] for v in (a, b, c, d, errors))
        if not len(a):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        m, o = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        cross = a != c
        nodes = [(a, m, c, o, errors, True), (m, b, o, d, errors, True), (a, m, o, d, errors + 1, True), (m, b, c, o, errors + 1, cross)]
        stack = [np.concatenate([np.broadcast_to(v[k], a.shape) for v in nodes]) for k in range(6)]
        keep = (stack[0] < stack[1]) & (stack[2] < stack[3]) & (stack[4] <= budget) & stack[5].astype(bool)
        a, b, c, d, errors = (v[keep] for v in stack[:5])
        bit -= 1
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 is connected with."""
    label = np.arange(n)
    while True:
        while not (label[label] == label).all():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return label
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))


def links(fps: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """(a, b): for distinct fingerprints (column fp), edges whose components are those of all links within the budget."""
    spark = fps.sparkSession
    count = fps.count()
    found = masks(count, budget)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for t, m in enumerate(found)]))
    rows = fps.select("fp", each.alias("g")).select("fp", "g.t", "g.part")
    sizes = lambda rows: rows.groupBy("t", "part").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("t", "part", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    hot = saved(sizes(rows), "simhash-hot")
    if not hot.isEmpty():
        # A large subtree is cut again: of two of its fingerprints within the budget some part of the bits left over agrees.
        finer = [(t, k, m | piece) for t, m in enumerate(found) for k, piece in enumerate(pieces_of(((1 << 64) - 1) & ~m, budget + 1))]
        again = F.array(*[F.struct(F.lit(t).alias("own"), F.lit(len(found) + t * (budget + 1) + k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for t, k, m in finer])
        large = rows.join(hot.select("t", "part"), ["t", "part"], "left_semi")
        large = large.select("fp", F.col("t").alias("whose"), F.explode(again).alias("g")).where("g.own = whose").select("fp", "g.t", "g.part")
        rows = saved(rows.join(hot.select("t", "part"), ["t", "part"], "left_anti").select("fp", "t", "part").union(large), "simhash-rows")
        hot = saved(sizes(rows), "simhash-hot")
    dealt = rows.join(hot, ["t", "part"], "left")
    own = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.select("fp", "t", "part", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("other"))
    group = F.xxhash64("t", "part", F.least("own", "other"), F.greatest("own", "other"))
    tasks = max(shuffle_partitions(spark), -(-count * len(found) // TASK_ROWS))
    dealt = dealt.select("fp", group.alias("g"), F.pmod(group, F.lit(tasks)).alias("task"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        values, group = rows["fp"].to_numpy(np.int64), rows["g"].to_numpy(np.int64)
        by = np.lexsort((values.view(np.uint64), group))
        values, group = values[by], group[by]
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(edges, len(group)))
        edges, sizes = edges[sizes > 1], sizes[sizes > 1]
        a, b = [], []
        load = np.cumsum(sizes * sizes)
        for k in np.unique(load // STEP_PAIRS):  # as many groups at a time as their pairs allow
            some = load // STEP_PAIRS == k
            first, last = edges[some][0], edges[some][-1] + sizes[some][-1]
            lo = edges[some] - first
            here = values[first:last]
            x, y = trie_links(here.view(np.uint64), lo, lo + sizes[some], budget)
            root = forest(len(here), x, y)
            other = root != np.arange(len(root))
            a.append(here[other])
            b.append(here[root[other]])
        empty = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])}).drop_duplicates()

    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that isn't its component's smallest: alternating large-star and small-star steps until nothing changes."""

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        """rows (a, b) with what `least` says of a, which is sent to each of SALTS parts of a's rows: a center with very many neighbours is no single task's work."""
        parts = least.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(parts, ["a", "salt"])

    def stars(df: DataFrame, large: bool) -> DataFrame:
        """df has a > b. Every neighbour (large: that is larger) of a node is tied to the least of the node and its neighbours."""
        if large:
            both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            out = met(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = df.groupBy("a").agg(F.min("b").alias("m"))
            out = met(df, least).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    seen = state(now)
    while seen[0]:
        before, now = now, saved(stars(stars(now, True), False), "stars")
        discard(before)
        if (then := state(now)) == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    own = saved(fingerprints(docs), "fingerprints")
    distinct = saved(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    tied = components(links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = saved(distinct.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
