"""Groups of texts whose five-word shingles are alike, for near-dedup in the pipeline: candidates by SimHash and MinHash, each link verified.

Similarity is the cosine of the two sets of five-word shingles, shared / sqrt(size * size), which is what SimHash estimates;
a link needs 0.8. Sixty-four bits of SimHash put such texts some ten bits apart, beyond what masks of a trie join can carry,
so besides the groups of the trie join every text has bands of four MinHash values (at a cosine of 0.8 two texts share one
of the 32 bands with a probability of 0.997 or more). All pairs that share a group are candidates, and each is settled by
its exact similarity or by both being connected already:

1. Every text is compared with the most typical one of its groups (the member of most and largest groups), its center.
   Those linked with one center are a cluster; one set of shingles travels for each text.
2. Texts that share a group with a cluster but aren't in it visit it: the cluster's members are dealt over chunks, visitors
   go to all of them, and each visitor is compared with the members until it is linked. Of two clusters the smaller visits.
3. Texts without a cluster that share a group meet in a task, or chunk by chunk where they are many.

So copies of one text cost their number; only texts that share groups and yet aren't alike cost more.

Contract: a null text is an empty one, and all texts without words are one group; fewer than five words are one shingle;
equal sets of shingles are one node; a null doc_id takes part like any other; an empty table has no groups; other columns
stay unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, by_bytes, hashes_of, mix, numbered, saved, scope, shuffle_partitions, spans_of, text_array, words_of
from .simhash import components, near_groups

SHINGLE = 5
VALUES = 128
BAND = 4
SIMILAR = 0.8
#: Most members of a group that are compared in one step.
CHUNK = 4096
TASK_BYTES = 64 << 20
SEED = 42


def shingles_of(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of text i are hashes[offsets[i]:offsets[i + 1]], in order."""
    codes, vocabulary, offsets = words_of(texts)
    n = np.diff(offsets)
    shingles = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    words = hashes_of(vocabulary, SEED)[codes]
    at, end = np.repeat(offsets[:-1], shingles) + spans_of(shingles), np.repeat(offsets[1:], shingles)
    hashes = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        here = np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) if len(at) else hashes
        hashes = mix(hashes ^ here)
    row = np.repeat(np.arange(len(n)), shingles)
    by = np.lexsort((hashes, row))
    hashes, row = hashes[by], row[by]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[first], np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int64)


def bands_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key for each band of each text that has shingles."""
    full = np.diff(offsets) > 0
    edges = offsets[:-1][full]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    draw = np.random.default_rng(SEED)
    factors, terms = draw.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, VALUES, dtype=np.uint32)
    keys = np.zeros((len(edges), VALUES // BAND), dtype=np.uint64)
    keys[:] = np.arange(VALUES // BAND, dtype=np.uint64)
    moved = np.empty_like(short)
    if len(edges):
        for k in range(VALUES):
            np.multiply(short, factors[k], out=moved)
            np.add(moved, terms[k], out=moved)
            keys[:, k // BAND] = mix(keys[:, k // BAND] ^ np.minimum.reduceat(moved, edges).astype(np.uint64))
    return keys.view(np.int64)


def described(rows: DataFrame) -> DataFrame:
    """rows (row, text) to (row, k1, k2, size, bands): the sums that tell equal sets of shingles, how many there are, and the bands."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                hashes, offsets = shingles_of(text_array(part.column("text")))
                size = np.diff(offsets)
                keys, full = bands_of(hashes, offsets), size > 0
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(size), dtype=np.uint64)
                    if full.any():
                        total[full] = np.add.reduceat(mix(hashes + np.uint64(salt)), offsets[:-1][full])
                    sums.append(total.view(np.int64))
                ends = np.concatenate([[0], np.cumsum(full)]) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, sums), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))], names=["row", "k1", "k2", "size", "bands"])

    return rows.mapInArrow(run, "row long, k1 long, k2 long, size long, bands array<long>")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rows (node, text) to (node, set): the first 32 bits of the shingles' hashes, in order, as often as they are there; another text's shingle is taken for one of them with a probability of one in 2 ** 32 for each."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                hashes, offsets = shingles_of(text_array(part.column("text")))
                data = memoryview((hashes >> np.uint64(32)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([data[4 * a : 4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def shared(mine: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of each other set's hashes are among mine (sorted)."""
    at = np.searchsorted(mine, others)
    at[at == len(mine)] = 0
    return np.add.reduceat((mine[at] == others).astype(np.int64), starts)


def alike(both: np.ndarray, n: np.ndarray, m: np.ndarray | int, similar: float) -> np.ndarray:
    """Whether shared / sqrt(n * m) reaches the similarity; a hair's breadth for rounding."""
    return both >= similar * np.sqrt(n * m) - 1e-9


def connected(sets: list[np.ndarray], label: np.ndarray, similar: float) -> np.ndarray:
    """For each set the first one that it is connected with by links. label: what is known already to be connected."""
    sizes = np.array([len(s) for s in sets])
    label = label.copy()
    for u in range(len(sets)):
        others = np.flatnonzero(label != label[u])
        if not len(others):
            break
        others = others[(others > u) & (np.minimum(sizes[others], sizes[u]) >= similar**2 * np.maximum(sizes[others], sizes[u]) - 1e-9) & (sizes[others] > 0)]
        if not len(others):
            continue
        both = shared(sets[u], np.concatenate([sets[k] for k in others]), np.cumsum(sizes[others]) - sizes[others])
        near = others[alike(both, sizes[others], sizes[u], similar)]
        if len(near):
            joined = np.unique(np.append(label[near], label[u]))
            label[np.isin(label, joined)] = joined[0]
    return label


def within(met: DataFrame, sets: DataFrame, similar: float, tasks: int) -> DataFrame:
    """met (g, node): edges (a, b) of a spanning forest of the exact links inside each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["g", "node"]).drop_duplicates(["g", "node"])
        group, node = rows["g"].to_numpy(), rows["node"].to_numpy()
        values = [np.frombuffer(x, dtype=np.uint32) for x in rows["set"]]
        edges = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                label = connected(values[lo:hi], np.arange(hi - lo), similar)
                other = np.flatnonzero(label != np.arange(hi - lo))
                a.append(node[lo:hi][other])
                b.append(node[lo:hi][label[other]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    dealt = met.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def visited(met: DataFrame, sets: DataFrame, similar: float, tasks: int) -> DataFrame:
    """met (g, node, member): edges (a, b) from each node of a group that is no member of it to one member that it is linked with, if there is one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, some in rows.sort_values(["g", "node"]).groupby("g", sort=False):
            inside = some["member"].to_numpy(bool)
            node = some["node"].to_numpy()
            values = [np.frombuffer(x, dtype=np.uint32) for x in some["set"]]
            members = np.flatnonzero(inside)
            if not len(members):
                continue
            flat, sizes = np.concatenate([values[k] for k in members]), np.array([len(values[k]) for k in members])
            starts = np.cumsum(sizes) - sizes
            for u in np.flatnonzero(~inside).tolist():
                if len(values[u]):
                    near = np.flatnonzero(alike(shared(values[u], flat, starts), sizes, len(values[u]), similar))
                    if len(near):
                        out.append((node[u], node[members[near[0]]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    dealt = met.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(run, "a long, b long")


def candidates(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, node, n): members of every group of two nodes or more; of groups with the same members one. nodes: (node, size, bands); groups: (node, g). Nodes without shingles have no links."""
    rows = nodes.select("node", F.explode("bands").alias("g")).union(groups.join(nodes.where("size > 0").select("node"), "node", "left_semi").select("node", "g"))
    # Most bands are one text's alone: their counts go ahead of the rows.
    common = saved(rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "common-groups")
    return candidates_again(rows.join(common, "g", "left_semi"))


def centers(met: DataFrame) -> DataFrame:
    """(node, center): of the most typical members of a node's groups the most typical one; the node itself is left out."""
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    rank = F.struct("weight", (-F.col("node")).alias("m"))
    best = met.join(weight, "node").groupBy("g").agg(F.max(rank).alias("best"))
    chosen = met.select("g", "node").join(best, "g").groupBy("node").agg(F.max("best").alias("best"))
    return chosen.select("node", (-F.col("best.m")).alias("center")).where("node <> center")


def parts_of(count: str, most: int) -> Column:
    return F.ceil(F.col(count) / most).cast("long")


def upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def dealt(node: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts)


def similar_links(rows: DataFrame, groups: DataFrame | None = None, similar: float = SIMILAR, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (row, text; saved), groups (row, g) that may hold links too. Returns (row, k1, k2), equal for rows of equal shingles, and (a, b), edges whose components are those of all links; of rows of equal shingles only the least is in an edge."""
    spark, chunk = rows.sparkSession, chunk or CHUNK
    own = saved(described(rows), "shingles")
    nodes = saved(own.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.min_by("bands", "row").alias("bands")), "shingle-nodes")
    more = groups.select(F.col("row").alias("node"), "g") if groups is not None else nodes.select("node", F.lit(0).cast("long").alias("g")).where("false")
    met = saved(candidates(nodes, more), "candidates")
    wanted = met.select(F.col("node").alias("row")).distinct()
    sets = saved(shingle_sets(among(rows, wanted, "row").select(F.col("row").alias("node"), "text")), "shingle-sets")
    load = nodes.join(wanted.withColumnRenamed("row", "node"), "node", "left_semi").agg(F.sum("size")).first()[0] or 0
    tasks = max(shuffle_partitions(spark), -(-4 * load // TASK_BYTES))
    # 1. Stars: chunks of each center's nodes, with the center.
    chosen = saved(centers(met), "centers")
    size = chosen.groupBy("center").agg(F.count("*").alias("n")).select("center", parts_of("n", chunk).alias("parts"))
    own_key = lambda key, part: F.xxhash64(key, part).alias("g")
    sides = chosen.join(size, "center")
    star = sides.select(own_key("center", dealt("node", F.col("parts"))), "node", F.lit(False).alias("member"))
    heads = size.select("center", upto(F.col("parts")).alias("part")).select(own_key("center", "part"), F.col("center").alias("node"), F.lit(True).alias("member"))
    stars = saved(visited(star.union(heads), sets, similar, tasks), "star-links")
    # Of each linked node the label is its center, or that center's.
    one = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    two = one.join(one.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = saved(two.union(two.select("label", "label").distinct().join(two.select(F.col("node").alias("known")), F.col("label") == F.col("known"), "left_anti")), "cluster-labels")
    named = met.select("g", "node").join(labels, "node", "left")
    named = saved(named.select("g", "node", "label"), "labelled")
    # 2. Visits: nodes that share a group with another cluster; of two clusters the smaller visits.
    count = labels.groupBy("label").agg(F.count("*").alias("n"))
    there = named.where("label is not null").select("g", F.col("label").alias("cluster")).distinct().join(count.withColumnRenamed("label", "cluster"), "cluster").select("g", "cluster", "n")
    guests = named.join(count.withColumnRenamed("n", "own_n"), "label", "left").join(there, "g").where("label is null or (cluster <> label and struct(n, cluster) > struct(own_n, label))")
    guests = saved(guests.select("node", "cluster").distinct(), "visits")
    hosts = guests.select("cluster").distinct().join(count.withColumnRenamed("label", "cluster"), "cluster").select("cluster", parts_of("n", chunk).alias("parts"))
    inside = labels.join(hosts.withColumnRenamed("cluster", "label"), "label").select(own_key("label", dealt("node", F.col("parts"))), "node", F.lit(True).alias("member"))
    outside = guests.join(hosts, "cluster").select("node", "cluster", upto(F.col("parts")).alias("part")).select(own_key("cluster", "part"), "node", F.lit(False).alias("member"))
    visits = visited(inside.union(outside), sets, similar, tasks)
    # 3. The rest among themselves.
    lone = saved(candidates_again(named.where("label is null").select("g", "node")).withColumn("parts", parts_of("n", chunk)), "lone")
    small = lone.where("parts = 1").select("g", "node")
    large = lone.where("parts > 1").select("g", "node", "parts", dealt("node", F.col("parts")).alias("i")).select("g", "node", "i", upto(F.col("parts")).alias("j"))
    large = large.select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node")
    links = saved(stars.union(visits).union(within(small.union(large), sets, similar, tasks)).distinct(), "near-edges")
    return own.select("row", "k1", "k2"), links


def candidates_again(rows: DataFrame) -> DataFrame:
    """(g, node, n) of groups with two nodes or more left, of groups with the same members one."""
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    met = rows.groupBy("g").agg(F.count("*").cast("int").alias("n"), members).where("n > 1")
    one = met.groupBy("n", "members").agg(F.min("g").alias("g")).select("g", "n")
    return rows.join(one, "g").select("g", "node", "n")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (of these the first; rows without a doc_id come last); all columns stay. Every row that goes is tied to the one that stays by a chain of verified links."""
    whole = numbered(docs)
    with scope() as keep:
        rows = whole.select(F.col("__row").alias("row"), "text")
        prints = near_groups(rows.withColumnRenamed("row", "doc_id"))
        groups = prints.select(F.col("doc_id").alias("row"), F.xxhash64(F.lit("simhash"), "component_id").alias("g"))
        of, edges = similar_links(rows, groups)
        tied = components(edges)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("row").alias("kept"))).alias("first")
        ids = whole.select(F.col("__row").alias("row"), "doc_id")
        # Rows of equal shingles are summed up before they meet, so very many of them are no task's burden.
        nodes = of.join(ids, "row").groupBy("k1", "k2").agg(F.min("row").alias("node"), first)
        roots = nodes.join(tied, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        kept = saved(roots.select(F.col("first.kept").alias("__row")), "kept-rows")
        keep(kept)
    return among(whole, kept, "__row").select(*[F.col(f"`{c}`") for c in docs.columns])
