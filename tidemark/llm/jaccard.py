"""Groups of texts that share most of their four-word shingles: an exact Jaccard join by signature trees.

Two sets link when the shingles they share are `percent` of their union or more. Nothing is estimated:

1. Candidates. All shingles are put in one order, those that many texts hold last. Two linked sets share one of the first
   n - ceil(percent * n / 100) + 1 of their n shingles in any such order, so each text is in the groups of these only, and
   groups of the same members are one.
2. Trees. The sets of a group become the leaves of a signature tree: each leaf has a bitmap of hashed shingles and a size,
   each node above it the OR of its children's bitmaps, their range of sizes, and how many shingles at most one of its sets
   has beyond its bits. Two trees (or one with itself) are walked down together; a pair of nodes is dropped once the greatest
   overlap that any two of their sets can have is too small for their sizes. A group is first walked by bitmaps alone, which
   are small, and keeps the members that have a partner left; only their sets travel, and pairs of leaves that are left then
   are compared exactly.
3. Who meets. Every text is compared with the center of its groups, the member of most and largest groups; texts linked with
   one center are a cluster, and where a group holds texts of two clusters the smaller one's visit the larger one, chunk by
   chunk. Texts of no cluster meet in their groups; of a group beyond a chunk's size the members are told apart by a second
   shared shingle, and again by a third, before its chunks meet each other. So copies cost their number, not its square.

Edges go to the connected components of the fingerprint join.

Contract: a null text is an empty one; texts without words have no shingles, link with nothing and are their own component;
fewer than four words are one shingle; equal sets are one node; rows with a null doc_id take part and get their component but
never name one; ties in size or place don't matter, for all pairs that can link are met; an empty table gives an empty
table; other columns stay unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, mix, numbered, saved, shuffle_partitions, spans_of, text_array
from .simhash import components
from .similar import centers, dealt, shared, shingles_of, upto

SHINGLE = 4
PERCENT = 85
#: Shingles that come last in the order: those that SEEN texts of a slice of SLICE bytes hold, the most frequent FREQUENT of them.
FREQUENT, SEEN, SLICE = 500_000, 3, 4 << 20
#: Members and bytes of shingles that meet in one step.
CHUNK, CHUNK_BYTES = 2048, 16 << 20
TASK_BYTES = 64 << 20
#: Children of a tree's node, and pairs of nodes looked at in one step.
FAN, STEP = 8, 1 << 14
#: How often a large group is told apart by one more shingle.
DEEPER = 2


def frequent(rows: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """The hashes that come last in the order, most frequent last. Counts are of all rows; only the order depends on them, never a result."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                hashes, _ = shingles_of(text_array(part.column("text")), width)
                values, counts = np.unique(hashes, return_counts=True)
                many = counts >= SEEN
                yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["token", "n"])

    found = rows.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return np.asarray(most.column("token").combine_chunks() if len(most) else [], dtype=np.int64).view(np.uint64)[::-1]


class Order:
    """The order of shingles: by hash, but for the frequent ones, which come last by how frequent they are."""

    def __init__(self, last: np.ndarray):
        by = np.argsort(last)
        self.values, self.rank = last[by], by

    def prefixes(self, hashes: np.ndarray, offsets: np.ndarray, percent: int, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of the first n - ceil(percent * n / 100) + 1 + more of each set's n hashes."""
        size = np.diff(offsets)
        want = np.where(size > 0, np.minimum(size, size + (-percent * size) // 100 + 1 + more), 0)
        at = np.minimum(np.searchsorted(self.values, hashes), max(0, len(self.values) - 1))
        late = self.values[at] == hashes if len(self.values) else np.zeros(len(hashes), dtype=bool)
        row = np.repeat(np.arange(len(size)), size)
        early = np.concatenate([[0], np.cumsum(~late)])
        place = early[:-1] - np.repeat(early[offsets[:-1]], size)
        take = ~late & (place < np.repeat(want, size))
        lacking = np.flatnonzero(early[offsets[1:]] - early[offsets[:-1]] < want)
        for k in lacking.tolist():  # frequent ones fill up
            here = np.flatnonzero(late[offsets[k] : offsets[k + 1]]) + offsets[k]
            short = want[k] - (size[k] - len(here))
            take[here[np.argsort(self.rank[at[here]])[:short]]] = True
        return hashes[take], np.concatenate([[0], np.cumsum(np.bincount(row[take], minlength=len(size)))]).astype(np.int64)


def described(rows: DataFrame, order, percent: int, width: int) -> DataFrame:
    """rows (row, text) to (row, k1, k2, size, tokens, marks): sums that tell equal sets, the number of shingles, the first ones in the order, and the bitmap of a leaf."""

    def run(batches):
        ordered = Order(order.value)
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                hashes, offsets = shingles_of(text_array(part.column("text")), width)
                size = np.diff(offsets)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                tokens, ends = ordered.prefixes(hashes, offsets, percent)
                marks = [marked(hashes[a:b], bits_for(b - a)).tobytes() if b > a else b"" for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, sums), pa.array(size), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64))), pa.array(marks, pa.binary())], names=["row", "k1", "k2", "size", "tokens", "marks"])

    return rows.mapInArrow(run, "row long, k1 long, k2 long, size long, tokens array<long>, marks binary")


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows (node, text) to (node, set): the hashes of its shingles, in order."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                hashes, offsets = shingles_of(text_array(part.column("text")), width)
                data = memoryview(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([data[8 * a : 8 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def bits_for(size: int) -> int:
    """The base-2 logarithm of a bitmap's bits: two to four for each shingle."""
    return max(6, int(2 * size - 1).bit_length())


def marked(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of some hashes, by their first bits."""
    marks = np.zeros(1 << bits, dtype=bool)
    marks[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(marks)


def folded(marks: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of 2 ** bits bits, or of more, as rows of that many: neighbouring bits become one."""
    out = np.zeros((len(marks), 1 << bits >> 3), dtype=np.uint8)
    for k, raw in enumerate(marks):
        own = np.frombuffer(raw, dtype=np.uint8)
        out[k] = own if len(own) == out.shape[1] else np.packbits(np.unpackbits(own).reshape(1 << bits, -1).any(axis=1))
    return out.view(np.uint64)


class Tree:
    """The signature tree of some sets, by their bitmaps and sizes. Level 0 has a leaf for each set, in the order `leaf`; FAN nodes have one above them."""

    def __init__(self, marks: np.ndarray, sizes: np.ndarray):
        self.leaf = np.lexsort((*marks[:, :4].T[::-1], np.log(sizes) // 0.1))
        marks, sizes = marks[self.leaf], sizes[self.leaf]
        self.levels = [(marks, sizes, sizes, sizes - np.bitwise_count(marks).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            marks, least, most, beyond = self.levels[-1]
            edges = np.arange(0, len(marks), FAN)
            self.levels.append((np.bitwise_or.reduceat(marks, edges, axis=0), np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges), np.maximum.reduceat(beyond, edges)))

    @staticmethod
    def of(sets: list[np.ndarray], bits: int) -> Tree:
        return Tree(np.stack([marked(s, bits) for s in sets]).view(np.uint64), np.array([len(s) for s in sets], dtype=np.int64))

    def at(self, level: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(level, len(self.levels) - 1)]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, how many) of the children of nodes of a level; a root above its own level has itself."""
        if level >= len(self.levels):
            return nodes, np.ones(len(nodes), dtype=np.int64)
        return FAN * nodes, np.minimum(FAN, len(self.levels[level - 1][0]) - FAN * nodes)


def may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some set under node i of a and some set under node j of b can link: by their sizes and by the greatest overlap that bits leave."""
    (marks, least, most, beyond), (marks2, least2, most2, beyond2) = a, b
    fit = (100 * most[i] >= percent * least2[j]) & (100 * most2[j] >= percent * least[i])
    some = np.flatnonzero(fit)
    i, j = i[some], j[some]
    both = np.bitwise_count(marks[i] & marks2[j]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(np.minimum(most[i], most2[j]), both + np.minimum(beyond[i], beyond2[j]))
    fit[some] = (100 + percent) * overlap >= percent * (least[i] + least2[j])
    return fit


def pairs(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (numbers of a's, numbers of b's) that may link, a step's at a time; of one tree with itself each pair once."""
    top = max(len(a.levels), len(b.levels)) - 1
    stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, i, j = stack.pop()
        fit = may_link(a.at(level), b.at(level), i, j, percent)
        i, j = i[fit], j[fit]
        if not level:
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a.leaf[i], b.leaf[j]
            continue
        for k in range(0, len(i), STEP // FAN**2):
            some, other = i[k : k + STEP // FAN**2], j[k : k + STEP // FAN**2]
            (x, nx), (y, ny) = a.children(level, some), b.children(level, other)
            each = nx * ny
            turn, width = spans_of(each), np.repeat(ny, each)
            left, right = np.repeat(x, each) + turn // width, np.repeat(y, each) + turn % width
            if a is b:
                left, right = left[left <= right], right[left <= right]
            stack.append((level - 1, left, right))


def linked(sets: list[np.ndarray], others: list[np.ndarray], one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs (one, other) those whose sets link, exactly. There may be no pair left."""
    if not len(one):
        return np.zeros(0, dtype=bool)
    if len(np.unique(one)) > len(np.unique(other)):
        return linked(others, sets, other, one, percent)
    out = np.zeros(len(one), dtype=bool)
    by = np.argsort(one, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], one[by][1:] != one[by][:-1]]))
    for some in np.split(by, edges[1:]):
        mine, theirs = sets[one[some[0]]], [others[k] for k in other[some].tolist()]
        sizes = np.array([len(s) for s in theirs])
        both = shared(mine, np.concatenate(theirs), np.cumsum(sizes) - sizes)
        out[some] = (100 + percent) * both >= percent * (len(mine) + sizes)
    return out


def middling(sets: list[np.ndarray]) -> int:
    """Bits for bitmaps of sets of several sizes."""
    return min(14, bits_for(int(np.median([len(s) for s in sets]))))


def by_first(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(i, kind="stable")
    return i[by], j[by]


def turns(i: np.ndarray) -> np.ndarray:
    """0, 1, ... for the pairs of each i, which is in order."""
    return spans_of(np.unique(i, return_counts=True)[1])


def connected(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one that it is connected with by links."""
    label = np.arange(len(sets))
    tree = Tree.of(sets, middling(sets))
    for i, j in pairs(tree, tree, percent):
        i, j = by_first(i, j)
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            now = turns(i) < FAN
            near = linked(sets, sets, i[now], j[now], percent)
            for x, y in zip(i[now][near].tolist(), j[now][near].tolist()):
                if label[x] != label[y]:
                    low, high = sorted((label[x], label[y]))
                    label[label == high] = low
            i, j = i[~now], j[~now]
    return label


def hosts_of(members: list[np.ndarray], visitors: list[np.ndarray], percent: int) -> np.ndarray:
    """For each visitor one member that it links with, or -1."""
    host = np.full(len(visitors), -1)
    bits = middling(members)
    for i, j in pairs(Tree.of(visitors, bits), Tree.of(members, bits), percent):
        i, j = by_first(i, j)
        while len(i):
            free = host[i] < 0
            i, j = i[free], j[free]
            now = turns(i) < FAN
            near = linked(visitors, members, i[now], j[now], percent)
            host[i[now][near]] = j[now][near]
            i, j = i[~now], j[~now]
    return host


def with_partner(marks: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have another one that their bitmaps and sizes allow them to link with. Linked sets' bitmaps are alike in size, or one is twice the other."""
    found = np.zeros(len(marks), dtype=bool)
    bits = np.array([8 * len(m) for m in marks])
    for size in np.unique(bits).tolist():
        some = np.flatnonzero((bits == size) | (bits == 2 * size))
        if len(some) > 1:
            tree = Tree(folded([marks[k] for k in some], size.bit_length() - 1), sizes[some])
            for i, j in pairs(tree, tree, percent):
                found[some[i]] = found[some[j]] = True
    return found


def plausible(met: DataFrame, marks: DataFrame, percent: int, tasks: int) -> DataFrame:
    """met (g, node, size): those that have a partner in their group, as far as bitmaps and sizes tell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g", kind="stable")
        keep = [with_partner(some["marks"].tolist(), some["size"].to_numpy(), percent) for _, some in rows.groupby("g", sort=False)]
        return rows[np.concatenate(keep)][["g", "node", "size"]]

    dealt_out = met.select("g", "node", "size").join(marks, "node").withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks)))
    return dealt_out.groupBy("task").applyInPandas(run, "g long, node long, size long")


def unpacked(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in rows["set"]]


def in_tasks(met: DataFrame, sets: DataFrame, run, tasks: int) -> DataFrame:
    """Edges (a, b) of what `run` makes of each group's rows; a task has whole groups."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), dtype=np.int64)]
        rows = rows.sort_values(["g", "node"]).drop_duplicates(["g", "node"])
        for _, some in rows.groupby("g", sort=False):
            if len(some) > 1:
                out.append(run(some))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"]).drop_duplicates()

    return met.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks))).groupBy("task").applyInPandas(each, "a long, b long")


def within(met: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """met (g, node): a spanning forest of the links inside each group."""

    def run(rows: pd.DataFrame) -> np.ndarray:
        node, label = rows["node"].to_numpy(), connected(unpacked(rows), percent)
        other = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([node[other], node[label[other]]], axis=1)

    return in_tasks(met, sets, run, tasks)


def visited(met: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """met (g, node, member): for each node of a group that is no member of it one member that it links with, if there is one."""

    def run(rows: pd.DataFrame) -> np.ndarray:
        inside, node, values = rows["member"].to_numpy(bool), rows["node"].to_numpy(), unpacked(rows)
        members, visitors = np.flatnonzero(inside), np.flatnonzero(~inside)
        if not len(members) or not len(visitors):
            return np.zeros((0, 2), dtype=np.int64)
        host = hosts_of([values[k] for k in members], [values[k] for k in visitors], percent)
        return np.stack([node[visitors[host >= 0]], node[members[host[host >= 0]]]], axis=1)

    return in_tasks(met, sets, run, tasks)


def groups(rows: DataFrame) -> DataFrame:
    """rows (g, node, size) of groups with two nodes or more, with their number n and bytes; of groups with the same members one."""
    met = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")).where("n > 1")
    one = met.groupBy("n", "x", "y").agg(F.min("g").alias("g"), F.first("bytes").alias("bytes")).select("g", "n", (8 * F.col("bytes")).alias("bytes"))
    return rows.join(one, "g").select(*rows.columns, "n", "bytes")


def of_like_size(met: DataFrame, percent: int) -> DataFrame:
    """met (g, node, size): those that have a member of near enough a size in their group, the next smaller or the next larger one."""
    order = Window.partitionBy("g").orderBy("size", "node")
    near = lambda a, b: F.coalesce(100 * a >= percent * b, F.lit(False))
    told = met.withColumns({"less": F.lag("size").over(order), "more": F.lead("size").over(order)})
    return told.where(near(F.col("less"), F.col("size")) | near(F.col("size"), F.col("more"))).select("g", "node", "size")


def parts(n: Column, size: Column, chunk: int) -> Column:
    return F.ceil(F.greatest(n / chunk, size / CHUNK_BYTES)).cast("long")


def told_apart(large: DataFrame, sets: DataFrame, order, percent: int, depth: int) -> DataFrame:
    """large (g, node, size, used): the same of the groups that one more shared shingle makes. Linked members of a group share the shingles used, `depth` of them, and so one more of the first n - ceil(percent * n / 100) + 1 + depth."""

    def run(batches):
        ordered = Order(order.value)
        for batch in batches:
            for part in by_bytes(batch, "set", 1 << 22):
                values = [np.frombuffer(x, dtype=np.uint64) for x in part.column("set").cast(pa.large_binary()).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
                tokens, ends = ordered.prefixes(np.concatenate(values), offsets, percent, depth)
                row = np.repeat(np.arange(len(values)), np.diff(ends))
                used = np.array(part.column("used").to_pylist(), dtype=np.int64).reshape(len(values), depth).view(np.uint64)[row]
                new = (used != tokens[:, None]).all(axis=1)
                row, used = row[new], np.sort(np.column_stack([used[new], tokens[new]]), axis=1)
                g = mix(used).sum(axis=1, dtype=np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * (depth + 1), pa.int32()), pa.array(used.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(g), part.column("node").take(pa.array(row)), part.column("size").take(pa.array(row)), lists], names=["g", "node", "size", "used"])

    told = large.join(sets, "node").select("g", "node", "size", "used", "set").mapInArrow(run, "g long, node long, size long, used array<long>")
    return told.dropDuplicates(["g", "node"])


def tasks_for(spark, size: int | None) -> int:
    return max(shuffle_partitions(spark), -(-8 * (size or 0) // TASK_BYTES))


def jaccard_links(rows: DataFrame, percent: int = PERCENT, width: int = SHINGLE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """rows (row, text; saved). Returns (row, k1, k2, size), equal keys for rows of equal sets, and (a, b), edges whose components are those of all links; of rows of equal sets only the least is in an edge."""
    spark = rows.sparkSession
    order = spark.sparkContext.broadcast(frequent(rows, width))
    own = saved(described(rows, order, percent, width), "jaccard-rows")
    nodes = own.where("size > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.min_by("tokens", "row").alias("tokens"), F.min_by("marks", "row").alias("marks"))
    nodes = saved(nodes, "jaccard-nodes")
    # Most shingles are one text's alone: their counts go ahead of the rows.
    each = nodes.select(F.explode("tokens").alias("g"), "node", "size")
    common = saved(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "jaccard-common")
    met = saved(groups(saved(each.join(common, "g", "left_semi"), "jaccard-members")).withColumn("parts", parts(F.col("n"), F.col("bytes"), chunk)), "jaccard-groups")
    # Most groups are of texts that share a passage and no more; their bitmaps tell so before any set travels.
    whole = saved(of_like_size(met.where("parts = 1").select("g", "node", "size"), percent), "jaccard-sized")
    left = plausible(whole, nodes.select("node", "marks"), percent, tasks_for(spark, (whole.agg(F.sum("size")).first()[0] or 0) // 16))
    left = saved(left.union(met.where("parts > 1").select("g", "node", "size")), "jaccard-plausible")
    met = saved(groups(left), "jaccard-candidates")
    wanted = saved(met.groupBy("node").agg(F.first("size").alias("size")), "jaccard-wanted")
    sets = saved(shingle_sets(rows.join(wanted.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "text"), width), "jaccard-sets")
    sized = lambda df: tasks_for(spark, df.agg(F.sum("size")).first()[0])
    group = lambda key, part: F.xxhash64(key, part).alias("g")

    # Stars: each text with the center of its groups; a center's texts in chunks.
    chosen = saved(centers(met).join(wanted, "node"), "jaccard-centers")
    many = chosen.groupBy("center").agg(parts(F.count("*"), 8 * F.sum("size"), chunk).alias("parts"))
    star = chosen.join(many, "center").select(group("center", dealt("node", F.col("parts"))), "node", F.lit(False).alias("member"))
    heads = many.select("center", upto(F.col("parts")).alias("part")).select(group("center", "part"), F.col("center").alias("node"), F.lit(True).alias("member"))
    stars = saved(visited(star.union(heads), sets, percent, sized(chosen)), "jaccard-stars")
    one = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    two = one.join(one.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = two.union(two.select("label", "label").distinct().join(two.select(F.col("node").alias("known")), F.col("label") == F.col("known"), "left_anti"))
    labels = saved(labels.join(wanted, "node"), "jaccard-labels")
    named = saved(met.select("g", "node", "size").join(labels.select("node", "label"), "node", "left"), "jaccard-named")

    # Visits: texts that share a group with another cluster; of two clusters the smaller one's visit.
    count = labels.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("n"), (8 * F.sum("size")).alias("bytes"))
    there = named.where("label is not null").select("g", F.col("label").alias("cluster")).distinct().join(count, "cluster").select("g", "cluster", "n")
    guests = named.join(count.select(F.col("cluster").alias("label"), F.col("n").alias("own_n")), "label", "left").join(there, "g")
    guests = guests.where("label is null or (cluster <> label and struct(n, cluster) > struct(own_n, label))")
    guests = saved(guests.select("node", "cluster", "size").distinct(), "jaccard-visits")
    hosts = count.join(guests.select("cluster").distinct(), "cluster", "left_semi").select("cluster", parts(F.col("n"), F.col("bytes"), chunk).alias("parts"))
    # Very many visitors of one cluster are dealt, too: each of their chunks meets each of its.
    guest_parts = guests.groupBy("cluster").agg(parts(F.count("*"), 8 * F.sum("size"), chunk).alias("turns"))
    outside = guests.join(hosts, "cluster").join(guest_parts, "cluster").select("node", "cluster", "size", dealt("node", F.col("turns")).alias("turn"), upto(F.col("parts")).alias("part"))
    outside = outside.select(F.xxhash64("cluster", "part", "turn").alias("g"), "node", F.lit(False).alias("member"), "size")
    inside = labels.withColumnRenamed("label", "cluster").join(hosts, "cluster").join(guest_parts, "cluster")
    inside = inside.select("node", "cluster", "size", dealt("node", F.col("parts")).alias("part"), upto(F.col("turns")).alias("turn")).select(F.xxhash64("cluster", "part", "turn").alias("g"), "node", F.lit(True).alias("member"), "size")
    meetings = saved(inside.union(outside), "jaccard-meetings")
    visits = visited(meetings.drop("size"), sets, percent, sized(meetings))

    # The rest among themselves.
    lone = saved(groups(named.where("label is null").select("g", "node", "size", F.array("g").alias("used"))).withColumn("parts", parts(F.col("n"), F.col("bytes"), chunk)), "jaccard-lone")
    small = lone.where("parts = 1").select("g", "node", "size")
    depth = 0
    # Two different sets that link share percent / (100 - percent) shingles or more.
    while depth < min(DEEPER, -(-percent // max(1, 100 - percent)) - 1) and not lone.where("parts > 1").isEmpty():
        depth += 1
        finer = groups(told_apart(lone.where("parts > 1").select("g", "node", "size", "used"), sets, order, percent, depth))
        lone = saved(finer.withColumn("parts", parts(F.col("n"), F.col("bytes"), chunk)), "jaccard-lone")
        small = small.union(lone.where("parts = 1").select("g", "node", "size"))
    large = lone.where("parts > 1").select("g", "node", "size", dealt("node", F.col("parts")).alias("i"), upto(F.col("parts")).alias("j"))
    large = large.select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node", "size")
    rest = saved(small.union(large), "jaccard-rest")
    found = stars.union(visits).union(within(rest.select("g", "node"), sets, percent, sized(rest)))
    return own.select("row", "k1", "k2", "size"), saved(found.distinct(), "jaccard-edges")


def alike_groups(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    rows = numbered(docs, ["doc_id", "text"]).withColumnRenamed("__row", "row")
    own, edges = jaccard_links(rows.select("row", "text"), percent, width, chunk)
    tied = components(edges)
    ids = saved(own.join(rows.select("row", "doc_id"), "row"), "jaccard-ids")
    nodes = ids.where("size > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    rooted = saved(nodes.join(tied, "node", "left").select("k1", "k2", "least", F.coalesce("root", "node").alias("root")), "jaccard-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("k1", "k2", "component_id")
    full = ids.where("size > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return full.union(ids.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
