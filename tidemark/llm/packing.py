"""Best-fit packing with certified bounds.

Documents become token sequences (an end token after each) that are cut only where longer than a sequence. Pieces are
dealt over groups of bounded size; each group packs its pieces by best-fit decreasing, and a lower bound from dual feasible
functions certifies it where its bin count equals the bound. Certified groups are done. Groups with a gap give back the
pieces of their bins that aren't full; these are dealt anew over fewer groups and packed again, until a round needs as many
bins as the one before or one group holds them all. At the end the same bound over all pieces (they have few lengths) tells
whether the whole has a gap; only if so, bins of certified groups that have room, which only other groups can use, are
exchanged as well, until the bound is met or a round gains nothing.

Contract: a null text is an empty one and still has its end token; repeated rows and repeated or null ids are packed each on
its own (rows are carried through, never joined back, and dealt by row, so equal ones spread); an empty table packs to an
empty table; other columns stay unread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, saved, text_array
from .tokens import BATCH_BYTES, DEFAULT, LIMIT, encoder

GROUP_PIECES = 8192
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, part long, bin int, offset long, fill long, certified boolean"


def cut_pieces(docs: DataFrame, tokenizer: str = DEFAULT, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """A row per piece; a piece's ids are in its checksum only."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", BATCH_BYTES):
                ids, offsets = enc.encoded(text_array(part.column("text")))
                totals = np.diff(offsets) + 1
                pieces = -(-totals // limit)
                row = np.repeat(np.arange(len(totals)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * limit
                length = np.minimum(limit, totals[row] - start)
                last = start + length == totals[row]
                view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                tail = int(end_id).to_bytes(4, "little")
                crc = []
                for a, n, ends in zip((offsets[row] + start).tolist(), length.tolist(), last.tolist()):
                    value = zlib.crc32(view[4 * a : 4 * (a + n - ends)])
                    crc.append(zlib.crc32(tail, value) if ends else value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, limit: int, counts: np.ndarray | None = None) -> int:
    """counts: how often each length is there, once where none are given. The best of two families of dual feasible functions: no packing of these lengths uses fewer bins.

    For a threshold k: lengths above limit - k count as a whole bin, those below k as nothing, the rest as they are. For a
    divisor p: a length counts floor((p + 1) * length / limit) / p, or length / limit where that product is whole.
    """
    if not len(lengths):
        return 0
    sizes, n = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    best = -(-int((sizes * n).sum()) // limit)
    for k in np.unique(np.minimum(sizes, limit - sizes)):
        if 0 < k <= limit // 2:
            value = np.where(sizes > limit - k, limit, np.where(sizes < k, 0, sizes))
            best = max(best, -(-int((value * n).sum()) // limit))
    for p in range(1, 21):
        product = (p + 1) * sizes
        value = np.where(product % limit == 0, sizes * p, product // limit * limit)
        best = max(best, -(-int((value * n).sum()) // (limit * p)))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of each bin). Open bins stand in stacks by free room; a bit set finds the tightest one that fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, fill = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = limit, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.array(fill, dtype=np.int64)


def whole_bound(pieces: DataFrame, limit: int) -> int:
    """The lower bound for all pieces; a row for each length, of which there are `limit` at most, comes to the driver."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    return lower_bound(counts["length"].to_numpy(np.int64), limit, counts["n"].to_numpy(np.int64))


def pack(pieces: DataFrame, limit: int = LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (a saved table). Also `certified`: its group's bin count met the bound."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, limit)
        rows["bin"], rows["offset"], rows["fill"] = bins, offsets, fill[bins]
        rows["certified"] = len(fill) == lower_bound(lengths, limit)
        return rows

    def packed(rest: DataFrame, number: int, groups: int) -> DataFrame:
        """Row numbers of a saved table take part in the dealing, so equal rows spread."""
        dealt = rest.select(*names).withColumn("part", F.pmod(F.xxhash64(F.lit(number), F.monotonically_increasing_id()), F.lit(groups)))
        return saved(dealt.groupBy("part").applyInPandas(run, PLACED), "packed")

    def kept(placed: DataFrame, number: int) -> DataFrame:
        return placed.select(*names, "part", "bin", "offset", "certified", F.lit(number).alias("round"), F.lit(0).cast("long").alias("own"))

    alone = pieces.where(F.col("length") >= limit)
    done = [alone.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"), F.lit(0).alias("round"), F.monotonically_increasing_id().alias("own"))]
    rest, closed, k, before = pieces.where(F.col("length") < limit), [], 0, None
    bins = lambda placed: placed.where("offset = 0").count()
    while n := rest.count():
        k += 1
        groups = max(1, -(-n // group_pieces))
        placed = packed(rest, k, groups)
        gap = ~F.col("certified") & (F.col("fill") < limit)
        if groups == 1 or (before is not None and bins(placed) >= before):
            closed.append((placed, k))
            break
        closed.append((placed.where(~gap), k))
        rest = saved(placed.where(gap).select(*names), "open-pieces")
        before = bins(placed.where(gap))
    bound = whole_bound(pieces, limit) - alone.count()
    total = sum(bins(placed) for placed, _ in closed)
    while total > bound:
        k += 1
        open_ = [placed.where(F.col("fill") < limit).select(*names) for placed, _ in closed]
        for more in open_[1:]:
            open_[0] = open_[0].union(more)
        rest = saved(open_[0], "open-pieces")
        groups = max(1, -(-rest.count() // group_pieces))
        tried = [*((placed.where(F.col("fill") == limit), n) for placed, n in closed), (packed(rest, k, groups), k)]
        now = sum(bins(placed) for placed, _ in tried)
        if now >= total:
            break
        closed, total = tried, now
        if groups == 1:
            break
    done += [kept(placed, k) for placed, k in closed]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # Unique by construction: full pieces take their row number (below 2^62), packed ones 2^62 plus round, group and bin.
    number = F.when(F.col("round") == 0, F.col("own")).otherwise(F.lit(1 << 62) + F.col("round") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 20) + F.col("bin"))
    return out.select(*names, number.cast("long").alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, tokenizer: str = DEFAULT, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """All documents in as few sequences as the exchange finds: a row per piece with its sequence and its place there."""
    return pack(saved(cut_pieces(docs, tokenizer, limit, end_id), "pieces"), limit)
