"""Periodic runs of words by harmonic grid probing.

A run of period p and at least three periods long holds two neighbouring points jp and (j+1)p of the grid of p, with the
words there equal to those a period later, and equal all the way between. So for every p the words at jp and (j+1)p are
compared, n/p comparisons of a whole array at once, n log n for all periods; what survives these and a few points between is
extended both ways by comparing arrays chunk by chunk. Periods are tried in ascending order and grid points inside a found
run are skipped. That loses nothing: a run that shared two of its periods with a run of a smaller period would have that
smaller period itself (Fine and Wilf), and would not be a run of its own.

Documents are independent: one pass over the table, without a shuffle. Memory goes with the longest text of a batch.

Contract: a null text has no words; a text below 24 words has no run; a null doc_id seeds as the word null; repeated rows are
rows of their own; equal exponents give the run with the smallest start, then the smallest period; an empty table gives an
empty table; other columns stay unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, spans_of, text_array, words_of

LEAST_WORDS, LEAST_PERIODS = 24, 3
BATCH_BYTES = 2 << 20
#: Words of a first comparison when a stretch is extended, and of the longest one.
CHUNK, MOST_CHUNK = 64, 1 << 16
#: Grid points looked at in one step; texts of at most WHOLE words take one.
STEP, WHOLE = 1 << 20, 4096


def grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, p), by p and then i: the points i = jp of the periods low to high that have two more points in n words."""
    periods = np.arange(low, high + 1)
    each = np.maximum(0, -(-(n - 2 * periods) // periods))
    p = np.repeat(periods, each)
    return spans_of(each) * p, p


@lru_cache(maxsize=64)
def small_grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    return grid(n, 1, n // LEAST_PERIODS)


def grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid points of n words in steps, of ascending periods."""
    if n <= WHOLE:
        size = 32
        while size < n:
            size += max(32, size >> 2)
        i, p = small_grid(size)
        inside = i + 2 * p < n
        yield i[inside], p[inside]
        return
    low = 1
    while low <= n // LEAST_PERIODS:  # a step never spans a period and its double, so what the smaller one finds is skipped
        high = min(2 * low - 1, n // LEAST_PERIODS, low + max(0, STEP * low // n))
        yield grid(n, low, high)
        low = high + 1


def upward(codes: np.ndarray, at: int, p: int) -> int:
    """The first place from `at` on whose word differs from that a period later, or has none there."""
    end, size = len(codes) - p, CHUNK
    while at < end:
        size = min(size, end - at)
        other = codes[at : at + size] != codes[at + p : at + p + size]
        if (first := int(other.argmax())) or other[0]:
            return at + first
        at, size = at + size, min(2 * size, MOST_CHUNK)
    return at


def downward(codes: np.ndarray, at: int, p: int) -> int:
    """The first place of the stretch that ends before `at`, all of whose words are equal to those a period later."""
    size = CHUNK
    while at > 0:
        size = min(size, at)
        other = (codes[at - size : at] != codes[at - size + p : at + p])[::-1]
        if (first := int(other.argmax())) or other[0]:
            return at - first
        at, size = at - size, min(2 * size, MOST_CHUNK)
    return at


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    found = []
    reach = np.zeros(n, dtype=np.int64)  # for each word where the found run ends that covers it and ends last
    for i, p in grids(n):
        same = codes[i] == codes[i + p]
        i, p = i[same], p[same]
        same = (codes[i + p] == codes[i + 2 * p]) & (reach[i] <= i + 2 * p)
        i, p = i[same], p[same]
        for part in (1, 2, 3):
            between = i + p * part // 4
            same = codes[between] == codes[between + p]
            i, p = i[same], p[same]
        k, places, periods = 0, i.tolist(), p.tolist()
        while k < len(places):
            at, q = places[k], periods[k]
            k += 1
            if reach[at] > at + 2 * q:
                continue
            upto = upward(codes, at, q)
            if upto > at + q:
                first = downward(codes, at, q)
                length = upto + q - first
                if length >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.append((first, length, q))
                    np.maximum(reach[first : upto + q], upto + q, out=reach[first : upto + q])
            if k < len(places) and periods[k] == q and places[k] < upto:  # the rest of this stretch
                k += int(np.searchsorted(i[k : np.searchsorted(p, q, side="right")], upto))
    return sorted(found, key=lambda run: (run[0], run[2]))


def planted(codes: np.ndarray, drawn: int) -> np.ndarray:
    """The words with the seeded repetition that every tenth document gets."""
    n, g = len(codes), drawn // 10
    if drawn % 10 or not n:
        return codes
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % p]])


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of every run only its first period does."""
    stay = np.ones(n, dtype=bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, outputs: bool = True) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed) for every row of docs. plant: every tenth document gets a seeded repetition first; runs and collapsed, the text without repeated periods, are left out on demand."""
    chosen = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * outputs
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]

    def run(batches):
        for batch in batches:
            for some in by_bytes(batch, "text", BATCH_BYTES):
                codes, vocabulary, offsets = words_of(text_array(some.column("text")), lower=False)
                spell = vocabulary.to_pylist()
                rows = []
                for k, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    own = codes[a:b]
                    if plant:
                        name = some.column("id")[k].as_py()
                        own = planted(own, zlib.crc32(b"null" if name is None else str(name).encode()))
                    runs = runs_of(own)
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                    left = " ".join([spell[w] for w in (own[kept(b - a, runs)] if runs else own).tolist()])
                    rows.append((len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha256(told.encode()).hexdigest(), sha256(left.encode()).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs] if outputs else None, left if outputs else None))
                arrays = [some.column("id"), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds[: 9 if outputs else 7])]]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    return chosen.mapInArrow(run, shape)
