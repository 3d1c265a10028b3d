"""Fill-in-middle, periodic runs and the Jaccard join against brute force, at their edges and with hot texts."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import jaccard, middle, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "id", "digest", "list", "copies", "parts", "part", "node", "g", "size", "set", "task", "member", "token", "root", "points", "runs", "__row")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("lmnrst") + r.choice(["", "ing", "ed", "er", "o"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with near and exact copies, repeated rows, nulls, empty, blank and long texts, marks, wide characters, and columns of clashing names."""
    texts = [prose(40 + 3 * k, k) for k in range(40)] + ["añ😀 " * 30, "é", "<P>x", "a <S> b", "<M>", None, "", " \t\n", "one", "One two", "one TWO", prose(20_000, 99), "\x1c a\x00b c d e"]
    texts += [prose(12, 300 + k % 3) * 6 for k in range(30)] + [texts[0]] * 700 + [texts[1] + " " + prose(3, k) for k in range(30)]
    rows = [(k, t, "en", None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0], None, None, None), (None, texts[2], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def digest(text):
    return sha256(text.encode()).hexdigest()


def cut(key, text):
    text = text or ""
    n, s = len(text), digest(f"1:{'null' if key is None else key}")
    h1, h2, h3, h4 = (int(s[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return key, n, form, a, b - a, digest(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), digest(text)


@pytest.mark.parametrize("hot", [(256, 20_000), (1, 50)])
def test_fill_in_middle_equals_slicing(docs, plain, hot):
    got = middle.fill_in_middle(docs, hot=hot).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(cut(*d) for d in plain)
    assert all(digest(r.output) == r.output_sha256 for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.where("false")).count() == 0


def test_fill_in_middle_equals_sql(spark):
    got = queries.op11_fill_in_middle(spark, SMALL)
    want = duckdb.connect().sql(f"WITH documents AS (SELECT * FROM '{SMALL}/documents.parquet') SELECT * FROM ({middle.ORACLE})")
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé€😀\n", max_size=3000))
def test_boundary_lists_select_every_place(text):
    raw = text.encode()
    entry = middle.boundary_list(np.frombuffer(raw, dtype=np.uint8))
    ends = np.cumsum([0] + [len(c.encode()) for c in text])
    assert entry[0] == len(text)
    for k in {0, len(text), len(text) // 2, max(0, len(text) - 1), len(text) // 3}:
        assert middle.select(k, len(raw), *entry) == ends[k]


def test_boundary_lists_of_long_texts():
    raw = ("a" * 9000 + "😀" * 9000 + "é" * 9000).encode()
    entry = middle.boundary_list(np.frombuffer(raw, dtype=np.uint8))
    for k in range(0, 27_001, 37):
        assert middle.select(k, len(raw), *entry) == min(k, 9000) + 4 * min(max(0, k - 9000), 9000) + 2 * max(0, k - 18_000)
    assert sum(map(len, entry[1:])) < 27_001 * 6 / 8  # at most six bits for a code point


def all_runs(words):
    """Runs by their definition: every maximal stretch of every period, with the smallest period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        k = 0
        while k < n - q:
            upto = k
            while upto < n - q and words[upto] == words[upto + q]:
                upto += 1
            length = upto + q - k
            if upto > k and length >= max(24, 3 * q):
                some = words[k : k + length]
                if not any(all(some[j] == some[j + d] for j in range(length - d)) for d in range(1, q)):
                    out.append((k, length, q))
            k = max(upto, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(key, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("null" if key is None else str(key)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return key, len(found), *best, found and 1000 * best[1] // best[2] or None, digest("".join("%d,%d,%d\n" % r for r in found)), digest(" ".join(w for i, w in enumerate(words) if i not in drop))


def test_periodic_runs_equal_definition(docs, plain):
    short = docs.where("coalesce(length(text), 0) < 20000")
    got = runs.periodic_runs(short, plant=True).collect()
    assert Counter(tuple(r)[:8] for r in got) == Counter(told(*d) for d in plain if len(d[1] or "") < 20_000)
    assert sum(r.n_runs > 0 for r in got) > 40
    assert all(digest(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs for r in got)
    assert runs.periodic_runs(docs.where("false")).count() == 0 and runs.periodic_runs(docs, plant=True).count() == len(plain)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=8), st.sampled_from([64, 4096]))
def test_runs_of_any_words(parts, whole):
    words = [w for some, times in parts for w in some * times]
    before, runs.WHOLE = runs.WHOLE, whole
    try:
        assert runs.runs_of(np.array(words, dtype=np.int64)) == all_runs(words)
    finally:
        runs.WHOLE = before


def test_runs_of_long_texts():
    r = np.random.default_rng(3)
    words = np.concatenate([r.integers(0, 2, 3000), np.tile(r.integers(0, 500, 700), 9)[:5000], np.zeros(4000, dtype=np.int64), np.tile([1, 2, 1], 900)])
    found = runs.runs_of(words)
    assert (3000, 5000, 700) in [(s, m, q) for s, m, q in found if q == 700] and any(m >= 4000 and q == 1 for s, m, q in found) and any(m >= 2700 and q == 3 for s, m, q in found)
    assert runs.runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def alike(rows, percent=85):
    """(id, size, component) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and a and sets[j] and (a == sets[j] or 100 * len(a & sets[j]) >= percent * len(a | sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (key, _) in zip(label, rows):
        least[x] = min([k for k in (least.get(x), key) if k is not None], default=None)
    return Counter((key, len(s), least[x] if s else key) for x, s, (key, _) in zip(label, sets, rows))


def got_groups(frame, **more):
    return Counter(map(tuple, jaccard.alike_groups(frame, **more).collect()))


def test_jaccard_equals_all_pairs(docs, plain):
    assert got_groups(docs) == alike(plain)
    assert jaccard.alike_groups(docs.where("false")).count() == 0


def near_texts(seed, n=220):
    """Texts about the threshold from each other, many of them with the same lines in other surroundings."""
    r = random.Random(seed)
    lines = [prose(30, 1000 + k) for k in range(5)]
    out = []
    for k in range(n):
        if out and r.random() < 0.6:
            words = r.choice(out).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = f"new{k}"
            out.append(" ".join(words[r.choice([0, 0, 2]) :]))
        else:
            out.append(" ".join([prose(r.choice([8, 30, 120]), 5000 + k), *r.sample(lines, r.randint(0, 5))]))
    return list(enumerate(out))


@pytest.mark.parametrize("chunk,seen", [(2048, 3), (3, 10**9)])
def test_jaccard_near_the_threshold(spark, monkeypatch, chunk, seen):
    """With small chunks groups are told apart by more shingles and visited chunk by chunk; nothing changes, with or without frequent shingles last."""
    monkeypatch.setattr(jaccard, "SEEN", seen)
    rows = near_texts(seen % 7)
    want = alike(rows)
    assert 20 < sum(k[0] != k[2] for k in want) < 200
    assert got_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), chunk=chunk) == want


def test_jaccard_of_exactly_the_threshold(spark):
    """Seventeen shared of twenty are 85 percent; seventeen of twenty-one aren't."""
    base = [f"w{k}" for k in range(23)]  # 20 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:20])), (3, " ".join(["a", "b", "c"])), (4, "A  b\tc"), (5, " ".join(base[:20] + ["x"]))]
    assert got_groups(spark.createDataFrame(rows, "doc_id long, text string")) == alike(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=40), min_size=2, max_size=60), st.integers(0, 2**32))
def test_trees_lose_no_pair(sets, salt):
    sets = [np.sort(jaccard.mix(np.array(sorted(s), dtype=np.uint64) + np.uint64(salt))) for s in sets] * 2
    sets = [s if k % 3 else np.sort(np.append(s, jaccard.mix(np.array([k], dtype=np.uint64) + np.uint64(10**12)))) for k, s in enumerate(sets)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    tree = jaccard.Tree.of(sets, 8)
    seen = [tuple(sorted(p)) for i, j in jaccard.pairs(tree, tree, 85) for p in zip(i.tolist(), j.tolist())]
    assert want <= set(seen) and len(seen) == len(set(seen))
    alone = jaccard.with_partner([jaccard.marked(s, jaccard.bits_for(len(s))).tobytes() for s in sets], np.array([len(s) for s in sets]), 85)
    assert {k for p in want for k in p} <= set(np.flatnonzero(alone).tolist())
    half = len(sets) // 2
    host = jaccard.hosts_of(sets[:half], sets[half:], 85)
    assert [h >= 0 for h in host] == [any((i, half + k) in want for i in range(half)) for k in range(len(sets) - half)]


def test_jaccard_pairs_that_all_are_settled():
    """More near copies than one step compares: once all are linked, no pair of the rest is left to compare."""
    base = np.arange(100, dtype=np.uint64) * np.uint64(1 << 57)
    sets = [np.sort(jaccard.mix(np.append(base + np.uint64(7), np.uint64(k)))) for k in range(3 * jaccard.FAN)]
    assert (jaccard.connected(sets, 85) == 0).all()
    assert (jaccard.hosts_of(sets[1:], sets[:1], 85) >= 0).all()
    assert not len(jaccard.linked(sets, sets, np.zeros(0, np.int64), np.zeros(0, np.int64), 85))
