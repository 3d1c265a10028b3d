"""The training-data operators against brute force, exact round trips and planted cases; and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tidemark.llm import common, content, decontaminate, lm, packing, passages, private, quality, queries, similar, simhash, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "host", "m", "failed", "bad", "fp", "root", "seed", "uid", "base", "spans", "clean", "task", "part", "key", "bin")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("lmnrst") + r.choice(["", "ing", "ed", "er", "o"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Prose with near and exact copies, a repeated row, nulls, empty, blank and long texts, and columns of clashing names."""
    texts = [prose(60 + k, k) for k in range(40)]
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), None, "", " \t\n", "one", "two words", prose(30_000, 99), "\x1c a\x00b c d e", texts[5]]
    rows = [(k, t, "en", "src%d" % (k % 3) if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_lm_equals_recursion(spark, docs, plain):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), r.held_out) for r in lm.score_documents(docs, order=2, mu=5.0).collect())
    words = [WORD.findall(lowered(t)) + ["</s>"] for _, t in plain]
    out = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in plain]
    one, two = Counter(), Counter()
    for w, o in zip(words, out):
        if not o:
            one.update(w)
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    base = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    p = lambda u, w: (two[u, w] + 5 * base(w)) / (one[u] + 5) if one[u] else base(w)
    expected = []
    for (i, _), w, o in zip(plain, words, out):
        score = math.log10(base(w[0])) + sum(math.log10(p(a, b)) for a, b in zip(w, w[1:]))
        expected.append((i is None, i or 0, len(w), sum(one[x] > 0 for x in w), n, round(sum(math.log10(base(x)) for x in w), 6), round(score, 6), o))
    assert got == sorted(expected)
    assert abs(sum(p("xx", w) for w in one) + 0.5 / (n + 0.5 * (v + 1)) - 1) < 1e-9


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_orders_equal_recursion(docs, plain, order):
    mu = 5.0
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 5)) for r in lm.score_documents(docs, order=order, mu=mu).collect())
    words = [tuple(WORD.findall(lowered(t)) + ["</s>"]) for _, t in plain]
    out = [zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1 for i, _ in plain]
    counts = Counter(w[k - n : k] for w, o in zip(words, out) if not o for n in range(1, order + 1) for k in range(n, len(w) + 1))
    n_all, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[w,] + 0.5) / (n_all + 0.5 * (v + 1))
        return (counts[(*h, w)] + mu * p(h[1:], w)) / (counts[h] + mu)

    expected = [(i is None, i or 0, round(sum(math.log10(p(w[max(0, k - order + 1) : k], w[k])) for k in range(len(w))), 5)) for (i, _), w in zip(plain, words)]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * max(1, abs(b[2])) for a, b in zip(got, sorted(expected))) and len(got) == len(expected)


@pytest.mark.parametrize("bits", [1, 13, 40, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_packed_hashes_round_trip(bits, n):
    values = np.sort(np.random.default_rng(bits).integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(64 - bits))
    data = lm.dense(values, bits)
    assert (lm.sparse(data, bits) == values).all() and len(lm.sparse(data, bits)) == n
    assert 8 * len(data) <= n * (max(0, bits - max(0, n.bit_length() - 1)) + 3) + 64


def fingerprint(text):
    w = WORD.findall(lowered(text))
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(docs, plain):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_groups(docs)).collect())
    prints = [fingerprint(t) for _, t in plain]
    root = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(plain, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(plain, prints, root))


def test_trie_join_and_chunks(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(30):
            values.add(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    tied = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.links(fps, chunk=16)).collect()}
    root = grouped(values, lambda a, b: (a ^ b).bit_count() <= 4)
    parts, expected = defaultdict(set), defaultdict(set)
    for v, e in zip(values, root):
        parts[tied.get(v, v)].add(v)
        expected[e].add(v)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize(("listed", "others"), [(0, 100), (1, 0), (10, 100_000), (1000, 100_000), (50_000, 300), (3, 3)])
def test_cascade_is_exact(listed, others):
    draw = np.random.default_rng(listed + others)
    a, b = (draw.integers(-(1 << 63), 1 << 63, listed + others, dtype=np.int64) for _ in "ab")
    mark = np.arange(len(a)) < listed
    made = urls.Cascade.of_bytes(urls.Cascade.built(a, b, mark).to_bytes())
    assert (made.has(a, b) == mark).all()
    # Some bits for each listed key: the size follows the list, and the universe by its logarithm only.
    assert 8 * len(made.to_bytes()) <= listed * (8 + 2 * math.log2(1 + others / max(1, listed))) + 64 * 64


GIVEN = ["https://WWW.Example.com/en/a?b", "http://example.com/en/", "http://x.example.com/fr", "http://a.net/es/1#x", "a.net/es/", None, "http://b.org/x", "http://com", "x://Ä.com/y", "http://q.net/fr/" + "z/" * 20_000, "http://" + "l." * 3000 + "com/"]


@pytest.mark.parametrize("small", [True, False])
def test_urls(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(urls, "ASKED_KEYS", 3)
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(GIVEN)] + [(0, GIVEN[0])], "page_id long, url string").withColumns({c: F.lit(1) for c in ("row", "host", "path", "keys", "shard", "key")})
    rows = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()]
    got = {r[0]: r[1:] for r in rows}
    assert len(rows) == len(GIVEN) + 1
    assert [got[k][2:] for k in range(11)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("net/fr/", "block"), ("com/", "allow")]
    assert got[8][0] == "Ä.com" and got[5][:2] == ("", "") and got[7][:2] == ("com", "")


def test_urls_of_conflicting_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/x")], "page_id long, url string")
    rules = urls.rule_table(spark, [("a.com", "/", "allow"), ("a.com", "/", "block"), ("a.com", "/", "block"), ("b.com", "/", "allow")])
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()} == {(1, "a.com/", "block"), (2, "b.com/", "allow")}
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules.where("false")).collect()} == {(1, None, "allow"), (2, None, "allow")}


def test_leaks_tolerate_substitutions(spark, docs):
    item = prose(24, 500).split()
    changed = list(item)
    changed[6], changed[15] = "other", "words"
    extra = [(900, prose(50, 7) + " " + " ".join(item).upper() + " " + prose(9, 8)), (901, prose(31, 9) + " " + " ".join(changed)), (902, prose(20, 10) + " " + " ".join(item[:7]) + " " + prose(20, 11)), (None, " ".join(item))]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short for once"), (4, prose(20, 501)), (5, "  ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_same, r.doc_start) for r in decontaminate.leaks(more, bench).collect()}
    assert got == {(900, 1): (24, 24, 50), (901, 1): (24, 22, 31), (None, 1): (24, 24, 0)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_leaks_of_eight_words_at_odd_places(spark):
    item = prose(8, 510)
    docs = spark.createDataFrame([(k, f"{prose(20 + k, 511)} {item} tail") for k in range(4)], "doc_id long, text string")
    got = {(r.doc_id, r.doc_start) for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(k, 20 + k) for k in range(4)}


def leak_by_brute_force(doc: str, item: str):
    """The best overlap over all diagonals: (same, -words, -doc start, -item start), or None."""
    d, w = (WORD.findall(lowered(x)) for x in (doc, item))
    best = None
    if w and len(w) < 8:
        starts = [k for k in range(len(d) - len(w) + 1) if d[k : k + len(w)] == w]
        return (len(w), -len(w), -starts[0], 0) if starts else None
    for diagonal in range(-len(w), len(d)):
        lo, hi = max(0, -diagonal), min(len(w), len(d) - diagonal)
        score = top = 0
        begin = first = lo
        last = lo - 1
        for j in range(lo, hi):
            if score <= 0:
                score, begin = 0, j
            score += 1 if d[j + diagonal] == w[j] else -3
            if score > top:
                top, first, last = score, begin, j
        n = last - first + 1
        same = sum(d[j + diagonal] == w[j] for j in range(first, last + 1))
        if n >= min(12, len(w)) and n > 0 and same >= 0.8 * n:
            best = max(best or (0,), (same, -n, -(first + diagonal), -first))
    return best


@pytest.mark.parametrize("light", [True, False])
def test_leaks_equal_brute_force(spark, light, monkeypatch):
    if not light:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    r = random.Random(6)
    items = [(k, prose(n, 600 + k)) for k, n in enumerate([1, 3, 5, 7, 7, 8, 9, 12, 14, 20, 30, 45, 59, 30])] + [(20, None), (21, ""), (13, prose(30, 613))]
    rows = []
    for k in range(150):
        parts = [prose(r.randint(0, 25), 700 + k)]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items)[1]
            w = (w or "").split()
            w = [f"sub{r.randint(0, 99)}" if r.random() < r.choice([0, 0, 0.05, 0.12]) else x for x in w]
            cut = r.randint(0, max(0, len(w) - 12)) if r.random() < 0.3 else 0
            parts += [" ".join(w[cut:]), prose(r.randint(0, 25), 900 + k)]
        rows.append((k if k % 10 else None, " ".join(parts).upper() if k % 4 == 0 else " ".join(parts)))
    rows += [rows[1], (1, prose(30, 3)), (2, None), (3, "")]
    expected = {}
    for i, t in rows:
        for n, w in items:
            if w and t and (b := leak_by_brute_force(t, w)):
                expected[i, n] = max(b, expected.get((i, n), (0,)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "no", "item", "seed")})
    got = {(x.doc_id, x.item_id): (x.n_same, -x.n_words, -x.doc_start, -x.item_start) for x in decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(expected.get(k) == v for k, v in got.items())
    assert len(got) >= 0.97 * len(expected) and {k for k in expected if k[1] < 5} <= set(got) and len(expected) > 60


def test_no_documents_leak_nothing(spark, docs):
    items = spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")
    assert decontaminate.leaks(docs.where("false"), items).count() == 0 and decontaminate.without_leaks(docs.where("false"), items).count() == 0


def test_leaks_go_by_row(spark):
    item = prose(24, 500)
    rows = [(None, item), (None, prose(40, 1)), (7, item), (7, prose(40, 2)), (8, prose(40, 3))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, kept)) == Counter([rows[1], rows[3], rows[4]])


def pieces_of(text):
    """(start, length, checksum) of each piece of a document."""
    ids = np.array([*tokens.encoder(tokens.DEFAULT).library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    return [(s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]


def sequences_of(rows) -> dict:
    """Rows by sequence, after a look at their places: gapless from 0, at most 2048 long."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0, *(r.length for r in some)])[:-1].tolist() and sum(r.length for r in some) <= 2048
    return by_sequence


def test_packing_tiles_every_document(docs, plain):
    """Repeated rows, repeated and null ids included: each row's pieces are there once."""
    rows = packing.pack_documents(docs).collect()
    expected = Counter((i, k, *piece) for i, t in plain for k, piece in enumerate(pieces_of(t)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    lower = packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert lower <= len(sequences_of(rows)) <= lower + 1


@pytest.mark.parametrize("spread", [(1, 2047), (600, 1100), (700, 700), (1025, 1300)])
def test_exchange_comes_near_the_bound(spark, spread):
    """Many small groups, which leave room only others can fill; equal rows spread over them; certified groups keep all but their emptiest bin."""
    r = random.Random(sum(spread))
    rows = [(None if k % 9 == 0 else k % 50, 0, 0, r.randint(*spread), 7) for k in range(3000)] + [(1, 0, 0, 2048, 1)] * 3
    pieces = packing.saved(spark.createDataFrame(rows, packing.PIECE).repartition(4), "test-pieces")
    out = packing.pack(pieces, group_pieces=400).collect()
    assert Counter((x.doc_id, x.length) for x in out) == Counter((x[0], x[3]) for x in rows)
    lengths = np.array([x[3] for x in rows])
    bound, plain_fit = packing.lower_bound(lengths, 2048), len(packing.best_fit_decreasing(lengths, 2048)[2])
    assert bound <= len(sequences_of(out)) <= max(1.02 * plain_fit, bound + 2)
    assert packing.whole_bound(pieces, 2048) == bound


def least_bins(lengths: list[int], limit: int) -> int:
    """The fewest bins, by trying."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + lengths[k] <= limit}.values():
            place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_fewest_bins():
    r = random.Random(2)
    for _ in range(200):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        fewest = least_bins(lengths, 20)
        assert packing.lower_bound(np.array(lengths), 20) <= fewest <= len(packing.best_fit_decreasing(np.array(lengths), 20)[2])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(docs, plain, name, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 40)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    enc = tokens.Encoder(name)
    odd = ["<|endoftext|>x <|startoftext|>", "it's 12a3 naïve café ǅ İstanbul e\u0301", "a\u00a0b\u2003c", "ﬁn ½ 日本語 👩‍👩‍👧", "x" * 3000, "don't!!! (ok)...", "word1 2word3's " * 300, "abc123" * 2000, "12 34  ab  cd " * 400, "<|endoftext|>7a" * 200, "a b" * 900]
    for t in [*odd, *(t or "" for _, t in plain)]:
        expected = enc.library.encode(t) if enc.pieces else enc.library.encode(t, add_special_tokens=False).ids
        given = tokens.text_array(__import__("pyarrow").array([t]))
        assert enc.counts(given)[0] == len(expected) and enc.encoded(given)[0].tolist() == list(expected), t[:50]
    assert enc.cut is not tokens.NEVER
    assert tokens.count_tokens(docs, name).count() == docs.count()


def test_long_strings_are_cut_only_where_tokens_end(monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 100)
    for name, text, parts in [("word_bpe_49k.json", "abc123" * 200, 11), ("word_bpe_49k.json", "x" * 1000, 1), ("byte_bpe_50k.json", "ab cd " * 200, 11), ("piece_bpe_32k.model", "ab cd " * 200, 11)]:
        assert len(tokens.cut_at(tokens.Encoder(name).cut, text, 100)) >= parts


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_chunks_that_differ_in_case_and_ends_are_encoded_once():
    """Odd texts get the library's ids, and chunks that differ in case or in the signs after them aren't encoded one by one."""
    enc = tokens.Encoder(tokens.DEFAULT)
    r = random.Random(5)
    signs = [*"aBÉé\u00df\u00d7\u00f7\u00ff'J\u030cI\u0307\u0130\u03a3\u03c21\u0663\u00b2\u00aa\u00b5.,!|><\u00a0\u3000\x85\x1c\x00_-~`[]{\U0001f600\u01c6\u017f\u212a\u0338=^\u00ad\u200d", "'s", "'LL", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", *" " * 10, "\n"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for some in (texts[:2500], texts[2500:], texts[:100], []):
        ids, offsets = enc.encoded(pa.array(some, pa.large_string()))
        expected = [e.ids for e in enc.library.encode_batch_fast(some, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
        assert enc.counts(pa.array(some, pa.large_string())).tolist() == [len(x) for x in expected]

    class Counted:
        def __init__(self, library):
            self.library, self.pieces = library, 0

        def encode_batch_fast(self, texts, **options):
            self.pieces += sum(len(t.split()) for t in texts)
            return self.library.encode_batch_fast(texts, **options)

    enc = tokens.Encoder(tokens.DEFAULT)
    enc.library = Counted(enc.library)
    words = [w + end for k in range(50) for w in (f"w{chr(97 + k % 26)}x" * (k // 26 + 1), f"W{chr(97 + k % 26)}X" * (k // 26 + 1)) for end in ("", ".", ",", "!?", "%%%")]
    enc.encoded(pa.array([" ".join(words)], pa.large_string()))
    assert enc.library.pieces <= 54, "50 words and 4 endings of 500 chunks"


def good(kind, value):
    d = re.sub("[^0-9]", "", value)
    luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))))
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(d) <= 19 and luhn % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]


def test_private_spans_equal_plain_patterns(spark):
    r = random.Random(3)
    texts = [None, "", "x@y.zz é a.b@c.d_e@f.gg 1.2.3.4.5.6.7.8 1.2.3.400 001.2.3.255 4111 1111 1111 1111-1 4041894974608795 +1 (988) 555-2485. +12.", "a@" + "b." * 9000 + "c", "1 " * 9000, "9" * 9000, "." * 5000 + "@x.y", "😀 me@x.org"]
    texts += ["".join(r.choice("0123456789 .-+@ab_()") for _ in range(200)) for _ in range(300)]
    got = {x.doc_id: x for x in private.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, n, m.end()) for k, (n, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if good(n, m[0]))
        written = ",".join(f"{n}:{s}:{e}" for s, _, n, e in found)
        assert got[i].spans == written and got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(x[2] == n for x in found) for n in PATTERNS]


def sanitised_by_brute_force(texts: list[str]) -> list[str]:
    """What disclosure asks for, by counting documents one by one."""
    spans = [sorted((m.start(), k, n, m.end(), m[0]) for k, (n, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if good(n, m[0])) for t in texts]
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]

    def entities(found):
        out = {}
        for start, _, kind, end, value in found:
            digits = re.sub("[^0-9]", "", value)
            own = value.lower() if kind in ("email", "ip") else digits
            group = {"email": "domain:" + value.lower().partition("@")[2], "ip": "network:" + value.rpartition(".")[0], "card": "issuer:" + digits[:6], "phone": "area:" + digits[:6]}[kind]
            for e in (f"{kind}:{own}", group):
                out.setdefault(e, (start, end))
        return out

    said = [entities(f) for f in spans]
    outside = []
    for t, f in zip(texts, spans):
        at, kept = 0, ""
        for start, _, _, end, _ in f:
            if start >= at:
                kept += t[at:start] + " "
            at = max(at, end)
        outside.append(set(split(kept + t[at:])))
    every = [set(split(t)) for t in texts]

    def around(k, e):
        start, end = said[k][e]
        left, right = split(texts[k][max(0, start - 160) : start]), split(texts[k][end : end + 160])
        return (left[1] if len(left) > 1 else "", right[-2] if len(right) > 1 else "")

    total, put = len(texts), {}
    docs_of = defaultdict(list)
    for k, e in enumerate(said):
        for name in e:
            docs_of[name].append(k)
    share = lambda both, df, n: math.log(min(1, both / df) * total / n) / math.log(total / n)
    for e, ks in docs_of.items():
        if len({around(k, e) for k in ks}) < 3 or len(ks) == total:
            continue
        for term in set().union(*(outside[k] for k in ks)):
            held = [k for k in ks if term in outside[k]]
            support = len({around(k, e) for k in held})
            if support < 3 or support < 0.5 * len(held) or share(len(held), sum(term in w for w in every), len(ks)) < 0.8:
                continue
            put[e, term] = ""
            for n in range(len(term) - 1, 1, -1):
                both = sum(any(w.startswith(term[:n]) for w in outside[k]) for k in ks)
                if share(both, sum(any(x.startswith(term[:n]) for x in w) for w in every), len(ks)) < 0.8:
                    put[e, term] = term[:n] + "*"
                    break
    out = []
    for k, t in enumerate(texts):
        more = list(spans[k])
        for m in re.finditer(r"[^\W_]+", t):
            asked = [put[e, m[0].lower()] for e in said[k] if (e, m[0].lower()) in put]
            if asked and not any(s[0] < m.end() and s[3] > m.start() for s in spans[k]):
                more.append((m.start(), 9, "term", m.end(), min(asked, key=lambda p: (len(p), p))))
        at, new = 0, ""
        for start, _, kind, end, value in sorted(more):
            if start >= at:
                new += t[at:start] + (value if kind == "term" else f"<{kind.upper()}>")
            at = max(at, end)
        out.append(new + t[at:])
    return out


def test_disclosure_equals_brute_force(spark):
    rows = [prose(30, k) for k in range(100)]
    rows += [f"{prose(60, 200 + k)} Zorblax {prose(40, 250 + k)} me@x.org {prose(60, 300 + k)} q7" for k in range(4)]
    rows += [f"{prose(60, 400)} Quuxley you@x2.org {prose(60, 401)}" + " end" * k for k in range(4)]
    rows += [f"{prose(60, 500 + k)} Maruvian {prose(9, 600 + k)} p{k}@maru.example.org {prose(60, 650 + k)}" for k in range(5)]
    rows += [f"{prose(20, 700 + k)} maruti marble {prose(5, 800 + k)}" for k in range(8)]
    rows += [f"{prose(50, 850 + k)} +1 (988) 555-24{10 + k} {prose(40, 870 + k)} 10.2.3.{k} {prose(50, 890 + k)}" for k in range(4)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in private.sanitised(frame).collect()}
    expected = sanitised_by_brute_force(rows)
    assert [clean[k] for k in range(len(rows))] == expected
    assert all("Zorblax" not in clean[100 + k] and "<EMAIL>" in clean[100 + k] for k in range(4)), "revealed by a name far from the address"
    assert all("Quuxley <EMAIL>" in clean[104 + k] for k in range(4)), "copies don't count"
    assert all("Maruvian" not in clean[108 + k] and "mar" in clean[108 + k] for k in range(5)), "generalised to what other words share"
    assert all(clean[k] == t for k, t in enumerate(rows[:100]))


def test_revealing_terms_go_where_the_entity_is_absent(spark):
    """A word that discloses an entity is a span in every document, also beside a span that it touches or without any."""
    rows = [prose(30, 2000 + k) for k in range(100)]
    rows += [f"{prose(60, 2200 + k)} Zorblax {prose(40, 2250 + k)} me@x.org {prose(60, 2300 + k)}" for k in range(4)]
    rows += [f"{prose(9, 2400)} Zorblax, zorblax; {prose(9, 2401)}", f"{prose(9, 2402)} 10.2.3.4zorblax {prose(9, 2403)}", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in private.digest(frame).collect()}
    for k, text in enumerate(rows):
        places = {f"term:{m.start()}:{m.end()}" for m in re.finditer("(?i)zorblax", text or "")}
        assert places <= set(got[k].split(",")), k
    assert got[106] == "" and "ip:" in got[105]
    clean = {r.doc_id: (r.text, r.n_chars) for r in private.sanitised(frame.withColumn("n_chars", F.length("text")), size="n_chars", everywhere=True).collect()}
    assert all("orblax" not in (t or "") and n == (None if t is None else len(t)) for t, n in clean.values())
    assert clean[106] == (None, None) and "<IP>" in clean[105][0]
    assert all(clean[k] == (t, len(t)) for k, t in enumerate(rows[:100]) if "term" not in got[k])


def test_beginnings_are_counted_over_words(spark):
    """What meets the wanted beginnings are words of the corpus: as many rows for many documents as for one."""
    texts = [["marb", "marble", "mare", "q", "zo", "zorb"], ["mar", "marb"], ["m", "marbles"], []]
    frame = spark.createDataFrame([(t,) for t in texts * 20], "words array<string>")
    few = private.beginnings(F.col("words"), 5, frame)
    assert few.count() == private.beginnings(F.col("words"), 5, frame.limit(4)).count() <= 8
    wanted = spark.createDataFrame([(p,) for p in ("ma", "mar", "marb", "marbl", "zor", "zz")], "prefix string")
    got = {r.prefix: r.df for r in private.counted(few, wanted, "df").collect()}
    plain = {p: 20 * sum(any(w.startswith(p) for w in t) for t in texts) for p in ("ma", "mar", "marb", "marbl", "zor", "zz")}
    assert got == {p: n for p, n in plain.items() if n}


def test_words_are_summed_up_before_they_meet_beginnings(spark):
    """A join with the wanted beginnings makes a row for each of these, however many words begin so."""
    of = spark.createDataFrame([("e%d" % (k % 2), f"ma{k:03d}", 1, 1 + k % 3) for k in range(600)], "entity string, word string, after int, n long")
    for keep in ([], ["entity"]):
        wanted = spark.createDataFrame([("e1", "ma"), ("e1", "ma1"), ("e0", "zz")], "entity string, prefix string").select(*keep, "prefix")
        out = private.counted(of, wanted, "df", *keep)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join ") < plan.index("Aggregate ")
        plain = {p: sum(1 + k % 3 for k in range(600) if f"ma{k:03d}".startswith(p) and (not keep or k % 2)) for p in ("ma", "ma1")}
        assert {r.prefix: r.df for r in out.collect()} == plain


def test_running_sums(spark):
    r = random.Random(1)
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 200, 5000)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<long>")
    got = {x.k: x.s for x in frame.select("k", private.running(F.col("v"), lambda a, x: a + x, F.lit(0).cast("long")).alias("s")).collect()}
    assert all(got[k] == np.cumsum(v).tolist() for k, v in enumerate(lists))


def test_passages_with_edits(spark, docs):
    shared = prose(120, 700).split()
    edited = list(shared)
    edited[40] = "changed"
    del edited[80]
    rows = [(800, prose(70, 1) + " " + " ".join(shared)), (801, " ".join(edited) + " " + prose(50, 2)), (802, prose(20, 3) + " " + " ".join(shared[:30])), (803, prose(200, 4))]
    got = {(r.doc_id, r.other_id): r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(800, 801), (801, 800)}
    one = got[801, 800]
    assert (one.first, one.last, one.other_first, one.other_last, one.n_same) == (0, 119, 70, 190, 118)
    assert {800, 801} & {r.doc_id for r in passages.passages(docs).collect()} == set()


def test_every_passage_of_a_pair():
    code = lambda *parts: np.array([zlib.crc32(w.encode()) for p in parts for w in p.split()])
    one, two, three = (prose(n, 710 + n) for n in (60, 61, 200))
    x = code(one, prose(60, 721), two, prose(40, 722), three)
    y = code(one, prose(60, 723), two, prose(70, 724), three)
    assert passages.chained([0, 120, 221], [0, 120, 251], [60, 61, 200]) == [[0, 1, 2]]
    ((got, cut),) = passages.aligned([(x, y, (True, True), [0, 120, 221], [0, 120, 251], [60, 61, 200])])
    assert [g[4] for g in got] == [60, 61, 200] and not cut
    assert [g[:4] for g in got] == [(0, 60, 0, 60), (120, 181, 120, 181), (221, 421, 251, 451)]


def local_score(x, y) -> int:
    """Best local alignment, by the whole table."""
    best, row = 0, np.zeros(len(y) + 1, dtype=np.int64)
    for i in range(len(x)):
        new = np.zeros(len(y) + 1, dtype=np.int64)
        for j in range(len(y)):
            new[j + 1] = max(0, row[j] + (1 if x[i] == y[j] else -3), row[j + 1] - 3, new[j] - 3)
        best, row = max(best, int(new.max())), new
    return best


def test_alignment_equals_the_whole_table():
    r = random.Random(4)
    pairs, expected = [], []
    for k in range(60):
        x = [r.randint(1, 1 << 30) for _ in range(r.randint(60, 110))]
        y = [w for w in x if r.random() > 0.03]
        y = [r.randint(1, 1 << 30) if r.random() < 0.1 else w for w in y]
        y = [r.randint(1, 1 << 30) for _ in range(r.randint(0, 30))] + y + [r.randint(1, 1 << 30) for _ in range(r.randint(0, 30))]
        seeds = [(i, j) for i in range(len(x) - 7) for j in range(len(y) - 7) if x[i : i + 8] == y[j : j + 8]]
        if not seeds:
            continue
        i, j = r.choice(seeds)
        pairs.append((np.array(x), np.array(y), (True, True), [i], [j], [8]))
        expected.append(local_score(x, y))
    assert len(pairs) > 40
    monkey = passages.MIN_WORDS
    passages.MIN_WORDS = 1
    try:
        got = [passages.aligned([p])[0][0] for p in pairs]
    finally:
        passages.MIN_WORDS = monkey
    # Alignments of fewest unequal columns, which may score a little less than the best ones.
    told = [max((4 * s[4] - 3 * max(s[1] - s[0], s[3] - s[2]) for s in spans), default=0) for spans in got]
    assert all(t >= e - 9 for t, e in zip(told, expected)) and sum(told) >= 0.97 * sum(expected)


def test_maximal_runs():
    assert passages.maximal_runs([5, -2, 4]) == [(0, 2)]
    assert passages.maximal_runs([2, -3, 9, -1, 1]) == [(0, 0), (2, 2), (4, 4)]
    assert passages.maximal_runs([4, -3, 4, -9, 7]) == [(0, 2), (4, 4)]


def test_passages_whose_parts_stand_elsewhere_first(spark):
    """D1 and D2 hold a half each, B and C the whole: all pairs of places of 50 words and more must be told, whoever holds their seeds first."""
    rows = []
    for k in range(12):
        one, two = prose(30, 740 + k), prose(30, 760 + k)
        texts = [f"{one} {prose(60, 800 + k)}", f"{prose(60, 820 + k)} {two}", f"{prose(33, 840 + k)} {one} {two}", f"{one} {two} {prose(33, 860 + k)}"]
        rows += [(10 * k + n, t) for n, t in enumerate(texts)]
    copy = prose(70, 780)
    rows += [(900, f"{copy} {prose(80, 781)} {copy}"), (901, copy)]
    got = {(r.doc_id, r.first) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("last - first >= 58").collect()}
    whole = {(10 * k + 2, 33) for k in range(12)} | {(10 * k + 3, 0) for k in range(12)} | {(900, 0), (900, 150), (901, 0)}
    assert {(d, min((f for e, f in whole if e == d), key=lambda x: abs(x - at))) for d, at in got} == whole


@pytest.mark.parametrize("changed", [12, 10, 8])
def test_passages_with_many_edits(spark, changed):
    """Pairs with every n-th word changed: the share that is found."""
    rows = []
    for k in range(40):
        words = prose(70, 1000 + k).split()
        edited = [f"new{n}" if n % changed == k % changed else w for n, w in enumerate(words)]
        rows += [(2 * k, " ".join([prose(20, 1100 + k), *words])), (2 * k + 1, " ".join([*edited, prose(20, 1200 + k)]))]
    got = {r.doc_id for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 72, len(got)


def test_passages_against_brute_force(spark):
    """A small corpus of copies with random edits, three or more of each passage, fragments of them in smaller ids, and unrelated texts."""
    r, rows, inside = random.Random(8), [], {}
    for k in range(14):
        shared = prose(80, 3000 + k).split()
        for piece in range(0, 52, 4):
            rows.append((len(rows), f"{prose(20, 3100 + 20 * k + piece)} {' '.join(shared[piece : piece + 32])} {prose(20, 3500 + 20 * k + piece)}"))
        for copy in range(r.randint(2, 5)):
            edited = [f"e{r.randint(0, 10**6)}" if r.random() < 0.05 * (copy % 3) else w for w in shared]
            rows.append((len(rows), f"{prose(r.randint(0, 60), 4000 + 10 * k + copy)} {' '.join(edited)} {prose(r.randint(0, 60), 5000 + 10 * k + copy)}"))
            inside.setdefault(k, []).append(rows[-1][0])
    rows += [(len(rows) + n, prose(150, 6000 + n)) for n in range(40)]
    texts = {i: t.split() for i, t in rows}
    score = {}
    for some in inside.values():
        for a in some:
            for b in some:
                if a < b:
                    score[a, b] = local_score(texts[a], texts[b])
    expected = {d for pair, s in score.items() if s >= 50 for d in pair}
    got = {x.doc_id for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & expected) >= 0.95 * len(expected)
    assert got <= {d for some in inside.values() for d in some}, "a passage where none is"


@pytest.mark.parametrize("many", [6, 150])
def test_passages_at_a_line_that_many_hold(spark, monkeypatch, many):
    """Pairs whose only common seeds are those of a line that others hold as well, so that neighbours in order seldom are the pair."""
    monkeypatch.setattr(passages, "BLOCK", 64, raising=False)
    line = prose(10, 7000)
    rows = [(k, f"{prose(60, 7100 + k)} {line} {prose(60, 7400 + k)}") for k in range(many)]
    for k in range(8 if many > 10 else 2):
        before, after = prose(40, 7700 + k).split(), prose(40, 7800 + k).split()
        for side in "ab":
            left, right = ([f"{side}{n}" if n % 6 == out else w for n, w in enumerate(words)] for words, out in ((before, 3), (after, 0)))
            rows.append((many + 2 * k + "ab".index(side), " ".join([prose(30, 7900 + len(rows)), *left, line, *right, prose(30, 8000 + len(rows))])))
    got = {(r.doc_id, r.other_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {(a, a + 1) for a in range(many, len(rows), 2)}
    assert got == pairs | {(b, a) for a, b in pairs}


def test_passages_through_words_that_repeat(spark, monkeypatch):
    """Runs of one word, and of a line, that many documents hold: their occurrences don't all meet, and passages through and of them are found."""
    monkeypatch.setattr(passages, "BLOCK", 64)
    line = prose(9, 9000)
    rows = [(k, f"{prose(60, 9100 + k)} {'zz ' * (20 + k % 10)} {prose(60, 9200 + k)} {f'{line} ' * (2 + k % 3)} {prose(60, 9300 + k)}") for k in range(30)]
    for k in range(3):
        before, after = prose(40, 9400 + k).split(), prose(40, 9500 + k).split()
        for side in "ab":
            left, right = ([f"{side}{n}" if n % 6 == out else w for n, w in enumerate(words)] for words, out in ((before, 3), (after, 0)))
            rows.append((len(rows), " ".join([prose(30, 9600 + len(rows)), *left, *["zz"] * (22 + 2 * (side == "b")), *right, prose(30, 9700 + len(rows))])))
    rows += [(len(rows) + k, f"{prose(30, 9800 + k)} {'zz ' * n} {prose(30, 9900 + k)}") for k, n in enumerate((60, 130))]
    plain, made = passages.left_over, []

    def counting(*args):
        made.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(passages, "left_over", counting)
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.other_id) for r in out}
    pairs = {(a, a + 1) for a in (30, 32, 34, 36)}
    assert got == pairs | {(b, a) for a, b in pairs}
    for k, n in ((36, 60), (37, 130)):
        assert {w for r in out if r.doc_id == k for w in range(r.first, r.last)} >= set(range(30, 30 + n))
    assert made[0] < 20_000


@pytest.mark.parametrize("words", [3, 40, 10**6])
def test_what_may_share_a_passage(words):
    """Blocks of occurrences against a plain comparison of all pairs; with few words, so that texts repeat themselves, too."""
    r = random.Random(words)
    texts, at = [], []
    for k in range(40):
        left, right = ([r.randint(1, words) for _ in range(r.choice([0, 3, 30, 200]))] for _ in "ab")
        if k % 3 and right:
            right[: len(right) // 2] = (texts[k - 1][at[k - 1] + 7 :] + [0] * 200)[: len(right) // 2]
        if k % 4 == 1 and left and texts[k - 1][: at[k - 1]]:
            left[: 9] = texts[k - 1][: at[k - 1]][:9]
        texts.append(left + list(range(-7, 0)) + right)
        at.append(len(left))
    near = [(t[max(0, p - passages.AROUND) : p + 7 + passages.AROUND], min(p, passages.AROUND)) for t, p in zip(texts, at)]

    def may(one, two):
        (x, p), (y, q) = one, two
        lo, hi = 0, 7
        while min(p, q) + lo > 0 and x[p + lo - 1] == y[q + lo - 1]:
            lo -= 1
        while p + hi < len(x) and q + hi < len(y) and x[p + hi] == y[q + hi]:
            hi += 1
        runs = lambda t, s: {(tuple(t[i : i + 4]), i - s) for i in range(len(t) - 3)}
        return hi - lo >= 50 or any(g == h and not (i == j and lo <= i and i + 4 <= hi) for g, i in runs(x, p) for h, j in runs(y, q))

    sizes = np.concatenate([[0], np.cumsum([len(t) for t, _ in near])])
    flat, seats = np.array([w for t, _ in near for w in t]), np.array([p for _, p in near])
    for split in (15, 40):
        i, j = passages.supported(flat, sizes, seats, split)
        got = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
        expected = {(a, b) for a in range(split) for b in range(split if split < 40 else 0, 40) if a != b and may(near[a], near[b])}
        assert expected <= got
        if words > 40:
            assert expected == got


def test_passages_of_rows_that_share_an_id_or_have_none(spark):
    copy = prose(80, 790)
    rows = [(None, copy + " " + prose(30, 1)), (None, prose(30, 2) + " " + copy), (5, copy), (5, prose(60, 3)), (6, prose(90, 4))]
    got = [(x.doc_id, x.first, x.last, x.other_id) for x in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {(g[0], g[1], g[2]) for g in got} == {(None, 0, 80), (None, 30, 110), (5, 0, 80)}
    assert passages.passages(spark.createDataFrame([(1, copy), (1, copy)], "doc_id long, text string")).count() == 2


def test_long_equal_stretches_beyond_the_margin(spark, monkeypatch):
    """Where a chain covers a part only, alignment goes on with the whole texts."""
    monkeypatch.setattr(passages, "MARGIN", 10)
    x = [zlib.crc32(w.encode()) for w in prose(400, 5).split()]
    whole = passages.aligned([(np.array(x), np.array(x), (True, True), [200], [200], [8])])
    assert whole == [([(0, 400, 0, 400, 400)], False)]
    part = np.array(x[190:218])
    assert passages.aligned([(part, part, (False, False), [10], [10], [8])])[0][1]
    copy = prose(300, 6)
    got = passages.passages(spark.createDataFrame([(1, copy), (2, copy)], "doc_id long, text string")).collect()
    assert {(g.first, g.last, g.n_same) for g in got} == {(0, 300, 300)}


def test_seed_links_across_tasks():
    r = random.Random(9)
    rows = sorted((r.randint(0, 5), r.randint(0, 9), k) for k in range(200))
    seed, doc, at = (np.array(c) for c in zip(*rows))
    runs = [k for k in range(200) if not k or rows[k][:2] != rows[k - 1][:2]] + [200]
    expected = set()
    for x, y, z in zip(runs, runs[1:], runs[2:]):
        if seed[x] == seed[y]:
            expected |= {(y, k) for k in range(x, y)} | {(k, y - 1) for k in range(y, z)}
    assert passages.LINKS == 1 and set(zip(*map(np.ndarray.tolist, passages.linked(seed, doc, at)))) == expected
    for cut in (1, 50, 117, 199):
        low, high = passages.borders(seed[:cut], doc[:cut])[1], passages.borders(seed[cut:], doc[cut:])[0] + cut
        kept = np.append(low, high)
        found = {(int(kept[i]), int(kept[j])) for i, j in zip(*passages.linked(seed[kept], doc[kept], at[kept]))}
        assert {p for p in expected if (p[0] < cut) != (p[1] < cut)} <= found


def test_fenwick_chains():
    assert passages.chained([0, 20, 40], [0, 22, 5], [10, 10, 10]) == [[0, 1], [2]]


def test_quality_equals_brute_force(docs, plain):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()}
    expected = set()
    for i, t in plain:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        repeat = len({k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.add((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
    assert got == expected
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_bad_hosts_take_their_documents_along(spark):
    rows = [(k, "x y", "bad") for k in range(30)] + [(30, prose(50, 1), "bad")] + [(31 + k, prose(50, k), "good") for k in range(60)] + [(99, prose(50, 3), "rare")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {*range(31, 91), 99}


def test_content():
    for page in content.LABELLED:
        body = page.split(content.START)[1].split(content.END)[0]
        expected = " ".join(re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] in content.INLINE else " ", body).split())
        assert content.main_text(page.replace(content.START, "").replace(content.END, "")) == expected
    page = "<nav><a>Menu</a></nav><article><h1>T</h1><p>A&amp;B &lt;x&gt; <b>c</b>d&nbsp;e<aside>Buy now cheap</aside> f<br>g<script>var t='</p>'</script></article><footer>z</footer><a hre"
    assert content.main_text(page) == "T A&B <x> cd e f g"
    assert content.main_text("") == "" and content.main_text("<p></p>") == ""


def every_region(scores):
    """The best run by trying all: highest sum, then first to end, then shortest; none if nothing is above zero."""
    runs = [(-round(sum(scores[i:j]), 9), j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = min(runs, default=(0, 0, 0))
    return (-best[2], best[1]) if best[0] < 0 else (0, 0)


def test_regions_equal_brute_force():
    r = random.Random(11)
    for _ in range(400):
        scores = [float(r.choice([-3, -2, -1, 1, 2, 3])) for _ in range(r.randint(0, 14))]
        assert content.best_region(scores) == every_region(scores)
    blocks = ["<p>{}</p>", "<div class='ad'>{}</div>", "<nav><a>{}</a></nav>", "<footer>{}</footer>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "{}<br>", "<script>{}</script>", "<form><input>{}</form>"]
    for k in range(120):
        page = "".join(r.choice(blocks).format(prose(r.randint(0, 6), 100 * k + n)) for n in range(r.randint(0, 7)))
        seen, scores = content.scored(page)
        begin, end = every_region(scores)
        mine = content.best_region(scores)
        assert abs(sum(scores[slice(*mine)]) - sum(scores[begin:end])) < 1e-9
        words = [w for what, kind, worth in seen[slice(*mine)] if not kind and worth > 0 for w in what.split()]
        assert content.main_text(page).split() == words


def test_equal_regions_and_long_pages():
    assert content.best_region([2.0, -5.0, 2.0]) == (0, 1) and content.best_region([1.0, -1.0, 1.0]) == (0, 1) and content.best_region([]) == (0, 0)
    page = "<article>" + "<p>some words of it &amp; more</p>" * 60_000 + "</article><footer>end</footer>"
    assert len(content.main_text(page)) == 60_000 * 24 - 1


def test_pages_of_the_given_table(spark):
    """Against the article element of the generated pages, which the operator doesn't look for by name."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r.text for r in content.extract(pages).collect()}
    with_article = [r for r in pages.collect() if r.html and "<article" in r.html]
    same = sum(bool(got[r.page_id]) and got[r.page_id].split()[:3] == " ".join(re.sub("<[^>]+>", " ", re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]).split()).split()[:3] for r in with_article)
    assert len(got) == pages.count() and same >= 0.9 * len(with_article)


def test_extract_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "<p>some words here</p>")], "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("text", F.lit(2))
    assert sorted((r.page_id, r.text, r.n_chars) for r in content.extract(pages).collect()) == [(1, "", 0), (1, "", 0), (2, "some words here", 15)]


def shingles_of(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(" ".join(words[k : k + similar.SHINGLE]) for k in range(max(1, len(words) - similar.SHINGLE + 1))) if words else frozenset()


def kept_by_brute_force(rows) -> Counter:
    """What one_of_each must keep of (doc_id, text) rows."""
    sets = [shingles_of(t) for _, t in rows]
    near = lambda a, b: a == b or bool(a and b) and len(a & b) >= 0.8 * math.sqrt(len(a) * len(b)) - 1e-9
    root, first = grouped(sets, near), {}
    for k, (i, _) in enumerate(rows):
        key = (i is None, i or 0, k)
        first[root[k]] = min(key, first.get(root[k], key))
    return Counter(rows[k] for _, _, k in first.values())


def near_texts(seed: int) -> list[str]:
    """Copies of a few texts, each with so many words changed that similarities spread over 0.5 to 1, and small and large texts that hold one another."""
    r, out = random.Random(seed), []
    for base in range(8):
        words = prose(90, 2000 + 100 * seed + base).split()
        for _ in range(12):
            changed = list(words)
            for at in r.sample(range(len(words)), r.randint(0, 6)):
                changed[at] = f"new{r.randint(0, 10**6)}"
            out.append(" ".join(changed))
        out += [" ".join(words[: 30 + 10 * base]), " ".join(words + prose(15 + 10 * base, base).split())]
    return out


@pytest.mark.parametrize("chunk", [4096, 4])
def test_one_of_each_equals_brute_force(spark, docs, plain, chunk, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rows = list(plain) + [(1000 + k, t) for k, t in enumerate(near_texts(1))] + [(1000, "another text under one id, not alike"), (None, None), (None, prose(50, 77)), (None, prose(50, 77))]
    got = Counter((r.doc_id, r.text) for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "node", "g", "k1", "size", "known")})).collect())
    expected = kept_by_brute_force(rows)
    assert got == expected


def test_texts_stay_where_they_are_in_near_dedup(spark, docs):
    """Whatever size the list of kept rows has, it goes to the texts and no text moves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = similar.one_of_each(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and out.count() < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1_600_000, 2])
def test_rows_among_marks(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MARKED", most)
    numbers = [0, 1, 62, 63, 64, 127, 128, 1000, (1 << 33) - 1, 1 << 33, (1 << 33) + 63, (5 << 33) + 7]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers] * 2 + [(None, "none")], "row long, text string")
    for chosen in ([], [63], numbers[::2], numbers):
        ids = spark.createDataFrame([(n,) for n in chosen + chosen[:1] + [None, 65]], "row long")
        assert Counter(tuple(r) for r in common.among(rows, ids, "row").collect()) == Counter((n, str(n)) for n in chosen * 2)


def test_similarity_of_just_enough(spark):
    """Shared 24 of 30 and 30 shingles is a cosine of 0.8 and a link; 23 is not."""
    base = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:28] + [f"x{k}" for k in range(6)])), (3, " ".join(base[6:] + ["y"] * 0 + [f"z{k}" for k in range(6)]))]
    sets = [shingles_of(t) for _, t in rows]
    assert len(sets[0] & sets[1]) == 24 and len(sets[0] & sets[2]) == 24 and len(sets[0]) == 30
    groups = spark.createDataFrame([(k, 7) for k in range(3)], "row long, g long")
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "row long, text string")
    _, links = similar.similar_links(frame, groups)
    assert {(r.node, r.root) for r in simhash.components(links).collect()} == {(1, 0), (2, 0)}
    _, links = similar.similar_links(frame.withColumn("text", F.replace("text", F.lit("w27"), F.lit("q"))).where("row < 2").union(frame.where("row = 1")).select("row", "text"), groups)
    assert simhash.components(links).where("node = 0").count() == 0


def test_hot_centers_of_components(spark):
    edges = [(k, 0) for k in range(1, 3000)] + [(5000 + k, 4000 + k) for k in range(50)] + [(4000 + k, 3999 + k) for k in range(50)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r for n, r in got if n < 3000} == {0} and {r for n, r in got if n > 3999} == {3999} and len(got) == 2999 + 50 + 49 + 1


OPERATORS = {
    "lm": lm.score_documents, "simhash": simhash.near_groups, "packing": packing.pack_documents, "tokens": tokens.count_tokens, "private": private.digest, "sanitised": private.sanitised,
    "passages": passages.passages, "quality": quality.judge, "keep_good": quality.keep_good, "one_of_each": similar.one_of_each,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_and_clashing_columns(docs, name):
    assert OPERATORS[name](docs.where("false")).count() == 0
    assert OPERATORS[name](docs).count() > 0


def test_empty_pages_and_benchmark(spark, docs):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge_urls(none, urls.rule_table(spark)).count() == 0 and content.extract(none).count() == 0
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = seen
        seen = corpus_pipeline.saved(stage(spark, seen, SMALL), f"test-{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert seen.columns == docs.columns and seen.schema == docs.schema, name
            assert seen.join(before, "doc_id", "left_anti").count() == 0
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in seen.collect())


def test_pipeline_of_odd_rows(spark, docs, monkeypatch):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, clashing columns; and no rows at all."""
    stages = corpus_pipeline.STAGES
    more = docs.withColumn("__n", F.lit(1))
    for given in (more, more.where("false")):
        seen = given
        for k, (_, stage) in enumerate(stages):
            before, seen = seen, corpus_pipeline.saved(stage(spark, seen, SMALL), f"odd-{k}")
            if k + 1 < len(stages):
                assert seen.columns == before.columns and seen.count() <= before.count()
        assert (seen.count() > 0) == (given.count() > 0)


def test_held_out_likelihood_is_better_than_base(spark):
    rows = [r for r in queries.op1_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
