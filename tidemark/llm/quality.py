"""Quality rules with host verdicts, in DataFrame expressions only.

Each document's whole text is measured once. Rule failures are summed by host; a host's failure rate is shrunk towards all
hosts by a beta prior fitted to their rates by moments (empirical Bayes); hosts beyond a threshold are rejected, and that
verdict is joined back. A document is kept if it fails no rule itself and its host is not rejected.

Contract: a null or blank text has no words and fails; a null host is a host of its own; repeated rows are judged each on
its own; an empty table gives an empty table; of other columns none is read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
HOST_THRESHOLD = 0.5
PRIOR_MOST = 1e6
#: Hosts up to this number, of at most HOST_CHARS characters each, are broadcast; beyond it they are joined by a shuffle.
BROADCAST_HOSTS = 50_000
HOST_CHARS = 300
WINDOW = 5


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside windows of five that occur twice or more. hashes: of each word."""
    indices = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    windows = F.transform(indices, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return windows


def covered(windows: Column) -> Column:
    """Length of the union of [i, i + 5) over the windows i whose hash stands more than once in the list."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  value is computed once

    def repeated(ranked: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(ranked, j)["h"] == s["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ranked, lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"]))

    def union(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])

    return bound(bound(ranked, repeated), union)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column `m`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*names, F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "").alias("__words"))
    step = step.select(*names, F.size("__words").alias("__n"), F.length(F.array_join("__words", "")).cast("long").alias("__chars"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    step = step.select(*names, "__n", "__chars", repeat_words(F.col("__h"), F.col("__n")).alias("__w"))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(*names, "__n", "__chars", "__w", lines.alias("__lines"))
    repeats = F.when(F.size("__w") > F.size(F.array_distinct("__w")), covered(F.col("__w"))).otherwise(0)
    return step.select(
        *names,
        F.struct(
            F.col("__n").cast("long").alias("n_words"),
            F.col("__chars").alias("word_chars"),
            F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            repeats.cast("long").alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
        ).alias("m"),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rule_failed(m: Column) -> Column:
    """Any rule: the base ones, too many symbols for the words, too many repeated lines."""
    return base_failed(m) | (100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * m["n_words"]) | (100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * m["n_lines"])


def host_rates(failures: DataFrame) -> DataFrame:
    """failures: (host, failed). A row per host: n, failed, rate (shrunk), rejected."""
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    total = hosts.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares"))
    mean = F.col("all_f") / F.col("all_n")
    spread = F.col("squares") / F.col("all_n") - mean * mean
    strength = F.when(spread > 1e-12, F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(1.0), mean * (1 - mean) / spread - 1))).otherwise(F.lit(PRIOR_MOST))
    # The totals are one row, which the driver reads and writes into the plan as numbers.
    known = total.select(mean.alias("mean"), strength.alias("strength")).first()
    mean, strength = (F.lit(float(x if x is not None else 0.0)) for x in known)
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "f", rate.alias("rate"), (rate > HOST_THRESHOLD).alias("rejected"))


def host_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_host_verdict(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """rows (with a column `host`) and `host_rejected`."""
    bad = saved(host_rates(failures).where("rejected").select("host", F.lit(True).alias("bad")), "hosts")
    size = bad.agg(F.count("*").alias("n"), F.max(F.length("host")).alias("chars")).first()
    small = size["n"] <= BROADCAST_HOSTS and (size["chars"] or 0) <= HOST_CHARS
    return rows.join(F.broadcast(bad) if small else bad, "host", "left").withColumn("host_rejected", F.coalesce("bad", F.lit(False))).drop("bad")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The verdict on every document, with its measures."""
    rows = measured(docs.select("doc_id", "text", host_of(host).alias("host")))
    m = F.col("m")
    rows = saved(rows.select("doc_id", "host", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"), rule_failed(m).alias("failed")), "quality")
    out = with_host_verdict(rows, rows.select("host", "failed"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("failed") & ~F.col("host_rejected")).alias("kept"), F.col("failed").alias("rule_failed"), "host_rejected")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs without those that are rejected; all columns stay. Texts are measured once: rows are written with their host and verdict."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"), host_of(host).alias("host"))
    rows = saved(measured(rows).select("row", "host", rule_failed(F.col("m")).alias("failed")), "judged")
    kept = with_host_verdict(rows.where(~F.col("failed")), rows.select("host", "failed"))
    return kept.where(~F.col("host_rejected")).select(*[F.col("row")[c].alias(c) for c in columns])


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w),
h AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM h) WHERE c > 1),
rw AS (SELECT r, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM d) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT s) AS u FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM w) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines
    FROM w LEFT JOIN rw ON rw.r = w.r LEFT JOIN l ON l.r = w.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM m),
hs AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE failed)::DOUBLE AS bad FROM f GROUP BY host),
p AS (SELECT sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS spread FROM hs),
q AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS s FROM p),
v AS (SELECT host, (bad + mean * s) / (n + s) > 0.5 AS rejected FROM hs, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, NOT failed AND NOT rejected AS kept, failed AS rule_failed, rejected AS host_rejected FROM f JOIN v USING (host)
"""
