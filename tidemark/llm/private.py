"""PII by information-theoretic sanitisation, in DataFrame expressions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities, each also as a member of a
larger one (the mail domain, the network, the card's issuer, the phone's area). Other words can reveal an entity as well. How
strongly is estimated from co-occurrence in whole documents of the corpus: a word discloses the share
log(P(e | word) / P(e)) / log(1 / P(e)) of what is to be known about e, all probabilities over documents (pointwise mutual
information over self-information). It must stand beside e in MIN_SUPPORT documents at least whose mentions of e have
different surroundings, and in different ones in MIN_VARIED of them (so not in copies of one text, even edited ones).

Words that disclose DISCLOSURE or more are spans of kind "term", in op7_private_data and the pipeline wherever they stand:
a word that names e beside its address names it elsewhere as well. (sanitised() alone keeps to the documents that mention e
unless it is told `everywhere`.) Where a word touches another span, what stands outside that span counts. In texts they are
generalised: cut to their longest beginning, of MIN_PREFIX letters or more, that discloses less (all words with that
beginning counted as one), marked by an asterisk; if there is none they are removed. Entities always give way to their kind.

Counts stay small: entities of fewer than MIN_SUPPORT documents can't reach it and are left out; words of fewer documents
with such entities, and pairs whose share among these alone is too small already, go before pairs are made, and then only the
words that are left are counted in the corpus. A document's entities and words stand in one row, so pairs need no join.

Patterns are written with possessive groups, which Java matches without recursion or going back, so very long texts need
no stack; the results are those of the plain patterns.

Contract: a null text is an empty one, without spans; positions are code points; repeated rows are treated each on its own
and count each as a document; null ids stay null; an empty table gives an empty table; other columns stay unread or, where
documents are returned, unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern's accepted matches to be possible; most texts hold none of it.
NEEDS = {"ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]"}
SPANS = "array<struct<start:bigint,no:int,kind:string,end:bigint,value:string>>"
AROUND_CHARS = 160
TERM, NOT_TERM = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
MIN_SUPPORT, MIN_VARIED, MIN_PREFIX = 3, 0.5, 2
DISCLOSURE = 0.8
#: Terms, and prefixes, that are broadcast: at most so many, of at most TERM_CHARS characters each; beyond it they are joined by a shuffle.
BROADCAST_TERMS, TERM_CHARS = 200_000, 100
BLOCK = 64


def accepted(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "card":
        at = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + at(i) - F.when(at(i) > 9, 9).otherwise(0))
        return F.when(F.length(digits).between(14, 19), luhn % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def running(values: Column, add, zero: Column) -> Column:
    """add() of each value of an array and all before it; in blocks, so that a long array isn't copied for each value."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
    heads = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(add(F.element_at(a, -1), x))))
    inner = lambda b, h: F.transform(b, lambda _, i: F.aggregate(F.slice(b, F.lit(1), i + 1), h, add))
    return F.when(n > 0, F.flatten(F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), inner))).otherwise(F.array().cast("array<bigint>"))


def located(text: Column, number: int) -> Column:
    """The accepted matches of one pattern with their places: the lengths of what stands between matches, and of matches, add up."""
    kind = KINDS[number]
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.length(p).cast("long"))
    none = F.array().cast(SPANS)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: g + F.length(m))
    ends = running(steps, lambda a, x: a + x, F.lit(0).cast("long"))
    span = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(number).alias("no"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"))
    spans = F.filter(F.zip_with(found, ends, span), lambda s: accepted(kind, s["value"]))
    there = text.rlike(NEEDS[kind]) if kind in NEEDS else F.contains(text, F.lit("@" if kind == "email" else "+"))
    return F.when(there, spans.cast(SPANS)).otherwise(none)


def base_spans(text: str) -> Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.array_sort(F.concat(*[located(whole, k) for k in range(len(KINDS))]))


def terms_in(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty string may stand at either end."""
    return F.split(F.lower(text), NOT_TERM)


def found_in(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """(uid, base, row): written once; row holds the given columns of every document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), base_spans(text).alias("base"))
    return saved(rows.select(F.monotonically_increasing_id().alias("uid"), "base", "row"), "private")


def entities_of(span: Column) -> Column:
    """The names of what a span mentions: itself, and the larger entity that it belongs to."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = F.regexp_replace(value, "[^0-9]+", "")
    domain = F.concat(F.lit("domain:"), F.regexp_extract(value, "@(.*)", 1))
    network = F.concat(F.lit("network:"), F.regexp_extract(value, r"^(.*)\.[0-9]+$", 1))
    number = lambda name, n: F.array(F.concat(kind, F.lit(":"), digits), F.concat(F.lit(name), F.substring(digits, 1, n)))
    own = F.concat(kind, F.lit(":"), value)
    return F.when(kind == "email", F.array(own, domain)).when(kind == "ip", F.array(own, network)).when(kind == "card", number("issuer:", 6)).otherwise(number("area:", 6))


def mentions(found: DataFrame, text: str = "text") -> DataFrame:
    """(uid, entity, around): the entities of each document; around tells what stands about the first mention: the outermost whole words within AROUND_CHARS."""
    each = found.where(F.size("base") > 0).select("uid", F.col("row")[text].alias("t"), F.explode("base").alias("s"))
    start, end = F.col("s.start").cast("int"), F.col("s.end").cast("int")
    before = F.substring("t", F.greatest(F.lit(0), start - AROUND_CHARS) + 1, F.least(start, F.lit(AROUND_CHARS)))
    after = F.substring("t", end + 1, F.lit(AROUND_CHARS))
    words = lambda part: F.array_remove(terms_in(part), "")
    # The outermost piece on either side may be a cut-off word, so the next one is taken.
    around = F.xxhash64(F.coalesce(F.get(words(before), F.lit(1)), F.lit("")), F.coalesce(F.get(F.reverse(words(after)), F.lit(1)), F.lit("")))
    named = each.select("uid", "s.start", around.alias("around"), F.explode(entities_of(F.col("s"))).alias("entity"))
    return named.groupBy("uid", "entity").agg(F.min_by("around", F.struct("start", "around")).alias("around"))


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its spans, so that places stay."""
    return redacted(text, F.transform(spans, lambda s: s.withField("kind", F.lit("term")).withField("value", F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))))


def terms_outside(text: Column, spans: Column) -> Column:
    """The distinct words of a text without what its spans cover, sorted."""
    return F.sort_array(F.array_remove(F.array_distinct(terms_in(F.when(F.size(spans) == 0, text).otherwise(masked(text, spans)))), ""))


def disclosed(both: Column, df: Column, n: Column, total: int) -> Column:
    return F.log(F.least(F.lit(1.0), both / df) * total / n) / F.log(F.lit(float(total)) / n)


def light(df: DataFrame, column: str) -> DataFrame:
    """df for a join by a column of words: broadcast, if it is small enough."""
    size = df.agg(F.count("*").alias("n"), F.max(F.length(column)).alias("chars")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_TERMS and (size["chars"] or 0) <= TERM_CHARS else df


def most_documents(n: Column, total: int) -> Column:
    """In how many documents a term may stand at most to disclose DISCLOSURE of an entity of n documents, with one beyond for rounding."""
    return n * F.pow(F.lit(float(total)) / n, F.lit(1 - DISCLOSURE)) + 1


def beginnings(words: Column, most: int, rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, word, after, n): the sorted words of each row, cut to `most` letters, and how many of these the word before begins with as well; n: in how many rows. A beginning is counted with the words of which it is longer than that, so once in a row."""
    n = F.size(words)
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))
    cut = lambda c: F.substring(c, 1, most)
    each = rows.select(*keep, F.explode(F.arrays_zip(words.alias("word"), before.alias("before"))).alias("w")).where("w.word is not null")
    each = each.select(*keep, cut("w.word").alias("word"), cut("w.before").alias("before")).where((F.length("word") >= MIN_PREFIX) & (F.col("word") != F.col("before")))
    same = lambda k: F.substring(F.col("word"), F.lit(1), k) == F.substring(F.col("before"), F.lit(1), k)
    shared = F.when(same(F.lit(MIN_PREFIX)), F.size(F.filter(F.sequence(F.lit(MIN_PREFIX), F.least(F.length("word"), F.length("before"))), same)) + MIN_PREFIX - 1).otherwise(MIN_PREFIX - 1)
    return each.select(*keep, "word", shared.alias("after")).groupBy(*keep, "word", "after").agg(F.count("*").alias("n"))


def counted(of: DataFrame, wanted: DataFrame, name: str, *keep: str) -> DataFrame:
    """(*keep, prefix, name): in how many rows a word has one of the wanted beginnings (*keep, prefix; distinct). of: as beginnings() gives it; its rows are words of the corpus, not of documents."""
    each = of.where(F.length("word") > F.col("after")).select(*keep, "word", "n", F.explode(F.sequence(F.col("after") + 1, F.length("word"))).alias("size"))
    each = each.select(*keep, F.substring(F.col("word"), F.lit(1), F.col("size")).alias("prefix"), "n").groupBy(*keep, "prefix").agg(F.sum("n").alias(name))
    # No left_semi: Spark would carry it out on the words, before they are summed up.
    return each.join(wanted, [*keep, "prefix"])


def revealing(found: DataFrame, said: DataFrame, text: str = "text") -> DataFrame | None:
    """(entity, term, put): the terms that disclose too much, and what takes their place; None if there are none. said: the mentions of found, saved."""
    of = said.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("around").alias("varied")).where((F.col("varied") >= MIN_SUPPORT) & (F.col("varied") >= MIN_VARIED * MIN_SUPPORT))
    total = found.count()
    of = saved(of.where(F.col("n") < total).select("entity", "n"), "entities")
    if of.isEmpty():
        return None
    # The entities and words of a document stand in one row, so that pairs of them are made in place.
    ents = said.join(light(of, "entity"), "entity").groupBy("uid").agg(F.collect_list(F.struct("entity", "n", "around")).alias("ents"))
    own = found.where(F.size("base") > 0).select("uid", terms_outside(F.col("row")[text], F.col("base")).alias("terms"))
    told = saved(own.join(ents, "uid").select("ents", "terms"), "told")
    # A term's documents among these alone tell which pairs can't reach DISCLOSURE, before any pair is made.
    most = of.agg(F.max(most_documents(F.col("n"), total))).first()[0]
    within = told.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least_df"))
    within = saved(within.where((F.col("least_df") >= MIN_SUPPORT) & (F.col("least_df") <= most)), "private-within")
    pairs = told.select("ents", F.explode("terms").alias("term")).join(light(within, "term"), "term").select("term", "least_df", F.explode("ents").alias("e"))
    pairs = pairs.select("e.entity", "term", "e.around", "e.n", "least_df").where(F.col("least_df") <= most_documents(F.col("n"), total))
    near = pairs.groupBy("entity", "term", "around").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("least_df").alias("least_df"))
    near = near.groupBy("entity", "term").agg(F.sum("k").alias("both"), F.count("*").alias("support"), F.first("n").alias("n"), F.first("least_df").alias("least_df"))
    near = near.where((F.col("support") >= MIN_SUPPORT) & (F.col("support") >= MIN_VARIED * F.col("both")))
    near = saved(near.where(disclosed(F.col("both"), F.col("least_df"), F.col("n"), total) >= DISCLOSURE).select("entity", "term", "both", "n"), "private-near")
    if near.isEmpty():
        return None
    whole = found.select(F.sort_array(F.array_distinct(terms_in(F.coalesce(F.col("row")[text], F.lit(""))))).alias("words"))
    df = whole.select(F.explode("words").alias("term")).join(light(near.select("term").distinct(), "term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    out = near.join(df, "term").select("entity", "term", "n", disclosed(F.col("both"), F.col("df"), F.col("n"), total).alias("disclosure"))
    out = saved(out.where(F.col("disclosure") >= DISCLOSURE), "private-revealing")
    if out.isEmpty():
        return None
    # Beginnings of the terms, each with the documents that hold a word that begins so.
    sizes = F.sequence(F.lit(MIN_PREFIX), F.length("term") - 1)
    tried = out.where(F.length("term") > MIN_PREFIX).select("entity", "term", "n", F.explode(sizes).alias("size")).withColumn("prefix", F.substring(F.col("term"), F.lit(1), F.col("size")))
    longest = tried.agg(F.max("size")).first()[0] or MIN_PREFIX
    df = counted(beginnings(F.col("words"), longest, whole), light(tried.select("prefix").distinct(), "prefix"), "df")
    # Of an entity's documents only the words count that begin like one of its terms; they stay in order.
    asked = light(tried.groupBy("entity").agg(F.collect_set(F.substring("prefix", 1, MIN_PREFIX)).alias("heads")), "entity")
    inside = told.select("terms", F.explode("ents.entity").alias("entity")).join(asked, "entity")
    inside = inside.select("entity", F.filter("terms", lambda w: F.array_contains("heads", F.substring(w, 1, MIN_PREFIX))).alias("terms"))
    both = counted(beginnings(F.col("terms"), longest, inside, "entity"), tried.select("entity", "prefix").distinct(), "both", "entity")
    fits = tried.join(df, "prefix").join(both, ["entity", "prefix"]).where(disclosed(F.col("both"), F.col("df"), F.col("n"), total) < DISCLOSURE)
    longest = fits.groupBy("entity", "term").agg(F.max("size").alias("size"))
    put = F.coalesce(F.concat(F.substring(F.col("term"), F.lit(1), F.col("size")), F.lit("*")), F.lit(""))
    return saved(out.join(longest, ["entity", "term"], "left").select("entity", "term", put.alias("put")), "private-terms")


def term_spans(found: DataFrame, said: DataFrame, reveal: DataFrame, text: str = "text", everywhere: bool = True) -> DataFrame:
    """(uid, base, row, spans): the places of the words that reveal an entity, in all documents or in those that mention it, join the base spans; a span's value is what takes its place, the shortest of what its entities ask for."""
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    words = found.select("uid", F.explode(terms_outside(whole, F.col("base"))).alias("term"))
    shortest = F.min_by("put", F.struct(F.length("put"), "put")).alias("put")
    if everywhere:
        wanted = words.join(light(reveal.groupBy("term").agg(shortest), "term"), "term")
    else:
        wanted = words.join(light(reveal, "term"), "term").join(said.select("uid", "entity"), ["uid", "entity"]).groupBy("uid", "term").agg(shortest)
    wanted = wanted.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("term", "put"))).alias("put"))
    here = found.join(wanted, "uid", "left")
    blank = masked(whole, F.col("base"))
    pieces = F.arrays_zip(F.regexp_extract_all(blank, F.lit(TERM), F.lit(0)).alias("w"), F.transform(F.split(blank, TERM, -1), lambda p: F.length(p).cast("long")).alias("gap"))
    span = lambda w, end: F.struct((end - F.length(w)).alias("start"), F.lit(len(KINDS)).alias("no"), F.lit("term").alias("kind"), end.alias("end"), F.element_at("put", F.lower(w)).alias("value"))

    def onward(a: Column, x: Column) -> Column:
        """One pass over the words and the gaps before them: where the text stands, and the spans so far."""
        end = a["end"] + x["gap"] + F.coalesce(F.length(x["w"]), F.lit(0))
        is_hit = F.coalesce(F.map_contains_key("put", F.lower(F.coalesce(x["w"], F.lit("")))), F.lit(False))
        return F.struct(end.alias("end"), F.when(is_hit, F.concat(a["hit"], F.array(span(x["w"], end)).cast(SPANS))).otherwise(a["hit"]).alias("hit"))

    hit = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(SPANS).alias("hit")), onward, lambda a: a["hit"])
    return here.select("uid", "base", "row", F.when(F.col("put").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", hit))).alias("spans"))


def all_spans(docs: DataFrame, columns: list[str], text: str = "text", everywhere: bool = True) -> DataFrame:
    """(uid, base, row, spans): spans are the base ones and those of terms."""
    found = found_in(docs, columns, text)
    said = saved(mentions(found, text), "mentions")
    reveal = revealing(found, said, text)
    return found.withColumn("spans", F.col("base")) if reveal is None else term_spans(found, said, reveal, text, everywhere)


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    rows = all_spans(docs, ["doc_id", "text"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return rows.select("row.doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced; spans that overlap are replaced by the first one's placeholder. The parts between are joined once."""
    past = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
    before = F.concat(F.array(F.lit(0).cast("long")), past)

    def part(s: Column, at: Column) -> Column:
        put = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.when(s["start"] >= at, F.concat(F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int")), put)).otherwise("")

    parts = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), part)
    return F.concat(F.array_join(parts, ""), F.substring(text, (F.element_at(before, -1) + 1).cast("int"), F.length(text)))


def sanitised(docs: DataFrame, text: str = "text", size: str | None = None, everywhere: bool = False) -> DataFrame:
    """docs with their texts redacted; rows and columns stay. size: a column of text lengths to bring up to date; everywhere: revealing words go from documents that don't mention their entity, too."""
    names = docs.columns
    found = all_spans(docs, names, text, everywhere)
    hit = F.size("spans") > 0
    found = found.select("row", hit.alias("hit"), F.when(hit, redacted(F.col("row")[text], F.col("spans"))).otherwise(F.col("row")[text]).alias("clean"))
    new = {text: F.col("clean")} | ({size: F.when(F.col("hit"), F.length("clean")).otherwise(F.col("row")[size]).cast(docs.schema[size].dataType)} if size in names else {})
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
