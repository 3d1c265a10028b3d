"""Column functions for names and numbers as people read them, and for text that other programs parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import menu_label

# Names of languages, and the five characters that markup must not hold, the ampersand first.
LANGUAGES = {"ar": "Arabic", "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "tr": "Turkish", "fa": "Persian", "ru": "Russian", "hi": "Hindi", "ur": "Urdu", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "sv": "Swedish"}
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def language_name(code: Column) -> Column:
    """The English name, or the code itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), code), code)


def result_label(translated: Column, source_language: Column, provider: Column, confidence: Column) -> Column:
    head = F.when(translated, F.concat(F.lit("AI "), language_name(F.coalesce(source_language, F.lit(""))))).otherwise(provider)
    return menu_label(head, F.concat(F.lit(" "), confidence.cast("string"), F.lit("%")))


def retry_label(language: Column, attempt: Column) -> Column:
    return menu_label(language_name(language), F.when(attempt > 1, F.concat(F.lit(" - Next "), attempt.cast("string"))).otherwise(" - Next"))


def fixed(x: Column) -> Column:
    """With one place after the point, halves up."""
    return F.format_string("%.1f", F.floor(x.cast("double") * 10 + 0.5) / 10)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(ms < 60_000, F.concat(fixed(ms / 1000), F.lit(" s"))).otherwise(F.concat(fixed(ms / 60_000), F.lit(" min")))


def size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(fixed(n / 1024), F.lit(" KB"))).otherwise(F.concat(fixed(n / (1 << 20)), F.lit(" MB")))


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def safe_headers(headers: Column) -> Column:
    """A map of header lines as one text; entries that hold a line break are dropped, and null is what remains of none."""
    good = F.map_filter(headers, lambda k, v: ~(F.concat(k, v).rlike(r"[\r\n]")))
    lines = F.transform(F.map_entries(good), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n")))
    return F.nullif(F.array_join(lines, ""), F.lit(""))


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """What a server asks to wait: seconds, or a date less the time now; null where it says neither."""
    seconds = header.try_cast("double")
    date = F.unix_millis(F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(seconds >= 0, (seconds * 1000).cast("long")).when(seconds.isNull() & date.isNotNull(), F.greatest(F.lit(0), date - now_ms))


def request_parts(kind: Column, ident: Column, extra: Column) -> Column:
    """struct(kind, content_id, imdb_id, season, episode, video_hash, video_size, filename) of a request's path and query; what can't be decoded is taken as it is."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    series, whole = kind == "series", decode(ident)
    parts = F.split(whole, ":")
    number = lambda k: F.when(series, F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?\d+)", 1).try_cast("int"))
    given = F.str_to_map(F.coalesce(decode(extra), F.lit("")), F.lit("&"), F.lit("="))
    value = lambda name: F.nullif(decode(F.try_element_at(given, F.lit(name))), F.lit(""))
    return F.struct(
        F.when(series, "series").otherwise("movie").alias("kind"), whole.alias("content_id"), F.when(F.get(parts, F.lit(0)).startswith("tt"), F.get(parts, F.lit(0))).alias("imdb_id"), number(1).alias("season"), number(2).alias("episode"),
        value("videoHash").alias("video_hash"), F.regexp_extract(value("videoSize"), r"^\s*([+-]?\d+)", 1).try_cast("long").alias("video_size"), value("filename").alias("filename"))
