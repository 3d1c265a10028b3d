"""Column functions for keys, settings, labels, and answers of services."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Status codes and messages of faults that pass, prefixes of translated variants, the width of a menu label.
PASSING_STATUS = [408, 425, 429, 500, 502, 503, 504]
PASSING_MESSAGE = r"(?i)AbortError|TimeoutError|ECONNRESET|ETIMEDOUT|EAI_AGAIN|ENOTFOUND|fetch failed|socket hang up|timed?\s*out|\b(408|425|429|500|502|503|504)\b"
VARIANT_PREFIX = "^(translated|gemini):"
LABEL_WIDTH = 18


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form. Spark has no function for it, so texts that it can change leave the JVM, and only these: for others a null travels."""
    return F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the JSON list of string parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def source_variant(variant: Column) -> Column:
    return F.regexp_replace(variant, VARIANT_PREFIX, "")


def stream_fingerprint(video_hash: Column, filename: Column, size: Column, url: Column) -> Column:
    """The video's hash, else name and size, else a hash of the address."""
    given = lambda c: F.when(c != "", c)
    named = F.concat(given(filename), F.lit(":"), F.coalesce(F.when(size != 0, size.cast("string")), F.lit("")))
    return F.coalesce(given(video_hash), named, F.sha2(F.to_json(F.array(url)).substr(F.lit(2), F.length(F.to_json(F.array(url))) - 2), 256))


def number_setting(value: Column, default: float, least: float, most: float) -> Column:
    """The leading number of a setting within bounds; the default where there is none."""
    leading = F.regexp_extract(value, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")
    return F.coalesce(F.least(F.lit(most), F.greatest(F.lit(least), leading)), F.lit(default))


def list_setting(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def menu_label(head: Column, suffix: Column) -> Column:
    """At most LABEL_WIDTH characters, the suffix whole."""
    room = F.greatest(F.lit(0), LABEL_WIDTH - F.length(suffix))
    return F.concat(F.rtrim(F.substring(head, F.lit(1), room)), suffix)


def passes(status: Column, message: Column) -> Column:
    """Whether a fault is worth another try: by its status, or by its message where it has none."""
    return F.when(status.isNotNull(), status.isin(PASSING_STATUS)).otherwise(F.coalesce(message.rlike(PASSING_MESSAGE), F.lit(False)))


def damage(text: Column) -> Column:
    """Share of replacement characters."""
    return F.regexp_count(text, F.lit("�")) / F.greatest(F.lit(1), F.length(text))


def decoding_score(text: Column, language: Column) -> Column:
    """Damage, and for Arabic a penalty for letters of other scripts."""
    letters, arabic = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{IsArabic}"))
    return damage(text) + F.when((language == "ar") & (letters >= 10), (1 - arabic / letters) * 0.25).otherwise(0.0)
