"""Timed-text files as they come: archives, byte encodings, ASS and WebVTT, each turned into SRT text."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..operators.text import language

# Size limits in bytes, extensions, encodings in the order in which they are tried.
MOST_ARCHIVE, MOST_FILE = 15 << 20, 5 << 20
EXTENSIONS = ("srt", "vtt", "ass", "ssa")
JUNK, SAMPLE = r"(?:^|/)(?:__MACOSX/|\._)", r"(?i)\b(?:sample|trailer|preview)\b"
EPISODE = r"(?i)(?:s\d{1,3}e|e|episode[ ._-]*)0?{episode}(?:\D|$)"
LANGUAGE_NAMES = {"ar": ["ar", "ara", "arabic", "العربية"], "en": ["en", "eng", "english"], "ja": ["ja", "jpn", "japanese"], "fr": ["fr", "fra", "fre", "french"], "es": ["es", "spa", "spanish"]}
ENCODINGS = ("cp1256", "cp1252", "iso8859_6", "utf-8")


def unpack(files: DataFrame) -> DataFrame:
    """files (file_id, name, content) to (file_id, ordinal, name, content): the entries of zip archives, other files as they are. Files beyond the size limit, and archives that can't be read, give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file_id, name, content in rows.itertuples(index=False, name=None):
                if content is None or len(content) > MOST_ARCHIVE:
                    continue
                if bytes(content[:2]) != b"PK":
                    out.append((file_id, 1, name, bytes(content)))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        out += [(file_id, k, e.filename, archive.read(e)) for k, e in enumerate(archive.infolist(), 1) if not e.is_dir() and e.file_size <= MOST_FILE]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["file_id", "ordinal", "name", "content"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "name", "content").mapInPandas(run, f"file_id {kind}, ordinal int, name string, content binary")


def names_language(name: Column, language: Column) -> Column:
    """Whether a file name has one of a language's names as a word of its own."""
    markers = F.create_map(*[F.lit(x) for k, v in LANGUAGE_NAMES.items() for x in (k, "|".join(v))])
    pattern = F.concat(F.lit(r"(?iu)(?:^|[^\p{L}\p{N}])(?:"), F.coalesce(F.try_element_at(markers, language), F.concat(F.lit(r"\Q"), F.replace(language, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))), F.lit(r")(?:$|[^\p{L}\p{N}])"))
    return F.coalesce(F.regexp_like(name, pattern), F.lit(False))


def choose_file(entries: DataFrame) -> DataFrame:
    """One entry (file_id, ordinal, name, bytes, the wanted episode's number and the language, which may be null) per archive: those that name the episode if any do, of these those that name the language if any do, full ones before samples, then the largest, then the first."""
    good = entries.where(F.col("name").rlike(rf"(?i)\.(?:{'|'.join(EXTENSIONS)})$") & ~F.col("name").rlike(JUNK) & (F.col("bytes") <= MOST_FILE))
    marker = F.replace(F.lit(EPISODE), F.lit("{episode}"), F.col("episode").cast("string"))
    tests = [F.coalesce(F.regexp_like("name", marker), F.lit(False)), names_language(F.col("name"), language(F.col("language"))), ~F.col("name").rlike(SAMPLE)]
    group = Window.partitionBy("file_id")
    for test in tests:
        told = good.withColumn("fits", test)
        good = told.withColumn("any", F.max("fits").over(group)).where(F.col("fits") | ~F.col("any")).drop("fits", "any")
    order = group.orderBy(F.desc("bytes"), "ordinal")
    return good.withColumn("n", F.row_number().over(order)).where("n = 1").select("file_id", "ordinal", "name", "bytes")


def damage_of(text: str, arabic: bool) -> float:
    """As functions.values.decoding_score: the share of replacement characters, and for Arabic the letters of other scripts."""
    letters = [c for c in text if c.isalpha()] if arabic else []
    own = sum("ARABIC" in unicodedata.name(c, "") for c in letters)
    return text.count("\ufffd") / max(1, len(text)) + ((1 - own / len(letters)) * 0.25 if len(letters) >= 10 else 0.0)


def likely_encoding(data: bytes) -> str:
    """UTF-16 by its mark or its zero bytes, UTF-8 if it is valid; else the code page under which no word mixes Latin and Arabic letters."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    head = data[:4096]
    for name, zeros in (("utf-16-le", head[1::2]), ("utf-16-be", head[0::2])):
        if len(zeros) > 3 and zeros.count(0) > 0.4 * len(zeros):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        mixed = re.search("[A-Za-z][\u0600-\u06ff]|[\u0600-\u06ff][A-Za-z]", data.decode("cp1256", "replace"))
        return "cp1252" if mixed else "cp1256"


@F.pandas_udf(StringType())
def decoded(content: pd.Series, language: pd.Series) -> pd.Series:
    """Text of bytes: by the likely encoding, unless another one does less damage."""

    def one(data, tag):
        if data is None:
            return None
        arabic = (tag or "").lower()[:2] == "ar"
        first = likely_encoding(data)
        tried = [data.decode(e, "replace") for e in (first, *(e for e in ENCODINGS if e != first))]
        return min(tried, key=lambda t: damage_of(t, arabic)).removeprefix("\ufeff")

    return pd.Series([one(d, t) for d, t in zip(content, language)])


def vtt_to_srt(content: Column) -> Column:
    """Header and cue settings go; points in times become commas; blocks without a time go."""
    body = F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"^\s*WEBVTT[^\n]*\n", "")
    blocks = F.filter(F.split(body, r"\n{2,}"), lambda b: b.contains("-->"))
    time = r"(?:(\d{1,3}):)?(\d{2}):(\d{2})\.(\d{3})"
    whole = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(F.regexp_replace(b, time, "$1:$2:$3,$4"), r"(?m)(^|> ):", "$100:"), r"(-->\s*[\d:,]+)[^\n]*", "$1"))
    return F.concat(F.array_join(F.transform(whole, lambda b, i: F.concat((i + 1).cast("string"), F.lit("\n"), F.regexp_replace(b, r"^(?s:.*?)(?=\S*\s*-->)", ""))), "\n\n"), F.lit("\n"))


def ass_to_srt(content: Column) -> Column:
    """The Format line names the columns; text keeps its commas; override tags go and line breaks are kept."""
    lines = F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n")
    names = F.transform(F.split(F.regexp_replace(F.element_at(F.filter(lines, lambda x: x.rlike(r"^Format:.*\bText\b")), 1), r"^Format:\s*", ""), ","), lambda x: F.lower(F.trim(x)))
    said = F.filter(lines, lambda x: x.startswith("Dialogue:"))
    at = lambda name: F.array_position(names, name).cast("int") - 1
    time = lambda x: F.concat(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(\d):", "0$1:"), r"\.(\d\d)$", ",$10"))

    def block(line: Column, i: Column) -> Column:
        parts = F.split(F.regexp_replace(line, r"^Dialogue:\s*", ""), ",", -1)
        text = F.array_join(F.slice(parts, F.size(names), F.size(parts)), ",")
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", "\n"), r"\\h", " ")
        return F.concat((i + 1).cast("string"), F.lit("\n"), time(F.get(parts, at("start"))), F.lit(" --> "), time(F.get(parts, at("end"))), F.lit("\n"), text)

    return F.concat(F.array_join(F.transform(said, block), "\n\n"), F.lit("\n"))
