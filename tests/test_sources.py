"""Formats, catalogue answers, batches and the streaming twin."""

import io
import json
import zipfile

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.operators import batches, state, text
from tidemark.plans import dialect, registry
from tidemark.sources import catalogues, formats
from tidemark.streaming import limits


def test_ass_and_vtt(spark):
    ass = "[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.50,0:00:03.00,Main,{\\i1}Hello, there{\\i0}\\Nyou\n"
    vtt = "WEBVTT x\n\nid1\n00:01.000 --> 00:02.500 align:start\nHi\n\nNOTE no\n\n01:00:03.000 --> 01:00:04.000\nyou\n"
    df = spark.createDataFrame([(1, ass, vtt)], "track_id int, a string, v string")
    got = df.select("track_id", formats.ass_to_srt(F.col("a")).alias("content"))
    assert [(r.start_ms, r.end_ms, r.text) for r in text.parse_srt(got).collect()] == [(1500, 3000, "Hello, there\nyou")]
    got = df.select("track_id", formats.vtt_to_srt(F.col("v")).alias("content"))
    assert [(r.start_ms, r.end_ms, r.text) for r in text.parse_srt(got).orderBy("id").collect()] == [(1000, 2500, "Hi"), (3603000, 3604000, "you")]


def test_archives_and_encodings(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, size in (("__MACOSX/._a.e02.srt", 900), ("show.e01.srt", 50), ("show.e02.srt", 30), ("show.e02.sample.srt", 70), ("x.nfo", 10)):
            z.writestr(name, "x" * size)
    files = spark.createDataFrame([(1, "a.zip", bytearray(data.getvalue())), (2, "b.srt", bytearray("مرحبا".encode("cp1256"))), (3, "c.zip", bytearray(b"PKbroken")), (4, "d", None)], "file_id int, name string, content binary")
    entries = formats.unpack(files)
    chosen = formats.choose_file(entries.select("file_id", "ordinal", "name", F.length("content").alias("bytes"), F.lit(2).alias("episode"), F.lit(None).cast("string").alias("language")))
    assert sorted((r.file_id, r.name) for r in chosen.collect()) == [(1, "show.e02.srt"), (2, "b.srt")]
    assert entries.where("file_id = 2").select(formats.decoded("content", F.lit("ar")).alias("t")).first().t == "مرحبا"


@pytest.mark.parametrize(("text", "encoding", "language"), [("El niño mañana", "cp1252", "es"), ("مرحبا يا صديقي العزيز", "cp1256", "ar"), ("مرحبا يا صديقي العزيز", "iso8859_6", "ar"), ("plain", "utf-16", "en"), ("plain text", "utf-16-le", "en"), ("naïve café", "utf-8", "fr"), ("", "utf-8", None)])
def test_encodings(spark, text, encoding, language):
    df = spark.createDataFrame([(bytearray(text.encode(encoding)), language)], "content binary, language string")
    assert df.select(formats.decoded("content", "language").alias("t")).first().t == text


def test_files_are_chosen_by_episode_then_language(spark):
    names = ["Scene1.s01e02.srt", "Scene1.s01e01.en.srt", "x.s01e02.Arabic.srt", "x.s01e02.Arabic.sample.srt", "x.e20.ar.srt", "readme.txt", "._x.s01e02.ar.srt"]
    rows = [(1, k, n, 100 + k, 2, "ara") for k, n in enumerate(names)] + [(2, k, n, 100 + k, None, None) for k, n in enumerate(names)] + [(3, 0, "only.sample.srt", 5, 7, "fr")]
    got = formats.choose_file(spark.createDataFrame(rows, "file_id int, ordinal int, name string, bytes long, episode int, language string"))
    assert {r.file_id: r.name for r in got.collect()} == {1: "x.s01e02.Arabic.srt", 2: "x.e20.ar.srt", 3: "only.sample.srt"}


def test_languages_are_no_patterns(spark):
    """A tag that no list has is looked for as it stands, whatever characters it is made of."""
    rows = [(k, n, name, 100 - n, None, tag) for k, tag in enumerate(["c++", "(", "[x", "a.c"]) for n, name in enumerate(["other.srt", f"film {tag} x.srt", "film abc x.srt"])]
    got = formats.choose_file(spark.createDataFrame(rows, "file_id int, ordinal int, name string, bytes long, episode int, language string"))
    assert {r.file_id: r.ordinal for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_catalogues(spark):
    one = json.dumps({"data": [{"attributes": {"language": "en", "files": [{"file_id": 7, "file_name": "a"}, {"file_id": 8}]}}, {"attributes": {"language": "fr", "files": [{"file_id": 7}]}}]})
    two = json.dumps({"subtitles": [{"url": "/a", "language": "EN", "release_name": "r", "unpack_files": [{"url": "/b", "language": ""}, {"url": ""}]}, {"url": "/c", "language": "de"}, {"url": "/d"}]})
    three = json.dumps({"data": [{"subtitleId": 3, "releaseInfo": ["Other.2001", "Dune.Part.Two.2024.WEB", "x"], "good": 2, "bad": 5}, {"subtitleId": 0}]})
    answers = spark.createDataFrame([(1, 1, one, two, three, "Dune.Part.Two.2024.WEB.mkv")], "request_id int, ordinal int, one string, two string, three string, filename string")
    assert sorted((r.provider_id, r.language, r.release) for r in catalogues.file_candidates(answers.withColumnRenamed("one", "body")).collect()) == [("7", "en", "a"), ("8", "en", None)]
    assert sorted((r.provider_id, r.language, r.release) for r in catalogues.nested_candidates(answers.withColumnRenamed("two", "body")).collect()) == [("/a", "en", "r"), ("/b", "en", "r"), ("/c", "de", None)]
    assert [(r.provider_id, r.release, r.rating) for r in catalogues.release_candidates(answers.withColumnRenamed("three", "body")).collect()] == [("3", "Dune.Part.Two.2024.WEB", -3.0)]


def test_batches_split_at_a_pause(spark):
    rows = [(1, k, k * 2000 + (3000 if k > 4 else 0), k * 2000 + 1500 + (3000 if k > 4 else 0), "text") for k in range(1, 9)]
    cues = spark.createDataFrame(rows, "track_id int, id long, start_ms long, end_ms long, text string")
    assert [r.batch for r in batches.batch_cues(cues, 6, 1000).orderBy("id").collect()] == [0] * 4 + [1] * 4
    bodies = ['```json\n[{"id": 1, "text": "un"}, {"id": 1, "text": "non"}]\n```', 'Sure: [{"id": 2, "text": "deux"}] ok', '{"translations": [{"id": 3, "text": " "}]}', '{"cues": [{"id": 4, "text": "quatre"}]}', "none"]
    rows = batches.answer_rows(spark.createDataFrame([(1, k, b) for k, b in enumerate(bodies)], "track_id int, batch int, body string"))
    assert [r.text for r in batches.translated(cues, rows).orderBy("id").collect()] == ["un", "deux", "text", "quatre", *["text"] * 4]


def test_stream_equals_batch(spark, tmp_path):
    visits = registry.adapter(spark, SMALL, dialect.visits).select("client", "event_id", "at_ms")
    middle = visits.agg(F.percentile("at_ms", 0.5)).first()[0]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(visits.schema).parquet(str(tmp_path / "in"))
    ask = limits.rate_limit(stream, 2, expire=False).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    for part in (visits.where(F.col("at_ms") <= middle), visits.where(F.col("at_ms") > middle)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ask.trigger(availableNow=True).start().awaitTermination()
    got = {(r.client, r.event_id, r.allowed, r.retry_after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.client, r.event_id, r.allowed, r.retry_after or 0) for r in state.rate_limit(visits, 2).collect()}
    assert any(not x[2] for x in got)
