"""The data source of timed text, the chain from bytes to cues, speech in sound, and the cache as a sink."""

import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sound, state, text
from tidemark.sources import timedtext
from tidemark.streaming.cache import Cache


def srt(said):
    return f"1\n00:00:01,000 --> 00:00:02,500\n{said}\n"


def zipped(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for name, content in files.items():
            archive.writestr(name, content)
    return data.getvalue()


ASS = "[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:03.50,0:00:05.00,Default,,0,0,0,,{\\pos(1,2)}First line\\NSecond, with comma"
CASES = {
    "plain": ("a.srt", srt("hello").encode(), None, None, ["hello"]),
    "ass": ("a", ASS.encode(), None, None, ["First line\nSecond, with comma"]),
    "vtt": ("a", b"WEBVTT\n\n00:00:02.000 --> 00:00:04.000 align:start\nCaption text\n", None, None, ["Caption text"]),
    "arabic": ("a.srt", srt("مرحبا بالعالم").encode("cp1256"), "ar", None, ["مرحبا بالعالم"]),
    "season": ("a.zip", zipped(**{"Show.S02E07.srt": srt("episode seven"), "Show.S02E08.srt": srt("episode eight")}), None, 8, ["episode eight"]),
    "forks": ("a.zip", zipped(**{"__MACOSX/._Movie.srt": bytes([0, 5, 22, 7, 255, 254]), "Movie.srt": srt("real one")}), None, None, ["real one"]),
    "sample": ("a.zip", zipped(**{"Movie.sample.srt": srt("sample"), "Movie.srt": srt("full") + "\n2\n00:00:05,000 --> 00:00:06,000\nmore\n"}), None, None, ["full", "more"]),
    "language": ("a.zip", zipped(**{"Movie.English.eng.srt": srt("English") + "\n" + srt("larger English track"), "Movie.Arabic.ara.srt": srt("العربية الصحيحة")}), "ar", None, ["العربية الصحيحة"]),
    "bom": ("a.srt", b"\xef\xbb\xbf" + srt("marked").replace("\n", "\r\n").encode(), None, None, ["marked"]),
}


def test_bytes_become_cues(spark):
    rows = [(k, *v[:4]) for k, v in CASES.items()] + [("html", "a", b"<html>not found</html>", None, None), ("readme", "a.zip", zipped(**{"readme.txt": "nothing here"}), None, None), ("broken", "a.zip", b"PKbroken", None, None), ("none", None, None, None, None)]
    got = timedtext.prepared(spark.createDataFrame(rows, "file_id string, name string, content binary, language string, episode int")).persist()
    assert {r.file_id: r.error for r in got.where("error is not null").collect()} == {"html": "not a valid timed text", "readme": "no supported text", "broken": "no supported text", "none": "no supported text"}
    cues = text.parse_srt(got.where("error is null").select(F.col("file_id").alias("track_id"), "content"))
    said = {}
    for r in cues.orderBy("track_id", "id").collect():
        said.setdefault(r.track_id, []).append(r.text)
    assert said == {k: v[4] for k, v in CASES.items()}


def test_source_and_round_trip(spark, tmp_path, monkeypatch):
    spark.dataSource.register(timedtext.TimedText)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.srt").write_text(srt("one"))
    (tmp_path / "in" / "sub" / "b.zip").write_bytes(zipped(**{"x.srt": srt("two"), "y.vtt": "WEBVTT\n"}))
    (tmp_path / "in" / "c.zip").write_bytes(b"PKbroken")
    (tmp_path / "in" / "_left").write_text("aside")
    rows = spark.read.format("timedtext").load(str(tmp_path / "in")).collect()
    assert sorted((r.name, r.ordinal, r.error) for r in rows) == [("a.srt", 1, None), ("c.zip", 1, "archive unreadable"), ("x.srt", 1, None), ("y.vtt", 2, None)]
    out = spark.createDataFrame([("d/one.srt", srt("one")), ("two.srt", srt("ñ"))], "name string, content string")
    out.write.format("timedtext").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("timedtext").load(str(tmp_path / "out")).collect()
    assert sorted((r.path[len(str(tmp_path / "out")) + 1 :], bytes(r.content).decode()) for r in back) == sorted(map(tuple, out.collect()))
    with pytest.raises(Exception, match="exists"):
        out.limit(1).write.format("timedtext").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("fine", "x"), ("../up", "x")], "name string, content string").coalesce(1).write.format("timedtext").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d", "two.srt"]


def test_large_archives_are_split_by_entries(tmp_path, monkeypatch):
    monkeypatch.setattr(timedtext, "TASK_BYTES", 4000)
    (tmp_path / "big.zip").write_bytes(zipped(**{f"{k}.srt": "x" * 1500 for k in range(9)}))
    (tmp_path / "a.srt").write_text("small")
    reader = timedtext.Reader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) == 6 and sorted(r[2] for p in parts for r in reader.read(p)) == sorted(["a.srt"] + [f"{k}.srt" for k in range(9)])


def recording(ms, spoken):
    n = ms * 16
    return b"".join(struct.pack("<h", round((9000 if any(a <= k / 16 < b for a, b in spoken) else 30) * math.sin(k / 7))) for k in range(n))


def test_speech_in_sound(spark):
    rows = [(1, recording(6000, [(1000, 2000), (3500, 5000)])), (2, recording(3000, [])), (3, b""), (4, None), (5, recording(1000, [(500, 510)]))]
    got = {}
    for r in sound.speech(spark.createDataFrame(rows, "client int, pcm binary")).orderBy("client", "start_ms").collect():
        got.setdefault(r.client, []).append((r.start_ms, r.end_ms))
    assert got.keys() == {1} and len(got[1]) == 2
    assert 900 <= got[1][0][0] <= 1000 and got[1][0][1] <= 2200 and got[1][1][1] <= 5200


def test_hangover(spark):
    """A gap shorter than the hangover doesn't part speech; what is open at the end stays, however short."""
    voiced = {1: "0011110000111100000000000", 2: "0000000000000000000011", 3: "0100000000", 4: "1", 5: "110000000000"}
    rows = [(c, n, v == "1") for c, told in voiced.items() for n, v in enumerate(told, 1)]
    got = sorted(map(tuple, state.hangover_islands(spark.createDataFrame(rows, "client int, n long, active boolean")).collect()))
    assert got == [(1, 2, 14), (2, 20, 22)] or got == sorted(loop(voiced))


def loop(voiced):
    out = []
    for c, told in voiced.items():
        v, start = [x == "1" for x in told], None
        for i in range(len(v) + 6):
            active = sum(v[max(0, i - 2) : i + 3]) >= 2
            if active and start is None:
                start = i
            elif start is not None and not active and not any(v[max(0, i - 6) : i]):
                end = max(start + 1, i - 5)
                if end - start >= 3:
                    out.append((c, start + 1, end))
                start = None
        if start is not None:
            out.append((c, start + 1, len(v)))
    return out


SHAPE = "key string, content string, cached_at_ms long"


def test_cache_merges_once(spark, tmp_path):
    """Last writes win, a replayed batch changes nothing, a merge killed before it is published leaves the old state, sweeps and vacuum keep what is current."""
    cache = Cache(spark, f"file://{tmp_path}/cache", SHAPE, buckets=4)
    rows = lambda *r: spark.createDataFrame(r, SHAPE).coalesce(1)
    seen = lambda: sorted(map(tuple, cache.read().collect()))
    assert seen() == []
    assert cache.merge(rows(("a", "1", 10), ("b", "1", 10), ("a", "2", 20), (None, "x", 1)), ("w", 0))
    assert seen() == [("a", "2", 20), ("b", "1", 10)]
    assert not cache.merge(rows(("a", "9", 90)), ("w", 0)) and seen() == [("a", "2", 20), ("b", "1", 10)]
    assert cache.merge(rows(("a", "old", 5), ("c", "1", 30)), ("w", 1)) and seen() == [("a", "2", 20), ("b", "1", 10), ("c", "1", 30)]

    class Killed(Cache):
        def _publish(self, state):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Killed(spark, f"file://{tmp_path}/cache", SHAPE, buckets=4).merge(rows(("d", "1", 40)), ("w", 2))
    assert seen() == [("a", "2", 20), ("b", "1", 10), ("c", "1", 30)]
    assert cache.merge(rows(("d", "1", 40)), ("w", 2)) and len(seen()) == 4
    cache.sweep(110, 100)
    cache.vacuum(1)
    assert seen() == [("a", "2", 20), ("c", "1", 30), ("d", "1", 40)]


def test_cache_of_a_stream(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache", SHAPE, buckets=2)
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame([("a", str(k), k), (f"k{k}", "x", k)], SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(cache.sink("s")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, cache.read().collect())) == [("a", "2", 2), ("k0", "x", 0), ("k1", "x", 1), ("k2", "x", 2)]
    assert cache.state()["batch"] == {"s": 2}
