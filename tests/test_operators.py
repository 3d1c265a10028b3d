"""Golden values and planted truth for operators that SQL doesn't check."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.operators import align, cues, refine, release, search, state, text, timing


def test_rank_golden(spark):
    requests = spark.createDataFrame([(1, "Dune.Part.Two.2024.1080p.BluRay.x264-GROUP.mkv", None, None)], "request_id long, filename string, season int, episode int")
    found = spark.createDataFrame(
        [(1, 1, "a", "1", "Dune.Part.Two.2024.1080p.BluRay.x264-GROUP", False, None, None), (1, 2, "a", "2", "Dune.Part.Two.2024.HDTV.x264-OTHER", False, None, None), (1, 3, "a", "3", "Unknown release", True, None, None), (1, 4, "a", "4", "Dune.Part.Two.2024.1080p.BluRay.x264-GROUP", True, 10.0, 1_000_000)],
        "request_id long, ordinal int, provider string, provider_id string, release string, hash_match boolean, rating double, downloads long",
    ).selectExpr("*", "false AS machine_translated")
    assert {r.ordinal: r.score for r in release.rank_candidates(requests, found).collect()} == {1: 70, 2: 12, 3: 75, 4: 100}


def test_waves_fill_from_one_provider(spark):
    ranked = spark.createDataFrame([(1, k, "ab"[k > 3], str(k), 50 - k, k) for k in range(1, 6)], "request_id long, ordinal int, provider string, provider_id string, score int, position int")
    assert [(r.position, r.wave, r.seat) for r in release.waves(ranked).orderBy("position").collect()] == [(1, 0, 0), (2, 0, 2), (3, 1, 0), (4, 0, 1), (5, 1, 1)]


def stabilised(spark, rows):
    return cues.stabilise(spark.createDataFrame([(1, k, float(a), float(b), t) for k, (a, b, t) in enumerate(rows, 1)], "track_id int, id int, start_ms double, end_ms double, text string")).orderBy("id").collect()


def test_stabilise_golden(spark):
    (one,) = stabilised(spark, [(1000, 2000, "Same"), (2200, 3200, "<i>same</i>")])
    assert (one.start_ms, one.end_ms, one.merged) == (1000, 3200, 1)
    assert stabilised(spark, [(2000, 2250, "a"), (4000, 5000, "b")])[0].end_ms == 2500
    grown = stabilised(spark, [(1000, 2000, "I am"), (1100, 3000, "I am here")])
    assert [r.text for r in grown] == ["I am here"]


def test_same_text_scan_stops_at_an_early_end(spark):
    kept = stabilised(spark, [(1000, 9000, "long"), (2000, 2600, "short"), (5000, 6000, "long")])
    assert [r.text for r in kept] == ["long", "short", "long"]


def test_srt_round_trip(spark):
    files = spark.createDataFrame([(1, "1\r\n00:00:01.500 --> 00:00:02,000\r\nHi\r\n\r\nx\n\n2\n10:00:01,500 --> 10:00:03,000\nyou\n")], "track_id int, content string")
    parsed = text.parse_srt(files)
    assert [(r.id, r.start_ms, r.end_ms, r.text) for r in parsed.orderBy("id").collect()] == [(1, 1500, 2000, "Hi"), (2, 36001500, 36003000, "you")]
    assert "10:00:01,500 --> 10:00:03,000" in text.write_srt(parsed).first().content


def test_cjk_tokens(spark):
    df = spark.createDataFrame([("日本 語",), ("The big cat",)], "t string").select(text.spoken_tokens(text.F.col("t")).alias("x"))
    assert [sorted(r.x) for r in df.collect()] == [["日本", "本語"], ["big", "cat"]]


def track(n, first, step, modulus, factor, length):
    at, out = first, []
    for i in range(n):
        out.append((at, at + length))
        at += step + i * factor % modulus
    return np.array(out, dtype=float)


def windows_of(spoken, begins, length):
    out = []
    for b in begins:
        out.append((b, length, [(float(max(0, s - b)), float(min(length, e - b))) for s, e in spoken if s <= b + length and e >= b]))
    return out


def aligned(spark, starts, ends, windows, most=180_000):
    rows = [(1, starts.tolist(), ends.tolist(), [(i, float(b), float(n), s) for i, (b, n, s) in enumerate(windows)])]
    schema = "track_id long, starts array<double>, ends array<double>, windows array<struct<window_ix:int,from_ms:double,length_ms:double,speech:array<struct<start_ms:double,end_ms:double>>>>"
    tracks = spark.createDataFrame(rows, schema)
    cues = tracks.select("track_id", F.explode(F.arrays_zip(F.col("starts").alias("start_ms"), F.col("ends").alias("end_ms"))).alias("c")).select("track_id", "c.*")
    heard = tracks.select("track_id", F.explode("windows").alias("w")).select("track_id", "w.*")
    return refine.activity_confidence(search.align_to_activity(tracks, most), cues, heard).first()


def test_constant_offset_is_found(spark):
    t = track(40, 500, 1900, 4300, 1777, 900)
    got = aligned(spark, t[:, 0], t[:, 1], windows_of(t + 3500, range(0, 121_000, 30_000), 24_000))
    assert got.confidence >= 58 and abs(got.offset_ms + 60_000 * got.rate - 63_500) < 150


def test_unrelated_activity_is_refused(spark):
    t = track(40, 500, 1900, 4300, 1777, 900)
    other = np.array([(i * 5000, i * 5000 + 900) for i in range(40)], dtype=float)
    assert aligned(spark, t[:, 0], t[:, 1], windows_of(other, range(0, 121_000, 30_000), 24_000)).confidence < 58


def test_padded_cues_move_onto_their_speech(spark):
    """Cues that begin 300 ms before and end 1,100 ms after their speech: the shift finds where dialogue begins."""
    spoken = track(200, 10_000, 4100, 3900, 1777, 2600)
    cues = np.stack([spoken[:, 0] - 5000 - 300, spoken[:, 1] - 5000 + 1100], axis=1)
    got = aligned(spark, cues[:, 0], cues[:, 1], windows_of(spoken, (20_000, 220_000, 460_000, 700_000), 25_000))
    assert got.confidence > 0 and abs(got.offset_ms - 5000) <= 450


def referenced(spark, starts, there, most=180_000):
    df = spark.createDataFrame([(1, starts.tolist(), there.tolist())], "track_id long, starts array<double>, reference array<double>")
    each = lambda c: df.select("track_id", F.explode(c).alias("at_ms"))
    return refine.reference_confidence(search.align_to_reference(df, most), each("starts"), each("reference")).first()


def test_reference_drift(spark):
    t = track(240, 4000, 1800, 4900, 1237, 1100)[:, 0]
    got = referenced(spark, t, t * 1.0007 + 275)
    assert got.confidence > 58 and np.abs(t * got.rate + got.offset_ms - (t * 1.0007 + 275)).max() < 150


def test_reference_frame_rate_and_offset(spark):
    t = track(180, 8000, 1700, 5300, 1777, 900)[:, 0]
    for rate, offset in ((1.0, -3000.0), (1.042709, 1500.0), (1.0, 15_000.0)):
        got = referenced(spark, t, t * rate + offset, 20_000)
        assert got.confidence > 58 and np.abs(t * got.rate + got.offset_ms - t * rate - offset).max() < 150, (rate, offset, got)


def test_kernels_equal_the_joins(spark):
    """The search's scores of a map are those of the joins."""
    t = track(60, 500, 1900, 4300, 1777, 900)
    windows = windows_of(t * 1.001 + 700, (0, 30_050, 61_010, 90_000), 24_000)
    track_ = {"starts": t[:, 0], "ends": t[:, 1], "reference": t[:, 0] * 1.001 + 400, "windows": [{"from_ms": b, "length_ms": n, "speech": [dict(zip(("start_ms", "end_ms"), x)) for x in s]} for b, n, s in windows]}
    cues = spark.createDataFrame([(1, float(a), float(b)) for a, b in t], "track_id long, start_ms double, end_ms double")
    heard = spark.createDataFrame([(1, i, float(b), float(n), s) for i, (b, n, s) in enumerate(windows)], "track_id long, window_ix int, from_ms double, length_ms double, speech array<struct<start_ms:double,end_ms:double>>")
    tried = [(1, k, r, o) for k, (r, o) in enumerate([(1.0, 0.0), (1.001, 700.0), (0.96, -333.0), (1.041667, 1950.0)])]
    got = {(r.map_id, r.window_ix): r.score for r in align.activity_scores(cues, heard, spark.createDataFrame(tried, "track_id long, map_id int, rate double, offset_ms double")).collect()}
    for _, k, r, o in tried:
        assert np.allclose([got[k, i] for i in range(4)], search.activity_windows(track_, r, np.array([o]))[:, 0])
    frame = lambda v: spark.createDataFrame([(1, float(x)) for x in v], "track_id long, at_ms double")
    for _, _, r, o in tried:
        told = {x.section: x.score for x in align.proximity_scores(frame(t[:, 0] * r + o), frame(t[:, 0] * 1.001 + 400)).collect()}
        assert np.allclose([told.get(i, 0.0) for i in range(6)], search.reference_sections(track_, r, np.array([o]))[:, 0])


def test_one_hot_track_and_client(spark):
    """A track, and a client, of 100,000 events: windows and folds take one pass."""
    hot = spark.range(100_000).select(F.lit(1).alias("track_id"), (F.col("id") * 700).alias("at_ms"))
    near = timing.nearest_onsets(hot.where("at_ms % 2100 = 0"), hot.where("at_ms % 1400 = 0"))
    assert near.count() == 33334
    assert align.proximity_scores(hot, hot.withColumn("at_ms", F.col("at_ms") + 10)).count() == 6
    visits = spark.range(100_000).select(F.lit(7).alias("client"), F.col("id").alias("event_id"), (F.col("id") * 10).alias("at_ms"))
    assert state.rate_limit(visits, 5).where("allowed").count() == 5 * -(-1_000_000 // 60_000)


@pytest.mark.parametrize("n", [0, 5])
def test_too_little_evidence(spark, n):
    df = spark.createDataFrame([(1, [1.0] * n, [1.0] * n)], "track_id long, starts array<double>, reference array<double>")
    assert search.align_to_reference(df).first().refused


def test_snap_and_settle(spark):
    """Cues 900 ms early move onto their speech; what can't be measured stays, and passes."""
    t = track(150, 15_000, 5000, 2100, 1777, 2500)
    speech = windows_of(t, range(20_000, 700_000, 60_000), 40_000)
    heard = spark.createDataFrame([(k, i, float(b), float(n), s) for k in (1, 2) for i, (b, n, s) in enumerate(speech)] + [(3, 0, 0.0, 1000.0, [])], "track_id long, window_ix int, from_ms double, length_ms double, speech array<struct<start_ms:double,end_ms:double>>")
    rows = [(k, i, float(a + d), float(b + d)) for k, d in ((1, -1100), (2, -250), (3, 0)) for i, (a, b) in enumerate(t)]
    cues = spark.createDataFrame(rows, "track_id long, k int, start_ms double, end_ms double")
    errors = {r.track_id: r.error_ms for r in refine.offset_error(cues, heard).collect()}
    assert errors == {1: 900, 2: 50}
    shifts = {r.track_id: r.shift_ms for r in refine.snap(cues, heard).select("track_id", "shift_ms").distinct().collect()}
    assert shifts == {1: 900, 2: 0, 3: 0}
    assert {r.track_id: r.accepted for r in refine.settled(cues.select("track_id").distinct(), cues.withColumn("start_ms", F.col("start_ms") - F.when(F.col("track_id") == 2, 1600).otherwise(0)), heard).collect()} == {1: True, 2: False, 3: True}
