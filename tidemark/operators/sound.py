"""Speech in raw sound: frames of 16-bit samples, their loudness, and the islands of those well above the quiet ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import islands

# Ms of a frame, sample rate, share of frames that are quieter than noise, how far above it speech begins, and its least loudness.
FRAME_MS, SAMPLE_RATE, QUIET_SHARE, ABOVE_NOISE, LEAST_LOUD = 30, 16_000, 0.25, 2.6, 380.0


def loudness(pcm: Column, sample_rate: int = SAMPLE_RATE) -> Column:
    """The root mean square of each whole frame of little-endian 16-bit samples, as an array; what is left over at the end is no frame."""
    width = int(sample_rate * FRAME_MS / 1000 + 0.5)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(sounds: pa.Array) -> pa.Array:
        out = []
        for sound in sounds:
            raw = sound.as_py() or b""
            samples = np.frombuffer(raw, dtype="<i2", count=len(raw) // (2 * width) * width).astype(np.float64).reshape(-1, width)
            out.append(np.sqrt((samples * samples).sum(axis=1) / width).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return run(pcm)


def frames_of(sounds: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """sounds (client, pcm) to (client, n from 1, active): a frame is active if it is much louder than the sound's quiet quarter. A sound is one window of some seconds, so its frames are one row's array."""
    levels = sounds.select("client", loudness(F.col("pcm"), sample_rate).alias("levels")).where(F.size("levels") > 0)
    noise = F.get(F.array_sort("levels"), F.floor(F.size("levels") * QUIET_SHARE).cast("int"))
    told = levels.select("client", "levels", F.greatest(F.lit(LEAST_LOUD), noise * ABOVE_NOISE).alias("bar"))
    return told.select("client", "bar", F.posexplode("levels").alias("at", "level")).select("client", (F.col("at") + 1).cast("long").alias("n"), (F.col("level") >= F.col("bar")).alias("active"))


def speech(sounds: DataFrame, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """sounds (client, pcm) to (client, start_ms, end_ms) of speech: voiced frames, three or more in a row."""
    found = islands(frames_of(sounds, sample_rate))
    return found.select("client", ((F.col("first") - 1) * FRAME_MS).alias("start_ms"), (F.col("last") * FRAME_MS).alias("end_ms"))
