"""Sound as rows (sound, i, v): generated by formula, filtered by recurrence, mixed by sums."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running
from .scratch import keep

RATE = 22_050
#: The generator's step and increment.
STEP, MORE, MODULUS = 1_664_525, 1_013_904_223, 1 << 32
#: Samples in a block of a filter's scan, or of noise.
BLOCK = 1 << 16


def ticks(spark, sounds: DataFrame) -> DataFrame:
    """(sound, i, t) for sounds (sound, seconds)."""
    n = F.greatest(F.lit(1), F.floor(F.col("seconds") * RATE + 0.5)).cast("long")
    return sounds.select("sound", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).withColumn("t", F.col("i") / RATE)


def jump(state: int, steps: int) -> int:
    """The generator's state so many steps on, by squaring the step's affine map."""
    a, c = STEP, MORE
    while steps:
        if steps & 1:
            state = (state * a + c) % MODULUS
        a, c, steps = a * a % MODULUS, (a * c + c) % MODULUS, steps >> 1
    return state


def noise(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """The generator's n values in -1 to 1 after the first ``skip``; a seed of 0 counts as 1. Jumps of 2**k steps make it a
    few array operations."""
    state = np.array([jump(seed % MODULUS or 1, skip + 1)], np.uint64)
    a, c = STEP, MORE
    while len(state) < n:
        state = np.concatenate([state, (state * np.uint64(a) + np.uint64(c)) % np.uint64(MODULUS)])
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return state[:n] / MODULUS * 2 - 1


def hiss(sounds: DataFrame) -> DataFrame:
    """Noise (sound, i, v) for sounds (sound, seed, seconds). A long sound is made in blocks, each of which jumps to its
    place in the generator's sequence, so it may lie in many tasks. Null seeds or lengths give no rows."""
    kind, n = dict(sounds.dtypes)["sound"], F.greatest(F.lit(1), F.floor(F.col("seconds") * RATE + 0.5)).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(BLOCK).cast("long")))
    blocks = sounds.filter("seed is not null and seconds is not null").select("sound", F.col("seed").cast("long").alias("seed"), n.alias("n"), starts.alias("at"))

    def run(batches):
        for b in batches:
            for sound, seed, n, at in zip(b["sound"], b["seed"], b["n"], b["at"], strict=True):
                v = noise(int(seed), int(min(BLOCK, n - at)), int(at))
                yield pd.DataFrame({"i": np.arange(at, at + len(v)), "v": v}).assign(sound=sound)[["sound", "i", "v"]]

    return blocks.mapInPandas(run, f"sound {kind}, i long, v double")


def envelope(t: Column, seconds: Column, attack: float = 0.005, curve: float = 5.0) -> Column:
    """Rises in ``attack`` seconds, then falls off exponentially to 0 at the end."""
    u = (t - attack) / (seconds - attack)
    return F.when(t >= seconds, 0.0).when(t < attack, t / attack).otherwise(F.exp(-curve * u) * (1 - u))


def adsr(t: Column, seconds: Column, attack: float, decay: float, sustain: float, release: float) -> Column:
    hold = F.when(t < attack, t / attack).when(t < attack + decay, 1 - (1 - sustain) * (t - attack) / decay).otherwise(sustain)
    return F.when(t >= seconds, 0.0).otherwise(hold * F.least(F.lit(1.0), (seconds - t) / release))


def note_hz(name: Column) -> Column:
    """Frequency of a note such as A4, C#5 or Bb3."""
    step = F.element_at(F.create_map(*[F.lit(x) for kv in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11), strict=True) for x in kv]), F.substring(name, 1, 1))
    bend = F.when(F.substring(name, 2, 1) == "#", 1).when(F.substring(name, 2, 1) == "b", -1).otherwise(0)
    octave = F.regexp_extract(name, r"(-?\d+)$", 1).cast("int")
    return 440.0 * F.pow(F.lit(2.0), (step + bend + 12 * (octave - 4) - 9) / 12.0)


def square(phase: Column) -> Column:
    return F.when(F.sin(phase) >= 0, 1.0).otherwise(-1.0)


def pulse(phase: Column, ratio: float, partials: int = 12) -> Column:
    """A pulse wave as a sum of partials."""
    return sum((F.sin(phase * k) * (2 * math.sin(math.pi * k * ratio) / (math.pi * k)) for k in range(1, partials + 1)), F.lit(0.0))


def triangle(phase: Column, partials: int = 6) -> Column:
    return sum((F.sin(phase * (2 * k + 1)) * ((-1) ** k * 8 / (math.pi * (2 * k + 1)) ** 2) for k in range(partials)), F.lit(0.0))


def glide(rows: DataFrame, hz: Column, name: str = "phase") -> DataFrame:
    """Phase of a tone whose pitch moves: a running sum."""
    return running(rows, ["sound"], ["i"], **{name: 2 * math.pi * hz / RATE})


def vibrato(hz: Column, t: Column, depth: float, rate: float) -> Column:
    return hz * (1 + depth * F.sin(2 * math.pi * rate * t))


def mix(*voices: DataFrame) -> DataFrame:
    """Voices added up; short ones count as 0 beyond their end."""
    out = voices[0]
    for v in voices[1:]:
        out = out.unionByName(v)
    return out.groupBy("sound", "i").agg(F.sum("v").alias("v"))


def normalise(rows: DataFrame, target: float) -> DataFrame:
    """Gain so that the peak is the target; silence stays."""
    peak = rows.groupBy("sound").agg(F.max(F.abs("v")).alias("peak"))
    return rows.join(peak, "sound").select("sound", "i", F.when(F.col("peak") < 1e-9, F.col("v")).otherwise(F.col("v") * target / F.col("peak")).alias("v"))


def affine(keeps: np.ndarray, adds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of the maps y -> keeps * y + adds, applied one after the other: for each place the map from the start to
    there. Maps are composed over distances of 1, 2, 4 and so on, so there is no step for each sample."""
    k, b, far = keeps.copy(), adds.copy(), 1
    while far < len(k):
        b[far:] += k[far:] * b[:-far]
        k[far:] *= k[:-far].copy()
        far *= 2
    return k, b


def low_pass(rows: DataFrame, cutoff: float | Column, high: bool = False) -> DataFrame:
    """One-pole low-pass (or what it takes away); the cutoff in Hz may change from row to row.

    The filter's step is an affine map of its last value. Blocks of samples are composed to one map each, these along
    the sound, and each block then starts from the value that the ones before it lead to.
    """
    f = F.least(F.greatest(F.lit(cutoff) if isinstance(cutoff, (int, float)) else cutoff, F.lit(20)), F.lit(RATE / 2 - 200))
    share = 1 - F.exp(-2 * math.pi * f.cast("double") / RATE)
    kind = dict(rows.dtypes)["sound"]
    t = running(rows.select("sound", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"), share.alias("a")), ["sound"], ["i"], place=F.lit(1))
    t = keep(t.withColumn("block", F.expr(f"(place - 1) div {BLOCK}")))
    maps = lambda pdf: affine(1 - pdf["a"].to_numpy(), (pdf["a"] * pdf["v"]).to_numpy())

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        k, b = maps(pdf.sort_values("place"))
        return pd.DataFrame({"sound": pdf["sound"].iloc[:1], "block": pdf["block"].iloc[:1], "k": k[-1], "b": b[-1]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        ends = affine(pdf["k"].to_numpy(), pdf["b"].to_numpy())[1]
        return pdf[["sound", "block"]].assign(start=np.concatenate([[0.0], ends[:-1]]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        k, b = maps(pdf)
        out = k * pdf["start"].to_numpy() + b
        return pdf.assign(v=pdf["v"] - out if high else out)[["sound", "i", "v"]]

    begin = t.groupBy("sound", "block").applyInPandas(composed, f"sound {kind}, block long, k double, b double").groupBy("sound").applyInPandas(starts, f"sound {kind}, block long, start double")
    return t.join(begin, ["sound", "block"]).groupBy("sound", "block").applyInPandas(run, f"sound {kind}, i long, v double")


def sequence(notes: DataFrame, loop: Column) -> DataFrame:
    """Notes (tune, voice, ord, name, seconds) laid out in time: start is the sum of the earlier ones of a voice. Samples
    beyond the loop's end come in again at its start (``loop`` samples)."""
    w = Window.partitionBy("tune", "voice").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    t = notes.withColumn("start", F.coalesce(F.sum("seconds").over(w), F.lit(0.0)))
    n = F.greatest(F.lit(1), F.floor(F.col("seconds") * RATE + 0.5)).cast("long")
    s = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    v = F.sin(2 * math.pi * note_hz(F.col("name")) * F.col("k") / RATE) * envelope(F.col("k") / RATE, F.col("seconds"))
    return s.withColumns({"i": F.pmod(F.floor(F.col("start") * RATE + 0.5).cast("long") + F.col("k"), loop), "v": v}).groupBy(F.col("tune").alias("sound"), "i").agg(F.sum("v").alias("v"))


def measures(rows: DataFrame) -> DataFrame:
    """Peak, last value and the step between the last and the first."""
    return rows.groupBy("sound").agg(F.max(F.abs("v")).alias("peak"), F.max_by("v", "i").alias("last"), F.abs(F.max_by("v", "i") - F.min_by("v", "i")).alias("seam"))


def pcm(v: Column) -> Column:
    """16-bit samples: clamped, scaled, halves rounded up."""
    return F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)) * 32767 + 0.5).cast("int")


def wav(rows: DataFrame) -> DataFrame:
    """(sound, wav): mono 16-bit files with the header of 44 bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("i")["s"].to_numpy("<i2").tobytes()
        head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, 2 * RATE, 2, 16) + b"data" + struct.pack("<I", len(data))
        return pd.DataFrame({"sound": [pdf["sound"].iloc[0]], "wav": [head + data]})

    return rows.select("sound", "i", pcm(F.col("v")).alias("s")).groupBy("sound").applyInPandas(run, f"sound {dict(rows.dtypes)['sound']}, wav binary")
