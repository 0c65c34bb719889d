"""Waveform kernels in numpy, run on Arrow batches. Each is a pure function of a row: retries and speculation agree.

Ids and parameters fan out on narrow rows; waveforms are joined last and leave in the same pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.functions.draws import draw
from timbral.operators import filters
from timbral.operators.numbering import numbered

#: Rows of one Arrow batch: a clip of four seconds is 64,000 floats.
WAVE_ROWS = 64

# Levels in dB and peaks, the telephone band in Hz and its order, a packet in seconds, and ranges of the raw-waveform operations.
LEVEL_DB, PEAK, BAND, ORDER, PACKET = -20.0, 0.99, (300.0, 3400.0), 4, 0.02
TAPS, ALPHA, NOISE_LEVEL, GAIN, CLIP = (5, 25), (0.1, 0.5), (0.001, 0.01), (0.7, 1.3), 0.9


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x**2))) if len(x) else 0.0


def normalise(x: np.ndarray, db: float = LEVEL_DB) -> np.ndarray:
    r = rms(x)
    return x * (10 ** (db / 20) / r) if r > 0 else x


def to_peak(x: np.ndarray, to: float = PEAK) -> np.ndarray:
    p = np.abs(x).max(initial=0.0)
    return x * (to / p) if p > 0 else x


def convolve_same(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By FFT; the middle len(x) samples, to a peak of .99."""
    n = len(x) + len(h) - 1
    if not len(x) or not len(h):
        return x
    size = 1 << (n - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]
    start = (len(h) - 1) // 2
    return to_peak(y[start : start + len(x)])


def mix(x: np.ndarray, noise: np.ndarray, db: float, offset: int = 0) -> np.ndarray:
    if not len(noise) or not len(x):
        return x
    laid = np.resize(np.roll(noise, -(offset % len(noise))), len(x))
    rx, rn = rms(x), rms(laid)
    if rx == 0 or rn == 0:
        return x
    y = x + laid * (rx / (rn * 10 ** (db / 20)))
    return to_peak(y) if np.abs(y).max() > 1 else y


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited, in the frequency domain; ceil(n * to / rate) samples."""
    if rate == to or not len(x):
        return x
    n = -(-len(x) * to // rate)
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return np.fft.irfft(out, n) * (n / len(x))


def bandpass(x: np.ndarray, rate: int, low: float = BAND[0], high: float = BAND[1], order: int = ORDER) -> np.ndarray:
    return filters.bandpass(x, rate, low, high, order)


def quantise(x: np.ndarray, bits: int) -> np.ndarray:
    half = 2**bits / 2
    return np.clip(np.round(x * half) / half, -1, 1)


def drop_packets(x: np.ndarray, rate: int, lost: float, rng: np.random.Generator) -> np.ndarray:
    size = int(rate * PACKET)
    full = len(x) // size if size else 0
    y = x.copy()
    y[: full * size].reshape(full, size)[rng.random(full) < lost] = 0
    return y


def codec(x: np.ndarray, rate: int, target: int, loss: float, band: bool, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Down and up, band, lost packets, levels; the loss rate is the label's own."""
    y = filters.telephone(x, rate, target)
    if band:
        y = bandpass(y, rate)
    if loss > 0:
        y = drop_packets(y, rate, loss, rng)
    if bits > 0:
        y = quantise(y, bits)
    return np.clip(normalise(y), -1, 1)


def rawboost(x: np.ndarray, operations: list[str], rng: np.random.Generator) -> np.ndarray:
    """The operations in their fixed order, each with draws of its own."""
    y = x
    if "linear_filter" in operations:
        taps = rng.standard_normal(int(rng.integers(TAPS[0], TAPS[1] + 1)))
        y = np.convolve(y, taps / np.abs(taps).sum())[: len(y)]
    if "nonlinear_distortion" in operations:
        y = to_peak(np.tanh(y * rng.uniform(*ALPHA)))
    if "additive_noise" in operations:
        level, n = rng.uniform(*NOISE_LEVEL), rng.standard_normal(len(y))
        y = y + y * n * level + rng.standard_normal(len(y)) * level * 0.5
    if "gain_variation" in operations:
        y = y * rng.uniform(*GAIN)
    if "clipping" in operations:
        y = np.clip(y, -CLIP, CLIP)
    return np.clip(normalise(y), -PEAK, PEAK)


def generator(*keys: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, keys)).encode()).digest()[:8], "little"))


def augmented(row: object, rate: int = 16000, seed: int = 42) -> np.ndarray:
    """One augmented waveform. Without a room's or a noise's wave that step is left out."""
    x = np.asarray(row.x, float)
    rng = generator(seed, row.clip_id, row.copy, "kernel")
    if row.aug == "-":
        return x
    if row.aug == "rir":
        y = x if row.rir is None else convolve_same(x, np.asarray(row.rir, float))
        y = y if row.noise_wave is None else mix(y, np.asarray(row.noise_wave, float), row.snr_db, int(rng.integers(1 << 30)))
        return np.clip(y, -1, 1)
    if row.aug == "codec":
        return codec(x, rate, int(row.rate), row.loss, bool(row.bandpass), int(row.bits), rng)
    if row.aug == "rawboost":
        return rawboost(x, list(row.operations), rng)
    raise ValueError(f"unknown augmentation {row.aug}")


def mapped(rows: DataFrame, kernel: Callable[..., np.ndarray], *keep: str) -> DataFrame:
    """rows: (x, ...) -> (keep..., y): y is kernel(row), whose x is an array already; one that needs no other column is `lambda r: f(r.x)`.

    This is how a kernel of one's own becomes a step. A null wave counts as empty.
    """
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (whole.iloc[at : at + WAVE_ROWS] for whole in parts for at in range(0, len(whole), WAVE_ROWS)):
            own = p.assign(x=[np.asarray([] if x is None else x, float) for x in p["x"]])
            yield p[list(keep)].assign(y=[kernel(r) for r in own.itertuples(index=False)])

    return rows.mapInPandas(run, f"{schema}, y array<double>")


def augment(rows: DataFrame, rate: int = 16000, seed: int = 42) -> DataFrame:
    """rows: corpus.parameters' columns with x, rir and noise_wave (arrays, the latter null where there is none) -> (clip_id, copy, aug, y)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (whole.iloc[at : at + WAVE_ROWS] for whole in parts for at in range(0, len(whole), WAVE_ROWS)):
            yield pd.DataFrame({"clip_id": p.clip_id, "copy": p["copy"], "aug": p.aug, "y": [augmented(r, rate, seed) for r in p.itertuples(index=False)]})

    columns = ["clip_id", "copy", "aug", "x", "rir", "noise_wave", "snr_db", "rate", "loss", "bandpass", "bits", "operations"]
    return rows.select(*columns).mapInPandas(run, "clip_id long, copy long, aug string, y array<double>")


def _paths(rows: DataFrame, dictionary: DataFrame, category: str, name: str, seed: int) -> DataFrame:
    """rows with `_path {name}`, that of a random member of the row's category."""
    names = numbered(dictionary.select(F.col("category").alias(category), F.col("path").alias(f"_path {name}")), [F.substring(F.md5(f"_path {name}"), 1, 3), f"_path {name}"], (category,), "_i", total="_n")
    sizes = names.groupBy(category).agg(F.first("_n").alias("_n"))
    picked = rows.join(sizes, category, "left").withColumn("_i", F.floor(draw(f"file {name}", "clip_id", "copy", seed=seed) * F.col("_n"))).drop("_n")
    return picked.join(names.drop("_n"), [category, "_i"], "left").drop("_i")


def with_dictionaries(rows: DataFrame, dictionaries: dict[str, tuple[DataFrame, str]], seed: int = 42) -> DataFrame:
    """rows with a wave for each name of dictionaries: that of a random member of the row's category; null where there is none.

    dictionaries: name -> ((category, path, wave), the column of the row's category). Paths are unique within a category. All
    paths are picked first, on narrow rows and for those alone that have a category; waves are joined after, by path.
    """
    has = F.lit(False)
    for _, category in dictionaries.values():
        has = has | F.col(category).isNotNull()
    out = rows.filter(has)
    for name, (dictionary, category) in dictionaries.items():
        out = _paths(out, dictionary, category, name, seed)
    for name, (dictionary, category) in dictionaries.items():
        waves = dictionary.select(F.col("category").alias(category), F.col("path").alias(f"_path {name}"), F.col("wave").alias(name))
        out = out.join(waves, [category, f"_path {name}"], "left").drop(f"_path {name}")
    others = rows.filter(~has).withColumns({name: F.lit(None).cast(out.schema[name].dataType) for name in dictionaries})
    return out.select(*rows.columns, *dictionaries).unionByName(others)
