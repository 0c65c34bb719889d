"""Spectra as rows, and proxies made of them. A clip is cut to its first seconds, so its rows are bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbral.operators.kernels import WAVE_ROWS

#: Clips whose bins are made at once: of five seconds at 16,000 Hz they are 160,000 rows each.
CLIPS = 16

# Seconds shown, range of decibels under a clip's loudest bin, least amplitude and power, the mel scale's linear step (Hz), its
# corner (Hz) and its logarithmic step beyond, the divisor of the identity proxy and the factor of the flatness proxy.
SECONDS, RANGE_DB, LEAST, LEAST_POWER, MEL_HZ, MEL_CORNER, MEL_LOG, IDENTITY, FLATNESS = 5.0, 80.0, 1e-5, 1e-10, 200.0 / 3, 1000.0, float(np.log(6.4) / 27), 100.0, 10.0


def stft(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """(frames, bins) magnitudes; frames are centred, zeros stand outside, the window is a periodic Hann."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2), size)[::hop]
    return np.abs(np.fft.rfft(frames * window, axis=1))


def mel(hz: np.ndarray) -> np.ndarray:
    return np.where(hz < MEL_CORNER, hz / MEL_HZ, MEL_CORNER / MEL_HZ + np.log(np.maximum(hz, MEL_CORNER) / MEL_CORNER) / MEL_LOG)


def unmel(m: np.ndarray) -> np.ndarray:
    corner = MEL_CORNER / MEL_HZ
    return np.where(m < corner, m * MEL_HZ, MEL_CORNER * np.exp(MEL_LOG * (m - corner)))


def mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    """(bands, bins): triangles of equal area between neighbouring edges on the mel scale, up to half the rate."""
    edges = unmel(np.linspace(0.0, float(mel(np.array(rate / 2))), bands + 2))[:, None]
    hz = np.arange(size // 2 + 1) * rate / size
    rise, fall = (hz - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - hz) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)) * 2 / (edges[2:] - edges[:-2])


def cepstra(x: np.ndarray, rate: int = 16000, size: int = 2048, hop: int = 512, bands: int = 128, n: int = 13) -> np.ndarray:
    """(frames, n): the orthonormal cosine transform of the decibels of mel powers."""
    db = 10 * np.log10(np.maximum(LEAST_POWER, stft(x, size, hop) ** 2 @ mel_bank(rate, size, bands).T))
    db = np.maximum(db, db.max() - RANGE_DB)
    k = np.arange(n)[:, None]
    turn = np.sqrt(np.where(k == 0, 1.0, 2.0) / bands) * np.cos(np.pi * k * (2 * np.arange(bands) + 1) / (2 * bands))
    return db @ turn.T


def identity(x: np.ndarray, rate: int = 16000, size: int = 2048, hop: int = 512, bands: int = 128, n: int = 13) -> float:
    """The norm of the mean cepstrum in hundreds, at most 1: a proxy that knows no speaker. A clip without samples has 0.5."""
    if not len(x):
        return 0.5
    return min(1.0, float(np.linalg.norm(cepstra(x, rate, size, hop, bands, n).mean(axis=0))) / IDENTITY)


def flatness(x: np.ndarray, size: int = 2048, hop: int = 512) -> float:
    """Ten times the mean over frames of the geometric by the arithmetic mean of powers: a proxy, not a perceptual score. A clip without samples has 0."""
    if not len(x):
        return 0.0
    power = np.maximum(LEAST_POWER, stft(x, size, hop) ** 2)
    return float((np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)).mean()) * FLATNESS


def spectrogram(waves: DataFrame, key: str, rate: int = 16000, size: int = 2048, hop: int = 512, seconds: float = SECONDS) -> DataFrame:
    """waves: (key, x) -> (key, frame, bin, db): of the first seconds, decibels under the clip's loudest bin, -80 at least. A null or empty wave has no rows."""
    schema = f"`{key}` {waves.schema[key].dataType.simpleString()}, frame long, bin long, db double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (whole.iloc[at : at + CLIPS] for whole in parts for at in range(0, len(whole), CLIPS)):
            levels = [np.maximum(LEAST, stft(np.asarray(x, float), size, hop)) for x in p["x"]]
            places = [np.indices(a.shape).reshape(2, -1) for a in levels]
            frame, place = np.concatenate(places, axis=1)
            db = np.concatenate([np.maximum(20 * np.log10(a / a.max()), -RANGE_DB).ravel() for a in levels])
            yield pd.DataFrame({key: np.repeat(p[key].to_numpy(), [a.size for a in levels]), "frame": frame, "bin": place, "db": db})

    cut = F.slice("x", 1, int(seconds * rate))  # before Python gets the clip
    return waves.filter(F.size("x") > 0).select(key, cut.alias("x")).mapInPandas(run, schema)


def proxies(waves: DataFrame, key: str, rate: int = 16000, size: int = 2048, hop: int = 512, bands: int = 128, n: int = 13) -> DataFrame:
    """waves: (key, x) -> (key, flatness, identity). A null wave counts as empty."""
    schema = f"`{key}` {waves.schema[key].dataType.simpleString()}, flatness double, identity double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in (whole.iloc[at : at + WAVE_ROWS] for whole in parts for at in range(0, len(whole), WAVE_ROWS)):
            xs = [np.asarray([] if x is None else x, float) for x in p["x"]]
            yield pd.DataFrame({key: p[key], "flatness": [flatness(x, size, hop) for x in xs], "identity": [identity(x, rate, size, hop, bands, n) for x in xs]})

    return waves.select(key, "x").mapInPandas(run, schema)
