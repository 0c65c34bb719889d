"""Filters, resampling and spectra: closed forms, recursions sample by sample, clips that are short, silent, empty or null."""

from __future__ import annotations

import numpy as np
import pytest

from tests.harness import session
from timbral.operators import filters, kernels, spectra


@pytest.fixture(scope="module")
def spark():
    return session()


def tone(hz, rate=16000, n=16000):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def recursion(x, sections):
    level = x[0]
    for g, a1, a2 in sections:
        s = r = -g * level
        level, out = 0.0, []
        for u in x:
            y = g * u + s
            s, r = -a1 * y + r, -g * u - a2 * y
            out.append(y)
        x = out
    return np.array(x)


@pytest.mark.parametrize(("rate", "low", "high", "order"), [(16000, 300, 3400, 4), (8000, 300, 4000, 4), (44100, 20, 12000, 6), (16000, 900, 1100, 2)])
def test_butterworth(rate, low, high, order):
    """The squared magnitude is that of the design's formula; all poles lie within the circle."""
    sections = filters.butterworth(rate, low, high, order)
    high = high if high < rate / 2 else 0.99 * rate / 2
    f = np.linspace(1, rate / 2 - 1, 400)
    z = np.exp(-2j * np.pi * f / rate)
    response = np.prod([g * (1 - z**2) / (1 + a1 * z + a2 * z**2) for g, a1, a2 in sections], axis=0)
    w, wl, wh = (np.tan(np.pi * v / rate) for v in (f, low, high))
    assert np.allclose(np.abs(response) ** 2, 1 / (1 + ((w**2 - wl * wh) / (w * (wh - wl))) ** (2 * order)), atol=1e-9)
    assert all(a2 < 1 and abs(a1) < 1 + a2 for _, a1, a2 in sections)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000])
def test_sections(n):
    x = np.random.default_rng(n).standard_normal(n)
    sections = filters.butterworth(16000, 300, 3400)
    assert np.allclose(filters.run_sections(x, sections), recursion(x, sections), atol=1e-11)


def test_bandpass_has_no_phase_and_bears_short_clips():
    x = tone(1000)
    assert np.allclose(kernels.bandpass(x, 16000)[500:-500], x[500:-500], atol=1e-3)
    assert np.allclose(kernels.bandpass(np.full(400, 0.7), 16000), 0, atol=1e-9)
    for n in (0, 1):
        assert np.array_equal(kernels.bandpass(np.full(n, 0.3), 16000), np.full(n, 0.3))
    for n in (2, 5, 27, 28):
        assert np.isfinite(kernels.bandpass(x[:n], 16000)).all() and len(kernels.bandpass(x[:n], 16000)) == n
    for wrong in ((16000, 3400, 300, 4), (16000, 300, 3400, 3), (400, 300, 3400, 4), (16000, 0, 3400, 4)):
        with pytest.raises(ValueError, match="band-pass"):
            filters.butterworth(*wrong)


@pytest.mark.parametrize("to", [8000, 11025, 22050, 44100, 48000])
def test_polyphase(to):
    """A tone keeps its samples' values at the new rate, a level keeps its value, a tone beyond the new band goes."""
    y = filters.polyphase(tone(440), 16000, to)
    assert len(y) == -(-16000 * to // 16000)
    assert np.abs(y - tone(440, to, len(y)))[400:-400].max() < 2e-4
    assert np.allclose(filters.polyphase(np.ones(2000), 16000, to)[200:-200], 1)
    if to < 16000:
        assert np.abs(filters.polyphase(tone(to / 2 + 1500), 16000, to))[400:-400].max() < 1e-3
    assert [len(filters.polyphase(np.ones(n), 16000, to)) for n in (0, 1, 3)] == [0, -(-to // 16000), -(-3 * to // 16000)]


def test_telephone():
    x = tone(440)
    assert np.array_equal(filters.telephone(x, 16000, 16000), x)
    assert np.abs(filters.telephone(x, 16000, 8000) - x)[400:-400].max() < 1e-4
    assert len(filters.telephone(x[:101], 16000, 8000)) == 101


def test_mapped(spark):
    """A kernel of one's own, with a column beside the wave; null and empty waves have empty results."""
    rows = spark.createDataFrame([(1, 2.0, [1.0, 2.0]), (2, 3.0, []), (3, 4.0, None)], "clip long, k double, x array<double>")
    got = {r.clip: r.y for r in kernels.mapped(rows, lambda r: r.x * r.k, "clip").collect()}
    assert got == {1: [2.0, 4.0], 2: [], 3: []}


def test_spectrogram(spark):
    """The loudest bin is the tone's; only the first seconds count; nothing is below -80; null and empty waves have no rows, silence is level."""
    x = [*tone(1000, n=8000).tolist(), *tone(3000, n=8000).tolist()]
    rows = spark.createDataFrame([("a", x), ("b", []), ("c", None), ("d", [0.0] * 100)], "clip string, x array<double>")
    got = spectra.spectrogram(rows, "clip", 16000, 512, 256, seconds=0.5).cache()
    assert {r.clip for r in got.select("clip").distinct().collect()} == {"a", "d"}
    assert {r.bin for r in got.filter("clip = 'a' and db > -1").collect()} == {32}
    assert got.filter("clip = 'a'").agg({"frame": "max"}).first()[0] == 8000 // 256
    assert got.filter("db < -80 or db > 0").count() == 0 and got.filter("clip = 'd' and db <> 0").count() == 0


def test_proxies(spark):
    noise = np.random.default_rng(1).standard_normal(16000).tolist()
    rows = spark.createDataFrame([("tone", tone(1000).tolist()), ("noise", noise), ("empty", []), ("null", None)], "clip string, x array<double>")
    got = {r.clip: r for r in spectra.proxies(rows, "clip").collect()}
    assert got["tone"].flatness < 0.1 < 4 < got["noise"].flatness < 7
    assert (got["empty"].flatness, got["empty"].identity) == (got["null"].flatness, got["null"].identity) == (0.0, 0.5)
    assert all(0 <= r.identity <= 1 for r in got.values())


def test_mel_scale():
    hz = np.array([0.0, 200.0, 1000.0, 6400.0])
    assert np.allclose(spectra.mel(hz), [0, 3, 15, 42]) and np.allclose(spectra.unmel(spectra.mel(hz)), hz)
    bank = spectra.mel_bank(16000, 2048, 20)
    assert np.allclose(bank.sum(axis=1) * 16000 / 2048, 1, atol=0.1)
