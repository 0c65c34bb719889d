"""Signal functions on ARRAY<DOUBLE> columns, as higher-order expressions (no Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, not once per element of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(power(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def clip(x: Column, most: float) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), v)))


def scale(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def normalise(x: Column, db: float = -20.0) -> Column:
    """To a level in dB RMS; silence stays."""
    return let(x, lambda y: let(rms(y), lambda r: F.when(r > 0, scale(y, F.lit(10.0 ** (db / 20)) / r)).otherwise(y)))


def limit_peak(x: Column, over: float, to: float) -> Column:
    return let(x, lambda y: let(peak(y), lambda p: F.when(p > over, scale(y, F.lit(to) / p)).otherwise(y)))


def mix(signal: Column, noise: Column, snr_db: Column, offset: Column | int = 0) -> Column:
    """noise, repeated to length from an offset, under signal at a ratio in dB; unchanged if either is silent."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    laid = F.transform(F.sequence(F.lit(0), F.size(signal) - 1), lambda i: F.element_at(noise, ((i + offset) % F.size(noise) + 1).cast("int")))

    def mixed(n: Column) -> Column:
        rs, rn = rms(signal), rms(n)
        by = let(rs / (F.nullif(rn, F.lit(0.0)) * F.pow(F.lit(10.0), snr_db / 20.0)), lambda k: F.zip_with(signal, n, lambda s, m: s + m * k))
        return F.when((rs > 0) & (rn > 0), limit_peak(by, 1.0, 0.99)).otherwise(signal)

    return let(laid, mixed)


def quantise(x: Column, bits: int) -> Column:
    """Levels are rounded half to even."""
    half = float(2**bits) / 2
    return clip(F.transform(x, lambda v: F.rint(v * half) / half), 1.0)


def drop_packets(x: Column, lost: Column, packet: int) -> Column:
    """lost: ARRAY<BOOLEAN> by packet. A last packet that isn't full is never lost."""
    full = F.floor(F.size(x) / packet)
    return F.transform(x, lambda v, i: F.when((F.floor(i / packet) < full) & F.coalesce(F.get(lost, F.floor(i / packet).cast("int")), F.lit(False)), F.lit(0.0)).otherwise(v))


def _taps(x: Column, h: Column, shift: Column | int) -> Column:
    """Sum over k of h[k] * x[i + shift - k], x being 0 outside."""
    places = F.sequence(F.lit(0), F.size(h) - 1)
    at = lambda i, k: F.when((i + shift - k >= 0) & (i + shift - k < F.size(x)), F.element_at(x, i + shift - k + 1)).otherwise(F.lit(0.0))
    return let(places, lambda ks: F.transform(x, lambda _, i: F.aggregate(ks, F.lit(0.0), lambda a, k: a + F.element_at(h, k + 1) * at(i, k))))


def convolve_same(x: Column, h: Column) -> Column:
    """The middle of the full convolution, as long as x, to a peak of .99. For short h; operators.kernels has the FFT."""
    return let(h, lambda g: limit_peak(_taps(x, g, F.floor((F.size(g) - 1) / 2).cast("int")), 0.0, 0.99))


def fir(x: Column, taps: Column) -> Column:
    """Causal filter by taps of unit absolute sum."""
    return let(let(total(F.transform(taps, F.abs)), lambda n: F.transform(taps, lambda t: t / n)), lambda unit: _taps(x, unit, 0))


def saturate(x: Column, alpha: Column) -> Column:
    """tanh, then to a peak of .99; silence is an error of division in the source of this rule and stays silence here."""
    return limit_peak(F.transform(x, lambda v: F.tanh(v * alpha)), 0.0, 0.99)


def snr_db(signal: Column, noise: Column) -> Column:
    pn = power(noise)
    return F.when(pn == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(power(signal) / F.when(pn != 0, pn)))


def pad_to(x: Column, n: Column, fill: float = 0.0) -> Column:
    return F.when(F.size(x) >= n, F.slice(x, 1, n)).otherwise(F.concat(x, F.array_repeat(F.lit(fill), F.greatest(n - F.size(x), F.lit(0)).cast("int"))))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
