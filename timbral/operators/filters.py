"""Recursive filters and resampling in the time domain, in numpy: linear time, memory of a clip's own length."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, gcd

import numpy as np

#: Samples that a block of a recursive filter holds: within one, the recursion is a product of matrices.
BLOCK = 128

#: Zero crossings of the resampler's sinc on either side.
CROSSINGS = 16


@lru_cache(64)
def butterworth(rate: int, low: float, high: float, order: int = 4) -> tuple[tuple[float, float, float], ...]:
    """A band-pass as sections (g, a1, a2): g * (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2), each of gain 1 at the band's centre. order is even.

    A band that reaches the Nyquist frequency ends at .99 of it; one that starts there or is empty is an error.
    """
    high = high if high < rate / 2 else 0.99 * rate / 2
    if order % 2 or order < 2 or not 0 < low < high:
        raise ValueError(f"no band-pass of order {order} from {low} to {high} Hz at {rate} Hz")
    wl, wh = np.tan(np.pi * low / rate), np.tan(np.pi * high / rate)
    half = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (wh - wl) / 2
    root = np.sqrt(half**2 - wl * wh)
    s = np.concatenate([half + root, half - root])
    z = (1 + s) / (1 - s)
    z = z[z.imag > 0]
    centre = np.exp(-2j * np.arctan(np.sqrt(wl * wh)))
    a1, a2 = -2 * z.real, np.abs(z) ** 2
    g = np.abs((1 + a1 * centre + a2 * centre**2) / (1 - centre**2))
    return tuple(zip(g.tolist(), a1.tolist(), a2.tolist(), strict=True))


@lru_cache(256)
def _block(g: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of BLOCK samples u and a state s: y = u @ own + s @ free, next s = u @ into + s @ on."""
    step = np.array([[-a1, -a2], [1.0, 0.0]])  # rows are states, so s @ step
    enter = np.array([-a1 * g, -g - a2 * g])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ step)
    free = np.stack([p[:, 0] for p in powers[:BLOCK]], 1)
    response = np.concatenate([[g], [(enter @ p)[0] for p in powers[: BLOCK - 1]]])
    lag = np.arange(BLOCK)[None, :] - np.arange(BLOCK)[:, None]
    own = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    into = np.stack([enter @ powers[BLOCK - 1 - i] for i in range(BLOCK)])
    return own, free, into, powers[BLOCK]


def run_sections(x: np.ndarray, sections: tuple[tuple[float, float, float], ...]) -> np.ndarray:
    """x through the sections, which start as if its first sample had stood for ever."""
    n = len(x)
    y = np.pad(x, (0, -n % BLOCK)).reshape(-1, BLOCK)
    level = x[0] if n else 0.0
    for g, a1, a2 in sections:
        own, free, into, on = _block(g, a1, a2)
        state, entered = np.array([-g * level, -g * level]), y @ into
        states = np.empty((len(y), 2))
        for i in range(len(y)):
            states[i] = state
            state = entered[i] + state @ on
        y = y @ own + states @ free
        level = 0.0  # what stands for ever doesn't pass a band
    return y.reshape(-1)[:n]


def bandpass(x: np.ndarray, rate: int, low: float, high: float, order: int = 4) -> np.ndarray:
    """Butterworth, forwards and then backwards: no phase, the magnitude squared. Ends are extended oddly by 3 (2 order + 1) samples, or what there is; a single sample stays."""
    pad = min(len(x) - 1, 3 * (2 * order + 1))
    if pad < 1:
        return x
    sections = butterworth(rate, low, high, order)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = run_sections(y, sections)[::-1]
    return y[pad : pad + len(x)]


@lru_cache(512)
def _taps(up: int, down: int, phase: int, crossings: int) -> np.ndarray:
    """Of the outputs at phase / up between two inputs, for the inputs from 1 - reach to reach around: a sinc under a squared cosine, of sum 1."""
    cut = min(1.0, up / down)
    reach = ceil(crossings / cut)
    u = cut * ((phase * down % up) / up - np.arange(1 - reach, reach + 1))
    taps = np.where(np.abs(u) < crossings, np.sinc(u) * np.cos(np.pi * u / (2 * crossings)) ** 2, 0.0)
    return taps / taps.sum()


def polyphase(x: np.ndarray, rate: int, to: int, crossings: int = CROSSINGS) -> np.ndarray:
    """ceil(n * to / rate) samples, band-limited to the lower of both rates; x is 0 outside."""
    if rate == to or not len(x):
        return x
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    out = np.empty(-(-len(x) * up // down))
    reach = ceil(crossings / min(1.0, up / down))
    around = np.lib.stride_tricks.sliding_window_view(np.pad(x, (reach - 1, reach)), 2 * reach)
    for phase in range(min(up, len(out))):
        places = out[phase::up]
        places[:] = np.einsum("ij,j->i", around[phase * down // up :: down][: len(places)], _taps(up, down, phase, crossings))
    return out


def telephone(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Down to target and up again, as long as x; at the same rate nothing happens."""
    y = polyphase(polyphase(x, rate, target), target, rate)[: len(x)]
    return np.pad(y, (0, len(x) - len(y)))
