"""Signal kernels in numpy, from their public definitions: Butterworth filters, zero-phase filtering, resampling, spectra, peaks and splines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def butter(order: int, corner: float | tuple[float, float], fs: float, kind: str = "low") -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a digital Butterworth filter, by the bilinear transform of its analogue prototype."""
    edges = np.atleast_1d(np.asarray(corner, float))
    if (edges <= 0).any() or (edges >= fs / 2).any() or len(edges) != (2 if kind == "band" else 1):
        raise ValueError(f"no such corner at {fs} Hz: {corner}")
    warped = 2 * fs * np.tan(np.pi * edges / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        p, z, at = poles * warped[0], np.zeros(0, complex), 0.0
    elif kind == "high":
        p, z, at = warped[0] / poles, np.zeros(order, complex), math.inf
    else:
        width, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half * half - centre * centre)
        p, z, at = np.concatenate([half + root, half - root]), np.zeros(order, complex), centre
    pd = (2 * fs + p) / (2 * fs - p)
    zd = np.concatenate([(2 * fs + z) / (2 * fs - z), -np.ones(len(p) - len(z))])
    where = np.exp(1j * (0 if at == 0 else np.pi if at == math.inf else 2 * math.atan(at / (2 * fs))))
    gain = 1 / abs(np.prod(where - zd) / np.prod(where - pd))
    pairs = sorted([q for q in pd if q.imag > 1e-12], key=lambda q: -abs(q)) + [None] * 0
    real = sorted([q.real for q in pd if abs(q.imag) <= 1e-12])
    sections = [np.array([1.0, -2 * q.real, abs(q) ** 2]) for q in pairs] + [np.array([1.0, -real[i] - real[i + 1], real[i] * real[i + 1]]) for i in range(0, len(real) - 1, 2)] + ([np.array([1.0, -real[-1], 0.0])] if len(real) % 2 else [])
    zeros = sorted(np.round(zd.real, 12).tolist())
    tops = []
    for a in sections:
        n = 2 if a[2] else 1
        own = [zeros.pop(0)] + ([zeros.pop(-1)] if n == 2 else [])
        tops.append(np.array([1.0, -sum(own), own[0] * own[1] if n == 2 else 0.0]))
    tops[0] = tops[0] * gain
    return [np.concatenate([b, a]) for b, a in zip(tops, sections, strict=True)]


def response(sections: list[np.ndarray], f: np.ndarray, fs: float) -> np.ndarray:
    """Complex frequency response."""
    z = np.exp(-2j * np.pi * np.asarray(f, float) / fs)
    out = np.ones_like(z)
    for s in sections:
        out = out * (s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z)
    return out


def _biquad(s: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    return section(s, x, state)[0]


#: Samples of a block of the recursion.
BLOCK = 32


@lru_cache(maxsize=64)
def _block(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A block's response to its samples (a matrix), to the two numbers of the state before it, and how these move the state after it."""
    told = []
    for impulse, z0, z1 in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)):
        row = []
        for i in range(BLOCK):
            v = impulse if i == 0 else 0.0
            y = b0 * v + z0
            z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
            row.append(y)
        told.append((row, z0, z1))
    h = np.array(told[0][0])
    lag = np.arange(BLOCK)[None, :] - np.arange(BLOCK)[:, None]
    return np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0), np.array([told[1][0], told[2][0]]), [told[1][1], told[2][1], told[1][2], told[2][2]]


def section(s: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section's output and last state. All blocks' responses to their samples are one matrix product; only the two numbers of the state go from block to block."""
    b0, b1, b2, _, a1, a2 = s.tolist()
    own, free, (m00, m01, m10, m11) = _block(b0, b1, b2, a1, a2)
    x = np.asarray(x, float)
    n = len(x)
    whole = n // BLOCK
    z0, z1 = map(float, state)
    out = np.empty(n)
    if whole:
        v = x[: whole * BLOCK].reshape(whole, BLOCK)
        y = v @ own
        adds0 = (b1 * v[:, -1] - a1 * y[:, -1] + b2 * v[:, -2] - a2 * y[:, -2]).tolist()
        adds1 = (b2 * v[:, -1] - a2 * y[:, -1]).tolist()
        before = []
        for p, q in zip(adds0, adds1, strict=True):
            before.append((z0, z1))
            z0, z1 = m00 * z0 + m01 * z1 + p, m10 * z0 + m11 * z1 + q
        y += np.array(before) @ free
        out[: whole * BLOCK] = y.ravel()
    for i, v in enumerate(x[whole * BLOCK :].tolist(), whole * BLOCK):
        y = b0 * v + z0
        z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
        out[i] = y
    return out, np.array([z0, z1])


def cascade(sections: list[np.ndarray], x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and last state (two numbers for each section) of all sections after each other, from a state."""
    y, out = np.asarray(x, float), np.empty(2 * len(sections))
    for k, s in enumerate(sections):
        y, out[2 * k : 2 * k + 2] = section(s, y, state[2 * k : 2 * k + 2])
    return y, out


def steady_state(sections: list[np.ndarray], level: float) -> np.ndarray:
    """The state in which each section would be if the input had been `level` forever."""
    out = np.empty(2 * len(sections))
    for k, s in enumerate(sections):
        b, a = s[:3], s[3:]
        gain = b.sum() / a.sum() if abs(a.sum()) > 1e-300 else 0.0
        z1 = b[2] - a[2] * gain
        out[2 * k : 2 * k + 2] = np.array([b[1] - a[1] * gain + z1, z1]) * level
        level = gain * level
    return out


def sosfilt(sections: list[np.ndarray], x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Filter once; steady starts each section as if x[0] had lasted forever."""
    y = np.asarray(x, float)
    for s in sections:
        b, a = s[:3], s[3:]
        state = np.zeros(2)
        if steady and len(y):
            level = b.sum() / a.sum() if abs(a.sum()) > 1e-300 else 0.0
            z1 = b[2] - a[2] * level
            state = np.array([b[1] - a[1] * level + z1, z1]) * y[0]
        y = _biquad(s, y, state)
    return y


def filtfilt(sections: list[np.ndarray], x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Zero-phase filtering with odd extension; a recording shorter than the extension gets a shorter one."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return x.copy()
    pad = min(3 * (2 * len(sections) + 1) if pad is None else pad, len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = sosfilt(sections, wide, True)
    back = sosfilt(sections, once[::-1], True)[::-1]
    return back[pad : pad + len(x)]


def resample_poly(x: np.ndarray, up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """Rational resampling by a Kaiser-windowed low-pass of half-length 10 max(up, down)."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    x = np.asarray(x, float)
    if up == down == 1 or not len(x):
        return x.copy()
    most = max(up, down)
    half = 10 * most
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / most) / most * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    size, reach = -(-len(x) * up // down), -(-(2 * half + 1) // up)
    wide = np.concatenate([np.zeros(reach), x, np.zeros(half // up + down + 1)])
    out = np.empty(size)
    for phase in range(min(up, size)):
        # outputs at every up-th place use the same taps, on input samples that lie `down` apart
        newest, tap = divmod(phase * down + half, up)
        own = taps[tap::up][::-1]
        count = -(-(size - phase) // up)
        first = newest + reach - len(own) + 1
        out[phase::up] = np.lib.stride_tricks.sliding_window_view(wide[first : first + (count - 1) * down + len(own)], len(own))[::down] @ own
    return out


def resample_fft(x: np.ndarray, n: int) -> np.ndarray:
    """Band-limited resampling to n samples."""
    x = np.asarray(x, float)
    if len(x) < 2:
        return np.zeros(n)
    if len(x) == n:
        return x.copy()
    spec = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(x), n)
    out[: m // 2 + 1] = spec[: m // 2 + 1]
    if m % 2 == 0:
        out[m // 2] *= 2.0 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    spec = np.zeros(n, complex)
    spec[: n // 2 + 1] = np.fft.rfft(x)
    spec[1 : (n + 1) // 2] *= 2
    return np.abs(np.fft.ifft(spec))


def periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density, mean removed."""
    x = np.asarray(x, float) - np.mean(x)
    p = np.abs(np.fft.rfft(x)) ** 2 / (fs * len(x))
    p[1 : len(p) - (len(x) % 2 == 0)] *= 2
    return np.fft.rfftfreq(len(x), 1 / fs), p


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged density of half-overlapping Hann segments, each with its mean removed."""
    x = np.asarray(x, float)
    size = min(size, len(x))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(1, size - size // 2)
    rows = []
    for lo in range(0, len(x) - size + 1, step):
        s = x[lo : lo + size]
        p = np.abs(np.fft.rfft((s - s.mean()) * win)) ** 2 / (fs * (win**2).sum())
        p[1 : len(p) - (size % 2 == 0)] *= 2
        rows.append(p)
    return np.fft.rfftfreq(size, 1 / fs), np.mean(rows, 0)


def find_peaks(x: np.ndarray, distance: int = 1) -> np.ndarray:
    """Local maxima (middle of plateaus) at least `distance` apart; the taller one stays."""
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    step = np.sign(np.diff(x))
    at = np.flatnonzero(step)
    rise = np.flatnonzero((step[at[:-1]] > 0) & (step[at[1:]] < 0)) if len(at) > 1 else np.zeros(0, int)
    peaks = (at[rise] + 1 + at[rise + 1]) // 2
    if distance <= 1:
        return peaks
    keep = np.ones(len(peaks), bool)
    lo, hi = (np.searchsorted(peaks, peaks + d).tolist() for d in (1 - distance, distance))
    for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
        if keep[k]:
            keep[lo[k] : hi[k]] = False
            keep[k] = True
    return peaks[keep]


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot interpolation, from four points on; x and at ascend. The ends' conditions are put into the next rows, which leaves three diagonals."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    h = np.diff(x)
    d = np.diff(y) / h
    b = 6 * np.diff(d)
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    mid[0], up[0], b[0] = h[0] + 2 * h[1], h[1] - h[0], b[0] * h[1] / (h[0] + h[1])
    mid[-1], low[-1], b[-1] = h[-1] + 2 * h[-2], h[-2] - h[-1], b[-1] * h[-2] / (h[-1] + h[-2])
    low, mid, up, b = low.tolist(), mid.tolist(), up.tolist(), b.tolist()
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        b[i] -= f * b[i - 1]
    b[-1] /= mid[-1]
    for i in range(n - 4, -1, -1):
        b[i] = (b[i] - up[i] * b[i + 1]) / mid[i]
    m = np.array([b[0] + (b[0] - b[1]) * h[0] / h[1], *b, b[-1] + (b[-1] - b[-2]) * h[-1] / h[-2]])
    # the points at[...] of an interval are consecutive; those outside belong to the first and last one
    edges = np.searchsorted(at, x[1:-1], "left")
    count = np.diff(edges, prepend=0, append=len(at))
    u = at - np.repeat(x[:-1], count)
    third, second, first = (m[1:] - m[:-1]) / (6 * h), m[:-1] / 2, d - h * (2 * m[:-1] + m[1:]) / 6
    return ((np.repeat(third, count) * u + np.repeat(second, count)) * u + np.repeat(first, count)) * u + np.repeat(y[:-1], count)


def leaky(x: np.ndarray, fs: float, tau: float = 0.01) -> np.ndarray:
    """Leaky integrator y[n] = a x[n] + (1 - a) y[n - 1], a = dt / (tau + dt)."""
    a = 1 / fs / (tau + 1 / fs)
    return sosfilt([np.array([a, 0.0, 0.0, 1.0, -(1 - a), 0.0])], x)


def cross_delay(x: np.ndarray, y: np.ndarray, fs: float, most: float) -> tuple[float, float]:
    """Delay of y behind x in seconds within `most`, and the correlation there."""
    x, y = np.asarray(x, float) - np.mean(x), np.asarray(y, float) - np.mean(y)
    n = 1 << (len(x) + len(y) - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(y, n) * np.conj(np.fft.rfft(x, n)), n)
    lags = np.arange(-min(int(most * fs), len(x) - 1), min(int(most * fs), len(y) - 1) + 1)
    k = int(np.argmax(c[lags]))
    norm = math.sqrt((x @ x) * (y @ y))
    return lags[k] / fs, float(c[lags[k]] / norm) if norm else 0.0
