"""Features of one window of samples in numpy; the same definitions as the DataFrame forms in operators/windows."""

from __future__ import annotations

import math

import numpy as np

NAN = math.nan


def ratio(a: float, b: float) -> float:
    return float(a / b) if b and math.isfinite(b) else NAN


def hjorth(x: np.ndarray) -> tuple[float, float]:
    """Mobility and complexity; NaN where a variance is 0."""
    if len(x) < 3:
        return NAN, NAN
    v0, v1, v2 = (float(np.var(np.diff(x, k))) for k in range(3))
    mobility = math.sqrt(ratio(v1, v0)) if v0 > 0 else NAN
    return mobility, (math.sqrt(v2 / v1) / mobility if v1 > 0 and mobility > 0 else NAN)


def higuchi(x: np.ndarray, kmax: int = 10) -> float:
    """Fractal dimension; a straight line gives 1."""
    n, ks, lengths = len(x), [], []
    for k in range(1, kmax + 1):
        if n < 2 * k:
            continue
        parts = []
        for m in range(k):
            steps = np.abs(np.diff(x[m::k]))
            if len(steps):
                parts.append(steps.sum() * (n - 1) / (len(steps) * k * k))
        if parts and np.mean(parts) > 0:
            ks.append(k)
            lengths.append(float(np.mean(parts)))
    return float(np.polyfit(-np.log(ks), np.log(lengths), 1)[0]) if len(ks) > 1 else NAN


def entropy(x: np.ndarray, bins: int = 64) -> float:
    """Bits over equal bins from the least to the greatest value."""
    if not len(x) or not np.isfinite(x).all() or x.max() <= x.min():
        return NAN
    at = np.minimum(((x - x.min()) / (x.max() - x.min()) * bins).astype(int), bins - 1)
    p = np.bincount(at, minlength=bins) / len(x)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def autocorrelation(x: np.ndarray, lag: int) -> float:
    c = x - x.mean() if len(x) else x
    return ratio(float(c[:-lag] @ c[lag:]), float(c @ c)) if len(x) > lag else NAN


def intervals(nn: np.ndarray) -> dict[str, float]:
    """meanNN, SDNN, RMSSD and the Poincaré ratio of intervals."""
    if len(nn) < 2:
        return {}
    d = np.diff(nn)
    out = {"meanNN": float(nn.mean()), "SDNN": float(nn.std(ddof=1)), "RMSSD": float(math.sqrt((d * d).mean()))}
    if len(nn) >= 3:
        short = float(d.std(ddof=1)) * math.sqrt(0.5)
        rest = 2 * float(nn.var(ddof=1)) - short * short
        out["SD1_SD2"] = short / math.sqrt(rest) if rest > 0 else NAN
    return out


def amplitude(x: np.ndarray, seconds: float, theta: float = 1.0) -> dict[str, float]:
    """The ten amplitude features of a bipolar signal."""
    size, d = np.abs(x), np.diff(x)
    rms = float(math.sqrt((x * x).mean()))
    c, sd = size - size.mean(), float(size.std())
    return {
        "aSKNA": float(size.mean()),
        "varSKNA": float(x.var()),
        "rmsSKNA": rms,
        "skewSKNA": float((c**3).mean() / sd**3) if sd > 0 else NAN,
        "kurtSKNA": float((c**4).mean() / sd**4 - 3) if sd > 0 else NAN,
        "wlSKNA": float(np.abs(d).sum() / seconds),
        "zcSKNA": float(((x[1:] < 0) != (x[:-1] < 0)).sum() / seconds),
        "sscSKNA": float((d[:-1] * d[1:] < 0).sum() / seconds),
        "wampSKNA": float(np.abs(d)[np.abs(d) > theta].sum() / seconds),
        "cfSKNA": ratio(float(size.max()), rms),
    }


def fixed_length(x: np.ndarray, n: int, how: str = "fft") -> np.ndarray:
    """n samples of a segment: band-limited (fft) or linear (interp); a segment of fewer than two samples gives zeros."""
    from pulseforge.functions import dsp

    if len(x) < 2:
        return np.zeros(n)
    if len(x) == n:
        return np.array(x, float)
    if how == "fft":
        return dsp.resample_fft(x, n)
    if how == "interp":
        return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
    raise ValueError(f"no such resampling: {how}")
