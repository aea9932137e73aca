"""Recording kernels: beat detection, delineation, spectral heart-rate features and nerve-activity features.

A recording is sequential by nature, so each is one group of applyInPandas; recordings run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.functions import dsp

REFRACTORY, SLOPE_ZONE, SEARCH_BACK = 0.2, 0.36, 1.66


def high_pass(x: np.ndarray, fs: float, corner: float = 0.08) -> np.ndarray:
    """Zero-phase high-pass of second order; a corner outside the band raises."""
    return dsp.filtfilt(dsp.butter(2, corner, fs, "high"), x)


def beat_envelope(x: np.ndarray, fs: float) -> tuple[np.ndarray, float]:
    """Envelope of the 5-15 Hz band at about 100 Hz, and its rate."""
    band = dsp.filtfilt(dsp.butter(2, (5.0, 15.0), fs, "band"), np.asarray(x, float))
    step = max(1, round(fs / 1000))
    slow = dsp.analytic_envelope(band[::step])
    again = max(1, round(fs / step / 100))
    return slow[::again], fs / step / again


def channel_delay(raw: np.ndarray, filtered: np.ndarray, fs: float, span: float = 300.0, most: float = 60.0) -> tuple[float, float]:
    """Delay of the filtered channel behind the raw one in seconds, from the envelopes of the first `span` seconds, and the correlation there; (0, 0) for less than ten seconds."""
    n = min(len(raw), len(filtered), round(span * fs))
    if n < 10 * fs:
        return 0.0, 0.0
    a, rate = beat_envelope(raw[:n], fs)
    b, _ = beat_envelope(filtered[:n], fs)
    return dsp.cross_delay(a, b, rate, most)


def lead_in(x: np.ndarray, fs: float, factor: float = 3.0, most: float = 60.0, smooth: float = 0.2, settle: float = 2.0) -> float:
    """Seconds of disturbance at the start: until the smoothed deviation from the median stays below `factor` times its steady value for `settle` seconds.

    The steady value is the median over the minute after the longest lead-in, so it doesn't depend on how much was read.
    A start that isn't disturbed gives 0, one that never settles gives `most`.
    """
    x = np.asarray(x, float)
    if len(x) < round(2 * fs):
        return 0.0
    w = max(1, round(smooth * fs))
    level = np.convolve(np.abs(x - np.median(x)), np.ones(w) / w, "same")
    lo = min(round(most * fs), max(0, len(level) - round(5 * fs)))
    steady = level[lo : lo + round(60 * fs)]
    steady = float(np.median(steady if len(steady) >= round(5 * fs) else level[len(level) // 2 :]))
    end = min(len(level), round(most * fs))
    bad = level[:end] > factor * steady
    if steady <= 0 or not end or not bad[0]:
        return 0.0
    # a clean sample ends the lead-in if the next bad one is at least the settling time away
    where = np.flatnonzero(bad)
    clean = np.flatnonzero(~bad)
    nxt = np.append(where, end + round(settle * fs))[np.searchsorted(where, clean)]
    quiet = clean[(nxt - clean >= max(1, round(settle * fs))) | (nxt >= end)]
    return float(min(quiet[0] + w, end) / fs) if len(quiet) else float(end / fs)


def filter_chain(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Band-passed signal, its slope, the square of the slope, and its moving mean over 150 ms."""
    band = dsp.filtfilt(dsp.butter(2, (5.0, 15.0), fs, "band"), x)
    slope = np.convolve(band, np.array([1.0, 2.0, 0.0, -2.0, -1.0]) / 8, "same")
    width = max(1, round(0.15 * fs))
    return {"band": band, "slope": slope, "energy": np.convolve(slope**2, np.ones(width) / width, "same")}


class Levels:
    """State of the beat decision: signal and noise levels, and the intervals that count as regular."""

    def __init__(self, signal: float, noise: float, fs: float):
        self.signal, self.noise, self.fs = signal, noise, fs
        self.beats: list[int] = []
        self.since: list[tuple[int, float, float]] = []  # peaks after the last beat
        self.recent: list[int] = []
        self.regular: list[int] = []
        self.usual: float | None = None
        self.steep = 0.0

    @property
    def threshold(self) -> float:
        return self.noise + 0.25 * (self.signal - self.noise)

    def t_wave(self, i: int, steep: float) -> bool:
        """Too soon after the last beat and less than half as steep."""
        return bool(self.beats) and i - self.beats[-1] < SLOPE_ZONE * self.fs and steep < 0.5 * self.steep

    def take(self, i: int, height: float, steep: float) -> None:
        if self.beats:
            gap = i - self.beats[-1]
            self.recent = [*self.recent, gap][-8:]
            about = self.usual or gap
            if 0.92 * about <= gap <= 1.16 * about:
                self.regular = [*self.regular, gap][-8:]
            self.usual = float(np.clip(np.mean(self.regular or self.recent), 0.3 * self.fs, 2.0 * self.fs))
        self.beats.append(i)
        self.since = [p for p in self.since if p[0] > i]
        self.signal, self.steep = 0.125 * height + 0.875 * self.signal, steep

    def pass_over(self, height: float) -> None:
        self.noise = 0.125 * height + 0.875 * self.noise

    def meet(self, i: int, height: float, steep: float, search_back: bool) -> None:
        """The next peak; a long gap before it is searched first."""
        if search_back and self.beats and self.usual and i - self.beats[-1] > SEARCH_BACK * self.usual:
            clear = max(1, round(REFRACTORY * self.fs))
            gap = [p for p in self.since if self.beats[-1] + clear <= p[0] < i - clear]
            if gap:
                best = max(gap, key=lambda p: (p[1], -p[0]))
                if best[1] > self.threshold / 2 and not self.t_wave(best[0], best[2]):
                    self.take(*best)
        if height > self.threshold and not self.t_wave(i, steep):
            self.take(i, height, steep)
        else:
            self.pass_over(height)
            if search_back:
                self.since.append((i, height, steep))


def decide(energy: np.ndarray, fs: float, search_back: bool = False) -> np.ndarray:
    """Indices of beats among the peaks of the energy, by two running levels (signal and noise) and a threshold between them.

    Peaks over five times the 99th percentile are artefacts. search_back looks into a gap of more than 1.66 usual
    intervals for the highest of all its peaks that stands a refractory time clear of both ends, is over half the
    threshold and isn't a T wave.
    """
    clear = max(1, round(REFRACTORY * fs))
    at = dsp.find_peaks(energy, clear)
    if not len(at):
        return at
    usual = energy[at] <= 5 * np.percentile(energy[at], 99)
    at = at[usual] if usual.any() else at
    early = energy[at[at < 10 * fs]]
    state = Levels(float(np.percentile(early if len(early) >= 5 else energy[at], 75)), float(np.median(energy[: max(1, int(10 * fs))])), fs)
    reach = max(1, round(0.075 * fs))
    change = np.abs(np.diff(energy))
    steep = {i: float(change[max(0, i - reach) : i].max(initial=0.0)) for i in at.tolist()}
    for i in at.tolist():
        state.meet(i, float(energy[i]), steep[i], search_back)
    return np.array(state.beats, int)


class BeatStream:
    """decide() over chunks of the energy as they arrive: push() tells the beats that later samples can't change.

    A peak is settled once no later one can be the taller within the refractory time; until then it is held back, with a
    tail of the energy. Levels start from the first ten seconds, at the first push that settles a peak after them (decide()
    takes the whole recording where these hold fewer than five peaks). Peaks above `limit` are artefacts; decide() sets that
    limit from all peaks. What is kept doesn't grow with the recording, but with search_back for the peaks since the last beat.
    """

    def __init__(self, fs: float, limit: float | None = None, search_back: bool = False):
        self.fs, self.limit, self.search_back = fs, limit, search_back
        self.base, self.tail, self.early = 0, [], []  # place of the tail's first sample; the tail; energy of the first ten seconds
        self.open: list[list] = []  # peaks: place, height, steepness, and whether it stays (None: not known yet)
        self.waiting: list[tuple[int, float, float]] = []  # settled peaks before the levels are set
        self.levels: Levels | None = None
        self.after = -1  # the last peak that is settled

    def push(self, energy: np.ndarray, last: bool = False) -> list[int]:
        """The beats (places from the first sample on) that these samples settle; last: no more will come."""
        clear, reach, ten = max(1, round(REFRACTORY * self.fs)), max(1, round(0.075 * self.fs)), int(10 * self.fs)
        if self.levels is None:
            self.early = [*self.early, *np.asarray(energy, float)[: max(1, ten) - len(self.early)].tolist()]
        x = np.concatenate([self.tail, np.asarray(energy, float)])
        end = self.base + len(x)
        seen = self.open[-1][0] if self.open else -1
        change = np.abs(np.diff(x))
        for i in dsp.find_peaks(x, 1).tolist():
            if i + self.base > seen:
                self.open.append([i + self.base, float(x[i]), float(change[max(0, i - reach) : i].max(initial=0.0)), None])
        step = np.flatnonzero(np.diff(x))
        # a peak that has begun lies after the last step that isn't flat; a new one can lie there at the earliest
        begun = int(step[-1]) if len(step) else 0
        cut = max(0, min(begun, len(x) - 1) - reach - 1)
        frontier = end if last else self.base + begun + 1
        self.tail, self.base = x[cut:].tolist(), self.base + cut
        for k in sorted(range(len(self.open)), key=lambda k: (self.open[k][1], self.open[k][0]), reverse=True):
            at, height, _, known = self.open[k]
            if known is not None:
                continue
            taller = [p[3] for p in self.open if abs(p[0] - at) < clear and (p[1], p[0]) > (height, at)]
            if any(taller):
                self.open[k][3] = False
            elif None not in taller and (last or at + clear <= frontier):
                self.open[k][3] = True
        unknown = next((k for k, p in enumerate(self.open) if p[3] is None), len(self.open))
        told = [tuple(p[:3]) for p in self.open[:unknown] if p[3]]
        done = [p for p in told if p[0] > self.after]
        if unknown:
            self.after = max(self.after, self.open[unknown - 1][0])
        edge = (self.open[unknown][0] if unknown < len(self.open) else frontier) - clear
        self.open = [p for k, p in enumerate(self.open) if k >= unknown or p[0] > edge or k == len(self.open) - 1]
        self.waiting += [p for p in done if self.limit is None or p[1] <= self.limit]
        if self.levels is None:
            if not (last or (self.waiting and self.waiting[-1][0] >= ten)):
                return []
            heights = [p[1] for p in self.waiting if p[0] < ten]
            heights = heights if len(heights) >= 5 else [p[1] for p in self.waiting]
            if not heights:
                return []
            self.levels = Levels(float(np.percentile(heights, 75)), float(np.median(self.early)), self.fs)
            self.early = []
        before = len(self.levels.beats)
        for p in self.waiting:
            self.levels.meet(*p, self.search_back)
        self.waiting = []
        beats = self.levels.beats[before:]
        self.levels.beats = self.levels.beats[-1:]
        return beats

    def dump(self) -> str:
        """The state as text; numbers keep all their digits."""
        import json

        return json.dumps(self.__dict__ | {"levels": self.levels and self.levels.__dict__})

    @classmethod
    def load(cls, text: str) -> BeatStream:
        import json

        held = json.loads(text)
        out = cls(held["fs"])
        out.__dict__.update(held)
        out.waiting = [tuple(p) for p in held["waiting"]]
        if held["levels"]:
            out.levels = Levels(0.0, 0.0, held["fs"])
            out.levels.__dict__.update(held["levels"])
            out.levels.since = [tuple(p) for p in out.levels.since]
        return out


def spans_of(x: np.ndarray, at: np.ndarray, fs: float, scale: float) -> list[tuple[int, int]]:
    """50 ms to both sides of each coarse beat on the full-rate grid."""
    half = max(1, round(0.05 * fs))
    centre = np.clip(np.rint(np.asarray(at) * scale).astype(int), 0, max(0, len(x) - 1))
    return [(max(0, c - half), min(len(x), c + half + 1)) for c in centre.tolist()]


def upright(x: np.ndarray, spans: list[tuple[int, int]]) -> bool:
    """Polarity of the whole recording: the mean height above the median at the beats is at least the mean depth."""
    if not spans:
        return True
    centre = float(np.median(x))
    return float(np.mean([x[a:b].max() - centre for a, b in spans])) >= float(np.mean([centre - x[a:b].min() for a, b in spans]))


def refine(x: np.ndarray, at: np.ndarray, fs: float, scale: float = 1.0) -> np.ndarray:
    """Extremum of the full-rate signal within 50 ms of each beat; one polarity for the whole recording."""
    if not len(at):
        return np.zeros(0, int)
    spans = spans_of(x, at, fs, scale)
    pick = np.argmax if upright(x, spans) else np.argmin
    return np.unique([a + int(pick(x[a:b])) for a, b in spans])


def detect(x: np.ndarray, fs: float, work_fs: float = 250.0, search_back: bool = False) -> np.ndarray:
    """Beats of a recording on its own sample grid."""
    x = np.nan_to_num(np.asarray(x, float))
    if len(x) < fs:
        return np.zeros(0, int)
    up, down = (int(work_fs), int(fs)) if fs != work_fs else (1, 1)
    slow = dsp.resample_poly(x, up, down) if fs != work_fs else x
    return refine(x, decide(filter_chain(slow, work_fs)["energy"], work_fs, search_back), fs, fs / work_fs)


#: What delineate() gives for each beat.
LANDMARKS = ("baseline", "q_onset", "s_offset", "t_peak", "t_end", "qrs_dur", "st_level", "t_r_ratio", "r_amp", "tpte", "qt", "snr")


def delineate(x: np.ndarray, beats: np.ndarray, fs: float, up: bool = True) -> dict[str, np.ndarray]:
    """LANDMARKS of each beat, NaN where not found; amplitudes count in the direction of the beat (up or down).

    Times are samples (q_onset to t_end) or milliseconds (qrs_dur, tpte, qt). QRS bounds are where the slope falls to 0.08
    of its greatest value in the complex; the T wave ends where the tangent at its steepest fall meets the baseline.
    """
    out = {n: np.full(len(beats), np.nan) for n in LANDMARKS}
    if len(beats) < 2:
        return out
    n, sign = len(x), 1.0 if up else -1.0
    s = lambda sec: int(sec * fs)
    gaps = np.diff(beats) / fs
    for k, (r, gap) in enumerate(zip(np.asarray(beats).tolist(), [gaps[0], *gaps.tolist()], strict=True)):
        if r < s(0.1) or r + s(0.6) >= n:
            continue
        quiet = x[r - s(0.1) : r - s(0.04)]
        base = float(np.median(quiet))
        y = lambda a, b: (x[a:b] - base) * sign  # noqa: B023, E731
        amp = float((x[r] - base) * sign)
        out["baseline"][k], out["r_amp"][k] = base, amp
        lo, hi = max(0, r - s(0.08)), min(n - 1, r + s(0.12))
        slope = np.abs(np.diff(x[lo:hi]))
        if len(slope) < 3:
            continue
        flat = slope <= 0.08 * slope.max()
        trough = lo + int(np.argmin(y(lo, r))) if r > lo else r
        # the last flat step before the Q trough (not before the first one), the first flat step after the S trough
        calm = np.flatnonzero(flat[: trough - lo])
        onset = lo + (max(int(calm[-1]) + 1, 1) if len(calm) else min(1, trough - lo))
        trough = r + int(np.argmin(y(r, hi))) if hi > r else r
        calm = np.flatnonzero(flat[trough - lo :])
        j = min(trough + int(calm[0]) if len(calm) else hi, lo + max(len(slope) - 1, trough - lo))
        out["q_onset"][k], out["s_offset"][k], out["qrs_dur"][k] = onset, j, (j - onset) / fs * 1000
        if j + s(0.06) < n:
            out["st_level"][k] = (x[j + s(0.06)] - base) * sign
        a, b = j + s(0.04), min(n - 1, r + int(min(0.6 * gap, 0.5) * fs))
        if b - a > s(0.02):
            t = a + int(np.argmax(np.abs(y(a, b))))
            out["t_peak"][k] = t
            if amp:
                out["t_r_ratio"][k] = (x[t] - base) * sign / amp
            fall = np.diff(x[t:b])
            if len(fall) > 2 and (step := fall[(i := int(np.argmin(sign * fall)))]) != 0:
                end = t + i + (base - x[t + i]) / step
                if t < end < b + s(0.1):
                    out["t_end"][k], out["tpte"][k], out["qt"][k] = end, (end - t) / fs * 1000, (end - onset) / fs * 1000
        noise, height = float(np.std(quiet)), float(np.ptp(x[lo : min(n, r + s(0.12))]))
        if noise > 0 and height > 0:
            out["snr"][k] = 20 * np.log10(height / noise)
    return out


def lf_hf(nn_ms: np.ndarray, at: np.ndarray) -> tuple[float, float, float, bool]:
    """Power of the intervals in [0.04, 0.15) and [0.15, 0.40) Hz, their ratio, and whether the span is long enough for the lower band; times that coincide have no powers."""
    if len(nn_ms) < 4:
        return math.nan, math.nan, math.nan, False
    span = at[-1] - at[0]
    grid = np.arange(at[0], at[-1], 0.25)
    if len(grid) < 8:
        return math.nan, math.nan, math.nan, False
    if not (np.diff(at) > 0).all():
        return math.nan, math.nan, math.nan, span >= 2 / 0.04
    y = dsp.cubic_spline(at, nn_ms, grid)
    i = np.arange(len(y)) - (len(y) - 1) / 2
    y = y - y.mean() - i * (i @ y / (i @ i))
    f, p = dsp.welch(y, 4.0, min(len(y), round(4 * span)))
    first, middle, last = np.searchsorted(f, (0.04, 0.15, 0.40)).tolist()
    bands = [float(np.trapezoid(p[a:b], f[a:b])) if b - a > 1 else math.nan for a, b in ((first, middle), (middle, last))]
    return bands[0], bands[1], bands[0] / bands[1] if bands[1] else math.nan, span >= 2 / 0.04


def nerve_chain(x: np.ndarray, fs: float, norm: str = "none", reference: float = 4.73, detrend: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Band-passed signal in microvolts and its rectified, integrated form at 100 Hz; detrend takes a cubic trend off first."""
    top = min(999.0, fs / 2 - 1)
    if top <= 500:
        raise ValueError(f"no band above 500 Hz at {fs} Hz")
    x = np.asarray(x, float) * 1000
    if detrend and len(x) > 4:
        t = np.linspace(-1, 1, len(x))
        x = x - np.polyval(np.polyfit(t, x, 3), t)
    band = dsp.filtfilt(dsp.butter(3, (500.0, top), fs, "band"), x).astype(np.float32).astype(float)
    if norm == "recording":
        band = band * (reference / band.std()) if band.std() > 0 else band
    elif norm != "none":
        raise ValueError(f"no such normalisation: {norm}")
    return band, dsp.resample_poly(dsp.leaky(np.abs(band), fs), 100, int(fs))


def dominant_frequency(x: np.ndarray, fs: float = 100.0) -> float:
    """Frequency of the greatest power in (0.1, 16] Hz; NaN for fewer than eight samples."""
    if len(x) < 8:
        return math.nan
    f, p = dsp.periodogram(x, fs)
    ok = (f > 0.1) & (f <= 16)
    return float(f[ok][np.argmax(p[ok])]) if ok.any() else math.nan


def rpeaks(df: DataFrame, fs: float, rec: str = "rec", idx: str = "idx", x: str = "x", search_back: bool = False) -> DataFrame:
    """Beats of every recording: rec, beat_idx, sample_idx, amp, rr (seconds). Groups without a beat give no rows. df may be recordings.Made."""
    import pandas as pd

    from pulseforge.operators.recordings import grouped

    rows, channels = grouped(df, rec, idx, [x])

    def kernel(key, pdf: pd.DataFrame) -> pd.DataFrame:
        c = channels(pdf)
        at = detect(c[x], fs, search_back=search_back)
        rr = np.concatenate([[np.nan], np.diff(at) / fs]) if len(at) else np.zeros(0)
        return pd.DataFrame({rec: [key[0]] * len(at), "beat_idx": np.arange(len(at)), "sample_idx": c[idx][at], "amp": c[x][at], "rr": rr})

    kind = dict(rows.dtypes)[rec]
    return rows.groupBy(rec).applyInPandas(kernel, f"{rec} {kind}, beat_idx long, sample_idx long, amp double, rr double")


def spectral_windows(nn: DataFrame, rec: str = "rec", w: str = "w", t: str = "t", value: str = "nn") -> DataFrame:
    """LF and HF power of each window of intervals (seconds); intervals without a time or a value take no part.

    A window is a row with its intervals, and a task takes its windows a batch at a time.
    """

    def kernel(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(2)
            at, value_ms = (x.to_numpy(zero_copy_only=False).astype(float) * unit for x, unit in zip(lists.flatten().flatten(), (1, 1000), strict=True))
            edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            told = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, v = at[lo:hi], value_ms[lo:hi]
                have = np.flatnonzero(~np.isnan(x) & ~np.isnan(v))
                order = have[np.argsort(x[have], kind="stable")]
                told.append(lf_hf(v[order], x[order]))
            powers = [pa.array(np.array(c, float), from_pandas=True) for c in list(zip(*told, strict=True))[:3]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *powers, pa.array([bool(r[3]) for r in told])], names=[rec, w, "LF_power", "HF_power", "LF_HF_ratio", "lf_reliable"])

    kinds = dict(nn.dtypes)
    rows = nn.groupBy(rec, w).agg(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"))).alias("x"))
    return rows.mapInArrow(kernel, f"{rec} {kinds[rec]}, {w} {kinds[w]}, LF_power double, HF_power double, LF_HF_ratio double, lf_reliable boolean")
