"""Whole recordings: beats with their clock, window tables of 19 and 11 features, and beat vectors.

A recording is one group of applyInPandas, and recordings run in parallel. A recording that fails gives one row whose
`status` tells why, so the others aren't lost; rows of a recording that works have the status ok. Inputs have a row for
each sample: rec, sample_idx and the channels; or they are Made.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.functions import dsp, kernels, steps
from pulseforge.functions.stats import quantile
from pulseforge.operators import signals

# Names and order of the feature tables' columns.
ECG_FEATURES = [
    "mobility", "complexity", "fractal_dimension", "entropy", "autocorrelation", "meanNN", "SDNN", "RMSSD", "LF_power", "HF_power",
    "LF_HF_ratio", "SD1_SD2", "TpTe", "QTc_Fridericia", "QRS_duration", "ST_level", "T_R_ratio", "R_slope", "beat_SNR",
]
NERVE_FEATURES = ["aSKNA", "varSKNA", "rmsSKNA", "skewSKNA", "kurtSKNA", "wlSKNA", "zcSKNA", "sscSKNA", "wampSKNA", "cfSKNA", "dfSKNA"]
GRID = "window_idx long, t_start_sec double, t_center_sec double, t_raw_center_sec double"
#: Rate of the analysis signal, and the heart rates that count.
ANALYSIS_FS, HR_LEAST, HR_MOST = 500.0, 30.0, 200.0


@dataclass(frozen=True)
class Made:
    """Recordings whose samples are made in the task that needs them, so that neither a shuffle nor a sort carries samples.

    rows has a few rows for each recording, which `order` puts in order; make(columns by name, channels wanted) gives the
    channels' samples of such rows, one row's after the other's. span (columns, needed by split.chunked alone) is the place of a
    row's first sample and their number. Operators take one wherever they take a row for each sample.
    """

    rows: DataFrame
    order: str
    columns: list[str]
    make: Callable
    span: tuple[str, str] | None = None


def grouped(df: DataFrame | Made, rec: str, idx: str, cols: list[str]) -> tuple[DataFrame, Callable]:
    """Rows for a group of each recording, and a function from a group's pandas table to its channels with `idx`, in order."""
    if isinstance(df, Made):
        order, columns, make = df.order, df.columns, df.make

        def channels(pdf):
            pdf = pdf.sort_values(order)
            out = make({c: pdf[c].to_numpy() for c in columns}, cols)
            return out | {idx: np.arange(len(next(iter(out.values()))))}

        return df.rows.select(*dict.fromkeys([rec, order, *columns])), channels

    def read(pdf):
        pdf = pdf.sort_values(idx)
        return {c: pdf[c].to_numpy() for c in [*cols, idx]}

    return df.select(rec, idx, *cols), read


def each_recording(df: DataFrame | Made, rec: str, idx: str, cols: list[str], schema: str, kernel: Callable) -> DataFrame:
    """kernel(samples by column name, in order) -> list of dicts, for each recording, as rec, the schema's columns and status."""
    import pandas as pd

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    rows, channels = grouped(df, rec, idx, cols)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        held = channels(pdf)
        try:
            rows = kernel({c: np.nan_to_num(held[c].astype(float)) for c in cols})
            status = "ok"
        except Exception as e:  # one bad recording must not end the others
            rows, status = [dict.fromkeys(names)], f"{type(e).__name__}: {e}"[:200]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        out.insert(0, rec, key[0])
        out["status"] = status
        return out

    return rows.groupBy(rec).applyInPandas(run, f"{rec} {dict(rows.dtypes)[rec]}, {schema}, status string")


def clock_offset(delay: Column, start: Column, lead_in: Column) -> Column:
    """What is added to a time of the analysed signal to get the raw recording's time."""
    return delay + start + lead_in


def first_beats(x: np.ndarray, raw: np.ndarray | None, fs: float, start: float, trim: bool, corner: float | None, search_back: bool) -> dict:
    """Delay, lead-in, clock offset, polarity and beats of one recording. Beats count from the analysed signal's start."""
    delay, r = signals.channel_delay(raw, x, fs) if raw is not None else (0.0, 0.0)
    delay = delay if r >= 0.5 and delay > 0 else 0.0
    x = x[round(delay * fs) + round(start * fs) :]
    lead = signals.lead_in(x, fs) if trim else 0.0
    x = x[round(lead * fs) :]
    if len(x) < 2 * fs:
        raise ValueError("less than two seconds of signal")
    x = signals.high_pass(x, fs, corner) if corner else x
    beats = signals.detect(x, fs, search_back=search_back)
    if len(beats) < 3:
        raise ValueError(f"only {len(beats)} beats")
    return {"x": x, "beats": beats, "upright": signals.upright(x, signals.spans_of(x, beats, fs, 1.0)), "delay_sec": delay, "delay_r": r, "leadin_sec": lead, "clock_offset_sec": delay + start + lead}


def stage_one(df: DataFrame | Made, fs: float, rec: str = "rec", idx: str = "sample_idx", x: str = "ecg", raw: str | None = None, start: float = 0.0, trim_lead_in: bool = False, corner: float | None = 0.08, search_back: bool = False) -> DataFrame:
    """Beats of every recording with its clock: rec, delay_sec, delay_r, leadin_sec, clock_offset_sec, upright, n_samples, beats (array of sample numbers), status.

    With a raw channel the delay of x behind it is estimated and taken off if their correlation is at least a half.
    """

    def kernel(c):
        got = first_beats(c[x], c[raw] if raw else None, fs, start, trim_lead_in, corner, search_back)
        return [{k: got[k] for k in ("delay_sec", "delay_r", "leadin_sec", "clock_offset_sec", "upright")} | {"n_samples": len(got["x"]), "beats": got["beats"].tolist()}]

    schema = "delay_sec double, delay_r double, leadin_sec double, clock_offset_sec double, upright boolean, n_samples long, beats array<long>"
    return each_recording(df, rec, idx, [x, *([raw] if raw else [])], schema, kernel)


def beat_rows(stage: DataFrame, fs: float, rec: str = "rec") -> DataFrame:
    """A row for each beat of stage_one(): rec, idx, t (seconds), t_raw, nn (interval before, seconds; null for the first)."""
    rows = stage.where("status = 'ok'").select(rec, "clock_offset_sec", F.posexplode("beats").alias("idx", "at"))
    t = F.col("at") / F.lit(float(fs))
    w = Window.partitionBy(rec).orderBy("idx")
    return rows.select(rec, F.col("idx").cast("long").alias("idx"), t.alias("t"), (t + F.col("clock_offset_sec")).alias("t_raw"), (t - F.lag(t).over(w)).alias("nn"))


def quality_report(stage: DataFrame, fs: float, rec: str = "rec") -> DataFrame:
    """By recording: beats, heart rate and intervals within 30-200 per minute, duration of two intervals, status; and the length that suits the longest 99th percentile of all recordings."""
    from pulseforge.operators import windows

    stage = steps.cut(stage, "stage")  # read three times below
    nn = beat_rows(stage, fs, rec).where("nn is not null").withColumnRenamed(rec, "rec")
    stats = windows.beat_stats(nn, 60 / HR_MOST, 60 / HR_LEAST).withColumnRenamed("rec", rec)
    top = stats.agg(F.max("p99").alias("longest"))
    length = (F.ceil(F.ceil(F.col("longest") * fs) / 256) * 256).cast("long")
    rows = stage.select(rec, "status", F.size("beats").alias("n_beats"), "delay_sec", "leadin_sec").join(stats, rec, "left").join(F.broadcast(top))  # one row
    return rows.withColumns({"mean_hr": 60.0 / F.col("mean"), "length": length}).drop("longest")


def ecg_window(seg: np.ndarray, fs: float, beats: np.ndarray, marks: dict[str, np.ndarray]) -> dict:
    """The 19 features of one window, n_beats and lf_reliable; beats are those inside, with their landmarks."""
    out: dict = dict.fromkeys(ECG_FEATURES, math.nan)
    out["mobility"], out["complexity"] = kernels.hjorth(seg)
    out |= {"fractal_dimension": kernels.higuchi(seg), "entropy": kernels.entropy(seg), "autocorrelation": kernels.autocorrelation(seg, max(1, round(0.05 * fs)))}
    out |= {"n_beats": len(beats), "lf_reliable": False}
    if len(beats) < 3:
        return out
    rr = np.diff(beats) / fs
    ok = (60 / rr >= HR_LEAST) & (60 / rr <= HR_MOST)
    if ok.sum() >= 2:
        out |= kernels.intervals(rr[ok] * 1000)
        out["LF_power"], out["HF_power"], out["LF_HF_ratio"], reliable = signals.lf_hf(rr[ok] * 1000, beats[1:][ok] / fs)
        out["lf_reliable"] = bool(reliable)
    middle = lambda v: float(np.median(v[np.isfinite(v)])) if np.isfinite(v).any() else math.nan
    out |= {n: middle(marks[k]) for n, k in (("TpTe", "tpte"), ("QRS_duration", "qrs_dur"), ("ST_level", "st_level"), ("T_R_ratio", "t_r_ratio"), ("beat_SNR", "snr"))}
    out["QTc_Fridericia"] = middle(marks["qt"][1:] / np.cbrt(rr))
    amp, t = marks["r_amp"], (beats - beats[0]) / fs
    fine = np.isfinite(amp)
    if fine.sum() >= 3:
        out["R_slope"] = float(np.polyfit(t[fine], amp[fine], 1)[0])
    return out


def grid(n: int, fs: float, window: float, stride: float):
    """window_idx, first sample, sample after the last one and times of whole windows."""
    size, step = int(np.rint(window * fs)), max(1, int(np.rint(stride * fs)))
    for k, lo in enumerate(range(0, n - size + 1, step)):
        yield {"window_idx": k, "t_start_sec": lo / fs, "t_center_sec": (lo + size / 2) / fs}, lo, lo + size


def ecg_windows(df: DataFrame | Made, fs: float, window: float = 30.0, stride: float = 5.0, rec: str = "rec", idx: str = "sample_idx", x: str = "ecg", raw: str | None = None, norm: str = "none", trim_lead_in: bool = False, corner: float | None = 0.08) -> DataFrame:
    """The 19 features of sliding windows: rec, window grid, n_beats, lf_reliable, ECG_FEATURES, status. norm: none, or recording (unit deviation)."""
    if norm not in ("none", "recording"):
        raise ValueError(f"no such normalisation: {norm}")

    def kernel(c):
        got = first_beats(c[x], c[raw] if raw else None, fs, 0.0, trim_lead_in, corner, False)
        q = max(1, round(fs / ANALYSIS_FS))
        slow, rate = dsp.resample_poly(got["x"], 1, q) if q > 1 else got["x"], fs / q
        beats = np.clip(np.rint(got["beats"] / q).astype(int), 0, len(slow) - 1)
        slow = slow / slow.std() if norm == "recording" and slow.std() > 0 else slow
        marks = signals.delineate(slow, beats, rate, got["upright"])
        rows = []
        for head, lo, hi in grid(len(slow), rate, window, stride):
            a, b = np.searchsorted(beats, [lo, hi])
            rows.append(head | {"t_raw_center_sec": head["t_center_sec"] + got["clock_offset_sec"]} | ecg_window(slow[lo:hi], rate, beats[a:b], {k: v[a:b] for k, v in marks.items()}))
        return rows

    schema = f"{GRID}, n_beats long, lf_reliable boolean, " + ", ".join(f"{n} double" for n in ECG_FEATURES)
    return each_recording(df, rec, idx, [x, *([raw] if raw else [])], schema, kernel)


def nerve_windows(df: DataFrame | Made, fs: float, window: float = 30.0, stride: float = 5.0, rec: str = "rec", idx: str = "sample_idx", x: str = "skna", offset: float = 0.0, norm: str = "none", detrend: bool = False) -> DataFrame:
    """The 11 features of sliding windows of the nerve channel (millivolts): rec, window grid, NERVE_FEATURES, status."""

    def kernel(c):
        band, slow = signals.nerve_chain(c[x], fs, norm, detrend=detrend)
        rows = []
        for head, lo, hi in grid(len(band), fs, window, stride):
            a, b = round(lo / fs * 100), round(hi / fs * 100)
            rows.append(head | {"t_raw_center_sec": head["t_center_sec"] + offset} | kernels.amplitude(band[lo:hi], (hi - lo) / fs) | {"dfSKNA": signals.dominant_frequency(slow[a:b])})
        return rows

    return each_recording(df, rec, idx, [x], f"{GRID}, " + ", ".join(f"{n} double" for n in NERVE_FEATURES), kernel)


def report(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature, finite_share, median, p5, p95 of each column."""
    from pulseforge.functions import ranges
    from pulseforge.functions.stats import finite

    df = steps.cut(df.select(*cols), "report")  # each look at the values below would compute the windows again
    rows = df.unpivot([], cols, "feature", "value").withColumn("value", finite(F.col("value")))
    share = rows.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("finite_share"))
    q = ranges.quantiles(rows, ["feature"], "value", [0.5, 0.05, 0.95])
    return share.join(q, "feature", "left").select("feature", "finite_share", F.col("q")[0].alias("median"), F.col("q")[1].alias("p5"), F.col("q")[2].alias("p95"))


def layout(lengths: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Where each channel, and the duration at the end, stand in a beat vector."""
    out, at = {}, 0
    for name, n in [*lengths.items(), ("duration", 1)]:
        out[name] = (at, at + n)
        at += n
    return out


def beat_vectors(df: DataFrame | Made, fs: float, lengths: dict[str, int] | None = None, rec: str = "rec", idx: str = "sample_idx", beat_channel: str = "ecg", how: str = "fft", norm: str = "recording", least: float = 0.5, most: float = 2.5) -> DataFrame:
    """A row for each three consecutive beats: rec, beat_idx, p0, p1, p2, t_center_sec, dur, keep (duration within bounds), vec (array<float>: the channels resampled to their lengths, then the duration).

    norm: recording or segment (mean 0, deviation 1; a deviation of 0 counts as 1), or none. Sequences of beats are
    arrays of indices over these rows (operators.windows.sequences), so no beat is stored twice.
    """
    lengths = lengths or {"ecg": 512, "skna": 4352}
    if norm not in ("none", "recording", "segment"):
        raise ValueError(f"no such normalisation: {norm}")

    def unit(v):
        return (v - v.mean()) / (v.std() or 1.0)

    def kernel(c):
        beats = signals.detect(c[beat_channel], fs)
        if len(beats) < 3:
            raise ValueError(f"only {len(beats)} beats")
        channels = {n: unit(c[n]) if norm == "recording" else c[n] for n in lengths}
        rows = []
        for k, (a, b, z) in enumerate(zip(beats, beats[1:], beats[2:], strict=False)):
            seconds = (z - a) / fs
            parts = [kernels.fixed_length(v[a:z], lengths[n], how) for n, v in channels.items()]
            parts = [unit(p) for p in parts] if norm == "segment" else parts
            rows.append({"beat_idx": k, "p0": int(a), "p1": int(b), "p2": int(z), "t_center_sec": (a + z) / 2 / fs, "dur": seconds, "keep": least <= seconds <= most, "vec": np.concatenate([*parts, [seconds]]).astype(np.float32)})
        return rows

    schema = "beat_idx long, p0 long, p1 long, p2 long, t_center_sec double, dur double, keep boolean, vec array<float>"
    return each_recording(df, rec, idx, sorted({*lengths, beat_channel}), schema, kernel)


def stage_two(df: DataFrame, fs: float, m: int = 12, stride: int = 1, rec: str = "rec", **how) -> tuple[DataFrame, DataFrame]:
    """Beat vectors of every recording (failed ones with their status), and the sequences of m kept beats as arrays of beat_idx: rec, idx, seq."""
    from pulseforge.operators import windows

    beats = beat_vectors(df, fs, rec=rec, **how)
    rows = beats.where("status = 'ok'").select(F.col(rec).alias("rec"), F.col("beat_idx").alias("idx"), "keep")
    return beats, windows.sequences(rows, m, stride).withColumnRenamed("rec", rec)


def usable_sequences(sequences: DataFrame, beats: DataFrame, rec: str = "rec") -> DataFrame:
    """Sequences all of whose beats are usable (see label_beats)."""
    good = beats.where("usable").select(rec, F.col("beat_idx").alias("b"))
    each = sequences.select(rec, "idx", F.explode("seq").alias("b")).join(good, [rec, "b"]).groupBy(rec, "idx").agg(F.count("*").alias("n"))
    return sequences.join(each, [rec, "idx"]).where(F.col("n") == F.size("seq")).drop("n")


def write_beats(beats: DataFrame, sequences: DataFrame, path: str, rec: str = "rec") -> None:
    """path/beats: each beat once, by recording; path/sequences: arrays of beat indices."""
    beats.write.partitionBy(rec).mode("overwrite").parquet(f"{path}/beats")
    sequences.write.mode("overwrite").parquet(f"{path}/sequences")


def label_beats(beats: DataFrame, readings: DataFrame, values: list[str], rec: str = "rec", t: str = "t_center_sec", mode: str = "interp") -> DataFrame:
    """Beats with interpolated (or nearest) readings, and usable: the readings are valid and the beat is kept."""
    from pulseforge.operators import labels

    out = beats
    for v in values:
        out = labels.as_of(out, readings.select(rec, F.col("t").alias(t), v), rec, t, v, mode).withColumnRenamed("valid", f"__{v}")
    ok = F.col("keep")
    for v in values:
        ok = ok & F.col(f"__{v}")
    return out.withColumn("usable", F.coalesce(ok, F.lit(False))).drop(*[f"__{v}" for v in values])


def lead_in_rows(df: DataFrame, rec: str, idx: str, x: str, width: int, most: int, steady: int, settle: int, factor: float = 3.0) -> DataFrame:
    """Lead-in of every recording in samples, in window functions: rec, lead_in.

    Smoothed deviation (moving mean over `width` samples) above `factor` times its median over the `steady` samples after
    the first `most`; it ends before the first sample that is followed by `settle` clean ones, and counts `width` more.
    """
    every, o = Window.partitionBy(rec), Window.partitionBy(rec).orderBy(idx)
    rows = df.select(rec, idx, F.abs(F.col(x) - quantile(x, 0.5, every)).alias("dev"), F.count("*").over(every).alias("n"))
    rows = rows.withColumn("level", F.sum("dev").over(o.rowsBetween(-(width // 2), (width - 1) // 2)) / width)
    lo = F.least(F.lit(most), F.greatest(F.lit(0), F.col("n") - settle))
    inside = (F.col(idx) >= lo) & (F.col(idx) < lo + steady)
    rows = rows.withColumn("steady", quantile(F.when(inside, F.col("level")), 0.5, every))
    rows = rows.where(F.col(idx) < most).withColumn("bad", (F.col("level") > factor * F.col("steady")).cast("int"))
    rows = rows.withColumn("ahead", F.sum("bad").over(o.rowsBetween(0, settle - 1)))
    first = F.min(F.when(F.col("ahead") == 0, F.col(idx)))
    out = rows.groupBy(rec).agg(F.max_by("bad", -F.col(idx)).alias("starts"), first.alias("quiet"), F.max("steady").alias("steady"), F.least(F.lit(most), F.max("n")).alias("end"))
    return out.select(rec, F.when((F.col("starts") == 0) | (F.coalesce("steady", F.lit(0.0)) <= 0), 0).otherwise(F.least(F.coalesce(F.col("quiet") + width, F.col("end")), F.col("end"))).cast("long").alias("lead_in"))
