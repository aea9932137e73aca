"""Recursive filters over recordings that are split into chunks, so that one long recording is many tasks.

A filter's state after a chunk is an affine function of the state before it: a fixed matrix (which depends on the
chunk's length alone) and what the chunk adds from rest. So each chunk tells what it adds, forwards and backwards, a
scan over these few numbers of a recording gives every chunk's states, and each chunk is filtered by itself from there.
The output is that of dsp.filtfilt() or dsp.sosfilt() over the whole recording, to rounding (1e-9 of the signal for the
beat band; 1e-8 for a high-pass of 0.08 Hz at 500 Hz, where poles lie close to one).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.functions import dsp
from pulseforge.operators.recordings import Made

#: Samples of a chunk.
CHUNK = 1 << 17
#: Chunks of at most this many samples tell what they add to a state by one matrix product.
SHORT = 1 << 13


def _lists(told: list) -> "pa.ListArray":  # noqa: F821
    """Arrays of numbers as a column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, told)]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *told])))


def chunked(df: DataFrame | Made, rec: str = "rec", idx: str = "sample_idx", x: str = "x", size: int = CHUNK) -> DataFrame:
    """rec, chunk, start (first sample's index) and x (array, in the order of idx); nulls and NaN count as 0."""
    if isinstance(df, Made):
        rows, read = _source(dealt(df, rec, x, size), rec, x)
        return _map(rows, lambda row: (row[rec], row["chunk"], row["start"], read(row)), f"{rec} {dict(rows.dtypes)[rec]}, chunk long, start long, x array<double>")
    value = F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(rec, F.floor(F.col(idx) / size).cast("long").alias("chunk"), F.struct(F.col(idx).cast("long").alias("i"), value.alias("v")).alias("s"))
    held = rows.groupBy(rec, "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most `size` samples
    return held.select(rec, "chunk", F.col("s")[0]["i"].alias("start"), F.transform("s", lambda s: s["v"]).alias("x"))


@dataclass(frozen=True)
class Dealt:
    """Chunks of made samples that hold what makes them, so that no shuffle, join or sort carries samples: rows has rec, chunk, start and, as arrays, the columns of the rows that reach into the chunk. zero_phase(), forward() and spread() take one in the place of chunks; each of their tasks makes its chunks' samples."""

    rows: DataFrame
    read: Callable


def dealt(made: Made, rec: str = "rec", x: str = "x", size: int = CHUNK) -> Dealt:
    """Made rows dealt to the chunks that they reach into, at most `size` for each. A row that reaches into several chunks is made in each of them, so rows should be short beside `size`."""
    make, (at, length) = made.make, made.span
    columns = [c for c in dict.fromkeys([at, length, *made.columns]) if c != rec]
    lo, n = F.col(at), F.col(length)
    near = F.sequence(F.floor(lo / size).cast("long"), F.floor((lo + n - 1) / size).cast("long"))
    rows = made.rows.where(n > 0).select(rec, F.explode(near).alias("chunk"), F.struct(*[F.col(c).alias(f"__{c}") for c in columns]).alias("s"))
    held = rows.groupBy(rec, "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most `size` rows
    start = F.greatest(F.col("s")[0][f"__{at}"].cast("long"), F.col("chunk") * size)

    def read(row):
        first, lengths = row[f"__{at}"], row[f"__{length}"]
        v = np.nan_to_num(make({c: np.full(len(first), row[rec]) if c == rec else row[f"__{c}"] for c in made_columns}, [x])[x])
        low = row["chunk"] * size
        return v[max(0, low - int(first[0])) : len(v) - max(0, int(first[-1] + lengths[-1]) - low - size)]

    made_columns = made.columns
    return Dealt(held.select(rec, "chunk", start.alias("start"), *[F.col("s")[f"__{c}"].alias(f"__{c}") for c in columns]), read)


def _source(chunks: DataFrame | Dealt, rec: str, x: str) -> tuple[DataFrame, Callable]:
    """The chunks' rows, and what gives a row's samples."""
    return (chunks.rows, chunks.read) if isinstance(chunks, Dealt) else (chunks.select(rec, "chunk", "start", x), lambda row: row[x])


def _told(v: np.ndarray) -> tuple[float, float, float]:
    """Mean, sum of squares about it, and greatest value."""
    mean = v.mean()
    return float(mean), float(((v - mean) ** 2).sum()), float(v.max())


def _joined(each: DataFrame, names: dict[str, str], rec: str) -> DataFrame:
    """rec, n, and for each name sd and top of the chunks' n, mean_<i>, q_<i> and top_<i>."""
    parts = [F.struct("n", *[F.col(f"{c}_{i}").alias(c) for c in ("mean", "q")]) for i in names]
    held = each.groupBy(rec).agg(F.sum("n").alias("n"), *[x for i, part in zip(names, parts, strict=True) for x in (F.max(f"top_{i}").alias(f"__t{i}"), (F.sum(F.col("n") * F.col(f"mean_{i}")) / F.sum("n")).alias(f"__m{i}"), F.collect_list(part).alias(f"__c{i}"))])  # a few numbers for each chunk
    squares = lambda i: F.aggregate(f"__c{i}", F.lit(0.0), lambda a, c: a + c["q"] + c["n"] * (c["mean"] - F.col(f"__m{i}")) * (c["mean"] - F.col(f"__m{i}")))
    return held.select(rec, "n", *[x for i, name in names.items() for x in (F.sqrt(squares(i) / F.col("n")).alias(f"sd_{name}"), F.col(f"__t{i}").alias(f"top_{name}"))])


def spread(chunks: DataFrame | Dealt, rec: str = "rec", x: str = "x") -> DataFrame:
    """rec, n, sd (population deviation) and top (greatest value) of a recording's samples, from a few numbers of each chunk."""
    rows, read = _source(chunks, rec, x)

    def told(row):
        v = read(row)
        return row[rec], len(v), *_told(v)

    each = _map(rows, told, f"{rec} {dict(rows.dtypes)[rec]}, n long, mean_0 double, q_0 double, top_0 double")
    return _joined(each, {"0": ""}, rec).withColumnsRenamed({"sd_": "sd", "top_": "top"})


def samples(chunks: DataFrame, rec: str = "rec", idx: str = "sample_idx", x: str = "x") -> DataFrame:
    """The chunks' samples: rec, idx and x; indices without gaps within a chunk."""
    return chunks.select(rec, "start", F.posexplode(x).alias("at", x)).select(rec, (F.col("start") + F.col("at")).alias(idx), x)


def _map(df: DataFrame, work, schema: str) -> DataFrame:
    """work(row as a dict of Python values, arrays as numpy) -> tuple of the schema's columns, for each row."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            held, many = [], 0
            for i in range(b.num_rows):  # a row is a chunk of many samples
                row = {n: np.asarray(b.column(k)[i].values) if n in arrays and b.column(k)[i].is_valid else b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                held.append(work(row))
                many += sum(len(v) for v in held[-1] if isinstance(v, np.ndarray))
                if many >= CHUNK or i == b.num_rows - 1:
                    told = [_lists(list(c)) if isinstance(c[0], np.ndarray) else pa.array(list(c), b.column(names[0]).type if k == 0 else None) for k, c in enumerate(zip(*held, strict=True))]
                    yield pa.RecordBatch.from_arrays(told, names=names)
                    held, many = [], 0

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=4096)
def _moves(keys: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How n samples of silence move the state of these sections, and what the response to it adds to the state backwards.

    With A the move of one sample, B what an input of 1 adds and C the output, these are A^n and the sum of A^i B C A^i over
    i < n, both from their halves.
    """
    sections = [np.array(s) for s in keys]
    size = 2 * len(sections)
    if n == 1:
        told = [dsp.cascade(sections, np.zeros(1), e) for e in np.eye(size)]
        return np.column_stack([z for _, z in told]), np.outer(dsp.cascade(sections, np.ones(1), np.zeros(size))[1], [y[0] for y, _ in told])
    half, back = _moves(keys, n // 2)
    ahead, back = half @ half, back + half @ back @ half
    if n % 2:
        one, added = _moves(keys, 1)
        ahead, back = one @ ahead, added + one @ back @ one
    return ahead, back


@lru_cache(maxsize=64)
def _powers(keys: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By i < n: A^i and A^i B, and by m <= n the sum of A^k B h_k over k < m, where h is the response to an impulse; in long doubles, as poles may lie close to one."""
    sections, size = [np.array(s) for s in keys], 2 * len(keys)
    p, step = np.eye(size, dtype=np.longdouble)[None], _moves(keys, 1)[0].astype(np.longdouble)
    while len(p) < n:
        p, step = np.concatenate([p, p @ step]), step @ step
    first, ahead = dsp.cascade(sections, np.ones(1), np.zeros(size))
    ahead = p[:n] @ ahead.astype(np.longdouble)
    h = np.r_[first, ahead[:-1] @ np.array([dsp.cascade(sections, np.zeros(1), e)[0][0] for e in np.eye(size)], np.longdouble)]
    return p[:n], ahead, np.concatenate([np.zeros((1, size)), np.cumsum(ahead * h[:, None], 0)])


@lru_cache(maxsize=64)
def _adding(keys: tuple, n: int) -> np.ndarray:
    """The matrix that gives what n samples add to the state from rest, forwards and then backwards."""
    p, ahead, sums = _powers(keys, 1 << (n - 1).bit_length())
    return np.hstack([ahead[:n][::-1], np.einsum("iab,ib->ia", p[:n], sums[n:0:-1])]).T.astype(float)


def _adds(keys: tuple, v: np.ndarray) -> np.ndarray:
    """What a chunk adds to the state from rest, forwards and then backwards: one product for short chunks."""
    if 0 < len(v) <= SHORT:
        return _adding(keys, len(v)) @ v
    sections, size = [np.array(s) for s in keys], 2 * len(keys)
    y, ahead = dsp.cascade(sections, v, np.zeros(size))
    return np.concatenate([ahead, dsp.cascade(sections, y[::-1], np.zeros(size))[1]])


def _states(keys: tuple, rows: list[dict], adds: list[np.ndarray]) -> list[np.ndarray]:
    """State before each chunk of a recording, forwards and backwards, from the chunks' adds; rows have n, head and tail in the order of chunks."""
    sections, size, n = [np.array(s) for s in keys], 2 * len(keys), sum(r["n"] for r in rows)
    pad = _pad(keys)
    head, tail = [], []
    for r in rows:
        if len(head) <= pad:
            head += r["head"]
    for r in reversed(rows):
        if len(tail) <= pad:
            tail = r["tail"] + tail
    own = min(pad, n - 1)
    head, tail = np.array(head), np.array(tail)
    before, after = 2 * head[0] - head[own:0:-1], (2 * tail[-1] - tail[-2 : -own - 2 : -1]) if own else np.zeros(0)
    level = before[0] if own else head[0]
    _, state = dsp.cascade(sections, before, dsp.steady_state(sections, level))
    ins = []
    for r, add in zip(rows, adds, strict=True):
        ins.append(state)
        state = _moves(keys, r["n"])[0] @ state + add[:size]
    # backwards: from the end of the extension
    end, _ = dsp.cascade(sections, after, state)
    start = dsp.steady_state(sections, end[-1] if own else 0.0)
    _, state = dsp.cascade(sections, end[::-1], start)
    backs = []
    for r, add, ahead in zip(reversed(rows), reversed(adds), reversed(ins), strict=True):
        backs.append(state)
        state = _moves(keys, r["n"])[0] @ state + add[size:] + _moves(keys, r["n"])[1] @ ahead
    return [np.concatenate([a, b]) for a, b in zip(ins, reversed(backs), strict=True)]


def _pad(keys: tuple) -> int:
    return 3 * (2 * len(keys) + 1)


def _placed(chunks: DataFrame | Dealt, filters: list[tuple], rec: str, x: str) -> DataFrame:
    """The chunks' rows with total (samples of the recording) and state: those of all filters, forwards and backwards, before the chunk.

    One pass over the samples serves all filters; what is shuffled again has a few numbers for each chunk.
    """
    rows, read = _source(chunks, rec, x)
    kind, most = dict(rows.dtypes)[rec], max(map(_pad, filters))

    def told(row):
        v = read(row)
        return row[rec], row["chunk"], len(v), np.concatenate([_adds(keys, v) for keys in filters]), v[: most + 1].copy(), v[-most - 1 :].copy()

    def states(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        adds = np.array([r["adds"] for r in rows])
        ends = np.cumsum([4 * len(keys) for keys in filters])
        out = np.hstack([_states(keys, rows, list(adds[:, end - 4 * len(keys) : end])) for keys, end in zip(filters, ends, strict=True)])
        return pa.table([pa.array([key[0].as_py()] * len(rows), key[0].type), pa.array([r["chunk"] for r in rows]), pa.array([sum(r["n"] for r in rows)] * len(rows)), pa.array(out.tolist(), pa.list_(pa.float64()))], names=[rec, "chunk", "total", "state"])

    adds = _map(rows, told, f"{rec} {kind}, chunk long, n long, adds array<double>, head array<double>, tail array<double>")
    found = adds.groupBy(rec).applyInArrow(states, f"{rec} {kind}, chunk long, total long, state array<double>")  # a few numbers for each chunk
    return rows.join(found, [rec, "chunk"])


def _filtered(keys: tuple, v: np.ndarray, state: np.ndarray, total: int) -> np.ndarray:
    """A chunk's samples, filtered from its states."""
    if total < 2:
        return v.copy()
    sections, size = [np.array(s) for s in keys], 2 * len(keys)
    y, _ = dsp.cascade(sections, v, state[:size])
    return dsp.cascade(sections, y[::-1], state[size:])[0][::-1].copy()


def _keys(sections: list[np.ndarray]) -> tuple:
    return tuple(tuple(s.tolist()) for s in sections)


def zero_phase(chunks: DataFrame | Dealt, sections: list[np.ndarray], rec: str = "rec", x: str = "x") -> DataFrame:
    """chunks with x filtered forwards and backwards with odd extension, as dsp.filtfilt() does with the whole recording.

    A recording of one sample stays as it is. One shuffle deals the samples to chunks, or the rows that make them; what is
    shuffled again has a few numbers for each chunk.
    """
    keys, read = _keys(sections), _source(chunks, rec, x)[1]
    placed = _placed(chunks, [keys], rec, x)
    work = lambda row: (row[rec], row["chunk"], row["start"], _filtered(keys, read(row), row["state"], row["total"]))
    return _map(placed, work, f"{rec} {dict(placed.dtypes)[rec]}, chunk long, start long, {x} array<double>")


def spreads(chunks: DataFrame | Dealt, filters: dict[str, list[np.ndarray]], rec: str = "rec", x: str = "x") -> DataFrame:
    """rec, n, and sd_<name> and top_<name> of each filter: spread() of what zero_phase() gives, in two passes for all filters, and no filtered sample leaves its task."""
    keys, read = [_keys(f) for f in filters.values()], _source(chunks, rec, x)[1]
    placed = _placed(chunks, keys, rec, x)
    ends = np.cumsum([4 * len(k) for k in keys]).tolist()

    def told(row):
        v = read(row)
        parts = [_told(_filtered(k, v, row["state"][end - 4 * len(k) : end], row["total"])) for k, end in zip(keys, ends, strict=True)]
        return row[rec], len(v), *[c for part in parts for c in part]

    names = [f"{c}_{i}" for i in range(len(keys)) for c in ("mean", "q", "top")]
    each = _map(placed, told, f"{rec} {dict(placed.dtypes)[rec]}, n long, " + ", ".join(f"{c} double" for c in names))
    return _joined(each, {str(i): name for i, name in enumerate(filters)}, rec)


def forward(chunks: DataFrame | Dealt, sections: list[np.ndarray], rec: str = "rec", x: str = "x") -> DataFrame:
    """chunks with x filtered once from rest, as dsp.sosfilt() does with the whole recording (such as the leaky integrator)."""
    rows, read = _source(chunks, rec, x)
    size, kind, keys = 2 * len(sections), dict(rows.dtypes)[rec], tuple(tuple(s.tolist()) for s in sections)

    def told(row):
        v = read(row)
        return row[rec], row["chunk"], len(v), dsp.cascade(sections, v, np.zeros(size))[1]

    def states(key, table):
        import pyarrow as pa

        rows, state, ins = sorted(table.to_pylist(), key=lambda r: r["chunk"]), np.zeros(size), []
        for r in rows:
            ins.append(state.tolist())
            state = _moves(keys, r["n"])[0] @ state + np.array(r["adds"])
        return pa.table([pa.array([key[0].as_py()] * len(rows), key[0].type), pa.array([r["chunk"] for r in rows]), pa.array(ins, pa.list_(pa.float64()))], names=[rec, "chunk", "state"])

    adds = _map(rows, told, f"{rec} {kind}, chunk long, n long, adds array<double>")
    found = adds.groupBy(rec).applyInArrow(states, f"{rec} {kind}, chunk long, state array<double>")
    work = lambda row: (row[rec], row["chunk"], row["start"], dsp.cascade(sections, read(row), row["state"])[0])
    return _map(rows.join(found, [rec, "chunk"]), work, f"{rec} {kind}, chunk long, start long, {x} array<double>")


def high_pass_sections(fs: float, corner: float = 0.08) -> list[np.ndarray]:
    return dsp.butter(2, corner, fs, "high")


def beat_band_sections(fs: float) -> list[np.ndarray]:
    return dsp.butter(2, (5.0, 15.0), fs, "band")


def high_pass(chunks: DataFrame | Dealt, fs: float, corner: float = 0.08, rec: str = "rec", x: str = "x") -> DataFrame:
    """signals.high_pass() over chunks."""
    return zero_phase(chunks, high_pass_sections(fs, corner), rec, x)


def beat_band(chunks: DataFrame | Dealt, fs: float, rec: str = "rec", x: str = "x") -> DataFrame:
    """The beat detector's band of 5-15 Hz over chunks."""
    return zero_phase(chunks, beat_band_sections(fs), rec, x)


def nerve_band(chunks: DataFrame, fs: float, norm: str = "none", reference: float = 4.73, rec: str = "rec", x: str = "x") -> DataFrame:
    """The nerve channel's band in microvolts over chunks, as signals.nerve_chain() gives it; norm recording brings each recording's deviation to `reference`."""
    top = min(999.0, fs / 2 - 1)
    if top <= 500:
        raise ValueError(f"no band above 500 Hz at {fs} Hz")
    if norm not in ("none", "recording"):
        raise ValueError(f"no such normalisation: {norm}")
    scaled = chunks.withColumn(x, F.transform(x, lambda v: v * 1000.0))
    band = zero_phase(scaled, dsp.butter(3, (500.0, top), fs, "band"), rec, x).withColumn(x, F.transform(x, lambda v: v.cast("float").cast("double")))
    if norm == "none":
        return band
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    sums = band.groupBy(rec).agg(F.sum(F.size(x)).alias("n"), F.sum(total(lambda v: v)).alias("s"), F.sum(total(lambda v: v * v)).alias("q"))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    gains = sums.select(rec, F.when(sd > 0, F.lit(reference) / sd).otherwise(1.0).alias("__gain"))
    return band.join(gains, rec).withColumn(x, F.transform(x, lambda v: v * F.col("__gain"))).drop("__gain")


def rectified(band: DataFrame, fs: float, tau: float = 0.01, rec: str = "rec", x: str = "x") -> DataFrame:
    """The band's absolute values through the leaky integrator, over chunks."""
    a = 1 / fs / (tau + 1 / fs)
    return forward(band.withColumn(x, F.transform(x, F.abs)), [np.array([a, 0.0, 0.0, 1.0, -(1 - a), 0.0])], rec, x)


def delay(df: DataFrame, fs: float, most: float, rec: str = "rec", idx: str = "sample_idx", x: str = "x", y: str = "y", size: int = CHUNK) -> DataFrame:
    """rec, lag (samples by which y is behind x), delay (seconds) and r (the correlation there): the best lag within `most` seconds.

    What dsp.cross_delay() gives for the whole recording: values less their means, no wrap-around, of equal lags the
    smallest. A chunk of x meets the samples of y within reach of it, sums of products of all lags come from one transform
    in the task, and Spark adds them by lag. Nulls and NaN count as 0, missing samples as the mean, channels without
    spread have lag 0 and r 0.
    """
    reach = int(most * fs)
    kind = dict(df.dtypes)[rec]
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(rec, F.col(idx).cast("long").alias("__i"), value(x).alias("__x"), value(y).alias("__y"))
    stats = rows.groupBy(rec).agg(F.min("__i").alias("__low"), F.max("__i").alias("__high"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"), (F.count("*") * F.stddev_pop("__x") * F.stddev_pop("__y")).alias("__norm"))
    rows = rows.join(stats, rec).select(rec, (F.col("__i") - F.col("__low")).alias("i"), (F.col("__x") - F.col("__mx")).alias("x"), (F.col("__y") - F.col("__my")).alias("y"), (F.col("__high") - F.col("__low")).alias("last"))
    chunk = lambda i: F.floor(i / size).cast("long")
    near = F.sequence(chunk(F.greatest(F.col("i") - reach, F.lit(0))), chunk(F.least(F.col("i") + reach, F.col("last"))))
    dealt = rows.select(rec, F.explode(near).alias("chunk"), F.struct("i", "x", "y").alias("s"))
    held = dealt.groupBy(rec, "chunk").agg(F.collect_list("s").alias("s")).select(rec, "chunk", "s.i", "s.x", "s.y")  # at most size + 2 x reach samples

    def run(batches):
        import pyarrow as pa

        n = 1 << (2 * size + 2 * reach).bit_length()
        for b in batches:
            for k in range(b.num_rows):  # a row is a chunk of many samples
                at = b.column(1)[k].as_py() * size
                i, a, c = (np.asarray(b.column(j)[k].values) for j in (2, 3, 4))
                own, far = np.zeros(size), np.zeros(size + 2 * reach)
                mine = (i >= at) & (i < at + size)
                own[i[mine] - at] = a[mine]
                far[i - at + reach] = c
                sums = np.fft.irfft(np.fft.rfft(far, n) * np.conj(np.fft.rfft(own, n)), n)[: 2 * reach + 1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=[rec, "sums"])

    sums = held.mapInArrow(run, f"`{rec}` {kind}, sums array<double>").select(rec, F.posexplode("sums").alias("at", "c"))
    lags = sums.groupBy(rec, (F.col("at") - reach).cast("long").alias("lag")).agg(F.sum("c").alias("c")).join(stats.select(rec, "__norm", (F.col("__high") - F.col("__low")).alias("__last")), rec)
    best = lags.where(F.abs("lag") <= F.col("__last")).groupBy(rec).agg(F.max(F.struct("c", (-F.col("lag")).alias("l"))).alias("b"), F.first("__norm").alias("norm"))
    lag = F.when(F.col("norm") > 0, -F.col("b.l")).otherwise(F.lit(0).cast("long"))
    return best.select(rec, lag.alias("lag"), (lag / F.lit(float(fs))).alias("delay"), F.when(F.col("norm") > 0, F.col("b.c") / F.col("norm")).otherwise(0.0).alias("r"))
