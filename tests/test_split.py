"""Filters over split recordings against those over whole ones."""

import re

import numpy as np
import pytest

from pulseforge.functions import dsp
from pulseforge.operators import signals, split

SIZES = {"a": 1, "b": 2, "c": 9, "d": 700, "e": 4001}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    told = {r: np.cumsum(rng.normal(size=n)) for r, n in SIZES.items()}
    rows = [(r, i, float(v)) for r, x in told.items() for i, v in enumerate(x)]
    return told, spark.createDataFrame(rows, "rec string, sample_idx long, x double").repartition(3).cache()


def gathered(chunks):
    out = {}
    for r in split.samples(chunks).orderBy("rec", "sample_idx").collect():
        out.setdefault(r.rec, []).append(r.x)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [4, 500, 10_000])
def test_split_equals_whole(spark, data, size):
    told, df = data
    if size == 4:  # chunks shorter than the extension
        df = df.where("rec <> 'e'")
    chunks = split.chunked(df, size=size)
    assert chunks.count() == sum(-(-n // size) for r, n in SIZES.items() if size > 4 or r != "e")
    for kind, got in (("high", split.high_pass(chunks, 500.0)), ("band", split.beat_band(chunks, 500.0))):
        for r, y in gathered(got).items():
            want = signals.high_pass(told[r], 500.0) if kind == "high" else dsp.filtfilt(dsp.butter(2, (5.0, 15.0), 500.0, "band"), told[r])
            # with a corner of 0.08 of 500 Hz sums over thousands of samples cancel, and rounding is greater
            assert len(y) == len(told[r]) and np.abs(y - want).max() < (1e-8 if kind == "high" else 1e-9) * max(1, np.abs(told[r]).max()), (kind, r)
    for r, y in gathered(split.rectified(chunks, 500.0)).items():
        assert np.abs(y - dsp.leaky(np.abs(told[r]), 500.0)).max() < 1e-9


def test_nerve_band_and_deviation(spark, data):
    told, df = data
    chunks = split.chunked(df.where("rec in ('d', 'e')"), size=600)
    for norm in ("none", "recording"):
        for r, y in gathered(split.nerve_band(chunks, 2200.0, norm)).items():
            band, _ = signals.nerve_chain(told[r], 2200.0, norm)
            assert np.abs(y - band).max() < 1e-5 * np.abs(band).max()
    for bad in ({"fs": 900.0}, {"fs": 2200.0, "norm": "other"}):
        with pytest.raises(ValueError):
            split.nerve_band(chunks, **bad)


def test_a_long_recording_is_many_tasks(spark, data):
    """No exchange but that of the samples carries arrays, and a recording's chunks lie in several partitions."""
    _, df = data
    chunks = split.chunked(df.where("rec = 'e'"), size=100)
    assert split.high_pass(chunks, 500.0).count() == 41
    spread = chunks.repartition(8, "rec", "chunk").groupBy(split.F.spark_partition_id()).count().count()
    assert spread > 4
    odd = spark.createDataFrame([(1, 0, None), (1, 1, float("nan")), (1, 2, 1.0)], "rec int, sample_idx long, x double")
    assert gathered(split.forward(split.chunked(odd, size=2), dsp.butter(2, 1.0, 10.0)))[1].tolist() == pytest.approx(dsp.sosfilt(dsp.butter(2, 1.0, 10.0), np.array([0.0, 0.0, 1.0])).tolist())
    assert split.high_pass(split.chunked(df.limit(0)), 500.0).count() == 0


@pytest.mark.parametrize("size", [16, 300, 10_000])
def test_delay_of_chunks_equals_that_of_the_whole(spark, size):
    rng = np.random.default_rng(4)
    told, rows = {}, []
    for r, (n, late) in {"a": (900, 37), "b": (700, -21), "c": (40, 3), "d": (2, 0), "e": (1, 0), "f": (50, 0)}.items():
        base = np.cumsum(rng.normal(size=n + 100)) * (r != "f") + 5
        x, y = base[50 : 50 + n], base[50 - late : 50 - late + n] + 0.1 * rng.normal(size=n) + 3
        if n > 60:
            x[7], y[9] = np.nan, np.nan
        told[r] = np.nan_to_num(x), np.nan_to_num(y)
        rows += [(r, i + 1000, None if np.isnan(u) and i % 2 else float(u), float(v)) for i, (u, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "rec string, sample_idx long, x double, y double").repartition(5)
    got = {r.rec: r for r in split.delay(df, 10.0, 6.0, size=size).collect()}
    assert set(got) == set(told)
    for r, (x, y) in told.items():
        lag, c = dsp.cross_delay(x, y, 10.0, 6.0)
        if x.std() == 0 or len(x) == 1:
            assert (got[r].lag, got[r].r) == (0, 0.0)
        else:
            assert abs(got[r].delay - lag) < 1e-12 and abs(got[r].r - c) < 1e-9 and got[r].lag == round(lag * 10)
    assert split.delay(df.limit(0), 10.0, 6.0).count() == 0


def test_made_samples_give_the_chunks_of_rows(spark):
    """Samples made in the task give the same chunks and recordings as a row for each, and no exchange or sort holds a row for each sample."""
    from pulseforge.operators import recordings

    rng = np.random.default_rng(2)
    rows = []
    for r in range(5):
        sizes = rng.integers(1, 30, 12)
        values = rng.normal(size=12)
        rows += [(f"r{r}", k, int(sizes[:k].sum()), int(n), float(v)) for k, (n, v) in enumerate(zip(sizes, values, strict=True))]
    df = spark.createDataFrame(rows, "rec string, k int, at long, n long, v double").repartition(3)  # rows of a recording are far apart
    flats = {}
    for rec, k, _, n, v in rows:
        flats.setdefault(rec, []).append(v + np.arange(n))

    def single(c, wanted):
        return {name: np.concatenate([np.full(n, v) + np.arange(n) for n, v in zip(c["n"], c["v"], strict=True)]) for name in wanted}

    made = recordings.Made(df, "k", ["n", "v"], single, ("at", "n"))
    got = gathered(split.chunked(made, x="x", size=32))
    assert all(np.array_equal(got[r], np.concatenate(v)) for r, v in flats.items()) and len(got) == 5
    told = {r.rec: r for r in split.spread(split.chunked(made, x="x", size=32)).collect()}
    for r, v in flats.items():
        v = np.concatenate(v)
        assert told[r].n == len(v) and abs(told[r].sd - v.std()) < 1e-12 and told[r].top == v.max()
    each = recordings.each_recording(made, "rec", "sample_idx", ["x"], "n long, s double", lambda c: [{"n": len(c["x"]), "s": float(c["x"].sum())}])
    assert {r.rec: (r.n, round(r.s, 9)) for r in each.collect()} == {r: (sum(map(len, v)), round(float(np.concatenate(v).sum()), 9)) for r, v in flats.items()}


@pytest.mark.parametrize("size", [7, 40, 4096])
def test_filters_of_dealt_rows_shuffle_no_samples(spark, size):
    """Filters over rows dealt to chunks equal those over whole recordings, and no exchange holds more than the rows' columns and the chunks' states."""
    from pulseforge.operators import recordings

    rng = np.random.default_rng(5)
    rows, flats = [], {}
    for r in range(4):
        at = 0
        for k in range([1, 2, 30, 90][r]):
            n, v = int(rng.integers(1, 60)) if r else 1, float(rng.normal())
            rows.append((r, k, at, n, v))
            flats.setdefault(r, []).append(v * np.cos(np.arange(n) / 9))
            at += n
        rows.append((r, 1000, at, 0, 5.0))  # without samples
    df = spark.createDataFrame(rows, "rec int, k int, at long, n long, v double").repartition(3)

    def make(c, wanted):
        return {name: np.concatenate([v * np.cos(np.arange(n) / 9) for n, v in zip(c["n"], c["v"], strict=True)]) for name in wanted}

    def carried(frame):
        """Columns that exchanges and sorts hold."""
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        parts = re.findall(r"\(\d+\) (?:Exchange|Sort)\s*\nInput \[\d+\]: \[(.*)\]", frame._jdf.queryExecution().explainString(mode))
        return {c.split("#")[0].strip() for part in parts for c in part.split(",")}

    made = recordings.Made(df, "k", ["n", "v"], make, ("at", "n"))
    chunks = split.dealt(made, x="x", size=size)
    filters = {"slow": split.high_pass_sections(500.0, 2.0), "band": split.beat_band_sections(500.0)}
    told = split.spreads(chunks, filters)
    assert "chunk" in carried(told) and "x" not in carried(told)
    assert "x" in carried(split.beat_band(split.chunked(made, x="x", size=size), 500.0))  # a join of samples
    got = {r.rec: r for r in told.collect()}
    assert sorted(got) == [0, 1, 2, 3]
    single = {name: gathered(split.zero_phase(chunks, f)) for name, f in filters.items()}
    for r, parts in flats.items():
        v = np.concatenate(parts)
        for name, f in filters.items():
            want = dsp.filtfilt(f, v)
            assert np.abs(single[name][r] - want).max() < 1e-9
            assert got[r].n == len(v) and abs(got[r][f"sd_{name}"] - want.std()) < 1e-9 and abs(got[r][f"top_{name}"] - want.max()) < 1e-9
