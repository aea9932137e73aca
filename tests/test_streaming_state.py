"""The expanding normaliser over batches: equal to the definition, and writing what a batch touches."""

import numpy as np
import pytest

from pulseforge.streaming import causal


def run(spark, tmp_path, name, batches, **options):
    df = None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "rec string, idx long, x double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        # files are taken in the order of their times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    q = causal.expanding_normaliser(stream, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}_state").start()
    q.processAllAvailable()
    told = [(p["numInputRows"], p["stateOperators"][0]) for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    return {(r.rec, r.idx): r.z for r in spark.table(name).collect()}, told


def explicit(values, window=None):
    out, seen = [], []
    for v in values:
        if v is None or v != v:
            out.append(None)
            continue
        past = seen[-window:] if window else seen
        q1, q2, q3 = np.percentile(past, [25, 50, 75]) if len(past) >= 4 else (0, 0, 0)
        out.append((v - q2) / (q3 - q1) if q3 > q1 else None)
        seen.append(v)
    return out


@pytest.mark.parametrize("window", [None, 50])
def test_equals_the_definition(spark, tmp_path, monkeypatch, window):
    monkeypatch.setattr(causal, "BLOCK", 16)
    rng = np.random.default_rng(7)
    values = {"a": rng.normal(size=400).tolist(), "b": np.round(rng.normal(size=300)).tolist(), "c": [1.0] * 90}
    values["a"][7], values["a"][250], values["b"][0] = None, float("nan"), None
    sizes = (150, 151, 400)
    batches = [[(r, i, v[i]) for r, v in values.items() for i in reversed(range(lo, min(hi, len(v))))] for lo, hi in zip((0, *sizes), sizes, strict=False)]
    got, _ = run(spark, tmp_path, f"z{window or 0}", batches, window=window)
    for r, v in values.items():
        for i, want in enumerate(explicit(v, window)):
            assert (got[r, i] is None) == (want is None) and (want is None or abs(got[r, i] - want) < 1e-9), (r, i)
    assert len(got) == sum(map(len, values.values()))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    rng = np.random.default_rng(8)
    values = rng.normal(size=40_040)
    batches = [[("a", i, float(values[i])) for i in range(lo, hi)] for lo, hi in ((0, 20_000), (20_000, 40_000), (40_000, 40_040))]
    got, told = run(spark, tmp_path, "long", batches)
    q1, q2, q3 = np.percentile(values[:40_039], [25, 50, 75])
    assert abs(got["a", 40_039] - (values[40_039] - q2) / (q3 - q1)) < 1e-9
    (rows, last) = told[-1]
    assert rows == 40 and last["numRowsUpdated"] <= 2 * (40 + 2) < last["numRowsTotal"]  # a block and its line of the index for each sample at most
