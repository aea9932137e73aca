"""Beats from chunks of any size equal those of the whole recording."""

import numpy as np
import pytest

from pulseforge.operators import signals
from pulseforge.streaming import causal

FS = 250.0


def recording(seed: int, n: int = 12_000, drop: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x, at = 0.05 * rng.normal(size=n), 100
    while at < n - 100:
        x[at - 3 : at + 4] += np.array([0.1, 0.4, 0.8, 1.0, 0.8, 0.4, 0.1]) * (0.45 if drop and rng.random() < 0.15 else 1.0)
        x[at + 60 : at + 80] += 0.25 * np.hanning(20)
        at += int(rng.normal(200, 15))
    return signals.filter_chain(x, FS)["energy"]


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("size", [1, 7, 250, 1999, 50_000])
def test_chunks_of_any_size(size, back):
    energy = recording(1, 4000 if size < 7 else 12_000, drop=True)
    want = signals.decide(energy, FS, back).tolist()
    held, got = signals.BeatStream(FS, search_back=back), []
    for k in range(0, len(energy), size):
        got += held.push(energy[k : k + size])
        held = signals.BeatStream.load(held.dump())
    early = len(got)
    got += held.push(np.zeros(0), last=True)
    assert got == want and len(want) > 10
    assert early >= len(want) - 3 or size > len(energy) // 2
    assert len(held.dump()) < 60_000


def test_plateaus_ties_and_flat_energy():
    rng = np.random.default_rng(2)
    for seed in range(5):
        energy = np.repeat(np.abs(np.round(recording(seed, 4000) * 1e4)), rng.integers(1, 4))
        want = signals.decide(energy, FS).tolist()
        held, got, k = signals.BeatStream(FS), [], 0
        while k < len(energy):
            step = int(rng.integers(1, 400))
            got += held.push(energy[k : k + step])
            k += step
        assert got + held.push(np.zeros(0), last=True) == want
    held = signals.BeatStream(FS)
    assert held.push(np.zeros(5000)) == [] and held.push(np.zeros(0), last=True) == []


def test_stream(spark, tmp_path):
    energies = {"a": recording(3), "b": recording(4)}
    for k, (lo, hi) in enumerate(((0, 3000), (3000, 3500), (3500, 12_000))):
        df = spark.createDataFrame([(r, 50 + i, float(e[i])) for r, e in energies.items() for i in reversed(range(lo, hi))], "rec string, idx long, energy double")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = causal.beats(stream, FS).writeStream.format("memory").queryName("beats").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("beats").collect()
    for r, e in energies.items():
        want, got = (signals.decide(e, FS) + 50).tolist(), sorted(x["at"] for x in rows if x["rec"] == r)
        assert got == want[: len(got)] and len(got) >= len(want) - 3
