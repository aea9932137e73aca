"""Structured Streaming forms of the causal operators: window features, expanding normalisation, and run alarms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_features(stream: DataFrame, ts: str = "ts", rec: str = "rec", x: str = "x", length: str = "30 seconds", slide: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Amplitude features of sliding event-time windows; rows later than the watermark are dropped."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), rec)
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(x)).alias("aSKNA"), F.var_pop(x).alias("varSKNA"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rmsSKNA"), F.max(F.abs(x)).alias("peak"))


def quantile_of(at, n: int, p: float) -> float:
    """The interpolated p-quantile of n values of which at(i) is the i-th in order."""
    place = (n - 1) * p
    lo = int(place)
    low = at(lo)
    return low + (at(min(lo + 1, n - 1)) - low) * (place - lo)


def scaled_by(v: float, at, n: int) -> float | None:
    """v less the median of the n values before it, over their interquartile range; null until there are four that differ."""
    if n < 4:
        return None
    q1, q2, q3 = (quantile_of(at, n, p) for p in (0.25, 0.5, 0.75))
    return (v - q2) / (q3 - q1) if q3 > q1 else None


#: Values a block of the expanding normaliser's state may hold before it is split in two.
BLOCK = 512


def expanding_normaliser(stream: DataFrame, rec: str = "rec", order: str = "idx", x: str = "x", window: int | None = None) -> DataFrame:
    """rec, order and z: each sample less the median of those before it, over their interquartile range (null until four are known).

    The state of a recording is its samples in sorted blocks of at most BLOCK values, with an index of their least values and
    sizes. A batch reads the index, and reads and writes the blocks its samples fall into and those that hold the quartiles,
    so what it writes grows with the batch and not with the history. It needs Spark's RocksDB state store. With `window`
    median and range are those of the last so many samples, which are the state. Rows must arrive in order from batch to
    batch, and are sorted by `order` inside one. Null and NaN samples have a null z and aren't kept.
    """
    kinds = dict(stream.dtypes)
    rows, schema = stream.select(rec, order, F.col(x).cast("double").alias(x)), f"{rec} {kinds[rec]}, {order} {kinds[order]}, z double"
    if window is not None:
        return _windowed(rows, rec, order, x, window, schema)
    from pyspark.sql.streaming import StatefulProcessor

    class Blocks(StatefulProcessor):
        def init(self, handle):
            self.index = handle.getMapState("index", "id int", "least double, n int")
            self.blocks = handle.getMapState("blocks", "id int", "v array<double>")

        def handleInputRows(self, key, rows, timerValues):
            import bisect

            import numpy as np
            import pandas as pd

            found = sorted((lo, i, n) for (i,), (lo, n) in self.index.iterator())
            least, ids, sizes = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]
            held, changed, fresh = {}, set(), max(ids, default=-1) + 1
            ends = np.cumsum(sizes)

            def block(i):
                if i not in held:
                    held[i] = list(self.blocks.getValue((i,))[0])
                return held[i]

            def at(k):
                b = int(np.searchsorted(ends, k, "right"))
                return block(ids[b])[k - (int(ends[b - 1]) if b else 0)]

            batch = pd.concat(list(rows)).sort_values(order, kind="stable")
            out = []
            for v in batch[x].to_numpy(float).tolist():
                if v != v:
                    out.append(None)
                    continue
                out.append(scaled_by(v, at, int(ends[-1]) if len(ends) else 0))
                b = max(bisect.bisect_right(least, v) - 1, 0)
                if not ids:
                    least, ids, sizes, held[fresh] = [v], [fresh], [0], []
                    fresh += 1
                mine = block(ids[b])
                bisect.insort(mine, v)
                changed.add(ids[b])
                least[b], sizes[b] = mine[0], len(mine)
                if len(mine) > BLOCK:
                    half = len(mine) // 2
                    held[ids[b]], held[fresh] = mine[:half], mine[half:]
                    least.insert(b + 1, mine[half])
                    sizes[b : b + 1] = [half, len(mine) - half]
                    ids.insert(b + 1, fresh)
                    changed.add(fresh)
                    fresh += 1
                ends = np.cumsum(sizes)
            for i in changed:
                self.blocks.updateValue((i,), (held[i],))
                self.index.updateValue((i,), (held[i][0], len(held[i])))
            yield pd.DataFrame({rec: batch[rec].to_numpy(), order: batch[order].to_numpy(), "z": pd.Series(out, dtype="float64")})

        def close(self):
            pass

    return rows.groupBy(rec).transformWithStateInPandas(Blocks(), schema, "Append", "None")


def _windowed(rows: DataFrame, rec: str, order: str, x: str, window: int, schema: str) -> DataFrame:
    """expanding_normaliser() over the last `window` samples."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator, state: GroupState):
        import bisect
        from collections import deque

        import pandas as pd

        seen = deque(state.get[0] if state.exists else [])
        ranked = sorted(seen)
        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for v in batch[x].to_numpy(float).tolist():
            if v != v:
                out.append(None)
                continue
            out.append(scaled_by(v, ranked.__getitem__, len(ranked)))
            seen.append(v)
            bisect.insort(ranked, v)
            if len(seen) > window:
                ranked.pop(bisect.bisect_left(ranked, seen.popleft()))
        state.update((list(seen),))
        yield pd.DataFrame({rec: batch[rec].to_numpy(), order: batch[order].to_numpy(), "z": pd.Series(out, dtype="float64")})

    return rows.groupBy(rec).applyInPandasWithState(step, schema, "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def beats(stream: DataFrame, fs: float, rec: str = "rec", order: str = "idx", energy: str = "energy", limit: float | None = None, search_back: bool = False) -> DataFrame:
    """rec and at (value of `order`) of each beat, as soon as later samples can't change it (signals.BeatStream).

    Rows are the detector's energy (signals.filter_chain), a sample each, and must arrive in order from batch to batch and
    without gaps; batches of any size give the same beats. Null and NaN energy counts as 0.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from pulseforge.operators.signals import BeatStream

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        first, text = state.get if state.exists else (int(batch[order].iloc[0]), None)
        held = BeatStream.load(text) if text else BeatStream(fs, limit, search_back)
        found = held.push(batch[energy].fillna(0.0).to_numpy(float))
        state.update((first, held.dump()))
        yield pd.DataFrame({rec: [key[0]] * len(found), "at": [first + i for i in found]})

    kinds = dict(stream.dtypes)
    return stream.select(rec, order, F.col(energy).cast("double").alias(energy)).groupBy(rec).applyInPandasWithState(step, f"{rec} {kinds[rec]}, at long", "first long, held string", "append", GroupStateTimeout.NoTimeout)


def run_alarm(stream: DataFrame, n: int, rec: str = "rec", order: str = "idx", flag: str = "flag") -> DataFrame:
    """A row when the run of flags of a recording first reaches n; the state is the length of the open run."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        (run,) = state.get if state.exists else (0,)
        for pdf in batches:
            pdf = pdf.sort_values(order)
            hits = []
            for at, f in zip(pdf[order], pdf[flag], strict=True):
                run = run + 1 if f else 0
                if run == n:
                    hits.append(at)
            yield pd.DataFrame({rec: [key[0]] * len(hits), "at": hits})
        state.update((run,))

    kinds = dict(stream.dtypes)
    return stream.select(rec, order, flag).groupBy(rec).applyInPandasWithState(step, f"{rec} {kinds[rec]}, at {kinds[order]}", "run long", "append", GroupStateTimeout.NoTimeout)
