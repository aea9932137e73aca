"""Variances and correlations of many columns in one pass, by sums of matrix products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Population variances of the columns, and their correlations over the rows with both values (NaN for constants).

    Each task adds up its rows as matrix products of values less the column's mean; what comes to the driver is at most
    64 rows of 4 x columns**2 numbers. Nulls, NaN and infinities are left out pair by pair.
    """
    d = len(cols)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    fine = lambda i: F.when(~F.isnan(f"c{i}") & (F.abs(f"c{i}") < float("inf")), F.col(f"c{i}"))
    first = rows.agg(*[F.avg(fine(i)) for i in range(d)]).first()
    mean = np.array([m or 0.0 for m in first])

    def sums(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((4, d, d))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - mean
            m = np.isfinite(x)
            x, m = np.where(m, x, 0.0), m.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["k", "m"])

    def added(key, pdf):
        import pandas as pd

        return pd.DataFrame({"k": [key[0]], "m": [np.sum(np.stack(pdf["m"].to_numpy()), 0).tolist()]})

    parts = rows.mapInArrow(sums, "k int, m array<double>").groupBy("k").applyInPandas(added, "k int, m array<double>").collect()
    n, s, q, p = np.sum([np.array(r.m) for r in parts], 0).reshape(4, d, d) if parts else np.zeros((4, d, d))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p / n - (s / n) * (s.T / n)
        var = q / n - (s / n) ** 2  # of the row's column, over the rows that have both
        spread = np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0))
        r = np.where(spread > 1e-12 * (1 + mean[:, None] ** 2), cov / spread, np.nan)
    own = np.diag(var).copy()
    return np.where(np.diag(n) > 0, np.maximum(own, 0), np.nan), r
