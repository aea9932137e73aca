"""Ranges with cut points of each group, and the quantiles that rest on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.functions import ranges


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(6)
    scale = 10.0 ** np.linspace(-3, 3, 19)
    columns = {f"f{i}": rng.normal(size=(9000 if i == 0 else 200)) * s for i, s in enumerate(scale)}
    rows = [(c, float(v)) for c, values in columns.items() for v in values]
    return spark.createDataFrame(rows, "feature string, value double").repartition(3).cache(), columns


@pytest.mark.parametrize("parts", [2, 16, 100])
def test_every_range_is_a_part(long, parts):
    df, _ = long
    rows = ranges.ranged_by(df, ["feature"], "value", "r", parts)(df)
    sizes = [r["count"] for r in rows.groupBy("feature", "r").count().collect()]
    assert sum(sizes) == df.count() and max(sizes) < 2.2 * df.count() / parts + 1
    mixed = rows.groupBy("feature", "r").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("feature", "r").collect()
    assert all(a.hi < b.lo for a, b in zip(mixed, mixed[1:], strict=False) if a.feature == b.feature)


def test_quantiles_of_groups_equal_numpy(long):
    df, columns = long
    told = {r.feature: (r.n, r.q) for r in ranges.quantiles(df, ["feature"], "value", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()}
    assert set(told) == set(columns)
    for c, v in columns.items():
        assert told[c][0] == len(v) and np.allclose(told[c][1], np.quantile(v, [0.0, 0.05, 0.5, 0.95, 1.0]), rtol=1e-12, atol=0)


def test_edges(spark):
    rows = [("a", 1.0)] * 50 + [("b", None), ("b", float("nan")), (None, 3.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    ranged = ranges.ranged_by(df, ["g"], "value", "r", 8)(df)
    assert ranged.count() == len(rows) and ranged.where("g = 'c' and r = 0").count() == 1
    assert ranged.where("g = 'a'").select("r").distinct().count() == 1  # equal values share a range
    assert {r.g: r.q for r in ranges.quantiles(df, ["g"], "value", [0.5]).collect() if r.g} == {"a": [1.0], "c": [2.0]}
    assert ranges.ranged_by(df.limit(0), ["g"], "value", "r", 8)(df.limit(0)).count() == 0
