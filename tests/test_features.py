import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.operators import events, features, labels, scoring, windows


def test_prune_and_edges(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=200)
    rows = [(float(x), float(2 * x), 1.0, float(y), None) for x, y in zip(a, rng.normal(size=200), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert features.prune(df, ["a", "b", "c", "d", "e"]) == ["b", "d"]


def test_normalise_start_up(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([3, 1, 2, 8, 5, 9])] + [("one", 0, 4.0), ("flat", 0, 1.0), ("flat", 1, 1.0)], "rec string, idx int, x double")
    got = {(r.rec, r.idx): r.x for r in features.normalise(df, ["x"], "rec", ["idx"]).collect()}
    assert got["one", 0] == 0.0 and got["flat", 0] == got["flat", 1] == 0.0
    before = [3, 1, 2, 8]
    iqr = np.percentile(before, 75) - np.percentile(before, 25)
    assert abs(got["r", 4] - (5 - np.median(before)) / iqr) < 1e-12
    assert abs(got["r", 0] - (3 - np.median([3, 1, 2, 8, 5, 9])) / iqr) < 1e-12
    with pytest.raises(ValueError):
        features.normalise(df, ["x"], "rec", ["idx"], "other")
    with pytest.raises(ValueError):
        features.drop_recordings(df, "rec", ["nothing"])
    assert features.drop_recordings(df, "rec", ["fla"]).select("rec").distinct().count() == 2


def test_labels_ties_and_reach(spark):
    probes = spark.createDataFrame([("r", t) for t in (-11.0, -5.0, 5.0, 25.0, 60.0)] + [("none", 1.0)], "rec string, t double")
    readings = spark.createDataFrame([("r", 0.0, 10.0), ("r", 10.0, 20.0), ("r", 50.0, 30.0), ("r", 30.0, None)], "rec string, t double, y double")
    got = {(r.rec, r.t): (r.valid, r.y) for r in labels.as_of(probes, readings, mode="nearest").collect()}
    assert got["r", 5.0] == (True, 10.0) and got["r", -5.0] == (True, 10.0) and got["r", -11.0] == (False, None) and got["r", 25.0] == (False, None) and got["r", 60.0] == (True, 30.0) and got["none", 1.0] == (False, None)
    assert {(r.t): r.y for r in labels.as_of(probes, readings, mode="interp").collect() if r.rec == "r"}[5.0] == 15.0


def test_higuchi_of_known_curves(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=1500)
    rows = [(n, 0, i, float(v)) for n, s in (("line", np.arange(1500.0)), ("white", noise), ("walk", np.cumsum(noise))) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "rec string, w int, idx int, x double")
    got = {r.rec: r.fractal_dimension for r in windows.higuchi(df).collect()}
    assert abs(got["line"] - 1) < 0.01 and abs(got["white"] - 2) < 0.05 and abs(got["walk"] - 1.5) < 0.08


def test_runs_and_grades(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, True, False, True, True, True])], "rec string, idx int, flag boolean")
    assert events.first_run(df, "flag", ["rec"], "idx", 3).first().at == 5
    assert events.first_run(df, "flag", ["rec"], "idx", 4).first().at is None
    e = spark.createDataFrame([(1, 5.0), (1, -5.0), (2, 10.0), (3, None)], "k int, e double")
    got = {r.k: (r.bhs, r.ieee, r.aami) for r in scoring.standards(e, "e", ["k"]).collect()}
    assert got[1] == ("A", "A", True) and got[2][0] == "D" and got[2][2] is False and got[3] == ("N/A", "N/A", False)
    lim = spark.createDataFrame([(x,) for x in (0.0, 0.25, 5.0, 5.01, -5.0)], "m double").select(scoring.iso_limit(F.col("m"))).collect()
    assert [round(r[0], 6) for r in lim] == [6.95, 6.91, 2.49, 0.0, 2.49]


def test_equal_errors_do_not_beat(spark, tmp_path):
    """Arms that both lie between a person's two middle values have equal errors, however their sums round; a smaller error is a win."""
    from pulseforge.plans.registry import QUERIES

    rng = np.random.default_rng(0)
    rows = []
    for p in range(60):
        half = int(rng.integers(5, 60))
        values = rng.permutation([*rng.uniform(0.05, 0.2, half), *rng.uniform(0.8, 0.95, half)])
        rows += [(p, i, p, float(v)) for i, v in enumerate(values)]
    rows += [(60, i, 60, 0.1) for i in range(8)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").withColumn("l_shipdate", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")))
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    told = {r.person: (r.gap, r.verdict) for r in QUERIES["gap_to_baseline"](spark, str(tmp_path)).collect()}
    assert told.pop(60)[1] == "BEATS"
    assert set(told.values()) == {(0.0, "does not beat")} and len(told) == 60
