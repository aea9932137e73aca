import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.operators import features as fx
from pulseforge.sources import recordings as rc
from pulseforge.streaming import causal


def test_recording_text(spark, tmp_path):
    head = ["x"] * 3 + ["0.5 ms/sample"] + ["é"] * 10
    body = [f"{i},{i * 0.1:.1f},{'NaN' if i == 3 else i},bad" for i in range(20)]
    (tmp_path / "a.txt").write_text("\n".join(head + body), encoding="latin1")
    rows = rc.read_recordings(spark, str(tmp_path / "a.txt"), ["CH1", "CH40", "CH41"]).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in rows] == list(range(20)) and {r.fs for r in rows} == {2000.0}
    assert [r.CH40 for r in rows][:5] == [0.0, 1.0, 2.0, 0.0, 4.0] and {r.CH41 for r in rows} == {0.0}
    part = rc.read_recordings(spark, str(tmp_path / "a.txt"), ["CH1"], start=0.001, duration=0.002, delay=0.0005).orderBy("sample_idx").collect()
    assert [round(r.CH1, 1) for r in part] == [0.3, 0.4, 0.5, 0.6]


def test_persons_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("s1_full",), ("s1_session2_cut",), ("s2_session10",)], "subject string")
    assert [r[0] for r in df.select(rc.person_key(F.col("subject"))).collect()] == ["s1", "s1", "s2"]
    people = spark.createDataFrame([("s1_full", "p")], "subject string, person string")
    with pytest.raises(Exception, match="no person for"):
        rc.person_by_map(df, people).collect()
    t = spark.createDataFrame([("r", 0.0, 15.0, 1.0, True), ("r", 5.0, 20.0, 2.0, False)], "recording string, t_start double, t_center double, f double, usable boolean")
    assert rc.window_settings(t).first() == (30.0, 5.0)
    rc.write_features(t.withColumn("fs", F.lit(1)), f"{tmp_path}/f", ["fs"])
    assert rc.read_features(spark, f"{tmp_path}/f", ["f"], usable=True).count() == 1
    with pytest.raises(ValueError):
        rc.read_features(spark, f"{tmp_path}/f", ["g"])
    with pytest.raises(ValueError):
        rc.write_features(t, f"{tmp_path}/g", ["t_start"])


def test_pairs_counts_readings_and_packs(spark, tmp_path):
    for k, n in enumerate((20, 3)):
        (tmp_path / f"r{k}.txt").write_text("\n".join(["h"] * 14 + ["0,1,2,3"] * n), encoding="latin1")
    assert sorted(r.n_rows for r in rc.row_counts(spark, f"{tmp_path}/r*.txt").collect()) == [3, 20]
    left = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "rec string, sample_idx long, x double")
    right = spark.createDataFrame([("a", i, float(-i)) for i in range(8)], "rec string, sample_idx long, y double")
    assert rc.aligned_pair(left, right).count() == 8
    off = spark.createDataFrame([("a", 0.3, 0.0, 0.1)], "rec string, left_delay double, right_delay double, lead_in double")
    got = sorted((r.sample_idx, r.x, r.y) for r in rc.aligned_pair(left, right, offsets=off, fs=10.0).collect())
    assert got == [(i, float(i + 4), float(-(i + 1))) for i in range(6)]
    (tmp_path / "s1" / "windowing_labeling").mkdir(parents=True)
    (tmp_path / "s1" / "windowing_labeling" / "bp_labels.csv").write_text("Time_start_min,Time_end_min,SBP,DBP\n0,1,120,80\n1,2,,70\n")
    rows = sorted(tuple(r) for r in rc.read_readings(spark, f"{tmp_path}/*/windowing_labeling/bp_labels.csv").collect())
    assert rows == [("s1", 30.0, 120.0, 80.0), ("s1", 90.0, None, 70.0)]
    (tmp_path / "t.csv").write_text("recording,t_start,t_center,f,g,usable\nr,0,15,1,2,true\nr,5,20,3,4,false\n")
    rc.pack_csv(spark, f"{tmp_path}/t.csv", f"{tmp_path}/packed", ["f", "g"], 500.0, "interp")
    one = rc.read_features(spark, f"{tmp_path}/packed", ["f", "g"], usable=True).first()
    assert (one.window_sec, one.stride_sec, one.f) == (30.0, 5.0, 1)
    for names, labels in ((["g", "f"], None), (["f"], ["SBP"])):
        with pytest.raises(ValueError):
            rc.read_features(spark, f"{tmp_path}/packed", names, labels=labels)
    with pytest.raises(ValueError):
        rc.write_nerve_features(left.limit(0), f"{tmp_path}/n")
    with pytest.raises(ValueError):
        rc.write_ecg_features(left, f"{tmp_path}/n")
    for _ in range(2):
        rc.append_history(left, f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == 20


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(r, i, float(v), bool(v > 0)) for r in (1, 2) for i, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "rec long, idx long, x double, flag boolean").withColumn("ts", F.timestamp_seconds(F.col("idx")))
    for k in range(2):
        df.where((F.col("idx") >= 20 * k) & (F.col("idx") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    z = {(r.rec, r.idx): r.z for r in run(causal.expanding_normaliser(stream()), "z").collect()}
    want = fx.normalise(df, ["x"], "rec", ["idx"], "expanding", strict=True).collect()
    assert len(z) == 80
    assert all(abs(z[r.rec, r.idx] - r.x) < 1e-9 for r in want if r.idx >= 4)
    alarms = sorted(tuple(r) for r in run(causal.run_alarm(stream(), 3), "alarm").collect())
    expect = []
    for rec in (1, 2):
        n = 0
        for r, i, _, f in rows:
            if r == rec:
                n = n + 1 if f else 0
                expect += [(rec, i)] if n == 3 else []
    assert alarms == sorted(expect)
    w = run(causal.window_features(stream(), length="10 seconds", slide="5 seconds", late="0 seconds"), "w").collect()
    assert w and all(r.n <= 10 for r in w)


def test_expanding_normaliser_keeps_long_recordings(spark, tmp_path):
    values = np.arange(5200.0) ** 1.5
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "rec long, idx long, x double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = causal.expanding_normaliser(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("long").start()
    q.processAllAvailable()
    q.stop()
    z = {r.idx: r.z for r in spark.table("long").collect()}
    for i in (5000, 5001, 5199):
        q1, q2, q3 = np.percentile(values[:i], [25, 50, 75])
        assert abs(z[i] - (values[i] - q2) / (q3 - q1)) < 1e-9
