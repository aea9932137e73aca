import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.functions import expanding, kernels, ranges
from pulseforge.operators import engineer as en
from pulseforge.operators import features as fx
from pulseforge.operators import labels, recordings, scoring, windows
from tests.test_signals_models import train


def samples(spark, recs):
    rows = [(r, i, *map(float, v)) for r, cols in recs.items() for i, v in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(rows, "rec string, sample_idx long, ecg double, raw double")


def test_stage_one_isolates_failures(spark):
    fs = 500
    up, down = train(60, fs, 20), train(75, fs, 20, -1.0)
    late = np.concatenate([np.zeros(200), up])[: len(up)]
    df = samples(spark, {"up": (late, up), "down": (down, down), "flat": (np.zeros(9000), np.zeros(9000)), "short": (up[:100], up[:100])})
    got = {r.rec: r for r in recordings.stage_one(df, fs, raw="raw").collect()}
    assert got["up"].status == "ok" and got["up"].upright and abs(got["up"].delay_sec - 0.4) < 0.02 and abs(got["up"].clock_offset_sec - got["up"].delay_sec) < 1e-9
    assert got["down"].status == "ok" and not got["down"].upright and got["down"].delay_sec == 0.0
    assert got["flat"].status != "ok" and "less than two seconds" in got["short"].status and got["short"].beats is None
    report = {r.rec: r for r in recordings.quality_report(recordings.stage_one(df, fs), fs).collect()}
    assert abs(report["down"].mean_hr - 75) < 1 and report["flat"].mean_hr is None and report["up"].length % 256 == 0
    beats = recordings.beat_rows(recordings.stage_one(df, fs, start=1.0), fs).where("rec = 'down'").collect()
    assert all(abs(b.t_raw - b.t - 1.0) < 1e-9 for b in beats)


def test_window_tables(spark):
    fs = 500
    df = samples(spark, {"a": (train(60, fs, 25),) * 2, "bad": (np.zeros(5000),) * 2})
    rows = recordings.ecg_windows(df, fs, 10.0, 5.0).collect()
    ok = sorted((r for r in rows if r.status == "ok"), key=lambda r: r.window_idx)
    assert [r.t_start_sec for r in ok] == [0.0, 5.0, 10.0, 15.0] and [r.t_center_sec for r in ok] == [5.0, 10.0, 15.0, 20.0]
    assert all(9 <= r.n_beats <= 11 and abs(r.meanNN - 1000) < 5 and r.QRS_duration < 150 for r in ok) and not any(r.lf_reliable for r in ok)
    assert [r.status for r in rows if r.rec == "bad"] != ["ok"]
    assert set(recordings.ECG_FEATURES) < set(rows[0].asDict())
    fs, t = 2200, np.arange(2200 * 4) / 2200
    x = 0.01 * (1 + 0.8 * np.sin(2 * np.pi * 2 * t)) * np.sin(2 * np.pi * 700 * t)
    nerve = recordings.nerve_windows(samples(spark, {"n": (x, x)}), fs, 2.0, 1.0, x="ecg").collect()
    assert len(nerve) == 3 and {r.dfSKNA for r in nerve} == {2.0} and all(r.rmsSKNA > r.aSKNA > 0 for r in nerve)
    slow = recordings.nerve_windows(samples(spark, {"n": (x, x)}), 500, x="ecg").collect()
    assert len(slow) == 1 and "no band" in slow[0].status


def test_kernels_equal_dataframe_forms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    df = spark.createDataFrame([("r", i // 100, i, float(v)) for i, v in enumerate(x)], "rec string, w long, idx long, x double")
    amp = {r.w: r for r in windows.amplitude(df, 2.0, 0.5).join(windows.moments(df), ["rec", "w"]).collect()}
    more = {r.w: r for r in windows.hjorth(df).join(windows.entropy(df), ["rec", "w"]).join(windows.higuchi(df), ["rec", "w"]).join(windows.autocorrelation(df, 3), ["rec", "w"]).collect()}
    for w in range(4):
        part = x[100 * w : 100 * w + 100]
        for n, v in kernels.amplitude(part, 2.0, 0.5).items():
            assert abs(amp[w][n] - v) < 1e-9, n
        want = [*kernels.hjorth(part), kernels.entropy(part), kernels.higuchi(part), kernels.autocorrelation(part, 3)]
        assert np.allclose([more[w][n] for n in ("mobility", "complexity", "entropy", "fractal_dimension", "autocorrelation")], want)


def test_beat_vectors_and_labels(spark, tmp_path):
    fs = 500
    ecg, other = train(60, fs, 12), np.random.default_rng(0).normal(size=12 * fs)
    df = samples(spark, {"a": (ecg, other)})
    assert recordings.layout({"ecg": 512, "skna": 4352}) == {"ecg": (0, 512), "skna": (512, 4864), "duration": (4864, 4865)}
    rows = recordings.beat_vectors(df, fs, {"ecg": 64, "raw": 32}).collect()
    assert all(len(r.vec) == 97 and abs(r.vec[-1] - r.dur) < 1e-6 and r.keep == (0.5 <= r.dur <= 2.5) for r in rows)
    part = recordings.beat_vectors(df, fs, {"ecg": 64}, norm="segment").first().vec[:64]
    assert abs(np.mean(part)) < 1e-5 and abs(np.std(part) - 1) < 1e-4
    assert np.array_equal(kernels.fixed_length(np.arange(4.0), 7, "interp"), np.linspace(0, 3, 7)) and not kernels.fixed_length(np.ones(1), 5).any()
    readings = spark.createDataFrame([("a", 2.0, 120.0, 80.0), ("a", 4.0, 130.0, float("nan"))], "rec string, t double, SBP double, DBP double")
    beats = recordings.beat_vectors(df, fs, {"ecg": 8}).drop("vec", "status")
    told = recordings.label_beats(beats, readings, ["SBP", "DBP"]).collect()
    vectors, seqs = recordings.stage_two(df, fs, 3, 2, lengths={"ecg": 8})
    recordings.write_beats(vectors, seqs, f"{tmp_path}/beats")
    found = spark.read.parquet(f"{tmp_path}/beats/sequences").collect()
    assert [list(r.seq) for r in sorted(found, key=lambda r: r.idx)][:2] == [[0, 1, 2], [2, 3, 4]] and spark.read.parquet(f"{tmp_path}/beats/beats").count() == len(rows)
    some = beats.withColumn("usable", F.col("beat_idx") != 3)
    assert all(3 not in r.seq for r in recordings.usable_sequences(seqs, some).collect()) and recordings.usable_sequences(seqs, some).count() == len(found) - 1
    assert len(told) == len(rows) and all(r.usable for r in told if r.t_center_sec < 12) and {r.DBP for r in told} == {80.0}


def test_lead_in_rows_equal_the_kernel(spark):
    from pulseforge.operators import signals

    rng = np.random.default_rng(1)
    for k, scale in enumerate((1, 30, 30)):
        y = rng.normal(size=3000)
        y[: 150 * k] *= scale
        df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(y)], "rec string, idx long, x double")
        want = signals.lead_in(y, 10.0, most=60.0)
        got = recordings.lead_in_rows(df, "rec", "idx", "x", 2, 600, 600, 20).first().lead_in
        assert got == round(want * 10), (k, got, want)


def test_expanding_quantiles_and_long_recordings(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=300), np.round(rng.normal(size=200), 1), np.arange(50.0)[::-1], np.ones(9), np.zeros(0)):
        got = expanding.expanding_quantiles(x, [0.25, 0.5, 0.75])
        for i in range(1, len(x) + 1):
            assert np.allclose(got[i], np.percentile(x[:i], [25, 50, 75]))
    df = spark.range(8000).select(F.lit(1).alias("rec"), F.col("id").alias("idx"), F.sin(F.col("id") * 7.3).alias("x"), F.when(F.col("id") % 3 > 0, F.cos("id")).alias("z"))
    out = fx.normalise(df, ["x", "z"], "rec", ["idx"]).orderBy("idx").collect()
    z = [r.z for r in df.orderBy("idx").collect()]
    assert all((r.z is None) == (v is None) for r, v in zip(out, z, strict=True)) and len(out) == 8000


def test_rankings(spark):
    stats = spark.createDataFrame([("a", 0.1, None), ("b", -0.9, 0.2), ("c", float("nan"), 0.3), ("d", 0.9, 0.1)], "feature string, r_pooled double, r_within double")
    assert [r.feature for r in fx.top_features(stats, "r_pooled", 3).orderBy("rank").collect()] == ["b", "d", "a"]
    assert fx.top_features(stats, "r_within", 4).where("rank = 4").first().feature == "a"
    with pytest.raises(ValueError):
        fx.top_features(stats, "other")


def test_range_quantiles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 2000), np.round(rng.standard_cauchy(2000), 1), strict=True)] + [(9, 5.0), (8, None), (8, float("nan")), (7, 1.0), (7, 2.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    qs = [0.0, 0.03, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", qs).collect()}
    for g in (0, 1, 2, 7, 9):
        v = [x for k, x in rows if k == g]
        assert got[g].n == len(v) and np.allclose(got[g].q, np.quantile(v, qs))
    assert 8 not in got
    every = ranges.quantiles(df, [], "v", [0.5]).first()
    assert np.isclose(every.q[0], np.median([v for _, v in rows if v is not None and v == v]))


def test_splits(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(8)] + [("b", i, float(i)) for i in range(20)], "rec string, i long, y double")
    got = scoring.temporal_split(df, "rec", ["i"]).collect()
    assert [r.slice for r in sorted((r for r in got if r.rec == "a"), key=lambda r: r.i)] == ["adapt"] * 3 + ["val"] + ["test"] * 4 or sum(r.slice == "val" for r in got if r.rec == "a") == 1
    cv = {(r.rec, r.block): r.p for r in scoring.blocked_cv_mean(df, "rec", ["i"], 4, 2).collect()}
    assert cv["a", 0] is None and np.isclose(cv["b", 1], np.mean([0, 1, 2, *range(12, 20)]))
    probes = spark.createDataFrame([("r", 1.0)], "rec string, t double")
    readings = spark.createDataFrame([("r", 1.0, float("nan")), ("r", 3.0, 7.0)], "rec string, t double, y double")
    assert labels.as_of(probes, readings).first().y == 7.0


def test_engineering_outputs(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"s{r}", r, w, 30.0 * w, *map(float, rng.uniform(1, 3, 3)), 12, 120.0, 80.0, True, w != 3) for r in range(3) for w in range(30)]
    ecg = spark.createDataFrame(rows, "Subject_ID string, Recording long, window_idx long, t_center_sec double, meanNN double, SDNN double, RMSSD double, n_beats int, SBP double, DBP double, usable boolean, label_valid boolean")
    skna = ecg.select(*en.KEY, "t_center_sec", (F.col("meanNN") * 2).alias("aSKNA"), F.col("SDNN").alias("varSKNA"))
    df, cols, notes = en.engineer(ecg, skna, k=2)
    assert df.count() == 87 and "aSKNA_x_HR" in cols and "HR_slope" in cols and "label_valid" not in cols and notes[-1].startswith(str(len(cols)))
    en.write_engineered(df, cols, notes, f"{tmp_path}/out", {"k": 2})
    assert spark.read.parquet(f"{tmp_path}/out/table").count() == 87
    one = spark.read.parquet(f"{tmp_path}/out/matrix").first()
    assert len(one.X) == len(cols) and one.y_sbp == 120.0 and spark.read.text(f"{tmp_path}/out/report").count() == len(notes) + len(cols) + 2
    built = []
    make = lambda: built.append(1) or df
    for settings, force in (({"k": 2}, False), ({"k": 2}, False), ({"k": 3}, False), ({"k": 3}, True)):
        assert en.cached(spark, f"{tmp_path}/cache", settings, make, force).count() == 87
    assert len(built) == 3
    raw, cols2, _ = en.engineer(ecg, skna, "robust", keep_raw=True, winsorise=(0.05, 0.95), twins=("s0", "s1"))
    assert raw.select("Subject_ID").distinct().count() == 2 and "SDNN_n" in cols2 and "meanNN" in raw.columns


def test_names_catalog_and_predictions(spark, tmp_path):
    assert en.base_of("R_slope_slope") == ("R_slope", "_slope") and en.family_of("aSKNA_x_HR_rm2") == "XSIG" and en.family_of("aSKNA_d1") == "SKNA"
    with pytest.raises(KeyError):
        en.base_of("unknown")
    assert en.columns_of(["HR", "HR_d1", "aSKNA"], "FS2_HRV", levels_only=True) == ["HR"]
    told = {r.feature: r for r in en.describe(spark.createDataFrame([(c,) for c in ("HR", "HR_rm2", "R_slope", "R_slope_slope")], "feature string")).collect()}
    assert (told["HR_rm2"].kind, told["HR_rm2"].rows, told["R_slope"].kind, told["R_slope_slope"].base) == ("rm", 3, "level", "R_slope") and "15 s" in told["HR_rm2"].description
    cat = {r.subject: (r.person, r.excluded) for r in en.catalog(spark, [("s5_session1", "x"), ("s13_full", "y")], ["s13_full"]).collect()}
    assert cat == {"s5_session1": ("s5", False), "s13_full": ("s13", True)}
    df = spark.createDataFrame([(r, f"p{r // 2}") for r in range(8)], "rec long, person string")
    kept, lost = en.exclude_recordings(df, "rec", "person", [0, 1, 2])
    assert lost == ["p0"] and kept.count() == 5
    for bad in ([99], [0, 1, 2, 3, 4, 5]):
        with pytest.raises(ValueError):
            en.exclude_recordings(df, "rec", "person", bad)
    pred = spark.createDataFrame([("a", 120.0, 121.0, 125.0), ("b", 130.0, 129.0, 140.0)], "person string, SBP_true double, SBP_pred double, SBP_amean double")
    for k in range(2):
        pred.coalesce(1).write.option("header", True).csv(f"{tmp_path}/run/fold_{k}/predictions.csv")
    arms = {r.arm: r for r in en.graded_arms(pred).collect()}
    assert set(arms) == {"pred", "amean"} and arms["pred"].bhs == "A" and arms["amean"].n_persons == 2
    assert en.pooled_predictions(spark, f"{tmp_path}/run", "fold_*/predictions.csv/*.csv").count() == 4
    with pytest.raises(ValueError):
        en.graded_arms(pred.select("person"))
    curves = spark.createDataFrame([("a", i, s, "SBP", 5.0 - i / 10, 4.5) for i in (10, 20) for s in ("train", "held-out")] + [("b", i, "held-out", "SBP", 9.0, 4.5) for i in (10, 20)], "fold string, iter long, split string, channel string, mae double, base double")
    by, ends = en.curve_summary(curves)
    assert by.where("iter = 20 and split = 'held-out'").first().mean == 6.0 and (ends.first().wins, ends.first().n_folds) == (1, 2)


def test_expanding_groups_equal_single_recordings(spark):
    """Recordings of every length, many of the same and alone, with missing, infinite, constant and repeated values, also when a recording spans batches."""
    rng = np.random.default_rng(8)
    recs = [rng.normal(size=n) for n in [1] * 3 + [2] * 4 + [5] * 40 + [12] * 30 + [40] * 11 + [64, 300]]
    for k, odd in ((3, np.nan), (8, np.inf), (9, np.nan), (60, -np.inf)):
        recs[k][len(recs[k]) // 2] = odd
    recs[10][:], recs[11][:4], recs[12] = 2.5, 1.0, np.round(recs[12])
    edges = np.append(0, np.cumsum([len(x) for x in recs]))
    for strict in (False, True):
        with np.errstate(invalid="ignore"):
            got = expanding.scaled_groups(np.concatenate(recs), edges, 10, 4, strict)
            want = [expanding.scaled(x, 10, 4, strict) for x in recs]
        assert np.array_equal(got, np.concatenate(want), equal_nan=True)
    rows = [(None if r == 5 else f"s{r}", i, float(v)) for r, x in enumerate(recs) for i, v in enumerate(x) if np.isfinite(v)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "rec string, i long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        told = fx.normalise(df, ["x"], "rec", ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {(r.rec, r.i): r.x for r in told}
    assert len(told) == len(by) == len(rows)
    for r, x in enumerate(recs):
        keep = np.flatnonzero(np.isfinite(x))
        assert [by[None if r == 5 else f"s{r}", i] for i in keep] == expanding.scaled(x[keep], 10, 4, False).tolist()


def test_engineer_reads_its_tables_once(spark):
    rng = np.random.default_rng(9)
    seen = {name: spark.sparkContext.accumulator(0) for name in ("ecg", "skna")}

    def counted(df, name):
        def run(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    rows = [(f"s{r}", r, w, 30.0 * w, *map(float, rng.uniform(1, 3, 3)), 12, 120.0, 80.0, True, True) for r in range(3) for w in range(20)]
    plain = spark.createDataFrame(rows, "Subject_ID string, Recording long, window_idx long, t_center_sec double, meanNN double, SDNN double, RMSSD double, n_beats int, SBP double, DBP double, usable boolean, label_valid boolean")
    # a recording without any value of a column, and one that lacks a value
    gone = F.when((F.col("Recording") != 1) & ~((F.col("Recording") == 2) & (F.col("window_idx") == 4)), F.col("RMSSD"))
    skna = plain.select(*en.KEY, "t_center_sec", (F.col("meanNN") * 2).alias("aSKNA"), F.col("SDNN").alias("varSKNA"))
    df, cols, _ = en.engineer(counted(plain.withColumn("RMSSD", gone), "ecg"), counted(skna, "skna"), "none", pruned=False)
    got = {(r.Recording, r.window_idx): r.RMSSD for r in df.collect()}
    assert len(got) == 60 and {n: a.value for n, a in seen.items()} == {"ecg": 60, "skna": 60}
    x = np.array([r[6] for r in rows]).reshape(3, 20)
    there = np.ones((3, 20), bool)
    there[1], there[2, 4] = False, False
    assert got[1, 0] == got[1, 19] == np.median(x[there]) and got[2, 4] == np.median(x[2][there[2]]) and got[0, 3] == x[0, 3]
