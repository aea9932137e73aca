import numpy as np
from pyspark.sql import functions as F

from pulseforge.operators import models, networks, scoring, signals
from pulseforge.plans import signal_queries


def train(bpm, fs, seconds, sign=1.0, transient=1.0):
    t = np.arange(int(seconds * fs)) / fs
    phase = (t - 0.3) % (60 / bpm)
    x = sign * np.exp(-(((phase - 0.25) / 0.01) ** 2)) + 0.1 * np.exp(-(((phase - 0.5) / 0.04) ** 2))
    x[: int(0.2 * fs)] *= transient
    return x + 0.005 * np.random.default_rng(0).normal(size=len(x))


def test_beats_of_both_polarities():
    for bpm, sign in ((60, 1.0), (75, -1.0)):
        at = signals.detect(train(bpm, 1000, 30, sign), 1000.0)
        assert abs(len(at) - bpm / 2) <= 1
        assert np.abs(np.diff(at) / 1000 - 60 / bpm).max() < 0.02
    x = train(60, 250, 60)
    x[:50] += 300
    assert len(signals.detect(x, 250.0)) > 50


def test_search_back_keeps_clear_of_the_next_beat():
    """A gap with one weak beat and a wave before the next: the weak one is found, and nothing closer than the refractory time."""
    fs = 250
    energy = np.zeros(fs * 20)
    beats = np.arange(1, 19) * fs
    for k, i in enumerate(beats):
        energy[i - 3 : i + 4] = [0.1, 0.4, 0.8, 1.0, 0.8, 0.4, 0.1]
        if k == 9:
            energy[i - 3 : i + 4] *= 0.2
    energy[beats[10] - 30] = 0.21
    plain, back = signals.decide(energy, fs), signals.decide(energy, fs, search_back=True)
    assert beats[9] not in plain and beats[9] in back and set(beats) <= set(back)
    assert np.diff(back).min() >= round(signals.REFRACTORY * fs)


def test_delineation_and_spectra():
    x = train(60, 500, 20)
    at = signals.detect(x, 500.0)
    land = signals.delineate(x, at, 500.0)
    assert np.nanmedian(land["qrs_dur"]) < 150 and np.isfinite(land["t_peak"]).sum() > 10 and np.nanmedian(land["t_r_ratio"]) > 0.05
    assert np.nanmedian(land["snr"]) > 20 and (land["t_end"] > land["t_peak"])[np.isfinite(land["t_end"])].all()
    down = signals.delineate(-x, at, 500.0, up=False)
    assert all(np.allclose(land[n], down[n] * (-1 if n == "baseline" else 1), equal_nan=True) for n in signals.LANDMARKS)
    beat_times = np.cumsum(1 + 0.05 * np.sin(2 * np.pi * 0.1 * np.arange(120)))
    lf, hf, _, ok = signals.lf_hf(np.diff(beat_times) * 1000, beat_times[1:])
    assert lf > 5 * hf and ok
    assert np.isnan(signals.lf_hf(np.ones(3), np.arange(3))[0])


def test_delay_and_lead_in():
    fs = 1000
    x = train(66, fs, 60)
    late = np.concatenate([np.zeros(2500), x])[: len(x)]
    delay, r = signals.channel_delay(x, late, fs)
    assert abs(delay - 2.5) <= 0.011 and r > 0.5
    assert signals.channel_delay(x[: 5 * fs], late[: 5 * fs], fs) == (0.0, 0.0)
    rng = np.random.default_rng(3)
    y = rng.normal(size=150 * 100)
    assert signals.lead_in(y, 100) == 0.0
    y[:750] *= 40
    y[5000:5100] *= 40  # a later artefact doesn't move it
    assert abs(signals.lead_in(y, 100) - 7.5) < 0.5
    y[: 60 * 100] = 40 * rng.normal(size=6000)
    assert signals.lead_in(y, 100) == 60.0


def test_nerve_chain_finds_the_modulation():
    fs, t = 4000.0, np.arange(40000) / 4000
    x = 0.001 * (1 + 0.8 * np.sin(2 * np.pi * t)) * np.sin(2 * np.pi * 700 * t) + 0.05 * np.sin(2 * np.pi * 60 * t)
    band, slow = signals.nerve_chain(x, fs)
    assert signals.dominant_frequency(slow) == 1.0
    scaled, slow2 = signals.nerve_chain(x, fs, "recording")
    assert abs(scaled.std() - 4.73) < 1e-9 and signals.dominant_frequency(slow2) == 1.0


def test_logistic_network_head_information():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    w = models.fit_logistic(x, y)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.9
    target = np.column_stack([np.sin(x[:, 0]), x[:, 1] * 0.5])
    net = models.Network(3, 10, 2).fit(x, target)
    assert np.abs(net.predict(x) - target).mean() < 0.12
    before = np.abs(net.predict(x[:100]) - (target[:100] + 1)).mean()
    tuned, epoch = models.tune_head(net, x[:100], target[:100] + 1, x[100:150], target[100:150] + 1)
    assert np.abs(tuned.predict(x[:100]) - (target[:100] + 1)).mean() < 0.5 * before and epoch > 0
    assert models.mutual_information(x[:, 0], x[:, 0] + 0.1 * x[:, 1]) > 1.0 > 0.1 > models.mutual_information(x[:, 0], x[:, 1])


def test_folds_do_not_leak(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, float(v), float(2 * v + rng.normal() * 0.1)) for p in range(4) for i, v in enumerate(rng.normal(size=30))]
    df = spark.createDataFrame(rows, "person long, i long, x double, y double")
    a = {(r.person, r.i): r.p for r in models.loso(df, ["x"], "y", "person", ["person", "i"][1:], model="network").collect()}
    other = df.withColumn("y", F.when(F.col("person") == 2, F.col("y") + 100).otherwise(F.col("y")))
    b = {(r.person, r.i): r.p for r in models.loso(other, ["x"], "y", "person", ["i"], model="network").collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a if k[0] == 2) and len(a) == 120
    assert any(abs(a[k] - b[k]) > 1 for k in a if k[0] == 1)


def test_neighbour_distances_equal_brute_force():
    rng = np.random.default_rng(2)
    for x, y in (rng.normal(size=(2, 700)), rng.standard_cauchy((2, 300)), np.round(rng.normal(size=(2, 400)), 1), rng.normal(size=(2, 4))):
        away = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        assert (models.neighbour_distances(x, y, 3) == np.partition(away, 3, 1)[:, 3]).all()


def test_all_recordings_take_part(spark):
    path = "/root/testdata/sf0.01"
    sizes = spark.read.parquet(f"{path}/events.parquet").groupBy("user_id").count().collect()
    want = {r["user_id"]: r["count"] - 1 for r in sizes if r["count"] > 1}
    got = {r["rec"]: r["count"] for r in signal_queries._design(spark, path).groupBy("rec").count().collect()}
    assert got == want and max(want) > 40 and sum(want.values()) == 9850


def test_networks_learn_by_all_solvers_and_units():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = np.column_stack([np.tanh(x[:, 0] - x[:, 1])])
    for how in ({"activation": "tanh"}, {"activation": "relu", "solver": "adam", "rate": 0.01}, {"hidden": (6, 6)}, {"solver": "sgd", "rate": 0.05, "activation": "tanh", "early_stopping": True}):
        net = models.Network(2, how.pop("hidden", 8), 1, 1e-4, **how).fit(x, y, 300)
        assert np.abs(net.predict(x) - y).mean() < 0.15, how
    w = net.w + 0.1
    value, grad = net.loss(w, x, y)
    for k in (0, 5, len(w) - 1):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs((net.loss(w + step, x, y)[0] - net.loss(w - step, x, y)[0]) / 2e-5 - grad[k]) < 1e-6
    cls = models.Network(2, 6, 1, 0.01, task="classes").fit(x, (y > 0).astype(float))
    assert ((cls.predict(x) > 0.5) == (y > 0)).mean() > 0.95
    assert models.architectures("5, 10x2,20") == [(5,), (10, 10), (20,)]


def test_ridge_and_logistic_by_sums_equal_explicit_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(int(p), i, *map(float, rng.normal(size=3)), float(p % 2)) for i, p in enumerate(rng.integers(0, 5, 300))]
    rows = [(p, i, a, b, c, 2 * a - b + c / 2, int(a + 0.5 * c + k > 0)) for p, i, a, b, c, k in rows]
    df = spark.createDataFrame(rows, "person long, i long, a double, b double, c double, y double, z int")
    got = {r.i: (r.y_pred, r.y_base) for r in models.loso_ridge(df, ["a", "b", "c"], ["y"], "person").collect()}
    x, y, who = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows]), np.array([r[0] for r in rows])
    for p in range(5):
        tr = who != p
        mean, dev = models.scaler(x[tr])
        q = (x - mean) / dev
        w = np.linalg.solve(q[tr].T @ q[tr] + 10 * np.eye(3), q[tr].T @ (y[tr] - y[tr].mean()))
        for i in np.flatnonzero(~tr):
            assert abs(got[i][0] - (q[i] @ w + y[tr].mean())) < 1e-8 and abs(got[i][1] - y[tr].mean()) < 1e-9
    a = {r.i: (r.p, r.thr) for r in models.loso_logistic(df, ["a", "b", "c"], "z", "person", ["i"]).collect()}
    z, b = np.array([r[6] for r in rows]), {}
    for p in range(5):
        tr = who != p
        mean, dev = models.scaler(x[tr])
        q = (x - mean) / dev
        w = models.fit_logistic(q[tr], z[tr].astype(float))
        chance = 1 / (1 + np.exp(-(q @ w[:-1] + w[-1])))
        b |= {i: (chance[i], np.quantile(chance[tr & (z == 0)], 0.95)) for i in np.flatnonzero(~tr).tolist()}
    assert a.keys() == b.keys() and all(abs(a[i][0] - b[i][0]) < 1e-4 and abs(a[i][1] - b[i][1]) < 1e-3 for i in a)


def test_nested_choice_and_model_file(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(p, i, float(v), float(np.sin(3 * v)) + 5 * p) for p in range(3) for i, v in enumerate(rng.uniform(-1, 1, 60))]
    df = spark.createDataFrame(rows, "person long, i long, x double, y double")
    out = networks.nested_loso(df, ["x"], ["y"], "person", "i", ["i"], [(1,), (8,)], "offset", 1000.0).collect()
    assert {r.picked for r in out} == {"8"} and len(out) == 180
    assert np.mean([abs(r.y_pred - r.y_true) for r in out]) < 0.2 < np.mean([abs(r.y_zero - r.y_true) for r in out])
    net = models.Network(2, (3, 2), 1, activation="tanh")
    models.save_model(spark, f"{tmp_path}/m", net, ["a", "b"], np.zeros(2), np.ones(2), {"stride": 5})
    again, body = models.load_model(spark, f"{tmp_path}/m")
    z = rng.normal(size=(5, 2))
    assert np.array_equal(again.predict(z), net.predict(z)) and body["features"] == ["a", "b"] and body["settings"] == {"stride": 5}


def test_fits_have_the_steps_of_the_reference(monkeypatch):
    given = []
    monkeypatch.setattr(models, "minimise", lambda f, w, steps=200, **rest: given.append(steps) or w)
    models.fit_logistic(np.ones((4, 1)), np.array([0.0, 1, 0, 1]))
    models.Network(1, 2, 1).fit(np.ones((4, 1)), np.ones((4, 1)))
    assert given == [2000, 1000]


def test_spectral_windows_equal_single_ones(spark):
    """Windows of several recordings in any order of rows; too few intervals, missing values and coinciding times give nulls or leave intervals out, and stop nothing."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for r, n in enumerate((3, 4, 9, 32, 32, 90)):
        for w in range(3):
            at = np.cumsum(rng.uniform(0.4, 2.5, n)) + 100 * w
            nn = rng.uniform(0.5, 1.5, n)
            want[r, w] = signals.lf_hf(nn * 1000, at)
            rows += [(r, w, float(a), float(v)) for a, v in zip(at, nn, strict=True)]
            rows += [(r, w, None, 1.0), (r, w, float(at[1]), None)]
    rows += [(9, 0, float(t // 2), 1.0 + t / 100) for t in range(32)] + [(9, 1, None, None)]
    rows += [(9, 2, float(4 * (t // 2)), 1.0 + t / 100) for t in range(32)]
    want[9, 0] = want[9, 1] = (np.nan,) * 3 + (False,)
    want[9, 2] = (np.nan,) * 3 + (True,)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "rec long, w long, t double, nn double")
    got = {(r.rec, r.w): r for r in signals.spectral_windows(df).collect()}
    assert got.keys() == want.keys() and got[4, 0].HF_power > 0 and got[5, 0].lf_reliable
    for k, told in want.items():
        numbers = [np.nan if v is None else v for v in (got[k].LF_power, got[k].HF_power, got[k].LF_HF_ratio)]
        assert np.allclose(numbers, told[:3], rtol=1e-9, equal_nan=True) and got[k].lf_reliable == told[3]
        assert not any(v is not None and np.isnan(v) for v in (got[k].LF_power, got[k].HF_power, got[k].LF_HF_ratio))


def test_logistic_scores_read_their_rows_once(spark):
    """The rows are made once, whatever the number of steps; weights equal a fit on the other persons, also far from zero, and AUC and precision their definitions."""
    rng = np.random.default_rng(12)
    n = 600
    who, a, b = rng.integers(0, 5, n), rng.normal(size=n), 1e6 + 3 * rng.normal(size=n)
    y = (a + (b - 1e6) / 3 + rng.normal(size=n) > 0.3).astype(int)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(int(p), i, float(u), float(v), int(t)) for i, (p, u, v, t) in enumerate(zip(who, a, b, y, strict=True))]
    df = spark.createDataFrame(rows, "person long, i long, a double, b double, y long").repartition(3)
    told = models.loso_logistic(df.mapInArrow(counted, df.schema), ["a", "b"], "y", "person", ["i"], fpr=None)
    got = scoring.auc_summary(told, "person").first()
    p = {r.i: (r.p, r.thr) for r in told.collect()}
    assert seen.value == n and all(t is None for _, t in p.values())
    p = np.array([p[i][0] for i in range(n)])
    x = np.column_stack([a, b - 1e6])
    for k in range(5):
        mean, dev = models.scaler(x[who != k])
        z = (x - mean) / dev
        w = models.fit_logistic(z[who != k], y[who != k].astype(float))
        assert np.abs(1 / (1 + np.exp(-(z[who == k] @ w[:-1] + w[-1]))) - p[who == k]).max() < 1e-4
    auc = lambda s, t: np.mean((s[t == 1][:, None] > s[t == 0]) + 0.5 * (s[t == 1][:, None] == s[t == 0]))
    hits = y[np.argsort(-p)]
    precision = (np.cumsum(hits) / np.arange(1, n + 1))[hits == 1].mean()
    each = [auc(p[who == k], y[who == k]) for k in range(5)]
    assert np.allclose([got.auc_pooled, got.ap_pooled, got.auc_mean, got.auc_sd], [auc(p, y), precision, np.mean(each), np.std(each, ddof=1)], atol=1e-12) and got.n_above_half == 5


def test_label_beats_uses_all_readings(spark, tmp_path):
    """Readings reach as far as the recording, so each kept beat has one, between the two events' values around it."""
    values = [50.0 + 10 * (i % 3) for i in range(80)]
    df = spark.createDataFrame([(i, 7, "view", v) for i, v in enumerate(values)], "event_id long, user_id long, event_type string, value double")
    df.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_600_000_000).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    told = signal_queries.label_beats(spark, str(tmp_path)).collect()
    times = 5.0 * np.arange(len(values))
    assert max(r.t_center_sec for r in told) > 35 and all(r.usable == r.keep for r in told)
    for r in told:
        assert abs(r.SBP - np.interp(r.t_center_sec, times, np.array(values) + 70)) < 1e-9 and abs(r.DBP - np.interp(r.t_center_sec, times, np.array(values) / 2 + 55)) < 1e-9
