"""Queries of window features, segments and as-of labels over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseforge.functions.stats import settle
from pulseforge.operators import labels, windows
from pulseforge.plans.registry import NN, SIG, query, r
from pulseforge.sources import tables

#: Whole windows of sixteen samples.
WIN = f"""{SIG}, win AS (SELECT *, idx // 16 AS w FROM (SELECT *, count(*) OVER (PARTITION BY rec) AS total FROM sig) WHERE (idx // 16) * 16 + 16 <= total)"""
O = "(PARTITION BY rec, w ORDER BY idx)"  # noqa: E741
P = "(PARTITION BY rec, w)"


def _win(spark, d, size=16, stride=None):
    return windows.count_windows(tables.signal(spark, d), size, stride)


def _told(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[settle(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("skna_amplitude", f"""WITH {WIN}, a AS (SELECT *, x - lag(x) OVER {O} AS d1, lead(x) OVER {O} - x AS up, CASE WHEN (x < 0) <> (lag(x) OVER {O} < 0) THEN 1 ELSE 0 END AS flip FROM win)
SELECT rec, w, {r('avg(abs(x))')} AS aSKNA, {r('var_pop(x)')} AS varSKNA, {r('sqrt(avg(x * x))')} AS rmsSKNA, {r('sum(abs(d1)) / 16e0')} AS wlSKNA, {r('sum(flip) / 16e0')} AS zcSKNA,
  {r('sum(CASE WHEN d1 * up < 0 THEN 1 ELSE 0 END) / 16e0')} AS sscSKNA, {r('coalesce(sum(CASE WHEN abs(d1) > 1 THEN abs(d1) END), 0e0) / 16e0')} AS wampSKNA, {r('max(abs(x)) / nullif(sqrt(avg(x * x)), 0)')} AS cfSKNA FROM a GROUP BY rec, w""")
def skna_amplitude(spark, d):
    return _told(windows.amplitude(_win(spark, d), 16.0))


@query("skna_moments", f"""WITH {WIN}, m AS (SELECT rec, w, abs(x) AS a, avg(abs(x)) OVER {P} AS mu FROM win)
SELECT rec, w, {r('avg((a - mu) ** 3) / nullif(avg((a - mu) ** 2) ** 1.5e0, 0)')} AS skewSKNA, {r('avg((a - mu) ** 4) / nullif(avg((a - mu) ** 2) ** 2, 0) - 3e0')} AS kurtSKNA FROM m GROUP BY rec, w""")
def skna_moments(spark, d):
    return _told(windows.moments(_win(spark, d)))


@query("hjorth", f"""WITH {WIN}, a AS (SELECT *, x - lag(x) OVER {O} AS d1 FROM win), b AS (SELECT *, d1 - lag(d1) OVER {O} AS d2 FROM a), v AS (SELECT rec, w, var_pop(x) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY rec, w)
SELECT rec, w, {r('sqrt(v1 / nullif(v0, 0))')} AS mobility, {r('sqrt(v2 / nullif(v1, 0)) / nullif(sqrt(v1 / nullif(v0, 0)), 0)')} AS complexity FROM v""")
def hjorth(spark, d):
    return _told(windows.hjorth(_win(spark, d)))


@query("entropy", f"""WITH {WIN}, e AS (SELECT rec, w, x, min(x) OVER {P} AS lo, max(x) OVER {P} AS hi FROM win), b AS (SELECT rec, w, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 64), 63) END AS bin FROM e),
c AS (SELECT rec, w, bin, count(*) AS n FROM b GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER {P} AS p FROM c)
SELECT rec, w, {r('sum(CASE WHEN bin IS NOT NULL THEN -p * log2(p) END)')} AS entropy FROM p GROUP BY rec, w""")
def entropy(spark, d):
    return _told(windows.entropy(_win(spark, d)))


@query("autocorr", f"""WITH {WIN}, a AS (SELECT rec, w, idx, x - avg(x) OVER {P} AS c FROM win), b AS (SELECT *, lead(c) OVER {O} AS nx FROM a) SELECT rec, w, {r('sum(c * nx) / nullif(sum(c * c), 0)')} AS autocorrelation FROM b GROUP BY rec, w""")
def autocorr(spark, d):
    return _told(windows.autocorrelation(_win(spark, d)))


@query("sliding_windows", f"""WITH {SIG}, g AS (SELECT rec, unnest(generate_series(0, (count(*) - 20) // 5)) AS w FROM sig GROUP BY rec HAVING count(*) >= 20)
SELECT g.rec, g.w, count(*) AS n, {r('avg(s.x)')} AS mean_x FROM g JOIN sig s ON s.rec = g.rec AND s.idx >= g.w * 5 AND s.idx < g.w * 5 + 20 GROUP BY 1, 2""")
def sliding_windows(spark, d):
    """Overlapping windows: twenty samples every five."""
    return _told(_win(spark, d, 20, 5).groupBy("rec", "w").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")))


@query("hrv_time_poincare", f"""WITH {SIG}, {NN}, a AS (SELECT rec, idx, idx // 16 AS w, nn FROM nn), b AS (SELECT *, nn - lag(nn) OVER {O} AS dd FROM a),
c AS (SELECT rec, w, count(*) AS n_nn, avg(nn) AS m, stddev_samp(nn) AS s, sqrt(avg(dd * dd)) AS rm, stddev_samp(dd) AS sd, var_samp(nn) AS v FROM b GROUP BY rec, w)
SELECT rec, w, n_nn, CASE WHEN n_nn >= 2 THEN {r('m', 4)} END AS "meanNN", CASE WHEN n_nn >= 2 THEN {r('s', 4)} END AS "SDNN", CASE WHEN n_nn >= 2 THEN {r('rm', 4)} END AS "RMSSD",
  CASE WHEN n_nn >= 3 AND 2 * v - sd * sd / 2 > 0 THEN {r('sd * sqrt(0.5e0) / sqrt(2 * v - sd * sd / 2)', 4)} END AS "SD1_SD2" FROM c""")
def hrv_time_poincare(spark, d):
    nn = tables.intervals(tables.signal(spark, d)).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    return _told(windows.interval_time(nn), 4)


@query("r_slope", f"""WITH {WIN} SELECT rec, w, {r('CASE WHEN count(x) >= 3 THEN regr_slope(x, t / 3600) END')} AS "R_slope" FROM win GROUP BY rec, w""")
def r_slope(spark, d):
    return _told(windows.slope(_win(spark, d).withColumn("h", F.col("t") / 3600), "h"))


@query("qtc", f"""WITH {SIG}, {NN}, q AS (SELECT rec, idx // 16 AS w, abs(x) / nullif(cbrt(nn / 3600), 0) AS qtc FROM nn) SELECT rec, w, {r('quantile_cont(qtc, 0.5)', 4)} AS qtc FROM q GROUP BY rec, w""")
def qtc(spark, d):
    """Interval-corrected magnitude: median of |x| over the cube root of the interval in hours."""
    nn = tables.intervals(tables.signal(spark, d)).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    v = F.abs("x") / F.when(F.col("nn") != 0, F.cbrt(F.col("nn") / 3600))
    return _told(nn.withColumn("q", v).groupBy("rec", "w").agg(F.percentile("q", 0.5).alias("qtc")), 4)


@query("higuchi", f"""WITH {WIN}, i AS (SELECT rec, w, x, row_number() OVER {O} - 1 AS i, count(*) OVER {P} AS n FROM win), s AS (
  SELECT a.rec, a.w, k, a.i % k AS m, sum(abs(a.x - b.x)) * (any_value(a.n) - 1) / (count(*) * k * k) AS L FROM i a, range(1, 6) t(k), i b WHERE a.rec = b.rec AND a.w = b.w AND b.i = a.i - k AND a.n >= 2 * k GROUP BY a.rec, a.w, k, a.i % k),
e AS (SELECT rec, w, k, avg(L) AS L FROM s GROUP BY 1, 2, 3 HAVING avg(L) > 0) SELECT rec, w, {r('regr_slope(ln(L), -ln(k))')} AS fractal_dimension FROM e GROUP BY rec, w""")
def higuchi(spark, d):
    return _told(windows.higuchi(_win(spark, d), 5))


@query("dominant_freq", f"""WITH {WIN}, c AS (SELECT rec, w, row_number() OVER {O} - 1 AS i, x - avg(x) OVER {P} AS c FROM win), p AS (
  SELECT rec, w, k, sum(c * cos(k * i * (2 * 3.141592653589793e0 / 16))) ** 2 + sum(c * sin(k * i * (2 * 3.141592653589793e0 / 16))) ** 2 AS p FROM c, range(1, 9) t(k) GROUP BY rec, w, k)
SELECT rec, w, CAST(first(k ORDER BY round(p, 6) DESC, k) AS BIGINT) AS df_bin FROM p GROUP BY rec, w""")
def dominant_freq(spark, d):
    return windows.dominant_bin(_win(spark, d), 16)


@query("segments", f"""WITH {SIG}, s AS (SELECT rec, idx, t AS p0, lead(t, 1) OVER (PARTITION BY rec ORDER BY idx) AS p1, lead(t, 2) OVER (PARTITION BY rec ORDER BY idx) AS p2 FROM sig)
SELECT rec, idx, {r('p2 - p0', 3)} AS dur, p2 - p0 >= 3600 AND p2 - p0 <= 90000 AS keep FROM s WHERE p2 IS NOT NULL""")
def segments(spark, d):
    out = windows.segments(tables.signal(spark, d), "t", 3600.0, 90000.0)
    return out.select("rec", "idx", settle(F.col("dur"), 3).alias("dur"), "keep")


@query("sequences", f"""WITH {SIG}, k AS (SELECT rec, idx, x > -40 AS keep FROM sig), q AS (SELECT rec, idx, row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS pos,
  list(idx) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS seq, min(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS ok FROM k)
SELECT rec, idx, array_to_string(seq, ',') AS seq FROM q WHERE len(seq) = 12 AND pos % 2 = 0 AND ok = 1""")
def sequences(spark, d):
    """Every second run of twelve beats without a rejected one."""
    out = windows.sequences(tables.signal(spark, d).withColumn("keep", F.col("x") > -40), 12, 2)
    return out.withColumn("seq", F.array_join(F.col("seq").cast("array<string>"), ","))


@query("beat_stats", f"""WITH {SIG}, {NN}, a AS (SELECT *, nn + lead(nn) OVER (PARTITION BY rec ORDER BY idx) AS seg, nn BETWEEN 600 AND 86400 AS ok FROM nn), b AS (
  SELECT rec, count(*) AS n, count(CASE WHEN ok THEN nn END) AS n_ok, avg(CASE WHEN ok THEN nn END) AS mean, stddev_pop(CASE WHEN ok THEN nn END) AS sd, min(CASE WHEN ok THEN nn END) AS lo, max(CASE WHEN ok THEN nn END) AS hi,
  quantile_cont(nn, 0.5) AS median, quantile_cont(seg, 0.99) AS p99 FROM a GROUP BY rec)
SELECT rec, n, n_ok, {', '.join(f'{r(c, 3)} AS {c}' for c in ('mean', 'sd', 'lo', 'hi', 'median', 'p99'))}, CAST(ceil(ceil(p99) / 256e0) * 256 AS BIGINT) AS length FROM b""")
def beat_stats(spark, d):
    return _told(windows.beat_stats(tables.intervals(tables.signal(spark, d)), 600.0, 86400.0), 3)


LAB = f"""{SIG}, lab AS (SELECT rec, t, x AS y FROM sig WHERE ch = 'purchase'), probe AS (SELECT rec, idx, t FROM sig WHERE ch = 'click'), u AS (
  SELECT rec, t, idx, NULL AS y, 1 AS pr FROM probe UNION ALL SELECT rec, t, NULL, y, 0 FROM lab), n AS (
  SELECT *, last_value(CASE WHEN pr = 0 THEN struct_pack(t := t, y := y) END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
    first_value(CASE WHEN pr = 0 THEN struct_pack(t := t, y := y) END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM u), v AS (
  SELECT rec, idx, t, l, r, coalesce(least(t - l.t, r.t - t) <= 43200, false) AS valid FROM n WHERE pr = 1)"""


def _as_of(spark, d, mode):
    sig = tables.signal(spark, d)
    readings = sig.where("ch = 'purchase'").select("rec", "t", F.col("x").alias("y"))
    out = labels.as_of(sig.where("ch = 'click'").select("rec", "idx", "t"), readings, mode=mode, reach=43200.0)
    return out.select("rec", "idx", "valid", settle(F.col("y")).alias("y"))


@query("label_interp", f"""WITH {LAB} SELECT rec, idx, valid, CASE WHEN valid THEN {r('CASE WHEN l IS NULL THEN r.y WHEN r IS NULL OR r.t = l.t THEN l.y ELSE l.y + (r.y - l.y) * (t - l.t) / (r.t - l.t) END')} END AS y FROM v""")
def label_interp(spark, d):
    return _as_of(spark, d, "interp")


@query("label_nearest", f"""WITH {LAB} SELECT rec, idx, valid, CASE WHEN valid THEN {r('CASE WHEN l IS NULL THEN r.y WHEN r IS NULL OR t - l.t <= r.t - t THEN l.y ELSE r.y END')} END AS y FROM v""")
def label_nearest(spark, d):
    return _as_of(spark, d, "nearest")


@query("usable_windows", f"""WITH {WIN}, a AS (SELECT rec, w, avg(abs(x)) AS a, max(abs(x)) / nullif(sqrt(avg(x * x)), 0) AS c, count(*) AS n, min(x) > -49 AS valid FROM win GROUP BY rec, w) SELECT rec, w, valid AND a IS NOT NULL AND c IS NOT NULL AND n >= 3 AS usable FROM a""")
def usable_windows(spark, d):
    f = windows.amplitude(_win(spark, d), 16.0).select("rec", "w", "aSKNA", "cfSKNA")
    n = _win(spark, d).groupBy("rec", "w").agg(F.count("*").alias("n_beats"), (F.min("x") > -49).alias("valid"))
    return labels.usable(f.join(n, ["rec", "w"]), ["aSKNA", "cfSKNA"], least={"n_beats": 3}).select("rec", "w", "usable")
