"""Queries of the feature-engineering operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseforge.functions import ranges
from pulseforge.functions.pairs import correlations
from pulseforge.functions.stats import settle
from pulseforge.operators import features as fx
from pulseforge.plans.registry import NN, SIG, query, r
from pulseforge.sources import tables

ORDER = ["idx"]
W = "(PARTITION BY rec ORDER BY idx)"


def _told(df, *cols, keys=("rec", "idx")):
    return df.select(*keys, *[settle(F.col(c)).alias(c) for c in cols])


def _norm_sql(centre: str, scale: str) -> str:
    off = f"(x - ({centre}))"
    return f"coalesce({off} / nullif({scale}, 0), {off} / nullif(sd, 0), CASE WHEN x IS NOT NULL THEN 0e0 END)"


EXPANDING = f"""WITH {SIG}, a AS (
  SELECT *, row_number() OVER {W} AS n, stddev_samp(x) OVER (PARTITION BY rec) AS sd,
    quantile_cont(x, 0.5) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0,
    CASE WHEN count(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 4 THEN
      quantile_cont(x, 0.75) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      - quantile_cont(x, 0.25) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS s0
  FROM sig), b AS (
  SELECT *, coalesce(c0, quantile_cont(CASE WHEN n <= 10 THEN x END, 0.5) OVER (PARTITION BY rec)) AS c,
    first_value(s0 IGNORE NULLS) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s
  FROM a)
SELECT rec, idx, {r(_norm_sql('c', 's'))} AS x FROM b"""


@query("norm_expanding", EXPANDING)
def norm_expanding(spark, d):
    return _told(fx.normalise(tables.signal(spark, d), ["x"], "rec", ORDER, "expanding"), "x")


@query("norm_robust", f"""WITH {SIG}, a AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY rec) AS c, stddev_samp(x) OVER (PARTITION BY rec) AS sd,
  quantile_cont(x, 0.75) OVER (PARTITION BY rec) - quantile_cont(x, 0.25) OVER (PARTITION BY rec) AS s FROM sig)
SELECT rec, idx, {r(_norm_sql('c', 's'))} AS x FROM a""")
def norm_robust(spark, d):
    return _told(fx.normalise(tables.signal(spark, d), ["x"], "rec", ORDER, "robust"), "x")


@query("norm_baseline", f"""WITH {SIG}, a AS (SELECT *, coalesce(quantile_cont(CASE WHEN t < 259200 THEN x END, 0.5) OVER (PARTITION BY rec), quantile_cont(x, 0.5) OVER (PARTITION BY rec)) AS c,
  stddev_samp(x) OVER (PARTITION BY rec) AS sd, quantile_cont(x, 0.75) OVER (PARTITION BY rec) - quantile_cont(x, 0.25) OVER (PARTITION BY rec) AS s FROM sig)
SELECT rec, idx, {r(_norm_sql('c', 's'))} AS x FROM a""")
def norm_baseline(spark, d):
    return _told(fx.normalise(tables.signal(spark, d), ["x"], "rec", ORDER, "baseline", baseline_end=259200.0), "x")


@query("norm_zscore", f"""WITH {SIG} SELECT rec, idx, {r("coalesce((x - avg(x) OVER (PARTITION BY rec)) / nullif(stddev_samp(x) OVER (PARTITION BY rec), 0), 0e0)")} AS x FROM sig""")
def norm_zscore(spark, d):
    return _told(fx.normalise(tables.signal(spark, d), ["x"], "rec", ORDER, "zscore"), "x")


@query("norm_none_keep_raw", f"WITH {SIG} SELECT rec, idx, {r('x')} AS x, {r('x')} AS x_n FROM sig")
def norm_none(spark, d):
    return _told(fx.normalise(tables.signal(spark, d), ["x"], "rec", ORDER, "none", keep_raw=True), "x", "x_n")


@query("winsorize", f"""WITH {SIG}, q AS (SELECT *, quantile_cont(x, 0.05) OVER (PARTITION BY rec) AS lo, quantile_cont(x, 0.95) OVER (PARTITION BY rec) AS hi FROM sig)
SELECT rec, idx, {r('least(greatest(x, lo), hi)')} AS x FROM q""")
def winsorize(spark, d):
    return _told(fx.winsorise(tables.signal(spark, d), ["x"], "rec", 0.05, 0.95), "x")


@query("impute_median", f"""WITH {SIG}, a AS (SELECT rec, idx, CASE WHEN ch <> 'purchase' AND rec % 7 <> 0 THEN x END AS x FROM sig), g AS (SELECT quantile_cont(x, 0.5) AS m FROM a)
SELECT rec, idx, {r('coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY rec), m)')} AS x FROM a, g""")
def impute_median(spark, d):
    """Readings of one channel and of every seventh recording count as missing, some of them as NaN."""
    sig = tables.signal(spark, d)
    gone = F.when(F.col("ch") == "purchase", F.lit(float("nan"))).when(F.col("rec") % 7 != 0, F.col("x"))
    return _told(fx.impute_median(sig.withColumn("x", gone), ["x"], "rec"), "x")


@query("log_shift", f"""WITH {SIG}, m AS (SELECT min(x) AS lo FROM sig) SELECT rec, idx, {r('ln(1 + x + CASE WHEN lo <= -1 THEN -lo + 1e-6 ELSE 0e0 END)', 4)} AS x FROM sig, m""")
def log_shift(spark, d):
    return fx.log_shift(tables.signal(spark, d), ["x"]).select("rec", "idx", settle(F.col("x"), 4).alias("x"))


@query("temporal_features", f"""WITH {SIG}, a AS (SELECT *, CAST(idx AS DOUBLE) AS i FROM sig)
SELECT rec, idx, {r('coalesce(x - lag(x) OVER ' + W + ', 0e0)')} AS x_d1,
  {r('avg(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS x_rm3,
  {r('coalesce(stddev_samp(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0e0)')} AS x_rs3,
  {r('coalesce(regr_sxy(x, i) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 5e0, 0e0)')} AS x_slope FROM a""")
def temporal_features(spark, d):
    return _told(fx.temporal(tables.signal(spark, d), ["x"], "rec", ORDER, 3), "x_d1", "x_rm3", "x_rs3", "x_slope")


@query("temporal_centred", f"""WITH {SIG} SELECT rec, idx, {r('avg(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS x_rm2 FROM sig""")
def temporal_centred(spark, d):
    return _told(fx.temporal(tables.signal(spark, d), ["x"], "rec", ORDER, 2, causal=False), "x_rm2")


@query("protocol_phase", f"""WITH {SIG}, c AS (SELECT *, (t / 3600) % 10 AS pos FROM sig), p AS (SELECT *, CASE WHEN pos < 4.5e0 THEN 'Before' WHEN pos < 5.5e0 THEN 'During' ELSE 'After' END AS phase FROM c)
SELECT phase, count(*) AS n, {r('avg(x)')} AS mean_x, CAST(sum(CASE WHEN pos >= 4.5e0 AND pos < 5.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cpt FROM p GROUP BY phase""")
def protocol_phase(spark, d):
    sig = tables.signal(spark, d).withColumn("h", F.col("t") / 3600)
    return fx.protocol_phase(sig, "h", 10.0, 4.5, 5.5).groupBy("phase").agg(F.count("*").alias("n"), settle(F.avg("x")).alias("mean_x"), F.sum("is_cpt").cast("long").alias("n_cpt"))


@query("phase_five_numbers", f"""WITH {SIG}, c AS (SELECT *, (t / 3600) % 10 AS pos FROM sig), p AS (SELECT *, CASE WHEN pos < 4.5e0 THEN 'Before' WHEN pos < 5.5e0 THEN 'During' ELSE 'After' END AS phase FROM c)
SELECT phase, {r('min(x)')} AS lo, {r('quantile_cont(x, 0.25)')} AS q1, {r('quantile_cont(x, 0.5)')} AS med, {r('quantile_cont(x, 0.75)')} AS q3, {r('max(x)')} AS hi FROM p GROUP BY phase""")
def phase_five_numbers(spark, d):
    sig = tables.signal(spark, d).withColumn("h", F.col("t") / 3600)
    rows = ranges.quantiles(fx.protocol_phase(sig, "h", 10.0, 4.5, 5.5), ["phase"], "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    return rows.select("phase", *[settle(F.col("q")[i]).alias(n) for i, n in enumerate(("lo", "q1", "med", "q3", "hi"))])


def families(spark, d):
    """Two feature families over count windows of sixteen samples: amplitude and timing."""
    sig = tables.signal(spark, d).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    amp = sig.groupBy("rec", "w").agg(F.avg(F.abs("x")).alias("aSKNA"), F.var_pop("x").alias("varSKNA"), F.count("*").alias("n"))
    nn = tables.intervals(sig.select("rec", "person", "idx", "t", "x")).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    time = nn.groupBy("rec", "w").agg(F.avg("nn").alias("meanNN"), F.count("*").alias("n"))
    return amp, time


FAMILIES = f"""{SIG}, {NN},
amp AS (SELECT rec, idx // 16 AS w, avg(abs(x)) AS aSKNA, var_pop(x) AS varSKNA, count(*) AS n FROM sig GROUP BY 1, 2),
tim AS (SELECT rec, idx // 16 AS w, avg(nn) AS meanNN FROM nn GROUP BY 1, 2)"""


@query("merge_inner_key", f"""WITH {FAMILIES} SELECT a.rec, a.w, {r('aSKNA')} AS aSKNA, {r('varSKNA')} AS varSKNA, {r('meanNN')} AS meanNN, a.n FROM amp a JOIN tim b ON a.rec = b.rec AND a.w = b.w""")
def merge_inner_key(spark, d):
    amp, time = families(spark, d)
    out = fx.merge_families(amp, time, ["rec", "w"])
    return out.select("rec", "w", *[settle(F.col(c)).alias(c) for c in ("aSKNA", "varSKNA", "meanNN")], "n")


@query("interactions", f"""WITH {FAMILIES}, m AS (SELECT a.*, meanNN, 60000e0 / greatest(meanNN, 1e-9) AS hr FROM amp a JOIN tim b ON a.rec = b.rec AND a.w = b.w)
SELECT rec, w, {r('hr')} AS HR, {r('aSKNA / greatest(n, 1)')} AS aSKNA_per_beat, {r('aSKNA * hr / 60e0')} AS aSKNA_x_HR, {r('aSKNA / (varSKNA + 1e-9)')} AS a_var_ratio FROM m""")
def interactions(spark, d):
    """Cross-signal interactions of the merged families."""
    amp, time = families(spark, d)
    out = fx.merge_families(amp, time, ["rec", "w"]).withColumn("hr", F.lit(60000.0) / F.greatest("meanNN", F.lit(1e-9)))
    cols = {"HR": F.col("hr"), "aSKNA_per_beat": F.col("aSKNA") / F.greatest("n", F.lit(1)), "aSKNA_x_HR": F.col("aSKNA") * F.col("hr") / 60.0, "a_var_ratio": F.col("aSKNA") / (F.col("varSKNA") + 1e-9)}
    return out.select("rec", "w", *[settle(x).alias(c) for c, x in cols.items()])


@query("family_pivot", f"""WITH {SIG} SELECT rec, {', '.join(f"{r(f'avg(CASE WHEN ch = {chr(39)}{c}{chr(39)} THEN x END)')} AS mean_{c}" for c in ('view', 'click', 'purchase'))} FROM sig GROUP BY rec""")
def family_pivot(spark, d):
    out = tables.signal(spark, d).groupBy("rec").pivot("ch", ["view", "click", "purchase"]).agg(F.avg("x"))
    return out.select("rec", *[settle(F.col(c)).alias(f"mean_{c}") for c in ("view", "click", "purchase")])


@query("dedup_anti", f"""WITH {SIG} SELECT rec, count(*) AS n FROM sig WHERE NOT (rec = 7 AND EXISTS (SELECT 1 FROM sig WHERE rec = 3)) GROUP BY rec""")
def dedup_anti(spark, d):
    return fx.drop_losers(tables.signal(spark, d), "rec", 3, 7).groupBy("rec").agg(F.count("*").alias("n"))


#: Components of an embedding.
DIM = 64
COMPONENTS = [f"f{i}" for i in range(DIM)]


def _wide(spark, d):
    """Embedding components as named columns, with the class as target."""
    rows = tables.read(spark, d, "embeddings")
    return rows.select("vec_id", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 12).alias("person"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)])


LONG = f"""lng AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, vec_id % 12 AS person, 'f' || i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range({DIM}) t(i))"""


@query("corr_pooled_within", f"""WITH {LONG}, p AS (SELECT feature, covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0) AS r_pooled, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, avg(CASE WHEN value IS NOT NULL THEN 1e0 ELSE 0e0 END) AS fin FROM lng GROUP BY feature),
o AS (SELECT feature, person, covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0) AS r FROM lng GROUP BY 1, 2 HAVING count(value) > 4), w AS (SELECT feature, quantile_cont(r, 0.5) AS r_within FROM o GROUP BY 1)
SELECT p.feature, {r('fin')} AS finite_share, {r('med')} AS median, {r('p5')} AS p5, {r('p95')} AS p95, {r('r_pooled')} AS r_pooled, {r('r_within')} AS r_within FROM p LEFT JOIN w ON p.feature = w.feature""")
def corr_pooled_within(spark, d):
    out = fx.feature_stats(_wide(spark, d), COMPONENTS, "y", "person")
    return out.select("feature", *[settle(F.col(c)).alias(c) for c in out.columns[1:]])


@query("corr_matrix", f"""WITH {LONG}, s AS (SELECT vec_id, feature, value FROM lng) SELECT a.feature AS f1, b.feature AS f2, {r('abs(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0))')} AS r FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY 1, 2""")
def corr_matrix(spark, d):
    """All pairs of columns from one pass over the rows."""
    _, r = correlations(_wide(spark, d), COMPONENTS)
    pairs = [(a, b, None if r[i, j] != r[i, j] else float(abs(r[i, j]))) for i, a in enumerate(COMPONENTS) for j, b in enumerate(COMPONENTS) if a < b]
    return spark.createDataFrame(pairs, "f1 string, f2 string, r double").select("f1", "f2", settle(F.col("r")).alias("r"))


@query("topk_features", f"""WITH {LONG}, p AS (SELECT feature, abs(covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0)) AS r FROM lng GROUP BY feature)
SELECT feature, {r('r')} AS r, CAST(row_number() OVER (ORDER BY {r('r')} DESC NULLS LAST, feature) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""")
def topk_features(spark, d):
    stats = fx.feature_stats(_wide(spark, d), COMPONENTS, "y", "person")
    told = stats.withColumn("r_pooled", settle(F.abs("r_pooled")))
    return fx.top_features(told, "r_pooled", 5).select("feature", F.col("r_pooled").alias("r"), "rank")


_F4 = "(PARTITION BY rec ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query("prune_collinear", f"""WITH RECURSIVE {SIG}, f AS (SELECT event_id AS row_id, x, x * 0.5e0 + 3 AS x_twin, 1e0 AS x_const, coalesce(stddev_samp(x) OVER {_F4}, 0e0) AS x_rs3, coalesce(regr_sxy(x, CAST(idx AS DOUBLE)) OVER {_F4} / 5e0, 0e0) AS x_slope, x * x AS x_sq FROM sig),
u AS (UNPIVOT f ON x, x_twin, x_const, x_rs3, x_slope, x_sq INTO NAME feature VALUE v), c AS (SELECT feature, row_number() OVER (ORDER BY var_pop(v) DESC, feature) AS rk FROM u GROUP BY feature HAVING var_pop(v) > 1e-8),
p AS (SELECT a.feature, list(b.feature) AS twins FROM (SELECT a.feature, b.feature AS other FROM u a JOIN u b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY 1, 2 HAVING abs(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0)) > 0.95e0) a JOIN c b ON b.feature = a.other GROUP BY 1),
o AS (SELECT c.feature, rk, coalesce(twins, []) AS twins FROM c LEFT JOIN p ON p.feature = c.feature),
g AS (SELECT 1 AS k, [feature] AS kept FROM o WHERE rk = 1 UNION ALL SELECT k + 1, CASE WHEN len(list_intersect(kept, twins)) > 0 THEN kept ELSE list_append(kept, feature) END FROM g JOIN o ON rk = k + 1)
SELECT unnest(kept) AS feature FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""")
def prune_collinear(spark, d):
    """Columns of a wide frame that pruning keeps (a shifted copy and a constant go)."""
    rows = fx.temporal(tables.signal(spark, d), ["x"], "rec", ORDER, 3).withColumns({"x_twin": F.col("x") * 0.5 + 3, "x_const": F.lit(1.0), "x_sq": F.col("x") * F.col("x")})
    kept = fx.prune(rows, ["x", "x_twin", "x_const", "x_rs3", "x_slope", "x_sq"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("cohort_distributions", f"""WITH {SIG}, u AS (SELECT 'person' AS level, person AS grp, x FROM sig UNION ALL SELECT 'pooled', 0, x FROM sig)
SELECT level, grp, count(*) AS n, {r('quantile_cont(x, 0.25)')} AS q1, {r('quantile_cont(x, 0.5)')} AS med, {r('quantile_cont(x, 0.75)')} AS q3 FROM u GROUP BY 1, 2""")
def cohort_distributions(spark, d):
    sig = tables.signal(spark, d)
    both = F.explode(F.array(F.struct(F.lit("person").alias("level"), F.col("person").alias("grp")), F.struct(F.lit("pooled").alias("level"), F.lit(0).cast("long").alias("grp"))))
    rows = ranges.quantiles(sig.select("x", both.alias("k")).select("x", "k.*"), ["level", "grp"], "x", [0.25, 0.5, 0.75])
    return rows.select("level", "grp", "n", *[settle(F.col("q")[i]).alias(c) for i, c in enumerate(("q1", "med", "q3"))])


@query("envelope_minmax", f"""WITH {SIG}, s AS (SELECT *, count(*) OVER (PARTITION BY rec) // 8 AS k FROM sig), b AS (SELECT *, idx // k AS bin FROM s WHERE k > 0), e AS (
  SELECT rec, bin, first(idx ORDER BY x, idx) AS i0, first(x ORDER BY x, idx) AS x0, first(idx ORDER BY x DESC, idx) AS i1, first(x ORDER BY x DESC, idx) AS x1 FROM b WHERE bin < 8 GROUP BY 1, 2)
SELECT rec, CAST(bin AS BIGINT) AS bin, i0 AS idx, {r('x0')} AS x FROM e UNION ALL SELECT rec, CAST(bin AS BIGINT), i1, {r('x1')} FROM e""")
def envelope_minmax(spark, d):
    return _told(fx.envelope(tables.signal(spark, d), "rec", "idx", "x", 8), "x", keys=("rec", "bin", "idx"))


@query("stride_decimate", f"""WITH {SIG}, s AS (SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY rec) / 10e0) AS BIGINT)) AS k FROM sig) SELECT rec, idx, {r('x')} AS x FROM s WHERE idx % k = 0""")
def stride_decimate(spark, d):
    return _told(fx.decimate(tables.signal(spark, d), "rec", "idx", 10), "x")


@query("cpt_runs", f"""WITH {SIG}, c AS (SELECT rec, idx, CASE WHEN (t / 3600) % 10 >= 3 AND (t / 3600) % 10 < 7 THEN 1 ELSE 0 END AS f FROM sig), g AS (SELECT *, coalesce(CASE WHEN f <> lag(f) OVER {W} THEN 1 ELSE 0 END, 0) AS ch FROM c),
h AS (SELECT *, sum(ch) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT rec, CAST(run AS BIGINT) AS run, CAST(min(f) AS INTEGER) AS is_cpt, min(idx) AS first, max(idx) AS last, count(*) AS n FROM h GROUP BY rec, run""")
def cpt_runs(spark, d):
    sig = tables.signal(spark, d).withColumn("h", F.col("t") / 3600)
    return fx.runs(fx.protocol_phase(sig, "h", 10.0, 3.0, 7.0), "is_cpt", "rec", "idx").withColumn("run", F.col("run").cast("long"))


@query("drop_recordings", f"WITH {SIG} SELECT rec, count(*) AS n FROM sig WHERE NOT contains(CAST(rec AS VARCHAR), '12') GROUP BY rec")
def drop_recordings(spark, d):
    return fx.drop_recordings(tables.signal(spark, d), "rec", ["12"]).groupBy("rec").agg(F.count("*").alias("n"))
