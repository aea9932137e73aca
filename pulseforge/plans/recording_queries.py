"""Queries of whole-recording and composed operators that SQL can express, over events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseforge.functions.stats import settle
from pulseforge.operators import engineer as en
from pulseforge.operators import models, recordings, split
from pulseforge.plans.registry import NN, SIG, query, r
from pulseforge.sources import tables

ROW = "(PARTITION BY rec ORDER BY idx)"
#: Smoothing over three samples, a lead-in of at most twenty, a steady level over the twenty after it, two clean samples.
LEAD = f"""{SIG}, a AS (SELECT rec, idx, abs(x - quantile_cont(x, 0.5) OVER (PARTITION BY rec)) AS dev, count(*) OVER (PARTITION BY rec) AS n FROM sig),
b AS (SELECT *, sum(dev) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS level, least(20, greatest(0, n - 2)) AS lo FROM a),
c AS (SELECT *, quantile_cont(CASE WHEN idx >= lo AND idx < lo + 20 THEN level END, 0.5) OVER (PARTITION BY rec) AS steady FROM b),
e AS (SELECT *, CASE WHEN level > 1.2e0 * steady THEN 1 ELSE 0 END AS bad FROM c WHERE idx < 20),
f AS (SELECT *, sum(bad) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ahead FROM e),
l AS (SELECT rec, CASE WHEN max(CASE WHEN idx = 0 THEN bad END) = 0 OR max(steady) <= 0 THEN 0 ELSE least(coalesce(min(CASE WHEN ahead = 0 THEN idx END) + 3, least(20, max(n))), least(20, max(n))) END AS lead_in FROM f GROUP BY rec)"""


def _lead(spark, d):
    return recordings.lead_in_rows(tables.signal(spark, d), "rec", "idx", "x", 3, 20, 20, 2, 1.2)


@query("lead_in", f"WITH {LEAD} SELECT rec, CAST(lead_in AS BIGINT) AS lead_in FROM l")
def lead_in(spark, d):
    return _lead(spark, d)


@query("clock_offset", f"WITH {LEAD} SELECT sig.rec, idx, {r('(rec % 7) * 0.5e0 + 2e0 + lead_in * 3600e0 + t')} AS t_raw FROM sig JOIN l USING (rec)")
def clock_offset(spark, d):
    """Raw time of each sample: the recording's delay, the start of the slice and the lead-in are added."""
    rows = tables.signal(spark, d).join(_lead(spark, d), "rec")
    offset = recordings.clock_offset((F.col("rec") % 7) * 0.5, F.lit(2.0), F.col("lead_in") * 3600.0)
    return rows.select("rec", "idx", settle(offset + F.col("t")).alias("t_raw"))


def _tables(spark, d):
    """Two feature tables over windows of sixteen samples, with labels and flags."""
    sig = tables.signal(spark, d).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    head = [F.concat(F.lit("s"), "rec").alias("Subject_ID"), F.col("rec").alias("Recording"), F.col("w").alias("window_idx")]
    amp = sig.groupBy("rec", "w").agg(F.avg(F.abs("x")).alias("aSKNA"), F.var_pop("x").alias("varSKNA"), F.min("t").alias("t0"), F.count("*").alias("n"))
    skna = amp.select(*head, "aSKNA", "varSKNA", (F.col("t0") / 60).alias("t_center_sec"))
    nn = tables.intervals(sig.select("rec", "person", "idx", "t", "x")).withColumn("w", F.floor(F.col("idx") / 16).cast("long"))
    time = nn.groupBy("rec", "w").agg(F.avg("nn").alias("meanNN"), F.stddev_samp("nn").alias("SDNN"), F.count("*").alias("n_beats"), F.min("t").alias("t0"), F.avg("x").alias("m"))
    ecg = time.select(*head, "meanNN", "SDNN", F.lit(0.0).alias("LF_power"), "n_beats", (F.col("t0") / 60).alias("t_center_sec"), (F.col("m") + 120).alias("SBP"), (F.col("n_beats") >= 4).alias("usable"), F.lit(True).alias("label_valid"))
    return ecg, skna


_FEATS = ["meanNN", "SDNN", "aSKNA", "varSKNA", "HR", "aSKNA_per_beat", "aSKNA_x_HR", "aSKNA_over_SDNN"]
_P = "(PARTITION BY rec, feature)"
_O = "(PARTITION BY rec, feature ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_R = "(PARTITION BY rec, feature ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
ENGINEER = f"""WITH {SIG}, {NN},
amp AS (SELECT rec, idx // 16 AS w, avg(abs(x)) AS aSKNA, var_pop(x) AS varSKNA FROM sig GROUP BY 1, 2),
tim AS (SELECT rec, idx // 16 AS w, avg(nn) AS meanNN, stddev_samp(nn) AS SDNN, count(*) AS n_beats FROM nn GROUP BY 1, 2),
m AS (SELECT tim.rec, tim.w, meanNN, SDNN, n_beats, aSKNA, varSKNA FROM tim JOIN amp ON amp.rec = tim.rec AND amp.w = tim.w WHERE n_beats >= 4),
k AS (SELECT min(varSKNA) AS lo FROM m),
i AS (SELECT rec, w, meanNN, SDNN, aSKNA, ln(1 + varSKNA + CASE WHEN lo <= -1 THEN -lo + 1e-6 ELSE 0e0 END) AS varSKNA, 60000e0 / greatest(meanNN, 1e-9) AS "HR", aSKNA / greatest(n_beats, 1) AS aSKNA_per_beat,
  aSKNA * (60000e0 / greatest(meanNN, 1e-9)) / 60e0 AS aSKNA_x_HR, aSKNA / (SDNN + 1e-9) AS aSKNA_over_SDNN FROM m, k),
u AS (SELECT rec, w, feature, value AS x FROM (UNPIVOT i ON {', '.join(f'"{c}"' for c in _FEATS)} INTO NAME feature VALUE value)),
a AS (SELECT *, row_number() OVER (PARTITION BY rec, feature ORDER BY w) AS n, stddev_samp(x) OVER {_P} AS sd, quantile_cont(x, 0.5) OVER {_O} AS c0,
  CASE WHEN count(x) OVER {_O} >= 4 THEN quantile_cont(x, 0.75) OVER {_O} - quantile_cont(x, 0.25) OVER {_O} END AS s0 FROM u),
b AS (SELECT *, coalesce(c0, quantile_cont(CASE WHEN n <= 10 THEN x END, 0.5) OVER {_P}) AS c, first_value(s0 IGNORE NULLS) OVER (PARTITION BY rec, feature ORDER BY w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM a),
z AS (SELECT rec, w, feature, coalesce((x - c) / nullif(s, 0), (x - c) / nullif(sd, 0), 0e0) AS x, CAST(n AS DOUBLE) AS n FROM b)
SELECT rec, w, feature, {r('x', 4)} AS level, {r('coalesce(x - lag(x) OVER (PARTITION BY rec, feature ORDER BY w), 0e0)', 4)} AS d1, {r(f'avg(x) OVER {_R}', 4)} AS rm2,
  {r(f'coalesce(stddev_samp(x) OVER {_R}, 0e0)', 4)} AS rs2, {r(f'coalesce(regr_sxy(x, n) OVER {_R} / 2e0, 0e0)', 4)} AS slope FROM z"""


@query("engineer", ENGINEER)
def engineer(spark, d):
    """The composed chain on two feature tables, in long form: the level and the four temporal features of each column."""
    df, cols, _ = en.engineer(*_tables(spark, d), k=2, pruned=False)
    forms = {"level": "", "d1": "_d1", "rm2": "_rm2", "rs2": "_rs2", "slope": "_slope"}
    level = [c for c in cols if not en.base_of(c)[1]]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[settle(F.col(c + s), 4).alias(n) for n, s in forms.items()]) for c in level]))
    return df.select(F.col("Recording").alias("rec"), F.col("window_idx").alias("w"), rows.alias("f")).select("rec", "w", "f.*")


_RIDGE = f"""WITH {SIG}, g AS (SELECT person, t / 86400 AS a, (idx % 17) / 10e0 + t / 864000 AS b, x AS y FROM sig),
s AS (SELECT person, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS yb FROM g GROUP BY 1),
z AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in ('n', 'sa', 'sb', 'sy', 'aa', 'bb', 'ab', 'ay', 'yb'))} FROM s),
q AS (SELECT s.person, {', '.join(f'CAST(z.{c} - s.{c} AS DOUBLE) AS {c}' for c in ('n', 'sa', 'sb', 'sy', 'aa', 'bb', 'ab', 'ay', 'yb'))} FROM s, z),
c AS (SELECT person, n, sa / n AS ma, sb / n AS mb, sy / n AS my, (aa - sa * sa / n) * (1 + 10 / n) AS caa, (bb - sb * sb / n) * (1 + 10 / n) AS cbb, ab - sa * sb / n AS cab, ay - sa * sy / n AS cay, yb - sb * sy / n AS cby FROM q),
w AS (SELECT *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) AS wa, (cby * caa - cay * cab) / (caa * cbb - cab * cab) AS wb FROM c)
SELECT g.person, count(*) AS n, {r('avg(abs(my + wa * (a - ma) + wb * (b - mb) - y))', 4)} AS mae, {r('avg(my + wa * (a - ma) + wb * (b - mb))', 4)} AS mean_pred, {r('avg(abs(my - y))', 4)} AS mae_base FROM g JOIN w USING (person) GROUP BY g.person"""


@query("ridge_loso", _RIDGE)
def ridge_loso(spark, d):
    """Ridge on two columns with each person held out."""
    sig = tables.signal(spark, d).select("person", (F.col("t") / 86400).alias("a"), ((F.col("idx") % 17) / 10.0 + F.col("t") / 864000).alias("b"), F.col("x").alias("y"))
    rows = models.loso_ridge(sig, ["a", "b"], ["y"], "person", 10.0)
    out = rows.groupBy("person").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y"))).alias("mae"), F.avg("y_pred").alias("mean_pred"), F.avg(F.abs(F.col("y_base") - F.col("y"))).alias("mae_base"))
    return out.select("person", "n", *[settle(F.col(c), 4).alias(c) for c in ("mae", "mean_pred", "mae_base")])


@query("exclude_recordings", f"WITH {SIG} SELECT rec, count(*) AS n FROM sig WHERE rec NOT IN (1, 2, 31) GROUP BY rec")
def exclude_recordings(spark, d):
    kept, _ = en.exclude_recordings(tables.signal(spark, d), "rec", "person", [1, 2, 31])
    return kept.groupBy("rec").agg(F.count("*").alias("n"))


@query("fine_tune_columns", f"""WITH {SIG}, s AS (SELECT rec, avg(x) AS m, stddev_pop(x) AS sd, max(x) AS hi, min(x) AS lo, count(*) AS n FROM sig GROUP BY rec)
SELECT rec, {r('m - lo')} AS "margin_SBP", {r('sd / nullif(hi, 0)')} AS "flat_SBP", n >= 69 AS truncated FROM s""")
def fine_tune_columns(spark, d):
    s = tables.signal(spark, d).groupBy("rec").agg(F.avg("x").alias("amean_SBP"), F.stddev_pop("x").alias("predsd_SBP"), F.max("x").alias("truesd_SBP"), F.min("x").alias("post_SBP"), F.count("*").alias("best_epoch"))
    out = en.fine_tune_columns(s, 70)
    return out.select("rec", settle(F.col("margin_SBP")).alias("margin_SBP"), settle(F.col("flat_SBP")).alias("flat_SBP"), "truncated")


_NAMES = [f"{b}{s}" for names in en.FAMILIES.values() for b in names for s in ("", "_d1", "_rm2", "_rs12", "_slope")]
_CASE = " ".join(f"WHEN list_contains([{', '.join(repr(b) for b in names)}], base) THEN '{f}'" for f, names in en.FAMILIES.items())


@query("column_families", f"""WITH p AS (SELECT DISTINCT part FROM (SELECT unnest([{', '.join(map(repr, _NAMES))}]) AS part)),
q AS (SELECT part AS feature, CASE WHEN part = 'R_slope' OR NOT regexp_matches(part, '_(d1|rm[0-9]+|rs[0-9]+|slope)$') THEN part ELSE regexp_replace(part, '_(d1|rm[0-9]+|rs[0-9]+|slope)$', '') END AS base FROM p)
SELECT feature, base, CASE {_CASE} END AS family, CASE WHEN feature = base THEN 'level' ELSE regexp_extract(feature, '_(d1|rm|rs|slope)[0-9]*$', 1) END AS kind,
CASE WHEN feature <> base AND regexp_matches(feature, '_r[ms][0-9]+$') THEN CAST(regexp_extract(feature, '([0-9]+)$', 1) AS INTEGER) + 1 END AS rows FROM q""")
def column_families(spark, d):
    """What the names of engineered columns tell."""
    rows = spark.createDataFrame([(n, en.family_of(n)) for n in _NAMES], "feature string, family string")
    return en.describe(rows).select("feature", "base", "family", "kind", "rows")


@query("graded_predictions", f"""WITH {SIG}, p AS (SELECT person, 120 + x / 40 AS t, 120 + x / 50 AS pred, 121e0 AS zero FROM sig), u AS (SELECT 'pred' AS arm, person, pred - t AS e FROM p UNION ALL SELECT 'zero', person, zero - t FROM p)
SELECT 'SBP' AS target, arm, count(*) AS n, {r('avg(abs(e))')} AS mae, {r('avg(e)')} AS me, {r('stddev_samp(e)')} AS sde FROM u GROUP BY arm""")
def graded_predictions(spark, d):
    """Prediction columns are found by their names."""
    rows = tables.signal(spark, d).select("person", (120 + F.col("x") / 40).alias("SBP_true"), (120 + F.col("x") / 50).alias("SBP_pred"), F.lit(121.0).alias("SBP_zero"))
    return en.graded_arms(rows).select("target", "arm", "n", *[settle(F.col(c)).alias(c) for c in ("mae", "me", "sde")])


@query("catalog", f"""WITH {SIG}, c AS (SELECT DISTINCT rec FROM sig) SELECT 's' || rec || CASE WHEN rec % 3 = 0 THEN '_session1' WHEN rec % 3 = 1 THEN '_full' ELSE '' END AS subject, 's' || rec AS person, rec = 3 AS excluded FROM c""")
def catalog(spark, d):
    names = tables.signal(spark, d).select("rec").distinct().select(F.concat(F.lit("s"), "rec", F.when(F.col("rec") % 3 == 0, "_session1").when(F.col("rec") % 3 == 1, "_full").otherwise("")).alias("subject"))
    return names.withColumns({"person": en.person_key(F.col("subject")), "excluded": F.col("subject").isin("s3_session1")})


@query("channel_lag", f"""WITH {SIG}, f AS (SELECT rec, idx, x, avg(x) OVER (PARTITION BY rec ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM sig),
m AS (SELECT rec, avg(x) AS mx, avg(y) AS my, count(*) * stddev_pop(x) * stddev_pop(y) AS norm FROM f GROUP BY rec),
c AS (SELECT a.rec, b.idx - a.idx AS lag, sum((a.x - mx) * (b.y - my)) AS c, max(norm) AS norm FROM f a JOIN f b ON b.rec = a.rec AND b.idx - a.idx BETWEEN -8 AND 8 JOIN m ON m.rec = a.rec GROUP BY 1, 2)
SELECT rec, CASE WHEN max(norm) > 0 THEN arg_max(lag, c) ELSE 0 END AS lag, {r('CASE WHEN max(norm) > 0 THEN max(c) / max(norm) ELSE 0e0 END')} AS r FROM c GROUP BY rec""")
def channel_lag(spark, d):
    """How far a trailing mean of five samples comes behind its signal, within eight samples."""
    last = Window.partitionBy("rec").orderBy("idx").rowsBetween(-4, 0)
    rows = tables.signal(spark, d).select("rec", "idx", "x", F.avg("x").over(last).alias("y"))
    return split.delay(rows, 1.0, 8.0, idx="idx", size=4096).select("rec", "lag", settle(F.col("r")).alias("r"))
