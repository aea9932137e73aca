"""Queries of scores, baselines, standards and splits over order lines, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseforge.functions.stats import settle
from pulseforge.operators import scoring as sc
from pulseforge.plans.registry import CLF, PRED, SIG, query, r
from pulseforge.sources import tables

BASE = f"""{PRED}, own AS (SELECT person, sum(y) AS s, count(y) AS n FROM pred GROUP BY 1), tot AS (SELECT sum(s) AS ss, sum(n) AS nn FROM own),
arms AS (SELECT p.*, (ss - s) / nullif(nn - n, 0) AS train_mean, s / n AS oracle FROM pred p JOIN own USING (person), tot)"""
CUM = f"""{CLF}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM clf GROUP BY p), c AS (
  SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM g)"""


def _told(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[settle(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _arms(spark, d):
    return sc.loso_baselines(tables.predictions(spark, d))


@query("loso_baselines", f"""WITH {BASE} SELECT person, count(*) AS n, {r('avg(abs(train_mean - y))')} AS mae_train_mean, {r('avg(abs(oracle - y))')} AS mae_oracle FROM arms GROUP BY person""")
def loso_baselines(spark, d):
    rows = _arms(spark, d).groupBy("person").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("train_mean") - F.col("y"))).alias("mae_train_mean"), F.avg(F.abs(F.col("oracle") - F.col("y"))).alias("mae_oracle"))
    return _told(rows)


@query("regression_score", f"""WITH {BASE} SELECT person, count(*) AS n, {r('avg(abs(train_mean - y))')} AS mae, {r('avg(train_mean - y)')} AS me, {r('stddev_samp(train_mean - y)')} AS sde FROM arms GROUP BY person""")
def regression_score(spark, d):
    return _told(sc.regression_score(_arms(spark, d), "y", "train_mean", ["person"]))


OFFSET = f"""{PRED}, f AS (SELECT person, min(t) AS t0 FROM pred GROUP BY 1), o AS (SELECT p.person, CASE WHEN count(CASE WHEN t <= t0 + 120 THEN y END) >= 3 THEN avg(CASE WHEN t <= t0 + 120 THEN y END) ELSE avg(y) END AS off FROM pred p JOIN f USING (person) GROUP BY 1)"""


@query("calib_offset", f"""WITH {OFFSET} SELECT person, {r('off')} AS "offset" FROM o""")
def calib_offset(spark, d):
    return _told(sc.calibration_offset(tables.predictions(spark, d), 120.0).groupBy("person").agg(F.first("offset").alias("offset")))


@query("zero_delta", f"""WITH {OFFSET} SELECT person, {r('avg(abs(off - y))')} AS mae_zero FROM pred JOIN o USING (person) GROUP BY person""")
def zero_delta(spark, d):
    rows = sc.calibration_offset(tables.predictions(spark, d), 120.0)
    return _told(rows.groupBy("person").agg(F.avg(F.abs(F.col("offset") - F.col("y"))).alias("mae_zero")))


@query("gap_to_baseline", f"""WITH {OFFSET}, {"own AS (SELECT person, sum(y) AS s, count(y) AS n FROM pred GROUP BY 1), tot AS (SELECT sum(s) AS ss, sum(n) AS nn FROM own), m AS (SELECT p.person, avg(abs(off - y)) AS zero, avg(abs((ss - s) / nullif(nn - n, 0) - y)) AS train FROM pred p JOIN o USING (person) JOIN own USING (person), tot GROUP BY 1)"}
SELECT person, {r('zero - train')} AS gap, CASE WHEN zero < train THEN 'BEATS' ELSE 'does not beat' END AS verdict FROM m""")
def gap_to_baseline(spark, d):
    """Gap of the calibration value to the mean of the others, and whether it is strictly better: by more than the sums' rounding, so equal means never beat each other."""
    rows = sc.loso_baselines(sc.calibration_offset(tables.predictions(spark, d), 120.0))
    m = rows.groupBy("person").agg(F.avg(F.abs(F.col("offset") - F.col("y"))).alias("zero"), F.avg(F.abs(F.col("train_mean") - F.col("y"))).alias("train"), F.count("*").alias("n"))
    rounding = F.col("n") * F.lit(2.0**-52) * (F.col("zero") + F.col("train"))
    return m.select("person", settle(F.col("zero") - F.col("train")).alias("gap"), F.when(F.col("train") - F.col("zero") > rounding, "BEATS").otherwise("does not beat").alias("verdict"))


@query("loso_ridge_1d", f"""WITH {SIG}, s AS (SELECT person, count(*) AS n, sum(t / 86400) AS sx, sum(x) AS sy, sum((t / 86400) * (t / 86400)) AS sxx, sum((t / 86400) * x) AS sxy FROM sig GROUP BY 1),
z AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s), q AS (SELECT s.person, z.n - s.n AS n, z.sx - s.sx AS sx, z.sy - s.sy AS sy, z.sxx - s.sxx AS sxx, z.sxy - s.sxy AS sxy FROM s, z),
f AS (SELECT person, (sxy - sx * sy / n) / ((sxx - sx * sx / n) * (1 + 10e0 / n)) AS b, n, sx, sy FROM q) SELECT person, {r('b', 4)} AS slope, {r('sy / n - b * sx / n', 4)} AS intercept FROM f""")
def loso_ridge_1d(spark, d):
    sig = tables.signal(spark, d).withColumn("day", F.col("t") / 86400)
    rows = sc.loso_ridge(sig, "day", "x", "person", 10.0)
    return _told(rows.groupBy("person").agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept")), 4)


@query("time_split", f"""WITH {SIG}, s AS (SELECT rec, x, (row_number() OVER (PARTITION BY rec ORDER BY idx) - 1) / count(*) OVER (PARTITION BY rec) AS place FROM sig), v AS (SELECT *, CASE WHEN place < 0.5e0 THEN 'adapt' WHEN place < 0.6e0 THEN 'val' ELSE 'test' END AS slice FROM s)
SELECT rec, slice, count(*) AS n, {r('avg(x)')} AS mean_x FROM v GROUP BY 1, 2""")
def time_split(spark, d):
    rows = sc.temporal_split(tables.signal(spark, d), "rec", ["idx"])
    return _told(rows.groupBy("rec", "slice").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")))


@query("drift", f"""WITH {SIG}, s AS (SELECT rec, x, (row_number() OVER (PARTITION BY rec ORDER BY idx) - 1) / count(*) OVER (PARTITION BY rec) AS place FROM sig)
SELECT rec, {r('avg(CASE WHEN place >= 0.6e0 THEN x END) - avg(CASE WHEN place < 0.5e0 THEN x END)')} AS drift, {r('stddev_pop(CASE WHEN place >= 0.6e0 THEN x END)')} AS sd_test FROM s GROUP BY rec""")
def drift(spark, d):
    rows = sc.temporal_split(tables.signal(spark, d), "rec", ["idx"])
    late, early = F.when(F.col("slice") == "test", F.col("x")), F.when(F.col("slice") == "adapt", F.col("x"))
    return _told(rows.groupBy("rec").agg((F.avg(late) - F.avg(early)).alias("drift"), F.stddev_pop(late).alias("sd_test")))


@query("blocked_cv_mean", f"""WITH {SIG}, i AS (SELECT rec, x AS y, row_number() OVER (PARTITION BY rec ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM sig),
b AS (SELECT *, CAST(((i + 1) * 5 - 1) // n AS INTEGER) AS block FROM i), g AS (SELECT rec, block, min(i) AS lo, max(i) AS hi, count(*) AS m FROM b GROUP BY 1, 2),
m AS (SELECT g.rec, g.block, CASE WHEN m >= 3 AND count(o.y) >= 10 THEN avg(o.y) END AS p FROM g JOIN b o ON o.rec = g.rec AND (o.i < g.lo - 2 OR o.i > g.hi + 2) GROUP BY g.rec, g.block, m)
SELECT b.rec, b.block, count(*) AS n, {r('avg(abs(p - y))')} AS mae FROM b JOIN m ON m.rec = b.rec AND m.block = b.block GROUP BY 1, 2""")
def blocked_cv_mean(spark, d):
    rows = sc.blocked_cv_mean(tables.signal(spark, d).withColumnRenamed("x", "y"), "rec", ["idx"], gap=2)
    return _told(rows.groupBy("rec", "block").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")))


@query("auc_midrank", f"""WITH {CLF}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM clf), s AS (SELECT sum(CASE WHEN y = 1 THEN rk END) AS sr, CAST(sum(y) AS BIGINT) AS np, CAST(sum(1 - y) AS BIGINT) AS nn FROM k)
SELECT {r('(sr - np * (np + 1) / 2e0) / nullif(np * nn, 0)')} AS auc, np AS n_pos, nn AS n_neg FROM s""")
def auc_midrank(spark, d):
    return _told(sc.roc_auc(tables.classified(spark, d)))


@query("avg_precision", f"""WITH {CUM} SELECT {r('sum(pos / pp * tp / (tp + fp))')} AS ap, {r('max(pp / (pp + nn))')} AS prevalence FROM c""")
def avg_precision(spark, d):
    return _told(sc.average_precision(tables.classified(spark, d)))


@query("roc_curve", f"""WITH {CUM} SELECT p AS threshold, {r('fp / nn')} AS fpr, {r('tp / pp')} AS tpr FROM c""")
def roc_curve(spark, d):
    return sc.roc_curve(tables.classified(spark, d)).select("threshold", settle(F.col("fpr")).alias("fpr"), settle(F.col("tpr")).alias("tpr"))


@query("threshold_fpr", f"""WITH {CLF}, f AS (SELECT doc_id % 5 AS fold, y, p FROM clf), t AS (SELECT fold, quantile_cont(CASE WHEN y = 0 THEN p END, 0.9) AS thr FROM f GROUP BY 1)
SELECT f.fold, {r('thr')} AS threshold, {r('avg(CASE WHEN y = 1 THEN CASE WHEN p >= thr THEN 1e0 ELSE 0e0 END END)')} AS sens, {r('avg(CASE WHEN y = 0 THEN CASE WHEN p < thr THEN 1e0 ELSE 0e0 END END)')} AS spec FROM f JOIN t ON t.fold = f.fold GROUP BY f.fold, thr""")
def threshold_fpr(spark, d):
    rows = tables.classified(spark, d).withColumn("fold", F.col("doc_id") % 5)
    return _told(sc.threshold_at_fpr(rows, "y", "p", 0.1, ["fold"]))


@query("cpt_summary", f"""WITH {CLF}, f AS (SELECT doc_id % 5 AS fold, y, p FROM clf), k AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2e0 AS rk FROM f),
a AS (SELECT fold, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * sum(1 - y), 0) AS auc FROM k GROUP BY fold)
SELECT {r('avg(auc)')} AS auc_mean, {r('stddev_samp(auc)')} AS auc_sd, count(CASE WHEN auc > 0.5e0 THEN 1 END) AS n_above_half FROM a""")
def cpt_summary(spark, d):
    """Spread of the folds' AUC; scores are counted by range in each fold."""
    rows = tables.classified(spark, d).withColumn("fold", F.col("doc_id") % 5)
    return _told(sc.auc_summary(rows, "fold").select("auc_mean", "auc_sd", "n_above_half"))


GRADES = """CASE WHEN a5 >= 60 AND a10 >= 85 AND a15 >= 95 THEN 'A' WHEN a5 >= 50 AND a10 >= 75 AND a15 >= 90 THEN 'B' WHEN a5 >= 40 AND a10 >= 65 AND a15 >= 85 THEN 'C' ELSE 'D' END"""
STAND = f"""avg(CASE WHEN abs(e) <= 5 THEN 1e0 ELSE 0e0 END) * 100 AS a5, avg(CASE WHEN abs(e) <= 10 THEN 1e0 ELSE 0e0 END) * 100 AS a10, avg(CASE WHEN abs(e) <= 15 THEN 1e0 ELSE 0e0 END) * 100 AS a15, avg(abs(e)) AS mae, avg(e) AS me, stddev_samp(e) AS sde, count(e) AS n"""
TOLD = f"""n, {r('mae')} AS mae, {r('me')} AS me, {r('sde')} AS sde, {r('a5', 4)} AS within5, {r('a10', 4)} AS within10, {r('a15', 4)} AS within15, {GRADES} AS bhs, CASE WHEN mae <= 5 THEN 'A' WHEN mae <= 6 THEN 'B' WHEN mae <= 7 THEN 'C' ELSE 'D' END AS ieee, coalesce(abs(me) <= 5 AND sde <= 8, false) AS aami"""


def _graded(df, keys):
    return df.select(*keys, "n", *[settle(F.col(c)).alias(c) for c in ("mae", "me", "sde")], *[settle(F.col(c), 4).alias(c) for c in ("within5", "within10", "within15")], "bhs", "ieee", "aami")


@query("bhs_ieee_aami", f"""WITH {BASE}, z AS (SELECT person, {STAND.replace('(e)', '((oracle - y) / 2)')} FROM arms GROUP BY person) SELECT person, {TOLD} FROM z""")
def bhs_ieee_aami(spark, d):
    rows = _arms(spark, d).withColumn("e", (F.col("oracle") - F.col("y")) / 2)
    return _graded(sc.standards(rows, "e", ["person"]), ["person"])


@query("grade_arms", f"""WITH {BASE}, u AS (SELECT 'train_mean' AS arm, train_mean - y AS e FROM arms UNION ALL SELECT 'oracle', oracle - y FROM arms), z AS (SELECT arm, {STAND} FROM u GROUP BY arm) SELECT arm, {TOLD} FROM z""")
def grade_arms(spark, d):
    """All prediction columns graded at once."""
    rows = _arms(spark, d).unpivot(["person", "y"], ["train_mean", "oracle"], "arm", "p").withColumn("e", F.col("p") - F.col("y"))
    return _graded(sc.standards(rows, "e", ["arm"]), ["arm"])


LIMITS = ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(sc.ISO_LIMITS))


@query("iso_81060", f"""WITH {BASE}, u AS (SELECT 'oracle' AS arm, person, oracle - y AS e FROM arms UNION ALL SELECT 'half', person, (25e0 - y) / 4 FROM arms UNION ALL SELECT 'off', person, 40e0 - y FROM arms),
o AS (SELECT arm, person, avg(e) AS m FROM u GROUP BY 1, 2), c AS (SELECT arm, count(e) AS n, avg(e) AS me, stddev_samp(e) AS sd FROM u GROUP BY 1), p AS (SELECT arm, count(*) AS n_persons, stddev_samp(m) AS sd_persons FROM o GROUP BY 1),
b(i, x, y) AS (VALUES {LIMITS}), l AS (SELECT c.arm, coalesce(max(a.y + (abs(me) - a.x) / (z.x - a.x) * (z.y - a.y)), 0e0) AS lim FROM c LEFT JOIN (b a JOIN b z ON z.i = a.i + 1) ON abs(me) >= a.x AND abs(me) <= z.x GROUP BY 1)
SELECT c.arm, n, n_persons, {r('me')} AS me, {r('sd', 4)} AS sd, {r('sd_persons')} AS sd_persons, {r('lim')} AS "limit", coalesce(abs(me) <= 5 AND sd <= 8, false) AS criterion1, coalesce(n_persons > 1 AND sd_persons <= lim, false) AS criterion2 FROM c JOIN p USING (arm) JOIN l USING (arm)""")
def iso_81060(spark, d):
    rows = _arms(spark, d)
    e = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), x.alias("e")) for n, x in (("oracle", F.col("oracle") - F.col("y")), ("half", (25.0 - F.col("y")) / 4), ("off", 40.0 - F.col("y")))]))
    out = sc.iso_81060(rows.select("person", e.alias("k")).select("person", "k.*"), "e", "person", ["arm"])
    return out.select("arm", "n", "n_persons", settle(F.col("me")).alias("me"), settle(F.col("sd"), 4).alias("sd"), *[settle(F.col(c)).alias(c) for c in ("sd_persons", "limit")], "criterion1", "criterion2")


@query("bland_altman", f"""WITH {BASE}, z AS (SELECT person, avg(train_mean - y) AS bias, stddev_samp(train_mean - y) AS sd FROM arms GROUP BY 1) SELECT person, {r('bias')} AS bias, {r('sd')} AS sd, {r('bias - 1.96e0 * sd')} AS low, {r('bias + 1.96e0 * sd')} AS high FROM z""")
def bland_altman(spark, d):
    return _told(sc.bland_altman(_arms(spark, d), "y", "train_mean", ["person"]))


@query("ablation_grid", f"""WITH {BASE}, u AS (SELECT person % 4 AS feature_set, 'train_mean' AS arm, abs(train_mean - y) AS e FROM arms UNION ALL SELECT person % 4, 'oracle', abs(oracle - y) FROM arms)
SELECT feature_set, {r("avg(CASE WHEN arm = 'train_mean' THEN e END)")} AS train_mean, {r("avg(CASE WHEN arm = 'oracle' THEN e END)")} AS oracle FROM u GROUP BY 1""")
def ablation_grid(spark, d):
    rows = _arms(spark, d).withColumn("feature_set", F.col("person") % 4).unpivot(["feature_set", "y"], ["train_mean", "oracle"], "arm", "p")
    return _told(rows.groupBy("feature_set").pivot("arm", ["train_mean", "oracle"]).agg(F.avg(F.abs(F.col("p") - F.col("y")))))
