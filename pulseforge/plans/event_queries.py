"""Queries of event timing over events: cycles of ten hours, a score from the value, thresholds by recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseforge.functions.stats import settle
from pulseforge.operators import events as ev
from pulseforge.plans.registry import SIG, query, r
from pulseforge.sources import tables

#: Hours since the cycle's event began, by recording and cycle; the event lasts two hours.
EPI = f"""{SIG}, e AS (SELECT rec AS recording, person, idx, CAST(floor(t / 3600 / 10) AS BIGINT) AS cycle, (t / 3600) % 10 - 4 AS t_rel, x AS p, -20e0 AS thr FROM sig)"""


def _epi(spark, d):
    h = F.col("t") / 3600
    return tables.signal(spark, d).select(F.col("rec").alias("recording"), "person", "idx", F.floor(h / 10).cast("long").alias("cycle"), (F.pmod(h, F.lit(10.0)) - 4).alias("t_rel"), F.col("x").alias("p"), F.lit(-20.0).alias("thr"))


@query("first_run", f"""WITH {SIG}, f AS (SELECT rec, idx, t, x > 0 AS flag FROM sig), g AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM f),
n AS (SELECT *, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY rec, g ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT rec, min(CASE WHEN flag AND run >= 3 THEN idx END) AS at FROM n GROUP BY rec""")
def first_run(spark, d):
    return ev.first_run(tables.signal(spark, d).withColumn("flag", F.col("x") > 0), "flag", ["rec"], "idx", 3)


_RUN = "(PARTITION BY recording, cycle ORDER BY t_rel ROWS UNBOUNDED PRECEDING)"


@query("episodes", f"""WITH {EPI}, a AS (SELECT *, t_rel >= 0 AND t_rel < 2 AS du, t_rel >= 2 AS af FROM e),
d1 AS (SELECT *, sum(CASE WHEN p >= thr THEN 0 ELSE 1 END) OVER {_RUN} AS g FROM a WHERE du), d2 AS (SELECT *, row_number() OVER (PARTITION BY recording, cycle, g, p >= thr ORDER BY t_rel) AS run FROM d1), d3 AS (SELECT recording, cycle, min(CASE WHEN p >= thr AND run >= 2 THEN t_rel END) AS a FROM d2 GROUP BY 1, 2),
f1 AS (SELECT *, sum(CASE WHEN p < thr THEN 0 ELSE 1 END) OVER {_RUN} AS g FROM a WHERE af), f2 AS (SELECT *, row_number() OVER (PARTITION BY recording, cycle, g, p < thr ORDER BY t_rel) AS run FROM f1), f3 AS (SELECT recording, cycle, min(CASE WHEN p < thr AND run >= 2 THEN t_rel END) AS b FROM f2 GROUP BY 1, 2),
o AS (SELECT recording, cycle, count(CASE WHEN du THEN 1 END) AS n_during, max(CASE WHEN du THEN p END) AS pm, avg(CASE WHEN du THEN p END) AS pa, avg(CASE WHEN t_rel < 0 THEN p END) AS pb FROM a GROUP BY 1, 2 HAVING count(CASE WHEN du THEN 1 END) >= 2)
SELECT o.recording, o.cycle, n_during, {r('a + 0.25e0', 5)} AS onset_latency, {r('b + 0.25e0 - 2', 5)} AS offset_latency, {r('pm')} AS p_max_during, {r('pa')} AS p_mean_during, {r('pb')} AS p_mean_before
FROM o LEFT JOIN d3 ON d3.recording = o.recording AND d3.cycle = o.cycle LEFT JOIN f3 ON f3.recording = o.recording AND f3.cycle = o.cycle""")
def episodes(spark, d):
    out = ev.episodes(_epi(spark, d), 2, 0.25, 2.0)
    return out.select("recording", "cycle", "n_during", *[settle(F.col(c), 5).alias(c) for c in ("onset_latency", "offset_latency")], *[settle(F.col(c)).alias(c) for c in ("p_max_during", "p_mean_during", "p_mean_before")])


@query("trajectory", f"""WITH {EPI}, o AS (SELECT person, CAST(floor(t_rel) AS BIGINT) AS t_rel, avg(p) AS m FROM e GROUP BY 1, 2) SELECT t_rel, {r('avg(m)')} AS mean, {r('stddev_samp(m) / sqrt(count(m))')} AS sem, count(m) AS n FROM o GROUP BY 1""")
def trajectory(spark, d):
    out = ev.trajectory(_epi(spark, d).withColumn("t_rel", F.floor("t_rel").cast("long")))
    return out.select("t_rel", settle(F.col("mean")).alias("mean"), settle(F.col("sem")).alias("sem"), "n")


@query("cum_detection", f"""WITH {EPI}, l AS (SELECT recording, cycle, min(CASE WHEN t_rel >= 0 AND p >= 0 THEN t_rel END) AS lat FROM e GROUP BY 1, 2) SELECT CAST(x AS DOUBLE) AS x, {r('avg(CASE WHEN lat <= x THEN 1e0 ELSE 0e0 END) * 100', 4)} AS percent FROM l, range(0, 7) t(x) GROUP BY x""")
def cum_detection(spark, d):
    lat = _epi(spark, d).groupBy("recording", "cycle").agg(F.min(F.when((F.col("t_rel") >= 0) & (F.col("p") >= 0), F.col("t_rel"))).alias("lat"))
    return ev.cumulative_detection(lat, "lat", list(range(7))).select("x", settle(F.col("percent"), 4).alias("percent"))


@query("offset_scan", f"""WITH {SIG}, b AS (SELECT rec, s, x AS p, CASE WHEN m >= 4.5e0 AND m < 5.5e0 THEN 1e0 ELSE 0e0 END AS bx FROM (SELECT rec, s, x, ((t / 3600 - s) % 10 + 10) % 10 AS m FROM sig, range(-4, 5) q(s))),
c AS (SELECT rec, s, count(p) AS n, round(covar_pop(p, bx) / nullif(CASE WHEN stddev_pop(p) * stddev_pop(bx) > 1e-300 THEN stddev_pop(p) * stddev_pop(bx) END, 0), 6) AS r FROM b GROUP BY 1, 2 HAVING count(p) >= 40)
SELECT rec, n, CAST(first(s ORDER BY r DESC NULLS LAST, s) AS DOUBLE) AS shift, max(r) AS r FROM c GROUP BY rec, n""")
def offset_scan(spark, d):
    return ev.offset_scan(tables.signal(spark, d).withColumn("h", F.col("t") / 3600), ["rec"], list(range(-4, 5)), "h", "x", 10.0, 4.5, 5.5)


@query("sham_mask", f"""WITH {SIG}, c AS (SELECT (t / 3600) % 10 AS m, x FROM sig) SELECT CAST(o AS DOUBLE) AS onset, CAST(CASE WHEN m >= o AND m < o + 1 THEN 1 ELSE 0 END AS INTEGER) AS y, count(*) AS n, {r('avg(x)')} AS mean_x FROM c, (VALUES (1e0), (2e0), (7e0)) v(o) WHERE NOT (m >= 4 AND m < 6) GROUP BY 1, 2""")
def sham_mask(spark, d):
    rows = tables.signal(spark, d).withColumn("cycle_min", F.pmod(F.col("t") / 3600, F.lit(10.0)))
    return ev.sham_mask(rows, [1.0, 2.0, 7.0]).groupBy("onset", "y").agg(F.count("*").alias("n"), settle(F.avg("x")).alias("mean_x"))


@query("stride_recovery", f"""WITH {SIG}, l AS (SELECT rec, t - lag(t) OVER (PARTITION BY rec ORDER BY idx) AS dt FROM sig) SELECT rec, {r('quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5)', 3)} AS stride, coalesce(abs(quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) - 3600) < 1e-6, false) AS disjoint FROM l GROUP BY rec""")
def stride_recovery(spark, d):
    """Median positive step of a recording, and whether windows of an hour would be disjoint."""
    nn = tables.intervals(tables.signal(spark, d))
    step = F.percentile(F.when(F.col("nn") > 0, F.col("nn")), 0.5)
    return nn.groupBy("rec").agg(settle(step, 3).alias("stride"), F.coalesce(F.abs(step - 3600) < 1e-6, F.lit(False)).alias("disjoint"))
