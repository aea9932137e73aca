"""Features of count windows: amplitude, moments, Hjorth, entropy, autocorrelation, interval statistics, segments.

df has rec, w (window), idx (order) and the sample x; every function returns a row for each (rec, w). Differences never
cross a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.functions.stats import quantile, try_ratio

KEY = ["rec", "w"]


def count_windows(df: DataFrame, size: int, stride: int | None = None, idx: str = "idx") -> DataFrame:
    """Whole windows of `size` rows, one every `stride` rows; a row stands in each window that holds it."""
    stride = stride or size
    total = df.groupBy("rec").agg(F.count("*").alias("__n"))
    if stride == size:
        rows = df.withColumn("w", F.floor(F.col(idx) / size).cast("long"))
    else:
        first = F.greatest(F.lit(0), F.floor((F.col(idx) - size) / stride) + 1).cast("long")
        rows = df.withColumn("w", F.explode(F.sequence(first, F.floor(F.col(idx) / stride).cast("long"))))
    return rows.join(total, "rec").where(F.col("w") * stride + size <= F.col("__n")).drop("__n")


def _diffs(df: DataFrame) -> DataFrame:
    o = Window.partitionBy(*KEY).orderBy("idx")
    return df.withColumn("d1", F.col("x") - F.lag("x").over(o)).withColumn("d2", F.col("d1") - F.lag("d1").over(o)).withColumn("up", F.lead("x").over(o) - F.col("x"))


def amplitude(df: DataFrame, duration: float, theta: float = 1.0) -> DataFrame:
    """Eight amplitude features of the bipolar signal; rates are per unit of `duration`."""
    o = Window.partitionBy(*KEY).orderBy("idx")
    rows = _diffs(df).withColumn("flip", ((F.col("x") < 0) != (F.lag("x").over(o) < 0)).cast("int"))
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    dur = F.lit(float(duration))
    return rows.groupBy(*KEY).agg(
        F.avg(F.abs("x")).alias("aSKNA"),
        F.var_pop("x").alias("varSKNA"),
        rms.alias("rmsSKNA"),
        (F.coalesce(F.sum(F.abs("d1")), F.lit(0.0)) / dur).alias("wlSKNA"),
        (F.coalesce(F.sum("flip"), F.lit(0)) / dur).alias("zcSKNA"),
        (F.coalesce(F.sum((F.col("d1") * F.col("up") < 0).cast("int")), F.lit(0)) / dur).alias("sscSKNA"),
        (F.coalesce(F.sum(F.when(F.abs("d1") > theta, F.abs("d1"))), F.lit(0.0)) / dur).alias("wampSKNA"),
        try_ratio(F.max(F.abs("x")), rms).alias("cfSKNA"),
    )


def moments(df: DataFrame) -> DataFrame:
    """Biased skewness and excess kurtosis of |x|."""
    return df.groupBy(*KEY).agg(F.skewness(F.abs("x")).alias("skewSKNA"), F.kurtosis(F.abs("x")).alias("kurtSKNA"))


def hjorth(df: DataFrame) -> DataFrame:
    """Mobility and complexity; null where a variance is 0."""
    v = _diffs(df).groupBy(*KEY).agg(F.var_pop("x").alias("v0"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2"))
    mobility = F.sqrt(try_ratio(F.col("v1"), F.col("v0")))
    return v.select(*KEY, mobility.alias("mobility"), try_ratio(F.sqrt(try_ratio(F.col("v2"), F.col("v1"))), mobility).alias("complexity"))


def entropy(df: DataFrame, bins: int = 64) -> DataFrame:
    """Shannon entropy in bits over equal bins from the least to the greatest value; null for a constant."""
    w = Window.partitionBy(*KEY)
    low, high = F.min("x").over(w), F.max("x").over(w)
    rows = df.withColumns({"lo": low, "hi": high})
    rows = rows.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))))
    counts = rows.groupBy(*KEY, "bin").count().withColumn("p", F.col("count") / F.sum("count").over(w))
    return counts.groupBy(*KEY).agg(F.sum(F.when(F.col("bin").isNotNull(), -F.col("p") * F.log2("p"))).alias("entropy"))


def autocorrelation(df: DataFrame, lag: int = 1) -> DataFrame:
    """Sum of lagged products over the sum of squares, mean removed."""
    o = Window.partitionBy(*KEY).orderBy("idx")
    rows = df.withColumn("c", F.col("x") - F.avg("x").over(Window.partitionBy(*KEY))).withColumn("next", F.lead("c", lag).over(o))
    return rows.groupBy(*KEY).agg(try_ratio(F.sum(F.col("c") * F.col("next")), F.sum(F.col("c") * F.col("c"))).alias("autocorrelation"))


def interval_time(df: DataFrame, nn: str = "nn") -> DataFrame:
    """meanNN, SDNN and RMSSD of a window's intervals, and the Poincaré ratio; null below two (three) intervals."""
    o = Window.partitionBy(*KEY).orderBy("idx")
    rows = df.withColumn("d", F.col(nn) - F.lag(nn).over(o))
    a = rows.groupBy(*KEY).agg(F.count(nn).alias("n_nn"), F.avg(nn).alias("meanNN"), F.stddev_samp(nn).alias("SDNN"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("RMSSD"), F.stddev_samp("d").alias("sd"), F.var_samp(nn).alias("var"))
    short = F.col("sd") * F.sqrt(F.lit(0.5))
    long_ = 2 * F.col("var") - short * short
    ratio = F.when((F.col("n_nn") >= 3) & (long_ > 0), short / F.sqrt(F.when(long_ > 0, long_)))
    many = F.col("n_nn") >= 2
    return a.select(*KEY, "n_nn", F.when(many, F.col("meanNN")).alias("meanNN"), F.when(many, F.col("SDNN")).alias("SDNN"), F.when(many, F.col("RMSSD")).alias("RMSSD"), ratio.alias("SD1_SD2"))


def slope(df: DataFrame, t: str = "t") -> DataFrame:
    """Least-squares slope of x over t, from three rows on."""
    return df.groupBy(*KEY).agg(F.when(F.count("x") >= 3, F.regr_slope("x", t)).alias("R_slope"))


def higuchi(df: DataFrame, kmax: int = 10) -> DataFrame:
    """Higuchi fractal dimension: slope of ln L(k) over ln(1/k); a straight line gives 1."""
    o = Window.partitionBy(*KEY).orderBy("idx")
    rows = df.withColumns({"i": F.row_number().over(o) - 1, "n": F.count("*").over(Window.partitionBy(*KEY))})
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.abs(F.col("x") - F.lag("x", k).over(o)).alias("d")) for k in range(1, kmax + 1)])
    rows = rows.withColumn("s", steps).select(*KEY, "i", "n", F.explode("s").alias("s")).where("s.d is not null and n >= 2 * s.k")
    per = rows.groupBy(*KEY, F.col("s.k").alias("k"), (F.col("i") % F.col("s.k")).alias("m")).agg(F.sum("s.d").alias("sum"), F.count("*").alias("c"), F.first("n").alias("n"))
    per = per.withColumn("L", F.col("sum") * (F.col("n") - 1) / (F.col("c") * F.col("k") * F.col("k")))
    each = per.groupBy(*KEY, "k").agg(F.avg("L").alias("L")).where("L > 0")
    return each.groupBy(*KEY).agg(F.regr_slope(F.ln("L"), -F.ln("k")).alias("fractal_dimension"))


def dominant_bin(df: DataFrame, size: int) -> DataFrame:
    """Frequency bin (1 to size / 2) of the greatest spectral power of whole windows of `size` rows, mean removed."""
    o = Window.partitionBy(*KEY).orderBy("idx")
    rows = df.withColumns({"i": F.row_number().over(o) - 1, "c": F.col("x") - F.avg("x").over(Window.partitionBy(*KEY))})
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(size // 2))))
    angle = F.col("k") * F.col("i") * F.lit(2 * 3.141592653589793 / size)
    power = rows.groupBy(*KEY, "k").agg((F.pow(F.sum(F.col("c") * F.cos(angle)), F.lit(2.0)) + F.pow(F.sum(F.col("c") * F.sin(angle)), F.lit(2.0))).alias("p"))
    return power.groupBy(*KEY).agg(F.max_by("k", F.struct(F.round("p", 6), -F.col("k"))).cast("long").alias("df_bin"))


def segments(beats: DataFrame, at: str = "t", least: float = 0.5, most: float = 2.5) -> DataFrame:
    """Three consecutive peaks and their duration; keep tells whether it is within bounds."""
    w = Window.partitionBy("rec").orderBy("idx")
    rows = beats.select("rec", "idx", F.col(at).alias("p0"), F.lead(at, 1).over(w).alias("p1"), F.lead(at, 2).over(w).alias("p2")).where("p2 is not null")
    dur = F.col("p2") - F.col("p0")
    return rows.withColumns({"dur": dur, "keep": (dur >= least) & (dur <= most)})


def sequences(beats: DataFrame, m: int, stride: int = 1, keep: str = "keep") -> DataFrame:
    """Every stride-th run of m consecutive beats as an array of their indices, if all of them are kept."""
    w = Window.partitionBy("rec").orderBy("idx")
    ahead = w.rowsBetween(0, m - 1)
    rows = beats.withColumns({"pos": F.row_number().over(w) - 1, "seq": F.collect_list("idx").over(ahead), "whole": F.min(F.col(keep).cast("int")).over(ahead)})
    return rows.where((F.size("seq") == m) & (F.col("pos") % stride == 0) & (F.col("whole") == 1)).select("rec", "idx", "seq")


def beat_stats(nn: DataFrame, least: float, most: float) -> DataFrame:
    """Per recording: intervals within bounds, their mean and population deviation, and the 99th percentile of two in a row, with the segment length it asks for."""
    w = Window.partitionBy("rec").orderBy("idx")
    rows = nn.withColumn("seg", F.col("nn") + F.lead("nn").over(w)).withColumn("ok", F.col("nn").between(least, most))
    good = F.when(F.col("ok"), F.col("nn"))
    out = rows.groupBy("rec").agg(F.count("*").alias("n"), F.count(good).alias("n_ok"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("sd"), F.min(good).alias("lo"), F.max(good).alias("hi"), quantile("nn", 0.5).alias("median"), quantile("seg", 0.99).alias("p99"))
    return out.withColumn("length", (F.ceil(F.ceil(F.when(F.col("p99") > 0, F.col("p99"))) / 256) * 256).cast("long"))
