"""Scores, baselines without features, device standards, and additive leave-one-person-out models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.functions import ranges
from pulseforge.functions.stats import try_ratio
from pulseforge.functions.steps import cut
from pulseforge.operators.ceilings import block_of

# The limit of the spread of persons' mean errors by the size of the mean error (ISO 81060-2).
ISO_LIMITS = [(0.0, 6.95), (0.5, 6.87), (1.0, 6.71), (1.5, 6.47), (2.0, 6.15), (2.5, 5.76), (3.0, 5.29), (3.5, 4.73), (4.0, 4.08), (4.5, 3.34), (5.0, 2.49)]


def errors(group: list[str], err: Column) -> list[Column]:
    """Aggregates of an error column: n, MAE, ME, SDE (sample)."""
    return [F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("me"), F.stddev_samp(err).alias("sde")]


def regression_score(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*errors(by or [], F.col(p) - F.col(y)))


def loso_baselines(df: DataFrame, y: str = "y", person: str = "person") -> DataFrame:
    """train_mean: mean of all other persons; oracle: the person's own mean. Sums by person and in all, no loop over persons.

    Totals come from the per-person sums (a row for each person), so no window runs over all rows.
    """
    own = df.groupBy(person).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    all_ = own.agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    stats = own.join(F.broadcast(all_))  # one row
    stats = stats.select(person, try_ratio(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")).alias("train_mean"), (F.col("__s") / F.col("__n")).alias("oracle"))
    return df.join(stats, person)


def calibration_offset(df: DataFrame, span: float, y: str = "y", t: str = "t", person: str = "person", least: int = 3) -> DataFrame:
    """offset: mean of y over the person's first `span` of time, of all rows if these are fewer than `least`."""
    first = df.groupBy(person).agg(F.min(t).alias("__t0"))
    rows = df.join(first, person)
    early = F.when(F.col(t) <= F.col("__t0") + span, F.col(y))
    own = rows.groupBy(person).agg(F.when(F.count(early) >= least, F.avg(early)).otherwise(F.avg(y)).alias("offset"))
    return df.join(own, person)


def loso_ridge(df: DataFrame, x: str, y: str, person: str, alpha: float = 10.0) -> DataFrame:
    """Leave-one-person-out ridge on one standardised feature: fold slopes and intercepts by subtracting the person's sums."""
    sums = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")]
    own = df.groupBy(person).agg(*sums)
    names = ["n", "sx", "sy", "sxx", "sxy"]
    total = own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    rest = own.join(F.broadcast(total)).select(person, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])  # one row of totals
    n = F.col("n")
    cxx, cxy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    slope = try_ratio(cxy, cxx + F.lit(alpha) * cxx / n)
    fit = rest.where("n > 0").select(person, slope.alias("slope"), (F.col("sy") / n - slope * F.col("sx") / n).alias("intercept"))
    return df.join(fit, person).withColumn("p", F.col("intercept") + F.col("slope") * F.col(x))


def temporal_split(df: DataFrame, rec: str, order: list[str], adapt: float = 0.5, val: float = 0.6) -> DataFrame:
    """slice: adapt, val or test by the row's place in its recording.

    A recording without val rows but with at least four adapt rows gives the last of these (from their 0.85 quantile of
    places on) to val.
    """
    w = Window.partitionBy(rec)
    place = (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)
    rows = df.withColumn("place", place)
    n_adapt, n_val = F.sum((F.col("place") < adapt).cast("int")).over(w), F.sum(((F.col("place") >= adapt) & (F.col("place") < val)).cast("int")).over(w)
    # places are k / n, so their quantile follows from the count
    rows = rows.withColumn("__cut", F.when((n_val == 0) & (n_adapt >= 4), 0.85 * (n_adapt - 1) / F.count("*").over(w)))
    early = F.col("place") < adapt
    late = early & (F.col("place") >= F.col("__cut"))
    return rows.withColumn("slice", F.when(late, "val").when(early, "adapt").when(F.col("place") < val, "val").otherwise("test")).drop("__cut")


def blocked_cv_mean(df: DataFrame, rec: str, order: list[str], blocks: int = 5, gap: int = 1, y: str = "y", least_block: int = 3, least_train: int = 10) -> DataFrame:
    """Contiguous blocks (block k begins at place floor(k * n / blocks)); each is predicted (p) by the mean of the rows more than `gap` rows away from it.

    Sums up to each row, taken at the edges of a block, give the training sums, so no pair of rows is compared. Blocks of
    fewer than least_block rows, or with fewer than least_train training rows, have no prediction.
    """
    w = Window.partitionBy(rec)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    rows = rows.withColumn("block", block_of(F.col("__i"), F.col("__n"), blocks))
    ahead = w.orderBy("__i")
    near = F.struct(F.sum(y).over(ahead.rowsBetween(-gap, -1)).alias("s"), F.count(y).over(ahead.rowsBetween(-gap, -1)).alias("c"))
    far = F.struct(F.sum(y).over(ahead.rowsBetween(1, gap)).alias("s"), F.count(y).over(ahead.rowsBetween(1, gap)).alias("c"))
    rows = rows.withColumns({"__near": near, "__far": far}) if gap else rows.withColumns({c: F.struct(F.lit(None).cast("double").alias("s"), F.lit(0).cast("long").alias("c")) for c in ("__near", "__far")})
    sums = rows.groupBy(rec, "block").agg(F.sum(y).alias("s"), F.count(y).alias("c"), F.count("*").alias("m"), F.min_by("__near", "__i").alias("a"), F.max_by("__far", "__i").alias("b"))
    every = Window.partitionBy(rec)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    train = F.sum("c").over(every) - F.col("c") - F.col("a.c") - F.col("b.c")
    total = F.sum("s").over(every) - zero("s") - zero("a.s") - zero("b.s")
    means = sums.select(rec, "block", F.when((F.col("m") >= least_block) & (train >= least_train), try_ratio(total, train)).alias("p"))
    return rows.drop("__i", "__n", "__near", "__far").join(means, [rec, "block"])


def score_counts(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Positives (pos) and negatives (neg) of each distinct score (of each group)."""
    return df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def cumulated(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Distinct scores (of each group) in descending order with positives and negatives so far (tp, fp) and in all (n_pos, n_neg)."""
    return cumulated_counts(score_counts(df, y, p, by or []), p, by or [])


def cumulated_counts(counts: DataFrame, p: str, by: list[str]) -> DataFrame:
    """cumulated() of what score_counts() gives.

    Scores are dealt to ranges with fixed cut points; sums within a range come from a window and those of the ranges above
    from a table with a row for each range, so that no window runs over all scores. The counts are written once, as they are read three times.
    """
    counts = counts if hasattr(counts, "cut_path") else cut(counts, "scores")
    counts = ranges.ranged(counts, p, "part")(counts)
    parts = counts.groupBy(*by, "part").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = group.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select(*by, "part", F.coalesce(F.sum("a").over(above), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(above), F.lit(0)).alias("b0"), F.sum("a").over(group).alias("n_pos"), F.sum("b").over(group).alias("n_neg"))
    inside = Window.partitionBy(*by, "part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).join(parts, [*by, "part"])
    return rows.select(*by, p, "pos", "neg", (F.col("tp") + F.col("a0")).alias("tp"), (F.col("fp") + F.col("b0")).alias("fp"), "n_pos", "n_neg")


def area(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Area under the ROC curve (of each group) of cumulated rows, and the aggregates `more`; ties count half."""
    part = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    told = rows.groupBy(*by).agg(F.sum(part).alias("a"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), *more)
    return told.withColumn("auc", try_ratio(F.col("a"), F.col("n_pos") * F.col("n_neg"))).drop("a")


def gained() -> Column:
    """Average precision of cumulated rows: the recall gained by a score times the precision there, added up."""
    return F.sum(try_ratio(F.col("pos"), F.col("n_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (of each group); ties count half."""
    return area(cumulated(df, y, p, by), by or []).select(*(by or []), "auc", "n_pos", "n_neg")


def auc_summary(df: DataFrame, fold: str, y: str = "y", p: str = "p") -> DataFrame:
    """Mean and sample deviation of the folds' AUC, how many folds are above a half, and the pooled AUC and average precision: one row.

    The rows are read once; the pooled counts add up those of the folds.
    """
    counts = cut(score_counts(df, y, p, [fold]), "folds")
    each = area(cumulated_counts(counts, p, [fold]), [fold]).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"), F.count(F.when(F.col("auc") > 0.5, 1)).alias("n_above_half"))
    every = counts.groupBy(p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pooled = area(cumulated_counts(every, p, []), [], gained().alias("ap_pooled")).select(F.col("auc").alias("auc_pooled"), "ap_pooled")
    return each.join(F.broadcast(pooled))  # one row each


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there."""
    return cumulated(df, y, p).agg(gained().alias("ap"), F.max(F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("prevalence"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return cumulated(df, y, p).select(F.col(p).alias("threshold"), try_ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), try_ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))


def bhs_grade(a5: Column, a10: Column, a15: Column) -> Column:
    """Grade from the shares (percent) of errors within 5, 10 and 15; null shares give N/A."""
    ok = lambda a, b, c: (a5 >= a) & (a10 >= b) & (a15 >= c)
    return F.when(a5.isNull(), "N/A").when(ok(60, 85, 95), "A").when(ok(50, 75, 90), "B").when(ok(40, 65, 85), "C").otherwise("D")


def ieee_grade(mae: Column) -> Column:
    return F.when(mae.isNull(), "N/A").when(mae <= 5, "A").when(mae <= 6, "B").when(mae <= 7, "C").otherwise("D")


def aami_pass(me: Column, sd: Column) -> Column:
    return F.coalesce((F.abs(me) <= 5) & (sd <= 8), F.lit(False))


def standards(df: DataFrame, err: str, by: list[str]) -> DataFrame:
    """BHS, IEEE 1708 and AAMI grades of an error column by group."""
    e = F.col(err)
    share = lambda k: F.avg((F.abs(e) <= k).cast("double")) * 100
    rows = df.groupBy(*by).agg(*errors(by, e), share(5).alias("within5"), share(10).alias("within10"), share(15).alias("within15"))
    return rows.withColumns({"bhs": bhs_grade(F.col("within5"), F.col("within10"), F.col("within15")), "ieee": ieee_grade(F.col("mae")), "aami": aami_pass(F.col("me"), F.col("sde"))})


def iso_limit(me: Column) -> Column:
    """Interpolated limit for a mean error; 0 beyond the last point."""
    m = F.abs(me)
    out = F.lit(0.0)
    for (x0, y0), (x1, y1) in reversed(list(zip(ISO_LIMITS, ISO_LIMITS[1:], strict=False))):
        out = F.when((m >= x0) & (m <= x1), F.lit(y0) + (m - x0) / F.lit(x1 - x0) * F.lit(y1 - y0)).otherwise(out)
    return out


def iso_81060(df: DataFrame, err: str, person: str, by: list[str]) -> DataFrame:
    """Both criteria: the errors' mean and spread, and the spread of the persons' mean errors against the limit."""
    own = df.groupBy(*by, person).agg(F.avg(err).alias("m"), F.sum(err).alias("s"), F.sum(F.col(err) * F.col(err)).alias("q"), F.count(err).alias("c"))
    rows = own.groupBy(*by).agg(F.count("*").alias("n_persons"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.stddev_samp("m").alias("sd_persons"))
    me = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.when(F.col("n") > 1, F.col("n") - 1))
    rows = rows.withColumns({"me": me, "sd": sd}).withColumn("limit", iso_limit(F.col("me")))
    second = F.coalesce((F.col("n_persons") > 1) & (F.col("sd_persons") <= F.col("limit")), F.lit(False))
    return rows.select(*by, "n", "n_persons", "me", "sd", "sd_persons", "limit", aami_pass(F.col("me"), F.col("sd")).alias("criterion1"), second.alias("criterion2"))


def bland_altman(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    d = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd")).withColumns({"low": F.col("bias") - 1.96 * F.col("sd"), "high": F.col("bias") + 1.96 * F.col("sd")})


def threshold_at_fpr(df: DataFrame, y: str, p: str, fpr: float, by: list[str]) -> DataFrame:
    """Quantile 1 - fpr of the scores of negatives, and the sensitivity and specificity at it."""
    cut = ranges.quantiles(df.where(F.col(y) == 0), by, p, [1 - fpr]).select(*by, F.col("q")[0].alias("threshold"))
    rows = df.join(cut, by)
    hit = (F.col(p) >= F.col("threshold")).cast("double")
    return rows.groupBy(*by, "threshold").agg(F.avg(F.when(F.col(y) == 1, hit)).alias("sens"), F.avg(F.when(F.col(y) == 0, 1 - hit)).alias("spec"))
