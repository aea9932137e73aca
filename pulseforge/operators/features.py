"""Feature engineering over windows of recordings: joins, imputation, normalisation, temporal features, pruning.

Every function takes and returns a DataFrame; rows of a recording are ordered by `order`, and null stands for a missing
value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.functions import ranges
from pulseforge.functions.expanding import expanding_scaled
from pulseforge.functions.pairs import correlations
from pulseforge.functions.stats import finite, quantile, safe_corr
from pulseforge.functions.steps import cut

FIRST_ROWS, LEAST_ROWS = 10, 4


def _all(rec):
    return Window.partitionBy(rec)


def merge_families(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on the key; columns of right that left has too are dropped."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in key]), key)


def protocol_phase(df: DataFrame, t: str = "t", cycle: float = 600.0, start: float = 270.0, end: float = 330.0) -> DataFrame:
    """cycle position, phase (Before, During, After; half-open) and is_cpt."""
    pos = F.pmod(F.col(t), F.lit(cycle))
    phase = F.when(pos < start, "Before").when(pos < end, "During").otherwise("After")
    return df.withColumns({"cycle_pos": pos, "phase": phase, "is_cpt": ((pos >= start) & (pos < end)).cast("int")})


def drop_losers(df: DataFrame, rec: str, keep: str | int, lose: str | int) -> DataFrame:
    """Drop recording `lose`, but only if `keep` is there too."""
    losers = df.where(F.col(rec) == F.lit(keep)).select(F.lit(lose).alias(rec)).limit(1)
    return df.join(F.broadcast(losers), rec, "left_anti")  # one row at most


def log_shift(df: DataFrame, cols: list[str]) -> DataFrame:
    """log1p of each column, shifted where its least value over all rows is -1 or less."""
    low = df.agg(*[F.min(c).alias(f"__{c}") for c in cols])
    shifted = df.join(F.broadcast(low))  # one row
    done = {c: F.log1p(F.col(c) + F.when(F.col(f"__{c}") <= -1, -F.col(f"__{c}") + F.lit(1e-6)).otherwise(0.0)) for c in cols}
    return shifted.withColumns(done).drop(*[f"__{c}" for c in cols])


def impute_median(df: DataFrame, cols: list[str], rec: str) -> DataFrame:
    """NaN and infinities become null; nulls get the recording's median, then that of all rows.

    The rows are written once, as several passes follow. Medians are taken of columns that lack a value only, and that of all rows where a recording lacks all.
    """
    clean = cut(df.withColumns({c: finite(F.col(c)) for c in cols}), "impute")
    counts = [x for i, c in enumerate(cols) for x in (F.count(c).alias(f"a{i}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"b{i}"))]
    told = clean.groupBy(rec).agg(*counts).agg(*[x for i in range(len(cols)) for x in (F.min(f"a{i}").alias(f"a{i}"), F.max(f"b{i}").alias(f"b{i}"))]).first()
    lacking, empty = [c for i, c in enumerate(cols) if told[f"b{i}"]], [c for i, c in enumerate(cols) if told[f"b{i}"] and not told[f"a{i}"]]
    w = _all(rec)
    if empty:
        medians = ranges.quantiles(long_form(clean, empty, []), ["feature"], "value", [0.5])
        clean = clean.join(F.broadcast(medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"__{c}") for c in empty])))  # one row
    return clean.withColumns({c: F.coalesce(F.col(c), quantile(c, 0.5, w), *[F.col(f"__{c}")] * (c in empty)) for c in lacking}).drop(*[f"__{c}" for c in empty])


def winsorise(df: DataFrame, cols: list[str], rec: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the recording's quantiles; one percentile call gives both."""
    w = _all(rec)
    out = df.withColumns({f"__{c}": quantile(c, F.array(F.lit(low), F.lit(high)), w) for c in cols})
    return out.withColumns({c: F.least(F.greatest(F.col(c), F.col(f"__{c}")[0]), F.col(f"__{c}")[1]) for c in cols}).drop(*[f"__{c}" for c in cols])


def normalise(df: DataFrame, cols: list[str], rec: str, order: list[str], method: str = "expanding", t: str = "t", baseline_end: float = 270.0, keep_raw: bool = False, strict: bool = False) -> DataFrame:
    """Within-recording normalisation: expanding, robust, baseline, zscore or none.

    expanding uses the median and the interquartile range of the rows before; the first row's centre is the median of
    the first ten rows, and the first scales are filled from later ones (strict=True leaves both null). Where there is no
    scale the recording's standard deviation stands in, else the result is 0.
    """
    every = _all(rec)
    name = (lambda c: f"{c}_n") if keep_raw else (lambda c: c)
    if method == "none":
        return df.withColumns({name(c): F.col(c) for c in cols})
    if method == "zscore":
        spread = lambda c: F.stddev_samp(c).over(every)
        return df.withColumns({name(c): F.coalesce((F.col(c) - F.avg(c).over(every)) / F.when(spread(c) > 0, spread(c)), F.when(F.col(c).isNotNull(), 0.0)) for c in cols})
    if method in ("robust", "baseline"):
        out = df.withColumns({f"__q{c}": quantile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), every) for c in cols})
        if method == "baseline":
            early = {c: F.coalesce(quantile(F.when(F.col(t) < baseline_end, F.col(c)), 0.5, every), F.col(f"__q{c}")[1]) for c in cols}
        else:
            early = {c: F.col(f"__q{c}")[1] for c in cols}
        out = out.withColumns({f"__c{c}": early[c] for c in cols}).withColumns({f"__s{c}": F.col(f"__q{c}")[2] - F.col(f"__q{c}")[0] for c in cols})
    elif method == "expanding":
        return expanding_scaled(df, cols, rec, order, {c: name(c) for c in cols}, FIRST_ROWS, LEAST_ROWS, strict)
    else:
        raise ValueError(f"no such method: {method}")
    spread = {c: F.stddev_samp(c).over(every) for c in cols}
    off = {c: F.col(c) - F.col(f"__c{c}") for c in cols}
    scaled = {c: F.coalesce(off[c] / F.when(F.col(f"__s{c}") != 0, F.col(f"__s{c}")), off[c] / F.when(spread[c] > 0, spread[c]), F.when(F.col(c).isNotNull(), 0.0)) for c in cols}
    return out.withColumns({f"__o{c}": scaled[c] for c in cols}).withColumns({name(c): F.col(f"__o{c}") for c in cols}).drop(*[f"__{p}{c}" for c in cols for p in "qcso"])


def temporal(df: DataFrame, cols: list[str], rec: str, order: list[str], k: int = 3, causal: bool = True) -> DataFrame:
    """First difference, rolling mean, standard deviation and slope of each column over k + 1 rows (or 2k + 1 centred ones).

    The slope divides by the spread of a whole window also where the window is cut off.
    """
    w = Window.partitionBy(rec).orderBy(*order)
    frame = w.rowsBetween(-k, 0 if causal else k)
    n = k + 1 if causal else 2 * k + 1
    spread = n * (n * n - 1) / 12.0
    number = F.row_number().over(w).cast("double")
    out = df.withColumn("__i", number)
    new = {}
    for c in cols:
        x = F.col(c)
        new[f"{c}_d1"] = F.coalesce(x - F.lag(c).over(w), F.lit(0.0))
        new[f"{c}_rm{k}"] = F.avg(c).over(frame)
        new[f"{c}_rs{k}"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        new[f"{c}_slope"] = F.coalesce(F.regr_sxy(x, F.col("__i")).over(frame) / spread, F.lit(0.0))
    return out.withColumns(new).drop("__i")


def prune(df: DataFrame, cols: list[str], least_var: float = 1e-8, most_corr: float = 0.95) -> list[str]:
    """Columns that stay, in descending order of variance: those that vary, less those correlated with one kept before.

    One pass over the rows gives variances and correlations; only these numbers come to the driver.
    """
    var, r = correlations(df, cols)
    order = sorted((i for i in range(len(cols)) if var[i] > least_var), key=lambda i: (-var[i], i))
    stay: list[int] = []
    for i in order:
        if not any(abs(r[i, j]) > most_corr for j in stay):  # NaN is no correlation
            stay.append(i)
    return [cols[i] for i in stay]


def long_form(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value: a row for each column."""
    return df.unpivot(keys, cols, "feature", "value")


def feature_stats(df: DataFrame, cols: list[str], target: str, person: str, information: bool = False) -> DataFrame:
    """For each column: share of finite values, median, 5th and 95th percentile, pooled correlation with the target, and the median of the correlations within persons (of more than four rows).

    information=True adds mi, the mutual information with the target; values that aren't finite count as the column's median there.
    """
    rows = long_form(df, cols, [person, target]).withColumn("value", finite(F.col("value")))
    pooled = rows.groupBy("feature").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("finite_share"), safe_corr(F.col("value"), F.col(target)).alias("r_pooled"))
    pooled = pooled.join(ranges.quantiles(rows, ["feature"], "value", [0.5, 0.05, 0.95]).select("feature", "q"), "feature", "left")
    own = rows.groupBy("feature", person).agg(safe_corr(F.col("value"), F.col(target)).alias("r"), F.count("value").alias("n")).where("n > 4")
    within = own.groupBy("feature").agg(quantile("r", 0.5).alias("r_within"))
    out = pooled.join(within, "feature", "left").select("feature", "finite_share", F.col("q")[0].alias("median"), F.col("q")[1].alias("p5"), F.col("q")[2].alias("p95"), "r_pooled", "r_within")
    if not information:
        return out
    from pulseforge.operators import information as mutual

    middle = {r["feature"]: r["median"] for r in out.select("feature", "median").collect()}  # a number for each column
    filled = df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(middle.get(c))) for c in cols})
    return out.join(F.broadcast(mutual.information(filled, cols, target).drop("fold")), "feature", "left")


#: What features may be ranked by (columns of feature_stats).
RANKINGS = ["r_pooled", "r_within", "mi", "finite_share", "median", "p5", "p95"]


def top_features(stats: DataFrame, key: str = "r_pooled", k: int = 5) -> DataFrame:
    """The k features of the greatest magnitude of `key`, nulls and NaN last, ties in the order of names, with rank."""
    if key not in RANKINGS:
        raise ValueError(f"no such ranking: {key}")
    size = finite(F.abs(F.col(key)))
    top = stats.withColumn("__s", size).orderBy(F.desc_nulls_last("__s"), "feature").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("__s"), "feature"))).drop("__s")  # k rows


def drop_recordings(df: DataFrame, rec: str, tokens: list[str]) -> DataFrame:
    """Drop recordings whose name equals or holds a token; a token that matches none raises."""
    name = F.col(rec).cast("string")
    found = df.agg(*[F.coalesce(F.max((name.contains(t)).cast("int")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(tokens)]).first()
    missing = [t for i, t in enumerate(tokens) if not found[i]]
    if missing:
        raise ValueError(f"no recording matches {missing}")
    keep = F.lit(True)
    for t in tokens:
        keep = keep & ~name.contains(t)
    return df.where(keep)


def runs(df: DataFrame, flag: str, rec: str, order: str) -> DataFrame:
    """Islands of consecutive rows with the same flag: rec, run, flag, first, last, n."""
    w = Window.partitionBy(rec).orderBy(order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    rows = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(rec, "run").agg(F.first(flag).alias(flag), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def envelope(df: DataFrame, rec: str, idx: str, x: str, bins: int) -> DataFrame:
    """Least and greatest sample of each of `bins` equal bins in the order of time; the rest of the recording is left out."""
    size = F.floor(F.count("*").over(_all(rec)) / bins)
    rows = df.withColumn("__s", size).where("__s > 0").withColumn("bin", F.floor(F.col(idx) / F.col("__s"))).where(F.col("bin") < bins)
    ends = rows.groupBy(rec, "bin").agg(F.min_by(F.struct(idx, x), F.struct(x, idx)).alias("lo"), F.max_by(F.struct(idx, x), F.struct(F.col(x), -F.col(idx))).alias("hi"))
    return ends.select(rec, "bin", F.explode(F.array_sort(F.array("lo", "hi"))).alias("p")).select(rec, "bin", f"p.{idx}", f"p.{x}")


def decimate(df: DataFrame, rec: str, idx: str, most: int) -> DataFrame:
    """Every n-th sample so that at most about `most` are left of each recording."""
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(_all(rec)) / most))
    return df.withColumn("__k", step).where(F.col(idx) % F.col("__k") == 0).drop("__k")
