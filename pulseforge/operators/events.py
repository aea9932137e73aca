"""Event timing and null controls: first runs, episodes, trajectories, offset scans and sham onsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseforge.functions.stats import safe_corr


def run_length(df: DataFrame, flag: str, by: list[str], t: str) -> DataFrame:
    """run: how many rows in a row, this one included, have the flag (0 without it); a null flag ends a run."""
    w = Window.partitionBy(*by).orderBy(t)
    off = (~F.coalesce(F.col(flag), F.lit(False))).cast("int")
    rows = df.withColumn("__g", F.sum(off).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "__g").orderBy(t)
    on = F.coalesce(F.col(flag), F.lit(False)).cast("int")
    return rows.withColumn("run", F.when(on == 1, F.sum(on).over(inside.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)).drop("__g")


def first_run(df: DataFrame, flag: str, by: list[str], t: str, n: int) -> DataFrame:
    """by, at: when the first run of n flags is full; null if there is none."""
    return run_length(df, flag, by, t).groupBy(*by).agg(F.min(F.when(F.col("run") >= n, F.col(t))).alias("at"))


def episodes(df: DataFrame, persist: int, half: float, length: float = 60.0, by: tuple = ("recording", "cycle"), t: str = "t_rel", p: str = "p", thr: str = "thr") -> DataFrame:
    """One row for each episode of at least `persist` rows during the event: onset and offset latency, greatest and mean score."""
    by = list(by)
    during, after = (F.col(t) >= 0) & (F.col(t) < length), F.col(t) >= length
    rows = df.withColumns({"__on": during & (F.col(p) >= F.col(thr)), "__off": after & (F.col(p) < F.col(thr))})
    on = first_run(rows.where(during), "__on", by, t, persist).withColumnRenamed("at", "__a")
    off = first_run(rows.where(after), "__off", by, t, persist).withColumnRenamed("at", "__b")
    own = rows.groupBy(*by).agg(
        F.count(F.when(during, 1)).alias("n_during"), F.max(F.when(during, F.col(p))).alias("p_max_during"), F.avg(F.when(during, F.col(p))).alias("p_mean_during"), F.avg(F.when(F.col(t) < 0, F.col(p))).alias("p_mean_before")
    ).where(F.col("n_during") >= persist)
    out = own.join(on, by, "left").join(off, by, "left")
    return out.select(*by, "n_during", (F.col("__a") + half).alias("onset_latency"), (F.col("__b") + half - length).alias("offset_latency"), "p_max_during", "p_mean_during", "p_mean_before")


def trajectory(df: DataFrame, person: str = "person", t: str = "t_rel", p: str = "p") -> DataFrame:
    """Mean over persons of their own means by time, with the standard error and the number of persons."""
    own = df.groupBy(person, t).agg(F.avg(p).alias("m"))
    return own.groupBy(t).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("n"))


def cumulative_detection(df: DataFrame, latency: str, grid: list[float]) -> DataFrame:
    """Percent of episodes detected by each time of the grid; episodes never detected count as not detected.

    All grid times are conditional aggregates of one pass.
    """
    one = df.agg(*[(F.avg(F.coalesce((F.col(latency) <= x).cast("double"), F.lit(0.0))) * 100).alias(f"g{i}") for i, x in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"g{i}").alias("percent")) for i, x in enumerate(grid)])).alias("r")).select("r.*")


def box(t, shift, cycle: float, start: float, end: float):
    """Whether t, moved back by shift, is in the event's part of the cycle."""
    pos = F.pmod(t - shift, F.lit(cycle))
    return ((pos >= start) & (pos < end)).cast("double")


def offset_scan(df: DataFrame, by: list[str], shifts: list[float], t: str = "t", p: str = "p", cycle: float = 600.0, start: float = 270.0, end: float = 330.0, least: int = 40) -> DataFrame:
    """Best shift by point-biserial correlation with the shifted template; the first of equals, and none for few rows.

    The correlations of all shifts are aggregates of one pass over the rows.
    """
    aggs = [safe_corr(F.col(p), box(F.col(t), F.lit(float(s)), cycle, start, end)).alias(f"r{i}") for i, s in enumerate(shifts)]
    own = df.groupBy(*by).agg(F.count(p).alias("n"), *aggs).where(F.col("n") >= least)
    cells = F.filter(F.array(*[F.struct(F.round(F.col(f"r{i}"), 6).alias("r"), F.lit(-float(s)).alias("back")) for i, s in enumerate(shifts)]), lambda x: x["r"].isNotNull())
    best = own.withColumn("best", F.array_max(cells))
    return best.select(*by, "n", F.when(F.col("best").isNotNull(), -F.col("best.back") + 0.0).alias("shift"), F.col("best.r").alias("r"))


def sham_mask(df: DataFrame, onsets: list[float], pos: str = "cycle_min", width: float = 1.0, start: float = 4.5, end: float = 5.5, guard: float = 0.5) -> DataFrame:
    """A row for each sham onset and each row outside the guarded event, with y: whether it is in the sham's time."""
    rows = df.where(~((F.col(pos) >= start - guard) & (F.col(pos) < end + guard)))
    rows = rows.withColumn("onset", F.explode(F.array(*[F.lit(float(o)) for o in onsets])))
    return rows.withColumn("y", ((F.col(pos) >= F.col("onset")) & (F.col(pos) < F.col("onset") + width)).cast("int"))
