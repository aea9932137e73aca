"""As-of labels: interpolated or nearest readings at given times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, readings: DataFrame, rec: str = "rec", t: str = "t", value: str = "y", mode: str = "interp", reach: float = 10.0) -> DataFrame:
    """Value of the readings at each probe's time, and whether it is valid.

    interp: linear between the neighbours, the end value outside; nearest: the nearer neighbour, the left one if both are
    as near. Valid if the nearer neighbour is within `reach`; otherwise the value is null. Both tables are put into one
    ordered window, so there is one shuffle by recording and no pair of rows is compared.
    """
    marks = readings.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(rec, t, F.col(value).alias("__y"), F.lit(0).alias("__probe"))
    asked = probes.withColumn("__probe", F.lit(1))
    rows = asked.unionByName(marks, allowMissingColumns=True)
    here = F.when(F.col("__probe") == 0, F.struct(F.col(t).alias("t"), F.col("__y").alias("y")))
    left = Window.partitionBy(rec).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(rec).orderBy(t).rangeBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__h", here).withColumns({"__l": F.last("__h", ignorenulls=True).over(left), "__r": F.first("__h", ignorenulls=True).over(right)}).where("__probe = 1")
    gap_l, gap_r = F.col(t) - F.col("__l.t"), F.col("__r.t") - F.col(t)
    width = F.col("__r.t") - F.col("__l.t")
    if mode == "interp":
        found = F.when(F.col("__l").isNull(), F.col("__r.y")).when(F.col("__r").isNull() | (width == 0), F.col("__l.y")).otherwise(F.col("__l.y") + (F.col("__r.y") - F.col("__l.y")) * gap_l / F.when(width > 0, width))
    elif mode == "nearest":
        found = F.when(F.col("__l").isNull(), F.col("__r.y")).when(F.col("__r").isNull() | (gap_l <= gap_r), F.col("__l.y")).otherwise(F.col("__r.y"))
    else:
        raise ValueError(f"no such mode: {mode}")
    near = F.least(gap_l, gap_r)
    valid = F.coalesce(near <= reach, F.lit(False))
    return rows.withColumns({"valid": valid, value: F.when(valid, found)}).drop("__probe", "__y", "__h", "__l", "__r")


def usable(df: DataFrame, cols: list[str], valid: str = "valid", least: dict[str, int] | None = None) -> DataFrame:
    """usable: valid, all columns finite, and counts at their least."""
    ok = F.col(valid) & F.forall(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    for c, n in (least or {}).items():
        ok = ok & (F.col(c) >= n)
    return df.withColumn("usable", F.coalesce(ok, F.lit(False)))
