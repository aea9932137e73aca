"""Ranges of a number column with cut points that are fixed before use, and exact quantiles by counts of ranges."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, col: str, name: str = "range", parts: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the number of the range of `col` (about equal rows of df in each; equal values share one).

    The cut points are numbers on the driver, so a row's range depends on its value alone and stays the same when a lost
    task runs again.
    """
    from pyspark.ml.feature import Bucketizer

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = []
    if parts > 1:
        found = df.select(F.col(col).cast("double").alias("x")).where("x is not null and not isnan(x)").approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)
        cuts = sorted({c for c in found if math.isfinite(c)})
    if not cuts:
        return lambda rows: rows.withColumn(name, F.lit(0))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=f"{name}__x", outputCol=f"{name}__r", handleInvalid="keep")

    def add(rows: DataFrame) -> DataFrame:
        rows = cutter.transform(rows.withColumn(f"{name}__x", F.col(col).cast("double")))
        return rows.withColumn(name, F.col(f"{name}__r").cast("int")).drop(f"{name}__x", f"{name}__r")

    return add


def ranged_by(df: DataFrame, by: list[str], col: str, name: str = "range", parts: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Like ranged(), with cut points of each group: only groups of more than a part of all rows are cut, the others are range 0.

    At most `parts` groups are that large, and they have at most 2 * parts cut points together, so these are numbers on the
    driver and a small broadcast. Groups whose key is null aren't cut.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*by, F.col(col).cast("double").alias("x")).where("x is not null and not isnan(x)")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    part = F.greatest(F.sum("__n") / F.lit(float(parts)), F.lit(1.0)).alias("__part")
    hot = sizes.crossJoin(F.broadcast(sizes.agg(part))).where("__n > __part").select(*by, F.ceil(F.col("__n") / F.col("__part")).cast("int").alias("__k")).collect() if parts > 1 else []
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    cuts = []
    if hot:
        pieces = spark.createDataFrame(hot, f"{schema}, __k int")
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = rows.join(F.broadcast(pieces), by).groupBy(*by).agg(F.first("__k").alias("__k"), F.percentile_approx("x", shares, 20 * parts).alias("__q"))
        step = lambda i: F.greatest(F.floor(i * F.lit(parts) / F.col("__k")).cast("int"), F.lit(1))
        told = F.transform(F.sequence(F.lit(1), F.col("__k") - 1), lambda i: F.element_at("__q", F.least(step(i), F.lit(parts - 1))))
        cuts = found.where("__k > 1").select(*by, F.array_sort(F.array_distinct(told)).alias("__cuts")).collect()
    if not cuts:
        return lambda frame: frame.withColumn(name, F.lit(0))
    fixed = spark.createDataFrame(cuts, f"{schema}, __cuts array<double>")

    def add(frame: DataFrame) -> DataFrame:
        x = F.col(col).cast("double")
        upto = lambda those: F.size(F.filter(those, lambda c: c <= x))
        every = F.filter("__cuts", lambda c, i: i % 32 == 0)  # each 32nd cut point, then those behind the last of them
        frame = frame.join(F.broadcast(fixed), by, "left").withColumn("__i", F.when(F.col("__cuts").isNotNull(), upto(every)).otherwise(0))
        inside = F.when(F.col("__i") > 0, (F.col("__i") - 1) * 32 + upto(F.slice("__cuts", (F.col("__i") - 1) * 32 + 1, F.lit(32)))).otherwise(0)
        return frame.withColumn(name, inside.cast("int")).drop("__cuts", "__i")

    return add


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """by, n and q (array of the interpolated quantiles qs of value), exact, without a group meeting in one task.

    Values are counted by group and value; the counts of ranges tell in which range an order statistic lies, and only that
    range's values are put in order. Nulls and NaN take no part; groups without a value give no row.
    """
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    counts = (ranged_by(counts, by, "__v", "__r") if by else ranged(counts, "__v", "__r"))(counts)
    sums = counts.groupBy(*by, "__r").agg(F.sum("__c").alias("__s"))
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.withColumns({"__n": F.sum("__s").over(key), "__b": F.sum("__s").over(key.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))}).withColumn("__b", F.coalesce("__b", F.lit(0)))
    at = [(i, side) for i in range(len(qs)) for side in (0, 1)]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.least(F.floor(F.lit(qs[i]) * (F.col("__n") - 1)) + side, F.col("__n") - 1).alias("k")) for i, side in at])
    asked = sums.select(*by, "__r", "__n", "__b", "__s", F.explode(places).alias("p")).where("p.k >= __b and p.k < __b + __s")
    wanted = asked.groupBy(*by, "__r").agg(F.first("__n").alias("__n"), F.first("__b").alias("__b"), F.collect_list("p").alias("__p"))  # at most two for each quantile
    inside = Window.partitionBy(*by, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(wanted, [*by, "__r"]).withColumn("__e", F.sum("__c").over(inside) + F.col("__b"))
    picked = rows.select(*by, "__v", "__n", F.explode(F.filter("__p", lambda p: (p["k"] < F.col("__e")) & (p["k"] >= F.col("__e") - F.col("__c")))).alias("p"))
    told = [F.max(F.when((F.col("p.i") == i) & (F.col("p.side") == side), F.col("__v"))) for i, side in at]
    out = picked.groupBy(*by).agg(F.first("__n").alias("n"), F.array(*told).alias("v"))
    part = lambda i: F.lit(qs[i]) * (F.col("n") - 1) - F.floor(F.lit(qs[i]) * (F.col("n") - 1))
    return out.select(*by, "n", F.array(*[F.col("v")[2 * i] + (F.col("v")[2 * i + 1] - F.col("v")[2 * i]) * part(i) for i in range(len(qs))]).alias("q"))
