"""Adapters that present event and order tables as recordings, readings and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a timestamp without zone, independent of the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    second = (F.expr(f"extract(second from {ts})") * 1_000_000).cast("long")
    return day + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: rec, person, ch, t (seconds from the recording's start), x (centred value), idx."""
    us = micros("ts")
    rec = Window.partitionBy("user_id")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return rows.select(
        F.col("user_id").alias("rec"),
        (F.col("user_id") % 30).alias("person"),
        F.col("event_type").alias("ch"),
        "event_id",
        ((us - F.min(us).over(rec)) / F.lit(1e6)).alias("t"),
        (F.col("value") - F.lit(50.0)).alias("x"),
        (F.row_number().over(rec.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"),
    )


def intervals(sig: DataFrame) -> DataFrame:
    """Gaps between consecutive samples of a recording: rec, person, idx, t, nn (seconds)."""
    w = Window.partitionBy("rec").orderBy("idx")
    return sig.withColumn("nn", F.col("t") - F.lag("t").over(w)).where("nn is not null")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as readings of persons: person, t (days), y, recording, key."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    return rows.select(
        F.col("l_suppkey").alias("person"),
        (micros("l_shipdate") / F.lit(86_400_000_000.0)).alias("t"),
        F.col("l_quantity").cast("double").alias("y"),
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary target with a score: doc_id, y, p."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return labels.join(docs, "doc_id").select("doc_id", F.col("y").cast("long").alias("y"), F.col("n_chars").cast("double").alias("p"))
