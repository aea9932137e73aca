"""Readers and writers: recording text files, reading tables, feature tables, and names of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseforge.sources import text_scan
from pulseforge.sources.text_scan import CHANNELS, HEADER_LINES


def person_key(subject: Column) -> Column:
    """Person of a subject id: one suffix _full or _cut and then one _session<n> are stripped."""
    return F.regexp_replace(F.regexp_replace(subject, "(_full|_cut)$", ""), "_session\\d+$", "")


def person_by_map(df: DataFrame, people: DataFrame, subject: str = "subject") -> DataFrame:
    """Person by a table (subject, person); a subject without one raises."""
    rows = df.join(people.select(subject, "person"), subject, "left")
    return rows.withColumn("person", F.when(F.col("person").isNull(), F.raise_error(F.concat(F.lit("no person for "), F.col(subject).cast("string")))).otherwise(F.col("person")))


def read_recordings(spark: SparkSession, path: str, channels: list[str] | None = None, start: float = 0.0, duration: float | None = None, delay: float = 0.0, index: list[dict] | None = None) -> DataFrame:
    """Samples of recording text files: file, sample_idx, fs and the wanted channels.

    Fourteen header lines are skipped; the sample rate comes from `<x> ms` in them, else 10 kHz; numbers that can't be
    read and NaN become 0, lines without a comma give no row; `delay` seconds are dropped first, then the slice from
    `start` is taken. Files are read by blocks of bytes, and only those blocks that the slice needs. `index` is what
    text_scan.line_index() gave for the path; without it, it is made by one pass that counts line ends.
    """
    index = text_scan.line_index(spark, path) if index is None else index
    return text_scan.samples(spark, index, channels or CHANNELS[1:], start, duration, delay)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Reference readings: subject (folder name), t (seconds of the interval's middle), SBP, DBP."""
    schema = "Time_start_min double, Time_end_min double, SBP double, DBP double"
    rows = spark.read.schema(schema).option("header", True).csv(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    return rows.select(folder.alias("subject"), ((F.col("Time_start_min") + F.col("Time_end_min")) / 2 * 60).alias("t"), "SBP", "DBP")


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """file and n_rows of recording text files: lines less the header, counted without parsing a value."""
    rows = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return rows.select("file", F.greatest(F.col("n") - HEADER_LINES, F.lit(0)).alias("n_rows"))


def shifted(df: DataFrame, skip: Column, rec: str = "rec", idx: str = "sample_idx") -> DataFrame:
    """Samples from the skip-th one on (a column of df), counted from 0 again."""
    return df.withColumn(idx, F.col(idx) - skip).where(F.col(idx) >= 0)


def aligned_pair(left: DataFrame, right: DataFrame, rec: str = "rec", offsets: DataFrame | None = None, fs: float | None = None) -> DataFrame:
    """Samples of two channels at the same index; a longer one is cut.

    offsets (rec, left_delay, right_delay, lead_in, in seconds) takes each channel's own delay and the common lead-in off
    first, a row for each recording.
    """
    if offsets is None:
        return left.join(right, [rec, "sample_idx"])

    def own(df, delay):
        skip = F.rint((F.col(delay)) * fs).cast("long") + F.rint(F.col("lead_in") * fs).cast("long")
        return shifted(df.join(offsets.select(rec, delay, "lead_in"), rec), skip, rec).drop(delay, "lead_in")

    return own(left, "left_delay").join(own(right, "right_delay"), [rec, "sample_idx"])


def write_features(df: DataFrame, path: str, settings: list[str], rec: str = "recording") -> None:
    """Feature table as Parquet by recording; tables of mixed settings (window length, stride, rate) are refused."""
    kinds = df.select(*settings).distinct().limit(2).count()
    if kinds > 1:
        raise ValueError(f"rows differ in {settings}")
    df.write.partitionBy(rec).mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, names: list[str], usable: bool = False, labels: list[str] | None = None) -> DataFrame:
    """Feature table (Parquet, or CSV by its name) that holds the features `names` in this order, and the label columns.

    A missing column or another order raises; usable keeps usable rows only (a filter that reaches the scan).
    """
    df = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    missing = [n for n in [*names, *(labels or [])] if n not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    stored = [c for c in df.columns if c in set(names)]
    if stored != list(names):
        raise ValueError(f"the features stand in another order: {stored}")
    return df.where("usable") if usable else df


SETTINGS = ["window_sec", "stride_sec", "analysis_fs", "label_mode"]


def write_ecg_features(df: DataFrame, path: str, rec: str = "recording") -> None:
    """Window table of the 19 ECG features with n_beats and lf_reliable."""
    from pulseforge.operators.recordings import ECG_FEATURES

    _write_family(df, path, ["n_beats", "lf_reliable"], ECG_FEATURES, rec)


def write_nerve_features(df: DataFrame, path: str, rec: str = "recording") -> None:
    """Window table of the 11 features of the nerve channel; an empty one is refused."""
    from pulseforge.operators.recordings import NERVE_FEATURES

    if df.isEmpty():
        raise ValueError("there is nothing to write")
    _write_family(df, path, [], NERVE_FEATURES, rec)


def _write_family(df: DataFrame, path: str, extra: list[str], names: list[str], rec: str) -> None:
    missing = [c for c in [*extra, *names, *SETTINGS] if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    rest = [c for c in df.columns if c not in {*extra, *names}]
    write_features(df.select(*rest, *extra, *names), path, SETTINGS, rec)


def pack_csv(spark: SparkSession, path: str, to: str, names: list[str], analysis_fs: float, label_mode: str, usable: bool = False) -> None:
    """A CSV feature table as Parquet, with the window and stride that its own times tell."""
    df = read_features(spark, path, names, usable)
    told = window_settings(df).first()
    df = df.withColumns({"window_sec": F.lit(told.window_sec), "stride_sec": F.lit(told.stride_sec), "analysis_fs": F.lit(analysis_fs), "label_mode": F.lit(label_mode)})
    write_features(df, to, SETTINGS)


def window_settings(df: DataFrame) -> DataFrame:
    """Window length and stride that the times of a feature table tell."""
    from pyspark.sql import Window

    w = Window.partitionBy("recording").orderBy("t_start")
    step = F.col("t_start") - F.lag("t_start").over(w)
    return df.withColumn("__d", step).agg((2 * F.percentile(F.col("t_center") - F.col("t_start"), 0.5)).alias("window_sec"), F.percentile(F.when(F.col("__d") > 0, F.col("__d")), 0.5).alias("stride_sec"))


def append_history(df: DataFrame, path: str) -> None:
    """Add the rows of a run to a table of runs."""
    df.write.mode("append").parquet(path)
