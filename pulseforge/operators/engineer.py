"""The composed feature-engineering chain, its outputs and cache, and what is known of columns by their names."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pulseforge.functions.stats import finite
from pulseforge.functions.steps import cut
from pulseforge.operators import features as fx
from pulseforge.sources.recordings import person_key

# Columns that aren't features, and feature names with a treatment of their own.
META = ["Subject_ID", "Recording", "window_idx", "t_start_sec", "t_center_sec", "t_raw_center_sec", "person", "cycle_min", "phase", "is_cpt", "n_beats", "lf_reliable"]
TARGETS = ["SBP", "DBP"]
FLAGS = ["label_valid", "usable"]
UNRELIABLE = ["LF_power", "LF_HF_ratio"]
LOGGED = ["complexity", "kurtSKNA", "skewSKNA", "cfSKNA", "LF_HF_ratio", "LF_power", "HF_power", "varSKNA"]

# Families of base features, and sets of families that are compared.
FAMILIES = {
    "ECG_MORPH": ["TpTe", "QTc_Fridericia", "QRS_duration", "ST_level", "T_R_ratio", "R_slope", "beat_SNR"],
    "HRV": ["meanNN", "SDNN", "RMSSD", "HF_power", "LF_power", "LF_HF_ratio", "SD1_SD2", "HR", "SDNN_over_RMSSD"],
    "NONLIN": ["mobility", "complexity", "fractal_dimension", "entropy", "autocorrelation"],
    "SKNA": ["aSKNA", "rmsSKNA", "skewSKNA", "kurtSKNA", "wlSKNA", "zcSKNA", "sscSKNA", "cfSKNA", "dfSKNA", "varSKNA", "wampSKNA", "wamp_over_wl", "SKNA_crest"],
    "XSIG": ["aSKNA_per_beat", "aSKNA_x_HR", "aSKNA_over_RMSSD", "aSKNA_over_SDNN"],
}
FEATURE_SETS = {
    "FS1_ECG_MORPH": ["ECG_MORPH"],
    "FS2_HRV": ["HRV"],
    "FS3_NONLIN": ["NONLIN"],
    "FS4_SKNA": ["SKNA"],
    "FS5_ECG_ALL": ["ECG_MORPH", "HRV", "NONLIN"],
    "FS6_ECG+SKNA": ["ECG_MORPH", "HRV", "NONLIN", "SKNA"],
    "FS7_SKNA+XSIG": ["SKNA", "XSIG"],
    "FS8_ALL": ["ECG_MORPH", "HRV", "NONLIN", "SKNA", "XSIG"],
}

CYCLE, EVENT = 10.0, (4.5, 5.5)  # minutes
KEY = ["Subject_ID", "Recording", "window_idx"]


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither meta data nor targets nor flags."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in {*META, *TARGETS, *FLAGS}]


def base_of(column: str) -> tuple[str, str]:
    """Base feature of an engineered column (the longest name it begins with) and the suffix; an unknown column raises."""
    known = [b for names in FAMILIES.values() for b in names if column == b or column.startswith(f"{b}_")]
    if not known:
        raise KeyError(f"column {column!r} belongs to no family")
    base = max(known, key=len)
    return base, column[len(base) :]


def family_of(column: str) -> str:
    base = base_of(column)[0]
    return next(f for f, names in FAMILIES.items() if base in names)


def columns_of(columns: list[str], feature_set: str, levels_only: bool = False) -> list[str]:
    """Columns of a feature set; levels_only leaves the temporal ones out."""
    return [c for c in columns if family_of(c) in FEATURE_SETS[feature_set] and not (levels_only and base_of(c)[1])]


def describe(columns: DataFrame, name: str = "feature", seconds_per_window: float = 5.0) -> DataFrame:
    """columns with base, kind (level, d1, rm, rs, slope), rows (windows a rolling feature spans) and a description."""
    kind = F.regexp_extract(name, r"_(d1|rm|rs|slope)\d*$", 1)
    k = F.regexp_extract(name, r"_(?:rm|rs)(\d+)$", 1)
    known = F.array(*[F.lit(b) for names in FAMILIES.values() for b in names])
    # R_slope is a base of its own, not a slope of R
    kind = F.when((kind == "") | F.array_contains(known, F.col(name)), "level").otherwise(kind)
    base = F.when(kind == "level", F.col(name)).otherwise(F.regexp_replace(name, r"_(d1|rm\d+|rs\d+|slope)$", ""))
    rows = F.when(kind.isin("rm", "rs"), k.try_cast("int") + 1)
    span = F.concat(rows.cast("string"), F.lit(" windows ("), F.format_number(rows * F.lit(seconds_per_window), 0), F.lit(" s)"))
    text = (
        F.when(kind == "d1", F.concat(F.lit("change since the window before of "), base))
        .when(kind == "rm", F.concat(F.lit("mean over "), span, F.lit(" of "), base))
        .when(kind == "rs", F.concat(F.lit("deviation over "), span, F.lit(" of "), base))
        .when(kind == "slope", F.concat(F.lit("trend over the rolling span of "), base))
        .otherwise(F.concat(base, F.lit(", normalised within its recording")))
    )
    return columns.withColumns({"base": base, "kind": kind, "rows": rows, "description": text})


def protocol(df: DataFrame, t: str = "t_center_sec", subject: str = "Subject_ID") -> DataFrame:
    """person, cycle_min, phase and is_cpt."""
    out = df.withColumn("person", person_key(F.col(subject))) if "person" not in df.columns else df
    out = fx.protocol_phase(out.withColumn("__m", F.col(t) / 60.0), "__m", CYCLE, *EVENT)
    return out.withColumnRenamed("cycle_pos", "cycle_min").drop("__m")


def quality_filter(df: DataFrame, subject: str = "Subject_ID", twins: tuple[str, str] | None = None, drop: list[str] = UNRELIABLE) -> DataFrame:
    """Usable rows with valid labels; of twins (keep, lose) the second goes if the first is there; unreliable columns go."""
    out = df.where(F.col("usable") & F.col("label_valid"))
    if twins:
        out = fx.drop_losers(out, subject, *twins)
    return out.drop(*[c for c in drop if c in out.columns])


def interactions(df: DataFrame, feats: list[str]) -> tuple[DataFrame, list[str]]:
    """Ratios across signals, each if its columns are there; infinities become null. Needs meanNN and, for those by beat, n_beats."""
    have, tiny = set(feats), F.lit(1e-9)
    hr = F.lit(60000.0) / F.greatest(F.col("meanNN"), tiny)
    over = lambda a, b: F.col(a) / (F.col(b) + tiny)
    rules: list[tuple[str, set[str], Column]] = [
        ("HR", {"meanNN"}, hr),
        ("aSKNA_per_beat", {"aSKNA"}, F.col("aSKNA") / F.greatest(F.col("n_beats"), F.lit(1))) if "n_beats" in df.columns else ("", {""}, F.lit(0)),
        ("aSKNA_x_HR", {"aSKNA", "meanNN"}, F.col("aSKNA") * hr / 60.0),
        ("aSKNA_over_RMSSD", {"aSKNA", "RMSSD"}, over("aSKNA", "RMSSD")),
        ("aSKNA_over_SDNN", {"aSKNA", "SDNN"}, over("aSKNA", "SDNN")),
        ("wamp_over_wl", {"wampSKNA", "wlSKNA"}, over("wampSKNA", "wlSKNA")),
        ("SDNN_over_RMSSD", {"SDNN", "RMSSD"}, over("SDNN", "RMSSD")),
        ("SKNA_crest", {"rmsSKNA", "aSKNA"}, over("rmsSKNA", "aSKNA")),
    ]
    new = {name: finite(x) for name, needs, x in rules if needs <= have}
    return df.withColumns(new), list(new)


def engineer(
    ecg: DataFrame, skna: DataFrame, method: str = "expanding", k: int = 2, causal: bool = True, most_corr: float = 0.95, keep_raw: bool = False,
    pruned: bool = True, winsorise: tuple[float, float] | None = None, twins: tuple[str, str] | None = None, rec: str = "Recording", order: str = "window_idx",
) -> tuple[DataFrame, list[str], list[str]]:
    """Merge, phases, quality, logarithms, interactions, imputation, clipping, normalisation, temporal features, pruning.

    Returns the table, its feature columns and notes of each step. Interactions are made before the normalisation, so
    they are normalised too. Rows that several passes need are written once. Only variances and correlations (for pruning) come to the driver.
    """
    df = cut(quality_filter(protocol(fx.merge_families(ecg, skna, KEY)), twins=twins), "engineer")
    feats = feature_columns(df)
    logged = [c for c in LOGGED if c in feats]
    df = fx.log_shift(df, logged) if logged else df
    df, inter = interactions(df, feats)
    feats += inter
    notes = [f"logarithms of {logged}", f"interactions {inter}"]
    df = fx.impute_median(df.withColumns({c: F.col(c).cast("double") for c in feats}), feats, rec)
    if winsorise:
        df = fx.winsorise(df, feats, rec, *winsorise)
        notes.append(f"clipped to the quantiles {winsorise} of each recording")
    df = fx.normalise(df, feats, rec, [order], method, t="t_center_sec", keep_raw=keep_raw)
    level = [f"{c}_n" for c in feats] if keep_raw else feats
    df = fx.temporal(df, level, rec, [order], k, causal)
    cols = level + [f"{c}{s}" for c in level for s in ("_d1", f"_rm{k}", f"_rs{k}", "_slope")]
    notes += [f"normalised by {method}: {len(level)} columns", f"temporal features over {k}, causal={causal}"]
    if pruned:
        df = cut(df, "engineer")
        kept = fx.prune(df, cols, most_corr=most_corr)
        notes.append(f"pruned {len(cols) - len(kept)} of {len(cols)}")
        cols = [c for c in cols if c in set(kept)]
    return df, cols, [*notes, f"{len(cols)} features"]


def write_engineered(df: DataFrame, cols: list[str], notes: list[str], path: str, settings: dict) -> None:
    """path/table (Parquet: meta data, targets, features), path/matrix (Parquet: X as array<float> with targets, phase and groups) and path/report (text)."""
    meta = [c for c in META if c in df.columns]
    targets = [c for c in TARGETS if c in df.columns]
    df.select(*meta, *targets, *cols).write.mode("overwrite").parquet(f"{path}/table")
    x = F.array(*[F.col(c).cast("float") for c in cols]).alias("X")
    extra = [F.col(a).alias(b) for a, b in (("is_cpt", "y_cpt"), ("phase", "phase"), ("person", "groups"), ("Subject_ID", "subject"), ("Recording", "recording"), ("t_center_sec", "t_center_sec")) if a in df.columns]
    df.select(x, *[F.col(t).cast("float").alias(f"y_{t.lower()}") for t in targets], *extra).write.mode("overwrite").parquet(f"{path}/matrix")
    lines = [json.dumps(settings, sort_keys=True), *[f"[{i}] {n}" for i, n in enumerate(notes, 1)], "features:", *[f"  {c}" for c in cols]]
    df.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def cached(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table that build() makes, kept as Parquet under a hash of all its settings; force builds it again."""
    where = f"{path}/{hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:24]}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if force or not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def catalog(spark: SparkSession, entries: list[tuple[str, str]], excluded: list[str] = ()) -> DataFrame:
    """subject, recording, person and excluded of a study's recordings (a small dimension table, to be joined by subject)."""
    rows = spark.createDataFrame(entries, "subject string, recording string")
    return rows.withColumns({"person": person_key(F.col("subject")), "excluded": F.col("subject").isin(list(excluded))})


def exclude_recordings(df: DataFrame, rec: str, person: str, names: list, least_groups: int = 3) -> tuple[DataFrame, list]:
    """df without the named recordings, and the persons of whom nothing is left. No match, or fewer persons left than least_groups, raises."""
    gone = F.col(rec).isin(names)
    by = df.groupBy(person).agg(F.max(gone.cast("int")).alias("hit"), F.max((~gone).cast("int")).alias("left"))
    lost = [r[0] for r in by.where("left = 0").select(person).collect()]  # persons that lose all
    told = by.agg(F.max("hit"), F.sum("left")).first()
    if not told[0]:
        raise ValueError(f"none of {names} is in the table")
    if (told[1] or 0) < least_groups:
        raise ValueError(f"only {told[1]} persons left, at least {least_groups} are needed")
    return df.where(~gone), sorted(lost)


def arms_in(columns: list[str], targets: list[str] = TARGETS, suffixes: tuple[str, ...] = ("pred", "zero", "oracle", "pre", "amean")) -> list[tuple[str, str]]:
    """(target, suffix) of the prediction columns that a table has beside <target>_true."""
    return [(t, s) for t in targets for s in suffixes if f"{t}_true" in columns and f"{t}_{s}" in columns]


def graded_arms(df: DataFrame) -> DataFrame:
    """Standards of every prediction column of a table of predictions: arm, target and the grades; persons come from person, Subject_ID or count as one."""
    from pulseforge.operators import scoring as sc

    arms = arms_in(df.columns)
    if not arms:
        raise ValueError("no prediction column beside its truth")
    who = next((c for c in ("person", "Subject_ID") if c in df.columns), None)
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("arm"), (F.col(f"{t}_{s}") - F.col(f"{t}_true")).cast("double").alias("e")) for t, s in arms]))
    rows = df.select((F.col(who) if who else F.lit("all")).alias("person"), parts.alias("k")).select("person", "k.*").where("e is not null")
    iso = sc.iso_81060(rows, "e", "person", ["target", "arm"]).select("target", "arm", "n_persons", "sd_persons", "criterion1", "criterion2")
    return sc.standards(rows, "e", ["target", "arm"]).join(iso, ["target", "arm"])


def _found(spark: SparkSession, where: str, **options) -> DataFrame | None:
    """The table at a path or pattern, None where no file is."""
    from pyspark.errors import AnalysisException

    reader = spark.read.options(**options)
    try:
        return reader.parquet(where) if where.endswith(".parquet") else reader.csv(where, header=True, inferSchema=True)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def pooled_predictions(spark: SparkSession, path: str, pattern: str = "fold_*/predictions.csv") -> DataFrame:
    """Predictions of a file, or of all folds of a run's folder, with fold (the folder's name).

    A folder where nothing fits the pattern gives the files of the pattern's last name at any depth; if there are none
    either, this raises FileNotFoundError.
    """
    single = re.search(r"\.(csv|parquet)$", path)
    rows = _found(spark, path if single else f"{path}/{pattern}")
    if rows is None and not single:
        rows = _found(spark, path, recursiveFileLookup=True, pathGlobFilter=pattern.rsplit("/", 1)[-1])
    if rows is None:
        raise FileNotFoundError(f"no predictions in {path}")
    return rows.withColumn("fold", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def zero_delta_bar(spark: SparkSession, path: str, summary: str = "loso_summary.csv", targets: list[str] = TARGETS) -> DataFrame | None:
    """target and zero_delta, the mean over folds of the errors of the calibration value, from a run's summary; None without the file or its columns."""
    rows = _found(spark, f"{path}/{summary}")
    names = {t: f"MAE_{t}_baseline_calib" for t in targets}
    if rows is None or not set(names.values()) <= set(rows.columns):
        return None
    bars = F.array(*[F.struct(F.lit(t).alias("target"), F.avg(F.col(c).cast("double")).alias("zero_delta")) for t, c in names.items()])
    return rows.agg(bars.alias("b")).select(F.inline("b"))


def pooled_runs(spark: SparkSession, paths: list[str], pattern: str = "fold_*/predictions.csv") -> tuple[DataFrame, DataFrame | None]:
    """Predictions of several files and run folders as one table (columns that one lacks are null), and the first folder's zero-delta bar that there is.

    A folder without predictions adds nothing, as long as some path has any; a named file must be there.
    """
    from functools import reduce

    tables, bar = [], None
    for path in paths:
        single = re.search(r"\.(csv|parquet)$", path)
        try:
            tables.append(pooled_predictions(spark, path, pattern))
        except FileNotFoundError:
            if single:
                raise
        if bar is None and not single:
            bar = zero_delta_bar(spark, path)
    if not tables:
        raise FileNotFoundError(f"no predictions in {', '.join(paths)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), bar


def graded_runs(spark: SparkSession, paths: list[str], pattern: str = "fold_*/predictions.csv") -> DataFrame:
    """graded_arms() of several runs together, with overall (both ISO criteria) and zero_delta, the bar of the calibration value (null without one)."""
    rows, bar = pooled_runs(spark, paths, pattern)
    told = graded_arms(rows).withColumn("overall", F.col("criterion1") & F.col("criterion2"))
    return told.withColumn("zero_delta", F.lit(None).cast("double")) if bar is None else told.join(F.broadcast(bar), "target", "left")  # a row for each target


def fine_tune_columns(df: DataFrame, cap: int, targets: list[str] = TARGETS) -> DataFrame:
    """margin_<t> (own mean less tuned), flat_<t> (spread of the predictions over that of the truth) and truncated (the best epoch is at the cap)."""
    new = {}
    for t in targets:
        if {f"amean_{t}", f"post_{t}"} <= set(df.columns):
            new[f"margin_{t}"] = F.col(f"amean_{t}") - F.col(f"post_{t}")
        if {f"predsd_{t}", f"truesd_{t}"} <= set(df.columns):
            new[f"flat_{t}"] = F.col(f"predsd_{t}") / F.nullif(F.col(f"truesd_{t}"), F.lit(0.0))
    if "best_epoch" in df.columns:
        new["truncated"] = F.col("best_epoch") >= cap - 1
    return df.withColumns(new)


def curve_summary(curves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Learning curves (fold, iter, split, channel, mae, base): mean and quartiles by iter, split and channel; and by channel how many folds beat their baseline at the last iter and the mean gap."""
    q = F.percentile("mae", F.array(F.lit(0.25), F.lit(0.75)))
    by_iter = curves.groupBy("iter", "split", "channel").agg(F.avg("mae").alias("mean"), q.alias("q")).select("iter", "split", "channel", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    last = curves.where("split = 'held-out'").groupBy("fold", "channel").agg(F.max_by(F.col("mae") - F.col("base"), "iter").alias("gap"))
    ends = last.groupBy("channel").agg(F.avg("gap").alias("gap"), F.count(F.when(F.col("gap") < 0, 1)).alias("wins"), F.count("*").alias("n_folds"))
    return by_iter, ends


def stride_of(df: DataFrame, rec: str, t: str) -> DataFrame:
    """Median step of a recording's times: one row."""
    w = Window.partitionBy(rec).orderBy(t)
    step = F.col(t) - F.lag(t).over(w)
    return df.select(step.alias("d")).where("d > 0").agg(F.percentile("d", 0.5).alias("stride"))
