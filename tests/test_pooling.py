"""Predictions of several runs pooled, with the bar of the calibration value."""

import pytest

from pulseforge.operators import engineer as en


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


HEAD = "person,SBP_true,SBP_pred,DBP_true,DBP_pred\n"


def test_folders_files_and_the_bar(spark, tmp_path):
    one, two, deep, none = (tmp_path / n for n in ("one", "two", "deep", "none"))
    for k in (1, 2):
        put(one / f"fold_{k}" / "predictions.csv", HEAD + f"p{k},120,121,80,81\np{k},122,121,82,81\n")
    put(two / "fold_9" / "predictions.csv", HEAD.replace("DBP_pred", "DBP_pred,DBP_amean") + "q,100,140,70,70,75\n")
    put(two / "loso_summary.csv", "fold,MAE_SBP_baseline_calib,MAE_DBP_baseline_calib\n1,4.0,2.0\n2,6.0,3.0\n")
    put(deep / "a" / "b" / "predictions.csv", HEAD + "r,1,1,1,1\n")
    put(deep / "loso_summary.csv", "fold,other\n1,4.0\n")
    put(none / "notes.txt", "nothing")
    put(tmp_path / "alone.csv", HEAD + "s,1,1,1,1\n")

    rows, bar = en.pooled_runs(spark, [str(one), str(none), str(deep), str(two), str(tmp_path / "alone.csv")])
    got = rows.collect()
    assert sorted(r.person for r in got) == ["p1", "p1", "p2", "p2", "q", "r", "s"]
    assert {r.fold for r in got} == {"fold_1", "fold_2", "fold_9", "b", tmp_path.name}
    assert {r.person: r.DBP_amean for r in got} == {"p1": None, "p2": None, "q": 75, "r": None, "s": None}
    assert {r.target: r.zero_delta for r in bar.collect()} == {"SBP": 5.0, "DBP": 2.5}
    assert en.pooled_predictions(spark, str(deep)).count() == 1 and en.zero_delta_bar(spark, str(one)) is None

    told = {(r.target, r.arm): r for r in en.graded_runs(spark, [str(one), str(two)]).collect()}
    assert set(told) == {("SBP", "pred"), ("DBP", "pred"), ("DBP", "amean")}
    assert told["SBP", "pred"].zero_delta == 5.0 and told["DBP", "amean"].zero_delta == 2.5 and told["DBP", "amean"].n == 1
    assert abs(told["SBP", "pred"].mae - (4 * 1 + 40) / 5) < 1e-12
    assert told["DBP", "pred"].overall and not told["SBP", "pred"].overall
    assert {r.zero_delta for r in en.graded_runs(spark, [str(one)]).collect()} == {None}


def test_missing_predictions_raise(spark, tmp_path):
    put(tmp_path / "none" / "notes.txt", "nothing")
    for paths in ([f"{tmp_path}/none"], [f"{tmp_path}/absent"], [f"{tmp_path}/absent.csv"]):
        with pytest.raises(FileNotFoundError):
            en.pooled_runs(spark, paths)
