"""Mutual information over strips against the estimate on whole columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseforge.operators import information as inf
from pulseforge.operators import models


def explicit(df, cols, y, person=None, k=3):
    """The same estimate with each fold's rows in one place."""
    rows = df.select("*", F.xxhash64(*df.columns).alias("rid")).toPandas()
    out = {}
    for fold in sorted(rows[person].dropna().unique()) if person else [None]:
        for c in cols:
            use = rows[[c, y]].notna().all(axis=1) & (rows[person].notna() & (rows[person] != fold) if person else True)
            mine = rows[use]
            out[fold, c] = models.mutual_information(mine[c].to_numpy(float), mine[y].to_numpy(float), k, inf.ties(mine["rid"].to_numpy()))
    return out


def told(df):
    return {(r.fold, r.feature): r.mi for r in df.collect()}


def alike(a, b):
    assert set(a) == set(b)
    assert max(abs(a[key] - b[key]) for key in a) < 1e-9


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 1500
    y = rng.normal(size=n)
    y[:8] *= 40  # rows far from all others
    person = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 4, n))
    own = y + 5 * person  # each person in a range of its own
    cols = {"near": y + 0.2 * rng.normal(size=n), "free": rng.standard_cauchy(n), "coarse": np.round(y), "hot": np.where(rng.random(n) < 0.6, 0.0, y), "own": own, "flat": np.full(n, 2.0)}
    rows = [(int(i), int(person[i]), float(y[i]), *[float(v[i]) for v in cols.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "i long, person long, y double, " + ", ".join(f"{c} double" for c in cols)).repartition(3).cache(), list(cols)


@pytest.mark.parametrize("parts", [1, 7])
def test_strips_equal_whole_columns(table, parts):
    df, cols = table
    want = explicit(df, cols, "y", "person")
    alike(told(inf.information(df, cols, "y", "person", parts=parts)), want)
    assert want[0, "near"] > 1.0 > 0.1 > want[0, "free"]


def test_without_folds(table):
    df, cols = table
    alike(told(inf.information(df, cols[:3], "y", parts=5)), explicit(df, cols[:3], "y"))


def test_edges(spark, table):
    df, _ = table
    odd = df.limit(200).select("person", "y", "near")
    odd = odd.union(odd).union(odd.limit(20).withColumn("near", F.lit(None))).union(odd.limit(20).withColumn("y", F.lit(float("nan")))).union(odd.limit(5).withColumn("person", F.lit(None))).cache()
    clean = odd.withColumns({"near": F.nanvl("near", F.lit(None)), "y": F.nanvl("y", F.lit(None))})
    alike(told(inf.information(odd, ["near"], "y", "person", parts=4)), {k: v for k, v in explicit(clean, ["near"], "y", "person").items()})
    assert inf.information(df.limit(0), ["near"], "y", "person").count() == 0
    assert told(inf.information(df.limit(0), ["near"], "y")) == {(None, "near"): 0.0}
    assert set(told(inf.information(df.where("i < 3"), ["near"], "y", "person")).values()) == {0.0}
    lone = df.where("person = 1")
    assert told(inf.information(lone, ["near"], "y", "person")) == {(1, "near"): 0.0}


def test_strips_split_a_value_that_many_rows_share():
    cuts = np.sort(np.array([0.0, 1.0, 1.0, 1.0, np.nextafter(1.0, 2), 2.0]))
    v = np.array([-1.0, 0.0, 0.5, 1.0, 1.0, 1.0, 1.5, 2.0, 3.0])
    tie = np.array([0.9, 0.9, 0.0, 0.1, 0.5, 0.99, 0.0, 0.0, 0.0])
    assert inf.strip_of(cuts, v, tie).tolist() == [0, 1, 1, 2, 3, 4, 5, 6, 6]


def test_digamma():
    euler = 0.5772156649015329
    assert abs(models.digamma(1.0) + euler) < 1e-9 and abs(models.digamma(4.0) - (1 + 1 / 2 + 1 / 3 - euler)) < 1e-9


def test_strips_settle_nearly_all_rows(spark, monkeypatch):
    """Only rows whose neighbours may lie beyond their strip's margin go on from it."""
    rng = np.random.default_rng(6)
    y = rng.normal(size=3000)
    df = spark.createDataFrame([(int(i % 4), float(v), float(v + 0.3 * rng.normal())) for i, v in enumerate(y)], "person long, y double, a double")
    left, cut = [], inf.cut

    def seen(rows, tag):
        out = cut(rows, tag)
        if "s" in out.columns:
            left.append(out.where("s is null").select("rid").distinct().count())
        return out

    monkeypatch.setattr(inf, "cut", seen)
    alike(told(inf.information(df, ["a"], "y", "person", parts=4)), explicit(df, ["a"], "y", "person"))
    assert len(left) == 1 and left[0] < 300


def test_neighbours_equal_all_pairs():
    rng = np.random.default_rng(7)
    x, y = np.round(rng.normal(size=400), 2), rng.normal(size=400)
    for k in (1, 3, 12, 399):
        near, far = models.neighbours(x, y, k)
        away = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(away, np.inf)
        want = np.sort(away, 1)[:, :k]
        assert np.array_equal(np.sort(np.take_along_axis(away, near, 1), 1), want) and np.array_equal(far, want[:, -1])


@pytest.mark.parametrize("copies", [1, 8])
def test_distances_of_all_folds_equal_explicit_ones(copies):
    """To the bit, in any order of rows, with persons whose absence leaves few of a row's nearest rows; and the scaled values come with them."""
    rng = np.random.default_rng(8)
    m, k, people = 400, 3, 6
    x, y, p = np.round(rng.gamma(2, 60, m), 1), np.round(rng.gamma(2, 40, m)), np.minimum(rng.integers(0, 9, m), people - 1)
    x, y, p = (np.repeat(c, copies) for c in (x, y, p))
    p[x < 60] = 2  # crowds of one person
    rid = rng.integers(-(2**62), 2**62, len(x))
    scale, n = np.empty((1, 2, people, 2)), np.empty((1, people))
    for j in range(people):
        use = p != j
        n[0, j] = use.sum()
        for axis, c in enumerate((x, y)):
            scale[0, axis, j] = c[use].mean(), c[use].std()
    plan = inf.Plan(k, list(range(people)), scale, n, [(np.zeros(0), np.zeros(0))])
    for order in (np.arange(len(x)), np.argsort(x, kind="stable")):
        told = list(plan.distances(0, rid[order], x[order], y[order], p[order]))
        assert [t[0] for t in told] == list(range(people))
        for j, r, a, b in told:
            u, v = (plan.scaled(0, axis, j, c[order], rid[order]) for axis, c in enumerate((x, y)))
            assert np.array_equal(a, u) and np.array_equal(b, v)
            use = p[order] != j
            away = np.maximum(np.abs(u[use][:, None] - u[use]), np.abs(v[use][:, None] - v[use]))
            assert np.array_equal(r[use], np.sort(away, 1)[:, k]) and np.isnan(r[~use]).all()
