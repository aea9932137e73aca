import duckdb
import numpy as np
import pytest

from pulseforge.llm import topk


def brute(rows, k):
    good = [(i, np.floor(np.array(v, dtype=float) * 1024).astype(object)) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            out[q] = sorted((-int(sum(x * y for x, y in zip(map(int, a), map(int, b), strict=False))), i) for i, b in good if i != q)[:k]
    return {(q, r, i, -s) for q, best in out.items() for r, (s, i) in enumerate(best, 1)}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in topk.op4_topk(spark, d).select("query_id", "rank", "vec_id", "score").collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert got == set(con.execute(topk.OP4_SQL).fetchall())


def test_ties_bad_vectors_and_short_tables(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(900)]
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] + [0.0] * 7), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, [0.0] * 8), (1000, [0.0] * 8), (1100, [1e17, -3e17] * 4), (1101, [1e17, -3e17] * 4)]
    monkeypatch.setattr(topk, "GROUP", 300)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "SMALL", 100)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [r for r in rows if r[0] is None or r[0] < 1100]
    got = {tuple(r) for r in topk.top_k(df.where("vec_id is null or vec_id < 1100"), df.where("vec_id % 100 = 0 and vec_id < 1100")).collect()}
    assert got == brute(small, 10)
    few = df.where("vec_id in (0, 1, 904)")
    assert {tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()} == brute([r for r in rows if r[0] in (0, 1, 904)], 10)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_pruning_keeps_results_and_saves_work():
    rng = np.random.default_rng(2)
    centre = np.repeat(rng.normal(0, 900, (12, 16)), topk.BLOCK, 0)
    vectors = np.floor(centre + rng.normal(0, 20, centre.shape))
    ids = np.arange(len(vectors)) * 3
    stats: list = []
    asked = np.arange(0, len(ids), 500)
    got = list(topk.search_group(ids, vectors, ids[asked], vectors[asked], 5, stats))
    full = vectors[asked] @ vectors.T
    for n, q in enumerate(asked.tolist()):
        best = sorted((-full[n, j], ids[j]) for j in range(len(ids)) if j != q)[:5]
        assert [(i, -s) for a, i, s in got if a == ids[q]] == [(i, s) for s, i in best]
    assert sum(stats) < 0.7 * len(asked) * 12


def test_large_sums_are_exact():
    a = np.array([[2.0**40, 3.0], [2.0**40, 4.0]])
    got = list(topk.search_group(np.array([1, 2]), a, np.array([9]), np.array([[2.0**40, 1.0]]), 2))
    assert got == [(9, 2, 2**80 + 4), (9, 1, 2**80 + 3)]


def test_scores_that_do_not_fit_and_short_vectors(spark):
    df = spark.createDataFrame([(0, [1e17, 2e17]), (1, [1e17, 1.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(df, df.where("vec_id = 0")).collect()
    near = spark.createDataFrame([(0, [3e6]), (1, [2e6, 5.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(near, near.where("vec_id = 0")).collect()]
    assert got == [(0, 1, 1, 3072000000 * 2048000000), (0, 2, 2, 3072000000 * 1024)]
