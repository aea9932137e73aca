"""Hard negatives against brute force, on even, clustered, repeated and odd vectors."""

import math

import duckdb
import numpy as np
import pytest

from pulseforge.llm import common, negatives

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plainly(rows, every=50, positives=5, k=3, low=50, high=95, scale=256, moved=7):
    rows = [(i, [math.floor(x * scale) for x in v], (c + 1) % 10 if moved and i % moved == 0 else c) for i, v, c in rows]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, v, c in rows:
        if a % every:
            continue
        scored = sorted((-inner(v, w), i, d) for i, w, d in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            found = [(n, t) for t, n, d in scored if d != c and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(found)]
    return sorted(out)


def made(seed, n=400, dim=8, classes=4, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(classes, dim))
    labels = r.integers(0, classes, n)
    x = centres[labels] + spread * r.normal(size=(n, dim))
    return [(i, v, int(c)) for i, v, c in zip(range(n), x.tolist(), labels, strict=True)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, spread):
    rows = made(1, spread=spread)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors="id % 10 = 0", moved="vec_id % 7 = 0")
    assert sorted(map(tuple, got.collect())) == plainly(rows, every=10) != []


def test_groups_of_equal_vectors_ties_and_signs(spark, monkeypatch):
    """A third of the rows is one vector, and more share their direction; groups are split and scans take small steps."""
    monkeypatch.setattr(negatives, "STEP", 7)
    rows = made(2, n=300, dim=3)
    rows += [(1000 + i, [0.5, 0.5, -0.25], i % 3) for i in range(150)] + [(2000 + i, [0.25, 0.25, -0.125], i % 5) for i in range(40)] + [(3000, [0.0, 0.0, 0.0], 1)]
    rows += [(-50, [-0.5, -0.5, 0.25], 9), (-100, [0.4, 0.5, -0.2], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = []
    plain_init = negatives.Index.__init__

    def init(self, rows, *a, **b):
        plain_init(self, rows, 6, 3, 20)
        asked.append(self)

    monkeypatch.setattr(negatives.Index, "__init__", init)
    got = negatives.hard_negatives(df, anchors="id % 25 = 0", positives=4, negatives=5, low=20, high=99)
    assert sorted(map(tuple, got.collect())) == plainly(rows, every=25, positives=4, k=5, low=20, high=99, moved=None)
    sizes = [r["count"] for r in asked[0].rows.groupBy("part").count().collect()]
    assert len(sizes) > 18 and max(sizes) < 80


def test_scans_stop_early(spark):
    """On clustered vectors most rows are never scored, neither in a part nor by the parts that are visited."""
    rows = made(3, n=3000, dim=6, classes=40, spread=0.02)
    rows = [(i, (np.array(v) / np.linalg.norm(v) * 10).tolist(), c) for i, v, c in rows]
    index = negatives.Index(negatives.whole_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding", 256.0, None, 10), pivots=20, rings=4)
    asked = index.rows.where("id % 50 = 0").select("id", "label", "v", negatives.F.lit(None).cast("long").alias("least"))
    counted = "anchor_id long, scanned long, held long"

    def search(query, part):
        before = part.scanned
        negatives.search_positives(query, part, 5)
        return [(query[0], part.scanned - before, len(part.ids))]

    first = index.scan(index.visits(asked, home=True), lambda q, p: negatives.search_positives(q, p, 5), {"least": "long"}, "anchor_id long, id long, score long")
    kth = first.groupBy(negatives.F.col("anchor_id").alias("id")).agg(negatives.F.min("score").alias("least"))
    visits = index.visits(asked.drop("least").join(kth, "id", "left").select("id", "label", "v", "least"))
    assert visits.count() < 0.5 * index.groups * asked.count()
    done = index.scan(visits, search, {"least": "long"}, counted).agg({"scanned": "sum", "held": "sum"}).first()
    assert 0 < done["sum(scanned)"] < 3000 * 60 * 0.6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.5], 1), (51, [1.0, 0.25], 1), (52, [1.0, -0.5], 2), (53, None, 1), (54, [1.0, None], 2), (55, [nan, 1.0], 2), (56, [1.0, inf], 2), (57, [1.0, 0.3], None), (None, [1.0, 0.4], 2), (58, [0.7], 2), (59, [], 2), (100, [9.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "x", 0, 1.5) for r in rows + rows + [(52, [1.0, -0.5], 7)]], SCHEMA + ", id string, part int, dist double")
    good = [r for r in rows if r[0] in (50, 51, 52, 58, 59, 100)]
    assert sorted(map(tuple, negatives.hard_negatives(df, moved="vec_id % 7 = 0").collect())) == plainly(good) != []
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 50")).count() == 0


def test_great_components(spark):
    """Scores beyond 2**53 are exact; one that doesn't fit a long is an error."""
    rows = [(i, [2.0**20 + i / 256, 2.0**21 - i / 256, 1.0 + i], i % 2) for i in range(120)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), high=100)
    assert sorted(map(tuple, got.collect())) == plainly(rows, high=100, moved=None) != []
    with pytest.raises(Exception, match="long"):
        negatives.hard_negatives(spark.createDataFrame([(i, [1e12 + i, 1e300], i % 2) for i in range(60)], SCHEMA)).collect()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    rel = con.execute(negatives.OP13_SQL)
    got = negatives.op13_negatives(spark, DIR)
    assert [c[0] for c in rel.description] == got.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(rel.fetchall())
    table = common.table(spark, DIR, "embeddings").collect()
    assert rows == plainly([(r.vec_id, r.embedding, r.label) for r in table])
