import numpy as np

from pulseforge.llm import toxicity as tx


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out(spark):
    rows = {r.doc_id: r for r in tx.op2_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(rows) == 10000
    held = [(x.toxic, rows[x.doc_id]) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    y, s, p = np.array([a for a, _ in held]), np.array([r.score for _, r in held]), np.array([r.predicted for _, r in held])
    print(len(y), auc(y, s), (p == y).mean(), p[y == 1].mean(), p[y == 0].mean())
    assert auc(y, s) > 0.95 and p[y == 1].mean() > 0.75 and p[y == 0].mean() < 0.02


def test_features_are_distinct_by_place():
    at, doc = tx.features(["a b c", None, "", "a", "c b"])
    assert np.bincount(doc, minlength=5).tolist() == [3 + 2 + 1 + 1, 0, 0, 1, 2 + 1]
    assert at.max() < 1 << tx.BITS


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot fool" if i % 3 == 0 else "a fine day", "x") for i in range(300)] + [(900, None, "x"), (901, "", "x"), (None, "you idiot", "x"), (5, "a fine day", "x"), (902, "idiot " * 100000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (900, 1), (1, None)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == 305
    by = {r.doc_id: r.score for r in got}
    assert by[3] > 0.5 > by[4] and by[None] > 0.5 and by[902] > 0.5 and by[900] == by[901]
    assert len(tx.fit(docs, labels.limit(0))["at"]) == 0 and len(tx.fit(docs, labels.where("toxic = 1"))["at"]) == 0
    assert tx.score(docs.limit(0), model).count() == 0
    assert {r.score < 0.5 for r in tx.score(docs, tx.fit(docs, labels.limit(0))).collect()} == {True}
    rows = tx.score_rows(docs, model)
    assert rows.columns == ["doc_id", "text", "score"] and dict(rows.dtypes)["score"] == "double"
    small = tx.score(docs.withColumn("doc_id", docs.doc_id.cast("int")), model)
    assert dict(small.dtypes)["doc_id"] == "int" and small.count() == 305
    again = tx.fit(docs.repartition(7), labels.repartition(3))
    assert (again["at"] == model["at"]).all() and (again["w"] == model["w"]).all()


def plain_ftrl(rows, epochs):
    """FTRL-proximal with dictionaries, a coordinate at a time."""
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == "bias" else tx.L1
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * l1) / ((tx.BETA + np.sqrt(n[k])) / tx.ALPHA + tx.L2)

    for _ in range(epochs):
        for at, y in rows:
            keys = [*at, "bias"]
            w = {k: weight(k) for k in keys}
            p = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30)))
            g = (p - y) * (tx.POSITIVE if y else 1.0)
            for k in keys:
                old = n.get(k, 0.0)
                sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / tx.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = old + g * g
    return {k: w for k in z if (w := weight(k)) != 0.0}


def test_ftrl_equals_a_plain_one(spark):
    """The weights of a fit over a table are those of a plain implementation over the same rows in the same order."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["vile", "filth"]
    rows = []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, 60, 12)]
        if i % 4 == 0:
            text[int(rng.integers(0, 12))] = "vile" if i % 8 else "filth"
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", F.lit(11))).collect()]
    by = {i: (np.unique(tx.features([t])[0]).tolist(), y) for i, t, y in rows}
    want = plain_ftrl([by[i] for i in order], tx.EPOCHS)
    assert abs(want.pop("bias", 0.0) - model["bias"]) < 1e-6
    assert set(model["at"].tolist()) == set(want) and len(want) > 2
    assert all(abs(want[k] - w) < 1e-4 for k, w in zip(model["at"].tolist(), model["w"].tolist(), strict=True))


def test_no_weight_is_dropped():
    model = tx.Ftrl()
    model.z[:300_000], model.n[:300_000] = 9.0, 1.0
    assert len(model.compact()["at"]) == 300_000
