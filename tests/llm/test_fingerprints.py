import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pulseforge.llm import fingerprints as fp


def check(rows, docs):
    docs = sorted(docs)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    groups = defaultdict(list)
    for key, text in docs:
        groups[fp.canonical(text)].append(key)
    for (key, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        text, after, r = text or "", after or "", got[key]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fp.digest(fp.canonical(text)) and r.edited_fingerprint == fp.digest(fp.canonical(edited))
        assert r.near_edited == float(fp.canonical(edited) == fp.canonical(text)) and r.near_next == float(fp.canonical(after) == fp.canonical(text))
        assert r.group_id == min(groups[fp.canonical(text)])


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    check(fp.op1_fingerprints(spark, "/root/testdata/sf0.01").collect(), [(d.doc_id, d.text) for d in docs])


def test_edges(spark, tmp_path):
    texts = [None, "", "a", "A", "é  x", "É X", "ﬁ", "fi", "x y " * 20000, "last"]
    df = spark.createDataFrame([(i * 7 - 20, t, "z", 3) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(fp.op1_fingerprints(spark, str(tmp_path)).collect(), [(i * 7 - 20, t) for i, t in enumerate(texts)])
    df.limit(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert fp.op1_fingerprints(spark, f"{tmp_path}/one").count() == 1
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fp.op1_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_collisions_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(fp, "SALT_ROWS", 5)
    texts = [f"text {i % 40}" if i > 60 else "hot" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fp.fingerprints(df, bits=3)
    assert prints.select("fingerprint").distinct().count() <= 8
    got = {r.doc_id: r.group_id for r in fp.groups(df, prints, bits=3).collect()}
    assert [got.get(i, i) for i in range(200)] == [texts.index(t) for t in texts]


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, "B"), (None, "a")], "doc_id long, text string")
    out = fp.edited_fingerprints(df)
    assert out.count() == 5 and out.agg(F.countDistinct("fingerprint")).first()[0] == 2
    assert {(r.doc_id, r.group_id) for r in fp.groups(df, fp.fingerprints(df)).collect()} == {(1, 1), (2, 1)}


def test_rows_of_one_id_with_different_texts(spark):
    """Each (id, fingerprint) has the group of its own text."""
    df = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha"), (3, "beta"), (3, "beta"), (4, "gamma"), (4, "delta"), (0, "delta")], "doc_id long, text string")
    names = {fp.digest(t.encode()): t for t in ("alpha", "beta", "gamma", "delta")}
    got = sorted((r.doc_id, names[r.fingerprint], r.group_id) for r in fp.groups(df, fp.fingerprints(df)).collect())
    assert got == [(0, "delta", 0), (1, "alpha", 1), (1, "beta", 1), (2, "alpha", 1), (3, "beta", 1), (4, "delta", 0)]
