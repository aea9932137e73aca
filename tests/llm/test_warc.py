import random

import duckdb
from pyspark.sql import functions as F

from pulseforge.llm import warc


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    cols = ["record_id", "page_id", "canonical_url", "source_page_id", "status", "headers", "digest", "length"]
    got = sorted(tuple(r) for r in warc.op10_warc(spark, d).select(*cols).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = con.execute(warc.OP10_SQL)
    names = [x[0] for x in want.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
    assert got == want
    assert {r[4] for r in got} >= {"resolved", "mismatch", "missing"}


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/?utm_source=x#top", "https://example.com:443/a", "HTTP://EXAMPLE.COM/a/", " http://example.com/a?ref=1&utm_campaign=2 "]
    other = ["http://example.com/a?b=2&a=1", "http://example.com/a?a=1&b=2&gclid=9", "http://example.com/A", "http://example.com", None]
    df = spark.createDataFrame([(u,) for u in same + other], "url string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("url"))).collect()]
    assert set(got[:4]) == {"http://example.com/a"}
    assert got[4:] == ["http://example.com/a?a=1&b=2", "http://example.com/a?a=1&b=2", "http://example.com/A", "http://example.com", None]


def test_as_of_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        kind = "response" if rng.random() < 0.2 else "revisit"
        tag = rng.choice([None, "1", "2"])
        headers = {"server": "s", **({"etag": tag} if tag else {}), **({"last-modified": rng.choice("ab")} if rng.random() < 0.5 else {})}
        rows.append((i, rng.choice(["http://h/x", "https://www.h/x/", "http://h/y"]), rng.randrange(120), kind, headers if rng.random() < 0.95 else None, f"d{i}" if kind == "response" else None, i))
    rows += [(900, None, 5, "revisit", {}, None, 0), (901, "http://h/x", None, "revisit", {}, None, 0), (902, "http://none/", 9, "revisit", {"etag": "1"}, None, 0)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "record_id long, url string, time long, kind string, headers map<string,string>, digest string, length long, status string")
    got = {r.record_id: r for r in warc.resolve(df, slice_=8).collect()}
    url = lambda u: None if u is None else "y" if "y" in u else "x" if "h/x" in u else "n"
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for i, u, t, kind, h, _, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and u is not None and t is not None and url(r[1]) == url(u) and r[2] < t]
        src = max(before, key=lambda r: (r[2], r[0]), default=None)
        assert got[i].source_id == (src[0] if src else None)
        a, b = h or {}, (src[4] or {}) if src else {}
        if not src:
            want = "missing"
        elif "etag" in a and "etag" in b:
            want = "resolved" if a["etag"] == b["etag"] else "mismatch"
        elif "last-modified" in a and "last-modified" in b:
            want = "resolved" if a["last-modified"] == b["last-modified"] else "mismatch"
        else:
            want = "unverified"
        assert got[i].status == want
        if want in ("resolved", "unverified"):
            assert got[i].headers == {**b, **{k: v for k, v in a.items() if k in warc.RENEWED}} and got[i].digest == src[5]
    assert warc.resolve(df.limit(0)).count() == 0
