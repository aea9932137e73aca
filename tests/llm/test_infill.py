"""Fill-in-the-middle against a plain Python form, and back."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseforge.llm import infill

DIR = "/root/testdata/sf0.001"


def plainly(key, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return key, n, "plain", None, None, text
    if h4 % 100 < spm:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\nb", "a\r\nb\rc d\x85e", "é́\U0001f600\nzwei\n\ndrei", "x <P> y\nz", "<<\n<S\n>P>\n<\nS>", "<\nM>\nM>", "z\x00\ny\x00", "q\n" * 9]


def test_equals_plain_form(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 5)] + [(None, "a\nb\nc"), (3, "again\nb"), (3, "again\nb"), (-9, "k\nl\nm\nn")]
    df = spark.createDataFrame([(i, t, "n", "plain", 1) for i, t in rows], "doc_id long, text string, output string, form string, at int")
    got = infill.fill_in_middle(df)
    assert ordered(map(tuple, got.collect())) == ordered(plainly(i, t) for i, t in rows)
    back = infill.restore(got)
    texts = {(r.doc_id, r.text, r.text_sha256) for r in back.collect()}
    assert texts == {(i, t or "", hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_rate_marks_and_ids_of_text(spark):
    rows = [(f"k{i}", "\n".join(map(str, range(i)))) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, body string")
    got = infill.fill_in_middle(df, "name", "body", rate=40, spm=0, seed=3)
    assert ordered(map(tuple, got.collect())) == ordered(plainly(i, t, 40, 0, 3) for i, t in rows)
    forms = [r.form for r in got.collect()]
    assert 5 < forms.count("psm") < 45 and "spm" not in forms
    own = ("[pre]", "[suf]", "[mid]")
    back = infill.restore(infill.fill_in_middle(df, "name", "body", marks=own), own)
    assert {(r.name, r.text) for r in back.collect()} == set(rows)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("<P>", ">S", "<M>")):
        with pytest.raises(ValueError):
            infill.values(bad)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>PSM\né ")), max_size=60), st.integers(-5, 5))
def test_round_trip(text, key):
    """The two statements alone, without Spark."""
    con = duckdb.connect()
    v = infill.values()
    names = lambda sql: {k: x for k, x in v.items() if f"${k}" in sql}
    con.execute("create table lot as select 0 as nr, ?::varchar as key, ?::varchar as text", [str(key), text])
    at, *rest = con.execute(infill.CUT_SQL, names(infill.CUT_SQL)).fetchone()
    assert (key, *rest) == plainly(key, text)
    con.execute("create or replace table lot as select 0 as nr, ?::varchar as form, ?::varchar as output", [rest[1], rest[4]])
    assert con.execute(infill.RESTORE_SQL, names(infill.RESTORE_SQL)).fetchone()[1] == text


def test_long_text_and_empty_table(spark):
    long = "Zeile ä\n" * 700_000 + "Ende"
    df = spark.createDataFrame([(5, long), (6, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in infill.restore(infill.fill_in_middle(df).withColumn("size", infill.F.length("output"))).collect()}
    assert got[5][1] == 700_001 and got[5][5] == len(long) + 9 and got[5][6] == long and got[6][6] == "x" * 3_000_000
    assert infill.restore(infill.fill_in_middle(df.limit(0))).count() == 0


def test_query_equals_sql_and_plain_form(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got = infill.op12_infill(spark, DIR)
    rel = con.execute(infill.OP12_SQL)
    assert [c[0] for c in rel.description] == got.columns
    rows = ordered(map(tuple, got.collect()))
    assert rows == ordered(rel.fetchall())
    docs = con.execute("select doc_id, text from documents").fetchall()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == ordered((*plainly(i, t)[:5], digest(plainly(i, t)[5]), digest(t or "")) for i, t in docs)
