import random

import numpy as np
import pyarrow as pa
import pytest

from pulseforge.llm import linededup as ld


def folded(text):
    return bytes(ld.FOLD[b] or 32 for b in text.encode())


def brute(docs):
    """Words of each text, and which of them stand in an earlier line of LEAST words or window of RUN words."""
    lines, windows, out = set(), set(), {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        w, bounds = [], []
        for line in (text or "").replace("\r", "\n").split("\n"):
            lo = len(w)
            w += folded(line).split()
            bounds.append((lo, len(w)))
        hit = np.zeros(len(w), bool)
        for lo, hi in bounds:
            if hi - lo >= ld.LEAST:
                g = tuple(w[lo:hi])
                hit[lo:hi] |= g in lines
                lines.add(g)
        for i in range(len(w) - ld.RUN + 1):
            g = tuple(w[i : i + ld.RUN])
            if g in windows:
                hit[i : i + ld.RUN] = True
            windows.add(g)
        out[key] = (w, hit)
    return out


def removed(texts, i, runs):
    lo, hi = (np.array(x) for x in zip(*runs, strict=True))
    new, gone = ld.without(ld.Words(pa.array(texts)), np.full(len(lo), i), lo, hi)
    assert [t for k, t in enumerate(new.to_pylist()) if k != i] == [t or "" for k, t in enumerate(texts) if k != i]
    return new[i].as_py(), int(gone[i])


def check(docs, runs):
    want, gone = brute(docs), {}
    for i, _, lo, hi in runs:
        gone.setdefault(i, np.zeros(len(want[i][0]), bool))[lo:hi] = True
    for key, (w, hit) in want.items():
        got = gone.get(key, np.zeros(len(w), bool))
        assert (got == hit).all(), (key, np.flatnonzero(got != hit)[:20], len(w))
    return sum(int(h.sum()) for _, h in want.values())


def test_real_tables(spark):
    """Exactly the words that brute force finds go: every later copy of a line, every word of a repeated window."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(d.doc_id, d.text) for d in df.collect()]
    runs = [tuple(r) for r in ld.repeated_runs(df).collect()]
    assert check(docs, runs) > 10_000
    by: dict = {}
    for i, _, lo, hi in runs:
        by.setdefault(i, []).append((lo, hi))
    got = {r.doc_id: (r.text, r.words_removed) for r in ld.op3_linededup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: removed([t], 0, by[k]) if k in by else (t, 0) for k, t in docs}
    seen: set = set()
    for k, t in sorted(docs):
        mine = [tuple(folded(x).split()) for x in t.replace("\r", "\n").split("\n")]
        left = [tuple(folded(x).split()) for x in got[k][0].replace("\r", "\n").split("\n")]
        assert not [x for x in left if len(x) >= ld.LEAST and x in seen and x in mine], k
        seen |= {x for x in mine if len(x) >= ld.LEAST}


def test_runs_and_edges(spark):
    rng = random.Random(4)
    word = lambda: f"W{rng.randrange(4000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200, 60)]
    docs = [(0, None), (1, ""), (2, "short text"), (3, "long " * 3000), (4, "long " * 2000), (5, "ab cd ef " * 60), (6, "x\n" * 90)]
    docs += [(7, " ".join(["tail"] * 203 + passages[0][:30])), (8, " ".join(["a", "b"] + ["tail"] * 40 + passages[0][:30]))]
    for i in range(80):
        body = []
        for _ in range(rng.randrange(1, 4)):
            body += [word() for _ in range(rng.randrange(0, 40))]
            p = rng.choice(passages)
            a = rng.randrange(0, 20) if rng.random() < 0.2 else 0
            b = rng.randrange(0, 20) if rng.random() < 0.2 else 0
            body += p[a : len(p) - b]
        docs.append((10 + i, "".join(w + rng.choice([" ", " ", "\n", ", ", ".\n"]) for w in body)))
    df = spark.createDataFrame([(k, t, "s", 1, 2, 3) for k, t in docs], "doc_id long, text string, hash string, lo int, id int, words_removed int").repartition(6)
    check(docs, [tuple(r) for r in ld.repeated_runs(df).collect()])
    out = ld.dedup_lines(df)
    assert out.columns == [*df.columns[:-1], "words_removed"] and out.count() == len(docs)
    assert {r.doc_id: (r.text, r.hash, r.lo, r.id) for r in out.collect() if r.doc_id < 4} == {0: (None, "s", 1, 2), 1: ("", "s", 1, 2), 2: ("short text", "s", 1, 2), 3: ("long ", "s", 1, 2)}
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_one_passage_in_many_documents(spark):
    rng = random.Random(1)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage, near = [word() for _ in range(64)], [word() for _ in range(120)]
    docs = []
    for i in range(400):
        mine = [w if rng.random() > 0.02 else word() for w in near]
        docs.append((i, " ".join([*(word() for _ in range(i % 90)), *passage, *(word() for _ in range(i % 7)), *mine])))
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    check(docs, [tuple(r) for r in ld.repeated_runs(df).collect()])


def test_twins_null_ids_and_rows_of_one_id(spark):
    p = " ".join(f"a{i}" for i in range(70))
    df = spark.createDataFrame([(5, p), (5, p), (None, p), (6, "x " + p + " y"), (7, "é " + p), (7, "other words here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text, r.words_removed) for r in ld.dedup_lines(df).collect())
    assert got == [(-1, p, 0), (5, p, 0), (5, p, 0), (6, "x y", 70), (7, "other words here", 0), (7, "é ", 70)]


@pytest.mark.parametrize(
    ("text", "runs", "left"),
    [
        ("one two three\nfour five six\nseven eight nine", [(3, 6)], "one two three\nseven eight nine"),
        ("one two three\nfour five six\nseven", [(2, 5)], "one two \nsix\nseven"),
        ("one two three.\nfour", [(1, 3)], "one \nfour"),
        ("(one two)", [(0, 2)], ""),
        ("one, two, three", [(0, 1), (1, 2)], "three"),
    ],
)
def test_without(text, runs, left):
    assert removed(["zz", text, None, "last one"], 1, runs)[0] == left
    assert removed(["zz", "other", None, text], 3, runs)[0] == left


def test_winnow_guarantee_and_hashes():
    rng = np.random.default_rng(0)
    a = [f"q{i}" for i in rng.integers(0, 5000, 400)]
    for lo in range(0, 350, 7):
        part = " ".join(["z"] * 5 + a[lo : lo + ld.RUN] + ["y"] * 9)
        h1, h2 = (set(ld.Words(pa.array([t])).stretches()[2].tolist()) for t in (" ".join(a), part))
        assert h1 & h2
    w = ld.Words(pa.array(["Ab, cd ef\nab", None, "", "AB CD", "ef ab"]))
    assert w.bounds.tolist() == [0, 4, 4, 4, 6, 8]
    lo = np.array([0, 4])
    assert len(set(w.digests(lo, lo + 2)[0].tolist())) == 1 and len(set(w.digests(lo, lo + 2)[1].tolist())) == 1
    assert len(set(w.digests(np.arange(8), np.arange(8) + 1)[0].tolist())) == 3


def test_lines_that_sums_of_powers_take_for_equal(spark):
    """Words and lines in the order of the Thue-Morse sequence and its complement collide in every sum of odd powers; they aren't equal and stay."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = "".join("xy"[k] for k in bits), "".join("yx"[k] for k in bits)
    long_a, long_b = " ".join(("rot", "blau")[k] for k in bits), " ".join(("blau", "rot")[k] for k in bits)
    docs = [(1, f"{a} red car"), (2, f"{b} red car"), (3, long_a), (4, long_b), (5, f"{a} red car\nmore")]
    got = {r.doc_id: (r.text, r.words_removed) for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == (docs[1][1], 0) and got[1] == (docs[0][1], 0) and got[3][1] < 1024 and got[5] == ("more", 3)
    check(docs, [tuple(r) for r in ld.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()])
    words = ld.Words(pa.array([long_a, long_b, a, b]))
    h, c = words.digests(words.bounds[:-1], words.bounds[1:])
    assert len(set(h.tolist())) == 4 and len(set(c.tolist())) == 4
