import random
import re

import numpy as np

from pulseforge.llm import neardup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(docs):
    out = {}
    for key, text in docs:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(docs):
    sets = sets_of(docs)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for k, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(k)
    common: dict = {}
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.op9_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(docs)
    assert sum(k != c for k, (_, c) in got.items()) > 20


def test_chains_hot_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "PASSES", 1)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three four five"), (6, " ".join(base))]
    text = base
    for i in range(40):  # each differs a little from the one before: a chain whose ends are far apart
        text = list(text)
        text[rng.randrange(120)] = f"x{i}"
        docs.append((10 + i, " ".join(text)))
    for i in range(60):  # a group of copies, each with changes of its own
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(120)] = f"y{i}"
        docs.append((100 + i, " ".join(copy)))
    for i in range(30):  # one passage in otherwise different texts
        docs.append((200 + i, " ".join(base[:60] + [f"z{i}q{j}" for j in range(40)])))
    docs += [(300, "same words here again and again"), (301, "Same words here again and again"), (302, "long " * 50000), (303, "long " * 70000)]
    df = spark.createDataFrame([(k, t, "c", 7) for k, t in docs], "doc_id long, text string, mark string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute(docs)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    again = df.where("doc_id in (3, 300)").unionByName(df.where("doc_id = 300")).unionByName(df.where("doc_id = 5").selectExpr("cast(null as long) doc_id", "text", "mark", "n"))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in nd.near_duplicates(again).collect()) == [(-1, -1), (3, 3), (300, 300), (300, 300)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.comp for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


def test_pruning_bounds():
    need = nd.least_matches()
    assert list(need) == [32, 64, 96, 128] and need[128] < 0.75 * 128
    rng = np.random.default_rng(0)
    x = rng.integers(0, 60000, (4000, nd.HASHES)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < 0.75, x, x + 1)
    assert (nd.survive(x, y, need) >= 0).mean() > 0.999
    far = np.where(rng.random(x.shape) < 0.4, x, x + 1)
    assert (nd.survive(x, far, need) >= 0).mean() < 0.01


def test_size_classes_lose_no_link():
    """Sizes whose ratio allows a link: each of two members asks the class of the other."""
    import math

    def place(n):
        step = math.floor(math.log(n) / math.log(100 / nd.NEED) + 1e-9)
        return step // 2, {step // 2, step // 2 + (-1 if step % 2 == 0 else 1)}

    for n in range(1, 1500):
        for m in range(n, 4 * n // 3 + 1):
            assert place(m)[0] in place(n)[1] and place(n)[0] in place(m)[1], (n, m)


def test_rows_of_one_id_go_by_their_texts(spark):
    same, other = "a b c d e f g h i j k l", "q r s t u v w x y z and more of it"
    rows = [(1, same), (2, same), (2, other), (3, other + " more"), (None, same), (4, None), (4, ""), (5, same), (5, same)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, th string, n int")
    kept = sorted((str(r.doc_id), str(r.text)) for r in nd.without_copies(df).select("doc_id", "text").collect())
    assert kept == sorted([("1", same), ("2", other), ("None", same), ("4", "None"), ("4", "")])
