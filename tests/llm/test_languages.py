import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulseforge.llm import languages as lg


def model_of(texts):
    langs, cols = sorted(texts), []
    for lang, text in texts.items():
        for lang_, *rest in lg.counted(lang, Counter(lg.words_of(text))):
            cols.append([np.full(len(lang_), langs.index(lang), np.int16), *rest])
    names = ["lang", "n", "hash", "ctx", "sfx", "begins", "count"]
    table = {n: np.concatenate([c[i] for c in cols]) for i, n in enumerate(names)}
    return lg.estimate(langs, {n: v.view(np.uint64) if v.dtype == np.int64 and n != "count" else v for n, v in table.items()})


def by_hand(text, order=lg.ORDER, size=None):
    """Kneser-Ney with dictionaries: p(context, char)."""
    raw = [Counter() for _ in range(order + 1)]
    for w in text.lower().split():
        s = "\x02" + w + "\x02"
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                raw[k][s[i - k + 1 : i + 1]] += 1
    amounts = [None]
    for k in range(1, order + 1):
        if k == order:
            amounts.append(dict(raw[k]))
            continue
        left = Counter(g[1:] for g in raw[k + 1])
        amounts.append({g: raw[k][g] if k > 1 and g[0] == "\x02" else max(left[g], 1) for g in raw[k]})
    size = size or len(raw[1]) + 1

    def p(ctx, c):
        k = len(ctx) + 1
        below = 1 / size if k == 1 else p(ctx[1:], c)
        mine = {g: a for g, a in amounts[k].items() if g[:-1] == ctx}
        if not mine:
            return below
        n1, n2 = sum(a == 1 for a in amounts[k].values()), sum(a == 2 for a in amounts[k].values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total = sum(mine.values())
        return max(mine.get(ctx + c, 0) - d * (ctx + c in mine), 0) / total + d * len(mine) / total * below

    return p


def test_probabilities_equal_brute_force():
    """Two languages; the size of the alphabet is that of both."""
    texts = {"xx": "the cat sat on the mat that cats saw thee then theta catta", "yy": "ein haus am see im see aus dem haus seee"}
    model = model_of(texts)
    size = len({c for t in texts.values() for c in t if c != " "}) + 2
    told = 0
    for j, lang in enumerate(model["langs"]):
        p = by_hand(texts[lang], size=size)
        words = ["the", "cats", "haus", "seen", "zq", "a"]
        got, _ = lg.word_scores(model, [w.encode() for w in words])
        for w, g in zip(words, got[:, j], strict=True):
            s = "\x02" + w + "\x02"
            want = sum(math.log(p(s[max(0, i - lg.ORDER + 1) : i], s[i])) for i in range(1, len(s)))
            assert abs(want - g) < 1e-3, (lang, w, want, g)
            told += 1
    assert told == 12


def test_one_language_equals_brute_force():
    text = "the cat sat on the mat that cats saw thee then theta catta the cat"
    model = model_of({"xx": text})
    p = by_hand(text)
    words = ["the", "cats", "haus", "seen", "zq", "a", "thetathe"]
    got, n = lg.word_scores(model, [w.encode() for w in words])
    assert n.tolist() == [len(w) + 1 for w in words]
    for w, g in zip(words, got[:, 0], strict=True):
        s = "\x02" + w + "\x02"
        want = sum(math.log(p(s[max(0, i - lg.ORDER + 1) : i], s[i])) for i in range(1, len(s)))
        assert abs(want - g) < 1e-3, (w, want, g)


def test_probabilities_sum_to_one():
    """Over the alphabet (with the end of a word, and one letter for all unknown ones) after contexts that the operator scores itself."""
    text = "the cat sat on the mat that cats saw"
    model = model_of({"xx": text})
    letters = sorted(set(text) - {" "})
    for before in ("t", "th", "ca", "sat"):
        base = lg.word_scores(model, [before.encode()])[0][0, 0]
        ends = by_hand(text)
        end = ends(("\x02" + before)[-(lg.ORDER - 1) :], "\x02")
        total = end
        for c in [*letters, "q"]:
            # p(c | before) from the scores of the two words, less their last events
            longer = lg.word_scores(model, [(before + c).encode()])[0][0, 0]
            last = ends(("\x02" + before + c)[-(lg.ORDER - 1) :], "\x02")
            total += math.exp(longer - math.log(last) - (base - math.log(end)))
        assert abs(total - 1) < 1e-3, (before, total)


def test_held_out_accuracy(spark):
    rows = lg.op5_languages(spark, "/root/testdata/sf0.01").collect()
    docs = {d.doc_id: d for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    seen = [(docs[r.doc_id].lang == r.lang_pred, r) for r in rows if r.held_out]
    assert np.mean([ok for ok, _ in seen]) > 0.95
    assert np.mean([r.accepted for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "fr"), ("un", None)], "text string, lang string")
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "the mat"), (5, "hund " * 50000), (5, "hund"), (6, "日本語"), (7, "'«»'")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = defaultdict(list)
    for r in lg.identify(df, train).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert [got[i][0].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and not got[1][0].accepted
    assert got[None][0].lang_pred == "en" and {r.lang_pred for r in got[5]} == {"de"} and got[6][0].lang_pred in ("de", "en")
    assert {r.lang_pred for r in lg.identify(df, train.limit(0)).collect()} == {"und"}
    assert lg.identify(df.limit(0), train).count() == 0


def test_large_models_keep_all_ngrams(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "vlaai kermis «mofers» sjoen aovend", "li"), (-2, "sjoen kermis a«b", None)], docs.schema)
    docs = docs.limit(80).union(rare)
    told = []
    for most in (lg.MAX_GRAMS, 5000):
        monkeypatch.setattr(lg, "MAX_GRAMS", most)
        told.append({r.doc_id: r for r in lg.identify(docs, docs.select("text", "lang")).collect()})
    model = lg.fit(docs)
    assert len(model["slices"]) > 1
    assert sum(len(rows[0]) for part in model["slices"] for rows in part.value) == lg.gram_counts(docs.where("lang is not null")).select("n", "hash").distinct().count()
    assert told[0].keys() == told[1].keys() and told[1][-2].lang_pred == "li"
    for i, a in told[0].items():
        b = told[1][i]
        assert a.lang_pred == b.lang_pred and a.n_scored == b.n_scored
        assert a.cross_entropy is None and b.cross_entropy is None or abs(a.cross_entropy - b.cross_entropy) < 1e-4


def test_calibration_rows_teach_too(spark):
    kind = "doc_id long, text string, lang string"
    train = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")], kind)
    calibration = spark.createDataFrame([(3, "vlaai kermis mofers sjoen aovend", "li"), (4, "the cat and the mat", "en")], kind)
    df = spark.createDataFrame([(5, "sjoen aovend"), (6, "the cat sat"), (7, "der hund")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in lg.identify(df, train, calibration).collect()} == {5: "li", 6: "en", 7: "de"}


def test_garbled_texts_are_rejected_and_clean_ones_stay(spark):
    """Letters of one of 40 texts are put in another order, whole or cut to several lengths, in all folds: nearly all from 60 letters on are rejected, of the others as good as none."""
    import random

    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("doc_id", "text", "lang").collect()
    rows, bad = [], {}
    for d in docs:
        text = d.text
        if d.doc_id % 40 == 7 and len(text) > 800:
            size = (60, 150, 400, 10**9)[d.doc_id // 40 % 4]
            chars = list(text[:size].replace("\n", " "))
            rng.shuffle(chars)
            text, bad[d.doc_id] = "".join(chars), size
        rows.append((d.doc_id, text, d.lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    train, calibration = lg.folds(df)
    told = {r.doc_id: r for r in lg.identify(df, train, calibration).collect()}
    caught = [not told[i].accepted for i in bad]
    assert len(bad) > 40 and np.mean(caught) > 0.9, np.mean(caught)
    fine = [r.accepted for i, r in told.items() if i not in bad and r.lang_pred != "und"]
    assert np.mean(fine) > 0.99, np.mean(fine)
    clash = df.withColumns({"lang_pred": F.lit("x"), "cross_entropy": F.lit(99.0), "row": F.lit(1)})
    kept = lg.accept_rows(clash, train, calibration)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, r in told.items() if r.accepted}
