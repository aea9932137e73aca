"""The quality model: n-grams and counts against plain forms, the optimum of the fit, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from pulseforge.llm import common, quality

M = (1 << 64) - 1
TEXTS = [None, "", " \n\t", "Ein Wort", "the the the THE", "ABC abc! x9 ### a.b.c naïve Ü -- ?", " führt  vor\n\nund  nach ", "wort*** wort%%% Mixed CaSe 12,5", "a", "q " * 40, "\x00 \x0b z"]


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_words(text):
    out = []
    for word in (text or "").encode().split():
        part = [0 if quality.KIND[b] == 4 else b + 32 if 65 <= b <= 90 else b for b in word]
        h = sum(mix(p + (i << 8) + 1) for i, p in enumerate(part) if p) & M
        upper, low = sum(65 <= b <= 90 for b in word), sum(97 <= b <= 122 or b >= 128 for b in word)
        case = (1 if low else 0) if not upper else 4 if not low else 2 if upper == 1 and 65 <= word[0] <= 90 else 3
        marks, last = sum(bool(quality.KIND[b] == 4) for b in word), word[-1] if quality.KIND[word[-1]] == 4 else 0
        back = next((k for k in (1, 2, 3) if len(out) >= k and h and out[-k][0] == h), 0)
        shape = case + 8 * last + (min(marks, 4) << 11) + (min(len(word) // 2, 15) << 14) + (back << 18) + (any(48 <= b <= 57 for b in word) << 20)
        out.append((h, shape))
    return out


def plain_features(text):
    w = plain_words(text)
    h, shape = [x[0] for x in w], [x[1] for x in w]
    coarse = [s & ~(15 << 14) for s in shape]
    found = set()
    for salt, grams in ((1, [h]), (2, [h, h]), (3, [shape]), (4, [coarse] * 2), (5, [coarse] * 3)):
        for i in range(len(w) - len(grams) + 1):
            x = salt
            for k, g in enumerate(grams):
                x = mix((x * quality.ODD + g[i + k]) & M)
            found.add(x >> (64 - quality.BITS))
    return found


def test_features_equal_plain_form():
    at, doc = quality.distinct(*quality.features(TEXTS))
    for i, t in enumerate(TEXTS):
        assert set(at[doc == i].tolist()) == plain_features(t)
    assert len(quality.features([None, ""])[0]) == 0 == len(quality.features([])[0])


def test_counts_equal_plain_form(spark):
    rows = [(i, i % 2, t) for i, t in enumerate(TEXTS * 7) if t is not None]
    got = quality.counts(spark.createDataFrame(rows, "id long, y int, text string").repartition(5))
    want = np.zeros_like(got)
    for _, y, t in rows:
        want[y, list(plain_features(t))] += 1
    assert (got == want).all()


def test_descent_reaches_the_optimum():
    """The duality gap closes: the primal value is that of the multipliers, so no other weights are better."""
    r = np.random.default_rng(1)
    dense = r.random((80, 30)) < 0.3
    y = np.where(dense[:, :10].sum(1) + r.normal(0, 1, 80) > 3, 1.0, -1.0)
    rows = [np.append(np.flatnonzero(d), 30) for d in dense]
    x = [r.normal(1, 0.1, len(v)) for v in rows]
    cost = np.where(y > 0, 0.7, 1.3)
    w = quality.descent(rows, x, y, 31, cost, 5000, 1e-10)
    full = np.zeros((80, 31))
    for i, (v, z) in enumerate(zip(rows, x, strict=True)):
        full[i, v] = z
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (full @ w))).sum()
    # the multipliers of w by least squares within their bounds: w is their sum of rows
    scipyless = np.clip(np.linalg.lstsq((full * y[:, None]).T, w, rcond=None)[0], 0, cost)
    assert primal(w) <= min(primal(w + 1e-3 * r.normal(size=31)) for _ in range(300))
    assert primal(w) <= primal((full * y[:, None]).T @ scipyless) + 1e-9
    a, b = quality.sigmoid_of(full @ w, y)
    p = 1 / (1 + np.exp(-(a * (full @ w) + b)))
    assert a > 0 and abs(p.mean() - (y > 0).mean()) < 0.02


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op11_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held) and sum(v.held_out for v in got.values()) > len(held)
    right = np.mean([got[r.doc_id].predicted == r.quality for r in held])
    assert len(held) > 60 and right > 0.93
    assert all(0 <= v.score <= 1 and v.predicted == (v.score >= 0.7) for v in got.values()) and len(got) == 1000


def test_model_learns_and_scores_odd_rows(spark):
    good = [(i, f"the plain text number {i} reads well and goes on, sentence {i % 7} by sentence.") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} $$$ CLICK### HERE!!" * (1 + i % 3)) for i in range(60)]
    odd = [(None, "no id"), (500, None), (501, ""), (502, "LONG!! " * 300_000), (1, "the plain text again"), (1, "the plain text again")]
    docs = spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in good + bad + odd], "doc_id long, text string, score double, y int, key string")
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(500, 1), (None, 0), (7, None), (8, 3), (9, 1), (9, 1), (999, 1)]
    marks = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, text string")
    model = quality.fit(docs, marks)
    got = [tuple(r) for r in quality.score(docs, model).collect()]
    assert len(got) == len(good + bad + odd)
    scores = dict(got)
    assert all(scores[i] > 0.7 for i, _ in good) and all(scores[i] < 0.3 for i, _ in bad) and scores[502] < 0.5
    assert scores[500] == scores[501] and 0 <= scores[501] <= 1
    again = quality.fit(docs.repartition(7), marks.repartition(3))
    assert (again["w"] == model["w"]).all() and again["b"] == model["b"]
    few = quality.fit(docs, marks, sample=30)
    assert len(few["w"]) == len(model["w"]) and (few["w"] != model["w"]).any()
    named = quality.score(docs.select(docs.doc_id.cast("string").alias("name"), docs.text.alias("body")), model, "name", "body")
    assert named.columns == ["name", "score"] and dict(named.where("name = '3'").collect())["3"] == scores[3]


@pytest.mark.parametrize("kept", ["quality = 1", "false"])
def test_untaught(spark, kept):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").where(kept)
    model = quality.fit(docs, marks)
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), model).count() == 0
    assert len(quality.fit(docs.limit(0), marks)["at"]) == 0
