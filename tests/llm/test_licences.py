import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pulseforge.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
T = licences.build(licences.BASE, licences.TEMPLATES)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def by_hand(text):
    words = WORD.findall(lower(text or ""))
    found = []
    for phrase, label in licences.BASE.items():
        p = phrase.split(" ")
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), found


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rows = {r.doc_id: r for r in licences.op7_licences(spark, "/root/testdata/sf0.01").collect()}
    hits = 0
    for d in docs:
        n, found = by_hand(d.text)
        r = rows[d.doc_id]
        at = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert ("gpl" in r.labels.split(",")) == ("GNU General Public License" in d.text)
        hits += r.n_base
    assert hits > 3 and len(rows) == len(docs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc software of a copy x é İ K".split() + ["under the mit license", "free of charge to any person"]), max_size=40))
def test_statistics_and_places(words):
    text = " ".join(words)
    counts, places, _ = licences.scan_texts(T, ["q", text, "the mit license"], 4, 16)
    n, found = by_hand(text)
    assert counts[1] == n
    assert sorted((at, T["labels"][k]) for k, at in set(places[1])) == sorted(found)
    ids = [T["ids"].get(w, 0) for w in licences.words_of(text)]
    whole = [" ".join(map(str, [T["ids"][w] for w in licences.words_of(t)])) for t in [*licences.BASE, *(t for _, t in licences.TEMPLATES)]]
    for end, (_, length) in enumerate(licences.statistics(T, ids)):
        best = 0
        for size in range(1, end + 2):
            part = " ".join(map(str, ids[end - size + 1 : end + 1]))
            if any(f" {part} " in f" {w} " for w in whole):
                best = size
        assert length == best


def test_edges(spark):
    long = "filler words here " * 30000 + licences.TEMPLATES[0][1].upper() + " end"
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "Under the-MIT license", "c"), (4, long, "d"), (4, long, "d")], "doc_id long, text string, labels string")
    rows = licences.scan(df).collect()
    assert len(rows) == 5
    by = {(r.doc_id or 0): r for r in rows}
    assert by[1].n_words == by[2].n_words == 0 and by[0].places[0].label == "mit"
    assert by[4].span_labels == ["mit"] and by[4].spans[0].share == 1.0 and by[4].spans[0].first == 90000
    assert licences.scan(df.limit(0)).count() == 0
