from collections import defaultdict

import corpus_pipeline as cp
from pulseforge.llm import languages, toxicity


def test_stages_follow_their_operators(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "lines", "neardup", "packing"]
    kept = cp.toxicity_stage(spark, docs, d).cache()
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in toxicity.op2_toxicity(spark, d).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    spoken = cp.language_stage(spark, docs, d)
    good = {r.doc_id for r in languages.op5_languages(spark, d).where("accepted").collect()}
    assert {r.doc_id for r in spoken.collect()} == good and spoken.columns == docs.columns
    lines = cp.line_stage(spark, docs, d)
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) for r in lines.collect())
    single = cp.neardup_stage(spark, docs, d)
    from tests.llm.test_neardup import brute

    want = {k for k, (_, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items() if k == c}
    assert {r.doc_id for r in single.collect()} == want


def test_run(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    fill, by = defaultdict(int), defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
        by[r.doc_id, r.doc_tokens] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())
    assert all(total == n for (_, total), n in by.items()) and len(by) > 100


def test_stages_on_odd_tables(spark):
    """Null, empty and repeated rows, ties, null ids, clashing and extra columns, and an empty table."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = [tuple(r) for r in docs.select(*cp.COLUMNS).limit(40).collect()]
    long_ = " ".join(f"wort{i} und der hund" for i in range(20000))
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \n ", None, "s", 3), (9004, long_, "de", "s", len(long_)), (None, "the and of", "en", "s", 10), base[0], (9005, *base[0][1:])]
    names = {"score": "x", "lang_pred": "y", "words_removed": "z", "id": "q", "__runs": "r", "component_id": "c", "row": "w"}
    rows = [(*r, *names.values()) for r in base + odd]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == cp.COLUMNS, name
        kept[name] = [tuple(r) for r in out.collect()]
        assert not [r for r in stage(spark, df.limit(0), d).collect()], name
    assert (9001, None, "en", "s", 0) in kept["toxicity"] and (9002, "", "en", "s", 0) in kept["toxicity"]
    assert not {9001, 9002, 9003} & {r[0] for r in kept["language"]} and 9004 in {r[0] for r in kept["language"]}
    lines = {r[0]: r for r in kept["lines"]}
    assert lines[9001][1] is None and lines[9002][1] == "" and lines[None][1] == "the and of"
    assert 9005 not in lines or len(lines[9005][1]) < len(base[0][1])
    assert all(r[4] == len(r[1]) for r in kept["lines"] if r[0] is not None and r[0] < 9000)
    single = [r[0] for r in kept["neardup"]]
    assert 9005 not in single and None in single and {9001, 9002} <= set(single)
    packed = cp.packing_stage(spark, df, d).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows}
    assert sum(r.length for r in packed if r.doc_id == 9001) == 1 and not cp.packing_stage(spark, df.limit(0), d).count()
