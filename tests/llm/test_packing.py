import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulseforge.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pieces_are_whole(rows, docs, window=2048):
    real = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for key, text in docs:
        ids = [*real.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    pieces_are_whole(packing.op6_packing(spark, "/root/testdata/sf0.001").collect(), [(d.doc_id, d.text) for d in docs])


def test_edges(spark):
    texts = [None, "", "a", "b c " * 3000, "x\n\n\ny  z", "same", "same"]
    df = spark.createDataFrame([(i, t, 0, 9) for i, t in enumerate(texts)], "doc_id long, text string, length int, offset int").repartition(2)
    from pyspark.sql import functions as F

    rows = packing.pack(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    pieces_are_whole(rows, list(enumerate(texts)))
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_lots_keep_everything():
    rng = np.random.default_rng(3)
    packer, out, want = packing.Packer(64, 5), [], {}
    for key in range(400):
        ids = rng.integers(0, 9, int(rng.integers(1, 200))).astype("<u4").tobytes()
        want[key] = ids
        out += packer.add(key, ids)
        if key % 90 == 89:
            out += packer.flush(False)
    out += packer.flush(True)
    got, fill = defaultdict(dict), defaultdict(int)
    for key, start, ids, _, number, _ in out:
        got[key][start] = ids
        fill[number] += len(ids) // 4
    assert {k: b"".join(v for _, v in sorted(p.items())) for k, p in got.items()} == want
    assert sum(64 - n for n in fill.values() if n & (n - 1)) == 0


def test_nnls_fits():
    a = packing.combinations(16).T
    x = np.zeros(a.shape[1])
    x[[1, 5, 9]] = [4, 7, 2]
    y = packing.nnls(a, a @ x)
    assert (y >= 0).all() and np.abs(a @ y - a @ x).max() < 1e-6
