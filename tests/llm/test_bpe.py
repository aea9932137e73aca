import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulseforge.llm import bpe

ODD = [
    "", " ", "  ", "\n", "\n\n", "a\n\n", "a\n\n\nb", "a  b", "a   b", " a", "a ", "a \nb", "a\n b", "a\n \nb", "a\t b", "\ta", "a  b", "a\x1cb c",
    "It's we'll don't I'm they've 'LL 'S", "aaaa aaaaaaa aaa", "ÉCOLE été été ΣΑΣ İstanbul ß ﬁ ½ Ⅷ", "<|endoftext|> x<|startoftext|>y <|endoftext|><|endoftext|>z", "日本語 テスト 🙂🙃 ‍﻿", "1234 5 67,8.9 $%^&*()!!!??", "x" * 3000, "é" * 700 + " abc" * 900, "́ ̈a ̀",
    "a b 　c", "tab\tand\r\nnew\x0bline\x0c.", "don’t “quote” — dash…",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    own = bpe.Encoder(bpe.load_tables(public_tokenizers.path(name)), most=50)
    real = Tokenizer.from_file(public_tokenizers.path(name))
    for text in ODD:
        ids, _ = own.encode([text])
        assert ids.tolist() == real.encode(text, add_special_tokens=False).ids, text
    ids, sizes = own.encode(ODD)
    assert ids.tolist() == [i for t in ODD for i in real.encode(t, add_special_tokens=False).ids]
    assert sizes.tolist() == [len(real.encode(t, add_special_tokens=False).ids) for t in ODD]


def test_query_equals_library(spark):
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in bpe.op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = real.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(real.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7), (2, "a b", 8)], "doc_id long, text string, ids int")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_documents(df, path).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in rows) == [(0, 2, "a</w> b</w>"), (1, 0, ""), (1, 0, ""), (2, 2, "a</w> b</w>")]
    assert bpe.encode_documents(df.limit(0), path).count() == 0
    back = bpe.decode_ids(bpe.encode_documents(df, path), path).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in rows)
