"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumaframe.llm import bpe_words, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_query_matches_the_library(spark, sf_dir):
    t = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_bpe_words(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges_with_and_without_frequent_words(spark, monkeypatch):
    t = Tokenizer.from_file(PATH)
    texts = [None, "", " \n", "It's the the THE don't İstanbul ΑΣ ΑΣΑ J̌ 12³ <|endoftext|> tail", "Ünïcode wörds 中文字 🙂🙂 !!'s", "x" * 3000, "the " * 5000, "same text", "same text"]
    data = [(i, s, "a") for i, s in enumerate(texts)] + [(None, "no id", "a"), (7, "same text", "b"), (7, "another", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string")
    for limit in (0, 3, 1000):
        monkeypatch.setattr(bpe_words.frequent, "__defaults__", (limit,))
        out = bpe_words.decode(bpe_words.encode(docs, PATH), PATH).collect()
        want = sorted((-1 if i is None else i, e.ids, t.decode(e.ids, skip_special_tokens=False)) for i, s, _ in data for e in [t.encode(s or "", add_special_tokens=False)])
        assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids), r.decoded) for r in out) == want
    assert bpe_words.encode(docs.limit(0), PATH).count() == 0


def test_digests_are_of_what_encode_and_decode_return(spark):
    docs = spark.createDataFrame([(1, "It's the wörds <|endoftext|>"), (None, "no id"), (3, None)], "doc_id long, text string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {r.doc_id: (list(r.ids), len(r.ids), sha(np.array(r.ids, "<u4").tobytes()), sha(r.decoded.encode())) for r in bpe_words.decode(bpe_words.encode(docs, PATH), PATH).collect()}
    assert {r.doc_id: (list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_words.digested(docs, PATH).collect()} == want


def test_decode_of_null_and_foreign_ids(spark):
    t = Tokenizer.from_file(PATH)
    tokens = spark.createDataFrame([(1, None), (2, []), (3, [5, None, -1, 10**6, 7])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe_words.decode(tokens, PATH).collect()} == {1: None, 2: "", 3: f"{t.id_to_token(5)} {t.id_to_token(7)}"}
