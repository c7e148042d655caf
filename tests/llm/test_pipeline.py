"""The stages against brute force, each on its own input."""

import public_tokenizers
from test_decontam import brute as contaminated
from test_native import base_spans
from test_partenum import brute as classes
from tokenizers import Tokenizer

import corpus_pipeline
from lumaframe.llm import storage

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = storage.written(stage(spark, docs, SF), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count()
        if i < 4:
            assert out.columns == docs.columns
        if name == "quality":
            assert sum(k in after for k, q in labels.items() if q == 1) >= 0.99 * sum(q == 1 for q in labels.values())
            assert sum(k in after for k, q in labels.items() if q == 0) <= 0.02 * sum(q == 0 for q in labels.values())
            assert all(after[k] == before[k] for k in after)
        elif name == "near_duplicates":
            want = {c for _, k, n, c in classes([(k, r.text) for k, r in before.items()]) if n}
            assert {k for k in after} == want | {k for k, r in before.items() if not r.text.split()}
        elif name == "decontamination":
            gone = set()
            for k, r in before.items():
                n, h, _ = contaminated(r.text, items)
                if h and 20 * h >= n:
                    gone.add(k)
            assert set(after) == set(before) - gone and gone
        elif name == "secrets":
            assert set(after) == set(before)
            for k, r in before.items():
                spans = base_spans(r.text)
                assert not base_spans(after[k].text) and (spans or after[k].text == r.text or "[SECRET]" in after[k].text) and after[k].n_chars == len(after[k].text)
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {k: r.n_tokens for k, r in after.items()} == {k: len(t.encode(r.text, add_special_tokens=False).ids) for k, r in before.items()}
        docs = out


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoding_returns_the_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, "It's the words of it", "en"), (None, "no id", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    rows = corpus_pipeline.encoding(spark, docs, SF).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {k: t.encode(s or "", add_special_tokens=False).ids for k, s, _ in docs.collect()}
    assert all(r.n_tokens == len(r.ids) for r in rows)
