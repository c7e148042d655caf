"""Cleaning of the documents table in stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded texts. Null ids, empty texts, repeated rows
and empty tables are handled as the operators of lumaframe.llm state it.
"""

from lumaframe.llm import bpe_words, decontam, partenum, quality_qda, secret_scan
from lumaframe.llm.queries import vocabulary
from lumaframe.llm.storage import written
from lumaframe.tables import table


def quality(spark, docs, sf_dir):
    """Documents with a quality score under 0.7 go."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"), least=0.7)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by a shingle similarity of 0.75 or more, the one with the least id stays."""
    return partenum.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents of whose words one in twenty or more stand in a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def encoding(spark, docs, sf_dir):
    """doc_id and token ids of every document, with their number and digests."""
    return bpe_words.digested(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]
#: Neither a covariance model nor a tokenizer can be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
