"""Decontamination against a brute-force version."""

import hashlib
import random
import re

from lumaframe.llm import decontam, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(rows, docs, items):
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    for r in rows:
        n, h, found = brute(r.text, items)
        assert (r["_n_words"], r["_n_hit"], r["_items"]) == (n, h, found), (r.doc_id, r.text)
        assert r["_contaminated"] == (h > 0 and 20 * h >= n)


def test_random_texts(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "Σας", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 9, 12, 13, 14, 30])))) for i in range(30)] + [(30, ""), (31, None), (None, "alone in the world"), (30, "Same Item TWICE")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            b = words(items[rng.randrange(30)][1])
            a = rng.randrange(len(b))
            parts += [" - ".join(x.upper() if x.isascii() else x for x in b[a : a + rng.randrange(5, 40)]), " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))]
        docs.append((i, "... ".join(parts)))
    docs += [(80, None), (81, ""), (None, items[6][1]), (3, docs[3][1]), (3, items[7][1]), (82, "x " * 3000 + (items[8][1] or ""))]
    out = decontam.contamination(
        spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, items string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n long"),
    ).collect()
    assert len(out) == len(docs)
    check(out, docs, [("null" if i is None else i, t) for i, t in items])


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in decontam.contamination(docs, none).collect()] == [(1, "a b c", 3, 0, [], False)]
    assert decontam.contamination(docs.limit(0), none).count() == 0
    assert decontam.clean(docs, none).collect() == docs.collect()


def test_query(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_winnow_decontam(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, h, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
