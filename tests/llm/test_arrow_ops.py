"""Quality, pseudonyms, records and language against brute force, round trips and held-out accuracy."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaframe.llm import bpe_words, crossparse, decontam, feistel, partenum, pretokens, quality_qda, queries, records, secret_scan

DOCS = "doc_id long, text string, n_chars long, _score2 double"
ODD = [None, "", " ", "…", "a", "x" * 50_000, "don't we'll 'sup !!'s\n\n <|endoftext|> é́Σσİß 中١²", "same", "same"]


def odd(spark):
    return spark.createDataFrame([(i, t, None, 0.5) for i, t in enumerate(ODD)] + [(None, "null id", 1, None), (3, "again", 1, 1.0)], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize(("name", "words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_split_gives_the_tokenizers_pieces(name, words):
    rng, e = random.Random(4), pretokens.Encoder(public_tokenizers.path(name))
    alphabet = "abSTre'lvmd  \n\t1²٣é́Σσİß中!?-_ '  \U0001d518́J̌"
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["", " ", "'", "''s", "'s's"]
    plain = [pretokens.folded(t) for t in many] if words else many
    cp, a, b, at = pretokens.split(plain, words)
    joined = "".join(plain)
    ids = e.encode([joined[x:y] for x, y in zip(a.tolist(), b.tolist())])
    for i, t in enumerate(many):
        assert [k for q in range(at[i], at[i + 1]) for k in ids[q]] == e.encode_whole(t)


@pytest.mark.parametrize(("name", "words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_code_point_is_split_as_the_tokenizer_does(name, words):
    e = pretokens.Encoder(public_tokenizers.path(name))
    texts = [f"x{chr(cp)}b" for cp in range(0x80, 0x32000) if not 0xD800 <= cp < 0xE000]
    plain = [t for t in texts if not e.special(t)]
    assert len(plain) > 100_000
    folded = [pretokens.folded(t) for t in plain] if words else plain
    cp, a, b, at = pretokens.split(folded, words)
    joined = "".join(folded)
    ids = e.encode([joined[x:y] for x, y in zip(a.tolist(), b.tolist())])
    whole = [x.ids for z in range(0, len(plain), 5000) for x in e.whole.encode_batch_fast(plain[z : z + 5000], add_special_tokens=False)]
    assert [t for i, t in enumerate(plain) if [k for q in range(at[i], at[i + 1]) for k in ids[q]] != whole[i]] == []


def test_records_round_trip(spark, tmp_path):
    docs = odd(spark)
    path = records.write(docs, public_tokenizers.path("byte_bpe_50k.json"), path=f"file://{tmp_path}/out", parts=3)
    rows = records.read(spark, path).orderBy("start").collect()
    e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((-1 if r.doc_id is None else r.doc_id, e.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()))
    got = sorted(((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in rows))
    assert got == want
    assert [r.doc_id is None and -1 or r.doc_id for r in rows] == sorted(r.doc_id is None and -1 or r.doc_id for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    part = spark.read.parquet(f"{path}/parts").orderBy("part").collect()[-1]
    assert list(records.load_record(path, part.part, part.records - 1)[1]) == list(rows[-1].ids)
    raw = bytearray(records.frame(5, np.array([1, 2, 3]), 2))
    raw[-6] ^= 1
    with pytest.raises(ValueError, match="payload"):
        records.unframe(memoryview(bytes(raw)), 0)
    empty = records.write(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), path=f"file://{tmp_path}/none", parts=2)
    assert records.read(spark, empty).count() == 0


def test_op8(spark, sf_dir, texts):
    e, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = {r.doc_id: r for r in queries.op8_token_records(spark, sf_dir).collect()}
    for i in sorted(texts):
        ids = np.array([*e.encode(texts[i].text, add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_feistel_permutes_and_undoes():
    p = feistel.Permutation(b"k")
    for n in (2, 3, 10, 97, 1000):
        assert sorted(p(i, n, b"t") for i in range(n)) == list(range(n))
    for kind, value in (
        ("email", "Jo.Doe+7@mail.example.com"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ip", "10.0.0.1"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("ssn", "123-45-6789"),
        ("phone", "+1 (643) 555-5742"), ("phone", "643-555-5742"), ("card", "4111 1111 1111 1111"),
        ("date", "1/2/2020"), ("date", "12.27.2024"), ("date", "03/4/1999"),
    ):
        new = feistel.pseudonym(kind, value, p)
        assert new != value and len(new) == len(value) or kind == "ip"
        assert new != value and feistel.VALUE.fullmatch(new).lastgroup == kind and feistel.pseudonym(kind, new, p, back=True) == value
    assert feistel.pseudonym("date", "2023-02-29", p) is None and feistel.pseudonym("ip", "300.1.1.1", p) is None
    card = feistel.pseudonym("card", "4111 1111 1111 1111", p).replace(" ", "")
    assert feistel.luhn(card[:-1]) == int(card[-1])


def test_pseudonyms_link_and_leave_the_rest(spark, texts):
    one, two = "call +1 (643) 555-5742 or a.b@x.example.org now", "again +1 (643) 555-5742, born 1999-12-31, 12345, 1.2.3"
    docs = spark.createDataFrame([(1, one, 1, 1.0), (2, two, 1, 1.0)], DOCS).unionByName(odd(spark))
    out = feistel.pseudonymise(docs).collect()
    assert len(out) == docs.count()
    by = {r.text for r in out if r.text}
    a, b = out[0].text, out[1].text
    assert a[5:22] == b[6:23] != "+1 (643) 555-5742" and "a.b@" not in a and b.endswith("12345, 1.2.3") and "1999-12-31" not in b
    assert {t for t in ODD if t} <= by and out[0]["_n_phone"] == out[0]["_n_email"] == 1
    restored = feistel.pseudonymise(spark.createDataFrame([(1, a, 1, 1.0)], DOCS), back=True).first()
    assert restored.text == one


def test_values_are_found_beside_other_words_and_numbers():
    p = feistel.Permutation(b"k")
    iban, card = "DE89370400440532013000", "4111111111111111"
    new = {v: feistel.pseudonym(k, v, p) for k, v in (("iban", iban), ("iban", "DE89 3704 0044 0532 0130 00"), ("card", card), ("card", "4111 1111 1111 1111"), ("date", "12/27/2024"))}
    for text, values in (
        (f"{iban} 2 times", [iban]), ("DE89 3704 0044 0532 0130 00 USD 500", ["DE89 3704 0044 0532 0130 00"]), ("PO12 4111 1111 1111 1111", ["4111 1111 1111 1111"]), (f"AB12 {iban}", [iban]),
        (f"{card} 12/27", [card]), (f"12 {card} 99", [card]), (f"{card} 12/27/2024", [card, "12/27/2024"]), ("55 4111 1111 1111 1111 22", ["4111 1111 1111 1111"]), (f"{card} {card}", [card, card]),
    ):
        want, at = text, 0
        for v in values:
            i = want.index(v, at)
            want, at = want[:i] + new[v] + want[i + len(v) :], i + len(v)
        got, counts = feistel.replaced(text, p)
        assert got == want and sum(counts.values()) == len(values), text
        assert feistel.replaced(got, p, back=True)[0] == text, text
    text = f"1234567890123 {card}"  # a number that is no card's and a card
    got, counts = feistel.replaced(text, p)
    assert got == f"1234567890123 {new[card]}" and counts == {"card": 1} and feistel.replaced(got, p, back=True)[0] == text
    assert feistel.pseudonym("card", "4111-1111-1111-1112", p) is None and feistel.replaced("4111-1111-1111-1112", p)[0] == "4111-1111-1111-1112"


def test_dates_keep_their_form():
    p = feistel.Permutation(b"k")
    for a in range(1, 32):
        for shape in ("{}/{}/2001", "{:02d}.{:02d}.1987"):
            value = shape.format(a, 5)
            new = feistel.pseudonym("date", value, p)
            assert [len(x) for x in re.split("[/.]", new)] == [len(x) for x in re.split("[/.]", value)] and feistel.pseudonym("date", new, p, back=True) == value
    month_first = feistel.pseudonym("date", "12/27/2024", p).split("/")
    assert int(month_first[0]) <= 12 < int(month_first[1])


def test_pii_query_against_an_independent_scan(spark, sf_dir, texts):
    """Addresses and card numbers, found by plain patterns, are gone; equal ones have equal pseudonyms; other texts stay as they are."""
    seen = {}
    for r in queries.op7_feistel_pii(spark, sf_dir).collect():
        text, n = texts[r.doc_id].text, sum(r[f"n_{k}"] for k in feistel.KINDS)
        assert n or text == r.text
        for pattern in (r"[a-z0-9.]+@[a-z.]+[a-z]", r"(?<!\d)\d{16}(?!\d)"):
            old, new = (re.findall(pattern, t or "") for t in (text, r.text))
            assert len(old) == len(new)
            for a, b in zip(old, new):
                card = a.isdigit()
                check = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(a[:-1]))) if card else 0
                real = not card or (check + int(a[-1])) % 10 == 0
                assert (a != b) == real and seen.setdefault(a, b) == b


def test_added_columns_whose_names_are_taken(spark):
    taken = "doc_id long, text string, _spans string, _new int, _n_words int, _h long, _id long, _lang string, _score double, _n_email string, _doc int, n_hit int, items int"
    row = (1, "mail a.b@x.org password: hunter22x one two three four five six seven eight nine ten", "s", 1, 2, 3, 4, "l", 0.5, "e", 9, 8, 7)
    docs = spark.createDataFrame([row], taken)
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    model = crossparse.Model({"xx": ["one two three"]})
    same = lambda r: tuple(r[c] for c in docs.columns if c != "text") == row[:1] + row[2:]
    for out in (decontam.contamination(docs, bench), secret_scan.with_spans(docs), secret_scan.redact(docs), crossparse.identify(docs, model), feistel.pseudonymise(docs), partenum.keep_one(docs)):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.columns[: len(docs.columns)] == docs.columns and same(out.first())
    assert decontam.clean(docs, bench).count() == 0


def test_quality_against_closed_form(spark, sf_dir, texts):
    """The scores of the query against class means and covariances computed on collected statistics."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = {k: quality_qda.statistics([r.text or ""], quality_qda._classes())[0] for k, r in texts.items()}
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    own = {c: np.array([x[k] for k, q in labels.items() if q == c and k in x and fold(k) != 2]) for c in (0, 1)}
    d, total = len(quality_qda.FEATURES), sum(map(len, own.values()))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in own.values()) / total
    log = {}
    for c, v in own.items():
        cov = 0.5 * np.cov(v.T, bias=True) + 0.5 * pooled
        cov = 0.98 * cov + 0.02 * (np.trace(cov) / d + 1e-6) * np.eye(d)
        log[c] = {k: np.log(len(v)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (y - v.mean(0)) @ np.linalg.solve(cov, y - v.mean(0)) for k, y in x.items()}
    for r in queries.op3_quality_qda(spark, sf_dir).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(0.5 * (log[1][r.doc_id] - log[0][r.doc_id]), -500, 500))), abs=1e-6)


def test_shard_slots_of_the_query(spark, sf_dir):
    rows = queries.op9_jump_sharding(spark, sf_dir).collect()
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)


def test_words_and_pieces_that_a_polynomial_hash_confuses(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{two} {one}")], "doc_id long, text string")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in bpe_words.encode(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [i.tolist() for i in records.Tokens(public_tokenizers.path("byte_bpe_50k.json"))([one, two])] == [t.encode(x, add_special_tokens=False).ids for x in (one, two)]


def test_many_spans_in_one_text(spark):
    """40,000 tokens in one text: the frames after and before a span grow, they are not computed anew."""
    text = " ".join(f"{i:024x}" for i in range(40_000)) + " user: someone"
    began = time.time()
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("spans").alias("n")).first()
    assert row.n >= 40_000 and time.time() - began < 60


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(score) + 0.5


def test_quality(spark, texts):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_quality_qda(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    score, label = np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])
    assert auc(score, label) > 0.98 and all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_qda.classify(odd(spark), labels).collect()
    assert len(out) == len(ODD) + 2 and {r["_score"] for r in out} == {1.0}
    assert {r["_score"] for r in quality_qda.classify(odd(spark), labels.limit(0)).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    out = quality_qda.classify(odd(spark), some).collect()
    assert all(0 <= r["_score"] <= 1 for r in out)
    assert quality_qda.keep_good(odd(spark), some, least=0.0).count() == len(ODD) + 2
    assert quality_qda.classify(odd(spark).limit(0), some).count() == 0


def test_statistics_match_plain_counts():
    import re

    row = dict(zip(quality_qda.FEATURES, quality_qda.statistics(["The cat$$ sat | on\nthe MAT, 12 the"], quality_qda._classes())[0]))
    words = "The cat$$ sat | on the MAT, 12 the".split()
    assert row["log_words"] == pytest.approx(np.log1p(len(words))) and row["word_length"] == pytest.approx(np.log1p(sum(map(len, words)) / len(words)))
    assert row["marked_words"] == pytest.approx(np.log(2 / 9 + 0.002)) and row["bar_words"] == pytest.approx(np.log(1 / 9 + 0.002))
    assert row["distinct_words"] == pytest.approx(8 / 9) and row["upper"] == pytest.approx(np.log(4 / len(re.findall("[A-Za-z]", " ".join(words))) + 0.002))


def test_language(spark, sf_dir, texts):
    rows = queries.op10_crossparse_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_parse_is_the_greedy_one_and_edges(spark):
    sample = {"xx": ["abra cadabra abra", "barn"], "yy": ["noon moon", "no monsoon"]}
    model = crossparse.Model(sample)

    def brute(text, lang):
        joined, text, i, n = "\0".join(map(crossparse.normal, sample[lang])), crossparse.normal(text), 0, 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in joined:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        return n

    rng = random.Random(1)
    texts = ["".join(rng.choice("abrcdnomsZ é12 ") for _ in range(rng.randrange(1, 900))) for _ in range(40)] + ["", "a", "  a", "abra", "abra cadabra " * 90, "noon" * 300, "zz" * 400]
    counts, _, _ = model.phrases(texts, model.lookup())
    assert counts.tolist() == [[brute(t, k) for t in texts] for k in model.langs]
    out = crossparse.identify(odd(spark), model).collect()
    assert len(out) == len(ODD) + 2 and [r["_lang"] for r in out[:4]] == ["und"] * 4 and out[4]["_lang"] != "und"
    none = crossparse.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["_lang"] for r in crossparse.identify(odd(spark), none).collect()} == {"und"}


def test_languages_of_many_letters_and_many_languages(spark):
    """Two languages of 512 ideographs each, thirty of a few Latin letters with texts of any length, all learnt and told apart."""
    rng = random.Random(3)
    alphabets = {f"c{i}": [chr(0x4E00 + 512 * i + k) for k in range(512)] for i in range(2)} | {f"l{i:02}": rng.sample("abcdefghijklmnopqrstuvwxyz", 9) for i in range(30)}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(2, 6))) for _ in range(60)] for k, v in alphabets.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, rng.choice([1, 2, 30, 200])), k) for i, k in enumerate(k for k in words for _ in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crossparse.fit(docs)
    assert model.langs == sorted(words) and model.nbytes < 32 * 2_600_000
    asked = spark.createDataFrame([(i, text(k, 30), k) for i, k in enumerate(k for k in words for _ in range(5))], "doc_id long, text string, lang string")
    got = crossparse.identify(asked, model).collect()
    assert sum(r["_lang"] == r.lang for r in got) >= 0.97 * len(got)


