"""The thin queries opN_<name>: the operators of this package over whole tables, with the columns agreed for each."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import bpe_words, crossparse, decontam, feistel, jump_shard, multi_index, partenum, quality_qda, records, secret_scan


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer's file, in `folder` or where the package public_tokenizers keeps them."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_words(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    return bpe_words.digested(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json", tokenizers)).drop("ids")


def op2_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"),
    )


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (crossparse.fold(F.col("doc_id")) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.classes(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_index.links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("_id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["order"] < len(secret_scan.BASE))
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(_spans, s -> s.order = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(secret_scan.BASE)),
        F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"), secret_scan.spelled(F.col("_spans")).alias("spans"),
    )


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feistel.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", *(F.col(f"_n_{k}").alias(f"n_{k}") for k in feistel.KINDS))


def op8_token_records(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    path = records.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json", tokenizers))
    return records.read(spark, path, with_ids=False)


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shard.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_crossparse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = crossparse.identify(docs.select("doc_id", "text"), crossparse.fit(docs))
    return found.select("doc_id", (crossparse.fold(F.col("doc_id")) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES = {f.__name__: f for f in (op1_bpe_words, op2_winnow_decontam, op3_quality_qda, op4_partenum_jaccard, op5_multi_index, op6_secret_scan, op7_feistel_pii, op8_token_records, op9_jump_sharding, op10_crossparse_language)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _parts(order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    fit = " AND ".join([f"length(h[i]) >= {least}", *(f"regexp_matches(h[i], '{m}')" for m in secret_scan.MIXED if pattern == secret_scan.KEY)])
    return f"""SELECT doc_id, {order} AS k, e - length(f[i]) AS s, e FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(f[1:i], lambda x: length(x))) AS BIGINT) AS e
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS f, regexp_extract_all(text, '{quoted}', {group}) AS h, regexp_split_to_array(text, '{quoted}') AS g FROM t WHERE regexp_matches(text, '{quoted}')), unnest(range(1, len(f) + 1)) u(i)) WHERE {fit}"""


_ROLE = "CASE k " + " ".join(f"WHEN {i} THEN '{k[4]}'" for i, k in enumerate(secret_scan.KINDS)) + " END"
_SPELLED = "concat(CASE k " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(secret_scan.KINDS)) + " END, ':', s, ':', e)"

ORACLES: dict[str, str] = {
    "op6_secret_scan": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({" UNION ALL ".join(_parts(i, k[1], k[2], k[3]) for i, k in enumerate(secret_scan.KINDS))}),
r AS (SELECT *, {_ROLE} AS role FROM p),
n AS (SELECT *, max(role = 'id') OVER near AS i, max(role = 'secret') OVER near AS x, max(role = 'endpoint') OVER near AS z,
    max(CASE WHEN k < 3 THEN e END) OVER (PARTITION BY doc_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_end,
    min(CASE WHEN k < 3 THEN s END) OVER (PARTITION BY doc_id ORDER BY s, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS base_start
    FROM r WINDOW near AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN 400 PRECEDING AND 400 FOLLOWING)),
l AS (SELECT * FROM n WHERE k < 3 OR (coalesce(base_end, 0) <= s AND (base_start IS NULL OR base_start >= e) AND CASE role WHEN 'id' THEN x WHEN 'secret' THEN i ELSE i AND x END)),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg({_SPELLED}, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg({_SPELLED}, ',' ORDER BY s, k) AS spans FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)""",
    "op2_winnow_decontam": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
wi AS (SELECT item, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
g AS (SELECT win, n, list(DISTINCT item) AS items FROM wi GROUP BY win, n),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM g), unnest(range(1, len(w) - n + 2)) t(s)),
h AS (SELECT doc_id, s, n, items FROM dw JOIN g USING (win, n)),
p AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list_distinct(flatten(list(items)))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op4_partenum_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
}
