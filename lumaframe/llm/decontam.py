"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are hashed, runs of K words are hashed from those, and of every W consecutive runs the least hash is kept as a
fingerprint. A shared span of K + W - 1 words holds W consecutive runs on both sides and so the same least one: no window of
that length escapes. Fingerprints are matched by a join; each hit is then extended to every window around it, compared
word for word. Items shorter than a window have no fingerprint; they are one window each, met at every position of a text.

Edge cases: a null text has no words; a null id is an id of its own, and a null item_id is spelled "null"; rows equal in
id and text get equal results; an empty benchmark leaves every document clean; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import row_key, unused, written

WINDOW = 13
#: A fingerprint covers K words and is the least of W in a row: K + W - 1 == WINDOW.
K, W = 8, 6
#: What stands between words, before and after A-Z are put in lower case. Splitting is several times faster here than extracting.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The benchmark's fingerprints and windows are broadcast up to so many rows (16 bytes each for fingerprints); beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z in lower case; other letters as they are."""
    return words(F.translate(text, _UPPER, _LOWER))


def coarse_hashes(text: Column) -> Column:
    """The hash of each word in lower case of any script: equal wherever exact_words are equal, and faster. Only for finding candidates."""
    return F.transform(words(text), lambda w: F.xxhash64(F.lower(w)))


def _each(n: Column, f) -> Column:
    """f(i) for i from 1 to n; empty for n < 1."""
    none = F.expr("cast(array() as array<int>)")
    return F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(none), f)


# The arguments below are columns, not expressions: they are read at each position, and an expression would be computed there anew.
def runs(h: str, k: int) -> Column:
    """The hash of each k hashes in a row."""
    return _each(F.size(h) - (k - 1), lambda i: F.xxhash64(F.slice(h, i, k)))


def least(g: str, w: int) -> Column:
    """The distinct least values of each w in a row: the fingerprints."""
    return F.array_distinct(_each(F.size(g) - (w - 1), lambda i: F.array_min(F.slice(g, i, w))))


# explode_outer, as Spark puts a filter on the array below explode, and there, too, it would compute what the columns stand for at each position.
def fingerprints(hashed: DataFrame, *keep: str) -> DataFrame:
    """fp, beside the columns to keep, for each fingerprint of the word hashes in column h."""
    return hashed.select(*keep, runs("h", K).alias("g")).select(*keep, F.explode_outer(least("g", W)).alias("fp")).where("fp is not null")


def grams(hashed: DataFrame, n: int, *keep: str) -> DataFrame:
    """fp, beside the columns to keep, for each distinct run of n word hashes."""
    return hashed.select(*keep, F.explode_outer(F.array_distinct(runs("h", n))).alias("fp")).where("fp is not null")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """window (its words, joined by a blank), n words, wid; and wid, item (an id as a string) of the items that hold it, a row each: a window of all items makes no long array."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), exact_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = items.select("item", n.alias("n"), F.explode_outer(_each(F.size("w") - n + 1, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window")).distinct()
    found = written(each.select("window", "n").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return found, written(each.join(found, ["window", "n"]).select("wid", "item"), "window-items")


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """_id, _h, n_hit, items: the documents in which a window occurs, with the number of words inside any and the sorted item ids."""
    found, items = windows(benchmark, item_id, text)
    prints = written(fingerprints(benchmark.select(coarse_hashes(F.col(text)).alias("h"))).distinct(), "prints")
    short = sorted(r.n for r in found.where(F.col("n") < WINDOW).select("n").distinct().collect())
    heads = {n: written(grams(found.where(F.col("n") == n).select(coarse_hashes(F.col("window")).alias("h")), n).distinct(), "heads") for n in short}
    keyed = docs.select(F.col(doc_id).alias("_id"), row_key(text).alias("_h"), F.col(text).alias("_text"))

    # which texts hold a fingerprint
    hashed = keyed.select("_id", "_h", coarse_hashes(F.col("_text")).alias("h"))
    marks = fingerprints(hashed, "_id", "_h").join(_small(prints), "fp").select("_id", "_h")
    for n in short:
        marks = marks.unionByName(grams(hashed, n, "_id", "_h").join(_small(heads[n]), "fp").select("_id", "_h"))
    marked = written(marks.distinct().select(F.col("_id").alias("_mid"), F.col("_h").alias("_mh")), "marked")
    near = keyed.join(marked, keyed["_id"].eqNullSafe(marked["_mid"]) & (keyed["_h"] == marked["_mh"])).select("_id", "_h", "_text").dropDuplicates(["_id", "_h"])
    near = written(near.select("_id", "_h", exact_words(F.col("_text")).alias("w"), coarse_hashes(F.col("_text")).alias("h")), "near")

    # the windows around each place of a fingerprint, word for word
    each = None
    for k, known in [(K, prints), *heads.items()]:
        n = WINDOW if known is prints else k
        places = near.select("_id", "_h", F.size("w").alias("size"), runs("h", k).alias("g")).select("_id", "_h", "size", F.posexplode("g").alias("at", "fp")).join(_small(known), "fp")
        if known is prints:  # W starts reach a run, and a window that starts there must fit
            places = places.select("_id", "_h", "size", F.explode(F.sequence(F.greatest(F.col("at") - (W - 2), F.lit(1)), F.col("at") + 1)).alias("s"))
        else:
            places = places.withColumn("s", F.col("at") + 1)
        starts = places.where(F.col("s") <= F.col("size") - (n - 1)).groupBy(F.col("_id").alias("_sid"), F.col("_h").alias("_sh")).agg(F.collect_set("s").alias("at"))
        at = near.join(starts, near["_id"].eqNullSafe(starts["_sid"]) & (near["_h"] == starts["_sh"])).select("_id", "_h", "w", "at")
        cut = at.select("_id", "_h", F.explode(F.transform("at", lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.array_join(F.slice("w", s, n), " ").alias("window")))).alias("x")).select("_id", "_h", "x.*")
        each = cut if each is None else each.unionByName(cut)
    real = written(each.join(_small(found), ["window", "n"]).select("_id", "_h", "s", "n", "wid"), "real")
    inside = real.groupBy("_id", "_h").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("s", F.col("s") + F.col("n") - 1))))).cast("long").alias("n_hit"))
    named = real.select("_id", "_h", "wid").distinct().join(_small(items), "wid").groupBy(F.col("_id").alias("_nid"), F.col("_h").alias("_nh")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return inside.join(named, inside["_id"].eqNullSafe(named["_nid"]) & (inside["_h"] == named["_nh"])).select("_id", "_h", "n_hit", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs with _n_words, _n_hit, _items and _contaminated (share * n_hit >= n_words, and any hit) added. Where docs has a column of such a name, the added one ends in underscores."""
    found = hits(docs, benchmark, doc_id, text, item_id).select(F.col("_id").alias("_fid"), F.col("_h").alias("_fh"), F.col("n_hit").alias("_fhit"), F.col("items").alias("_fitems"))
    every = F.struct("*")  # as one column, so that no name of docs meets one of found
    keyed = docs.select(every.alias("_doc"), F.col(doc_id).alias("_kid"), row_key(text).alias("_kh"), F.size(words(F.col(text))).cast("long").alias("_words"))
    joined = keyed.join(found, F.col("_kid").eqNullSafe(F.col("_fid")) & (F.col("_kh") == F.col("_fh")), "left")
    n_hit = F.coalesce(F.col("_fhit"), F.lit(0))
    return joined.select(
        "_doc.*", F.col("_words").alias(unused(docs, "_n_words")), n_hit.alias(unused(docs, "_n_hit")),
        F.coalesce(F.col("_fitems"), F.expr("cast(array() as array<string>)")).alias(unused(docs, "_items")), ((n_hit > 0) & (n_hit * share >= F.col("_words"))).alias(unused(docs, "_contaminated")),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return contamination(docs, benchmark, **names).where(~F.col(unused(docs, "_contaminated"))).select(*docs.columns)
