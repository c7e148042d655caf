"""Secret scans with multipart credential linking, in DataFrame expressions only.

Roles: assign, hex and key are secrets, access and ident are identifiers, endpoint is an endpoint. A key is reported beside an
identifier, an ident beside a secret, an endpoint beside both.

Base spans are found by pattern alone. Weak candidates (a bare key-like string, an account name, an endpoint) are
reported only when complementary parts stand within `scope` characters in the same text: an interval self-join, done as
RANGE window frames over the parts of a document, so that it costs a sort and never forms pairs.

Edge cases: a null text is an empty one; a null id is an id of its own; rows equal in id and text share one result each;
rows of one id with different texts are kept apart; an empty table gives an empty result; other columns pass through.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import row_key, unused

#: The base kinds in order with their patterns. For access and hex the minimum length is part of the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds. ident: a named account; key: a long mixed token; endpoint: a URL, or an IPv4 address with an optional port.
IDENT = r"""((?i:user(?:name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})"""
KEY = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What a key must hold beside.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?"
#: (kind, pattern, group whose length counts, least length, role)
KINDS = (
    ("assign", ASSIGN, 2, 6, "secret"),
    ("access", ACCESS, 0, 20, "id"),
    ("hex", HEX, 0, 24, "secret"),
    ("ident", IDENT, 2, 3, "id"),
    ("key", KEY, 0, 20, "secret"),
    ("endpoint", ENDPOINT, 0, 1, "endpoint"),
)
BASE = ("assign", "access", "hex")
#: A text without a match of this has neither a base span nor an account name, and then no complete set of parts either.
ANY_BASE = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]"


def _cut(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind as an array of (order, n, before, length, ok); before: characters between a match and the one before."""
    fit = lambda h: reduce(lambda a, b: a & b, [F.length(h) >= least, *(h.rlike(m) for m in MIXED if pattern == KEY)])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.zip_with(
        F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("before"), F.length(m).alias("len"))), held,
        lambda x, h: F.struct(F.lit(order).alias("order"), x["before"].alias("before"), x["len"].alias("len"), fit(h).alias("ok")),
    )


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _h, order, start, end: every match of every kind, in code points, of the texts with a base match."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.col("_text").rlike(ANY_BASE))
    rows = rows.withColumn("_h", F.xxhash64("_text")).dropDuplicates(["_id", "_h"])
    cuts = F.array(*(_cut(F.col("_text"), i, p, g, least) for i, (_, p, g, least, _) in enumerate(KINDS)))
    each = rows.select("_id", "_h", F.explode(cuts).alias("_cut")).select("_id", "_h", F.posexplode("_cut").alias("_n", "_x"))
    ends = F.sum(F.col("_x.before") + F.coalesce(F.col("_x.len"), F.lit(0))).over(Window.partitionBy("_id", "_h", "_x.order").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("_end", ends).where("_x.len is not null and _x.ok").select("_id", "_h", F.col("_x.order").alias("order"), (F.col("_end") - F.col("_x.len")).alias("start"), F.col("_end").alias("end"))


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """The base spans, and the weak ones whose complementary parts start within `scope` characters of them."""
    role = F.element_at(F.array(*(F.lit(k[4]) for k in KINDS)), F.col("order") + 1)
    near = Window.partitionBy("_id", "_h").orderBy("start").rangeBetween(-scope, scope)
    have = lambda r: F.max(F.col("_role") == r).over(near)
    before = Window.partitionBy("_id", "_h").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_id", "_h").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows is not computed anew for each row
    base = F.col("order") < len(BASE)
    near_by = found.withColumn("_role", role).select(
        "*", have("id").alias("_i"), have("secret").alias("_s"), have("endpoint").alias("_e"),
        F.max(F.when(base, F.col("end"))).over(before).alias("_base_end"), F.min(F.when(base, F.col("start"))).over(after).alias("_base_start"),
    )
    apart = (F.coalesce(F.col("_base_end"), F.lit(0)) <= F.col("start")) & (F.col("_base_start").isNull() | (F.col("_base_start") >= F.col("end")))
    complete = F.when(F.col("_role") == "id", F.col("_s")).when(F.col("_role") == "secret", F.col("_i")).otherwise(F.col("_i") & F.col("_s"))
    return near_by.where(base | (apart & complete)).select("_id", "_h", "order", "start", "end")


def scan(docs: DataFrame, scope: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _h and spans ARRAY<STRUCT<start, order, end>> by start and kind, of the documents with any span."""
    return linked(parts(docs, doc_id, text), scope).groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end"))).alias("spans"))


def with_spans(docs: DataFrame, scope: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the column _spans, empty where nothing was found; its name ends in underscores where docs has one of that name."""
    found = scan(docs, scope, doc_id, text).select(F.col("_id").alias("_found_id"), F.col("_h").alias("_found_h"), F.col("spans").alias("_found_spans"))
    keyed = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_kid"), row_key(text).alias("_kh"))  # as one column, so that no name of docs meets one of found
    joined = keyed.join(found, F.col("_kid").eqNullSafe(F.col("_found_id")) & (F.col("_kh") == F.col("_found_h")), "left")
    none = F.expr("cast(array() as array<struct<start: bigint, order: int, end: bigint>>)")
    return joined.select("_doc.*", F.coalesce(F.col("_found_spans"), none).alias(unused(docs, "_spans")))


def spelled(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), s["order"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every reported span of the text replaced by mask; overlapping spans give one mask. n_chars follows, where there is one."""
    t = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def merge(s: Column, x: Column) -> Column:
        gap = x["start"] >= s["at"]
        fresh = F.when(gap & ((x["start"] > s["at"]) | (s["at"] == 0)), F.concat(t.substr(s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], fresh).alias("out"))

    spans = unused(docs, "_spans")
    done = F.aggregate(F.col(spans), start, merge, lambda s: F.concat(s["out"], t.substr(s["at"].cast("int") + 1, F.length(t))))
    fresh = unused(docs, "_new")
    clean = with_spans(docs, scope, doc_id, text).withColumn(fresh, F.when(F.size(spans) > 0, done).otherwise(t))
    swaps = {text: F.col(fresh)} | ({"n_chars": F.when(F.size(spans) > 0, F.length(fresh)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clean.select(*((swaps[c].alias(c) if c in swaps else F.col(c)) for c in docs.columns))
