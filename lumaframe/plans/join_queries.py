"""Join shapes over the driver's tables. Zones are spans of event ids, one for each customer, so that they cover the ids at every scale."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sequences as S
from ..tables import table
from .registry import query

_ZONES = "zones AS (SELECT c_custkey AS zone, 7 * c_custkey AS first, 7 * c_custkey + 3 + c_custkey % 9 AS last FROM customer)"


def zones(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("zone"), (7 * k).alias("first"), (7 * k + 3 + k % 9).alias("last"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"WITH {_ZONES} SELECT zone, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN zones ON event_id BETWEEN first AND last GROUP BY zone")
def zone_interval_join(spark, sf_dir):
    j = J.interval_join(events(spark, sf_dir).select("event_id", "value"), zones(spark, sf_dir), "event_id", "first", "last", 64)
    return j.groupBy("zone").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {_ZONES}, gops AS (SELECT c_custkey AS gop, 32 * c_custkey AS a, 32 * c_custkey + 31 AS b FROM customer) SELECT gop, zone, greatest(a, first) - a AS rel_first, least(b, last) - a AS rel_last FROM gops JOIN zones ON first <= b AND last >= a")
def zone_clip_to_gop(spark, sf_dir):
    k = F.col("c_custkey")
    gops = table(spark, sf_dir, "customer").select(k.alias("gop"), (32 * k).alias("a"), (32 * k + 31).alias("b"))
    j = J.overlap_join(gops, zones(spark, sf_dir), ("a", "b"), ("first", "last"), 64)
    return j.select("gop", "zone", (F.col("from") - F.col("a")).alias("rel_first"), (F.col("to") - F.col("a")).alias("rel_last"))


@query(f"WITH {_ZONES} SELECT zone, first, last FROM (SELECT *, max(last) OVER (ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM zones) WHERE e >= first")
def zone_overlap_check(spark, sf_dir):
    return J.overlaps_within(zones(spark, sf_dir), "first", "last", 64)


@query("WITH p AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id AS u, event_id AS error_id, value AS error_value FROM events WHERE event_type = 'error') SELECT p.user_id, p.event_id, coalesce(e.error_id, -1) AS error_id, coalesce(e.error_value, -1) AS error_value FROM p ASOF LEFT JOIN e ON p.user_id = e.u AND p.event_id >= e.error_id")
def asof_prev_error(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("user_id", "event_id")
    return J.asof_join(left, e.where("event_type = 'error'"), ["user_id"], "event_id", {"error_id": "event_id", "error_value": "value"}).fillna(-1, ["error_id", "error_value"])


_CURVE = "curve AS (SELECT event_type AS clip, r AS rung, 30 + 8 * r + round(avg(value) / 100, 4) AS score, round(sum(value), 2) * pow(2.0, r) AS kbps FROM events, (SELECT unnest([1, 2, 3, 4]) AS r) WHERE user_id % 4 < r GROUP BY event_type, r)"


def curve(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("rung", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).where(F.col("user_id") % 4 < F.col("rung"))
    return e.groupBy(F.col("event_type").alias("clip"), "rung").agg((30 + 8 * F.col("rung") + F.round(F.avg("value") / 100, 4)).alias("score"), (F.round(F.sum("value"), 2) * F.pow(F.lit(2.0), "rung")).alias("kbps"))


@query(f"WITH {_CURVE}, s AS (SELECT clip, score AS x0, kbps AS y0, lead(score) OVER w AS x1, lead(kbps) OVER w AS y1 FROM curve WINDOW w AS (PARTITION BY clip ORDER BY score)), t AS (SELECT unnest([40.0, 45.5, 52.0, 60.0, 90.0])::DOUBLE AS target) SELECT clip, target, round(exp(ln(y0) + (target - x0) / (x1 - x0) * (ln(y1) - ln(y0))), 3) AS kbps FROM s JOIN t ON target >= x0 AND target < x1")
def bracketing_rungs(spark, sf_dir):
    s = J.bracketing(curve(spark, sf_dir), ["clip"], "score", "kbps").withColumn("target", F.explode(F.array(*(F.lit(x) for x in (40.0, 45.5, 52.0, 60.0, 90.0)))))
    return s.where("target >= x0 and target < x1").select("clip", "target", F.round(J.log_interpolated(F.col("target")), 3).alias("kbps"))


@query("SELECT o_orderkey, coalesce(type, '?') AS type, coalesce(qp, -1) AS qp FROM orders LEFT JOIN (SELECT event_id, event_type AS type, CAST(event_id % 52 AS BIGINT) AS qp FROM events WHERE event_id % 3 = 0) ON event_id = o_orderkey")
def stats_with_fallback(spark, sf_dir):
    stats = events(spark, sf_dir).where("event_id % 3 = 0").select(F.col("event_id").alias("o_orderkey"), F.col("event_type").alias("type"), (F.col("event_id") % 52).alias("qp"))
    return J.with_fallback(table(spark, sf_dir, "orders").select("o_orderkey"), stats, ["o_orderkey"], {"type": "?", "qp": -1})


@query("SELECT a.event_type AS cls_a, b.event_type AS cls_b, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct, round(avg((a.value - b.value) * (a.value - b.value)), 4) AS mse FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY a.event_type, b.event_type")
def class_contingency(spark, sf_dir):
    e = events(spark, sf_dir)
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("cls_b"), F.col("value").alias("vb"))
    j = e.select("event_id", F.col("event_type").alias("cls_a"), "value").join(b, "event_id")
    d = F.col("value") - F.col("vb")
    n = j.groupBy("cls_a", "cls_b").agg(F.count("*").alias("n"), F.round(F.avg(d * d), 4).alias("mse"))
    return n.withColumn("share_pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # one row a pair of classes


@query("SELECT k AS key, 'left' AS only_in FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) UNION ALL SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0 EXCEPT SELECT o_custkey FROM orders)")
def catalogue_diff(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return J.difference(a, table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY event_type")
def manifest_semi_join(spark, sf_dir):
    keep = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return events(spark, sf_dir).join(keep, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_CURVE} SELECT a.clip, a.rung AS arm_i, b.rung AS arm_j, round(100 * (b.kbps / a.kbps - 1), 4) AS more_pct FROM curve a JOIN curve b ON a.clip = b.clip AND a.rung < b.rung")
def arm_pairs(spark, sf_dir):
    a = curve(spark, sf_dir)
    b = a.select("clip", F.col("rung").alias("arm_j"), F.col("kbps").alias("kb"))
    return a.join(b, "clip").where("rung < arm_j").select("clip", F.col("rung").alias("arm_i"), "arm_j", F.round(100 * (F.col("kb") / F.col("kbps") - 1), 4).alias("more_pct"))


_PLAN = "SELECT n_name AS title, q AS rung, fps FROM nation, (SELECT unnest([18, 23, 28]) AS q), (SELECT unnest([24, 30]) AS fps) WHERE n_regionkey = 1"


@query(_PLAN)
def run_matrix(spark, sf_dir):
    """Titles by rungs by rates: the plan of a measurement; both factors are constants."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("title"))
    return n.withColumn("rung", F.explode(F.array(*map(F.lit, (18, 23, 28))))).withColumn("fps", F.explode(F.array(F.lit(24), F.lit(30))))


#: Fixed values of the H.264 standard, table A-1: level, macroblocks a second, frame size, picture buffer in macroblocks, kbit/s, kbit of buffer.
LEVELS = [
    (10, 1485, 99, 396, 64, 175), (11, 3000, 396, 900, 192, 500), (12, 6000, 396, 2376, 384, 1000), (13, 11880, 396, 2376, 768, 2000), (20, 11880, 396, 2376, 2000, 2000), (21, 19800, 792, 4752, 4000, 4000),
    (22, 20250, 1620, 8100, 4000, 4000), (30, 40500, 1620, 8100, 10000, 10000), (31, 108000, 3600, 18000, 14000, 14000), (32, 216000, 5120, 20480, 20000, 20000), (40, 245760, 8192, 32768, 20000, 25000),
    (41, 245760, 8192, 32768, 50000, 62500), (42, 522240, 8704, 34816, 50000, 62500), (50, 589824, 22080, 110400, 135000, 135000), (51, 983040, 36864, 184320, 240000, 240000), (52, 2073600, 36864, 184320, 240000, 240000),
]
_LEVEL_SQL = ", ".join(str(x) for x in LEVELS)


def level_of(streams, id_col="stream"):
    """The first level whose bounds on macroblocks a second, frame size, sides, picture buffer and rate hold; a null bound skips its test. The levels are an ordered constant array: neither join nor shuffle."""
    names = ("level", "mbps", "fs", "dpb", "br", "cpb")
    levels = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(names, row))) for row in LEVELS))
    size = F.col("mb_w") * F.col("mb_h")

    def fits(x):
        within = lambda need, limit: F.col(need).isNull() | (F.col(need) <= x[limit])
        return within("mbps", "mbps") & (size <= x["fs"]) & (F.greatest("mb_w", "mb_h") <= F.floor(F.sqrt(8.0 * x["fs"]))) & within("kbps", "br") & (F.col("refs") <= F.least(F.floor(x["dpb"] / size), F.lit(16)))

    return streams.select(id_col, F.get(F.filter(levels, fits), F.lit(0))["level"].cast("int").alias("level")).where("level is not null")


_STREAMS = "SELECT o_orderkey AS stream, 10 + o_custkey % 120 AS mb_w, 9 + o_custkey % 68 AS mb_h, 1 + o_orderkey % 5 AS refs, CAST(o_totalprice AS BIGINT) % 60000 AS kbps, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (10 + o_custkey % 120) * (9 + o_custkey % 68) * 30 END AS mbps FROM orders"


@query(f"WITH s AS ({_STREAMS}), l(level, max_mbps, max_fs, max_dpb, max_br, max_cpb) AS (VALUES {_LEVEL_SQL}) SELECT stream, min(level) AS level FROM s JOIN l ON (mbps IS NULL OR mbps <= max_mbps) AND mb_w * mb_h <= max_fs AND greatest(mb_w, mb_h) <= floor(sqrt(8.0 * max_fs)) AND kbps <= max_br AND refs <= least(max_dpb // (mb_w * mb_h), 16) GROUP BY stream")
def level_pick(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w, h = 10 + F.col("o_custkey") % 120, 9 + F.col("o_custkey") % 68
    # a half rounds to even in the SQL's cast
    s = o.select(F.col("o_orderkey").alias("stream"), w.alias("mb_w"), h.alias("mb_h"), (1 + F.col("o_orderkey") % 5).alias("refs"), (F.bround("o_totalprice").cast("long") % 60000).alias("kbps"), F.when(F.col("o_orderkey") % 7 != 0, w * h * 30).alias("mbps"))
    return level_of(s)


@query("WITH x AS (SELECT l_partkey AS id, l_suppkey AS ref, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) SELECT a.id, b.id AS target FROM (SELECT * FROM x WHERE n = 1) a JOIN (SELECT * FROM x WHERE n = 1) b ON a.ref = b.id")
def dictionary_self_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("ref"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    x = S.latest(li, ["id"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "ref", "l_quantity", "l_extendedprice")]).select("id", "ref")
    return x.join(x.select(F.col("id").alias("target")), F.col("ref") == F.col("target")).select("id", "target")


_RULES = [("setup", 1, "^(sign|log)"), ("spend", 2, "purch"), ("look", 3, "view|click"), ("rest", 9, ".*")]


@query("WITH r(stage, priority, pattern) AS (VALUES " + ", ".join(str(r) for r in _RULES) + ") SELECT stage, count(*) AS n FROM (SELECT event_id, arg_min(stage, priority) AS stage FROM events JOIN r ON regexp_matches(event_type, pattern) GROUP BY event_id) GROUP BY stage")
def rule_attribution(spark, sf_dir):
    """The first rule that matches: rules are few and constant, so they are an ordered CASE and need no join."""
    stage = F.lit(None).cast("string")
    for name, _, pattern in sorted(_RULES, key=lambda r: -r[1]):
        stage = F.when(F.col("event_type").rlike(pattern), name).otherwise(stage)
    return events(spark, sf_dir).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
