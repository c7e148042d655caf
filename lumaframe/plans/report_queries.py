"""Censuses, boards, curves and verdicts over measurement records. The proxies: events are readings, event types are classes or clips."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import sequences as S
from ..tables import table
from .join_queries import _CURVE, curve
from .registry import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM events GROUP BY event_type")
def mb_census(spark, sf_dir):
    return A.census(events(spark, sf_dir), ["event_type"]).withColumn("share_pct", F.round("share_pct", 6))


@query("WITH m AS (SELECT event_type, median(value) AS centre, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high FROM events GROUP BY event_type HAVING count(*) >= 4) SELECT event_type, round(any_value(centre), 6) AS centre, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, any_value(low) AS low, any_value(high) AS high, round(1.4826 * median(abs(value - centre)), 6) AS rsd FROM events JOIN m USING (event_type) GROUP BY event_type")
def robust_spread(spark, sf_dir):
    x = A.robust_spread(events(spark, sf_dir), "event_type", "value")
    return x.select("event_type", "n", "low", "high", *(F.round(c, 6).alias(c) for c in ("centre", "mean", "sd", "rsd")))


@query("WITH b AS (SELECT event_type, CAST(least(floor(value), 255) AS BIGINT) AS bin, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY bin) AS run, sum(c) OVER (PARTITION BY event_type) AS n FROM b) SELECT event_type, min(bin) AS bin FROM r WHERE run * 4 > n GROUP BY event_type")
def hist_percentile(spark, sf_dir):
    return A.histogram_percentile(events(spark, sf_dir), "event_type", F.least(F.floor("value"), F.lit(255).cast("long")))


_NAMED = "r AS (SELECT c_mktsegment AS class, c_custkey AS title, round((c_acctbal + 1000) / 6000, 6) AS ratio FROM customer)"


def _named(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("title"), F.round((F.col("c_acctbal") + 1000) / 6000, 6).alias("ratio"))


@query(f"WITH {_NAMED} SELECT class, count(*) AS n, round(median(ratio), 6) AS median, max(ratio) AS worst, max(title) FILTER (WHERE ratio = top) AS worst_title, CASE WHEN median(ratio) <= 1.0 AND max(ratio) <= 1.15 THEN 'PASS' ELSE 'OPEN' END AS verdict FROM (SELECT *, max(ratio) OVER (PARTITION BY class) AS top FROM r) GROUP BY class")
def class_board(spark, sf_dir):
    return A.board(_named(spark, sf_dir), "class", "title", "ratio").withColumn("median", F.round("median", 6))


@query(f"WITH {_NAMED} SELECT coalesce(class, 'ALL') AS class, round(median(ratio), 6) AS median, count(*) AS n FROM r GROUP BY GROUPING SETS ((class), ())")
def class_and_overall_medians(spark, sf_dir):
    r = _named(spark, sf_dir)
    return r.groupingSets([["class"], []], "class").agg(F.round(F.median("ratio"), 6).alias("median"), F.count("*").alias("n")).select(F.coalesce("class", F.lit("ALL")).alias("class"), "median", "n")


@query("SELECT event_type, round(median(d), 6) AS median, count(*) FILTER (WHERE d < -1.0) AS n_fail, count(*) FILTER (WHERE d BETWEEN -1.0 AND -0.5) AS n_debt, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) FILTER (WHERE d < -1.0), '') AS failing, CASE WHEN count(*) FILTER (WHERE d < -1.0) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE d BETWEEN -1.0 AND -0.5) > 0 THEN 'DEBT' ELSE 'PASS' END AS verdict FROM (SELECT event_type, event_id, (value - 2) / 2 AS d FROM events WHERE value > CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0.6 ELSE 1.5 END) GROUP BY event_type")
def psnr_floor(spark, sf_dir):
    low = F.when(F.col("event_type") == "view", 0.0).when(F.col("event_type") == "click", 0.6).otherwise(1.5)
    x = events(spark, sf_dir).where(F.col("value") > low).select("event_type", "event_id", ((F.col("value") - 2) / 2).alias("d"))
    return A.floor_verdict(x, "event_type", "event_id", "d").withColumn("median", F.round("median", 6))


@query(f"WITH {_CURVE} SELECT clip, CASE WHEN bool_and(up) THEN 'yes' ELSE 'no' END AS rises, CASE WHEN max(score) >= 62.5 THEN 'saturated' ELSE 'open' END AS top FROM (SELECT clip, score, coalesce(score > lag(score) OVER (PARTITION BY clip ORDER BY kbps), TRUE) AS up FROM curve) GROUP BY clip HAVING count(*) >= 4")
def curve_gates(spark, sf_dir):
    w = Window.partitionBy("clip").orderBy("kbps")
    x = curve(spark, sf_dir).withColumn("up", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(True)))
    return x.groupBy("clip").agg(F.when(F.bool_and("up"), "yes").otherwise("no").alias("rises"), F.when(F.max("score") >= 62.5, "saturated").otherwise("open").alias("top"), F.count("*").alias("n")).where("n >= 4").drop("n")


def _lagrange(c, x):
    return " + ".join(f"{c}[{i + 1}].r * " + " * ".join(f"({x} - {c}[{j + 1}].s) / ({c}[{i + 1}].s - {c}[{j + 1}].s)" for j in range(4) if j != i) for i in range(4))


_X = "(lo + (hi - lo) * k / 99.0)"


@query(f"WITH {_CURVE}, c AS (SELECT clip, list(struct_pack(s := score, r := ln(kbps)) ORDER BY score) AS c FROM curve GROUP BY clip), b AS (SELECT t.clip, a.c AS a, t.c AS c, greatest(a.c[1].s, t.c[1].s) AS lo, least(a.c[4].s, t.c[4].s) AS hi FROM c t, c a WHERE a.clip = 'view' AND t.clip <> 'view') SELECT clip, round((exp(avg({_lagrange('c', _X)} - ({_lagrange('a', _X)}))) - 1) * 100, 4) AS bd_pct FROM b, range(100) t(k) WHERE hi > lo GROUP BY clip")
def bd_rate4(spark, sf_dir):
    points = curve(spark, sf_dir).withColumn("one", F.lit(1))
    return A.bd_rate4(points, ["one"], "clip", "view", "kbps", "score").select("clip", F.round("bd_pct", 4).alias("bd_pct"))


@query("SELECT p.event_type, round(sqrt(exp(avg(ln(p.value + 1)) - any_value(i.l))), 6) AS ratio FROM events p, (SELECT avg(ln(value + 1)) AS l FROM events WHERE event_type = 'signup') i GROUP BY p.event_type")
def geo_mean_ratio(spark, sf_dir):
    logs = events(spark, sf_dir).groupBy("event_type").agg(F.avg(F.ln(F.col("value") + 1)).alias("l"))
    base = F.max(F.when(F.col("event_type") == "signup", F.col("l"))).over(Window.partitionBy(F.lit(1)))  # one row a type
    return logs.select("event_type", F.round(F.sqrt(F.exp(F.col("l") - base)), 6).alias("ratio"))


@query("SELECT user_id, count(*) AS n, round(sum(CASE WHEN event_type = 'error' THEN value END) / nullif(sum(CASE WHEN event_type <> 'error' THEN value END), 0), 6) AS retained, round(avg(least(value / 20.0, 2)), 6) AS clamped FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0")
def energy_retention(spark, sf_dir):
    err, v = F.col("event_type") == "error", F.col("value")
    x = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(err).alias("e"), F.round(F.sum(F.when(err, v)) / F.nullif(F.sum(F.when(~err, v)), F.lit(0.0)), 6).alias("retained"), F.round(F.avg(F.least(v / 20.0, F.lit(2.0))), 6).alias("clamped"))
    return x.where("e > 0").drop("e")


@query("SELECT o_orderpriority AS stage, round(sum(o_totalprice * (o_custkey % 7)) / sum(o_totalprice), 6) AS weighted, round(sum(o_totalprice) * 100.0 / sum(sum(o_totalprice)) OVER (), 6) AS share_pct FROM orders GROUP BY o_orderpriority")
def weighted_stage_mean(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.sum(F.col("o_totalprice") * (F.col("o_custkey") % 7)).alias("w"), F.sum("o_totalprice").alias("t"))
    return g.select("stage", F.round(F.col("w") / F.col("t"), 6).alias("weighted"), F.round(F.col("t") * 100.0 / F.sum("t").over(Window.partitionBy(F.lit(1))), 6).alias("share_pct"))


@query("SELECT fingerprint, min(event_id) AS event_id, count(*) AS copies FROM (SELECT event_id, md5(concat(event_type, ':', CAST(user_id AS VARCHAR), ':', CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR))) AS fingerprint FROM events) GROUP BY fingerprint")
def fingerprint_dedup(spark, sf_dir):
    f = F.md5(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.floor(F.col("value") / 20).cast("string")))
    return events(spark, sf_dir).groupBy(f.alias("fingerprint")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies"))


@query("SELECT o_orderpriority AS preset, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS p FROM orders GROUP BY o_orderpriority")
def preset_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("preset")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 2))
    return p.withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


_RANKED = "SELECT user_id, event_type, value, event_id, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS pri FROM events WHERE event_type <> 'error'"


@query(f"SELECT user_id, event_type AS source, value FROM ({_RANKED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pri, event_id) = 1 UNION ALL SELECT DISTINCT user_id, 'missing', -1.0 FROM events WHERE user_id NOT IN (SELECT user_id FROM ({_RANKED}))")
def source_fallback(spark, sf_dir):
    """The first source by priority for each key; keys without any are marked."""
    e = events(spark, sf_dir)
    some = e.where("event_type <> 'error'").withColumn("pri", F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3))
    pick = S.latest(some, ["user_id"], [F.col("pri"), F.col("event_id")]).select("user_id", F.col("event_type").alias("source"), "value")
    none = e.select("user_id").distinct().join(some.select("user_id"), "user_id", "left_anti").select("user_id", F.lit("missing").alias("source"), F.lit(-1.0).alias("value"))
    return pick.unionByName(none)


_VALID = "CASE WHEN l_linenumber = 7 THEN 'frame-mismatch' WHEN l_discount > 0.09 THEN 'feeder-bound' WHEN l_quantity < 3 THEN 'size-mismatch' WHEN l_tax > 0.07 THEN 'not-quiet' WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'single-run' ELSE 'yes' END"


@query(f"SELECT {_VALID} AS valid, count(*) AS n FROM lineitem GROUP BY 1")
def validity_labels(spark, sf_dir):
    label = F.when(F.col("l_linenumber") == 7, "frame-mismatch").when(F.col("l_discount") > 0.09, "feeder-bound").when(F.col("l_quantity") < 3, "size-mismatch").when(F.col("l_tax") > 0.07, "not-quiet")
    label = label.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1), "single-run").otherwise("yes")
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("valid")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT o_custkey AS title, o_orderkey, o_totalprice / 300000 AS ratio, lag(o_totalprice / 300000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT title, o_orderkey, round(ratio - before, 6) AS change FROM d WHERE abs(ratio - before) >= 0.03 ORDER BY abs(ratio - before) DESC, o_orderkey LIMIT 5")
def change_report(spark, sf_dir):
    """The five largest changes to the report before: a top-k report."""
    r = F.col("o_totalprice") / 300000
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("title"), "o_orderkey", (r - F.lag(r).over(w)).alias("d"))
    return d.where(F.abs("d") >= 0.03).orderBy(F.desc(F.abs("d")), "o_orderkey").limit(5).select("title", "o_orderkey", F.round("d", 6).alias("change"))


@query("WITH s AS (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS next FROM events WHERE value > 1) SELECT user_id, round(min(next / value) - 1, 8) AS agreement, CASE WHEN max(value) / min(value) > 1.15 THEN 'spread' ELSE 'tight' END AS warning FROM s GROUP BY user_id HAVING count(*) >= 2")
def round_agreement(spark, sf_dir):
    s = events(spark, sf_dir).where("value > 1").select("user_id", "value", F.lead("value").over(Window.partitionBy("user_id").orderBy("value")).alias("next"))
    x = s.groupBy("user_id").agg(F.round(F.min(F.col("next") / F.col("value")) - 1, 8).alias("agreement"), F.when(F.max("value") / F.min("value") > 1.15, "spread").otherwise("tight").alias("warning"), F.count("*").alias("n"))
    return x.where("n >= 2").drop("n")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE abs(value - t) / t > 0.05) AS off_rate, round(median(abs(value - t) / t), 6) AS median_abs, round(max(abs(value - t) / t), 6) AS worst_abs FROM (SELECT event_type, value, 10.0 + user_id % 40 AS t FROM events) GROUP BY event_type")
def rate_tracking(spark, sf_dir):
    t = F.lit(10.0) + F.col("user_id") % 40
    x = events(spark, sf_dir).select("event_type", (F.abs(F.col("value") - t) / t).alias("e"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0.05).alias("off_rate"), F.round(F.median("e"), 6).alias("median_abs"), F.round(F.max("e"), 6).alias("worst_abs"))


@query("WITH f AS (SELECT l_orderkey, count(*) AS frames FROM lineitem GROUP BY l_orderkey), g AS (SELECT l_orderkey, frames * 900 AS frames FROM f), s AS (SELECT l_orderkey, frames, greatest(1, CAST(floor(frames / 24.0 / 180 + 0.5) AS BIGINT)) AS n, least(frames, 720) AS wlen FROM g) SELECT l_orderkey, k, CAST(floor(k * (frames / CAST(n AS DOUBLE)) + (frames / CAST(n AS DOUBLE) - wlen) / 2) AS BIGINT) AS start, CAST(wlen AS BIGINT) AS wlen FROM s, unnest(range(n)) t(k)")
def stratified_windows(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") * 900).alias("frames"))
    s = f.select("l_orderkey", "frames", F.greatest(F.lit(1).cast("long"), F.floor(F.col("frames") / 24.0 / 180 + 0.5)).alias("n"), F.least("frames", F.lit(720).cast("long")).alias("wlen"))
    each = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    step = F.col("frames") / F.col("n").cast("double")
    return each.select("l_orderkey", "k", F.floor(F.col("k") * step + (step - F.col("wlen")) / 2).alias("start"), "wlen")


@query("SELECT user_id, CASE WHEN min(v) >= -0.02 THEN 'default' ELSE arg_min(event_type, (v, event_type)) END AS label FROM (SELECT user_id, event_type, round(avg(value) / 20 - 1, 6) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def arm_labels(spark, sf_dir):
    v = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.round(F.avg("value") / 20 - 1, 6).alias("v"))
    x = v.groupBy("user_id").agg(F.min(F.struct("v", "event_type")).alias("m"))
    return x.select("user_id", F.when(F.col("m.v") >= -0.02, "default").otherwise(F.col("m.event_type")).alias("label"))


@query("SELECT event_type, coalesce(CAST(user_id % 4 AS VARCHAR), '*') AS rung, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY CUBE (event_type, user_id % 4) HAVING event_type IS NOT NULL")
def census_cube(spark, sf_dir):
    """An extension; the reports only print class and overall figures."""
    x = events(spark, sf_dir).withColumn("rung", (F.col("user_id") % 4).cast("string")).cube("event_type", "rung").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return x.where("event_type is not null").select("event_type", F.coalesce("rung", F.lit("*")).alias("rung"), "n", "total")


@query("SELECT event_id, upper(event_type) AS name, split_part(concat(event_type, ':', CAST(user_id AS VARCHAR)), ':', 2) AS tail, event_type LIKE '%ck' AS ends_ck, regexp_extract(props, '\"([a-z_]+)\"', 1) AS first_key, length(props) AS props_len FROM events")
def string_scalars(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.upper("event_type").alias("name"), F.substring_index(F.concat_ws(":", "event_type", F.col("user_id").cast("string")), ":", -1).alias("tail"), F.col("event_type").endswith("ck").alias("ends_ck"), F.regexp_extract("props", '"([a-z_]+)"', 1).alias("first_key"), F.length("props").cast("long").alias("props_len"))


@query("WITH a AS (SELECT user_id AS cell, CAST(floor(value * 10) AS BIGINT) AS size FROM events WHERE event_type = 'view'), b AS (SELECT user_id AS cell, CAST(floor(value * 10) AS BIGINT) AS size FROM events WHERE event_type = 'click'), s AS (SELECT cell, count(*) AS equal FROM (SELECT DISTINCT * FROM a INTERSECT SELECT DISTINCT * FROM b) GROUP BY cell) SELECT cell, equal FROM s")
def same_output_sizes(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("cell"), F.floor(F.col("value") * 10).alias("size"), "event_type")
    both = e.where("event_type = 'view'").select("cell", "size").intersect(e.where("event_type = 'click'").select("cell", "size"))
    return both.groupBy("cell").agg(F.count("*").alias("equal"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, list_aggregate(list_transform(list(CAST(floor(value) AS BIGINT) ORDER BY event_id)[1:5], lambda v: CAST(v * 2 AS VARCHAR)), 'string_agg', ' ') AS head FROM events GROUP BY user_id")
def array_scalars(spark, sf_dir):
    x = events(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.array_sort(F.collect_list(F.struct("event_id", F.floor("value").alias("v")))).alias("l"))
    return x.select("user_id", "kinds", F.array_join(F.transform(F.slice("l", 1, 5), lambda s: (s["v"] * 2).cast("string")), " ").alias("head"))
