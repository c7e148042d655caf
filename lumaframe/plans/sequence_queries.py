"""Sequence operations over the events table, a stream for each user."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..tables import table
from .registry import query


def units(spark, sf_dir):
    """Events as coded units: bits are a hundred times the value."""
    return table(spark, sf_dir, "events").withColumn("bits", F.floor(F.col("value") * 100))


_U = "u AS (SELECT user_id, event_id, event_type, value, CAST(floor(value * 100) AS BIGINT) AS bits, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(f"WITH RECURSIVE {_U}, b AS (SELECT user_id, n, greatest(9000 - bits, 0) AS f, CASE WHEN 9000 - bits < 0 THEN 1 ELSE 0 END AS under FROM u WHERE n = 1 UNION ALL SELECT u.user_id, u.n, greatest(least(f + 4500, 9000) - bits, 0), under + CASE WHEN least(f + 4500, 9000) - bits < 0 THEN 1 ELSE 0 END FROM b JOIN u ON u.user_id = b.user_id AND u.n = b.n + 1) SELECT user_id, max(n) AS n, CAST(max(under) AS BIGINT) AS underflows, arg_max(f, n) AS fill_end FROM b GROUP BY user_id")
def leaky_bucket(spark, sf_dir):
    return S.leaky_bucket(units(spark, sf_dir), "user_id", ["event_id"], "bits", 9000, 4500)


@query(f"WITH RECURSIVE {_U}, b AS (SELECT user_id, n, event_id, event_id * 100 AS t_start, event_id * 100 + bits AS t_end FROM u WHERE n = 1 UNION ALL SELECT u.user_id, u.n, u.event_id, greatest(t_end, u.event_id * 100), greatest(t_end, u.event_id * 100) + bits FROM b JOIN u ON u.user_id = b.user_id AND u.n = b.n + 1) SELECT user_id, event_id, t_start, t_end FROM b")
def arrival_schedule(spark, sf_dir):
    return S.arrivals(units(spark, sf_dir), "user_id", "event_id", F.col("event_id") * 100, F.col("bits")).select("user_id", "event_id", "t_start", "t_end")


@query(f"WITH {_U}, d AS (SELECT *, value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS up FROM u), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM d WHERE up) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, island HAVING count(*) >= 3")
def fade_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = units(spark, sf_dir).withColumn("up", F.col("value") > F.lag("value").over(w))
    return S.runs(x.select("user_id", "event_id", "up"), "user_id", "event_id", F.col("up"), 3)


@query(f"WITH {_U}, g AS (SELECT a.user_id, a.n, sum(b.value * exp(-((a.n - b.n) * (a.n - b.n)) / 8.0)) / sum(exp(-((a.n - b.n) * (a.n - b.n)) / 8.0)) AS v FROM u a JOIN u b ON a.user_id = b.user_id AND abs(a.n - b.n) <= 6 GROUP BY a.user_id, a.n) SELECT user_id, n, round(v, 6) AS blurred FROM g")
def gauss_blur(spark, sf_dir):
    x = units(spark, sf_dir).select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"))
    return S.gaussian(x, "user_id", "n", "value", 2.0).select("user_id", "n", F.round("blurred", 6).alias("blurred"))


@query(f"WITH {_U}, g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM u) SELECT user_id, min(gap) AS least, max(gap) AS most, count(*) FILTER (WHERE gap > 200) AS late FROM g GROUP BY user_id")
def removal_gaps(spark, sf_dir):
    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return units(spark, sf_dir).select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.count_if(F.col("gap") > 200).alias("late"))


@query(f"WITH {_U}, c AS (SELECT user_id, event_id, event_id % 256 AS poc, lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM u) SELECT user_id, event_id, CAST(poc + 256 * sum(CASE WHEN poc < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS whole FROM c")
def counter_unwrap(spark, sf_dir):
    x = units(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 256).alias("poc"))
    return S.unwrapped(x, "user_id", "event_id", "poc", 256).select("user_id", "event_id", "whole")


@query(f"WITH {_U} SELECT user_id, event_id, CAST(sum(bits) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS planned, coalesce((SELECT min(p.event_id) FROM u p WHERE p.user_id = u.user_id AND p.event_id > u.event_id AND p.event_type = 'purchase'), -1) AS next_key FROM u")
def planned_bits_and_next_key(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    key = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return units(spark, sf_dir).select("user_id", "event_id", F.sum("bits").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("planned"), F.coalesce(F.last(key, ignorenulls=True).over(back), F.lit(-1)).alias("next_key"))


@query(f"WITH {_U} SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS frame FROM u")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return units(spark, sf_dir).select("user_id", "event_id", F.coalesce(F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("frame"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return S.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(f"WITH RECURSIVE {_U}, d AS (SELECT user_id, n, CASE WHEN 1 >= 8 THEN bits >> 1 ELSE bits END AS t, 1 AS c FROM u WHERE n = 1 UNION ALL SELECT u.user_id, u.n, CASE WHEN c + 1 >= 8 THEN (t + bits) >> 1 ELSE t + bits END, CASE WHEN c + 1 >= 8 THEN (c + 1) >> 1 ELSE c + 1 END FROM d JOIN u ON u.user_id = d.user_id AND u.n = d.n + 1) SELECT user_id, CAST(arg_max(t, n) AS BIGINT) AS total, CAST(arg_max(c, n) AS BIGINT) AS count FROM d GROUP BY user_id")
def decayed_tally(spark, sf_dir):
    return S.decayed(units(spark, sf_dir), "user_id", ["event_id"], "bits", 8)


@query(f"WITH {_U}, k AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'signup' THEN 0 END AS kind FROM u), b AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k), s AS (SELECT *, sum(CASE WHEN kind = 0 AND before = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS unit FROM b) SELECT user_id, CAST(unit AS BIGINT) AS unit, count(*) AS n, CAST(sum(bits) AS BIGINT) AS bits FROM s GROUP BY user_id, unit")
def access_units(spark, sf_dir):
    x = S.sessions(units(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type").isin("view", "click"))
    return x.groupBy("user_id", "unit").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


_COST = f"{_U}, c AS (SELECT user_id, n, value + 1 AS intra, abs(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), value)) + 1 AS inter FROM u), r AS (SELECT *, least(intra, inter) / intra AS ratio FROM c), m AS (SELECT *, max(ratio) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS top3, lead(inter / intra) OVER (PARTITION BY user_id ORDER BY n) AS next FROM r), s AS (SELECT *, ratio >= 0.9 AND (ratio >= top3 + 0.1 OR 1 - ratio <= (1 - top3) / 2) AND NOT coalesce(next < 0.02, FALSE) AS cut FROM m)"


@query(f"WITH {_COST} SELECT user_id, n, round(ratio, 6) AS ratio FROM s WHERE cut")
def scene_cuts(spark, sf_dir):
    """The documented cut rule on proxy costs: a high ratio that stands out from the three before it, and no flash."""
    return _costs(spark, sf_dir).where("cut").select("user_id", "n", F.round("ratio", 6).alias("ratio"))


def _costs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    c = units(spark, sf_dir).select("user_id", F.row_number().over(w).cast("long").alias("n"), (F.col("value") + 1).alias("intra"), (F.abs(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))) + 1).alias("inter"))
    v = Window.partitionBy("user_id").orderBy("n")
    m = c.withColumn("ratio", F.least("intra", "inter") / F.col("intra")).withColumns({"top3": F.max("ratio").over(v.rowsBetween(-3, -1)), "next": F.lead(F.col("inter") / F.col("intra")).over(v)})
    stands_out = (F.col("ratio") >= F.col("top3") + 0.1) | (1 - F.col("ratio") <= (1 - F.col("top3")) / 2)
    return m.withColumn("cut", (F.col("ratio") >= 0.9) & stands_out & ~F.coalesce(F.col("next") < 0.02, F.lit(False)))


@query(f"WITH {_COST}, g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS shot FROM s) SELECT user_id, CAST(shot AS BIGINT) AS shot, min(n) AS first, max(n) AS last, round(avg(intra), 6) AS icost_mean, round(max(intra), 6) AS icost_peak, round(avg(inter), 6) AS pcost_mean FROM g GROUP BY user_id, shot")
def shot_table(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    g = _costs(spark, sf_dir).withColumn("shot", F.sum(F.coalesce(F.col("cut"), F.lit(False)).cast("long")).over(w))
    return g.groupBy("user_id", "shot").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.round(F.avg("intra"), 6).alias("icost_mean"), F.round(F.max("intra"), 6).alias("icost_peak"), F.round(F.avg("inter"), 6).alias("pcost_mean"))


@query(f"WITH {_COST}, g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS shot FROM s), t AS (SELECT user_id, shot, count(*) AS len, avg(inter) AS pcost FROM g GROUP BY user_id, shot), o AS (SELECT *, sum(pcost * len) OVER (PARTITION BY user_id) / sum(len) OVER (PARTITION BY user_id) AS title FROM t), f AS (SELECT *, least(greatest(6 * 0.4 * log2(pcost / title), -4), 4) AS own FROM o) SELECT user_id, CAST(shot AS BIGINT) AS shot, round(coalesce(last_value(CASE WHEN len >= 24 OR shot = 0 THEN own END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY shot), 0), 5) AS crf_offset FROM f")
def shot_crf(spark, sf_dir):
    """6 * (1 - 0.6) * log2 of a shot's cost to the title's, within 4; a short shot takes the offset of the shot before it, which is a carried last value."""
    w = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    g = _costs(spark, sf_dir).withColumn("shot", F.sum(F.coalesce(F.col("cut"), F.lit(False)).cast("long")).over(w))
    t = g.groupBy("user_id", "shot").agg(F.count("*").alias("len"), F.avg("inter").alias("pcost"))
    whole = Window.partitionBy("user_id")
    own = F.least(F.greatest(6 * 0.4 * F.log2(F.col("pcost") / (F.sum(F.col("pcost") * F.col("len")).over(whole) / F.sum("len").over(whole))), F.lit(-4.0)), F.lit(4.0))
    f = t.withColumn("own", own)
    kept = F.last(F.when((F.col("len") >= 24) | (F.col("shot") == 0), F.col("own")), ignorenulls=True).over(whole.orderBy("shot").rowsBetween(Window.unboundedPreceding, 0))
    return f.select("user_id", "shot", F.round(F.coalesce(kept, F.lit(0.0)), 5).alias("crf_offset"))


@query("WITH t AS (SELECT DISTINCT event_id * 100 AS instant FROM events), s AS (SELECT event_id * 100 AS a, event_id * 100 + CAST(floor(value * 100) AS BIGINT) AS b, CAST(floor(value * 100) AS BIGINT) AS bits FROM events) SELECT instant, count(*) AS n, CAST(sum(bits) AS BIGINT) AS bits FROM t JOIN s ON a < instant AND b >= instant GROUP BY instant")
def in_flight(spark, sf_dir):
    """Units under way at each instant: a range join on time, in cells."""
    from ..operators.joins import interval_join

    e = units(spark, sf_dir)
    spans = e.select((F.col("event_id") * 100).alias("a"), (F.col("event_id") * 100 + F.col("bits")).alias("b"), "bits")
    return interval_join(e.select((F.col("event_id") * 100).alias("instant")).distinct(), spans, "instant", "a", "b", 20_000).where("a < instant").groupBy("instant").agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))


@query(f"WITH {_U}, s AS (SELECT user_id, n, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, event_type = 'error' AS hit FROM u), c AS (SELECT user_id, k, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS precision FROM s) SELECT user_id, max(k) AS depth FROM c WHERE precision >= 0.2 GROUP BY user_id")
def precision_coverage(spark, sf_dir):
    """The last place in score order at which the running precision still meets the target."""
    x = units(spark, sf_dir).select("user_id", (F.col("event_type") == "error").cast("double").alias("hit"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long").alias("k"))
    p = x.withColumn("precision", F.avg("hit").over(Window.partitionBy("user_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return p.where("precision >= 0.2").groupBy("user_id").agg(F.max("k").alias("depth"))
