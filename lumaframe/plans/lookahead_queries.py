"""Decisions over ordered frames and the buffer of a coded stream. The events of a user are the frames of a stream."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compliance
from ..operators import sequences as S
from ..tables import table
from .registry import query


def frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(w).cast("long").alias("n"), F.floor(F.col("value") * 100).alias("bits"))


_U = "u AS (SELECT user_id, event_id, event_type, value, CAST(floor(value * 100) AS BIGINT) AS bits, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(f"WITH {_U}, d AS (SELECT user_id, n, value - lag(value) OVER (PARTITION BY user_id ORDER BY n) AS step FROM u), s AS (SELECT user_id, n, CASE WHEN step >= 0.2 AND step <= 16 THEN 1 WHEN step <= -0.2 AND step >= -16 THEN -1 ELSE 0 END AS way FROM d), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, way ORDER BY n) AS island FROM s WHERE way <> 0) SELECT user_id, CAST(way AS INTEGER) AS way, min(n) AS first, max(n) AS last FROM g GROUP BY user_id, way, island HAVING count(*) >= 6")
def fades(spark, sf_dir):
    """Six frames in a row whose mean moved the same way by 0.2 or more, and no step over 16."""
    w = Window.partitionBy("user_id").orderBy("n")
    step = F.col("value") - F.lag("value").over(w)
    s = frames(spark, sf_dir).select("user_id", "n", F.when((step >= 0.2) & (step <= 16), 1).when((step <= -0.2) & (step >= -16), -1).otherwise(0).alias("way")).where("way <> 0")
    g = s.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("user_id", "way").orderBy("n")))
    return g.groupBy("user_id", "way", "island").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("c")).where("c >= 6").drop("island", "c")


_COST = f"{_U}, c AS (SELECT user_id, n, value + 1 AS intra, abs(value - coalesce(lag(value) OVER w, value)) + 1 AS fwd, abs(value - coalesce(lead(value) OVER w, value)) + 1 AS bwd FROM u WINDOW w AS (PARTITION BY user_id ORDER BY n)), k AS (SELECT *, least(fwd, bwd, intra) < 0.77 * intra AS keeps FROM c)"


@query(f"WITH {_COST}, r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, keeps ORDER BY n) AS island FROM k), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, keeps, island ORDER BY n) AS place FROM r) SELECT user_id, n, CASE WHEN keeps AND place % 4 <> 0 THEN 'B' ELSE 'P' END AS type FROM p")
def b_placement(spark, sf_dir):
    """A frame stays B while the least of its costs is under 0.77 of the intra one; of a run every fourth is an anchor, so that no more than three follow one another."""
    w = Window.partitionBy("user_id").orderBy("n")
    near = lambda f: F.abs(F.col("value") - F.coalesce(f("value").over(w), F.col("value"))) + 1
    c = frames(spark, sf_dir).select("user_id", "n", (F.col("value") + 1).alias("intra"), near(F.lag).alias("fwd"), near(F.lead).alias("bwd"))
    k = c.withColumn("keeps", F.least("fwd", "bwd", "intra") < 0.77 * F.col("intra"))
    r = k.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("user_id", "keeps").orderBy("n")))
    p = r.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "keeps", "island").orderBy("n")))
    return p.select("user_id", "n", F.when(F.col("keeps") & (F.col("place") % 4 != 0), "B").otherwise("P").alias("type"))


@query(f"WITH {_U}, m AS (SELECT user_id, max(n) AS frames, bool_or(event_type = 'signup') AS keyed FROM u GROUP BY user_id), b AS (SELECT user_id, n FROM u WHERE event_type = 'signup' OR n = 1 UNION SELECT user_id, x FROM m, unnest(range(1, frames + 1, 12)) t(x) WHERE NOT keyed), g AS (SELECT user_id, n AS first, lead(n) OVER (PARTITION BY user_id ORDER BY n) - 1 AS last FROM b) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS gop, first, coalesce(last, frames) AS last, CAST((SELECT sum(bits) FROM u WHERE u.user_id = g.user_id AND u.n BETWEEN g.first AND coalesce(g.last, m.frames)) AS BIGINT) AS bits FROM g JOIN m USING (user_id)")
def gop_table(spark, sf_dir):
    """Groups of pictures between key frames; a stream without any is cut every twelve frames. Bits of a group by a running group number, not by a join on ranges."""
    stream = Window.partitionBy("user_id")
    f = frames(spark, sf_dir).withColumn("keyed", F.bool_or(F.col("event_type") == "signup").over(stream))
    starts = (F.col("n") == 1) | F.when(F.col("keyed"), F.col("event_type") == "signup").otherwise(F.col("n") % 12 == 1)
    g = f.withColumn("gop", F.sum(starts.cast("long")).over(stream.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return g.groupBy("user_id", "gop").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.sum("bits").alias("bits"))


@query(f"WITH {_U}, p AS (SELECT user_id, event_id // 200 AS gop, count(*) AS frames, CAST(sum(bits) AS BIGINT) AS bits, min(n) AS first, arg_max(value, n) AS last_value FROM u GROUP BY user_id, gop) SELECT user_id, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(bits) AS BIGINT) AS bits, array_to_string(list(CAST(bits AS VARCHAR) ORDER BY gop), ' ') AS by_gop, arg_max(last_value, gop) AS last_value FROM p GROUP BY user_id")
def merged_partials(spark, sf_dir):
    """Statistics of each group of pictures, merged in order whichever was done first."""
    f = frames(spark, sf_dir)
    p = f.groupBy("user_id", F.floor(F.col("event_id") / 200).alias("gop")).agg(F.count("*").alias("frames"), F.sum("bits").alias("bits"), F.max_by("value", "n").alias("last_value"))
    m = p.groupBy("user_id").agg(F.sum("frames").alias("frames"), F.sum("bits").alias("bits"), F.array_sort(F.collect_list(F.struct("gop", "bits"))).alias("l"), F.max_by("last_value", "gop").alias("last_value"))
    return m.select("user_id", "frames", "bits", F.array_join(F.transform("l", lambda x: x["bits"].cast("string")), " ").alias("by_gop"), "last_value")


@query(f"WITH {_U} SELECT user_id, n, CAST(sum(bits) OVER w AS BIGINT) AS ahead, count(*) OVER w AS seen, round(max(value) OVER w, 6) AS peak FROM u WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)")
def lookahead_window(spark, sf_dir):
    """What a window of forty frames ahead holds."""
    w = Window.partitionBy("user_id").orderBy("n").rowsBetween(0, 39)
    return frames(spark, sf_dir).select("user_id", "n", F.sum("bits").over(w).alias("ahead"), F.count("*").over(w).alias("seen"), F.round(F.max("value").over(w), 6).alias("peak"))


@query(f"WITH {_U} SELECT user_id, n, n + 2 <= max(n) OVER (PARTITION BY user_id) AS ready, n % 4 = 1 AS filtered, count(*) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 AS neighbours FROM u")
def filter_queue(spark, sf_dir):
    """When a picture leaves the temporal filter's queue: as soon as two successors are present, else at the flush; every fourth is filtered, with the neighbours that exist."""
    stream = Window.partitionBy("user_id")
    return frames(spark, sf_dir).select("user_id", "n", (F.col("n") + 2 <= F.max("n").over(stream)).alias("ready"), (F.col("n") % 4 == 1).alias("filtered"), (F.count("*").over(stream.orderBy("n").rowsBetween(-2, 2)) - 1).alias("neighbours"))


@query(f"WITH {_U} SELECT user_id, n, round(greatest(4500 + (f - 6000) / CASE WHEN f > 6000 THEN 4.0 ELSE 2.0 END, 0.4 * 4500), 6) AS budget, round(greatest(0.9 * f, 45.0), 6) AS limit_bits FROM (SELECT user_id, n, CAST(bits * 3 % 9000 AS DOUBLE) AS f FROM u)")
def fill_budget(spark, sf_dir):
    """The bits that bring a buffer back to its goal within a horizon, which differs above and below it, and the fit test's limit."""
    f = (F.col("bits") * 3 % 9000).cast("double")
    budget = F.greatest(4500 + (f - 6000) / F.when(f > 6000, 4.0).otherwise(2.0), F.lit(0.4 * 4500))
    return frames(spark, sf_dir).select("user_id", "n", F.round(budget, 6).alias("budget"), F.round(F.greatest(0.9 * f, F.lit(45.0)), 6).alias("limit_bits"))


@query("WITH t AS (SELECT event_type AS cat, count(*) AS cnt, CAST(sum(floor(value)) AS BIGINT) AS s FROM events GROUP BY event_type) SELECT cat, w, least((CAST(40 * w AS BIGINT) * cnt + (s + cnt) * 128) // ((s + cnt) * 256), s // cnt, 32767) AS offset_q FROM t, (SELECT unnest([256, 410, 655, 1024]) AS w)")
def noise_offsets(spark, sf_dir):
    """What is taken off a coefficient: strength by weight over the mean, in integers, never more than the mean itself."""
    t = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cat")).agg(F.count("*").alias("cnt"), F.sum(F.floor("value")).alias("s")).withColumn("w", F.explode(F.array(*map(F.lit, (256, 410, 655, 1024)))))
    return t.select("cat", "w", F.least(F.expr("(40L * w * cnt + (s + cnt) * 128) div ((s + cnt) * 256)"), F.expr("s div cnt"), F.lit(32767).cast("long")).alias("offset_q"))


_RATE, _DELAY, _TICK, _SIZE = 5000.0, 0.9, 0.4, 9000.0
_HRD = f"WITH RECURSIVE {_U}, r AS (SELECT user_id, n, bits, {_DELAY} + {_TICK} * (n - 1) AS t_out FROM u), a AS (SELECT user_id, n, bits, t_out, CAST(0 AS DOUBLE) AS t_start, bits / {_RATE} AS t_end FROM r WHERE n = 1 UNION ALL SELECT r.user_id, r.n, r.bits, r.t_out, greatest(a.t_end, r.t_out - {_DELAY}), greatest(a.t_end, r.t_out - {_DELAY}) + r.bits / {_RATE} FROM a JOIN r ON r.user_id = a.user_id AND r.n = a.n + 1)"


@query(_HRD + f", f AS (SELECT a.user_id, a.n, a.t_out, any_value(a.t_end) AS t_end, sum(CASE WHEN k.t_start >= a.t_out THEN 0 WHEN k.t_end <= a.t_out THEN k.bits ELSE k.bits * (a.t_out - k.t_start) / (k.t_end - k.t_start) END) AS held FROM a JOIN a k ON k.user_id = a.user_id AND k.n >= a.n GROUP BY a.user_id, a.n, a.t_out) SELECT user_id, count(*) AS units, count(*) FILTER (WHERE t_out < t_end - 1e-9) AS underflows, count(*) FILTER (WHERE held > {_SIZE} + 1e-6) AS overflows, round(max(held), 4) AS most_held, round(min(t_out - t_end), 6) AS least_margin FROM f GROUP BY user_id")
def hrd_variable(spark, sf_dir):
    """The decoder's buffer where delivery pauses: a unit arrives after the one before it and no earlier than its delay before removal; held at a removal is what has arrived and is not removed."""
    x = compliance.buffer_check(frames(spark, sf_dir), "user_id", "n", "bits", _RATE, _SIZE, _DELAY, _TICK)
    return compliance.buffer_report(x, "user_id")


@query(_HRD.replace(f"greatest(a.t_end, r.t_out - {_DELAY})", "a.t_end") + f", f AS (SELECT *, {_RATE} * t_out - (sum(bits) OVER (PARTITION BY user_id ORDER BY n) - bits) AS held FROM a) SELECT user_id, count(*) AS units, count(*) FILTER (WHERE t_out < t_end - 1e-9) AS underflows, count(*) FILTER (WHERE held > {_SIZE} + 1e-6) AS overflows, round(max(held), 4) AS most_held, round(min(t_out - t_end), 6) AS least_margin FROM f GROUP BY user_id")
def hrd_constant(spark, sf_dir):
    """The same where the channel never pauses: what it has delivered by a removal, less what was removed."""
    x = compliance.buffer_check(frames(spark, sf_dir), "user_id", "n", "bits", _RATE, _SIZE, _DELAY, _TICK, constant=True)
    return compliance.buffer_report(x, "user_id")


@query(f"WITH RECURSIVE {_U}, b AS (SELECT user_id, n, event_id % 16 AS lsb, event_id % 3 <> 0 AS ref FROM u), p AS (SELECT user_id, n, lsb, CAST(0 AS BIGINT) AS msb, CASE WHEN ref THEN 0 ELSE 0 END AS rmsb, CASE WHEN ref THEN lsb ELSE 0 END AS rlsb FROM b WHERE n = 1 UNION ALL SELECT b.user_id, b.n, b.lsb, m.msb, CASE WHEN b.ref THEN m.msb ELSE m.rmsb END, CASE WHEN b.ref THEN b.lsb ELSE m.rlsb END FROM b JOIN (SELECT p.user_id, p.n, p.rmsb, p.rlsb, x.lsb AS nl, CASE WHEN x.lsb < p.rlsb AND p.rlsb - x.lsb >= 8 THEN p.rmsb + 16 WHEN x.lsb > p.rlsb AND x.lsb - p.rlsb > 8 THEN p.rmsb - 16 ELSE p.rmsb END AS msb FROM p JOIN b x ON x.user_id = p.user_id AND x.n = p.n + 1) m ON m.user_id = b.user_id AND b.n = m.n + 1) SELECT user_id, n, msb + lsb AS whole FROM p")
def picture_order(spark, sf_dir):
    """Picture order counts from their low bits: the high part follows the last reference picture, which depends on the data and is a fold."""
    f = frames(spark, sf_dir).select("user_id", "n", (F.col("event_id") % 16).alias("lsb"), (F.col("event_id") % 3 != 0).alias("ref"))
    return S.picture_order(f, "user_id", "n", "lsb", "ref", 16)


@query(f"WITH RECURSIVE {_U}, m AS (SELECT user_id, n, CAST(bits AS DOUBLE) AS model, CAST(0 AS DOUBLE) AS owed FROM u WHERE n = 1 UNION ALL SELECT u.user_id, u.n, model + 0.125 * (u.bits - model), least(greatest(owed + u.bits - 2000, owed - 500), owed + 500) FROM m JOIN u ON u.user_id = m.user_id AND u.n = m.n + 1) SELECT user_id, n, round(model, 4) AS model, round(owed, 4) AS owed FROM m")
def rate_ledger(spark, sf_dir):
    """A model of the bits that follows a stream by an eighth, and what is owed to the target, which moves by no more than 500 a frame: a fold along the stream."""
    seq = F.array_sort(F.collect_list(F.struct("n", F.col("bits").cast("double").alias("b"))))
    zero = F.struct(F.lit(0.0).alias("model"), F.lit(0.0).alias("owed"), F.expr("cast(array() as array<struct<n: bigint, model: double, owed: double>>)").alias("out"))

    def step(s, u):
        begins = F.size(s["out"]) == 0
        model = F.when(begins, u["b"]).otherwise(s["model"] + 0.125 * (u["b"] - s["model"]))
        owed = F.when(begins, F.lit(0.0)).otherwise(F.least(F.greatest(s["owed"] + u["b"] - 2000, s["owed"] - 500), s["owed"] + 500))
        return F.struct(model.alias("model"), owed.alias("owed"), F.concat(s["out"], F.array(F.struct(u["n"].alias("n"), model.alias("model"), owed.alias("owed")))).alias("out"))

    x = frames(spark, sf_dir).groupBy("user_id").agg(F.aggregate(seq, zero, step, lambda s: s["out"]).alias("x")).select("user_id", F.explode("x").alias("x"))
    return x.select("user_id", "x.n", F.round("x.model", 4).alias("model"), F.round("x.owed", 4).alias("owed"))
