"""Verdicts, states and picks over measurement records. The proxies: customers are titles, segments are classes, events are readings, their types are arms or clips."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..tables import table
from .join_queries import _CURVE, curve
from .registry import query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"WITH {_CURVE}, r AS (SELECT clip, min(score) AS lo, max(score) AS hi, min(kbps) AS a, max(kbps) AS b, count(*) AS n FROM curve GROUP BY clip), p AS (SELECT x.clip AS anchor, y.clip AS arm, x.n, x.hi - x.lo AS span, greatest(x.lo, y.lo) AS lo, least(x.hi, y.hi) AS hi, ln(least(x.b, y.b)) - ln(greatest(x.a, y.a)) AS shared, ln(greatest(x.b, y.b)) - ln(least(x.a, y.a)) AS either FROM r x JOIN r y ON x.clip = 'view' AND y.clip <> 'view') SELECT anchor, arm, round(CASE WHEN hi <= lo OR span <= 0 THEN 0 ELSE (hi - lo) / span END, 6) AS quality_overlap, greatest(0, least(n, CAST(round_even(CASE WHEN either > 0 THEN shared / either ELSE 0 END * (n - 1), 0) AS BIGINT) + 1)) AS rungs FROM p")
def curve_overlap(spark, sf_dir):
    """The share of the anchor's quality that an arm covers, and the rungs of the shared range of log rates; halves round to even."""
    r = curve(spark, sf_dir).groupBy("clip").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("kbps").alias("a"), F.max("kbps").alias("b"), F.count("*").alias("n"))
    x = r.where("clip = 'view'").select(F.col("clip").alias("anchor"), "n", *(F.col(c).alias(f"{c}0") for c in ("lo", "hi", "a", "b")))
    p = r.where("clip <> 'view'").drop("n").withColumnRenamed("clip", "arm").join(F.broadcast(x))  # one row
    lo, hi, span = F.greatest("lo", "lo0"), F.least("hi", "hi0"), F.col("hi0") - F.col("lo0")
    shared, either = F.ln(F.least("b", "b0")) - F.ln(F.greatest("a", "a0")), F.ln(F.greatest("b", "b0")) - F.ln(F.least("a", "a0"))
    rungs = F.bround(F.when(either > 0, shared / either).otherwise(0.0) * (F.col("n") - 1), 0).cast("long") + 1
    return p.select("anchor", "arm", F.round(F.when((hi <= lo) | (span <= 0), 0.0).otherwise((hi - lo) / span), 6).alias("quality_overlap"), F.greatest(F.lit(0).cast("long"), F.least("n", rungs)).alias("rungs"))


_TARGETS = (40.0, 45.0, 50.0, 55.0)


@query(f"WITH {_CURVE}, s AS (SELECT clip, score AS x0, kbps AS y0, lead(score) OVER w AS x1, lead(kbps) OVER w AS y1 FROM curve WINDOW w AS (PARTITION BY clip ORDER BY score)), i AS (SELECT clip, t, min_by(exp(ln(y0) + (t - x0) / (x1 - x0) * (ln(y1) - ln(y0))), x0) AS rate FROM s, (SELECT unnest({list(_TARGETS)})::DOUBLE AS t) WHERE t BETWEEN x0 AND x1 GROUP BY clip, t) SELECT clip, array_to_string(list(CAST(CAST(round(rate) AS BIGINT) AS VARCHAR) ORDER BY t), ' ') AS rates FROM i GROUP BY clip HAVING count(DISTINCT rate) = {len(_TARGETS)}")
def curve_inversion(spark, sf_dir):
    """The rate of each clip at the target scores, log-linear in the first segment that holds the score; clips with all of them, all different."""
    s = J.bracketing(curve(spark, sf_dir), ["clip"], "score", "kbps").withColumn("t", F.explode(F.array(*map(F.lit, _TARGETS)))).where("t between x0 and x1")
    i = s.groupBy("clip", "t").agg(F.min_by(J.log_interpolated(F.col("t")), "x0").alias("rate"))
    a = i.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", F.round("rate").cast("long").alias("r")))).alias("l"), F.countDistinct("rate").alias("n")).where(F.col("n") == len(_TARGETS))
    return a.select("clip", F.array_join(F.transform("l", lambda x: x["r"].cast("string")), " ").alias("rates"))


@query(f"WITH {_CURVE} SELECT clip, round((max_by(score, kbps) - min_by(score, kbps)) / log2(max(kbps) / min(kbps)), 6) AS per_octave FROM curve GROUP BY clip")
def slope_per_octave(spark, sf_dir):
    return curve(spark, sf_dir).groupBy("clip").agg(F.round((F.max_by("score", "kbps") - F.min_by("score", "kbps")) / F.log2(F.max("kbps") / F.min("kbps")), 6).alias("per_octave"))


#: Percent per clip, and of the median, that an arm may cost.
BAR, MEDIAN_BAR = 6.0, 0.5
_READS = "reads AS (SELECT event_type AS arm, user_id % 12 AS clip, event_id % 5 = 0 AS control, value / 10 - 1.5 AS pct FROM events), raw AS (SELECT arm, clip, median(pct) AS raw FROM reads WHERE NOT control GROUP BY arm, clip), c AS (SELECT clip, median(pct) AS centre, max(pct) AS most FROM reads WHERE control GROUP BY clip), s AS (SELECT clip, 1.4826 * median(abs(pct - centre)) AS spread FROM reads JOIN c USING (clip) WHERE control GROUP BY clip)"


@query(f"WITH {_READS}, v AS (SELECT arm, clip, raw, raw > {BAR} OR raw - most > {BAR} AS over, spread > {BAR} AS blind FROM raw JOIN c USING (clip) JOIN s USING (clip)) SELECT arm, round(median(raw), 6) AS median, round(max(raw), 6) AS worst, CASE WHEN bool_or(over) THEN 'REFUSED' WHEN median(raw) > {MEDIAN_BAR} THEN 'REFUSED on the median' WHEN bool_or(blind) THEN 'UNRESOLVED' ELSE 'PASS' END AS verdict FROM v GROUP BY arm")
def arm_verdict(spark, sf_dir):
    """Refused by any clip over the bar, itself or against its most favourable control, or by the median; unresolved where a clip's controls differ by more than the bar."""
    reads = events(spark, sf_dir).select(F.col("event_type").alias("arm"), (F.col("user_id") % 12).alias("clip"), (F.col("event_id") % 5 == 0).alias("control"), (F.col("value") / 10 - 1.5).alias("pct"))
    raw = reads.where("not control").groupBy("arm", "clip").agg(F.median("pct").alias("raw"))
    controls = reads.where("control")
    c = controls.groupBy("clip").agg(F.median("pct").alias("centre"), F.max("pct").alias("most"))
    s = controls.join(c, "clip").groupBy("clip").agg((1.4826 * F.median(F.abs(F.col("pct") - F.col("centre")))).alias("spread"), F.first("most").alias("most"))
    v = raw.join(s, "clip").select("arm", "raw", ((F.col("raw") > BAR) | (F.col("raw") - F.col("most") > BAR)).alias("over"), (F.col("spread") > BAR).alias("blind"))
    verdict = F.when(F.bool_or("over"), "REFUSED").when(F.median("raw") > MEDIAN_BAR, "REFUSED on the median").when(F.bool_or("blind"), "UNRESOLVED").otherwise("PASS")
    return v.groupBy("arm").agg(F.round(F.median("raw"), 6).alias("median"), F.round(F.max("raw"), 6).alias("worst"), verdict.alias("verdict"))


@query("SELECT class, round(median(d), 4) AS median, max_by(title, abs(d)) AS worst, round(max(abs(d)), 4) AS worst_size, array_to_string(list(CAST(title AS VARCHAR) ORDER BY title) FILTER (WHERE abs(d) > 45), ' ') AS outside, CASE WHEN abs(median(d)) > 2 OR max(abs(d)) > 45 THEN 'INVALID' ELSE 'OK' END AS guard FROM (SELECT c_mktsegment AS class, c_custkey AS title, c_acctbal / 100 - 45 + c_custkey / 1e9 AS d FROM customer) GROUP BY class")
def size_guard(spark, sf_dir):
    """Whether the sizes of two arms match: the median and the worst of the differences against their bars."""
    d = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("class"), F.col("c_custkey").alias("title"), (F.col("c_acctbal") / 100 - 45 + F.col("c_custkey") / 1e9).alias("d"))
    out = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.abs("d") > 45, F.col("title")))), lambda t: t.cast("string")), " ")
    return d.groupBy("class").agg(F.round(F.median("d"), 4).alias("median"), F.max_by("title", F.abs("d")).alias("worst"), F.round(F.max(F.abs("d")), 4).alias("worst_size"), F.when(F.max(F.abs("d")) > 45, out).alias("outside"), F.when((F.abs(F.median("d")) > 2) | (F.max(F.abs("d")) > 45), "INVALID").otherwise("OK").alias("guard"))


@query("SELECT user_id AS curve, count(*) FILTER (WHERE value > 60) AS clamped, count(*) AS frames, CASE WHEN count(*) FILTER (WHERE value > 60) > 0.05 * count(*) THEN 'none' ELSE 'read' END AS bd FROM events GROUP BY user_id")
def clip_bound_gate(spark, sf_dir):
    """A curve with more than a twentieth of its frames at the model's bound is not read."""
    hot = F.count_if(F.col("value") > 60)
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("curve")).agg(hot.alias("clamped"), F.count("*").alias("frames"), F.when(hot > 0.05 * F.count("*"), "none").otherwise("read").alias("bd"))


_SIDE = "SELECT user_id AS win, round(avg(value) / 20, 6) AS flat, round(max(value) / 30, 6) AS cambi, CAST(sum(floor(value * 100)) AS BIGINT) AS bytes FROM events WHERE event_type = '{}' GROUP BY user_id"


@query(f"WITH a AS ({_SIDE.format('view')}), b AS ({_SIDE.format('click')}) SELECT win, round(b.bytes * 1.0 / a.bytes, 6) AS size, round(b.flat - a.flat, 6) AS flat, CASE WHEN abs(b.bytes * 1.0 / a.bytes - 1) > 0.5 THEN 'UNMATCHED' WHEN b.flat > a.flat + 0.1 OR b.cambi > a.cambi + 0.2 THEN 'FAIL' ELSE 'pass' END AS verdict FROM a JOIN b USING (win) WHERE a.bytes > 0")
def banding_verdict(spark, sf_dir):
    """Not judged if the sizes differ; failed if flatness or banding exceeds the reference by a margin."""
    side = lambda kind, s: events(spark, sf_dir).where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("win")).agg(F.round(F.avg("value") / 20, 6).alias(f"flat{s}"), F.round(F.max("value") / 30, 6).alias(f"cambi{s}"), F.sum(F.floor(F.col("value") * 100)).alias(f"bytes{s}"))
    j = side("view", "a").join(side("click", "b"), "win").where("bytesa > 0").withColumn("ratio", F.col("bytesb") / F.col("bytesa"))
    bad = (F.col("flatb") > F.col("flata") + 0.1) | (F.col("cambib") > F.col("cambia") + 0.2)
    return j.select("win", F.round("ratio", 6).alias("size"), F.round(F.col("flatb") - F.col("flata"), 6).alias("flat"), F.when(F.abs(F.col("ratio") - 1) > 0.5, "UNMATCHED").when(bad, "FAIL").otherwise("pass").alias("verdict"))


@query("WITH h AS (SELECT user_id AS cell, event_type AS arm, md5(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS digest FROM events WHERE event_type IN ('view', 'click')) SELECT cell, count(DISTINCT digest) FILTER (WHERE arm = 'view') AS ours, count(DISTINCT digest) FILTER (WHERE arm = 'click') AS theirs, (SELECT count(*) FROM (SELECT DISTINCT digest FROM h a WHERE a.cell = h.cell AND arm = 'view' INTERSECT SELECT DISTINCT digest FROM h b WHERE b.cell = h.cell AND arm = 'click')) AS same FROM h GROUP BY cell")
def same_bitstream_guard(spark, sf_dir):
    """How many digests the two arms of a cell share: two encoders never write one bitstream."""
    h = events(spark, sf_dir).where("event_type in ('view', 'click')").select(F.col("user_id").alias("cell"), (F.col("event_type") == "view").alias("own"), F.md5(F.floor("value").cast("string")).alias("digest"))
    d = h.groupBy("cell", "digest").agg(F.bool_or("own").alias("a"), F.bool_or(~F.col("own")).alias("b"))
    return d.groupBy("cell").agg(F.count_if("a").alias("ours"), F.count_if("b").alias("theirs"), F.count_if(F.col("a") & F.col("b")).alias("same"))


_PRIOR = "SELECT o_custkey AS cell, o_orderpriority AS build, o_custkey % 7 AS reference, o_orderkey AS record, o_orderdate AS day FROM orders"


@query(f"WITH r AS ({_PRIOR}) SELECT cell, record, build, day FROM r WHERE build <> '1-URGENT' AND reference <> 3 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY day DESC, record DESC) = 1")
def newest_prior_build(spark, sf_dir):
    """Of each cell the newest record of another build with a reference that still counts."""
    r = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT' and o_custkey % 7 <> 3")
    x = r.groupBy(F.col("o_custkey").alias("cell")).agg(F.max(F.struct(F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("build"))).alias("m"))
    return x.select("cell", "m.record", "m.build", "m.day")


_GOAL = "SELECT l_partkey AS title, l_linenumber % 3 AS goal, round(avg(l_discount * 10 + 0.6), 6) AS ratio FROM lineitem WHERE {} GROUP BY 1, 2"


@query(f"WITH c AS ({_GOAL.format('''l_returnflag = 'R' AND l_tax < 0.06''')}), w AS ({_GOAL.format('''l_returnflag <> 'R' ''')}) SELECT coalesce(c.title, w.title) AS title, coalesce(c.goal, w.goal) AS goal, CASE WHEN c.ratio IS NOT NULL THEN c.ratio ELSE w.ratio END AS ratio, CASE WHEN c.ratio IS NOT NULL THEN 'cropped' ELSE 'credits-included' END AS source FROM c FULL JOIN w ON c.title = w.title AND c.goal = w.goal")
def cropped_or_whole(spark, sf_dir):
    """Each goal of a title from its cropped cell if that has a ratio, else from the whole one, which is marked and leaves the class statistics."""
    part = lambda cond, name: table(spark, sf_dir, "lineitem").where(cond).groupBy(F.col("l_partkey").alias("title"), (F.col("l_linenumber") % 3).alias("goal")).agg(F.round(F.avg(F.col("l_discount") * 10 + 0.6), 6).alias(name))
    j = part("l_returnflag = 'R' and l_tax < 0.06", "c").join(part("l_returnflag <> 'R'", "w"), ["title", "goal"], "full")
    return j.select("title", "goal", F.coalesce("c", "w").alias("ratio"), F.when(F.col("c").isNotNull(), "cropped").otherwise("credits-included").alias("source"))


_CELLS = "SELECT c_mktsegment AS class, c_nationkey % 2 AS tier, 'G' || (c_custkey % 3) AS goal, CASE WHEN c_custkey % 11 <> 0 THEN round((c_acctbal + 1000) / 9500, 6) END AS ratio, CASE WHEN c_custkey % 17 = 0 THEN 'not-quiet' WHEN c_custkey % 13 = 0 THEN 'single-run' ELSE 'yes' END AS valid FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_custkey % 3 = 1) AND NOT (c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 2 AND c_custkey % 17 <> 0)"


@query(f"WITH x AS ({_CELLS}), g AS (SELECT class, tier, goal, count(*) FILTER (WHERE ratio IS NOT NULL) AS known, median(ratio) FILTER (WHERE valid IN ('yes', 'single-run')) AS mid, max(ratio) FILTER (WHERE valid IN ('yes', 'single-run')) AS worst FROM x GROUP BY class, tier, goal), s AS (SELECT class, tier, goal, CASE WHEN mid IS NOT NULL THEN CASE WHEN mid <= 0.65 AND worst <= 1.15 THEN 'pass' ELSE 'open' END WHEN known > 0 THEN 'void' ELSE 'none' END AS state FROM g), p AS (SELECT class, tier, coalesce(max(state) FILTER (WHERE goal = 'G0'), 'none') AS g0, coalesce(max(state) FILTER (WHERE goal = 'G1'), 'none') AS g1, coalesce(max(state) FILTER (WHERE goal = 'G2'), 'none') AS g2 FROM s GROUP BY class, tier) SELECT *, CASE WHEN 'open' IN (g0, g1, g2) THEN 'OPEN' WHEN g0 = 'pass' AND g1 = 'pass' AND g2 = 'pass' THEN 'PASS' WHEN 'pass' IN (g0, g1, g2) THEN 'incomplete' ELSE '-' END AS verdict FROM p")
def class_goal_states(spark, sf_dir):
    """pass, open, void or none for each class, tier and goal, and the row's verdict."""
    k = F.col("c_custkey")
    x = table(spark, sf_dir, "customer").where("not (c_mktsegment = 'BUILDING' and c_custkey % 3 = 1) and not (c_mktsegment = 'MACHINERY' and c_custkey % 3 = 2 and c_custkey % 17 <> 0)").select(
        F.col("c_mktsegment").alias("class"), (F.col("c_nationkey") % 2).alias("tier"), F.concat(F.lit("G"), (k % 3).cast("string")).alias("goal"), F.when(k % 11 != 0, F.round((F.col("c_acctbal") + 1000) / 9500, 6)).alias("ratio"), (k % 17 != 0).alias("sound"))
    ok = F.when(F.col("sound"), F.col("ratio"))
    state = F.when(F.median(ok).isNotNull(), F.when((F.median(ok) <= 0.65) & (F.max(ok) <= 1.15), "pass").otherwise("open")).when(F.count("ratio") > 0, "void").otherwise("none")
    goals = ["G0", "G1", "G2"]
    s = x.groupBy("class", "tier", "goal").agg(state.alias("state")).groupBy("class", "tier").pivot("goal", goals).agg(F.first("state"))
    s = s.select("class", "tier", *(F.coalesce(g, F.lit("none")).alias(g.lower()) for g in goals))
    any_ = lambda v: (F.col("g0") == v) | (F.col("g1") == v) | (F.col("g2") == v)
    return s.withColumn("verdict", F.when(any_("open"), "OPEN").when((F.col("g0") == "pass") & (F.col("g1") == "pass") & (F.col("g2") == "pass"), "PASS").when(any_("pass"), "incomplete").otherwise("-"))


@query("WITH q AS (SELECT o_orderpriority AS class, o_custkey % 4 AS tier, o_orderkey AS cell, round(o_totalprice / 100000 - 2.4, 4) AS dv, round((o_custkey % 100) / 40.0 - 1.2, 4) AS dp, round((o_orderkey % 211) / 100.0 - 1.05, 4) AS ds FROM orders) SELECT class, tier, round(median(dv), 5) AS median, count(*) FILTER (WHERE dv < -2.3 OR dp < -1.15) AS under_floor, count(*) FILTER (WHERE abs(ds) > 1.03) AS off_size, min_by(cell, (dv, dp, cell)) AS worst, CASE WHEN median(dv) < 0 OR count(*) FILTER (WHERE dv < -2.3 OR dp < -1.15 OR abs(ds) > 1.03) > 0 THEN 'open' ELSE 'pass' END AS state FROM q GROUP BY class, tier")
def quality_state(spark, sf_dir):
    """Open if the median difference is under its bar, a cell is under a floor, or its size is off."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), (F.col("o_custkey") % 4).alias("tier"), F.col("o_orderkey").alias("cell"), F.round(F.col("o_totalprice") / 100000 - 2.4, 4).alias("dv"), F.round((F.col("o_custkey") % 100) / 40.0 - 1.2, 4).alias("dp"), F.round((F.col("o_orderkey") % 211) / 100.0 - 1.05, 4).alias("ds"))
    floor, off = (F.col("dv") < -2.3) | (F.col("dp") < -1.15), F.abs("ds") > 1.03
    return q.groupBy("class", "tier").agg(F.round(F.median("dv"), 5).alias("median"), F.count_if(floor).alias("under_floor"), F.count_if(off).alias("off_size"), F.min_by("cell", F.struct("dv", "dp", "cell")).alias("worst"), F.when((F.median("dv") < 0) | (F.count_if(floor | off) > 0), "open").otherwise("pass").alias("state"))


_ROWS = "SELECT DISTINCT l_suppkey AS cell, l_linestatus = 'O' AS ours, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 5 ELSE 2 END AS stride, CASE WHEN l_tax < 0.05 THEN 'local' ELSE 'cloud' END AS src, l_linenumber AS rung FROM lineitem"


@query(f"WITH r AS ({_ROWS}), s AS (SELECT cell, stride, src, list(a.rung ORDER BY a.rung) AS rungs FROM (SELECT * FROM r WHERE ours) a JOIN (SELECT * FROM r WHERE NOT ours) b USING (cell, stride, src, rung) GROUP BY cell, stride, src HAVING count(*) >= 4) SELECT cell, stride, src, array_to_string(rungs, ' ') AS rungs FROM s WHERE stride % 2 = 1 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY stride, src DESC) = 1")
def curve_choice(spark, sf_dir):
    """Of each cell the curve to show: rungs that both arms have, four at least; the lowest odd stride first, then the local source before the cloud."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_linestatus") == "O").alias("ours"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 5).otherwise(2).alias("stride"), F.when(F.col("l_tax") < 0.05, "local").otherwise("cloud").alias("src"), F.col("l_linenumber").alias("rung"))
    both = r.where("stride % 2 = 1").groupBy("cell", "stride", "src", "rung").agg(F.countDistinct("ours").alias("sides")).where("sides = 2")
    s = both.groupBy("cell", "stride", "src").agg(F.array_sort(F.collect_list("rung")).alias("rungs")).where("size(rungs) >= 4")
    best = s.groupBy("cell").agg(F.min(F.struct("stride", (F.col("src") != "local").alias("far"), "src", "rungs")).alias("m"))
    return best.select("cell", "m.stride", "m.src", F.array_join(F.transform("m.rungs", lambda x: x.cast("string")), " ").alias("rungs"))


@query("WITH c AS (SELECT user_id % 20 AS clip, event_type AS arm, user_id % 4 AS rung, CAST(sum(floor(value * 1000)) AS BIGINT) AS instr, avg(value) AS kbps FROM events GROUP BY 1, 2, 3), p AS (SELECT a.arm, a.clip, a.instr AS ia, b.instr AS ib, abs(b.kbps / 20 - 1) <= 0.10 AS near FROM c a JOIN c b USING (clip, rung) WHERE b.arm = 'view' AND a.arm <> 'view') SELECT arm, round(100 * (CAST(sum(ia) AS DOUBLE) / sum(ib) - 1), 6) AS total_pct, round(100 * (CAST(sum(ia) FILTER (WHERE near) AS DOUBLE) / sum(ib) FILTER (WHERE near) - 1), 6) AS near_pct, round(max(100 * (CAST(ia AS DOUBLE) / ib - 1)), 6) AS worst_pct FROM p GROUP BY arm")
def instruction_ratios(spark, sf_dir):
    """The ratio of sums over all rungs, and over those that the base lands within a tenth of; and the worst rung."""
    c = events(spark, sf_dir).groupBy((F.col("user_id") % 20).alias("clip"), F.col("event_type").alias("arm"), (F.col("user_id") % 4).alias("rung")).agg(F.sum(F.floor(F.col("value") * 1000)).alias("ia"), F.avg("value").alias("kbps"))
    b = c.where("arm = 'view'").select("clip", "rung", F.col("ia").alias("ib"), (F.abs(F.col("kbps") / 20 - 1) <= 0.10).alias("near"))
    p, near = c.where("arm <> 'view'").join(b, ["clip", "rung"]), lambda v: F.sum(F.when(F.col("near"), F.col(v)))
    pct = lambda a, b: F.round(100 * (a / b - 1), 6)
    return p.groupBy("arm").agg(pct(F.sum("ia"), F.sum("ib")).alias("total_pct"), pct(near("ia"), near("ib")).alias("near_pct"), F.round(F.max(100 * (F.col("ia") / F.col("ib") - 1)), 6).alias("worst_pct"))


_TREE = "t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS parent, CAST(floor(c_acctbal + 1000) AS BIGINT) AS own FROM customer)"


@query(f"WITH RECURSIVE {_TREE}, u AS (SELECT node AS leaf, node, own FROM t UNION ALL SELECT u.leaf, t.parent, u.own FROM u JOIN t ON t.node = u.node WHERE t.parent IS NOT NULL), i AS (SELECT node, CAST(sum(own) AS BIGINT) AS total FROM u GROUP BY node) SELECT i.node, i.total, i.total - coalesce(CAST(sum(k.total) AS BIGINT), 0) AS exclusive FROM i LEFT JOIN t ON t.parent = i.node LEFT JOIN i k ON k.node = t.node GROUP BY i.node, i.total")
def exclusive_counts(spark, sf_dir):
    """Of a call tree with total samples the samples of each node without its children's: one join with the sums by parent. The proxy's totals are made by its depth, a known number of rounds."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 0, F.floor((F.col("c_custkey") - 1) / 4)).alias("parent"), F.floor(F.col("c_acctbal") + 1000).alias("own"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.array(F.col("node")), lambda p, _: F.when(F.element_at(p, -1) > 0, F.concat(p, F.array(F.floor((F.element_at(p, -1) - 1) / 4)))).otherwise(p))
    total = t.select(F.explode(path).alias("node"), "own").groupBy("node").agg(F.sum("own").alias("total"))
    below = total.join(t.select("node", "parent"), "node").groupBy(F.col("parent").alias("node")).agg(F.sum("total").alias("below"))
    return total.join(below, "node", "left").select("node", "total", (F.col("total") - F.coalesce("below", F.lit(0))).alias("exclusive"))


@query("SELECT event_type AS stage, user_id AS leaf, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 5")
def top_leaves(spark, sf_dir):
    """The five leaves of each stage with most samples: a top-k report."""
    n = events(spark, sf_dir).groupBy(F.col("event_type").alias("stage"), F.col("user_id").alias("leaf")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("n"), "leaf"))).where("r <= 5").drop("r")


@query("WITH b AS (SELECT event_type, CAST(floor(log2(floor(value * 1000) + 1)) AS BIGINT) AS bucket, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY bucket) AS run, sum(c) OVER (PARTITION BY event_type) AS n FROM b) SELECT event_type, count(*) AS buckets, min(bucket) FILTER (WHERE run * 2 > n) AS p50, min(bucket) FILTER (WHERE run * 100 > n * 99) AS p99 FROM r GROUP BY event_type")
def log_histogram(spark, sf_dir):
    """Percentiles from counts by powers of two."""
    b = events(spark, sf_dir).groupBy("event_type", F.floor(F.log2(F.floor(F.col("value") * 1000) + 1)).alias("bucket")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type")
    r = b.withColumn("run", F.sum("c").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return r.groupBy("event_type").agg(F.count("*").alias("buckets"), F.min(F.when(F.col("run") * 2 > F.col("n"), F.col("bucket"))).alias("p50"), F.min(F.when(F.col("run") * 100 > F.col("n") * 99, F.col("bucket"))).alias("p99"))


@query("WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, round(max(value) OVER w - min(value) OVER w, 6) AS range, first_value(value) OVER w AS first, max(value) OVER w AS high, min(value) OVER w AS low FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_range(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf_dir).select("user_id", "event_id", F.round(F.max("value").over(w) - F.min("value").over(w), 6).alias("range"), F.first("value").over(w).alias("first"), F.max("value").over(w).alias("high"), F.min("value").over(w).alias("low"))


@query("WITH g AS (SELECT c_custkey // 40 AS y, c_custkey % 40 AS x, c_acctbal AS v FROM customer) SELECT g.y, g.x, coalesce(l.v, 0) AS beside, coalesce(u.v, 0) AS above, round((coalesce(l.v, 0) + coalesce(u.v, 0)) / 2, 4) AS mean FROM g LEFT JOIN g l ON l.y = g.y AND l.x = g.x - 1 LEFT JOIN g u ON u.y = g.y - 1 AND u.x = g.x")
def neighbour_lookup(spark, sf_dir):
    """The blocks on the left and above of a grid, by windows over rows and columns; a grid is dense, so that the place before is the neighbour."""
    g = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 40).alias("y"), (F.col("c_custkey") % 40).alias("x"), F.col("c_acctbal").alias("v"))
    zero = lambda by, along: F.coalesce(F.lag("v").over(Window.partitionBy(by).orderBy(along)), F.lit(0.0))
    n = g.select("y", "x", zero("y", "x").alias("beside"), zero("x", "y").alias("above"))
    return n.withColumn("mean", F.round((F.col("beside") + F.col("above")) / 2, 4))


@query("WITH u AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS period, (event_id * 7) % 16 AS poc FROM events), o AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY period, poc, event_id) AS gap FROM u) SELECT user_id, CAST(min(gap) AS BIGINT) AS least, CAST(max(gap) AS BIGINT) AS most, count(*) FILTER (WHERE gap < 0) AS backwards FROM o GROUP BY user_id")
def output_order_gaps(spark, sf_dir):
    """Gaps between units in output order: by key period, then picture order."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    u = events(spark, sf_dir).select("user_id", "event_id", F.sum((F.col("event_type") == "signup").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("period"), ((F.col("event_id") * 7) % 16).alias("poc"))
    o = u.select("user_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("period", "poc", "event_id"))).alias("gap"))
    return o.groupBy("user_id").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.count_if(F.col("gap") < 0).alias("backwards"))


#: Names of colour codes with their other spellings: fixed values of the standard.
COLOURS = {"bt709": 1, "undef": 2, "unspecified": 2, "bt470m": 4, "bt470bg": 5, "smpte170m": 6, "bt601": 6, "smpte240m": 7, "film": 8, "bt2020": 9}


@query("SELECT s_suppkey, CAST(CASE lower(name) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COLOURS.items()) + " ELSE -1 END AS INTEGER) AS code, map_extract(MAP {" + ", ".join(f"'{k}': {v}" for k, v in COLOURS.items()) + "}, 'bt2020')[1] AS wide FROM (SELECT s_suppkey, list_extract(['BT709', 'bt601', 'Film', 'BT2020', 'none', 'SMPTE240m'], CAST(s_suppkey % 6 + 1 AS INTEGER)) AS name FROM supplier)")
def colour_codes(spark, sf_dir):
    """Codes of names in any case, from a map of a fixed few; unknown names give -1."""
    codes = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    name = F.get(F.array(*map(F.lit, ("BT709", "bt601", "Film", "BT2020", "none", "SMPTE240m"))), (F.col("s_suppkey") % 6).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.try_element_at(codes, F.lower(name)), F.lit(-1)).alias("code"), F.element_at(codes, "bt2020").alias("wide"))


@query("SELECT event_id, CAST(floor(event_id * 90000.0 * 1001 / 30000) AS BIGINT) AS ticks, round(event_id * 1001.0 / 30000, 6) AS seconds, round(floor(value * 1000) / (300 / (30000.0 / 1001)) / 1000, 6) AS kbps, round((6 * value + user_id + 3) / 8, 6) AS plane_mean, CAST(CAST(value AS VARCHAR) AS DOUBLE) = value AS exact FROM events")
def rate_time(spark, sf_dir):
    """90 kHz ticks and seconds of a frame at 30000/1001 a second, kbit/s of 300 frames, the 6:1:1 mean of three planes, and that the shortest text of a double gives it back."""
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.floor(F.col("event_id") * F.lit(90000.0) * 1001 / 30000).alias("ticks"), F.round(F.col("event_id") * F.lit(1001.0) / 30000, 6).alias("seconds"), F.round(F.floor(v * 1000) / (F.lit(300.0) / (30000.0 / 1001)) / 1000, 6).alias("kbps"), F.round((6 * v + F.col("user_id") + 3) / 8, 6).alias("plane_mean"), (v.cast("string").cast("double") == v).alias("exact"))


@query("WITH a AS (SELECT event_id AS n, value AS src FROM events WHERE event_type <> 'error'), b AS (SELECT event_id AS n, value * 1.01 AS dec FROM events WHERE event_id % 7 <> 0), c AS (SELECT event_id AS n, event_id % 52 AS qp FROM events WHERE event_id % 5 <> 0) SELECT n, round(src - dec, 8) AS diff, qp FROM a JOIN b USING (n) JOIN c USING (n)")
def three_way_align(spark, sf_dir):
    """Source, decode and statistics joined on the frame's index; time stamps of three tools never agree."""
    e = events(spark, sf_dir).withColumnRenamed("event_id", "n")
    b, c = e.where("n % 7 <> 0").select("n", (F.col("value") * 1.01).alias("dec")), e.where("n % 5 <> 0").select("n", (F.col("n") % 52).alias("qp"))
    return e.where("event_type <> 'error'").select("n", F.col("value").alias("src")).join(b, "n").join(c, "n").select("n", F.round(F.col("src") - F.col("dec"), 8).alias("diff"), "qp")


@query("WITH c AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, min_by(event_id, (cost, n)) AS first_best, min(cost) AS cost, max_by(event_id, (cost, n)) AS last_worst FROM c GROUP BY user_id")
def first_wins(spark, sf_dir):
    """Of equal costs the first candidate: its place is part of what is compared."""
    cost = F.floor("value")
    return events(spark, sf_dir).groupBy("user_id").agg(F.min(F.struct(cost.alias("c"), "event_id")).alias("a"), F.max(F.struct(cost.alias("c"), "event_id")).alias("b")).select("user_id", F.col("a.event_id").alias("first_best"), F.col("a.c").alias("cost"), F.col("b.event_id").alias("last_worst"))


@query("WITH g AS (SELECT user_id AS run, event_id // 500 AS horizon, event_id AS gop, CAST(floor(value * 10) AS BIGINT) AS len FROM events) SELECT run, horizon, gop, row_number() OVER (PARTITION BY run, horizon ORDER BY len DESC, gop) AS place, CAST(sum(len) OVER (PARTITION BY run ORDER BY horizon, len DESC, gop) AS BIGINT) AS done FROM g")
def longest_first(spark, sf_dir):
    """The order of work: within a horizon the longest group first, and the work done by then."""
    g = events(spark, sf_dir).select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 500).alias("horizon"), F.col("event_id").alias("gop"), F.floor(F.col("value") * 10).alias("len"))
    order = [F.desc("len"), F.col("gop")]
    return g.select("run", "horizon", "gop", F.row_number().over(Window.partitionBy("run", "horizon").orderBy(*order)).cast("long").alias("place"), F.sum("len").over(Window.partitionBy("run").orderBy("horizon", *order).rowsBetween(Window.unboundedPreceding, 0)).alias("done"))


@query("SELECT step, CAST(gop AS BIGINT) AS gop, coprime FROM (SELECT step, gop, (SELECT count(*) FROM range(2, 10) t(k) WHERE step % k = 0 AND gop % k = 0) = 0 AS coprime FROM (SELECT CAST(n_nationkey + 1 AS BIGINT) AS step FROM nation), (SELECT unnest([1, 2, 4, 6, 8]) AS gop))")
def stride_check(spark, sf_dir):
    """A stride of scored frames must share no factor with the pattern of picture types, or it sees one type only."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("step"), F.explode(F.array(*(F.lit(g).cast("long") for g in (1, 2, 4, 6, 8)))).alias("gop"))
    shared = F.exists(F.sequence(F.lit(2), F.lit(9)), lambda k: (F.col("step") % k == 0) & (F.col("gop") % k == 0))
    return n.withColumn("coprime", ~shared)


@query("WITH s AS (SELECT user_id AS title, event_id AS shot, CAST(floor(value) AS BIGINT) + 1 AS frames FROM events) SELECT title, shot, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY title ORDER BY shot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM s")
def concatenated_shots(spark, sf_dir):
    """Where each shot begins when those of a title are put behind one another."""
    w = Window.partitionBy("title").orderBy("shot").rowsBetween(Window.unboundedPreceding, -1)
    s = events(spark, sf_dir).select(F.col("user_id").alias("title"), F.col("event_id").alias("shot"), (F.floor("value") + 1).alias("frames"))
    return s.withColumn("first", F.coalesce(F.sum("frames").over(w), F.lit(0)))


@query("WITH p AS (SELECT user_id AS clip, event_id AS try, 20 + event_id % 15 AS crf, floor(value * 100) + 1 AS bytes FROM events), t AS (SELECT clip, avg(bytes) AS target FROM p GROUP BY clip), m AS (SELECT clip, any_value(target) AS target, arg_min({c: crf, b: bytes}, (abs(ln(bytes / target)), try)) AS x FROM p JOIN t USING (clip) GROUP BY clip) SELECT clip, x.c AS crf, CAST(x.b AS BIGINT) AS bytes, round(least(greatest(6 * log2(x.b / target), -8), 8), 4) AS step FROM m")
def nearest_operating_point(spark, sf_dir):
    """Of the measured points the one nearest to the target size by the logarithm, and the next step of the solve, at most 8 either way."""
    p = events(spark, sf_dir).select(F.col("user_id").alias("clip"), F.col("event_id").alias("try"), (20 + F.col("event_id") % 15).alias("crf"), (F.floor(F.col("value") * 100) + 1).alias("bytes"))
    t = p.groupBy("clip").agg(F.avg("bytes").alias("target"))
    m = p.join(t, "clip").groupBy("clip").agg(F.first("target").alias("target"), F.min(F.struct(F.abs(F.ln(F.col("bytes") / F.col("target"))).alias("away"), "try", "crf", "bytes")).alias("m"))
    return m.select("clip", "m.crf", "m.bytes", F.round(F.least(F.greatest(6 * F.log2(F.col("m.bytes") / F.col("target")), F.lit(-8.0)), F.lit(8.0)), 4).alias("step"))


#: What each preset sets (search level, sub-sample search or -1, references, lookahead, arithmetic coding, 8x8 transform, B pictures, settling of the search).
PRESETS = [("ultrafast", 1, 2, 1, 0, 0, 0, 0, 1), ("superfast", 1, 2, 1, 0, 1, 1, 3, 1), ("veryfast", 2, 2, 1, 10, 1, 1, 3, 1), ("faster", 4, 2, 2, 20, 1, 1, 3, 1), ("fast", 6, 2, 2, 30, 1, 1, 3, 0), ("medium", 7, 2, 3, 40, 1, 1, 3, 0), ("slow", 8, -1, 5, 50, 1, 1, 3, 0), ("slower", 9, -1, 8, 60, 1, 1, 3, 0), ("veryslow", 10, -1, 16, 60, 1, 1, 3, 0), ("placebo", 11, -1, 16, 60, 1, 1, 3, 0)]


@query("WITH p(preset, subme, subpel, ref, lookahead, cabac, tr8, bframes, settle) AS (VALUES " + ", ".join(map(str, PRESETS)) + ") SELECT preset, count(*) AS runs, any_value(lookahead) AS lookahead, any_value(ref) AS ref, round(avg(o_totalprice), 2) AS mean FROM orders JOIN p ON preset = list_extract(['ultrafast', 'medium', 'slow', 'placebo', 'none'], CAST(o_custkey % 5 + 1 AS INTEGER)) GROUP BY preset")
def preset_table(spark, sf_dir):
    """Runs joined with the settings of their preset, a table of fixed size; runs of unknown presets drop out."""
    p = spark.createDataFrame(PRESETS, "preset string, subme int, subpel int, ref int, lookahead int, cabac int, tr8 int, bframes int, settle int")
    o = table(spark, sf_dir, "orders").select("o_totalprice", F.get(F.array(*map(F.lit, ("ultrafast", "medium", "slow", "placebo", "none"))), (F.col("o_custkey") % 5).cast("int")).alias("preset"))
    return o.join(F.broadcast(p), "preset").groupBy("preset").agg(F.count("*").alias("runs"), F.first("lookahead").alias("lookahead"), F.first("ref").alias("ref"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT o_orderstatus AS arm, c_mktsegment AS corpus, count(*) AS runs, count(DISTINCT o_custkey) AS clips, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(max(o_totalprice), 2) AS worst FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderstatus, c_mktsegment")
def band_at_rate(spark, sf_dir):
    """Mean, median and worst of an arm over each corpus."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("corpus"))
    v = lambda f: F.round(f("o_totalprice"), 2)
    return table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy(F.col("o_orderstatus").alias("arm"), "corpus").agg(F.count("*").alias("runs"), F.countDistinct("o_custkey").alias("clips"), v(F.avg).alias("mean"), v(F.median).alias("median"), v(F.max).alias("worst"))


@query("WITH r AS (SELECT l_orderkey AS cell, l_linenumber AS step, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bits, CAST(floor(l_quantity) AS BIGINT) AS qp, l_suppkey FROM lineitem) SELECT count(*) AS steps, count(*) FILTER (WHERE qp NOT BETWEEN 0 AND 51) AS qp_out, count(*) FILTER (WHERE bits <= 0) AS no_bits, count(DISTINCT cell) AS cells, CAST(bit_xor(bits * 31 + qp) AS BIGINT) AS checksum FROM r")
def replay_invariants(spark, sf_dir):
    """What must hold for every step of a replayed run, and a checksum that does not depend on the order of the rows."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.floor(F.col("l_extendedprice") * 100).alias("bits"), F.floor("l_quantity").alias("qp"))
    return r.agg(F.count("*").alias("steps"), F.count_if(~F.col("qp").between(0, 51)).alias("qp_out"), F.count_if(F.col("bits") <= 0).alias("no_bits"), F.countDistinct("cell").alias("cells"), F.bit_xor(F.col("bits") * 31 + F.col("qp")).alias("checksum"))


@query("WITH r AS (SELECT o_custkey AS cell, o_orderpriority AS build, o_orderstatus AS side, o_orderkey AS record, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), a AS (SELECT cell, build, arg_min(record, record) AS record, arg_min(bytes, record) AS bytes FROM r WHERE side = 'F' GROUP BY cell, build), b AS (SELECT cell, build, record, bytes FROM r WHERE side = 'O') SELECT a.cell, a.build, a.record AS anchor, arg_min(b.record, (abs(b.bytes - a.bytes), b.record)) AS ours, min(abs(b.bytes - a.bytes)) AS apart FROM a JOIN b USING (cell, build) GROUP BY a.cell, a.build, a.record")
def point_on_its_bytes(spark, sf_dir):
    """An anchor's point and, of the same cell and build, the point of ours that is nearest to it in bytes."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderpriority").alias("build"), "o_orderstatus", F.col("o_orderkey").alias("record"), F.floor("o_totalprice").alias("bytes"))
    a = r.where("o_orderstatus = 'F'").groupBy("cell", "build").agg(F.min(F.struct("record", "bytes")).alias("a"))
    b = r.where("o_orderstatus = 'O'").select("cell", "build", "record", "bytes")
    near = a.join(b, ["cell", "build"]).groupBy("cell", "build", "a").agg(F.min(F.struct(F.abs(F.col("bytes") - F.col("a.bytes")).alias("apart"), "record")).alias("m"))
    return near.select("cell", "build", F.col("a.record").alias("anchor"), F.col("m.record").alias("ours"), "m.apart")


@query("WITH c AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS p), q AS (SELECT p, (SELECT quantile_cont(value, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) FROM events)[CAST(round(p * 20) AS INTEGER)] AS cut FROM c), s AS (SELECT cut, count(*) FILTER (WHERE value <= cut) AS l, count(*) FILTER (WHERE value <= cut AND event_type = 'error') AS le, count(*) FILTER (WHERE value > cut) AS r, count(*) FILTER (WHERE value > cut AND event_type = 'error') AS re FROM q, events GROUP BY cut) SELECT round(cut, 6) AS cut, l, r, round((l * (1 - pow(CAST(le AS DOUBLE) / l, 2) - pow(1 - CAST(le AS DOUBLE) / l, 2)) + r * (1 - pow(CAST(re AS DOUBLE) / r, 2) - pow(1 - CAST(re AS DOUBLE) / r, 2))) / (l + r), 8) AS impurity FROM s WHERE l > 0 AND r > 0")
def gini_cuts(spark, sf_dir):
    """The impurity of a split at each of nineteen quantiles, the step that a decision tree repeats: one pass counts between the cuts, running sums give both sides. The cuts are nineteen numbers."""
    e = events(spark, sf_dir).select("value", (F.col("event_type") == "error").cast("long").alias("hit"))
    cuts = e.agg(F.percentile("value", F.array(*(F.lit(k / 20) for k in range(1, 20)))).alias("q")).first().q or []
    at = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    n = e.groupBy(at.alias("k")).agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    every = F.struct(F.sum("n").alias("n"), F.sum("h").alias("h"))
    sides = n.agg(F.collect_list(F.struct("k", "n", "h")).alias("x"), every.alias("all"))  # twenty rows at most
    one = sides.select("x", "all", F.posexplode(F.array(*(F.lit(c) for c in cuts))).alias("i", "cut")) if cuts else sides.select("x", "all", F.lit(0).alias("i"), F.lit(0.0).alias("cut")).where("false")
    left = lambda c: F.aggregate(F.filter("x", lambda v: v["k"] <= F.col("i")), F.lit(0).cast("long"), lambda s, v: s + v[c])
    s = one.select("cut", left("n").alias("l"), left("h").alias("le"), "all").select("cut", "l", "le", (F.col("all.n") - F.col("l")).alias("r"), (F.col("all.h") - F.col("le")).alias("re")).where("l > 0 and r > 0").distinct()
    gini = lambda n, h: F.col(n) * (1 - F.pow(F.col(h) / F.col(n), F.lit(2)) - F.pow(1 - F.col(h) / F.col(n), F.lit(2)))
    return s.select(F.round("cut", 6).alias("cut"), "l", "r", F.round((gini("l", "le") + gini("r", "re")) / (F.col("l") + F.col("r")), 8).alias("impurity"))


@query("SELECT 's' || CAST(s AS VARCHAR) AS seed, cell, opt FROM (SELECT s, n_name AS cell, opt, row_number() OVER (PARTITION BY s, n_name ORDER BY md5(concat(CAST(s AS VARCHAR), ':', n_name, ':', opt))) AS k FROM nation, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest(['aq', 'cabac', 'tr8', 'ref', 'bframes', 'trellis']) AS opt)) WHERE k <= 2")
def seeded_matrix(spark, sf_dir):
    """A regression matrix: for each seed and cell two options, drawn by a digest that any later run repeats."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("cell"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("s"))
    m = n.withColumn("opt", F.explode(F.array(*map(F.lit, ("aq", "cabac", "tr8", "ref", "bframes", "trellis")))))
    key = F.md5(F.concat_ws(":", F.col("s").cast("string"), "cell", "opt"))
    return m.withColumn("k", F.row_number().over(Window.partitionBy("s", "cell").orderBy(key))).where("k <= 2").select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("seed"), "cell", "opt")
