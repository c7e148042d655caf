"""Aggregates and verdicts over measurement records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_spread(rows: DataFrame, by: str, value: str, least: int = 4) -> DataFrame:
    """by, n, centre (median), rsd (1.4826 * median absolute deviation), mean, sd, low, high, of groups with at least `least` rows."""
    centre = rows.groupBy(by).agg(F.median(value).alias("centre"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")).where(F.col("n") >= least)
    away = rows.join(centre.select(by, "centre"), by).groupBy(by).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("centre")))).alias("rsd"))
    return centre.join(away, by)


def histogram_percentile(rows: DataFrame, by: str, bin: Column, numerator: int = 1, denominator: int = 4) -> DataFrame:
    """by, bin: the first bin whose running count is strictly above numerator/denominator of all; exact, from counts per bin alone."""
    bins = rows.groupBy(F.col(by), bin.alias("bin")).count()
    w = Window.partitionBy(by)
    run = bins.withColumn("_run", F.sum("count").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("count").over(w))
    return run.where(F.col("_run") * denominator > F.col("_all") * numerator).groupBy(by).agg(F.min("bin").alias("bin"))


def board(rows: DataFrame, by: str, title: str, ratio: str, most: float = 1.0, worst: float = 1.15) -> DataFrame:
    """by, n, median, worst, worst_title, verdict; of equal ratios the last title counts."""
    x = rows.groupBy(by).agg(F.count("*").alias("n"), F.median(ratio).alias("median"), F.max(F.struct(F.col(ratio).alias("r"), F.col(title).alias("t"))).alias("w"))
    return x.select(by, "n", "median", F.col("w.r").alias("worst"), F.col("w.t").alias("worst_title"), F.when((F.col("median") <= most) & (F.col("w.r") <= worst), "PASS").otherwise("OPEN").alias("verdict"))


def floor_verdict(rows: DataFrame, by: str, title: str, value: str, fail: float = -1.0, debt: float = -0.5) -> DataFrame:
    """by, median, n_fail, n_debt, failing (sorted titles), verdict: FAIL below `fail`, DEBT from there to `debt`. Missing values are left out."""
    v = F.col(value)
    x = rows.where(v.isNotNull()).groupBy(by).agg(
        F.median(value).alias("median"), F.count_if(v < fail).alias("n_fail"), F.count_if(v.between(fail, debt)).alias("n_debt"), F.array_join(F.array_sort(F.collect_list(F.when(v < fail, F.col(title).cast("string")))), ",").alias("failing"))
    return x.withColumn("verdict", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_debt") > 0, "DEBT").otherwise("PASS"))


def census(rows: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """by, n, share_pct of all rows, or of those equal in `within`."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*(within or [F.lit(1)]))))


def bd_rate4(points: DataFrame, by: list[str], arm: str, anchor: str, rate: str, score: str) -> DataFrame:
    """by, arm, bd_pct: Bjontegaard rate difference to the anchor, for curves of exactly four points with different scores; NULL where the scores do not overlap.

    With four points the cubic fit of ln(rate) on score is the interpolating cubic: Lagrange's form, in plain expressions.
    """
    curve = points.groupBy(*by, arm).agg(F.array_sort(F.collect_list(F.struct(F.col(score).cast("double").alias("s"), F.ln(rate).alias("r")))).alias("c")).where("size(c) = 4 and c[0].s < c[1].s and c[1].s < c[2].s and c[2].s < c[3].s")
    a = curve.where(F.col(arm) == anchor).select(*by, F.col("c").alias("a"))
    both = curve.where(F.col(arm) != anchor).join(a, by)
    s = lambda c, i: F.col(c)[i]["s"]
    both = both.withColumns({"lo": F.greatest(s("a", 0), s("c", 0)), "hi": F.least(s("a", 3), s("c", 3))})

    def at(c: str, x: Column) -> Column:
        out = None
        for i in range(4):
            term = F.col(c)[i]["r"]
            for j in range(4):
                if j != i:
                    term = term * (x - s(c, j)) / (s(c, i) - s(c, j))
            out = term if out is None else out + term
        return out

    x = lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / 99.0
    mean = F.aggregate(F.sequence(F.lit(0), F.lit(99)), F.lit(0.0), lambda t, k: t + at("c", x(k)) - at("a", x(k))) / 100.0
    return both.select(*by, arm, F.when(F.col("hi") > F.col("lo"), (F.exp(mean) - 1) * 100).alias("bd_pct"))
