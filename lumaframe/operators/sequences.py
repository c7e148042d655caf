"""Operations on ordered rows: windows where the state allows it, folds over a group's sorted array where it does not."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaky_bucket(units: DataFrame, by: str, order: list[str], bits: str, size: int, rate: int, start: int | None = None, span: int = 10_000) -> DataFrame:
    """by, n, underflows, fill_end: f = min(f + rate, size) - bits; below 0 an underflow is counted and f is 0. The first unit does not refill.

    A stream is cut into pieces of `span` units. What a piece does to the fill is a shift between two bounds, whatever it holds, and such maps are closed under composition: the fills
    at which pieces begin follow from one map a piece, and then each piece is counted by itself. So no task holds a whole stream.
    """
    long = lambda v: F.lit(v).cast("long")
    w = Window.partitionBy(by).orderBy(*order)
    unit = F.struct(F.col("_i").alias("i"), F.col(bits).cast("long").alias("b"))
    pieces = units.withColumn("_i", F.row_number().over(w) - 1).withColumn("_piece", F.floor(F.col("_i") / span)).groupBy(by, "_piece").agg(F.array_sort(F.collect_list(unit)).alias("_u"))
    clamp = lambda m, x: F.least(F.greatest(x + m["a"], m["lo"]), m["hi"])

    def compose(m: Column, u: Column) -> Column:
        one = F.struct((F.when(u["i"] == 0, long(0)).otherwise(long(rate)) - u["b"]).alias("a"), long(0).alias("lo"), F.greatest(long(size) - u["b"], long(0)).alias("hi"))
        return F.struct((m["a"] + one["a"]).alias("a"), clamp(one, m["lo"]).alias("lo"), clamp(one, m["hi"]).alias("hi"))

    wide = 1 << 60  # further than any sum of bits goes
    maps = pieces.select(by, "_piece", F.aggregate("_u", F.struct(long(0).alias("a"), long(-wide).alias("lo"), long(wide).alias("hi")), compose).alias("_m"))
    first = long(size if start is None else start)
    begin = F.struct(first.alias("f"), F.expr("cast(array() as array<struct<_piece: bigint, _f: bigint>>)").alias("out"))
    follow = lambda s, m: F.struct(clamp(m["_m"], s["f"]).alias("f"), F.concat(s["out"], F.array(F.struct(m["_piece"].alias("_piece"), s["f"].alias("_f")))).alias("out"))
    fills = maps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_piece", "_m"))).alias("_all")).select(by, F.explode(F.aggregate("_all", begin, follow, lambda s: s["out"])).alias("_x")).select(by, "_x.*")

    def step(s: Column, u: Column) -> Column:
        f = F.when(u["i"] == 0, s["f"]).otherwise(F.least(s["f"] + rate, long(size))) - u["b"]
        return F.struct(F.greatest(f, long(0)).alias("f"), (s["under"] + (f < 0).cast("long")).alias("under"))

    done = pieces.join(fills, [by, "_piece"]).select(by, "_piece", F.size("_u").alias("_n"), F.aggregate("_u", F.struct(F.col("_f").alias("f"), long(0).alias("under")), step).alias("_s"))
    return done.groupBy(by).agg(F.sum("_n").alias("n"), F.sum("_s.under").alias("underflows"), F.max_by("_s.f", "_piece").alias("fill_end"))


def arrivals(units: DataFrame, by: str, order: str, earliest: Column, duration: Column) -> DataFrame:
    """units with t_start, t_end of the recurrence t_start = max(t_end before, earliest): a running maximum of (earliest - work before) plus the work, no loop."""
    w = Window.partitionBy(by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = units.withColumns({"_e": earliest, "_d": duration}).withColumn("_work", F.sum("_d").over(run))
    x = x.withColumn("t_end", F.max(F.col("_e") - (F.col("_work") - F.col("_d"))).over(run) + F.col("_work"))
    return x.withColumn("t_start", F.col("t_end") - F.col("_d")).drop("_e", "_d", "_work")


def runs(rows: DataFrame, by: str, order: str, flag: Column, least: int) -> DataFrame:
    """by, first, last, n of the runs of at least `least` rows in a row for which flag holds (gaps and islands)."""
    w = Window.partitionBy(by).orderBy(order)
    x = rows.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_i", F.row_number().over(w))
    x = x.where("_on").withColumn("_island", F.col("_i") - F.row_number().over(w))
    return x.groupBy(by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def unwrapped(rows: DataFrame, by: str, order: str, counter: str, modulus: int) -> DataFrame:
    """rows with `whole`: the counter plus the modulus times the wraps so far."""
    w = Window.partitionBy(by).orderBy(order)
    wrap = (F.col(counter) < F.lag(counter).over(w)).cast("long")
    return rows.withColumn("_wrap", F.coalesce(wrap, F.lit(0))).withColumn("whole", F.col(counter) + modulus * F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_wrap")


def gaussian(rows: DataFrame, by: str, index: str, value: str, sigma: float, weight: Column | None = None) -> DataFrame:
    """by, index, blurred: a centred window of radius ceil(3 sigma), clipped at the ends, as a frame over the sorted rows of a group."""
    radius = int(-(-3 * sigma // 1))
    x = rows.select(by, index, F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w")).alias("_x"))
    near = F.collect_list("_x").over(Window.partitionBy(by).orderBy(index).rangeBetween(-radius, radius))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("g"))

    def add(s: Column, n: Column) -> Column:
        d = (n["i"] - F.col(index)).cast("double")
        g = F.exp(-(d * d) / (2.0 * sigma * sigma)) * n["w"]
        return F.struct((s["s"] + n["v"] * g).alias("s"), (s["g"] + g).alias("g"))

    return x.withColumn("_near", near).select(by, index, F.aggregate("_near", zero, add, lambda s: s["s"] / s["g"]).alias("blurred"))


def decayed(rows: DataFrame, by: str, order: list[str], value: str, limit: int) -> DataFrame:
    """by, total, count of a tally whose sums are halved (shifted) whenever the count reaches the limit.

    When that is follows from places alone: after the first `limit` rows, then after every limit - limit // 2. So rows are summed between halvings, and only
    these sums, a row for each halving, are folded in order.
    """
    step = limit - limit // 2
    long = lambda v: F.lit(v).cast("long")
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")
    block = F.when(F.col("_i") <= limit, long(0)).otherwise(F.floor((F.col("_i") - limit - 1) / step) + 1)
    sums = rows.select(by, F.col(value).cast("long").alias("_v"), place.alias("_i")).withColumn("_block", block).groupBy(by, "_block").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    full = lambda x: x["_n"] == F.when(x["_block"] == 0, long(limit)).otherwise(long(step))
    half = lambda v, x: F.when(full(x), F.shiftright(v, 1)).otherwise(v)
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("_block", "_s", "_n"))), F.struct(long(0).alias("t"), long(0).alias("c")), lambda s, x: F.struct(half(s["t"] + x["_s"], x).alias("t"), half(s["c"] + x["_n"], x).alias("c")))
    return sums.groupBy(by).agg(fold.alias("_f")).select(by, F.col("_f.t").alias("total"), F.col("_f.c").alias("count"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def sessions(units: DataFrame, by: str, order: str, opens: Column, body: Column) -> DataFrame:
    """units with `unit`: the number of the access unit. A row that may open one does so only once a body row came since the last opening.

    Of consecutive openers only the first counts, so an opener counts if the row before it that is either kind is a body row.
    """
    w = Window.partitionBy(by).orderBy(order)
    kind = F.when(body, 1).when(opens, 0)
    before = F.last(kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = units.withColumn("_new", F.when(opens & (before == 1), 1).otherwise(0))
    return x.withColumn("unit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def picture_order(frames: DataFrame, by: str, order: str, low: str, reference: str, modulus: int) -> DataFrame:
    """by, order, whole: counts whose low part is coded; the high part is that of the last reference picture, one modulus more or less where the low parts are half of it apart."""
    long = lambda v: F.lit(v).cast("long")
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(low).cast("long").alias("l"), F.col(reference).alias("r"))))
    zero = F.struct(long(0).alias("msb"), long(0).alias("lsb"), F.expr(f"cast(array() as array<struct<o: {frames.schema[order].dataType.simpleString()}, whole: bigint>>)").alias("out"))

    def step(s: Column, u: Column) -> Column:
        msb = F.when((u["l"] < s["lsb"]) & (s["lsb"] - u["l"] >= modulus // 2), s["msb"] + modulus).when((u["l"] > s["lsb"]) & (u["l"] - s["lsb"] > modulus // 2), s["msb"] - modulus).otherwise(s["msb"])
        msb = F.when(F.size(s["out"]) == 0, long(0)).otherwise(msb)
        return F.struct(F.when(u["r"], msb).otherwise(s["msb"]).alias("msb"), F.when(u["r"], u["l"]).otherwise(s["lsb"]).alias("lsb"), F.concat(s["out"], F.array(F.struct(u["o"].alias("o"), (msb + u["l"]).alias("whole")))).alias("out"))

    return frames.groupBy(by).agg(F.aggregate(seq, zero, step, lambda s: s["out"]).alias("x")).select(by, F.explode("x").alias("x")).select(by, F.col("x.o").alias(order), "x.whole")
