"""Joins that Spark has no operator for, as compositions of those it has."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, zones: DataFrame, at: str, first: str, last: str, cell: int) -> DataFrame:
    """Each point with every closed interval that holds it: an equi-join on cells of `cell` units, then the exact test. No nested loop, whatever the sizes."""
    cut = zones.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(first) / cell), F.floor(F.col(last) / cell))))
    return points.withColumn("_cell", F.floor(F.col(at) / cell)).join(cut, "_cell").where(F.col(at).between(F.col(first), F.col(last))).drop("_cell")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], cell: int) -> DataFrame:
    """Pairs of closed intervals that overlap, each once: met in the cell where the overlap begins."""
    cells = lambda df, s: df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s[0]) / cell), F.floor(F.col(s[1]) / cell))))
    both = cells(a, a_span).join(cells(b, b_span), "_cell")
    begin, end = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    return both.where((begin <= end) & (F.floor(begin / cell) == F.col("_cell"))).withColumns({"from": begin, "to": end}).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: dict[str, str]) -> DataFrame:
    """left with, for each new name in value, the right-hand column of the last right row at or before `at` within the group: union and a running last."""
    cols = [c for c in left.columns]
    kind = {f.name: f.dataType for f in left.schema.fields}
    l = left.select(*cols, F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[src].dataType).alias(new) for new, src in value.items()))
    r = right.select(*(F.col(c).cast(kind[c]).alias(c) if c in [*by, at] else F.lit(None).cast(kind[c]).alias(c) for c in cols), F.lit(0).alias("_side"), *(F.col(src).alias(new) for new, src in value.items()))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).select(*cols, "_side", *(F.last(new, ignorenulls=True).over(w).alias(new) for new in value)).where("_side = 1").drop("_side")


def bracketing(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Consecutive points of each curve as segments (x0, y0, x1, y1)."""
    w = Window.partitionBy(*by).orderBy(x)
    return curve.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).where("x1 is not null")


def log_interpolated(target: Column) -> Column:
    """exp of the line through (x0, ln y0) and (x1, ln y1) at target."""
    f = (target - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return F.exp(F.ln("y0") + f * (F.ln("y1") - F.ln("y0")))


def with_fallback(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """A left join whose missing right values take defaults."""
    return left.join(right, on, "left").select(*left.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(key, F.lit(side).alias("only_in"))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def beside(rows: DataFrame, key: str, value: str, reach: int, span: int = 1000) -> DataFrame:
    """key, value and near, an array of (d, value) of the rows up to `reach` places away, for rows numbered by a whole key.

    Rows are cut by the key into groups of `span` places, each with a margin of its neighbours' ends, and a window runs over a group: each row is moved once and a few twice,
    and no sort is longer than a group.
    """
    own = rows.select(F.col(key), F.col(value), F.floor(F.col(key) / span).alias("_g"), F.lit(True).alias("_own"))
    place = F.pmod(F.col(key), F.lit(span))
    margin = lambda at, step: own.where(at).withColumn("_g", F.col("_g") + step).withColumn("_own", F.lit(False))
    every = own.unionByName(margin(place < reach, -1)).unionByName(margin(place >= span - reach, 1))
    near = F.collect_list(F.struct(F.col(key).alias("k"), F.col(value))).over(Window.partitionBy("_g").orderBy(key).rangeBetween(-reach, reach))
    others = F.transform(F.filter("_near", lambda n: n["k"] != F.col(key)), lambda n: F.struct((n["k"] - F.col(key)).alias("d"), n[value].alias(value)))
    return every.withColumn("_near", near).where("_own").select(key, value, others.alias("near"))


def overlaps_within(zones: DataFrame, first: str, last: str, cell: int) -> DataFrame:
    """Intervals that overlap one that begins earlier, or begins with them and ends earlier, by cells: no window over all of them."""
    key = zones.withColumn("_id", F.monotonically_increasing_id())
    a = key.select(F.col(first).alias("_a0"), F.col(last).alias("_a1"), F.col("_id").alias("_ai"))
    met = overlap_join(key, a, (first, last), ("_a0", "_a1"), cell)
    before = (F.col("_a0") < F.col(first)) | ((F.col("_a0") == F.col(first)) & ((F.col("_a1") < F.col(last)) | ((F.col("_a1") == F.col(last)) & (F.col("_ai") < F.col("_id")))))
    return met.where(before).select(*zones.columns, "_id").dropDuplicates(["_id"]).drop("_id")
