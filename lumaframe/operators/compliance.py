"""Buffer checks over coded streams."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import arrivals


def buffer_check(units: DataFrame, by: str, order: str, bits: str, rate: float, size: float, delay: float, spacing: float, constant: bool = False) -> DataFrame:
    """units with t_out (removal), t_start and t_end (arrival), held (bits in the buffer just before removal), under (not complete when removed) and over (more held than `size`).

    Removals are `spacing` apart, the first after `delay`. A unit arrives when the one before it has, and unless delivery is constant no earlier than `delay` before its removal.
    Held with pauses: all that has arrived by the removal, less the units removed before; arrivals are in order, so what has arrived by an instant is the sum of
    the whole units before it and a part of one, found by an as-of join of removals with arrivals instead of a sum over every unit under way.
    """
    w = Window.partitionBy(by).orderBy(order)
    x = units.withColumn("t_out", delay + spacing * (F.row_number().over(w) - 1))
    x = arrivals(x, by, order, F.lit(0.0) if constant else F.greatest(F.col("t_out") - delay, F.lit(0.0)), F.col(bits) / rate)
    x = x.withColumn("_before", F.coalesce(F.sum(bits).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if constant:
        x = x.withColumn("held", rate * F.col("t_out") - F.col("_before"))
    else:
        marks = x.select(by, F.col("t_out").alias("_t"), F.lit(1).alias("_kind"), F.struct(order).alias("_at"), F.lit(None).cast("struct<s: double, e: double, b: double, before: double>").alias("_unit"))
        begins = x.select(by, F.col("t_start").alias("_t"), F.lit(0).alias("_kind"), F.struct(order).alias("_at"), F.struct(F.col("t_start").alias("s"), F.col("t_end").alias("e"), F.col(bits).cast("double").alias("b"), F.col("_before").cast("double").alias("before")).alias("_unit"))
        last = F.last("_unit", ignorenulls=True).over(Window.partitionBy(by).orderBy("_t", "_kind", "_at").rowsBetween(Window.unboundedPreceding, 0))
        met = marks.unionByName(begins).select(by, "_kind", F.col("_at")[order].alias(order), "_t", last.alias("_u")).where("_kind = 1")
        part = F.when(F.col("_u.e") > F.col("_t"), F.col("_u.b") * (F.col("_t") - F.col("_u.s")) / (F.col("_u.e") - F.col("_u.s"))).otherwise(F.col("_u.b"))
        x = x.join(met.select(by, order, (F.col("_u.before") + part).alias("_arrived")), [by, order]).withColumn("held", F.greatest(F.col("_arrived") - F.col("_before"), F.lit(0.0))).drop("_arrived")
    return x.withColumns({"under": F.col("t_out") < F.col("t_end") - 1e-9, "over": F.col("held") > size + 1e-6}).drop("_before")


def buffer_report(checked: DataFrame, by: str) -> DataFrame:
    """by, units, underflows, overflows, most_held, least_margin (of a removal after the end of arrival)."""
    return checked.groupBy(by).agg(F.count("*").alias("units"), F.count_if("under").alias("underflows"), F.count_if("over").alias("overflows"), F.round(F.max("held"), 4).alias("most_held"), F.round(F.min(F.col("t_out") - F.col("t_end")), 6).alias("least_margin"))


def suffix_equal(a: DataFrame, b: DataFrame, by: str, order: str, digest: str, tail: int) -> DataFrame:
    """by, differing: how many of the last `tail` frame hashes differ between two decodes, counted from the end."""
    last = lambda df, name: df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= tail).select(by, "_r", F.col(digest).alias(name))
    return last(a, "x").join(last(b, "y"), [by, "_r"], "full").groupBy(by).agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))
