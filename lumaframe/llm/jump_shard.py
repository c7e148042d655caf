"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

No ring table: the shard follows from the key and the number of shards. One more shard takes only
the rows that move into it.

Edge cases: a null key counts as key 0; a null text has size 1 and checksum 0; equal rows get one slot each;
an empty table gives an empty result; further columns of the input are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published generator, 2862933555777941757.
MULTIPLIER = 2862933555777941757
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M32 = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2**64 in 32-bit halves; no product passes 48 bits, so ANSI mode never overflows."""
    low_half, high_half = lo.bitwiseAND(0xFFFF) * _LO, F.shiftright(lo, 16) * _LO
    low = low_half + F.shiftleft(high_half.bitwiseAND(0xFFFF), 16) + 1

    def times32(x: Column, c: int) -> Column:
        return x.bitwiseAND(0xFFFF) * c + F.shiftleft((F.shiftright(x, 16) * c).bitwiseAND(0xFFFF), 16)

    high = F.shiftright(low, 32) + F.shiftright(high_half, 16) + times32(hi, _LO) + times32(lo, _HI)
    return high.bitwiseAND(_M32), low.bitwiseAND(_M32)


def jump(key: Column, shards: int) -> Column:
    """STRUCT<at, grown>: the key's shard among `shards`, and among one more.

    The published loop, as a fold: a key makes at most one jump a shard.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_M32).alias("lo"),
        long(0).alias("at"), long(0).alias("grown"), long(0).alias("next"),
    )

    def merge(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        landed = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"),
            F.when(s["next"] < shards, s["next"]).otherwise(s["at"]).alias("at"),
            s["next"].alias("grown"), landed.alias("next"),
        )
        return F.when(s["next"] <= shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, merge, lambda s: F.struct(s["at"].cast("int").alias("at"), s["grown"].cast("int").alias("grown")))


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_block: int = 20_000) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard for every row.

    slot runs gapless from 0 within a shard. Shards are cut into blocks of about rows_per_block rows by a hash of the key;
    rows are numbered within a block and blocks are offset by a running sum over the small table of block counts,
    so that no task sees a whole shard.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    blocks = max(64, -(-docs.count() // (shards * rows_per_block)))
    rows = docs.select(
        F.col(key).alias("_key"), (F.octet_length(text_col) + 1).cast("long").alias("size"), F.crc32(text_col).alias("text_crc32"), jump(F.col(key), shards).alias("_to"),
    ).select("_key", "size", "text_crc32", F.col("_to.at").alias("shard"), F.col("_to.grown").alias("grown_shard"), F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(blocks)).cast("int").alias("_block"))
    offsets = rows.groupBy("shard", "_block").count().withColumn(
        "_before", F.sum("count").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ).select("shard", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_within", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_key", "text_crc32", "size")) - 1)
    return numbered.join(offsets, ["shard", "_block"]).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_within") + F.col("_before")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """All columns of docs under path, one folder shard=k for each shard."""
    docs.withColumn("shard", jump(F.col(key), shards)["at"]).write.partitionBy("shard").parquet(path)
