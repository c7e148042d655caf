"""Tables written to the folder that driver and executors share, to cut lineage."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written between two sweeps.
SWEEP = 6
#: Used only by a local master whose session names no folder, as in tests: its executors are threads of the driver's machine.
LOCAL = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of setCheckpointDir; on a cluster without either, an error instead of a folder that is not shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = LOCAL
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lumaframe/{label}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Lets go of what finished steps have left. Spark deletes the shuffle files of a query once the driver has collected its plan as garbage, which may take long by itself; nothing that is still in use is touched."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, label: str, few: bool = False) -> DataFrame:
    """df, computed once, written as Parquet to the shared folder and read back: later reads survive lost executors.

    few: the rows are few for the tasks that make them; they are brought together by size first, so that not every task leaves a file.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.hint("rebalance") if few else df).write.parquet(path)
    context = spark.sparkContext
    context._lumaframe_written = getattr(context, "_lumaframe_written", 0) + 1
    if context._lumaframe_written % SWEEP == 0:
        sweep(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written(), once all that was derived from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or with underscores after it if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def met_by(rows: DataFrame, table: DataFrame, key: list[str], count: str, least: int = 1000) -> DataFrame:
    """rows joined with table, which has one row a key with the number of rows that have it in column `count`.

    Keys of more than max(least, a 10,000th of all) rows, fewer than 10,000 of them by that, are broadcast, so that no task gets a hot key; all others are shuffled.
    """
    total = table.agg(F.sum(count).alias("n")).first().n or 0
    often = max(least, total // 10_000)
    hot = table.where(F.col(count) > often).drop(count)
    if not hot.limit(1).count():
        return rows.join(table.drop(count), key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(table.where(F.col(count) <= often).drop(count), key))


def row_key(text: str = "text"):
    """A hash that, next to doc_id, tells rows of one id with different texts apart; rows equal in both share results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
