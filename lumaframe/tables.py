"""Reading the driver's tables."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to an Arrow function, unless the session says otherwise: texts are long, and a batch of Spark's 10,000 is held several times on its way.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that Arrow functions find it whatever their path is."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_lumaframe_shipped", False):
        context._lumaframe_shipped = True
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lumaframe-")
        shutil.copytree(root, f"{folder}/all/lumaframe", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/lumaframe", "zip", f"{folder}/all"))
        shutil.rmtree(f"{folder}/all")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that driver and executors share: spark.checkpoint.dir, or on a local master without it a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return f"{(named or 'file:///tmp/checkpoints').rstrip('/')}/lumaframe/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor folder; only Spark's reader opens it, so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
