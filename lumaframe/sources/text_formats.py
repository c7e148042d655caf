"""Readers of the text formats around an encode. Every one takes read.text rows and refuses lines that do not parse."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import asof_join


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line of one or many text files: n counts the lines of each file from 1. A file is read in splits; the place of a split and of a line in it give the order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    return raw.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_at", "_i")).alias("n"), "line")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line, without comments and blank lines."""
    return numbered(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "#.*", ""))).where("line <> ''")


def strict(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("line"))))


def plan(spark: SparkSession, path: str) -> DataFrame:
    """first, last, idr, qp_offset of lines `first last [idr] [qp+N]`."""
    p = r"^(\d+)\s+(\d+)(\s+idr)?(?:\s+qp([+-]\d+))?$"
    ok = F.col("line").rlike(p)
    get = lambda i: F.regexp_extract("line", p, i)
    return lines(spark, path).select(strict(ok, get(1), "plan").cast("int").alias("first"), get(2).cast("int").alias("last"), (get(3) != "").alias("idr"), F.when(get(4) != "", get(4)).otherwise("0").cast("int").alias("qp_offset"))


def zones(text: DataFrame, column: str) -> DataFrame:
    """first, last, qp, offset of `start,end,q=N|b=F` joined by `/`; b is a factor on bits and becomes an offset of -6 log2(F)."""
    p = r"^(\d+),(\d+),(q|b)=([0-9.]+)$"
    each = text.select(F.explode(F.split(column, "/")).alias("line"))
    get = lambda i: F.regexp_extract("line", p, i)
    value = get(4).cast("double")
    return each.select(strict(F.col("line").rlike(p), get(1), "zone").cast("int").alias("first"), get(2).cast("int").alias("last"), F.when(get(3) == "q", value).alias("qp"), F.when(get(3) == "b", -6 * F.log2(value)).alias("offset"))


def qpfile(spark: SparkSession, path: str) -> DataFrame:
    """frame, type, qp of lines `frame type qp`; a frame that comes twice is refused."""
    p = r"^(\d+)\s+([IPBKbi])\s+(-?\d+)$"
    get = lambda i: F.regexp_extract("line", p, i)
    rows = lines(spark, path).select(strict(F.col("line").rlike(p), get(1), "qpfile").cast("int").alias("frame"), get(2).alias("type"), get(3).cast("int").alias("qp"), "line")
    n = F.count("*").over(Window.partitionBy("frame"))
    return rows.withColumn("_n", n).select(strict(F.col("_n") == 1, F.col("frame"), "frame twice").alias("frame"), "type", "qp")


def pass_stats(spark: SparkSession, path: str, most: float = 1e15) -> DataFrame:
    """file, gop, idx, type, cplx, bits, qp, is_ref of lines `type cplx bits qp [is_ref]`.

    `#gop <index> <first frame> <end frame> <records>` opens a section, which must hold as many records; other lines that begin with # are comments; records before any marker are
    section 0. A type is 0 to 2, a QP 0 to 51, costs are finite, not negative and at most `most`.
    """
    marker = r"^#gop\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
    whole = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    raw = numbered(spark, path)
    opened = F.when(F.col("line").rlike(marker), F.struct(F.regexp_extract("line", marker, 1).cast("int").alias("gop"), F.regexp_extract("line", marker, 4).cast("int").alias("records")))
    body = raw.withColumn("_s", F.last(opened, ignorenulls=True).over(whole)).where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("gop", F.coalesce("_s.gop", F.lit(0)))
    section = Window.partitionBy("file", "gop")
    body = body.withColumn("idx", F.row_number().over(section.orderBy("n")) - 1).withColumn("_n", F.count("*").over(section))
    parts = F.split(F.trim("line"), r"\s+")
    f = [F.get(parts, F.lit(i)) for i in range(5)]
    fits = lambda i: f[i].try_cast("double").between(0.0, most)  # noqa: E731  refuses NaN and infinities too
    ok = F.size(parts).between(4, 5) & f[0].rlike("^[0-2]$") & f[3].rlike(r"^\d+$") & f[3].try_cast("int").between(0, 51) & fits(1) & fits(2) & F.coalesce(f[4].rlike(r"^-?\d+$"), F.lit(True)) & F.coalesce(F.col("_s.records") == F.col("_n"), F.lit(True))
    return body.select("file", "gop", "idx", strict(F.coalesce(ok, F.lit(False)), f[0], "stats").cast("int").alias("type"), f[1].cast("double").alias("cplx"), f[2].cast("double").alias("bits"), f[3].cast("int").alias("qp"), f[4].cast("int").alias("is_ref"))


def frame_stats(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of frame decisions; -1 and '?' are missing values."""
    rows = spark.read.schema("frame int, gop int, type string, idr int, ref int, qp int, bytes int, k int").json(path, mode="FAILFAST")
    return rows.select("frame", "gop", F.nullif("type", F.lit("?")).alias("type"), *(F.nullif(c, F.lit(-1)).alias(c) for c in ("idr", "ref", "qp", "bytes", "k")))


def mb_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, by, bx, cls (0 skip, 1 inter, 2 intra) of debug logs: `New frame, type: X` lines, each followed by rows of three characters a macroblock."""
    rows = numbered(spark, path)
    start = F.col("line").startswith("New frame, type:")
    x = rows.withColumn("frame", F.sum(start.cast("int")).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 1).where(~start & (F.length("line") > 0) & (F.col("frame") >= 0))
    x = x.withColumn("by", F.row_number().over(Window.partitionBy("file", "frame").orderBy("n")) - 1)
    cell = x.select("file", "frame", "by", F.posexplode(F.expr("transform(sequence(1, length(line) div 3), i -> substring(line, 3 * i - 2, 1))")).alias("bx", "c"))
    return cell.select("file", "frame", "by", "bx", F.when(F.col("c") == "S", 0).when(F.col("c").isin("i", "I", "A"), 2).otherwise(1).alias("cls"))


def frame_sizes(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, size of comma-separated packet lists: the last field is the size in bytes, frames count from 0."""
    p = r"^(?:.*,)?(\d+)$"
    return lines(spark, path).select("file", (F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1).alias("frame"), strict(F.col("line").rlike(p), F.regexp_extract("line", p, 1), "size").cast("long").alias("size"))


def frame_scores(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, vmaf, psnr_y of JSON reports `{"frames": [{"frameNum": n, "metrics": {...}}]}`."""
    rows = spark.read.schema("frames array<struct<frameNum: int, metrics: struct<vmaf: double, psnr_y: double>>>").json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.explode("frames").alias("f")).select("file", F.col("f.frameNum").alias("frame"), "f.metrics.vmaf", "f.metrics.psnr_y")


def cuts(spark: SparkSession, path: str) -> DataFrame:
    """file, first, name of lines `<first frame> <name>`."""
    p = r"^(\d+)\s+(\S.*)$"
    return lines(spark, path).select("file", strict(F.col("line").rlike(p), F.regexp_extract("line", p, 1), "cut").cast("long").alias("first"), F.regexp_extract("line", p, 2).alias("name"))


def weight_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, name, place, weight of lines `NAME = w, w, ...` with 16 or 64 weights of 1 to 255 each."""
    p = r"^(\w+)\s*=\s*([\d,\s]+)$"
    each = F.transform(F.split(F.regexp_extract("line", p, 2), r"\s*,\s*"), lambda w: F.trim(w).try_cast("int"))
    ok = F.col("line").rlike(p) & F.size(each).isin(16, 64) & F.forall(each, lambda w: F.coalesce(w.between(1, 255), F.lit(False)))
    return lines(spark, path).select("file", strict(ok, F.regexp_extract("line", p, 1), "weights").alias("name"), F.posexplode(each).alias("place", "weight"))


def trace_rows(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns of an XML table of <row>s whose cells name their value once, `<c id="3">text</c>`, and refer to it later, `<c ref="3"/>`: each reference is joined with its definition."""
    raw = spark.read.format("xml").option("rowTag", "row").schema(", ".join(f"{c} struct<_id: bigint, _ref: bigint, _VALUE: string>" for c in columns)).load(path).withColumn("_row", F.monotonically_increasing_id())
    cells = raw.select("_row", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"{c}._id"), F.col(f"{c}._ref")).alias("id"), F.col(f"{c}._VALUE").alias("v")) for c in columns))).alias("x")).select("_row", "x.*")
    known = cells.where("v is not null").groupBy("id").agg(F.min("v").alias("value"))
    full = cells.join(known, "id", "left").groupBy("_row").pivot("c", list(columns)).agg(F.first(F.coalesce("v", "value")))
    return full.select(*columns)


def call_tree(spark: SparkSession, path: str) -> DataFrame:
    """file, n, depth, samples, name, parent (its n) of an indented report: two blanks a level, then `<samples> <name>`. The parent is the last line of one level less, an as-of join by level instead of a stack."""
    p = r"^((?:  )*)(\d+)\s+(\S.*)$"
    ok = F.col("line").rlike(p)
    rows = numbered(spark, path).where(F.trim("line") != "").select("file", "n", F.when(ok, F.length(F.regexp_extract("line", p, 1)) / 2).otherwise(F.raise_error(F.concat(F.lit("tree: "), F.col("line")))).cast("int").alias("depth"), F.regexp_extract("line", p, 2).cast("long").alias("samples"), F.regexp_extract("line", p, 3).alias("name"))
    above = asof_join(rows.withColumn("_level", F.col("depth") - 1), rows.select("file", F.col("depth").alias("_level"), "n"), ["file", "_level"], "n", {"parent": "n"})
    return above.drop("_level")


def write_scan(shots: DataFrame, path: str, identity: dict[str, str]) -> None:
    """A scan: its identity (what was scanned, and how) as one row, and the table of shots."""
    spark = shots.sparkSession
    shots.write.parquet(f"{path}/shots")
    spark.createDataFrame(sorted(identity.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/identity")


def read_scan(spark: SparkSession, path: str, identity: dict[str, str]) -> DataFrame:
    """The shots of a scan; one of something else is refused."""
    found = {r.key: r.value for r in spark.read.parquet(f"{path}/identity").collect()}
    if found != identity:
        raise ValueError(f"the scan is of {found}, not of {identity}")
    return spark.read.parquet(f"{path}/shots")


def markdown(rows: DataFrame, title: str) -> str:
    """A small report as a markdown table, its rows in order of the first column."""
    cells = [[str(v) for v in r] for r in rows.orderBy(rows.columns[0]).collect()]
    return "\n".join([f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(c) + " |" for c in cells), ""])


def write_stats(rows: DataFrame, path: str, by: str = "gop") -> None:
    """JSON lines in a folder for each section, in frame order."""
    rows.repartition(by).sortWithinPartitions(by, "frame").write.partitionBy(by).json(path)
