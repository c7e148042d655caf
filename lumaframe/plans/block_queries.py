"""Block kernels over the embeddings table: 64 floats are an 8x8 block, and a block's reference is the one with the next id."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import registration
from ..operators import joins
from ..tables import table
from .registry import query

#: A block as integers, and pairs with the next block, in SQL.
_Q = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 128 + 0.5) AS BIGINT))"
_PAIRS = f"WITH q AS (SELECT vec_id, {_Q} AS px FROM embeddings), p AS (SELECT a.vec_id, a.px AS a, b.px AS b, list_transform(list_zip(a.px, b.px), lambda z: z[1] - z[2]) AS res FROM q a JOIN q b ON b.vec_id = a.vec_id + 1) "


def _rows(name, rows):
    """A constant matrix times a list, in SQL."""
    return f"list_transform([{', '.join('[' + ', '.join(map(str, r)) + ']' for r in rows)}], lambda r: CAST(list_sum(list_transform(list_zip(r, {name}), lambda z: z[1] * z[2])) AS BIGINT))"


def _tile(name, top, left, size=4, width=8):
    return "[" + ", ".join(f"{name}[{(top + i) * width + left + j + 1}]" for i in range(size) for j in range(size)) + "]"


def _sum(x):
    return f"CAST(list_sum({x}) AS BIGINT)"


_ABS = "lambda v: abs(v)"
_H4 = B.matrix_rows(4, B.hadamard(4))


def _satd(name):
    return " + ".join(_sum(f"list_transform({_rows(_tile(name, y, x), _H4)}, {_ABS})") for y in (0, 4) for x in (0, 4))


@query(_PAIRS + f"SELECT vec_id, {_sum(f'list_transform(res, {_ABS})')} AS sad, {_satd('res')} AS satd FROM p")
def registered_kernels(spark, sf_dir):
    """The registered functions from SQL text."""
    registration.register(spark)
    return spark.sql("SELECT vec_id, luma_sad(a, b) AS sad, luma_satd(a, b) AS satd FROM {p}", p=pairs(spark, sf_dir).select("vec_id", "a", "b"))


def blocks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", B.quantised(F.col("embedding")).alias("px"))


def pairs(spark, sf_dir):
    q = blocks(spark, sf_dir)
    return q.withColumnRenamed("px", "a").withColumn("_next", F.col("vec_id") + 1).join(q.select(F.col("vec_id").alias("_next"), F.col("px").alias("b")), "_next").select("vec_id", "a", "b", B.residual(F.col("a"), F.col("b")).alias("res"))


@query(_PAIRS + f"SELECT vec_id, {_sum(f'list_transform(res, {_ABS})')} AS sad FROM p")
def block_sad(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", B.sad(F.col("a"), F.col("b")).alias("sad"))


@query(_PAIRS + f"SELECT vec_id, {_sum('list_transform(res, lambda v: v * v)')} AS ssd, round(CASE WHEN {_sum('list_transform(res, lambda v: v * v)')} = 0 THEN 99.0 ELSE 10 * log10(65025.0 / ({_sum('list_transform(res, lambda v: v * v)')} / 64.0)) END, 6) AS psnr FROM p")
def block_ssd_psnr(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", B.ssd(F.col("a"), F.col("b")).alias("ssd")).select("vec_id", "ssd", F.round(B.psnr(F.col("ssd") / 64.0), 6).alias("psnr"))


@query(f"WITH q AS (SELECT vec_id, {_Q} AS px FROM embeddings), s AS (SELECT vec_id, {_sum('px')} AS total, {_sum('list_transform(px, lambda v: v * v)')} AS squares FROM q) SELECT vec_id, total, squares, 64 * squares - total * total AS var_64x64 FROM s")
def block_variance(spark, sf_dir):
    s = blocks(spark, sf_dir).select("vec_id", B.total(F.col("px")).alias("total"), B.squares(F.col("px")).alias("squares"))
    return s.withColumn("var_64x64", 64 * F.col("squares") - F.col("total") * F.col("total"))


@query(_PAIRS + f"SELECT vec_id, {_satd('res')} AS satd FROM p")
def block_satd(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", B.satd(F.col("res")).alias("satd"))


@query(_PAIRS + f"SELECT vec_id, ({_sum(f'list_transform({_rows("res", B.matrix_rows(8, B.hadamard(8)))}, {_ABS})')} + 2) >> 2 AS sa8d FROM p")
def block_sa8d(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", B.sa8d(F.col("res")).alias("sa8d"))


@query(_PAIRS + f", h AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: (z[1] + z[2] + 1) >> 1) AS m, a FROM p), r AS (SELECT vec_id, list_transform(list_zip(a, m), lambda z: z[1] - z[2]) AS res FROM h) SELECT vec_id, {_satd('res')} AS satd_avg FROM r")
def block_average_satd(spark, sf_dir):
    mean = pairs(spark, sf_dir).select("vec_id", "a", B.average(F.col("a"), F.col("b")).alias("m"))
    return mean.select("vec_id", B.residual(F.col("a"), F.col("m")).alias("res")).select("vec_id", B.satd(F.col("res")).alias("satd_avg"))


_DCT = _PAIRS + f", d AS (SELECT vec_id, {_rows(_tile('res', 0, 0), B.matrix_rows(4, B.CORE4))} AS c FROM p) "
_PLACES = lambda v: [v[0] if y % 2 == 0 == x % 2 else v[1] if y % 2 and x % 2 else v[2] for y in range(4) for x in range(4)]
QP = 22


@query(_DCT + f"SELECT vec_id, CAST(c[1] AS BIGINT) AS dc, {_sum(f'list_transform(c, {_ABS})')} AS energy, list_aggregate(list_transform(c, lambda v: CAST(v AS VARCHAR)), 'string_agg', ' ') AS coefs FROM d")
def block_core_transform(spark, sf_dir):
    d = pairs(spark, sf_dir).select("vec_id", B.dct4(B.sub_block(F.col("res"), 8, 0, 0, 4)).alias("c"))
    return d.select("vec_id", F.col("c")[0].alias("dc"), B.total(F.transform("c", lambda v: F.abs(v))).alias("energy"), F.array_join(F.transform("c", lambda v: v.cast("string")), " ").alias("coefs"))


_QB = 15 + QP // 6
_LEVELS = _DCT + f", l AS (SELECT vec_id, list_transform(list_zip(c, {_PLACES(B.QUANT[QP % 6])}), lambda z: CAST(sign(z[1]) AS BIGINT) * ((abs(z[1]) * z[2] + {(1 << _QB) // 3}) >> {_QB})) AS l FROM d) "
_ZIG = "[" + ", ".join(f"l[{i + 1}]" for i in B.ZIGZAG4) + "]"


@query(_LEVELS + f"""SELECT vec_id, CAST(len(list_filter(l, lambda v: v <> 0)) AS INTEGER) AS nonzero,
    CAST(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN ({_ZIG})[i] <> 0 THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS mask,
    {_sum(f'list_transform(list_zip(l, {_PLACES(B.DEQUANT[QP % 6])}), lambda z: abs(z[1] * z[2] * {1 << QP // 6}))')} AS dequantised FROM l""")
def block_quantise(spark, sf_dir):
    d = pairs(spark, sf_dir).select("vec_id", B.dct4(B.sub_block(F.col("res"), 8, 0, 0, 4)).alias("c"))
    level = d.select("vec_id", B.quant4(F.col("c"), QP).alias("l"))
    return level.select("vec_id", F.size(F.filter("l", lambda v: v != 0)).alias("nonzero"), B.scan_mask(F.col("l")).alias("mask"), B.total(F.transform(B.dequant4(F.col("l"), QP), lambda v: F.abs(v))).alias("dequantised"))


_COS = [[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
_DCT8 = [[round(_COS[u][y] * _COS[v][x], 12) for y in range(8) for x in range(8)] for u in range(8) for v in range(8)]
_BANDS = {"lf": [8 * u + v for u in range(8) for v in range(8) if 1 <= u + v <= 2], "mf": [8 * u + v for u in range(8) for v in range(8) if 3 <= u + v <= 6], "hf": [8 * u + v for u in range(8) for v in range(8) if u + v >= 7]}


@query(f"WITH q AS (SELECT vec_id, {_Q} AS px FROM embeddings), e AS (SELECT vec_id, list_transform([{', '.join('[' + ', '.join(f'{v:.12f}::DOUBLE' for v in r) + ']' for r in _DCT8)}], lambda r: list_sum(list_transform(list_zip(r, px), lambda z: z[1] * z[2]))) AS c FROM q) SELECT vec_id, " + ", ".join("round(" + " + ".join(f"c[{i + 1}] * c[{i + 1}]" for i in at) + f", 2) AS {k}" for k, at in _BANDS.items()) + " FROM e")
def block_dct_bands(spark, sf_dir):
    rows = F.array(*(F.array(*(F.lit(v) for v in r)) for r in _DCT8))
    c = blocks(spark, sf_dir).select("vec_id", F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col("px"), lambda k, v: k * v), F.lit(0.0), lambda s, v: s + v)).alias("c"))
    energy = lambda at: F.aggregate(F.transform(F.array(*map(F.lit, at)), lambda i: F.get("c", i) * F.get("c", i)), F.lit(0.0), lambda s, v: s + v)
    return c.select("vec_id", *(F.round(energy(at), 2).alias(k) for k, at in _BANDS.items()))


_INTRA = {"v": "b[57 + (i - 1) % 8]", "h": "b[((i - 1) // 8) * 8 + 8]", "dc": "dc"}


@query(_PAIRS + f", d AS (SELECT *, ({_sum('b')} + 32) >> 6 AS dc FROM p), r AS (SELECT vec_id, " + ", ".join(f"list_transform(range(1, 65), lambda i: a[i] - {x}) AS {k}" for k, x in _INTRA.items()) + " FROM d) SELECT vec_id, " + ", ".join(f"{_satd(k)} AS cost_{k}" for k in _INTRA) + " FROM r")
def block_intra_costs(spark, sf_dir):
    """Prediction from the reference's last row, last column and mean, by the transformed difference."""
    p = pairs(spark, sf_dir).withColumn("dc", F.shiftright(B.total(F.col("b")) + 32, 6))
    pred = {"v": lambda i: F.get("b", 56 + i % 8), "h": lambda i: F.get("b", F.floor(i / 8).cast("int") * 8 + 7), "dc": lambda i: F.col("dc")}
    res = p.select("vec_id", *(_against(f).alias(k) for k, f in pred.items()))
    return res.select("vec_id", *(B.satd(F.col(k)).alias(f"cost_{k}") for k in pred))


def _against(pred):
    """The block less a prediction given by place."""
    return F.transform("a", lambda v, i: v - pred(i))


_CAND = f"WITH q AS (SELECT vec_id, {_Q} AS px FROM embeddings), c AS (SELECT a.vec_id, b.vec_id AS ref, b.vec_id - a.vec_id AS d, {_sum('list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))')} AS cost, list_transform(list_zip(a.px, b.px), lambda z: z[1] - z[2]) AS res FROM q a JOIN q b ON b.vec_id BETWEEN a.vec_id - 8 AND a.vec_id + 8 AND b.vec_id <> a.vec_id) "


@query(_CAND + "SELECT vec_id, d, cost FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, abs(d), d) AS n FROM c) WHERE n = 1")
def argmin_motion(spark, sf_dir):
    """Exhaustive search within 8 places; of equal costs the shorter vector, then the lesser."""
    c = joins.beside(blocks(spark, sf_dir), "vec_id", "px", 8).select("vec_id", F.transform("near", lambda n: F.struct(B.sad(F.col("px"), n["px"]).alias("cost"), F.abs(n["d"]).alias("len"), n["d"].alias("d"))).alias("c"))
    best = c.where("size(c) > 0").select("vec_id", F.array_min("c").alias("m"))
    return best.select("vec_id", "m.d", "m.cost")


@query(_CAND + f", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, abs(d), d) AS n FROM c), s AS (SELECT vec_id, d, {_satd('res')} AS satd FROM k WHERE n <= 3) SELECT vec_id, d, satd FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY satd, abs(d), d) AS n FROM s) WHERE n = 1")
def motion_rerank(spark, sf_dir):
    """The three least by SAD, ranked anew by SATD."""
    c = joins.beside(blocks(spark, sf_dir), "vec_id", "px", 8).where("size(near) > 0")
    ranked = F.transform("near", lambda n: F.struct(B.sad(F.col("px"), n["px"]).alias("cost"), F.abs(n["d"]).alias("len"), n["d"].alias("d"), B.residual(F.col("px"), n["px"]).alias("res")))
    top = c.select("vec_id", F.slice(F.array_sort(ranked), 1, 3).alias("top"))
    best = top.select("vec_id", F.array_min(F.transform("top", lambda t: F.struct(B.satd(t["res"]).alias("satd"), t["len"].alias("len"), t["d"].alias("d")))).alias("m"))
    return best.select("vec_id", "m.d", "m.satd")


@query("SELECT event_id, CAST(CASE WHEN v = 0 THEN 1 ELSE 1 + 2 * length(bin(abs(v))) END AS INTEGER) AS mv_bits, round(pow(2.0, (qp - 12) / 6.0), 6) AS qscale, round(pow((bits + 1) * pow(2.0, (qp - 12) / 6.0), 0.6), 4) AS weight, round(12 + 6 * log2(pow(2.0, (qp - 12) / 6.0)), 6) AS qp_back, round(least(greatest((value - 32.0) / 32.0, 0.0), 1.0), 8) AS dark FROM (SELECT event_id, CAST(floor(value) AS BIGINT) - 60 AS v, CAST(event_id % 52 AS INTEGER) AS qp, CAST(floor(value * 100) AS BIGINT) AS bits, value FROM events)")
def rate_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.floor("value") - 60).alias("v"), (F.col("event_id") % 52).cast("int").alias("qp"), F.floor(F.col("value") * 100).alias("bits"), "value")
    q = B.qscale(F.col("qp"))
    return e.select("event_id", B.mv_bits(F.col("v")).alias("mv_bits"), F.round(q, 6).alias("qscale"), F.round(B.stat_weight(F.col("bits"), F.col("qp")), 4).alias("weight"), F.round(12 + 6 * F.log2(q), 6).alias("qp_back"), F.round(B.ramp(F.col("value"), 32.0, 64.0), 8).alias("dark"))


@query(f"WITH q AS (SELECT vec_id, label, {_Q} AS px FROM embeddings), s AS (SELECT vec_id, label, {_sum('px')} / 64.0 AS mean, sqrt(greatest({_sum('list_transform(px, lambda v: v * v)')} / 64.0 - ({_sum('px')} / 64.0) * ({_sum('px')} / 64.0), 0)) AS sd FROM q) SELECT label, count(*) AS n, count(*) FILTER (WHERE mean > -2 AND mean < 2 AND sd > 5 AND sd < 60) AS smooth FROM s GROUP BY label")
def smooth_blocks(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", "label", B.quantised(F.col("embedding")).alias("px"))
    s = q.select("label", (B.total(F.col("px")) / 64.0).alias("mean"), (B.squares(F.col("px")) / 64.0).alias("sq"))
    sd = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.col("mean") > -2) & (F.col("mean") < 2) & (sd > 5) & (sd < 60)).alias("smooth"))
