"""More block kernels over the embeddings table: transforms both ways, prediction, interpolation, filters and readings over frames (a label is a frame)."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import transforms as T
from ..tables import table
from .block_queries import _ABS, _H4, _PAIRS, _PLACES, _Q, _rows, _satd, _sum, _tile, blocks, pairs
from .registry import query

#: Samples of 8 bits.
_PX = "list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 128 + 0.5) + 128, 0), 255) AS BIGINT))"
_P = f"WITH q AS (SELECT vec_id, label, {_PX} AS px FROM embeddings)"
_TEXT = lambda x: f"array_to_string({x}, ' ')"


def samples(spark, sf_dir):
    px = F.transform(B.quantised(F.col("embedding")), lambda v: F.least(F.greatest(v + 128, F.lit(0)), F.lit(255)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


def _text(x):
    return F.array_join(F.transform(x, lambda v: v.cast("string")), " ")


def _at(px, y, x):
    return F.get(px, 8 * y + x)


@query(_PAIRS + f"SELECT vec_id, {_TEXT(T.both_ways_sql('res', T.forward8, 8))} AS coefs FROM p")
def block_forward8(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", _text(T.both_ways(F.col("res"), T.forward8, 8)).alias("coefs"))


@query(_PAIRS + f", t AS (SELECT vec_id, {T.both_ways_sql('res', T.forward8, 8)} AS c FROM p) SELECT vec_id, {_TEXT(f'list_transform({T.both_ways_sql("c", T.inverse8, 8)}, lambda v: CAST(floor((v + 32) / 64.0) AS BIGINT))')} AS res FROM t")
def block_inverse8(spark, sf_dir):
    c = pairs(spark, sf_dir).select("vec_id", T.both_ways(F.col("res"), T.forward8, 8).alias("c"))
    return c.select("vec_id", _text(F.transform(T.both_ways(F.col("c"), T.inverse8, 8), lambda v: F.shiftright(v + 32, 6))).alias("res"))


_QP = 22
_DCT4 = _PAIRS + f", d AS (SELECT vec_id, b, {_rows(_tile('res', 0, 0), B.matrix_rows(4, B.CORE4))} AS c FROM p), l AS (SELECT vec_id, b, list_transform(list_zip(c, {_PLACES(B.QUANT[_QP % 6])}), lambda z: CAST(sign(z[1]) AS BIGINT) * ((abs(z[1]) * z[2] + {(1 << 15 + _QP // 6) // 3}) >> {15 + _QP // 6})) AS l FROM d), k AS (SELECT vec_id, b, list_transform(list_zip(l, {_PLACES(B.DEQUANT[_QP % 6])}), lambda z: z[1] * z[2] * {1 << _QP // 6}) AS k FROM l)"


@query(_DCT4 + f" SELECT vec_id, {_TEXT(f'list_transform(list_zip({T.both_ways_sql("k", T.inverse4, 4)}, {_tile("b", 0, 0)}), lambda z: CAST(floor((z[1] + 32) / 64.0) AS BIGINT) + z[2])')} AS rec FROM k")
def block_reconstruct4(spark, sf_dir):
    """Transform, quantiser, dequantiser, inverse transform, and the prediction added."""
    d = pairs(spark, sf_dir).select("vec_id", "b", B.dct4(B.sub_block(F.col("res"), 8, 0, 0, 4)).alias("c"))
    k = d.select("vec_id", "b", B.dequant4(B.quant4(F.col("c"), _QP), _QP).alias("k"))
    back = F.transform(T.both_ways(F.col("k"), T.inverse4, 4), lambda v: F.shiftright(v + 32, 6))
    return k.select("vec_id", _text(F.zip_with(back, B.sub_block(F.col("b"), 8, 0, 0, 4), lambda r, p: r + p)).alias("rec"))


#: Fixed values of the standard: multipliers of the 8x8 quantiser and dequantiser by qp % 6 for six kinds of places, and the kind of each place by (row % 4, column % 4).
QUANT8 = [(13107, 11428, 20972, 12222, 16777, 15481), (11916, 10826, 19174, 11058, 14980, 14290), (10082, 8943, 15978, 9675, 12710, 11985), (9362, 8228, 14913, 8931, 11984, 11259), (8192, 7346, 13159, 7740, 10486, 9777), (7282, 6428, 11570, 6830, 9118, 8640)]
DEQUANT8 = [(20, 18, 32, 19, 25, 24), (22, 19, 35, 21, 28, 26), (26, 23, 42, 24, 33, 31), (28, 25, 45, 26, 35, 33), (32, 28, 51, 30, 40, 38), (36, 32, 58, 34, 46, 43)]
KINDS8 = [[0, 3, 4, 3], [3, 1, 5, 1], [4, 5, 2, 5], [3, 1, 5, 1]]
_PLACES8 = lambda v: [v[KINDS8[y % 4][x % 4]] for y in range(8) for x in range(8)]
_QB8, _SH8 = 16 + _QP // 6, 6 - _QP // 6
_LEVEL8 = f"list_transform(list_zip(c, {_PLACES8(QUANT8[_QP % 6])}), lambda z: CAST(sign(z[1]) AS BIGINT) * ((abs(z[1]) * z[2] + {(1 << _QB8) // 3}) >> {_QB8}))"


@query(_PAIRS + f", t AS (SELECT vec_id, {T.both_ways_sql('res', T.forward8, 8)} AS c FROM p), l AS (SELECT vec_id, {_LEVEL8} AS l FROM t) SELECT vec_id, len(list_filter(l, lambda v: v <> 0)) AS nonzero, {_sum(f'list_transform(list_zip(l, {_PLACES8(DEQUANT8[_QP % 6])}), lambda z: abs(CAST(floor((z[1] * z[2] * 16 + {1 << _SH8 - 1}) / {float(1 << _SH8)}) AS BIGINT)))')} AS dequantised FROM l")
def block_quantise8(spark, sf_dir):
    constant = lambda v: F.array(*map(F.lit, _PLACES8(v)))
    c = pairs(spark, sf_dir).select("vec_id", T.both_ways(F.col("res"), T.forward8, 8).alias("c"))
    level = c.select("vec_id", F.zip_with("c", constant(QUANT8[_QP % 6]), lambda v, m: F.signum(v).cast("long") * F.shiftright(F.abs(v).cast("long") * m + (1 << _QB8) // 3, _QB8)).alias("l"))
    back = F.zip_with("l", constant(DEQUANT8[_QP % 6]), lambda v, m: F.abs(F.shiftright(v * m * 16 + (1 << _SH8 - 1), _SH8)))
    return level.select("vec_id", F.size(F.filter("l", lambda v: v != 0)).cast("long").alias("nonzero"), B.total(back).alias("dequantised"))


_DC = [f"CAST(list_sum({_tile('px', y, x)}) AS BIGINT)" for y in (0, 4) for x in (0, 4)]


@query(f"{_P}, d AS (SELECT vec_id, {', '.join(f'{x} AS d{i}' for i, x in enumerate(_DC))}, px FROM q) SELECT vec_id, d0 + d1 + d2 + d3 AS f0, d0 - d1 + d2 - d3 AS f1, d0 + d1 - d2 - d3 AS f2, d0 - d1 - d2 + d3 AS f3, {_TEXT(_rows('px[1:16]', _H4))} AS luma FROM d")
def block_dc_hadamard(spark, sf_dir):
    """Of the sums of the four tiles the 2x2 transform, and of sixteen samples the 4x4 one; the rows of both are in the order of their signs' bits."""
    q = samples(spark, sf_dir)
    d = q.select("vec_id", "px", *(B.total(B.sub_block(F.col("px"), 8, y, x, 4)).alias(f"d{i}") for i, (y, x) in enumerate(((0, 0), (0, 4), (4, 0), (4, 4)))))
    return d.selectExpr("vec_id", "d0 + d1 + d2 + d3 AS f0", "d0 - d1 + d2 - d3 AS f1", "d0 + d1 - d2 - d3 AS f2", "d0 - d1 - d2 + d3 AS f3", "px").select("vec_id", "f0", "f1", "f2", "f3", _text(B.apply_rows(F.slice("px", 1, 16), B.matrix_rows(4, B.hadamard(4)))).alias("luma"))


_H8 = B.matrix_rows(8, B.hadamard(8))
_ALL4 = " + ".join(f"{_sum(f'list_transform({_rows(_tile("px", y, x), _H4)}, {_ABS})')} - {_sum(_tile('px', y, x))} + abs({_sum(_tile('px', y, x))} - 16 * (({_sum(_tile('px', y, x))} + 8) >> 4))" for y in (0, 4) for x in (0, 4))


@query(f"{_P} SELECT vec_id, {_ALL4} AS e4, {_sum(f'list_transform({_rows("px", _H8)}, {_ABS})')} - {_sum('px')} AS e8 FROM q")
def block_texture(spark, sf_dir):
    """The two texture energies: of each 4x4 tile against its own rounded mean, and of the 8x8 block without its mean."""
    out, px = None, F.col("px")
    for y in (0, 4):
        for x in (0, 4):
            t = B.sub_block(px, 8, y, x, 4)
            dc = B.total(t)
            e = B.total(F.transform(B.apply_rows(t, B.matrix_rows(4, B.hadamard(4))), lambda v: F.abs(v))) - dc + F.abs(dc - 16 * F.shiftright(dc + 8, 4))
            out = e if out is None else out + e
    return samples(spark, sf_dir).select("vec_id", out.alias("e4"), (B.total(F.transform(B.apply_rows(px, _H8), lambda v: F.abs(v))) - B.total(px)).alias("e8"))


#: The edge around the first tile of a block, in the numbers of transforms.intra4: the left and upper samples are those of the next block's last column and row.
_EDGE = [8 * (3 - i) + 7 for i in range(4)] + [63] + [56 + i for i in range(8)]
_EDGE_SQL = [f"b[{i + 1}]" for i in _EDGE]


def _predicted_sql(mode):
    return "[" + ", ".join(f"CAST(floor(({' + '.join(f'{k} * {_EDGE_SQL[i]}' for i, k in w.items())} + {(1 << s) >> 1}) / {float(1 << s)}) AS BIGINT)" for w, s in T.intra4(mode)) + "]"


def _cost_sql(mode):
    diff = f"list_transform(list_zip({_tile('a', 0, 0)}, {_predicted_sql(mode)}), lambda z: z[1] - z[2])"
    return _sum(f"list_transform(list_transform([{diff}], lambda m: {_rows('m', _H4)})[1], {_ABS})")


@query(_PAIRS + f", c AS (SELECT vec_id, [{', '.join(map(_cost_sql, range(9)))}] AS c FROM p) SELECT vec_id, {_TEXT('c')} AS costs, CAST(list_position(c, list_min(c)) - 1 AS INTEGER) AS best FROM c")
def block_intra4_modes(spark, sf_dir):
    """The nine 4x4 predictions of a block's first tile, by the transformed difference; of equal costs the first."""
    def cost(mode):
        pred = F.array(*(F.shiftright(sum((F.get("b", _EDGE[i]) * k for i, k in w.items()), F.lit((1 << s) >> 1)), s) for w, s in T.intra4(mode)))
        return B.total(F.transform(B.apply_rows(F.zip_with(B.sub_block(F.col("a"), 8, 0, 0, 4), pred, lambda x, y: x - y), B.matrix_rows(4, B.hadamard(4))), lambda v: F.abs(v)))

    c = pairs(spark, sf_dir).select("vec_id", F.array(*map(cost, range(9))).alias("c"))
    return c.select("vec_id", _text(F.col("c")).alias("costs"), (F.array_position("c", F.array_min("c")) - 1).cast("int").alias("best"))


_CLIP = lambda x: f"least(greatest({x}, 0), 255)"
_HALF = lambda step, first: "[" + ", ".join(_CLIP(f"CAST(floor(({T.six_tap([T.Sql(f'px[{first(i) + k * step + 1}]') for k in range(6)])} + 16) / 32.0) AS BIGINT)") for i in range(24)) + "]"
_ACROSS, _DOWN = (lambda i: 8 * (i // 3) + i % 3), (lambda i: 8 * (i // 8) + i % 8)


@query(f"{_P} SELECT vec_id, {_TEXT(_HALF(1, _ACROSS))} AS across, {_TEXT(_HALF(8, _DOWN))} AS down FROM q")
def block_half_samples(spark, sf_dir):
    """Samples half-way between two columns, and two rows, where the six-tap filter has all of its samples."""
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255))
    half = lambda step, first: F.array(*(clip(F.shiftright(T.six_tap([F.get("px", first(i) + k * step) for k in range(6)]) + 16, 5)) for i in range(24)))
    return samples(spark, sf_dir).select("vec_id", _text(half(1, _ACROSS)).alias("across"), _text(half(8, _DOWN)).alias("down"))


_BI = "[" + ", ".join(f"((8 - dx) * (8 - dy) * px[{8 * y + x + 1}] + dx * (8 - dy) * px[{8 * y + x + 2}] + (8 - dx) * dy * px[{8 * y + x + 9}] + dx * dy * px[{8 * y + x + 10}] + 32) >> 6" for y in range(7) for x in range(7)) + "]"


@query(f"{_P}, v AS (SELECT vec_id, px, vec_id % 8 AS dx, (vec_id // 8) % 8 AS dy FROM q) SELECT vec_id, {_TEXT(_BI)} AS moved FROM v")
def block_chroma_motion(spark, sf_dir):
    """A block moved by eighths of a sample, the vector from its number."""
    v = samples(spark, sf_dir).select("vec_id", "px", (F.col("vec_id") % 8).alias("dx"), (F.floor(F.col("vec_id") / 8) % 8).alias("dy"))
    dx, dy, p = F.col("dx"), F.col("dy"), (lambda y, x: _at("px", y, x))
    return v.select("vec_id", _text(F.array(*(F.shiftright((8 - dx) * (8 - dy) * p(y, x) + dx * (8 - dy) * p(y, x + 1) + (8 - dx) * dy * p(y + 1, x) + dx * dy * p(y + 1, x + 1) + 32, 6) for y in range(7) for x in range(7)))).alias("moved"))


_AVG = lambda a, b: f"(({a} + {b} + 1) >> 1)"
_G = lambda y, x: f"px[{8 * y + x + 1}]"
_LOW = {"across": ((0, 1), (1, 1), (0, 2), (1, 2)), "down": ((1, 0), (2, 0), (1, 1), (2, 1)), "both": ((1, 1), (2, 1), (1, 2), (2, 2))}


def _low_sql(at):
    return "[" + ", ".join(_AVG(_AVG(_G(2 * r + at[0][0], 2 * x + at[0][1]), _G(2 * r + at[1][0], 2 * x + at[1][1])), _AVG(_G(2 * r + at[2][0], 2 * x + at[2][1]), _G(2 * r + at[3][0], 2 * x + at[3][1]))) for r in range(3) for x in range(3)) + "]"


@query(f"{_P} SELECT vec_id, " + ", ".join(f"{_TEXT(_low_sql(at))} AS {k}" for k, at in _LOW.items()) + " FROM q")
def block_lowres_half(spark, sf_dir):
    """Half-sample planes of the picture at half size, as cascaded rounded averages of the full one."""
    avg = lambda a, b: F.shiftright(a + b + 1, 1)
    p = lambda r, x, o: _at("px", 2 * r + o[0], 2 * x + o[1])
    return samples(spark, sf_dir).select("vec_id", *(_text(F.array(*(avg(avg(p(r, x, at[0]), p(r, x, at[1])), avg(p(r, x, at[2]), p(r, x, at[3]))) for r in range(3) for x in range(3)))).alias(k) for k, at in _LOW.items()))


@query(f"{_P} SELECT vec_id, {_TEXT('[' + ', '.join(f'({x} + 8) // 16' for x in _DC) + ']')} AS coarse, {_TEXT('list_transform(px, lambda v: v << 2)')} AS ten_bits FROM q")
def block_coarse(spark, sf_dir):
    """Rounded means of 4x4 tiles, and the samples at ten bits."""
    mean = lambda y, x: F.floor((B.total(B.sub_block(F.col("px"), 8, y, x, 4)) + 8) / 16)
    return samples(spark, sf_dir).select("vec_id", _text(F.array(mean(0, 0), mean(0, 4), mean(4, 0), mean(4, 4))).alias("coarse"), _text(F.transform("px", lambda v: F.shiftleft(v, 2))).alias("ten_bits"))


_FLAT = " + ".join(f"{_sum(f'list_transform({_rows(f"list_transform({_tile("px", y, x)}, lambda v: v - (({_sum(_tile("px", y, x))} + 8) >> 4))", _H4)}, {_ABS})')}" for y in (0, 4) for x in (0, 4))
_NEXT = f"{_P}, n AS (SELECT a.vec_id, a.label, a.px, list_transform(list_zip(a.px, b.px), lambda z: z[1] - z[2]) AS res FROM q a JOIN q b ON b.vec_id = a.vec_id + 1)"


@query(f"{_NEXT}, c AS (SELECT label, {_FLAT} AS intra, {_satd('res')} AS inter FROM n) SELECT label, CAST(sum(intra) + 1 AS BIGINT) AS intra, CAST(sum(inter) + 1 AS BIGINT) AS inter, CAST(sum(least(intra, inter)) + 1 AS BIGINT) AS least_cost FROM c GROUP BY label")
def frame_complexity(spark, sf_dir):
    """The cost of each frame against flat tiles, against the next block, and by the lesser of both block by block; one more of each."""
    q = samples(spark, sf_dir)
    n = q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("after")), "vec_id")
    flat = None
    for y in (0, 4):
        for x in (0, 4):
            t = B.sub_block(F.col("px"), 8, y, x, 4)
            around = T.let(F.shiftright(B.total(t) + 8, 4), lambda m: F.transform(t, lambda v: v - m))  # noqa: B023  used at once
            one = B.total(F.transform(T.let(around, lambda d: B.apply_rows(d, B.matrix_rows(4, B.hadamard(4)))), lambda v: F.abs(v)))
            flat = one if flat is None else flat + one
    c = n.select("label", flat.alias("intra"), B.satd(B.residual(F.col("px"), F.col("after"))).alias("inter"))
    return c.groupBy("label").agg((F.sum("intra") + 1).alias("intra"), (F.sum("inter") + 1).alias("inter"), (F.sum(F.least("intra", "inter")) + 1).alias("least_cost"))


_LAP = " + ".join(f"abs(4 * {_G(y, x)} - {_G(y - 1, x)} - {_G(y + 1, x)} - {_G(y, x - 1)} - {_G(y, x + 1)})" for y in range(1, 7) for x in range(1, 7))
_READ = "r AS (SELECT label, bin, sum(count(*)) OVER (PARTITION BY label ORDER BY bin) AS run, sum(count(*)) OVER (PARTITION BY label) AS n FROM b WHERE mean BETWEEN 24 AND 232 GROUP BY label, bin), f AS (SELECT label, min(bin) AS bin, any_value(n) AS n FROM r WHERE run > n // 4 GROUP BY label), w AS (SELECT label, count(*) AS blocks FROM b GROUP BY label) SELECT label, blocks, CAST(coalesce(n, 0) AS BIGINT) AS n, "


def _reading(spark_rows, scale):
    """label, blocks, n, level: the first bin of the counted blocks whose running count is over a quarter of them; 0 if fewer than an eighth of all count."""
    sound = spark_rows.where(F.col("mean").between(24, 232)).groupBy("label", "bin").count()
    by = Window.partitionBy("label")
    r = sound.select("label", "bin", F.sum("count").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("count").over(by).alias("n"))
    first = r.where("run > n div 4").groupBy("label").agg(F.min("bin").alias("bin"), F.first("n").alias("n"))
    return spark_rows.groupBy("label").agg(F.count("*").alias("blocks")).join(first, "label", "left").select("label", "blocks", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") * 8 >= F.col("blocks"), F.col("bin") * scale).otherwise(0).cast("long").alias("level"))


@query(f"{_P}, b AS (SELECT label, {_sum('px')} // 64 AS mean, CAST(least(({_LAP}) * 16 // 36 // 4, 511) AS BIGINT) AS bin FROM q), {_READ} CAST(CASE WHEN n * 8 >= blocks THEN bin * 16 ELSE 0 END AS BIGINT) AS level FROM w LEFT JOIN f USING (label)")
def spatial_noise(spark, sf_dir):
    """The quartile of the blocks' mean absolute Laplacian, a quarter of it in sixteenths; blocks near black or white do not count."""
    lap = sum((F.abs(4 * _at("px", y, x) - _at("px", y - 1, x) - _at("px", y + 1, x) - _at("px", y, x - 1) - _at("px", y, x + 1)) for y in range(1, 7) for x in range(1, 7)), F.lit(0))
    b = samples(spark, sf_dir).select("label", F.floor(B.total(F.col("px")) / 64).alias("mean"), F.least(F.floor(F.floor(lap * 16 / 36) / 4), F.lit(511)).cast("long").alias("bin"))
    return _reading(b, 16)


_BESIDE = f"{_P}, n AS (SELECT a.vec_id, a.label, a.px, b.px AS after FROM q a JOIN q b ON b.vec_id = a.vec_id + 1)"
_ERR = _sum("list_transform(list_zip(px, after), lambda z: abs(z[1] - z[2]))")


@query(f"{_BESIDE}, b AS (SELECT label, {_sum('px')} // 64 AS mean, least({_ERR} * 16 // 64, 1023) AS bin FROM n), {_READ} CAST(CASE WHEN n * 8 >= blocks THEN bin ELSE 0 END AS BIGINT) AS level FROM w LEFT JOIN f USING (label)")
def temporal_noise(spark, sf_dir):
    """The quartile of the blocks' match errors against the next picture, in sixteenths."""
    q = samples(spark, sf_dir)
    n = q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("after")), "vec_id")
    return _reading(n.select("label", F.floor(B.total(F.col("px")) / 64).alias("mean"), F.least(F.floor(B.sad(F.col("px"), F.col("after")) * 16 / 64), F.lit(1023)).cast("long").alias("bin")), 1)


#: The strength of a neighbour by its distance, of 256; the width of the photometric weight.
STRENGTH, SIGMA, RANGE = (256, 218, 154, 115, 90), 6.0, 2
GAUSS = [math.floor(256 * math.exp(-d * d / (2 * SIGMA * SIGMA)) + 0.5) for d in range(32)]
_NB = [d for k in range(1, RANGE + 1) for d in (-k, k)]
_WB = lambda d: f"(({STRENGTH[abs(d)]} * ((256 * 96 + (96 + e{d + RANGE}) // 2) // (96 + e{d + RANGE}))) >> 8)"
_WP = lambda d: f"((w{d + RANGE} * list_extract({GAUSS}, CAST(least(abs(p{d + RANGE}[i] - px[i]), 31) AS INTEGER) + 1)) >> 8)"


@query(f"{_P}, j AS (SELECT q.vec_id, q.px, " + ", ".join(f"n{d + RANGE}.px AS p{d + RANGE}" for d in _NB) + " FROM q " + " ".join(f"JOIN q n{d + RANGE} ON n{d + RANGE}.vec_id = q.vec_id + ({d})" for d in _NB) + "), e AS (SELECT *, " + ", ".join(f"{_sum(f'list_transform(list_zip(px, p{d + RANGE}), lambda z: abs(z[1] - z[2]))')} * 16 // 64 AS e{d + RANGE}" for d in _NB) + " FROM j), w AS (SELECT *, " + ", ".join(f"{_WB(d)} AS w{d + RANGE}" for d in _NB) + " FROM e) SELECT vec_id, " + _TEXT(f"list_transform(range(1, 65), lambda i: (256 * px[i] + {' + '.join(f'{_WP(d)} * p{d + RANGE}[i]' for d in _NB)} + (256 + {' + '.join(map(_WP, _NB))}) // 2) // (256 + {' + '.join(map(_WP, _NB))}))") + " AS filtered FROM w")
def temporal_filter(spark, sf_dir):
    """Each sample as the rounded mean of its own and those of two pictures on either side, weighted by distance, block error and difference. The neighbours come by a window over the ordered blocks, in
    groups of a thousand with a margin, so that no sort is global."""
    q, size = samples(spark, sf_dir).select("vec_id", "px"), 1000
    own = q.withColumn("g", F.floor(F.col("vec_id") / size)).withColumn("own", F.lit(True))
    margin = lambda cond, step: q.where(cond).withColumn("g", F.floor(F.col("vec_id") / size) + step).withColumn("own", F.lit(False))
    rows = own.unionByName(margin(F.col("vec_id") % size < RANGE, -1)).unionByName(margin(F.col("vec_id") % size >= size - RANGE, 1))
    near = Window.partitionBy("g").orderBy("vec_id").rangeBetween(-RANGE, RANGE)
    j = rows.withColumn("near", F.collect_list(F.struct("vec_id", "px")).over(near)).where("own").where(F.size("near") == 2 * RANGE + 1)
    j = j.select("vec_id", "px", F.filter("near", lambda n: n["vec_id"] != F.col("vec_id")).alias("near"))
    whole = lambda a, b: F.floor(a / b).cast("long")

    def weighed(n):
        err = whole(B.sad(F.col("px"), n["px"]) * 16, F.lit(64))
        return F.struct(n["px"].alias("p"), F.shiftright(F.get(F.array(*map(F.lit, STRENGTH)), F.abs(n["vec_id"] - F.col("vec_id")).cast("int")) * whole(F.lit(256 * 96) + whole(96 + err, F.lit(2)), 96 + err), 8).alias("w"))

    gauss = F.array(*map(F.lit, GAUSS))
    j = j.select("vec_id", "px", F.transform("near", weighed).alias("near"))

    def sample(v, i):
        zero = F.struct((v.cast("long") * 256).alias("acc"), F.lit(256).cast("long").alias("sum"))
        def add(s, n):
            w = F.shiftright(n["w"] * F.get(gauss, F.least(F.abs(F.get(n["p"], i) - v), F.lit(31))), 8)
            return F.struct((s["acc"] + w * F.get(n["p"], i)).alias("acc"), (s["sum"] + w).alias("sum"))
        return F.aggregate("near", zero, add, lambda s: whole(s["acc"] + whole(s["sum"], F.lit(2)), s["sum"]))

    return j.select("vec_id", _text(F.transform("px", sample)).alias("filtered"))


@query(f"{_BESIDE} SELECT label, count(*) AS n, count(*) FILTER (WHERE {_ERR} / 64.0 > 8.0) AS moving, count(*) FILTER (WHERE {_sum('px')} // 64 NOT BETWEEN 24 AND 232) AS clipped FROM n GROUP BY label")
def moving_blocks(spark, sf_dir):
    """Blocks whose mean absolute difference to the next picture passes a bar, and those near black or white."""
    q = samples(spark, sf_dir)
    n = q.join(q.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("after")), "vec_id")
    return n.groupBy("label").agg(F.count("*").alias("n"), F.count_if(B.sad(F.col("px"), F.col("after")) / 64.0 > 8.0).alias("moving"), F.count_if(~F.floor(B.total(F.col("px")) / 64).between(24, 232)).alias("clipped"))


#: Fixed values of the standard: chroma QP for luma QP 30 to 51; the default 4x4 weights within and between pictures in scan order.
CHROMA = (29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39)
WEIGHTS = {"intra": (6, 13, 13, 20, 20, 20, 28, 28, 28, 28, 32, 32, 32, 37, 37, 42), "inter": (10, 14, 14, 20, 20, 20, 24, 24, 24, 24, 27, 27, 27, 30, 30, 34), "flat": (16,) * 16}


@query(f"SELECT event_id, CAST(CASE WHEN q < 30 THEN q ELSE list_extract({list(CHROMA)}, q - 29) END AS INTEGER) AS chroma_qp FROM (SELECT event_id, CAST(least(greatest(event_id % 60 + user_id % 13 - 6, 0), 51) AS INTEGER) AS q FROM events)")
def chroma_qp(spark, sf_dir):
    q = F.least(F.greatest(F.col("event_id") % 60 + F.col("user_id") % 13 - 6, F.lit(0)), F.lit(51)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", q.alias("q")).select("event_id", F.when(F.col("q") < 30, F.col("q")).otherwise(F.get(F.array(*map(F.lit, CHROMA)), F.col("q") - 30)).cast("int").alias("chroma_qp"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {p}, {v[s]}, {(13107 * 16 + (v[s] >> 1)) // v[s]})" for k, v in WEIGHTS.items() for s, p in enumerate(B.ZIGZAG4)) + ") t(name, place, weight, multiplier)")
def quant_matrices(spark, sf_dir):
    """The weights of each list by place, and the quantiser's multiplier scaled by them."""
    w = spark.createDataFrame([(k, s, v[s]) for k, v in WEIGHTS.items() for s in range(16)], "name string, s int, weight int")
    return w.select("name", F.get(F.array(*map(F.lit, B.ZIGZAG4)), F.col("s")).alias("place"), "weight", F.floor((13107 * 16 + F.shiftright("weight", 1)) / F.col("weight")).cast("int").alias("multiplier"))


@query("WITH b AS (SELECT user_id, event_id, event_type = 'signup' AS intra, value > 15 AS coef, CAST(floor(value * 3) AS BIGINT) AS mv, user_id % 3 AS ref FROM events), n AS (SELECT *, lag(intra) OVER w AS li, lag(coef) OVER w AS lc, lag(mv) OVER w AS lm, lag(ref) OVER w AS lr, (row_number() OVER w - 1) % 4 AS x FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CASE WHEN intra OR li THEN CASE WHEN x = 0 THEN 4 ELSE 3 END WHEN coef OR lc THEN 2 WHEN ref <> lr OR abs(mv - lm) >= 4 THEN 1 ELSE 0 END AS strength FROM n WHERE li IS NOT NULL")
def deblock_strength(spark, sf_dir):
    """The strength of the edge between a block and the one on its left: intra (4 at every fourth block, which begins a macroblock), coefficients, another reference or a vector apart by 4."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    b = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "signup").alias("intra"), (F.col("value") > 15).alias("coef"), F.floor(F.col("value") * 3).alias("mv"), (F.col("user_id") % 3).alias("ref"))
    n = b.select("*", F.lag(F.struct("intra", "coef", "mv", "ref")).over(w).alias("l"), ((F.row_number().over(w) - 1) % 4).alias("x")).where("l is not null")
    return n.select("user_id", "event_id", F.when(F.col("intra") | F.col("l.intra"), F.when(F.col("x") == 0, 4).otherwise(3)).when(F.col("coef") | F.col("l.coef"), 2).when((F.col("ref") != F.col("l.ref")) | (F.abs(F.col("mv") - F.col("l.mv")) >= 4), 1).otherwise(0).alias("strength"))


@query(f"WITH q AS (SELECT vec_id, label, {_Q} AS px FROM embeddings), v AS (SELECT label, vec_id, log2(({_sum('list_transform(px, lambda v: v * v)')} - {_sum('px')} * {_sum('px')} // 64) / 64.0 + 2) AS l FROM q) SELECT vec_id, round(0.4 * (l - 4.5), 6) AS qp_offset, round(0.4 * (l - avg(l) OVER (PARTITION BY label)), 6) AS around_frame FROM v")
def variance_offsets(spark, sf_dir):
    """The offset by the logarithm of a block's variance, around a fixed centre and around the frame's mean."""
    var = (B.squares(F.col("px")) - F.floor(B.total(F.col("px")) * B.total(F.col("px")) / 64)) / 64.0
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", B.quantised(F.col("embedding")).alias("px")).select("vec_id", "label", F.log2(var + 2).alias("l"))
    mean = v.groupBy("label").agg(F.avg("l").alias("mean"))
    return v.join(mean, "label").select("vec_id", F.round(0.4 * (F.col("l") - 4.5), 6).alias("qp_offset"), F.round(0.4 * (F.col("l") - F.col("mean")), 6).alias("around_frame"))


_MID = [(y, x) for y in (2, 3, 4) for x in (2, 3, 4)]
_ROW = lambda y, x: T.six_tap([T.Sql(f"px[{8 * y + x - 2 + k + 1}]") for k in range(6)])
_CENTRE = [_CLIP(f"CAST(floor(({T.six_tap([_ROW(y - 2 + k, x) for k in range(6)])} + 512) / 1024.0) AS BIGINT)") for y, x in _MID if y - 2 >= 0 and y + 3 <= 7]
_HALFROW = [_CLIP(f"CAST(floor(({_ROW(y, x)} + 16) / 32.0) AS BIGINT)") for y, x in _MID]


@query(f"{_P} SELECT vec_id, {_TEXT('[' + ', '.join(_CENTRE) + ']')} AS centre, {_TEXT('[' + ', '.join(_AVG(_G(y, x), h) for (y, x), h in zip(_MID, _HALFROW)) + ']')} AS quarter, {_TEXT('[' + ', '.join(_AVG(h, c) for h, c in zip(_HALFROW, _CENTRE)) + ']')} AS lower FROM q")
def block_quarter_samples(spark, sf_dir):
    """Where all samples of the filters lie in the block: the half sample between four others, from unrounded rows; a quarter between a sample and the half beside it; a quarter between that half and the centre."""
    row = lambda y, x: T.six_tap([_at("px", y, x - 2 + k) for k in range(6)])
    clip = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255))
    half = {p: clip(F.shiftright(row(*p) + 16, 5)) for p in _MID}
    centre = {(y, x): clip(F.shiftright(T.six_tap([row(y - 2 + k, x) for k in range(6)]) + 512, 10)) for y, x in _MID}
    q = samples(spark, sf_dir).select("vec_id", "px", F.array(*half.values()).alias("h"), F.array(*centre.values()).alias("c"))
    avg = lambda a, b: F.shiftright(a + b + 1, 1)
    quarter = F.array(*(avg(_at("px", y, x), F.get("h", i)) for i, (y, x) in enumerate(_MID)))
    return q.select("vec_id", _text(F.col("c")).alias("centre"), _text(quarter).alias("quarter"), _text(F.zip_with("h", "c", avg)).alias("lower"))


_TOP, _LEFT, _CORNER = [f"b[{57 + i}]" for i in range(8)], [f"b[{8 * i + 8}]" for i in range(8)], "b[1]"
_GRAD = lambda e: " + ".join(f"{k + 1} * ({e[4 + k]} - {e[2 - k] if k < 3 else _CORNER})" for k in range(4))


@query(_PAIRS + f", g AS (SELECT vec_id, a, 16 * ({_LEFT[7]} + {_TOP[7]}) AS base, CAST(floor((34 * ({_GRAD(_TOP)}) + 32) / 64.0) AS BIGINT) AS gx, CAST(floor((34 * ({_GRAD(_LEFT)}) + 32) / 64.0) AS BIGINT) AS gy FROM p), r AS (SELECT vec_id, gx, gy, [" + ", ".join(f"a[{8 * y + x + 1}] - least(greatest(CAST(floor((base + gx * {x - 3} + gy * {y - 3} + 16) / 32.0) AS BIGINT), -128), 127)" for y in range(8) for x in range(8)) + f"] AS res FROM g) SELECT vec_id, gx, gy, {_satd('res')} AS cost FROM r")
def block_plane_prediction(spark, sf_dir):
    """The plane through the edges of an 8x8 block, and what is left of the block."""
    top, left = [F.get("b", 56 + i) for i in range(8)], [F.get("b", 8 * i + 7) for i in range(8)]
    slope = lambda e: F.shiftright(34 * sum(((k + 1) * (e[4 + k] - (e[2 - k] if k < 3 else F.get("b", F.lit(0)))) for k in range(4)), F.lit(0)) + 32, 6)
    g = pairs(spark, sf_dir).select("vec_id", "a", (16 * (left[7] + top[7])).alias("base"), slope(top).alias("gx"), slope(left).alias("gy"))
    pred = lambda i: F.least(F.greatest(F.shiftright(F.col("base") + F.col("gx") * (i % 8 - 3) + F.col("gy") * (F.floor(i / 8).cast("int") - 3) + 16, 5), F.lit(-128)), F.lit(127))
    return g.select("vec_id", "gx", "gy", F.transform("a", lambda v, i: v - pred(i)).alias("res")).select("vec_id", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), B.satd(F.col("res")).alias("cost"))
