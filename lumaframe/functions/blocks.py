"""Block kernels as column expressions on ARRAY<INT>: they stay in the JVM and need no UDF."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 4x4 and 8x8 Hadamard signs follow from a rule, the integer core transform and its scan order are the standard's.
CORE4 = [[1, 1, 1, 1], [2, 1, -1, -2], [1, -1, -1, 1], [1, -2, 2, -1]]
ZIGZAG4 = [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]
#: Fixed values of the standard: multipliers of the 4x4 quantiser and dequantiser by qp % 6, for positions (even, even), (odd, odd), others.
QUANT = [(13107, 5243, 8066), (11916, 4660, 7490), (10082, 4194, 6554), (9362, 3647, 5825), (8192, 3355, 5243), (7282, 2893, 4559)]
DEQUANT = [(10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23)]


def hadamard(n: int) -> list[list[int]]:
    return [[-1 if bin(i & j).count("1") % 2 else 1 for j in range(n)] for i in range(n)]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def quantised(x: Column, scale: int = 128) -> Column:
    """Samples from floats: floor(x * scale + 0.5)."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * scale + 0.5).cast("int"))


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sad(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def ssd(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y)))


def total(a: Column) -> Column:
    return _total(a)


def squares(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x.cast("long") * x))


def average(a: Column, b: Column) -> Column:
    """(a + b + 1) >> 1"""
    return F.zip_with(a, b, lambda x, y: F.shiftright(x + y + 1, 1))


def weighted(a: Column, b: Column, wa: int, wb: int, shift: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.shiftright(x * wa + y * wb + (1 << (shift - 1)), shift))


def tile(px: Column, width: int, top: int, left: int, size: int = 4) -> list[Column]:
    """The samples of a square tile as scalar columns, row by row."""
    return [F.element_at(px, (top + i) * width + left + j + 1) for i in range(size) for j in range(size)]


def _signed(terms: list[tuple[int, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [c if k == 1 else c * k for k, c in terms if k])


def transform2d(samples: list[Column], matrix: list[list[int]]) -> list[Column]:
    """matrix * block * matrix' of scalar columns, row by row."""
    n = len(matrix)
    half = [_signed([(matrix[i][k], samples[k * n + j]) for k in range(n)]) for i in range(n) for j in range(n)]
    return [_signed([(matrix[j][k], half[i * n + k]) for k in range(n)]) for i in range(n) for j in range(n)]


def matrix_rows(n: int, matrix: list[list[int]]) -> list[list[int]]:
    """The n*n by n*n matrix of the two-dimensional transform."""
    return [[matrix[i][a] * matrix[j][b] for a in range(n) for b in range(n)] for i in range(n) for j in range(n)]


def apply_rows(px: Column, rows: list[list[int]]) -> Column:
    """rows * px, for a constant matrix."""
    table = F.array(*(F.array(*(F.lit(v) for v in r)) for r in rows))
    return F.transform(table, lambda r: _total(F.zip_with(r, px, lambda k, v: k * v)))


def sub_block(px: Column, width: int, top: int, left: int, size: int) -> Column:
    return F.transform(F.array(*(F.lit((top + i) * width + left + j) for i in range(size) for j in range(size))), lambda i: F.get(px, i))


def satd(res: Column, width: int = 8) -> Column:
    """Sum of the absolute 4x4 Hadamard coefficients of all tiles of a residual, not halved."""
    rows = matrix_rows(4, hadamard(4))
    tiles = [apply_rows(sub_block(res, width, y, x, 4), rows) for y in range(0, width, 4) for x in range(0, width, 4)]
    return reduce(lambda a, b: a + b, [_total(F.transform(t, lambda v: F.abs(v))) for t in tiles])


def sa8d(res: Column) -> Column:
    """(sum of the absolute 8x8 Hadamard coefficients + 2) >> 2"""
    return F.shiftright(_total(F.transform(apply_rows(res, matrix_rows(8, hadamard(8))), lambda v: F.abs(v))) + 2, 2)


def dct4(px: Column) -> Column:
    """The integer core transform of a 4x4 block."""
    return apply_rows(px, matrix_rows(4, CORE4))


def _by_place(values: tuple[int, int, int]) -> Column:
    return F.array(*(F.lit(values[0] if y % 2 == 0 == x % 2 else values[1] if y % 2 and x % 2 else values[2]) for y in range(4) for x in range(4)))


def quant4(coef: Column, qp: int, intra: bool = True) -> Column:
    """(abs(c) * mf + f) >> qbits with the sign restored; f is a third of a step within a frame, else a sixth."""
    qbits = 15 + qp // 6
    f = (1 << qbits) // (3 if intra else 6)
    return F.zip_with(coef, _by_place(QUANT[qp % 6]), lambda c, m: (F.signum(c) * F.shiftright(F.abs(c).cast("long") * m + f, qbits)).cast("int"))


def dequant4(level: Column, qp: int) -> Column:
    return F.zip_with(level, _by_place(DEQUANT[qp % 6]), lambda c, m: c * m * (1 << qp // 6))


def zigzag4(coef: Column) -> Column:
    return F.transform(F.array(*map(F.lit, ZIGZAG4)), lambda i: F.get(coef, i))


def scan_mask(level: Column) -> Column:
    """Bit i set where the i-th level in scan order is not 0."""
    return F.aggregate(F.transform(zigzag4(level), lambda v, i: F.when(v != 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v).cast("long")


def mv_bits(d: Column) -> Column:
    """1 + 2 * bit length of abs(d)."""
    return F.when(d == 0, 1).otherwise(1 + 2 * F.length(F.bin(F.abs(d))))


def qscale(qp: Column) -> Column:
    return F.pow(F.lit(2.0), (qp - 12) / 6.0)


def stat_weight(bits: Column, qp: Column, exponent: float = 0.6) -> Column:
    return F.pow((bits + 1) * qscale(qp), F.lit(exponent))


def psnr(mse: Column, peak: int = 255, best: float = 99.0) -> Column:
    return F.when(mse <= 0, F.lit(best)).otherwise(10 * F.log10(F.lit(float(peak * peak)) / mse))


def ramp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def arrived(t: Column, start: Column, end: Column, bits: Column) -> Column:
    """Bits delivered by time t when `bits` arrive evenly from start to end."""
    return F.when(t <= start, F.lit(0.0)).when(t >= end, bits.cast("double")).otherwise(bits * (t - start) / (end - start))
