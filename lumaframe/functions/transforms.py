"""One-dimensional transforms and predictions of the standard, written once for anything that adds, subtracts and shifts: columns, integers and SQL text.

A transform takes a list of terms and `shr(term, bits)`, the arithmetic shift to the right.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Shift = Callable


class Sql(str):
    """SQL text that can be added, subtracted and multiplied."""

    def __add__(self, other):
        return Sql(f"({str(self)} + {str(other)})")

    __radd__ = __add__

    def __sub__(self, other):
        return Sql(f"({str(self)} - {str(other)})")

    def __rsub__(self, other):
        return Sql(f"({str(other)} - {str(self)})")

    def __mul__(self, other):
        return Sql(f"({str(self)} * {str(other)})")

    __rmul__ = __mul__

    def __neg__(self):
        return Sql(f"(-{str(self)})")


def sql_shr(x, bits: int) -> Sql:
    """DuckDB shifts negative numbers as the standard does only by division rounded down."""
    return Sql(f"CAST(floor({str(x)} / {float(1 << bits)}) AS BIGINT)")


def forward8(s: list, shr: Shift) -> list:
    """The 8-point forward transform: its rows are an eighth of the standard's matrix, halves and quarters rounded down."""
    even, odd = [s[i] + s[7 - i] for i in range(4)], [s[i] - s[7 - i] for i in range(4)]
    outer, inner = [even[0] + even[3], even[1] + even[2]], [even[0] - even[3], even[1] - even[2]]
    wide = lambda x: x + shr(x, 1)  # noqa: E731  one and a half times
    t = [odd[1] + odd[2] + wide(odd[0]), odd[0] - odd[3] - wide(odd[2]), odd[0] + odd[3] - wide(odd[1]), odd[1] - odd[2] + wide(odd[3])]
    return [outer[0] + outer[1], t[0] + shr(t[3], 2), inner[0] + shr(inner[1], 1), t[1] + shr(t[2], 2), outer[0] - outer[1], t[2] - shr(t[1], 2), shr(inner[0], 1) - inner[1], shr(t[0], 2) - t[3]]


def inverse8(c: list, shr: Shift) -> list:
    """The 8-point inverse transform of the standard, before the final rounding."""
    wide = lambda x: x + shr(x, 1)
    top, low = [c[0] + c[4], c[0] - c[4]], [shr(c[2], 1) - c[6], c[2] + shr(c[6], 1)]
    even = [top[0] + low[1], top[1] + low[0], top[1] - low[0], top[0] - low[1]]
    u = [c[5] - c[3] - wide(c[7]), c[1] + c[7] - wide(c[3]), c[7] - c[1] + wide(c[5]), c[3] + c[5] + wide(c[1])]
    odd = [u[3] - shr(u[0], 2), shr(u[1], 2) - u[2], u[1] + shr(u[2], 2), u[0] + shr(u[3], 2)]
    return [e + o for e, o in zip(even, odd)] + [e - o for e, o in zip(even[::-1], odd[::-1])]


def inverse4(c: list, shr: Shift) -> list:
    """The 4-point inverse transform of the standard, before the final rounding."""
    plus, minus = [c[0] + c[2], c[1] + shr(c[3], 1)], [c[0] - c[2], shr(c[1], 1) - c[3]]
    return [plus[0] + plus[1], minus[0] + minus[1], minus[0] - minus[1], plus[0] - plus[1]]


def six_tap(s: list):
    """The half-sample filter of the standard between the third and fourth of six samples, before rounding."""
    return s[0] - s[1] * 5 + s[2] * 20 + s[3] * 20 - s[4] * 5 + s[5]


def let(x: Column, f: Callable) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def both_ways(px: Column, one: Callable, n: int) -> Column:
    """A one-dimensional transform of the rows, then of the columns, of an n by n block; the result row by row."""
    shr = lambda x, bits: F.shiftright(x, bits)
    steps = F.array(*map(F.lit, range(n)))
    rows = F.transform(steps, lambda i: F.array(*one([F.get(px, i * n + j) for j in range(n)], shr)))
    columns = lambda m: F.transform(steps, lambda j: F.array(*one([F.get(F.get(m, F.lit(i)), j) for i in range(n)], shr)))
    turned = lambda m: F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.get(F.get(m, j), i))))
    return let(let(rows, columns), turned)


def both_ways_sql(name: str, one: Callable, n: int) -> str:
    """The same in DuckDB, as a list; `name` is a list of n * n numbers."""
    rows = f"list_transform(range({n}), lambda i: [{', '.join(one([Sql(f'{name}[i * {n} + {j + 1}]') for j in range(n)], sql_shr))}])"
    columns = f"list_transform([{rows}], lambda m: list_transform(range({n}), lambda j: [{', '.join(one([Sql(f'm[{i + 1}][j + 1]') for i in range(n)], sql_shr))}]))[1]"
    return f"list_transform([{columns}], lambda m: flatten(list_transform(range({n}), lambda i: list_transform(range({n}), lambda j: m[j + 1][i + 1]))))[1]"


def intra4(mode: int) -> list[tuple[dict[int, int], int]]:
    """(weights, shift) of each sample of a 4x4 prediction, all neighbours present. Neighbours are numbered along the edge: 0 to 3 the left ones from the lowest up, 4 the corner, 5 to 12 the upper ones."""

    def three(i: int) -> tuple[dict[int, int], int]:  # of a place and those beside it, the ends repeated
        w: dict[int, int] = {}
        for j, k in ((i - 1, 1), (i, 2), (i + 1, 1)):
            j = min(max(j, 0), 12)
            w[j] = w.get(j, 0) + k
        return w, 2

    two = lambda i: ({i: 1, i + 1: 1}, 1)
    out = []
    for y in range(4):
        for x in range(4):
            if mode == 0:
                out.append(({5 + x: 1}, 0))
            elif mode == 1:
                out.append(({3 - y: 1}, 0))
            elif mode == 2:
                out.append(({**{i: 1 for i in range(4)}, **{5 + i: 1 for i in range(4)}}, 3))
            elif mode == 3:
                out.append(three(6 + x + y))
            elif mode == 4:
                out.append(three(4 + x - y))
            elif mode == 5:  # steep downwards to the right
                z = 2 * x - y
                out.append(three(5 - y if z < -1 else 4) if z < 0 else two(4 + z // 2) if z % 2 == 0 else three(4 + (z + 1) // 2))
            elif mode == 6:
                z = 2 * y - x
                out.append(three(3 + x if z < -1 else 4) if z < 0 else two(3 - z // 2) if z % 2 == 0 else three(4 - (z + 1) // 2))
            elif mode == 7:
                out.append(two(5 + x + y // 2) if y % 2 == 0 else three(6 + x + y // 2))
            else:
                z = x + 2 * y
                out.append(({0: 1}, 0) if z > 5 else ({0: 3, 1: 1}, 2) if z == 5 else two(2 - z // 2) if z % 2 == 0 else three(2 - z // 2))
    return out
