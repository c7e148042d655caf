"""Rate-quality curves of any length: grouped Arrow functions, as a polynomial fit is no SQL expression."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bd_rate(ref: list[tuple[float, float]], test: list[tuple[float, float]]) -> float | None:
    """Bjontegaard rate difference in percent of (rate, score) curves; None where the scores do not overlap or a curve has one point."""
    if min(len(ref), len(test)) < 2:
        return None
    (ra, sa), (rb, sb) = (np.array(sorted(c, key=lambda p: p[1]), float).T for c in (ref, test))
    lo, hi = max(sa.min(), sb.min()), min(sa.max(), sb.max())
    if hi <= lo:
        return None
    at = np.linspace(lo, hi, 100)
    fit = lambda r, s: np.polyval(np.polyfit(s - lo, np.log(r), min(3, len(s) - 1)), at - lo)
    return float((np.exp(np.mean(fit(rb, sb) - fit(ra, sa))) - 1) * 100)


def bd_rates(points: DataFrame, by: str, arm: str, anchor: str, rate: str = "kbps", score: str = "score") -> DataFrame:
    """by, arm, bd_pct for every arm but the anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        curves = {a: list(zip(g[rate], g[score])) for a, g in pdf.groupby(arm)}
        rows = [(pdf[by].iloc[0], a, bd_rate(curves[anchor], c)) for a, c in sorted(curves.items()) if a != anchor and anchor in curves]
        return pd.DataFrame(rows, columns=[by, arm, "bd_pct"])

    kind = lambda c: points.schema[c].dataType.simpleString()
    return points.groupBy(by).applyInPandas(run, f"{by} {kind(by)}, {arm} {kind(arm)}, bd_pct double")


def rung_overlap(ref: list[float], test: list[float], n: int) -> int:
    """Rungs of the shared range of log rates, 0 to n."""
    (a, b), (c, d) = ((np.log(min(x)), np.log(max(x))) for x in (ref, test))
    shared, either = min(b, d) - max(a, c), max(b, d) - min(a, c)
    return max(0, min(n, round((shared / either if either else 0) * (n - 1)) + 1))


def inverted(curve: list[tuple[float, float]], targets: tuple[float, ...] = (88, 90, 92, 94)) -> list[float | None]:
    """The rate at each target score, log-linear within the first segment that holds it."""
    pts = sorted(curve, key=lambda p: p[1])
    out: list[float | None] = []
    for t in targets:
        seg = next(((p, q) for p, q in zip(pts, pts[1:]) if p[1] <= t <= q[1]), None)
        f = None if seg is None else (t - seg[0][1]) / ((seg[1][1] - seg[0][1]) or 1)
        out.append(None if seg is None else float(np.exp(np.log(seg[0][0]) + f * (np.log(seg[1][0]) - np.log(seg[0][0])))))
    return out
