"""Operators with serial state over a group of pictures: propagation along motion and the two-pass plan. A group is bounded by its key-frame interval."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the documented model: AQ and propagation strengths, ratios between picture types, quantiser compression.
TREE_STRENGTH, QCOMP, IP_RATIO, PB_RATIO = 1.4, 0.6, 1.4, 1.3


def propagated(intra: np.ndarray, inter: np.ndarray, mv: np.ndarray, aq: np.ndarray | float = 1.0, strength: float = TREE_STRENGTH) -> np.ndarray:
    """QP offsets by (frame, block): from the last frame back, a block passes 1 - inter / intra of its own and inherited cost to the block its vector points at in the frame before."""
    frames, blocks = intra.shape
    gain = np.zeros((frames, blocks))
    for f in range(frames - 1, 0, -1):
        share = 1 - np.minimum(inter[f], intra[f]) / np.maximum(intra[f], 1e-9)
        target = np.clip(np.arange(blocks) + mv[f], 0, blocks - 1)
        np.add.at(gain[f - 1], target, (intra[f] * aq + gain[f]) * share)
    return -strength * np.log2(1 + gain / np.maximum(intra * aq, 1e-9))


def tree_offsets(costs: DataFrame) -> DataFrame:
    """gop, frame, block, offset of rows gop, frame, block, intra, inter, mv; each group is one bounded task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["frame", "block"])
        shape = (p["frame"].nunique(), p["block"].nunique())
        grid = lambda c: p[c].to_numpy().reshape(shape)
        return pd.DataFrame({"gop": p["gop"], "frame": p["frame"], "block": p["block"], "offset": propagated(grid("intra"), grid("inter"), grid("mv")).reshape(-1)})

    return costs.groupBy("gop").applyInPandas(run, "gop long, frame long, block long, offset double")


def qscale(qp):
    return 2.0 ** ((qp - 12) / 6.0)


def planned(kinds: list[str], bits: np.ndarray, qp: np.ndarray, budget: float, blur: float = 20.0, step: float = 4.0) -> np.ndarray:
    """The second pass's QP of each picture: costs from the first pass, a Gaussian blur over P pictures, a rate factor found by bisection, I from the P after it, B from the anchor after it."""
    cost = (bits + 1) * qscale(qp)
    is_p = np.array([k == "P" for k in kinds])
    sigma, cplx = 0.5 * blur, cost.astype(float)
    radius = math.ceil(3 * sigma)
    weight = np.array([1.0 if k == "P" else 0.5 if k == "I" else 0.0 for k in kinds])
    for i in np.flatnonzero(is_p):
        a, b = max(0, i - radius), min(len(kinds), i + radius + 1)
        g = np.exp(-((np.arange(a, b) - i) ** 2) / (2 * sigma * sigma)) * weight[a:b]
        cplx[i] = (g * cost[a:b]).sum() / g.sum()

    def plan(rate: float) -> np.ndarray:
        q, last = np.zeros(len(kinds)), None
        for i in np.flatnonzero(is_p):
            x = 12 + 6 * math.log2(max(cplx[i] ** (1 - QCOMP) / rate, 1e-9))
            last = x if last is None else min(max(x, last - step), last + step)
            q[i] = last
        for i, k in enumerate(kinds):
            if k == "I":
                near = [q[j] for j in range(i + 1, len(kinds)) if is_p[j]][:8] or [q[j] for j in range(i) if is_p[j]][-1:] or [26.0]
                q[i] = float(np.mean(near)) - 6 * math.log2(IP_RATIO)
        for i, k in enumerate(kinds):
            if k == "B":
                j = next((j for j in range(i + 1, len(kinds)) if kinds[j] != "B"), None)
                anchor = 26.0 if j is None else q[j] + (6 * math.log2(IP_RATIO) if kinds[j] == "I" else 0)
                q[i] = anchor + 6 * math.log2(PB_RATIO)
        return np.clip(q, 0, 51)

    low, high = 1e-6, 1e6
    for _ in range(60):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if (cost / qscale(plan(mid))).sum() <= budget else (low, mid)
    return plan(low)


def two_pass(stats: DataFrame, budget_per_picture: float) -> DataFrame:
    """gop, idx, qp of rows gop, idx, type ('I', 'P', 'B'), bits, qp."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("idx")
        q = planned(list(p["type"]), p["bits"].to_numpy(float), p["qp"].to_numpy(float), budget_per_picture * len(p))
        return pd.DataFrame({"gop": p["gop"], "idx": p["idx"], "qp": q})

    return stats.groupBy("gop").applyInPandas(run, "gop long, idx long, qp double")


def unwrapped_order(lsb: list[int], is_idr: list[bool], is_ref: list[bool], bits: int) -> list[int]:
    """Picture order counts from their low bits: the high part carries from the last reference picture."""
    size, out, prev_lsb, prev_msb = 1 << bits, [], 0, 0
    for value, idr, ref in zip(lsb, is_idr, is_ref):
        if idr:
            prev_lsb = prev_msb = 0
        if value < prev_lsb and prev_lsb - value >= size // 2:
            msb = prev_msb + size
        elif value > prev_lsb and value - prev_lsb > size // 2:
            msb = prev_msb - size
        else:
            msb = prev_msb
        out.append(msb + value)
        if ref:
            prev_lsb, prev_msb = value, msb
    return out
