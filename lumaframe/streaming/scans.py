"""Streaming forms of the scans: the same answers as the batch forms for any cut into micro-batches. Input comes in order within a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_stream(units: DataFrame, by: str, order: str, bits: str, size: int, rate: int) -> DataFrame:
    """by, order, fill, underflows after each unit of a stream; the state is three numbers a stream."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fill, under, seen = state.get if state.exists else (size, 0, 0)
        for pdf in [pd.concat(list(parts)).sort_values(order)]:
            rows = []
            for at, b in zip(pdf[order], pdf[bits]):
                fill = (fill if seen == 0 else min(fill + rate, size)) - int(b)
                if fill < 0:
                    under, fill = under + 1, 0
                seen += 1
                rows.append((key[0], at, fill, under))
            yield pd.DataFrame(rows, columns=["key", "at", "fill", "underflows"])
        state.update((fill, under, seen))

    return units.groupBy(by).applyInPandasWithState(run, "key long, at long, fill long, underflows long", "fill long, under long, seen long", "append", GroupStateTimeout.NoTimeout)


def cut_stream(frames: DataFrame, by: str, order: str, ratio: str) -> DataFrame:
    """key, at, cut: each frame's decision comes one frame late, as the frame after may clear it as a flash; held are the last three ratios and the frame that waits.
    A row without a ratio, behind the last frame, ends a stream: it gives out the frame that waits and forgets the state."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, wait_at, wait_cut = state.get if state.exists else ([], -1, False)
        held, rows = list(held), []
        pdf = pd.concat(list(parts)).sort_values(order)
        for at, r in zip(pdf[order], pdf[ratio]):
            if pd.isna(r):
                rows += [(key[0], wait_at, bool(wait_cut))] if wait_at >= 0 else []
                held, wait_at, wait_cut = [], -1, False
                continue
            if wait_at >= 0:
                rows.append((key[0], wait_at, bool(wait_cut and r >= 0.02)))
            top = max(held, default=None)
            wait_at, wait_cut = int(at), top is not None and r >= 0.9 and (r >= top + 0.1 or 1 - r <= (1 - top) / 2)
            held = [*held, float(r)][-3:]
        if wait_at >= 0:
            state.update((held, wait_at, bool(wait_cut)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "at", "cut"])

    return frames.groupBy(by).applyInPandasWithState(run, "key long, at long, cut boolean", "held array<double>, wait_at long, wait_cut boolean", "append", GroupStateTimeout.NoTimeout)


def shot_stream(frames: DataFrame, by: str, order: str, cut: str, value: str) -> DataFrame:
    """key, shot, first, last, mean of the frames with decisions: a shot comes out when the next one begins. A row without a decision, behind the last frame, finishes a stream."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shot, first, last, n, total = state.get if state.exists else (0, -1, -1, 0, 0.0)
        rows = []
        pdf = pd.concat(list(parts)).sort_values(order)
        for at, c, v in zip(pdf[order], pdf[cut], pdf[value]):
            if n and (pd.isna(c) or c):
                rows.append((key[0], shot, first, last, total / n))
                shot, n, total = shot + 1, 0, 0.0
            if pd.isna(c):
                shot, first, last, n, total = 0, -1, -1, 0, 0.0
                continue
            first, last, n, total = int(at) if not n else first, int(at), n + 1, total + float(v)
        if n:
            state.update((shot, first, last, n, total))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "shot", "first", "last", "mean"])

    return frames.groupBy(by).applyInPandasWithState(run, "key long, shot long, first long, last long, mean double", "shot long, first long, last long, n long, total double", "append", GroupStateTimeout.NoTimeout)


def windowed_census(events: DataFrame, ts: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: counts in tumbling windows, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
