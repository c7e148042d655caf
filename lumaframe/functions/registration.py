"""Kernels under names of their own for SQL: Arrow functions over whole batches, and a table function that splits a byte stream into its units."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..tables import ship


def _rows(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in x]) if len(x) else np.zeros((0, 1), np.int64)


def _hadamard(n: int) -> np.ndarray:
    return np.array([[-1 if bin(i & j).count("1") % 2 else 1 for j in range(n)] for i in range(n)])


def _sad(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.abs(_rows(a) - _rows(b)).sum(1))


def _satd(a: pd.Series, b: pd.Series) -> pd.Series:
    d = _rows(a) - _rows(b)
    side = int(round(d.shape[1] ** 0.5))
    tiles = d.reshape(-1, side // 4, 4, side // 4, 4).swapaxes(2, 3)
    h = _hadamard(4)
    return pd.Series(np.abs(h @ tiles @ h.T).sum((1, 2, 3, 4)))


def _robust(v: pd.Series) -> float:
    return float(1.4826 * np.median(np.abs(v - np.median(v))))


class Units:
    """split_nals(bytes): seq, type, size of each unit of a stream, the start codes between them left out."""

    def eval(self, data: bytes):
        from ..sources.annexb import split

        for i, (_, body, end) in enumerate(split(bytes(data))):
            yield i, data[body] & 31, end - body


def register(spark: SparkSession) -> None:
    """luma_sad and luma_satd of two blocks (square, a multiple of 4 wide), robust_sigma of a group, and the table function split_nals."""
    ship(spark)  # first: a registered function keeps the list of files of that moment
    spark.udf.register("luma_sad", F.pandas_udf(_sad, "long"))
    spark.udf.register("luma_satd", F.pandas_udf(_satd, "long"))
    spark.udf.register("robust_sigma", F.pandas_udf(_robust, "double"))
    spark.udtf.register("split_nals", F.udtf(Units, returnType="seq int, type int, size int"))
