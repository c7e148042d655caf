"""A quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled covariance and then towards a multiple of the identity.
A text's score is the logistic function of the difference of the two log densities (Mahalanobis distances by
the Cholesky factors, which are computed once at fitting) plus the log of the class sizes, scaled by `temper`.

Sums for the fit run over all labelled rows of the training folds; only the sums, (1 + d + d * d) numbers a class, reach the driver.

Edge cases: a null text counts as empty, and an empty one has a score like any other; null labels and labels without a document
are left out; a document with several labels is used once for each; with fewer than two classes the score is the share
of class 1, or 0.5 without any label; other columns pass through.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import batches, categories, codes, give_up, release, slices, span_hashes
from .crossparse import fold
from .storage import written

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "sentence_marks", "other_marks", "marked_words", "bar_words", "newline", "distinct_words", "short_words",
)
#: Marks of ordinary prose. Everything else that is neither letter, number nor white space is an other mark.
PROSE = ".,;:'\"?()-"


@lru_cache(1)
def _classes() -> np.ndarray:
    table = categories().copy()
    table[[ord(c) for c in PROSE]] = 4
    for cp in range(0x110000):
        if table[cp] == 1 and chr(cp).isupper():
            table[cp] = 5
    table[10] = 6
    return table


def statistics(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    cp, starts = codes(texts)
    n = len(texts)
    kind = classes[cp]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(starts))
    by = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7).astype(float)
    chars = np.maximum(np.diff(starts), 1).astype(float)
    solid = (kind != 3) & (kind != 6)
    edge = np.ones(len(cp) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[starts] = True
    cuts = np.flatnonzero(edge)
    first, last = cuts[:-1], cuts[1:]
    held = solid[first] if len(cp) else np.zeros(0, bool)
    first, last = first[held], last[held]
    word_of = owner[first]
    words = np.bincount(word_of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = np.bincount(word_of, last - first, minlength=n) / some
    marked = np.bincount(word_of, kind[last - 1] == 0, minlength=n) / some if len(first) else np.zeros(n)
    bars = np.bincount(word_of, (last - first == 1) & (kind[first] == 0), minlength=n) / some if len(first) else np.zeros(n)
    short = np.bincount(word_of, last - first <= 3, minlength=n) / some if len(first) else np.zeros(n)
    if len(first):
        h, _ = span_hashes(cp, first, last)
        order = np.lexsort((h, word_of))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
        distinct = np.bincount(word_of[order][new], minlength=n) / some
    else:
        distinct = np.zeros(n)
    letters = np.maximum(by[:, 1] + by[:, 5], 1)
    part = lambda x: np.log(x + 0.002)
    return np.stack([
        np.log1p(np.diff(starts)), np.log1p(words), np.log1p(length), part(by[:, 5] / letters), part(by[:, 2] / chars), part(by[:, 4] / chars), part(by[:, 0] / chars),
        part(marked), part(bars), part(by[:, 6] / chars), distinct, short,
    ], 1)


class Model:
    """Class means, Cholesky factors of the inverse covariances, log determinants and sizes."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float = 0.5, ridge: float = 0.02, temper: float = 0.5):
        d, self.temper, self.classes, self.share = len(FEATURES), temper, [], 0.5
        counts = {k: v[0] for k, v in sums.items() if v[0] > 0}
        if counts:
            self.share = counts.get(1, 0.0) / sum(counts.values())
        if set(counts) != {0, 1}:
            return
        scatter, means = {}, {}
        for k, v in sums.items():
            means[k] = v[1 : 1 + d] / v[0]
            scatter[k] = v[1 + d :].reshape(d, d) - v[0] * np.outer(means[k], means[k])
        pooled = sum(scatter.values()) / sum(counts.values())
        for k in (0, 1):
            own = scatter[k] / counts[k]
            cov = (1 - shrink) * own + shrink * pooled
            cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-6) * np.eye(d)
            low = np.linalg.cholesky(cov)
            self.classes.append((means[k], np.linalg.inv(low), float(np.log(np.diag(low)).sum()), float(np.log(counts[k]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        logs = [size - half_det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half_det, size in self.classes]
        return 1 / (1 + np.exp(-np.clip(self.temper * (logs[1] - logs[0]), -500, 500)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column _x, the statistics of the text, instead of the text."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.expr("cast(null as array<double>)").alias("_x")).schema

    def run(parts):
        give_up()
        classes = _classes()
        for batch in parts:
            texts = batches(batch.column(text))
            rows = [statistics(texts[a:b], classes) for a, b in slices(texts)]
            flat = np.concatenate(rows).reshape(-1) if rows else np.zeros(0)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), x], [*kept, "_x"])
        release()

    return docs.mapInArrow(run, schema)


def fit(features: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", **shape) -> Model:
    """features: doc_id and _x. Only rows outside the held-out fold are learnt from."""
    known = labels.where(F.col(quality).isin(0, 1)).select(F.col(doc_id).alias("_label_id"), F.col(quality).cast("int").alias("_label"))
    rows = features.where(fold(F.col(doc_id)) != 2).join(known, F.col(doc_id) == F.col("_label_id")).select("_label", "_x")

    def run(parts):
        total = {}
        for batch in parts:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(-1, len(FEATURES))
            y = np.array(batch.column("_label").to_pylist())
            for k in (0, 1):
                own = x[y == k]
                total[k] = total.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["k", "i", "v"])

    sums: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.k, np.zeros(1 + len(FEATURES) + len(FEATURES) ** 2))[r.i] = r.v
    return Model(sums, **shape)


def scored(features: DataFrame, model: Model) -> DataFrame:
    """features with _score for _x."""
    kept = [c for c in features.columns if c != "_x"]
    schema = features.select(*kept, F.lit(0.0).alias("_score")).schema

    def run(parts):
        for batch in parts:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(x))], [*kept, "_score"])

    return features.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **shape) -> DataFrame:
    """doc_id and _score of every row of docs."""
    features = written(measured(docs.select(doc_id, text), text), "statistics")
    return scored(features, fit(features, labels, doc_id, **shape))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, text: str = "text", doc_id: str = "doc_id", **shape) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns. The statistics are taken anew beside the text, which is not shuffled."""
    model = fit(measured(docs.select(doc_id, text), text), labels, doc_id, **shape)
    shared = docs.schema

    def run(parts):
        give_up()
        classes = _classes()
        for batch in parts:
            texts = batches(batch.column(text))
            score = np.concatenate([np.zeros(0), *(model.score(statistics(texts[a:b], classes)) for a, b in slices(texts))])
            yield batch.filter(pa.array(score >= least))
        release()

    return docs.mapInArrow(run, shared)
