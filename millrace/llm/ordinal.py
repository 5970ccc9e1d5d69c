"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s), s the sum of one weight for each distinct hashed feature
of the text: lower-cased words, their shapes (letters and digits folded), and how often words repeat.
All grades share the weights; thresholds are ordered by construction. The model gives the expected
grade and the tail probability P(grade >= `top`) for selection.

Fitting uses labelled rows of at most `max_rows` documents (a documented bound, drawn by a hash of
the id), whose hashed features alone come to the driver; features of fewer than `min_docs`
of them, or than the share `min_share`, keep weight zero. Scoring reads every whole text and shuffles nothing.

Null and empty texts have the features of no word; very long ones count whole. Null grades and labels
of absent documents do not count; of several labels of one id the lowest counts; documents that share
an id share its grade. An empty table gives no scores, no labels a model of weights zero. Other columns
of docs, whatever their names, are not read. With fewer than two grades in the labels
the weights are zero and the thresholds follow the shares.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 18
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
_MARKS = ".,;:!?()[]{}\"'#*$%&|<>"


def _feature_ids(words: list[str], cache: dict[str, tuple[int, int]]) -> tuple[int, ...]:
    from xxhash import xxh3_64_intdigest

    mask = (1 << BITS) - 1
    out: set[int] = set()
    for w in set(words):
        ids = cache.get(w)
        if ids is None:
            shape = _DIGITS.sub("0", _LETTERS.sub("a", w))
            ids = cache[w] = (xxh3_64_intdigest("w" + w.strip(_MARKS)) & mask, xxh3_64_intdigest("s" + shape) & mask)
        out.update(ids)
    n = len(words)
    again = int(8 * (1 - len(set(words)) / n)) if n else 9
    out.add(xxh3_64_intdigest(f"r{again}:{min(12, n.bit_length())}") & mask)
    return tuple(out)


def features(text: str | None, cache: dict[str, tuple[int, int]]) -> tuple[int, ...]:
    if len(cache) > 400_000:
        cache.clear()
    return _feature_ids((text or "").lower().split(), cache)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) by row and grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 12, rate: float = 0.15, l2: float = 3e-4, min_docs: int = 3, min_share: float = 0.002, seed: int = 5) -> Model:
    w = np.zeros(1 << BITS)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 0.5)[:-1] / (len(grades) + 0.5 * n_grades)
    first = np.log(share / (1 - share))
    if len(np.unique(grades)) < 2:
        return Model(w, first)
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    kept = np.bincount(flat, minlength=1 << BITS) >= max(min_docs, min_share * len(rows))
    ends = np.cumsum(lens)
    # thresholds as a start and positive steps, so that they stay in order
    a, steps = first[0], np.log(np.maximum(np.diff(first), 1e-3))
    acc, acc_t = np.full(1 << BITS, 1e-6), np.full(n_grades - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            idx = np.concatenate([flat[ends[i] - lens[i] : ends[i]] for i in part])
            row = np.repeat(np.arange(len(part)), lens[part])
            use = kept[idx]
            idx, row = idx[use], row[use]
            s = np.bincount(row, w[idx], len(part))
            t = a + np.concatenate(([0.0], np.cumsum(np.exp(steps))))
            below = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -40, 40)))
            slope = below * (1 - below)
            g, r = grades[part], np.arange(len(part))
            pad = np.concatenate([np.zeros((len(part), 1)), below, np.ones((len(part), 1))], axis=1)
            d = np.concatenate([np.zeros((len(part), 1)), slope, np.zeros((len(part), 1))], axis=1)
            p = np.maximum(pad[r, g + 1] - pad[r, g], 1e-9)
            grad_s = (d[r, g + 1] - d[r, g]) / p / len(part)  # of the loss by s
            grad_t = np.zeros(n_grades - 1)
            for k in range(n_grades - 1):
                grad_t[k] = (-(d[r, k + 1] * (g == k)) / p + (d[r, k + 1] * (g == k + 1)) / p).mean()
            touched, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, grad_s[row]) + l2 * w[touched]
            acc[touched] += grad**2
            w[touched] -= rate * grad / np.sqrt(acc[touched])
            by = np.concatenate(([grad_t.sum()], [grad_t[k + 1 :].sum() * np.exp(steps[k]) for k in range(n_grades - 2)]))
            acc_t += by**2
            move = rate * by / np.sqrt(acc_t)
            a, steps = a - move[0], steps - move[1:]
    return Model(w, a + np.concatenate(([0.0], np.cumsum(np.exp(steps)))))


def _features_of(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], "f array<int>").schema:
        out = out.add(f)
    arrow = to_arrow_schema(out)

    def run(batches):
        cache: dict = {}
        for batch in batches:
            rows = [features(t, cache) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, list(arrow)[-1].type)], schema=arrow)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, text: str = "text", doc_id: str = "doc_id", max_rows: int = 12_000, **options) -> Model:
    """grades(doc_id, grade): grade 0 (worst) to n_grades - 1."""
    labelled = grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    n = labelled.count()
    if n > max_rows:
        # a filter on the hash first, a little wide, so that few rows are sorted, however many labels there are
        drawn = F.xxhash64(F.lit(3), F.col("_id"))
        labelled = labelled.where(F.shiftrightunsigned(drawn, 2) < min((1 << 62) - 1, (1 << 62) * 2 * max_rows // n)).orderBy(drawn, "_id").limit(max_rows)
    # at most max_rows rows of two numbers
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(labelled), F.col("_doc") == F.col("_id")).select("grade", "text")
    got = _features_of(chosen, "text", ("grade",)).toArrow()
    rows = [np.asarray(x.values, np.int64) for x in got.column("f")]
    y = got.column("grade").to_numpy().astype(np.int64)
    if not len(y):
        return Model(np.zeros(1 << BITS), np.linspace(-1, 1, n_grades - 1))
    return fit_rows(rows, y, n_grades, **options)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), top: int | None = None, least: float = 0.5) -> DataFrame:
    """Columns `keep` with expected_grade, tail_probability (of grade `top` or better) and kept (at
    least `least` of it)."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    top = len(model.thresholds) if top is None else top
    out = docs.select(*keep).schema.add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")
    arrow = to_arrow_schema(out)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 1 MB, whatever the input

    def run(batches):
        m, cache = Model(*sent.value), {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            s = np.array([m.weights[list(features(t, cache))].sum(dtype=np.float64) for t in texts])
            p = m.probabilities(s)
            tail = p[:, top:].sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= least)], schema=arrow)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)
