"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text is read as words and punctuation runs. Two streams give n-grams: the words themselves, and their forms
(case, length class, whether the word repeats the one before; punctuation as it is), so that shouting, decorated
words, tables and repetitions are recognised whatever the words are. Features are hashed into a table of fixed
size; a document's score is the sparse dot product of the table's weights with its n-gram frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.labelled import fold, training_rows
from shelfwise.llm.text import ALNUM, NOT_SPACE, Runs, mixed, run_hashes, slices, tidied, words

BITS = 18
#: (stream, words) of each view
VIEWS = (("word", 1), ("word", 2), ("form", 1), ("form", 2), ("form", 3))
MAX_TRAINING_DOCS = 6000
THRESHOLD = 0.3
FOLDS, HELD = 5, 0

_MARK = NOT_SPACE & ~ALNUM
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the feature of every n-gram of the texts, in order, and the texts' bounds."""
    plain = words(data, offsets, ALNUM, lower=True)
    marks = words(data, offsets, _MARK)
    starts = np.concatenate([plain.starts, marks.starts])
    order = np.argsort(starts, kind="stable")
    word = np.concatenate([plain.hashes, marks.hashes])[order]
    first, last, length = data[plain.starts], data[plain.ends - 1], plain.ends - plain.starts
    again = np.zeros(len(plain.hashes), dtype=bool)
    again[1:] = plain.hashes[1:] == plain.hashes[:-1]
    again[plain.bounds[:-1][plain.bounds[:-1] < len(again)]] = False  # not the word of the text before
    form = (
        _UPPER[first] + 2 * _UPPER[last] + 4 * (length > 1) + 8 * (length > 12) + 16 * _DIGIT[first] + 32 * again
    ).astype(np.uint64)
    form = np.concatenate([mixed(form + np.uint64(1)), marks.hashes])[order]
    bounds = np.searchsorted(starts[order], offsets)
    streams = {"word": word, "form": form}
    out = []
    for view, (stream, n) in enumerate(VIEWS):
        held = streams[stream]
        number = np.maximum(np.diff(bounds) - n + 1, 0)
        made = np.concatenate([[0], np.cumsum(number)])
        at = np.arange(made[-1]) - np.repeat(made[:-1] - bounds[:-1], number)
        value = held[at] if n == 1 else Runs(held).hash(at, at + n)
        out.append(((mixed(value ^ np.uint64(view + 1)) >> np.uint64(64 - BITS)).astype(np.int64), made))
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def dot(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's sparse dot product; the last weight is the constant."""
    total = np.full(len(offsets) - 1, float(weights[-1]))
    for feature, bounds in features(data, offsets):
        total += _sums(weights[feature], bounds) / np.maximum(np.diff(bounds), 1)
    return total


class Ftrl:
    """Follow the regularised leader, one example at a time; weights are a function of the two sums it keeps."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 0.05, l1: float = 1e-4, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def examples(rows: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, y, features, frequencies) of each training row, made by the tasks."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text"), 1 << 18):
                at, x = [[] for _ in range(end - first)], [[] for _ in range(end - first)]
                for feature, bounds in features(data, offsets):
                    for i in range(end - first):
                        f, c = np.unique(feature[bounds[i] : bounds[i + 1]], return_counts=True)
                        at[i].append(f)
                        x[i].append(c / max(1, bounds[i + 1] - bounds[i]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first).cast(pa.int64()),
                        batch.column("y").slice(first, end - first).cast(pa.int32()),
                        pa.array([np.concatenate(a).astype(np.int32) for a in at], pa.list_(pa.int32())),
                        pa.array([np.concatenate(a).astype(np.float32) for a in x], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "y", "at", "x"],
                )

    made = rows.mapInArrow(run, "doc_id long, y int, at array<int>, x array<float>").toArrow()
    columns = [made.column(c).combine_chunks() for c in range(4)]
    return [
        (columns[0][i].as_py(), columns[1][i].as_py(), np.asarray(columns[2][i].values), np.asarray(columns[3][i].values, dtype=np.float64))
        for i in range(made.num_rows)
    ]


def train(rows: DataFrame, passes: int = 3) -> np.ndarray:
    """Weights from doc_id, text, y. The rows are learnt in an order drawn from their ids; no rows give zero weights."""
    held = examples(rows)
    model = Ftrl((1 << BITS) + 1)
    rng = np.random.default_rng(7)
    held.sort(key=lambda r: r[0])
    for _ in range(passes):
        for i in rng.permutation(len(held)):
            _, y, at, x = held[i]
            at, where = np.unique(at, return_inverse=True)
            summed = np.bincount(where, x, minlength=len(at))
            model.learn(np.append(at, 1 << BITS), np.append(summed, 1.0), y)
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with ``quality_score`` (0 to 1); null texts score as empty. A column of that name is replaced."""
    docs = docs.drop("quality_score")
    names, text = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", quality_score double"
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [dot(sent.value, data, offsets) for _, _, data, offsets in slices(batch.column(text))]
            value = 1 / (1 + np.exp(-np.clip(np.concatenate(made), -35, 35))) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=[*names, "quality_score"])

    return docs.mapInArrow(run, schema)


def model(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCS) -> np.ndarray:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    return train(training_rows(docs, labels, "quality", FOLDS, HELD, most))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), model(docs, labels))
    return scored.select(
        "doc_id",
        (fold(FOLDS) == HELD).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents the classifier does not reject, unchanged."""
    numbered = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(docs.columns)])
    kept = score(numbered, model(docs, labels)).where(F.col("quality_score") >= THRESHOLD)
    return kept.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
