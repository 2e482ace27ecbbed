"""Toxic passages by maximum-scoring segment search, calibrated as extreme values.

Words score their log-odds between toxic and other training documents under a Dirichlet prior proportional to the
term's frequency in both; words without evidence of their own take that of their leading bytes. All other words cost
a little. A linear scan finds every maximal segment of positive sum. Under chance the best sum of a text of n words
follows an extreme-value law; its two constants are fitted on the other training documents, which makes segments
comparable whatever the text's length. A document's segments are aggregated by the sum statistic of that law, and the
result becomes a probability by a two-constant logistic fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.labelled import fold, training_rows
from shelfwise.llm.text import ALNUM, Words, mixed, run_hashes, slices, words

MAX_TRAINING_DOCS = 20_000
MAX_TERMS = 200_000
#: terms: whole words, and leading bytes of this number
LEADING = (None, 7, 5)
PRIOR = 0.1
LEAST_Z = 3.0
STEP = 0.1
SIGNIFICANT = 0.01
FOLDS, HELD = 5, 0


def terms(found: Words, data: np.ndarray) -> list[np.ndarray]:
    """Hashes of every word's term at each level, most specific first; a word shorter than a level's bytes has 0 there."""
    out = []
    for level, n in enumerate(LEADING):
        if n is None:
            held = found.hashes
        else:
            ends = np.minimum(found.ends, found.starts + n)
            mask = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(mask, found.starts, 1)
            np.add.at(mask, ends, -1)
            inside = np.cumsum(mask[:-1]) > 0
            held = run_hashes(data, inside, found.starts, ends, lower=True)
        value = mixed(held ^ np.uint64(level + 1))
        if n is not None:
            value = np.where(found.ends - found.starts > n, value, np.uint64(0))
        out.append(value)
    return out


@dataclass
class Model:
    keys: np.ndarray  #: sorted term hashes
    scores: np.ndarray
    rate: float = 1.0  #: decay of the extreme-value law
    scale: float = 0.1  #: its factor per word
    intercept: float = -2.0
    slope: float = 1.0

    def word_scores(self, found: Words, data: np.ndarray) -> np.ndarray:
        out = np.full(len(found.hashes), -STEP)
        open_ = np.ones(len(out), dtype=bool)
        if not len(self.keys):
            return out
        for value in terms(found, data):
            place = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            known = open_ & (self.keys[place] == value)
            out[known] = self.scores[place[known]]
            open_ &= ~known
        return np.where(out < -STEP, -STEP, out)

    def evidence(self, sums: list[float], n: int) -> float:
        """-ln of the probability that chance gives a text of n words segments like the best r of these, at the best r."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            total += self.rate * s - math.log(max(self.scale * n, 1e-9))
            if total <= 0:
                break
            chance = total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, chance)
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -35, 35)))


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, sum) of all maximal segments of positive sum, last included, in time linear in the values.

    Only places of positive values can begin or end one; the run of others between two is one sum.
    """
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(values)])
    # kept segments: first, last, sum before it, sum through it; back: the nearest earlier one with a smaller sum before
    kept: list[tuple[int, int, float, float]] = []
    back: list[int] = []
    for i in at.tolist():
        first, last, low, high = i, i, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = back[j]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, last, low, high))
                back.append(j)
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:], back[j:]
    return [(first, last, high - low) for first, last, low, high in kept]


def _counted(rows: DataFrame) -> DataFrame:
    """term, and the number of training documents of each label that hold it."""
    schema = pa.schema([("term", pa.int64()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column("y").cast(pa.int32()))
            for first, end, data, offsets in slices(batch.column("text"), 1 << 19):
                found = words(data, offsets, ALNUM, lower=True)
                doc = found.doc()
                for value in terms(found, data):
                    held = value != 0
                    pair = np.unique(np.stack([value[held], doc[held].astype(np.uint64)]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[0].view(np.int64)), pa.array(y[first:end][pair[1].astype(np.int64)])], schema=schema
                    )

    return (
        rows.mapInArrow(run, "term long, y int")
        .groupBy("term")
        .agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    )


def _segments_of(rows: DataFrame, model: Model) -> list[tuple[int, int, list[float]]]:
    """(y, words, sums of the segments) of each training document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, sums = [], []
            for _, _, data, offsets in slices(batch.column("text")):
                found = words(data, offsets, ALNUM, lower=True)
                values = model.word_scores(found, data)
                for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                    number.append(int(b - a))
                    sums.append([s for _, _, s in maximal_segments(values[a:b])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").cast(pa.int32()), pa.array(number, pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
                names=["y", "n", "sums"],
            )

    held = rows.mapInArrow(run, "y int, n long, sums array<double>").collect()
    return [(r.y, r.n, r.sums) for r in held]


def _law(model: Model, clean: list[tuple[int, list[float]]]) -> tuple[float, float]:
    """Decay and factor of the extreme-value law, from the best segments of texts without the label."""
    # the decay: the positive root of mean exp(rate * word score) = 1, words scoring the typical term or the step
    typical = float(np.median(model.scores[model.scores > 0])) if (model.scores > 0).any() else 1.0
    n = sum(x for x, _ in clean) or 1
    share = min(max(sum(len(s) for _, s in clean), 1) / n, 0.01)
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        value = share * math.exp(min(mid * typical, 700)) + (1 - share) * math.exp(-mid * STEP) - 1
        low, high = (mid, high) if value < 0 else (low, mid)
    rate = low
    # the factor: as many texts with a segment as were seen
    least = min((s for _, held in clean for s in held), default=typical)
    seen = max(sum(bool(s) for _, s in clean), 1)
    return rate, min(max(seen / (n * math.exp(-rate * least)), 1e-6), 1e6)


def train(rows: DataFrame) -> Model:
    """Fit on doc_id, text, y; without rows, or with one label only, no word scores and every text gets the same low score."""
    totals = rows.agg(F.sum("y"), F.count("*")).head()
    toxic, n = int(totals[0] or 0), int(totals[1])
    if not toxic or toxic == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), intercept=-4.0 if not toxic else 4.0)
    a, b = F.col("toxic") + PRIOR * F.col("n"), F.col("n") - F.col("toxic") + PRIOR * F.col("n")
    odds = F.log(a / (toxic + PRIOR * n)) - F.log(b / (n - toxic + PRIOR * n))
    chosen = (
        _counted(rows)
        .withColumn("odds", odds)
        .withColumn("z", F.abs("odds") / F.sqrt(1 / a + 1 / b))
        .where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "term")
        .limit(MAX_TERMS)
        .select("term", "odds")
        .toArrow()
    )
    keys = np.asarray(chosen.column(0).combine_chunks()).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], np.asarray(chosen.column(1).combine_chunks())[order])
    held = _segments_of(rows, model)
    model.rate, model.scale = _law(model, [(m, s) for y, m, s in held if not y])
    x = np.log1p([model.evidence(s, m) for _, m, s in held])
    y = np.array([float(r[0]) for r in held])
    w = np.array([0.0, 1.0])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -35, 35)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum()]) + 1e-2 * w
        q = p * (1 - p)
        h = np.array([[q.sum(), (q * x).sum()], [(q * x).sum(), (q * x * x).sum()]]) + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    model.intercept, model.slope = float(w[0]), float(w[1])
    return model


_PASSAGE = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``toxicity`` (0 to 1) and ``passages``: the segments that chance gives a text of its length
    with less than ``SIGNIFICANT``, as first and last word (from 0) and sum. Null and empty texts have none and score lowest.
    Columns of the new names are replaced."""
    docs = docs.drop("toxicity", "passages")
    names, text = docs.columns, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            evidence, passages = [], []
            for _, _, data, offsets in slices(batch.column(text)):
                found = words(data, offsets, ALNUM, lower=True)
                values = held.word_scores(found, data)
                for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
                    segments = maximal_segments(values[a:b])
                    evidence.append(held.evidence([s for *_, s in segments], b - a))
                    passages.append(
                        [
                            {"first": f, "last": l, "score": s}
                            for f, l, s in segments
                            if held.scale * (b - a) * math.exp(-held.rate * s) < SIGNIFICANT
                        ]
                    )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(held.probability(np.array(evidence)), pa.float64()), pa.array(passages, pa.list_(_PASSAGE))],
                names=[*names, "toxicity", "passages"],
            )

    return docs.mapInArrow(run, schema + ", toxicity double, passages array<struct<first: bigint, last: bigint, score: double>>")


def model(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold."""
    return train(training_rows(docs, labels, "toxic", FOLDS, HELD, most))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), model(docs, labels))
    return scored.select(
        "doc_id",
        (fold(FOLDS) == HELD).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
