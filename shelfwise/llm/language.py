"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of a fixed number of bytes (the last one padded); all of them count. Bytes are embedded,
filters of several widths run over the window, each filter's largest value is kept, and a softmax over the learnt
languages follows. A document's languages are scored by the mean log-probability of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.labelled import fold
from shelfwise.llm.stage import free_name
from shelfwise.llm.text import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: training documents of each language (about), windows of each of them, and languages learnt at most
DOCS_PER_LANGUAGE = 1000
WINDOWS_PER_DOC = 4
MAX_LANGUAGES = 256
FOLDS, HELD = 4, 2
UNKNOWN = "und"
_BLOCK = 256


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts (padded with zero bytes), each text's bounds in them, and their lengths."""
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(number)])
    text = np.repeat(np.arange(len(sizes)), number)
    start = offsets[:-1][text] + (np.arange(bounds[-1]) - bounds[:-1][text]) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][text] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    held = padded[start[:, None] + np.arange(WINDOW)[None, :]]
    held[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
    return held, bounds, length


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.5, (256, EMBEDDING))}
        for k in WIDTHS:
            w[f"filter{k}"] = rng.normal(0, (2 / (k * EMBEDDING)) ** 0.5, (k * EMBEDDING, FILTERS))
            w[f"bias{k}"] = np.zeros(FILTERS)
        w["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        w["shift"] = np.zeros(len(languages))
        return Network(languages, {n: a.astype(np.float32) for n, a in w.items()})

    def _patches(self, embedded: np.ndarray, k: int) -> np.ndarray:
        n, places = len(embedded), WINDOW - k + 1
        flat = np.lib.stride_tricks.as_strided(
            embedded, (n, places, k * EMBEDDING), (embedded.strides[0], embedded.strides[1], embedded.strides[2])
        )
        return flat.reshape(n * places, k * EMBEDDING)

    def forward(self, held: np.ndarray, keep: bool = False):
        """Log-probabilities of windows; with ``keep`` also what the backward pass needs."""
        w = self.weights
        embedded = np.ascontiguousarray(w["embed"][held])
        pooled, kept = [], []
        for k in WIDTHS:
            patches = self._patches(embedded, k)
            value = (patches @ w[f"filter{k}"]).reshape(len(held), WINDOW - k + 1, FILTERS)
            if keep:
                at = value.argmax(axis=1)
                kept.append((patches, at))
            pooled.append(value.max(axis=1) + w[f"bias{k}"])
        pooled = np.concatenate(pooled, axis=1)
        active = np.maximum(pooled, 0)
        logits = active @ w["out"] + w["shift"]
        logits -= logits.max(axis=1, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return (logp, pooled, active, kept) if keep else logp

    def gradient(self, held: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(held)
        logp, pooled, active, kept = self.forward(held, keep=True)
        d = np.exp(logp)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": active.T @ d, "shift": d.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        back = (d @ w["out"].T) * (pooled > 0)
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            patches, at = kept[i]
            g[f"bias{k}"] = part.sum(axis=0)
            row = np.arange(n)[:, None] * (WINDOW - k + 1) + at  # the patch each filter kept
            chosen = patches[row.ravel()].reshape(n, FILTERS, -1)
            g[f"filter{k}"] = np.einsum("nfd,nf->df", chosen, part, optimize=True)
            to_patch = part[:, :, None] * w[f"filter{k}"].T[None]
            taps = at[:, :, None] + np.arange(k)[None, None, :]
            bytes_ = held[np.arange(n)[:, None, None], taps]
            np.add.at(g["embed"], bytes_.ravel(), to_patch.reshape(-1, EMBEDDING))
        return g


def train(held: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 4e-3) -> Network:
    """Fit windows to language numbers by Adam with a falling rate; the order of the windows is drawn with a fixed seed."""
    net = Network.fresh(languages)
    rng = np.random.default_rng(5)
    first = {n: np.zeros_like(a) for n, a in net.weights.items()}
    second = {n: np.zeros_like(a) for n, a in net.weights.items()}
    step, total = 0, max(1, epochs * -(-len(held) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(held))
        for a in range(0, len(held), batch):
            at = order[a : a + batch]
            step += 1
            now = rate * (1 - step / (total + 1))
            for n, g in net.gradient(held[at], y[at]).items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                net.weights[n] = (
                    net.weights[n] - now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                ).astype(np.float32)
    return net


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and language numbers of a bounded sample: about ``DOCS_PER_LANGUAGE`` documents of each of the most frequent
    ``MAX_LANGUAGES`` languages outside the held-out fold, by hash of the id, and ``WINDOWS_PER_DOC`` windows spread over each."""
    open_ = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(FOLDS) != HELD)
    counts = open_.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.lang for r in counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    spark = docs.sparkSession
    share = spark.createDataFrame([(r.lang, min(1.0, DOCS_PER_LANGUAGE / r["count"])) for r in counts], "lang string, share double")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = open_.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(turn < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = pc.utf8_lower(batch.column("text").cast(pa.string()))
            for first, end, data, offsets in slices(lower):
                held, bounds, _ = windows(data, offsets)
                rows, langs, ids = [], [], []
                for i in range(end - first):
                    n = int(bounds[i + 1] - bounds[i])
                    for p in sorted(set(np.linspace(0, n - 1, WINDOWS_PER_DOC).round().astype(int).tolist())) if n else []:
                        rows.append(held[bounds[i] + p].tobytes())
                        langs.append(batch.column("lang")[first + i].as_py())
                        ids.append(batch.column("doc_id")[first + i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["doc_id", "lang", "w"]
                )

    made = sample.mapInArrow(run, "doc_id long, lang string, w binary").toPandas().sort_values(["doc_id", "w"])
    number = {l: i for i, l in enumerate(languages)}
    held = np.frombuffer(b"".join(made.w), dtype=np.uint8).reshape(-1, WINDOW)
    return held, made.lang.map(number).to_numpy(dtype=np.int64), languages


def model(docs: DataFrame) -> Network | None:
    held, y, languages = training_windows(docs)
    return train(held, y, languages) if len(held) else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred and lang_score (0 to 1); ``und`` and 0 where the text is null or has no letter.

    Without a model (nothing to learn from) every row is ``und``. Columns of the new names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    names, text = docs.columns, docs.columns.index("text")
    found, sure = free_name("best", names), free_name("share", names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {found} string, {sure} double"
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_net = sent.value
        for batch in batches:
            best, share = [], []
            for _, _, data, offsets in slices(pc.utf8_lower(batch.column(text).cast(pa.string())), 1 << 19):
                if held_net is None:
                    best += [UNKNOWN] * (len(offsets) - 1)
                    share += [0.0] * (len(offsets) - 1)
                    continue
                held, bounds, length = windows(data, offsets)
                logp = np.concatenate(
                    [held_net.forward(held[a : a + _BLOCK]) for a in range(0, len(held), _BLOCK)]
                    or [np.zeros((0, len(held_net.languages)), np.float32)]
                )
                sums = np.concatenate(
                    [np.zeros((1, logp.shape[1])), np.cumsum(logp.astype(np.float64) * length[:, None], axis=0)]
                )
                mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                at = p.argmax(axis=1)
                best += [held_net.languages[i] for i in at]
                share += p[np.arange(len(at)), at].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())], names=[*names, found, sure]
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.mapInArrow(run, schema).select(
        *[F.col(f"`{n}`") for n in names],
        F.when(lettered, F.col(found)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, F.col(sure)).otherwise(0.0).alias("lang_score"),
    )


def op3(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), model(docs))
    return found.select("doc_id", (fold(FOLDS) == HELD).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
