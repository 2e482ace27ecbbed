"""Substring deduplication by seed and extend.

Seeds are winnowed k-word anchors: of every ``window`` consecutive words at least one anchor is taken, by
its hash alone, so two documents that share a window share one of its anchors. Documents are joined on
anchors. Each seed is extended both ways as far as a window can reach; documents with the same extension
form a class, whose members need no comparison with each other: all but the class's smallest document lose
the extent. Only the smallest document of each class is extended against the anchor's other classes, by the
hashes of the windows around the anchor. The maximal repeats found (runs of repeated windows) are removed.
Copies are thus never expanded into pairs, and every window of every document is judged.

Words and windows are compared by 64-bit hashes of their words, an anchor and its window by two
independent ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.stage import free_name, stage
from shelfwise.llm.text import Runs, Words, arrow_rows, mixed, slices, tidied, words

WINDOW_WORDS = 50
SEED_WORDS = 20

_SALT = np.uint64(0xA24BAED4963EE407)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, by doubling."""
    low, span = values, 1
    while 2 * span <= width:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return np.minimum(low[: len(values) - width + 1], low[width - span : len(low)]) if span < width else low


def anchors(found: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words (in the slice) and hashes of the winnowed k-word anchors of every text of ``window`` or more words.

    Every ``window`` consecutive words hold an anchor whose hash is the least of their k-word hashes. Of equal
    hashes close to each other only as many stay as that takes.
    """
    width = window - k + 1
    counts = np.diff(found.bounds)
    n = len(found.hashes)
    if n < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(n - k + 1)
    grams = Runs(mixed(found.hashes ^ _SALT)).hash(at, at + k)
    least = _window_minimum(grams, width)
    # windows within one text: its first word plus window words do not pass the text's end
    text_end = np.repeat(found.bounds[1:], counts)
    inside = np.arange(len(least)) + window <= text_end[: len(least)]
    # a gram is taken where it equals the least of some window that holds it
    none = np.zeros(0, dtype=np.int64)
    top = np.iinfo(np.uint64).max
    # largest of the window minima over the windows that hold gram i (0 where there is none)
    held = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), held, np.zeros(width - 1, np.uint64)])
    best = top - _window_minimum(top - padded, width)
    taken = np.flatnonzero((grams == best[: len(grams)]) & (best[: len(grams)] > 0))
    if not len(taken):
        return none, np.zeros(0, dtype=np.uint64)
    hashes = grams[taken]
    order = np.lexsort((taken, hashes))
    p, g = taken[order], hashes[order]
    text = np.searchsorted(found.bounds, p, side="right")
    same = (g[1:] == g[:-1]) & (text[1:] == text[:-1]) & (p[1:] - p[:-1] < width)
    if same.any():
        keep = np.ones(len(p), dtype=bool)
        last = None
        for i in np.flatnonzero(np.concatenate([[False], same]) & np.concatenate([same, [False]])):
            # i has an equal before and behind it; it goes if no window fits between the one kept last and the next
            before = p[i - 1] if keep[i - 1] else last
            if p[i + 1] - before <= width:
                keep[i], last = False, before
        taken = np.sort(p[keep])
        hashes = grams[taken]
    return taken, hashes


_SEED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()), ("anchor", pa.int64()), ("extent", pa.int64())]
)


def _text_rows(batch: pa.RecordBatch):
    ids = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(0))
    for first, end, data, offsets in slices(batch.column("text")):
        found = words(data, offsets)
        runs = Runs(found.hashes)
        texts = runs.hash(found.bounds[:-1], found.bounds[1:]).view(np.int64)
        yield ids[first:end], found, runs, texts, data, offsets


def seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Every anchor with the hash of its extension both ways (as far as the text goes)."""
    reach = window - k

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, found, runs, texts, _, _ in _text_rows(batch):
                at, hashes = anchors(found, window, k)
                text = np.searchsorted(found.bounds, at, side="right") - 1
                left = np.maximum(at - reach, found.bounds[text])
                right = np.minimum(at + window, found.bounds[text + 1])
                extent = mixed(runs.hash(left, right) + (at - left).astype(np.uint64))
                yield arrow_rows(
                    _SEED_SCHEMA,
                    doc_id=ids[text],
                    text_hash=texts[text],
                    place=(at - found.bounds[text]).astype(np.int32),
                    anchor=hashes.view(np.int64),
                    extent=extent.view(np.int64),
                )

    return (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", "text")
        .mapInArrow(run, "doc_id long, text_hash long, place int, anchor long, extent long")
    )


_WINDOW_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()), ("anchor", pa.int64()), ("words", pa.int64())]
)


def extended(docs: DataFrame, wanted: DataFrame, window: int, k: int) -> DataFrame:
    """All windows around the wanted seeds (doc_id, text_hash, seeds: place and anchor)."""
    reach = window - k

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, row = batch.column("seeds"), 0
            for ids, found, runs, texts, _, _ in _text_rows(batch):
                for i in range(len(ids)):
                    held = asked[row].values
                    row += 1
                    if texts[i] != batch.column("text_hash")[row - 1].as_py():
                        continue
                    at = np.asarray(held.field("place")).astype(np.int64)
                    anchor = np.asarray(held.field("anchor"))
                    n = int(found.bounds[i + 1] - found.bounds[i])
                    start = (at[:, None] + np.arange(-reach, 1)[None, :]).ravel()
                    anchor = np.repeat(anchor, reach + 1)
                    fits = (start >= 0) & (start + window <= n)
                    start, anchor = start[fits], anchor[fits]
                    hashes = runs.hash(start + found.bounds[i], start + found.bounds[i] + window)
                    yield arrow_rows(
                        _WINDOW_SCHEMA,
                        doc_id=np.full(len(start), ids[i]),
                        text_hash=np.full(len(start), texts[i]),
                        place=start.astype(np.int32),
                        anchor=anchor,
                        words=hashes.view(np.int64),
                    )

    asked = docs.select("doc_id", "text").join(wanted, "doc_id")
    return asked.select("doc_id", "text", "text_hash", "seeds").mapInArrow(
        run, "doc_id long, text_hash long, place int, anchor long, words long"
    )


def repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = SEED_WORDS) -> DataFrame:
    """doc_id, text_hash, first, last: runs of words that lie in windows which also start in a document with a smaller doc_id.

    Runs may overlap; first and last count words of the text from 0, last excluded. Rows with a null doc_id have
    no order and are left alone; rows repeated under one doc_id do not judge each other.
    """
    reach = window - k
    every = stage(seeds(docs, window, k), "seeds")
    joined = every.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = stage(every.join(joined.select("anchor"), "anchor", "left_semi"), "shared-seeds")
    classes = shared.groupBy("anchor", "extent").agg(F.min("doc_id").alias("least"))
    classes = stage(classes, "classes")
    contested = (
        classes.groupBy("anchor").agg(F.min("extent").alias("a"), F.max("extent").alias("b")).where("a <> b").select("anchor")
    )
    placed = stage(shared.join(classes, ["anchor", "extent"]), "placed-seeds")
    # all but a class's smallest document: every window that holds the seed starts in a smaller one
    whole = placed.where("doc_id > least").select(
        "doc_id",
        "text_hash",
        F.greatest(F.lit(0), F.col("place") - reach).alias("first"),
        (F.col("place") + window).alias("last"),
    )
    wanted = (
        placed.where("doc_id = least")
        .join(contested, "anchor", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("place", "anchor")).alias("seeds"))  # of one document
    )
    windows = stage(extended(docs, wanted, window, k), "windows")
    first_in = windows.groupBy("anchor", "words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    single = (
        windows.join(first_in.where("least < most").select("anchor", "words", "least"), ["anchor", "words"])
        .where("doc_id > least")
        .select("doc_id", "text_hash", F.col("place").alias("first"), (F.col("place") + window).alias("last"))
    )
    return whole.union(single)


_KEPT_SCHEMA = pa.schema(
    [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
)


def _without(text: bytes, spans: list | None) -> tuple[int, int, str, bytes]:
    """Number of words, of removed ones, hash of the kept words, and the text without the removed words."""
    held = text.split()
    if not spans:
        return len(held), 0, hashlib.sha256(b" ".join(held)).hexdigest(), text
    gone = np.zeros(len(held) + 1, dtype=np.int64)
    for first, last in spans:
        gone[min(first, len(held))] += 1
        gone[min(last, len(held))] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    data = np.frombuffer(text, dtype=np.uint8)
    found = words(data, np.array([0, len(data)]))
    # a removed word goes with the white space behind it
    edges = np.concatenate([found.starts, [len(data)]])
    parts = [text[: edges[0]]]
    turn = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    for a, b in zip(turn[::2], turn[1::2]):
        parts.append(text[edges[a] : edges[b]])
    kept = [w for w, x in zip(held, gone.tolist()) if not x]
    return len(held), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), b"".join(parts)


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = SEED_WORDS) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, kept_sha256 and kept (the text without the removed words).

    A null text has no words and stays null in ``kept``; an empty text stays empty. Repeated rows of one id and text lose
    the same words. Columns of the new names are replaced, all others pass unchanged.
    """
    docs = docs.drop(*_KEPT_SCHEMA.names)
    own_spans = free_name("spans", docs.columns)
    spans = (
        repeats(docs, window, k)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("first", "last")).alias("spans"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("text_hash", "spans")).alias(own_spans))
    )
    columns = docs.columns
    out_fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            asked = batch.column(own_spans)
            texts = batch.column(columns.index("text")).cast(pa.binary())
            for i in range(batch.num_rows):
                text, spans = texts[i].as_py(), asked[i].as_py()
                if spans:
                    data = np.frombuffer(text, dtype=np.uint8) if text else np.zeros(0, np.uint8)
                    found = words(data, np.array([0, len(data)]))
                    own = int(Runs(found.hashes).hash(found.bounds[:-1], found.bounds[1:]).view(np.int64)[0])
                    spans = [(s["first"], s["last"]) for x in spans if x["text_hash"] == own for s in x["spans"]]
                made.append((*_without(text or b"", spans),) if text is not None else (0, 0, _EMPTY, None))
            fields = batch.columns[: len(columns)] + [
                pa.array([m[0] for m in made], pa.int64()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([m[2] for m in made], pa.string()),
                pa.array([m[3] for m in made], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(fields, names=[*columns, *_KEPT_SCHEMA.names])

    return (
        docs.join(spans, "doc_id", "left")
        .select(*[F.col(f"`{c}`") for c in columns], F.col(own_spans))
        .mapInArrow(run, ", ".join(out_fields) + ", n_words long, n_removed long, kept_sha256 string, kept string")
    )


_EMPTY = hashlib.sha256(b"").hexdigest()


def op6(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents without their repeated passages; a document of which nothing is left goes, the rest keep their spacing.

    Of the other columns only n_chars changes, and only where words went.
    """
    # the columns pass under numbers, so that none clashes with the operator's own
    plain = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"c{i}") for i, c in enumerate(docs.columns)])
    found = remove_repeats(plain).where("n_removed = 0 or n_removed < n_words")
    out = []
    for i, c in enumerate(docs.columns):
        own = F.col(c if c in ("doc_id", "text") else f"c{i}")
        if c == "text":
            own = F.col("kept")
        elif c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)
