"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set. Within a partition each item is sketched by its
MinHash: its shingles of least hash, as many as the partition's size and the threshold ask for. A document that
contains at least the threshold's share of an item lacks at most ``size - ceil(threshold * size)`` of its
shingles, so with one more than that in the sketch it always holds one of them: the search loses no pair. A
document's candidates are the items with a sketch value among its shingles; they are verified by counting the
distinct shingles they really share, compared as words.

Items are the query set: they go to the tasks in blocks of bounded size, one pass over the documents a block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import ALNUM, LOWER, arrow_rows, shingles, slices, tidied, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: bytes of item text in one block; the only thing sent to every task
BLOCK_BYTES = 4 << 20

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]
)
_WORD_BYTES = bytes(i if ALNUM[i] else 0x20 for i in range(256))
_LOWER_WORDS = bytes(LOWER[list(_WORD_BYTES)].tolist())


def text_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and what is beyond ASCII, A-Z as a-z."""
    return [w for w in text.translate(_LOWER_WORDS).split(b" ") if w]


def shingle_set(held: list[bytes], k: int) -> set[bytes]:
    """Distinct k-word shingles; none if there are fewer words."""
    return {b" ".join(held[i : i + k]) for i in range(len(held) - k + 1)}


def needed(size: int, threshold: float) -> int:
    """Least number of shared shingles that reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


class ItemIndex:
    """Sketches of a block of items, partitioned by size: partition p holds sets of 2**p .. 2**(p+1)-1 shingles."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.items, self.sets, partitions = [], [], defaultdict(list)
        for item_id, text in items:
            held = shingle_set(text_words(text), k)
            if held:
                partitions[len(held).bit_length() - 1].append(len(self.items))
                self.items.append(item_id)
                self.sets.append(held)
        values, owners = [], []
        for p, members in partitions.items():
            # the widest sketch any size in the partition needs
            most = max(s - needed(s, threshold) + 1 for s in range(1 << p, 2 << p))
            for i in members:
                column = pa.array(sorted(self.sets[i]), pa.binary())
                data, offsets = next(((d, o) for _, _, d, o in slices(column, 1 << 40)))
                hashes, _ = shingles(words(data, offsets, ALNUM, lower=True), k)
                sketch = np.unique(hashes)[:most]
                values.append(sketch)
                owners.append(np.full(len(sketch), i))
        values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        self.first = np.zeros(1 << 16, dtype=bool)  # by leading bits: most shingles of most texts end here
        self.first[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in hashes, item) for every sketch value met."""
        at = np.flatnonzero(self.first[(hashes >> np.uint64(48)).astype(np.int64)])
        low = np.searchsorted(self.values, hashes[at], side="left")
        high = np.searchsorted(self.values, hashes[at], side="right")
        number = high - low
        where = np.repeat(at, number)
        place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number - low, number)
        return where, self.owners[place]


def _found(indexes: list[ItemIndex], texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its size, shared shingles) of every pair at or over the threshold."""
    for first, _, data, offsets in slices(texts):
        found = words(data, offsets, ALNUM, lower=True)
        for index in indexes:
            hashes, bounds = shingles(found, index.k)
            where, item = index.candidates(hashes)
            text = np.searchsorted(bounds, where, side="right") - 1
            held, held_of = set(), -1
            for t, i in sorted(set(zip(text.tolist(), item.tolist()))):
                if t != held_of:
                    held = shingle_set(text_words(data[offsets[t] : offsets[t + 1]].tobytes()), index.k)
                    held_of = t
                size, shared = len(index.sets[i]), len(index.sets[i] & held)
                if shared >= needed(size, index.threshold):
                    yield first + t, index.items[i], size, shared


def _search(indexes: list[ItemIndex]):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [(ids[r].as_py(), i, n, s, s / n) for r, i, n, s in _found(indexes, batch.column("text"))]
            yield arrow_rows(_SCHEMA, **{n: [r[j] for r in rows] for j, n in enumerate(_SCHEMA.names)})

    return run


def _sift(indexes: list[ItemIndex], at: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[r for r, *_ in _found(indexes, batch.column(at))]] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(items: DataFrame, k: int, threshold: float, block_bytes: int) -> Iterator[list[ItemIndex]]:
    """The items in blocks of about ``block_bytes`` of text, each as indexes by shingle length."""
    plain = items.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null")
    total = plain.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))
    numbered = plain.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        by_length = defaultdict(list)
        for r in numbered.where(F.col("block") == block).select("item_id", "text").collect():
            by_length[min(k, len(text_words(r.text.encode())))].append((r.item_id, r.text.encode()))
        yield [ItemIndex(members, n, threshold) for n, members in sorted(by_length.items()) if n]


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair at or over the threshold.

    Items with no word (null, empty, punctuation) match nothing; items shorter than k words are one shingle of their own
    length. Null texts hold nothing. Repeated rows give repeated pairs. Null ids stay null.
    """
    found = None
    for indexes in item_blocks(items, k, threshold, block_bytes):
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _search(indexes), "doc_id long, item_id long, n_item long, n_shared long, containment double"
        )
        found = part if found is None else found.union(part)
    return found


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained_items(docs, items)


def clean(
    docs: DataFrame, items: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows whose text contains no test item at or over the threshold, unchanged; nothing is shuffled.

    A row is judged by its text alone, whatever its id; null texts stay.
    """
    kept = docs
    for indexes in item_blocks(items, k, threshold, block_bytes):
        kept = kept.mapInArrow(_sift(indexes, docs.columns.index("text")), docs.schema)
    return kept
