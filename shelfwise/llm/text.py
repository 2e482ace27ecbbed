"""Whole Arrow text columns as arrays of words, word hashes and hashes of word runs.

Everything works on the UTF-8 bytes of many texts at once, so a word costs a few vector operations
and no Python object. Texts are taken in slices of bounded size (`slices`), never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ctypes
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_CHAR_BASE = U64(0xD6E8FEB86659FD93)
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: U64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base modulo 2**64, kept and lengthened as needed."""

    def __init__(self, base: U64):
        self.base, self.kept = base, _powers(base, 1 << 12)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.kept):
            self.kept = _powers(self.base, 2 * n)
        return self.kept[:n]


_BYTE = mixed(np.arange(1, 257, dtype=U64) * _BASE)
_CHAR, _WORD, _UNWORD = _Powers(_CHAR_BASE), _Powers(_BASE), _Powers(_BASE_INVERSE)

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE_BYTES)] = False
#: letters, digits and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a text column, nulls as empty.

    A slice holds up to ``limit`` bytes, or one text that is longer than that.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


@dataclass
class Words:
    """The words of a slice of texts, in order."""

    starts: np.ndarray  #: byte of each word's first byte
    ends: np.ndarray  #: byte after its last
    bounds: np.ndarray  #: of each text, its first word; one more at the end
    hashes: np.ndarray  #: 64 bits of each word

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Longest runs of bytes that ``inside`` marks; ``lower`` hashes A-Z as a-z."""
    n = len(data)
    mask = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1], before[1:] = False, mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1:], after[:-1] = False, mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), run_hashes(data, mask, starts, ends, lower))


def run_hashes(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    held = data if mask is None else data[mask]
    value = (_BYTE[LOWER] if lower else _BYTE)[held] * _CHAR.upto(int(lengths.max()))[place]
    return mixed(np.add.reduceat(value, first) + lengths.astype(U64))


class Runs:
    """Hashes of runs of consecutive words, any length, from one pass of sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum(hashes * _WORD.upto(len(hashes)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start..end-1."""
        back = _UNWORD.upto(len(self.sums))[start]
        return mixed((self.sums[end] - self.sums[start]) * back + (end - start).astype(U64))


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and their bounds; a shorter text is one shingle, an empty one none."""
    counts = np.diff(found.bounds)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - found.bounds[:-1], number)
    end = start + np.repeat(np.minimum(counts, k), number)
    return Runs(found.hashes).hash(start, end), bounds


def tidied(run):
    """A task's function that at its end hands freed memory back to the system.

    Spark keeps Python workers for later tasks; what Arrow and the C library hold on to would come on top of a later
    stage's needs.
    """

    def and_tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return and_tidy


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
