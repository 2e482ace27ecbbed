"""Packing documents into sequences by minimum bin slack.

A bin is filled by the combination of available piece lengths with the least slack: a subset-sum over the
lengths, as bits of one integer, finds the fullest feasible sum that holds the largest length left, and the
combination is removed. The choice depends on the number of pieces of each length only, so it is made on that
table (one row a length, whatever the number of documents), and the same combination is taken as often as the
counts allow. The pieces are then dealt to the bins by their number within their length, which is counted in
shares and needs no task to see all pieces of one length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.stage import stage
from shelfwise.llm.text import tidied

CAPACITY = 1024
END_ID = 2
SHARES = 512
#: pre-tokens that a worker keeps the ids of, those met lately and as many met before
CACHE = 300_000

# The pre-token pattern of the byte-level vocabulary, for texts of the plain alphabet below. Words come first,
# as most pre-tokens are; no other alternative begins like one.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]*")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  #: the ASCII characters that are not plain
_PIECES = re.compile(
    r" ?[A-Za-zÀ-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^ \t\n\x0b\x0c\r0-9A-Za-zÀ-ɏ]+"
    r"|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"
)


class _Ids(dict):
    """The ids of a pre-token as bytes, from the tokenizer's model at the first time.

    The model is asked directly: a pre-token needs no cutting any more, only the byte-level spelling of its characters.
    When full it becomes the older generation, and what is met again comes back from there: frequent pre-tokens stay.
    """

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        self.spelled = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c)}
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            made = array("I", [token.id for token in self.model.tokenize(piece.translate(self.spelled))]).tobytes()
        self[piece] = made
        return made


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes.

    Texts of the plain alphabet are cut into pre-tokens here, which do not depend on each other, so that a pre-token
    met before costs one look-up, also in a later task of the same worker; all others, and texts with a special token's string, go to the tokenizer whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known = _Ids(tokenizer)

    def encode(text: str) -> bytes:
        plain = not any(c in text for c in _SEPARATORS) if text.isascii() else _PLAIN.fullmatch(text)
        if plain and not any(s in text for s in special):
            return b"".join(map(known.__getitem__, _PIECES.findall(text)))
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    return encode


_PIECE_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity``; only a document's first piece may be shorter.

    A null text is empty and gives the piece of ``end_id`` alone. Null doc_ids stay null, repeated rows give their pieces each.
    """
    end = array("I", [end_id]).tobytes()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = [[] for _ in _PIECE_SCHEMA]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = memoryview(encode(text.as_py() or "") + end)
                at, number = 0, 0
                size = len(ids) // 4
                step = size % capacity or capacity
                while at < size:
                    for column, value in zip(rows, (doc, number, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)]))):
                        column.append(value)
                    at, number, step = at + step, number + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the fullest feasible combination of at most ``room``, largest first; ``counts`` are of the lengths left."""
    lengths = sorted((l for l in counts if l <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    reach = [1]  # sums reachable with the first i lengths
    for l in lengths:
        bits, left, times = reach[-1], min(counts[l], room // l), 1
        while left > 0:
            take = min(times, left)
            bits |= (bits << (take * l)) & full
            left, times = left - take, times * 2
        reach.append(bits)
        if bits >> room:
            break
    target, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(reach) - 2, -1, -1):
        l, used = lengths[i], 0
        # the larger lengths give what they can, so that the smaller ones are used least
        while not reach[i] >> target & 1:
            target, used = target - l, used + 1
        chosen += [l] * used
    return sorted(chosen, reverse=True)


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by minimum bin slack with the largest length left in every bin."""
    left = {l: n for l, n in counts.items() if n}
    bins = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        chosen = [largest, *fullest({l: n for l, n in rest.items() if n}, capacity - largest)]
        uses = {l: chosen.count(l) for l in set(chosen)}
        times = min(left[l] // u for l, u in uses.items())
        bins.append((chosen, times))
        for l, u in uses.items():
            left[l] -= u * times
            if not left[l]:
                del left[l]
    return bins


def slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length in turn the runs of its pieces: first number, bins' first id, pieces a bin, offset in the bin."""
    rows, taken, first_id = [], {}, 0
    for chosen, times in bins:
        at = 0
        for l in sorted(set(chosen), reverse=True):
            each = chosen.count(l)
            rows.append((l, taken.get(l, 0), first_id, each, at))
            taken[l] = taken.get(l, 0) + each * times
            at += l * each
        first_id += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "number", "bin", "each", "offset"), columns))


def pack(cut: DataFrame, capacity: int = CAPACITY, shares: int = SHARES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``cut`` has ``length`` (1 to capacity) and is read more than once."""
    share = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares))
    dealt = cut.withColumn("_share", share)
    per_share = {(r.length, r._share): r.n for r in dealt.groupBy("length", "_share").agg(F.count("*").alias("n")).collect()}
    counts: dict[int, int] = {}
    begin = np.zeros((capacity + 1) * shares, dtype=np.int64)
    for (l, s), n in sorted(per_share.items()):
        begin[l * shares + s] = counts.get(l, 0)
        counts[l] = counts.get(l, 0) + n
    table = slots(combinations(counts, capacity))
    sent = cut.sparkSession.sparkContext.broadcast((begin, table))  # at most capacity * shares numbers and the combinations
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_turn", F.row_number().over(within).cast("long") - 1)
    columns = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, table = sent.value
        # one increasing key over (length, number)
        span = np.int64(1) << 45
        keys = table["length"] * span + table["number"]
        for batch in batches:
            length = np.asarray(batch.column("length"))
            number = begin[length * shares + np.asarray(batch.column("_share"))] + np.asarray(batch.column("_turn"))
            run_of = np.searchsorted(keys, length * span + number, side="right") - 1
            nth = number - table["number"][run_of]
            each = table["each"][run_of]
            bin_id = table["bin"][run_of] + nth // each
            offset = table["offset"][run_of] + nth % each * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(bin_id), pa.array(offset)], names=[*columns, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces of ``docs`` with their sequence and place; ``path`` is the tokenizer file of every machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(stage(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op7(docs: DataFrame) -> DataFrame:
    return packed(docs)
