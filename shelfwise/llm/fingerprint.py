"""Document fingerprints by MinHash.

Each of many universal hash permutations a*x + b (modulo 2**32, a odd) of a text's 5-word shingle hashes keeps its least
value; the low 16 bits of these make the fingerprint. The share of equal fields estimates the Jaccard similarity of the
shingle sets. For near duplicates, bands of fields are joined in Spark and the pairs verified by exact Jaccard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.stage import stage
from shelfwise.llm.text import ALNUM, shingles, slices, words

SHINGLE_WORDS = 5
FIELDS = 64
BANDS = 16
THRESHOLD = 0.8
#: size of the bitmap that spares shuffling texts no pair needs
FILTER_BITS = 1 << 24
#: counters that order shingles from rare to frequent, and documents from which a shingle counts as frequent at least
COUNTERS = 1 << 21
FREQUENT = 64

_RNG = np.random.default_rng(2024)
_A = (_RNG.integers(0, 1 << 31, FIELDS, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, FIELDS, dtype=np.uint32)


def signatures(texts: pa.Array, k: int = SHINGLE_WORDS) -> np.ndarray:
    """One row of 16-bit fields for each text; texts without a word have all fields at their largest."""
    out = np.full((len(texts), FIELDS), 0xFFFF, dtype=np.uint16)
    for first, _, data, offsets in slices(texts, 1 << 20):
        hashes, bounds = shingles(words(data, offsets, ALNUM, lower=True), k)
        filled = np.flatnonzero(np.diff(bounds))
        if not len(filled):
            continue
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(x)
        for i in range(FIELDS):
            np.multiply(x, _A[i], out=value)
            value += _B[i]
            least = np.minimum.reduceat(value, bounds[filled])
            out[first + filled, i] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
    return out


def hexed(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_SCHEMA = pa.schema([*_FIELDS, ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_ROW, _LAST, _FIRST = 0, 1, 2


def _compared(ids: list, texts: list[str], own: np.ndarray, after: list[str], after_own: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, n) for t, n in zip(texts, after)]
    changed_own = signatures(pa.array(changed, pa.large_string()))
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(hexed(own), pa.string()),
        pa.array(hexed(changed_own), pa.string()),
        pa.array(likeness(own, changed_own), pa.float64()),
        pa.array(likeness(own, after_own), pa.float64()),
    ]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each with the one after it; the partition's first and last are also sent on with their texts."""
    part = TaskContext.get().partitionId()

    def sent(kind: int, doc, text: str) -> pa.RecordBatch:
        values = {"doc_id": doc, "kind": kind, "part": part, "text": text}
        return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)

    ids, texts, own = [], [], np.zeros((0, FIELDS), np.uint16)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            piece = batch.slice(a, 1024)
            new = [t or "" for t in piece.column("text").to_pylist()]
            if not ids:
                yield sent(_FIRST, piece.column("doc_id")[0].as_py(), new[0])
            ids, texts = ids + piece.column("doc_id").to_pylist(), texts + new
            own = np.concatenate([own, signatures(pa.array(new, pa.large_string()))])
            n = len(ids) - 1
            if n:
                held = _compared(ids[:n], texts[:n], own[:n], texts[1:], own[1:])
                held += [pa.array([v] * n, t) for v, t in ((_ROW, pa.int32()), (part, pa.int32()), (None, pa.string()))]
                yield pa.RecordBatch.from_arrays(held, schema=_SCHEMA)
            ids, texts, own = ids[n:], texts[n:], own[n:]
    if ids:
        yield sent(_LAST, ids[0], texts[0])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_FIELDS)
    for batch in batches:
        texts, after = batch.column("text").to_pylist(), batch.column("after").to_pylist()
        own, after_own = (signatures(pa.array(x, pa.large_string())) for x in (texts, after))
        yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id").to_pylist(), texts, own, after, after_own), schema=schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the next row by doc_id (nulls first, repeated ids by a hash of their text), after the last the
    first; a single row is its own next. Null texts are empty. Only the two rows at the edges of each partition of the
    ordered table meet in a join; all others meet their neighbour in the ordered partition.
    """
    spark = docs.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text").alias("tie")
    ordered = docs.select(F.col("doc_id").cast("long"), "text", tie).repartitionByRange(number, "doc_id", "tie")
    made = stage(
        ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(
            _neighbours, _DDL + ", kind int, part int, text string"
        ),
        "fingerprints",
    )
    edges = made.where(f"kind <> {_ROW}").select("doc_id", "kind", "part", "text")
    parts = sorted(r.part for r in edges.where(f"kind = {_LAST}").select("part").collect())  # one row a partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = edges.where(f"kind = {_FIRST}").select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = edges.where(f"kind = {_LAST}").join(following, "part").join(heads, "next")
    last = tails.select("doc_id", "text", "after").mapInArrow(_across, _DDL)
    return made.where(f"kind = {_ROW}").select([n for n, _ in _FIELDS]).union(last)


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, sets = whole.slice(at, 256), []
                for name in ("text_a", "text_b"):
                    sets.append(list(_sets(batch.column(name))))
                shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)])
                either = np.array([len(a) + len(b) for a, b in zip(*sets)]) - shared
                keep = (shared >= threshold * either - 1e-9) & (either > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _likely(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id and text of the documents whose id may be among ``ids``: all that are, and few others.

    The ids become one bitmap of fixed size, so texts that no pair needs are dropped before they are shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    marked = (
        ids.select(place("id").alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("marks"))
        .collect()  # at most ``bits`` in all
    )
    held = np.zeros(bits // 8, dtype=np.uint8)
    for r in marked:
        part = np.frombuffer(bytes(r.marks), dtype=np.uint8)
        at = (r.bucket - 1) * len(part)
        held[at : at + len(part)] = part[: len(held) - at]
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column("p")) - 1
            keep = (sent.value[p >> 3] >> (p & 7)) & 1 > 0
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", place("doc_id").alias("p"))
    return named.mapInArrow(run, "doc_id long, text string")


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text."""
    for _, _, data, offsets in slices(column):
        hashes, bounds = shingles(words(data, offsets, ALNUM, lower=True), SHINGLE_WORDS)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(hashes[a:b])


def _counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % counters


def _frequencies(texts: DataFrame, counters: int) -> np.ndarray:
    """How many texts hold a shingle of each counter; shingles share counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for held in _sets(batch.column("text")):
                np.add.at(total, _counter(held, counters), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, dtype=np.int64)  # at most ``counters`` rows
    out[np.asarray(counted.column("at"))] = np.asarray(counted.column("n"))
    return out


def _size_classes(most: int) -> np.ndarray:
    """Least size of each class; a class is about 2 % wide."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 51 // 50))
    return np.array(out, dtype=np.int64)


def _prefixes(texts: DataFrame, threshold: float, counters: int, frequent: int) -> DataFrame:
    """h, size_class, small, doc, comp, n, rest: the rare shingles by which documents at or over the threshold meet.

    Shingles are in one order, from rare to frequent. Two documents of m <= n shingles at the threshold share at least
    threshold / (1 + threshold) * (m + n), so their first common one has as many left (``rest``) in both. Documents go out
    as the smaller and as the larger one of a pair; for frequent shingles the larger one goes to each class of sizes that
    the smaller one can have, with as few shingles as that class asks for.
    """
    totals = _frequencies(texts, counters)
    mean = totals.sum() / max(np.count_nonzero(totals), 1)
    sent = texts.sparkSession.sparkContext.broadcast(totals)
    hot_at, share = max(frequent, 8 * mean), threshold / (1 + threshold)
    names = ["h", "size_class", "small", "doc", "comp", "n", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _size_classes(1 << 16)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                docs, comps = (batch.column(c).to_pylist() for c in ("doc", "comp"))
                made: list[tuple] = []
                for i, held in enumerate(_sets(batch.column("text"))):
                    n = len(held)
                    if not n:
                        continue
                    while n >= classes[-1]:
                        classes = _size_classes(2 * n)
                    seen = sent.value[_counter(held, counters)]
                    order = np.lexsort((held, seen))[: n - math.ceil(threshold * n - 1e-9) + 1]
                    held, hot = held[order].view(np.int64), seen[order] > hot_at
                    rest = n - np.arange(len(held))
                    own = int(np.searchsorted(classes, n, side="right")) - 1
                    least = int(np.searchsorted(classes, math.ceil(threshold * n - 1e-9), side="right")) - 1

                    def add(keep: np.ndarray, size_class: int, small: int) -> None:
                        if keep.any():
                            made.append((held[keep], rest[keep], size_class, small, i, n))

                    inner = rest >= 2 * share * n - 1e-9
                    add(~hot & inner, -1, 1)
                    add(~hot, -1, 0)
                    add(hot & inner, own, 1)
                    if hot.any():
                        for c in range(least, own + 1):
                            add(hot & (rest >= share * (n + classes[c]) - 1e-9), c, 0)
                if made:
                    number = [len(m[0]) for m in made]
                    of = lambda values: pa.array(np.repeat(np.array(values, dtype=np.int64), number))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([m[0] for m in made])),
                            of([m[2] for m in made]),
                            of([m[3] for m in made]),
                            of([docs[m[4]] for m in made]),
                            of([comps[m[4]] for m in made]),
                            of([m[5] for m in made]),
                            pa.array(np.concatenate([m[1] for m in made])),
                        ],
                        names=names,
                    )

    return texts.select("doc", "comp", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def similar_pairs(
    texts: DataFrame, threshold: float = THRESHOLD, counters: int = COUNTERS, frequent: int = FREQUENT
) -> DataFrame:
    """a < b: candidates that hold every pair of documents of different ``comp`` at or over the threshold.

    ``texts`` has doc, comp and text. Rows of the class that holds most of a shingle's rows meet those of other classes
    only, so a large class costs no pairs of its own.
    """
    rows = stage(_prefixes(texts, threshold, counters, frequent), "prefixes")
    key = ["h", "size_class"]
    main = (
        rows.groupBy(*key, "comp").agg(F.count("*").alias("rows"))
        .groupBy(*key).agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.count("*").alias("comps"))
        .where("comps > 1")
    )
    placed = rows.join(main, key).withColumn("of_main", F.col("comp") == F.col("main"))
    side = lambda here: F.explode(
        F.when(F.col("of_main"), F.array(F.lit(here))).otherwise(F.array(F.lit(0), F.lit(3 - here)))
    )
    s = placed.where("small = 1").select(
        *key, side(1).alias("way"), F.col("doc").alias("s_doc"), F.col("comp").alias("s_comp"), F.col("n").alias("m"), F.col("rest").alias("s_rest")
    )
    l = placed.where("small = 0").select(*key, side(2).alias("way"), "doc", "comp", "n", "rest")
    share = threshold / (1 + threshold)
    fits = (
        (F.col("s_comp") != F.col("comp"))
        & (F.col("m") <= F.col("n"))
        & (F.col("m") >= threshold * F.col("n") - 1e-9)
        & (F.least("s_rest", "rest") >= share * (F.col("m") + F.col("n")) - 1e-9)
    )
    met = s.join(l, [*key, "way"]).where(fits)
    return met.select(F.least("doc", "s_doc").alias("a"), F.greatest("doc", "s_doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, prints: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """fingerprint, class_id: the least doc_id of the class of verified near duplicates that a fingerprint belongs to.

    ``prints`` has doc_id and fingerprint. Documents of equal fingerprint are one class from the start. In every band a
    class shares with others it is compared, by exact Jaccard, with the band's smallest document. Where that leaves the
    other members of a band in several classes, they are joined on their rare shingles (`similar_pairs`), which misses no
    pair at the threshold, and verified too; verified links make the classes. Fingerprints of null ids alone have no class.
    """
    classes = stage(
        prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc")), "print-classes"
    )
    width = 4 * FIELDS // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("fingerprint", i * width + 1, width)) for i in range(bands)])
    banded = stage(classes.select("doc", F.explode(keys).alias("band")), "bands")
    led = banded.groupBy("band").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a < z").select("band", "a")
    members = stage(banded.join(led, "band").where("doc > a").select("band", "a", F.col("doc").alias("b")), "band-members")
    pairs = members.select("a", "b").distinct()

    def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        text_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = text_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold), "a long, b long")

    joined = components(judged(pairs, _likely(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))))
    placed = members.join(joined, members.b == joined.node, "left").select(
        "band", F.col("b").alias("doc"), F.coalesce("component", "b").alias("comp")
    )
    open_bands = placed.groupBy("band").agg(F.min("comp").alias("c"), F.max("comp").alias("z")).where("c < z").select("band")
    left = stage(placed.join(open_bands, "band").select("doc", "comp").distinct(), "open-members")
    if not left.isEmpty():
        named = left.join(_likely(docs, left.select(F.col("doc").alias("id"))), F.col("doc") == F.col("doc_id"))
        texts = stage(named.select("doc", "comp", "text"), "open-texts")
        further = judged(stage(similar_pairs(texts, threshold), "rare-pairs"), texts.select(F.col("doc").alias("doc_id"), "text"))
        joined = components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).union(further))
    return classes.join(joined, classes.doc == joined.node, "left").select(
        "fingerprint", F.coalesce("component", "doc").alias("class_id")
    )


def op9(docs: DataFrame) -> DataFrame:
    prints = fingerprints(docs)
    classes = near_duplicates(docs, prints.select("doc_id", "fingerprint"))
    return prints.join(classes, "fingerprint", "left").select(*[n for n, _ in _FIELDS], "class_id")
