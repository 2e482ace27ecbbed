"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a point within half of it of both. Every distinct
fingerprint therefore emits all variants within half the radius, and fingerprints that meet on a
variant are linked. Two fingerprints that share a variant are within the radius of each other by the
triangle inequality, so every collision is a link; the links are verified all the same.

The variants are not shuffled one by one: a fingerprint goes once to each bucket of variants (their
leading bits) that its ball touches, and the bucket's task writes out the fingerprint's variants of
that bucket, sorts them and joins the holders of each. Dense balls share their leading bits, so a bucket's
variants are dealt to parts by a hash that is linear in their bits: the hash of a variant is that of the
fingerprint and of the flips together, so a part's variants are written out without the others and
parts are even however close the fingerprints lie. A task holds one part at a time, and buckets of many
fingerprints are counted beforehand and their parts sent to several tasks. What a task returns is a
spanning forest, at most one link a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.stage import free_name, stage
from shelfwise.llm.text import mixed, tidied

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: variants that a bucket holds on average, and that a task writes out at a time
BUCKET_VARIANTS = 1 << 21
ROOM = 1 << 18
#: fingerprints of a bucket that one task takes; a bucket of average load has less than half as many
BUCKET_FINGERPRINTS = 1 << 17


def fingerprint_of(text: bytes, k: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()  # bytes: only A-Z change and only ASCII white space parts
    if not words:
        return 0
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        digest = xxhash.xxh64_intdigest
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), 1 << 16):  # bounded for the longest texts
        part = np.array(hashes[first : first + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash and the 64-bit fingerprint (as a signed long) of each row's whole text; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            made = np.array([fingerprint_of(t.as_py() or b"", k) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(made)], schema=schema)

    named = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return named.mapInArrow(run, "doc_id long, text_hash long, fp long")


@lru_cache(maxsize=8)
def _flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks over ``bits`` low bits with 0..w bits set, for w = 0..most."""
    masks, out = np.zeros(1, dtype=np.uint64), []
    last = np.array([-1])
    level = masks
    for w in range(most + 1):
        out.append(masks)
        if w < most:
            made = [(m | (1 << b), b) for m, l in zip(level.tolist(), last.tolist()) for b in range(l + 1, bits)]
            level = np.array([m for m, _ in made], dtype=np.uint64)
            last = np.array([b for _, b in made], dtype=np.int64)
            masks = np.concatenate([masks, level])
    return out


_COLUMNS = mixed(np.arange(1, 65, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)


def _linear(values: np.ndarray) -> np.ndarray:
    """32 bits of each value, such that those of two values joined by exclusive or are joined likewise."""
    out = np.zeros(len(values), dtype=np.uint64)
    for bit, column in enumerate(_COLUMNS):
        out ^= column * ((values >> np.uint64(bit)) & np.uint64(1))
    return out


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, each member's least known one, once a and b belong together too."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def bucket_links(
    fps: np.ndarray, bucket: int, bits: int, radius: int, room: int = ROOM, share: int = 0, share_bits: int = 0
) -> np.ndarray:
    """A spanning forest, as (smaller, larger), of the fingerprints that meet on a variant with the leading ``bits`` of ``bucket``.

    Of the variants those count whose linear hash ends in the ``share_bits`` bits of ``share``; they are written out about
    ``room`` at a time.
    """
    half = radius // 2
    low_bits = 64 - bits
    flips = _flips(low_bits, half)
    fps = np.unique(fps)
    top = (fps >> np.uint64(low_bits)).astype(np.int64) if bits else np.zeros(len(fps), dtype=np.int64)
    spent = np.array([int(x ^ bucket).bit_count() for x in top], dtype=np.int64)
    fps, spent = fps[spent <= half], spent[spent <= half]
    load = sum(int((spent == s).sum()) * len(flips[half - s]) for s in range(half + 1))
    part_bits = max(share_bits, math.ceil(math.log2(max(load / room, 1))))
    mask = np.uint64((1 << part_bits) - 1)
    low = fps & np.uint64((1 << low_bits) - 1)
    own = _linear(low) & mask
    by_hash = []  # for each number of flips left: the flips by their hash, and the hashes
    for masks in flips:
        hashes = _linear(masks) & mask
        order = np.argsort(hashes, kind="stable")
        by_hash.append((masks[order], hashes[order]))
    root = np.arange(len(fps))
    for part in range(share, 1 << part_bits, 1 << share_bits):
        variants, owners = [], []
        for s in range(half + 1):
            at = np.flatnonzero(spent == s)
            masks, hashes = by_hash[half - s]
            first = np.searchsorted(hashes, own[at] ^ np.uint64(part), side="left")
            number = np.searchsorted(hashes, own[at] ^ np.uint64(part), side="right") - first
            place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number - first, number)
            variants.append(np.repeat(low[at], number) ^ masks[place])
            owners.append(np.repeat(at, number))
        held, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        same = held[1:] == held[:-1]
        # the holders of a variant are at most twice half the radius apart
        root = _join(root, owner[:-1][same], owner[1:][same])
    node = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([fps[root[node]], fps[node]], axis=1)


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a < b (as unsigned ``fp``, returned as signed longs) that join every fingerprint to all it is within ``radius`` of, directly or through others.

    ``fps`` has distinct ``fp``.
    """
    if radius % 2:
        raise ValueError("meet in the middle needs an even radius")
    half = radius // 2
    ball = sum(math.comb(64, i) for i in range(half + 1))
    number = fps.count()
    bits = min(40, max(10, math.ceil(math.log2(max(number * ball / BUCKET_VARIANTS, 1)))))
    near = _flips(bits, half)[half].astype(np.int64)
    sent_schema = pa.schema([("bucket", pa.int64()), ("fp", pa.int64())])

    @tidied
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = np.asarray(batch.column("fp")).view(np.uint64)
            for first in range(0, len(all_fps), 1024):
                part = all_fps[first : first + 1024]
                to = (part >> np.uint64(64 - bits)).astype(np.int64)[:, None] ^ near[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.ravel()), pa.array(np.repeat(part.view(np.int64), len(near)))], schema=sent_schema
                )

    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        bucket, share, share_bits = (k.as_py() for k in key)
        held = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        links = bucket_links(held, bucket, bits, radius, share=share, share_bits=share_bits)
        return pa.Table.from_arrays([pa.array(links[:, i].copy().view(np.int64)) for i in (0, 1)], schema=link_schema)

    sent = fps.select("fp").mapInArrow(send, "bucket long, fp long")
    # a full bucket is dealt to as many tasks as it has fingerprints for; each takes its share of the variants
    shares = F.ceil(F.log2(F.col("count") / BUCKET_FINGERPRINTS)).cast("int")
    full = stage(sent.groupBy("bucket").count().where(F.col("count") > BUCKET_FINGERPRINTS).select("bucket", shares.alias("bits")), "simhash-full")
    dealt = sent.join(full, "bucket", "left").withColumn("share_bits", F.coalesce("bits", F.lit(0)))
    every = F.sequence(F.lit(0), F.pow(F.lit(2), F.col("share_bits")).cast("int") - 1)
    dealt = dealt.select("bucket", "fp", "share_bits", F.explode(every).alias("share"))
    return dealt.groupBy("bucket", "share", "share_bits").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id (smallest doc_id reachable over links of ``radius`` bits or fewer).

    Rows with a null doc_id keep a fingerprint and link others; a component of null ids alone has a null id.
    Repeated rows share a fingerprint and a component. Texts without words have fingerprint 0 and link like others.
    """
    prints = stage(fingerprints(docs, k), "simhash")
    groups = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-groups")
    linked = components(ball_links(groups.select("fp"), radius))
    least = (
        linked.join(groups, linked.node == groups.fp)
        .groupBy("component")
        .agg(F.min("first_doc").alias("least_doc"))
    )
    placed = linked.join(least, "component").select(F.col("node").alias("fp"), "least_doc")
    classes = groups.join(placed, "fp", "left").select(
        "fp", F.coalesce("least_doc", "first_doc").alias("component_id")
    )
    return prints.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")


def op8(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without all but one of each near-duplicate group: the row of the smallest doc_id stays.

    Rows of the same id and text count once. Rows of one id with different texts are judged each by their own group.
    Rows with a null doc_id are never the one to go, save for repeats. All columns pass unchanged.
    """
    gone = near_duplicates(docs).where("doc_id > component_id").select("doc_id", "text_hash").distinct()
    lost = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    left = docs.join(gone, lost, "left_anti")
    hashed, long = free_name("text_hash", docs.columns), free_name("text_long", docs.columns)
    marked = left.withColumns({hashed: F.xxhash64("text"), long: F.length("text")})  # rather than to sort by whole texts
    return marked.dropDuplicates(["doc_id", hashed, long]).drop(hashed, long)
