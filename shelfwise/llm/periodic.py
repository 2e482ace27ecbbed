"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words in which words one period apart are identical, long enough for its
period and not extendable. Periods up to ``DIRECT`` are found by comparing each word with the one a lag before.
Longer ones are sought scale by scale: the scale of periods in (s/2, s] hashes all s-word stretches and takes the
least hash of every s/2 consecutive ones. A run of period q holds four periods and such a window spans fewer than
three, so a window and the one a period later both lie in the run and choose the same stretch; and as an s-word
stretch holds a whole period, it recurs in the run at multiples of q only. Neighbouring occurrences of a chosen
stretch therefore include one pair at distance q for every run. Each pair is a seed, extended both ways by binary
search over the hashes of stretches of any length.

Work grows with n log n in a text's words, memory with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.stage import free_name
from shelfwise.llm.text import Runs, slices, words

#: periods that are found by comparing at every lag
DIRECT = 8
MIN_WORDS = 6
MIN_PERIODS = 4
RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _slid(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` (a power of two) consecutive values, by doubling."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the least of some window of ``width`` consecutive values."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = _slid(hashes, width, np.minimum)
    pad = np.zeros(width - 1, dtype=hashes.dtype)
    # the greatest of the minima of all windows over a position reaches its value only if one of them chose it
    return np.flatnonzero(_slid(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)


def _seeds(runs: Runs, doc: np.ndarray, bounds: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances, in (scale/2, scale], of neighbouring equal minimizers of a text.

    All texts that can hold such a period are hashed in one go. Stretches and windows that reach into the next text choose
    positions of their own; they take none from the windows within a text, and no pair of two texts is a seed.
    """
    long = np.diff(bounds) >= MIN_PERIODS * (scale // 2 + 1)
    at = np.flatnonzero(long[doc])
    hashes = runs.hash(at, np.minimum(at + scale, len(doc)))
    place = chosen(hashes, scale // 2)
    order = np.argsort(hashes[place], kind="stable")  # ascending within equal hashes
    held, place = hashes[place][order], at[place[order]]
    apart = place[1:] - place[:-1]
    hit = (held[1:] == held[:-1]) & (doc[place[1:]] == doc[place[:-1]]) & (apart > scale // 2) & (apart <= scale)
    return place[:-1][hit], apart[hit]


def _reach(runs: Runs, left: np.ndarray, right: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from ``left`` and ``right`` on (or before them), at most ``most``."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if forward:
            same = runs.hash(left, left + mid) == runs.hash(right, right + mid)
        else:
            same = runs.hash(left - mid, left) == runs.hash(right - mid, right)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def find_runs(
    hashes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> np.ndarray:
    """(start, length, period) of all runs, by start and then period; starts count over all texts.

    ``bounds`` are each text's first word and, last, the number of words; no run crosses them.
    """
    if min_periods < MIN_PERIODS:
        raise ValueError(f"runs of fewer than {MIN_PERIODS} periods can hide from the minimizers")
    n = len(hashes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begins, ends, periods = [], [], []
    for q in range(1, min(DIRECT, n - 1) + 1):
        first, last = _stretches((hashes[q:] == hashes[:-q]) & (doc[q:] == doc[:-q]))
        begins.append(first)
        ends.append(last + q)
        periods.append(np.full(len(first), q))
    longest = int(np.diff(bounds).max(initial=0))
    scale = 2 * DIRECT
    if longest >= MIN_PERIODS * (scale // 2 + 1):
        runs = Runs(hashes)
    while longest >= MIN_PERIODS * (scale // 2 + 1):
        at, gap = _seeds(runs, doc, bounds, scale)
        if len(at):
            text = doc[at]
            ahead = _reach(runs, at, at + gap, bounds[text + 1] - at - gap, True)
            back = _reach(runs, at, at + gap, at - bounds[text], False)
            made = np.unique(np.stack([at - back, at + gap + ahead, gap], axis=1), axis=0)
            begins.append(made[:, 0])
            ends.append(made[:, 1])
            periods.append(made[:, 2])
        scale *= 2
    if not begins:
        return np.zeros((0, 3), dtype=np.int64)
    begin, end, period = np.concatenate(begins), np.concatenate(ends), np.concatenate(periods)
    size = end - begin
    fit = size >= np.maximum(min_words, min_periods * period)
    begin, end, period = begin[fit], end[fit], period[fit]
    least = np.ones(len(begin), dtype=bool)
    for i in range(len(begin)):  # of at least four periods, so a smaller period would divide this one
        b, e, q = int(begin[i]), int(end[i]), int(period[i])
        if any(np.array_equal(hashes[b : b + q - q // f], hashes[b + q // f : b + q]) for f in _prime_factors(q)):
            # the first period repeats within itself, and so does all that follows it
            least[i] = False
    found = np.stack([begin, end - begin, period], axis=1)[least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> bytes:
    """The words at ``starts`` to ``ends`` of ``data`` that no run holds after its first period, joined by one space."""
    step = np.zeros(len(starts) + 1, dtype=np.int32)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    raw = data.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist()))


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that a run holds after its first period.
    Words part at ASCII white space. A null or wordless text has no run and an empty ``collapsed``. Every row is judged by
    itself, so repeated rows and ids, and null ids, pass through; columns of the same names, in any case, are replaced.
    """
    made = ("n_words", "runs", "collapsed")
    kept = [f.name for f in docs.schema if f.name.lower() not in made]
    schema = T.StructType(
        [docs.schema[k] for k in kept]
        + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    )
    sent = free_name("_text", kept)
    inner = [pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(sent)):
                found = words(data, offsets)
                runs = find_runs(found.hashes, found.bounds, min_words, min_periods)
                cuts = np.searchsorted(runs[:, 0], found.bounds)
                number = np.repeat(np.arange(end - first), np.diff(cuts))
                runs[:, 0] -= found.bounds[number]
                texts = []
                for i in range(end - first):
                    a, b = offsets[i], offsets[i + 1]
                    if cuts[i] < cuts[i + 1]:
                        held = slice(found.bounds[i], found.bounds[i + 1])
                        mine = runs[cuts[i] : cuts[i + 1]]
                        texts.append(_collapsed(data[a:b], found.starts[held] - a, found.ends[held] - a, mine))
                    else:
                        texts.append(b" ".join(data[a:b].tobytes().split()))
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], fields=inner)
                )
                columns = [batch.column(k).slice(first, end - first) for k in kept]
                columns += [
                    pa.array(np.diff(found.bounds)),
                    lists,
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    return docs.select(*(F.col(f"`{k}`") for k in kept), F.col("text").alias(sent)).mapInArrow(run, schema)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a planted run at the end of the texts whose checksum of doc_id is divisible by ten.

    With g a tenth of the checksum and n the words, those from number g % n on repeat the first of them over and over, with
    period 1 + (words from there on) // (3 + g % 8). Texts without words, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    parts = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    # one struct in an array: a lambda's variable is worked out once, an expression within it at every element
    whole = F.array(F.struct(parts.alias("words"), g.alias("g")))
    placed = F.transform(whole, lambda s: F.struct(s.words.alias("words"), s.g.alias("g"), (s.g % F.size(s.words)).cast("int").alias("first")))
    placed = F.transform(
        placed,
        lambda s: F.struct(s.words, s.first, (1 + F.floor((F.size(s.words) - s.first) / (3 + s.g % 8))).cast("int").alias("period")),
    )

    def repeated(s: Column) -> Column:
        def number(i: Column) -> Column:
            return F.when(i < s.first, i).otherwise(s.first + (i - s.first) % s.period)

        return F.array_join(F.transform(s.words, lambda _, i: F.get(s.words, number(i))), " ")

    tail = F.get(F.transform(placed, repeated), F.lit(0))
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(parts) > 0), tail).otherwise(F.col("text")))


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(repeated_tails(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    ranked = F.transform("runs", lambda r: F.struct((-r.length).alias("a"), r.start.alias("start"), r.period.alias("period")))
    best = F.get(F.array_sort(ranked), F.lit(0))
    line = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period))
    top = found.withColumn("_best", best)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.a")).alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.a div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
