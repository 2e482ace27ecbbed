"""Periodic runs against a scan of every lag, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus import DOCS, prose

from shelfwise.llm import periodic
from shelfwise.llm.text import mixed


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(
                q % p == 0 and all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)
            ):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return [w for i, w in enumerate(words) if i not in gone]


def edited(doc: int | None, words: list) -> list:
    if doc is None or not words or (h := zlib.crc32(str(doc).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _text(rng: random.Random) -> list[int]:
    """Runs of many periods, some within others, between and inside words of a small or a large alphabet."""
    out: list[int] = []
    size = rng.choice([2, 3, 50, 10_000])
    for _ in range(rng.randrange(0, 5)):
        out += [rng.randrange(size) for _ in range(rng.randrange(0, 30))]
        root = [rng.randrange(size) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 47, 64, 65]))]
        if rng.random() < 0.3:
            root = root * 4 + [rng.randrange(size)]
        out += (root * 7)[: rng.randrange(1, 6 * len(root))]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_a_scan_of_every_lag(seed):
    rng = random.Random(seed)
    texts = [_text(rng) for _ in range(40)]
    bounds = np.cumsum([0, *map(len, texts)])
    flat = np.array([w for t in texts for w in t], dtype=np.uint64)
    hashes = mixed(flat + np.uint64(1))
    found = periodic.find_runs(hashes, bounds)
    want = [(int(b) + s, l, q) for b, t in zip(bounds, texts) for s, l, q in brute_runs(t)]
    assert [tuple(r) for r in found.tolist()] == want
    assert any(q > 16 for _, _, q in want)


def test_long_period_at_its_shortest():
    rng = random.Random(3)
    for q in (4096, 4097, 5000):
        root = [rng.randrange(1 << 40) for _ in range(q)]
        words = [1, 2, *(root * 4), 3]
        got = periodic.find_runs(np.array(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(words)]))
        assert got.tolist() == [[2, 4 * q, q]]


def test_fewer_periods_than_the_minimizers_see_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, dtype=np.uint64), np.array([0, 9]), min_periods=3)


def test_query_equals_plain_python(spark, awkward_rows):
    rng = random.Random(8)
    rows = [r if len(r[1] or "") < 50_000 else (*r[:1], r[1][:20_000], *r[2:]) for r in awkward_rows]
    for i in range(160):
        root = prose(rng, rng.choice([1, 3, 12, 20]))
        text = f"{prose(rng, rng.randrange(5, 90))}\n\n{' '.join([root] * rng.randrange(1, 8))}\t{prose(rng, 9)}"
        rows.append((100 + i, text, "en", "s", 1))
    found = periodic.op11(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(found) == len(rows)
    want, many = [], 0
    for doc, text, *_ in rows:
        words = edited(doc, (text or "").encode().split())
        runs = brute_runs(words)
        many += len(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        kept = b" ".join(brute_collapsed(words, runs))
        want.append(
            (doc, len(runs), *best, best[2] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
             hashlib.sha256(kept).hexdigest(), len(words))
        )
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert many > 80


def test_runs_keep_rows_and_columns(spark, awkward_docs, awkward_rows, no_docs):
    named = awkward_docs.withColumnRenamed("lang", "_text").withColumnRenamed("source", "RUNS")
    found = periodic.periodic_runs(named)
    assert found.columns == ["doc_id", "text", "_text", "n_chars", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == len(awkward_rows)
    same = {r.doc_id: r for r in rows if r.doc_id in (11, 12)}
    assert same[11].runs[0].asDict() == {"start": 0, "length": 200, "period": 1} and same[11].collapsed == "same"
    assert sum(r.collapsed == "" and r.runs == [] for r in rows) == 3  # two nulls and the empty text
    assert periodic.periodic_runs(no_docs).count() == periodic.op11(no_docs).count() == 0
