"""SimHash groups, substring removal and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from corpus import DOCS, prose

from shelfwise.llm import decontaminate, simhash, substring
from shelfwise.llm.components import components


def _near_copies(rng: random.Random) -> list[tuple]:
    base, rows = prose(rng, 60).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(["alpha", "beta", "gamma"])
        rows.append((1000 - i, " ".join(words), "en", "s", 1))
    return rows


def _brute_components(prints: list[tuple]) -> dict[tuple, int | None]:
    values = sorted({fp for _, fp in prints})
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                up[top(a)] = top(b)
    least: dict[int, int] = {}
    for doc, fp in prints:
        if doc is not None:
            least[top(fp)] = min(least.get(top(fp), doc), doc)
    return {(doc, fp): least.get(top(fp)) for doc, fp in prints}


def test_simhash_components_equal_brute_force(spark, awkward_rows):
    rows = awkward_rows + _near_copies(random.Random(1))
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = simhash.near_duplicates(docs).collect()
    want = _brute_components([(r.doc_id, r.fp) for r in found])
    assert len(found) == len(rows)
    assert {((r.doc_id, r.fp), r.component_id) for r in found} == set(want.items())
    assert sum(r.component_id != r.doc_id for r in found) > 20
    digest = {r.doc_id: r for r in simhash.op8(docs).collect() if r.doc_id is not None}
    assert digest[5].fingerprint == digest[6].fingerprint == "0" * 16


def test_simhash_bits_by_hand():
    xxhash = pytest.importorskip("xxhash")
    text = "A b c d e f B c d e"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(text.encode()) == want


def test_buckets_give_the_same_links_in_parts():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centre]))
    bucket = int(fps[0] >> np.uint64(58))
    whole = simhash.bucket_links(fps, bucket, 6, 4)
    parts = simhash.bucket_links(fps, bucket, 6, 4, room=500)
    # both join the same fingerprints
    assert len(whole) and set(whole.ravel().tolist()) == set(parts.ravel().tolist())


def _joined(links: np.ndarray) -> set[frozenset]:
    up: dict[int, int] = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in links.tolist():
        up[top(a)] = top(b)
    groups = defaultdict(set)
    for v in list(up):
        groups[top(v)].add(v)
    return set(map(frozenset, groups.values()))


def test_a_dense_ball_gives_a_forest_and_its_shares_give_the_same():
    rng = np.random.default_rng(2)
    flips = rng.integers(14, 54, (1500, 3)).astype(np.uint64)
    fps = np.unique(np.bitwise_xor.reduce(np.uint64(1) << flips, axis=1) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    bucket = int(fps[0] >> np.uint64(54))
    whole = simhash.bucket_links(fps, bucket, 10, 4, room=1 << 24)
    assert 500 < len(whole) < len(fps) and (whole[:, 0] < whole[:, 1]).all()
    shares = [simhash.bucket_links(fps, bucket, 10, 4, room=1 << 14, share=i, share_bits=2) for i in range(4)]
    assert all(len(s) < len(fps) for s in shares)
    assert _joined(np.concatenate(shares)) == _joined(whole)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    pairs = np.argwhere(np.triu(near, 1))
    assert _joined(fps[pairs]) == _joined(whole)


def test_full_buckets_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", 20)
    rows = _near_copies(random.Random(1)) + [(2000 + i, prose(random.Random(i), 40), "en", "s", 1) for i in range(40)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    want = _brute_components([(r.doc_id, r.fp) for r in found])
    assert {((r.doc_id, r.fp), r.component_id) for r in found} == set(want.items())


def test_keep_one_keeps_every_group_and_all_columns(spark, awkward_docs, awkward_rows):
    named = awkward_docs.withColumnRenamed("source", "fp").withColumnRenamed("lang", "text_hash")
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 14 not in ids and 10 in ids
    assert ids.count(4) == 2  # its other text has a group of its own


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(400)] + [(5, 5)]
    random.Random(2).shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got) == 301 + 401
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(401))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_removal(rows: list[tuple], window: int = 50) -> dict[tuple, tuple]:
    held = [(i, t, (t or "").encode().split()) for i, t, *_ in rows]
    first: dict[bytes, int] = {}
    for i, _, words in held:
        if i is not None:
            for s in range(len(words) - window + 1):
                key = b" ".join(words[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, t, words in held:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[b" ".join(words[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i, t] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_removal_equals_brute_force(spark, awkward_rows):
    rng = random.Random(9)
    rows = list(awkward_rows)
    passages = [prose(rng, n) for n in (49, 50, 51, 80, 200)]
    for i in range(60):  # passages in turn, cut at random ends, and periodic texts
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(2):
            words = rng.choice(passages).split()
            parts.append(" ".join(words[rng.randrange(3) : len(words) - rng.randrange(3)]))
        if i % 7 == 0:
            parts.append("ab cd ef " * rng.randrange(15, 40))
        parts.append(prose(rng, rng.randrange(0, 40)))
        rows.append((500 - i, "\n".join(parts), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = _brute_removal(rows)
    found = substring.remove_repeats(docs.withColumnRenamed("source", "spans")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, r.text], r.doc_id
        if not r.n_removed:
            assert r.kept == r.text
        elif r.kept is not None:
            assert hashlib.sha256(b" ".join(r.kept.encode().split())).hexdigest() == r.kept_sha256
    assert sum(w[1] for w in want.values()) > 3000


def test_cleaned_drops_what_is_empty_and_keeps_columns(spark, awkward_docs):
    named = awkward_docs.withColumnRenamed("source", "kept").withColumnRenamed("lang", "n_words")
    kept = substring.cleaned(named)
    assert kept.schema == named.schema
    rows = {r.doc_id: r for r in kept.collect() if r.doc_id is not None}
    assert 14 not in rows  # a whole copy
    assert rows[5].text == "" and rows[6].text is None and rows[10].n_chars == len(rows[10].text)
    assert rows[3].n_chars == len(rows[3].text) < 60


ITEMS = "item_id long, text string"


def _words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def _grams(words: list[bytes], k: int) -> set[tuple]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_decontamination_equals_brute_force(spark, awkward_rows):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 5, 6, 9, 14, 30, 61, 200])]
    items += [(90, None), (91, ""), (92, "..."), (None, items[3][1]), (3, items[3][1])]
    rows = list(awkward_rows)
    for i in range(80):
        words = rng.choice(items[:8])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        text = f"{prose(rng, rng.randrange(60))} {', '.join(words).upper()}. {prose(rng, rng.randrange(60))}"
        rows.append((100 + i, text, "en", "s", 0))
    docs, table = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = []
    for doc, text, *_ in rows:
        held = _words(text)
        for item, item_text in items:
            words = _words(item_text)
            k = min(5, len(words))
            grams = _grams(words, k) if k else set()
            shared = len(grams & _grams(held, k)) if k else 0
            if grams and shared >= 0.8 * len(grams) - 1e-9:
                want.append((doc, item, len(grams), shared))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    for room in (1 << 22, 400):  # one block, and several
        found = decontaminate.contained_items(docs, table, block_bytes=room)
        assert sorted([tuple(r)[:4] for r in found.collect()], key=key) == sorted(want, key=key)
    dirty = defaultdict(bool)
    for doc, *_ in want:
        dirty[doc] = True
    kept = decontaminate.clean(docs, table)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.where("doc_id >= 100").collect()) == [i for i in range(100, 180) if not dirty[i]]


def test_empty_tables(spark, no_docs):
    assert simhash.op8(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    assert substring.op6(no_docs).count() == 0 and substring.cleaned(no_docs).count() == 0
    no_items = spark.createDataFrame([], ITEMS)
    assert decontaminate.op10(no_docs, no_items).count() == 0
    assert decontaminate.clean(no_docs, no_items).count() == 0
