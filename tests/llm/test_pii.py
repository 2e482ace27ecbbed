"""Personal data: patterns against the plain ones, the field against enumeration, and the query."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corpus import DOCS, prose

from shelfwise.llm import pii
from shelfwise.llm.text import slices, words

# the patterns as the query's contract states them
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and plain_luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
}


def plain_luhn(s: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), k, m.end()) for k, (p, good) in PLAIN.items() for m in re.finditer(p, text) if good(m.group())]
    return sorted(out, key=lambda s: (s[0], list(PLAIN).index(s[1])))


@pytest.mark.parametrize("alphabet", ["a1@.", "12.5 ", "0123456789 -", "+123456789012 (.-", "ä@a-.%+ \n9", "1234567890+ .-@a"])
def test_patterns_equal_the_plain_ones(alphabet):
    rng = random.Random(alphabet)
    found = 0
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
        found += len(plain_spans(text))
    assert found > 20


def test_patterns_take_long_runs_in_their_stride():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.fit(pii.labelled_table())


def _spans(field, text: str) -> set:
    _, _, data, offsets = next(slices(pa.array([text]), 1 << 40))
    return {(k, a, b) for a, k, b in pii.field_spans(field, data, offsets).get(0, [])}


def test_field_on_unseen_rows(field):
    right = wrong = missed = 0
    for text, gold in pii.labelled_table(1200, seed=7):
        got, want = _spans(field, text), set(gold)
        # signs around a value are no part of a span
        want = {(k, a + len(text[a:b]) - len(text[a:b].lstrip('"([')), b) for k, a, b in want} if not got & want else want
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.93
    assert ("phone", 5, 19) in _spans(field, "call (017) 555-7713 now") and not _spans(field, "over 4799134681044207 of")


def _enumerated(scores: np.ndarray, pairs: np.ndarray) -> tuple[float, tuple]:
    n, labels = scores.shape
    every = []
    for path in itertools.product(range(labels), repeat=n):
        way = [0, *path, 0]
        every.append((scores[range(n), path].sum() + sum(pairs[a, b] for a, b in zip(way, way[1:])), path))
    best = max(every)
    return float(np.log(sum(np.exp(v) for v, _ in every))), best[1]


def test_likelihood_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 5, 0, 3]
    scores, pairs = rng.normal(size=(len(sizes), 5, 4)), rng.normal(size=(4, 4))
    gold = rng.integers(0, 4, (len(sizes), 5))
    real = np.arange(5) < np.array(sizes)[:, None]
    value, by_score, by_pair = pii.likelihood(scores, pairs, gold, real)
    want = 0.0
    for s, g, n in zip(scores, gold, sizes):
        total, _ = _enumerated(s[:n], pairs)
        way = [0, *g[:n].tolist(), 0]
        want += s[range(n), g[:n]].sum() + sum(pairs[a, b] for a, b in zip(way, way[1:])) - total
    assert value == pytest.approx(want)
    for array, slope in ((scores, by_score), (pairs, by_pair)):
        for place in rng.integers(0, array.size, 12):
            at = np.unravel_index(place, array.shape)
            array[at] += 1e-6
            up = pii.likelihood(scores, pairs, gold, real)[0]
            array[at] -= 2e-6
            down = pii.likelihood(scores, pairs, gold, real)[0]
            array[at] += 1e-6
            assert slope[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    flat = np.concatenate([s[:n] for s, n in zip(scores, sizes)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    paths = [p for s, n in zip(scores, sizes) for p in (_enumerated(s[:n], pairs)[1] if n else ())]
    assert pii.viterbi(flat, pairs, bounds).tolist() == paths


def test_doubtful_stretches_decode_as_whole_texts():
    rng = np.random.default_rng(5)
    for _ in range(30):
        scores, pairs = rng.normal(size=(200, 5)), rng.normal(size=(5, 5))
        scores[:, 0] += rng.choice([0, 3, 9], 200)
        bounds = np.sort(np.concatenate([[0, 200], rng.integers(0, 200, 6)]))
        assert (pii.decode(scores, pairs, bounds) == pii.viterbi(scores, pairs, bounds)).all()


def test_scores_equal_a_plain_sum(field):
    texts = ["mail (017) 555-7713 to Ünal,", "", "x", "0049 1 2 3@ \n [at]"]
    _, _, data, offsets = next(slices(pa.array(texts), 1 << 40))
    found = words(data, offsets, lower=True)
    shapes = pii.features(data, found, field.cues)
    got = field.scores(shapes, found.bounds)
    doc = found.doc()
    for i in range(len(doc)):
        want = field.weights[-1].astype(float)
        parts = [(r, shapes.own[r, i]) for r in range(6)]
        parts += [(6 + r, shapes.seen[r, i - 1]) for r in range(2) if i and doc[i - 1] == doc[i]]
        parts += [(8 + r, shapes.seen[r, i + 1]) for r in range(2) if i + 1 < len(doc) and doc[i + 1] == doc[i]]
        for row, value in parts:
            want = want + field.weights[field.table.find(pii._salted(np.array([value]), row))[0]]
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_query_equals_plain_python_and_adds_spans(spark, awkward_rows):
    rng = random.Random(6)
    rows = list(awkward_rows)
    made = ["x.y@mail7.example.com", "97.51.17.173", "4539578763621486", "+1 (017) 555-7713", "300.1.1.1", "4539578763621487"]
    for i in range(120):
        rows.append((100 + i, f"ä {prose(rng, 8)} {made[i % 6]} {prose(rng, 4)}\n", "en", "s", 1))
    rows.append((500, f"{prose(rng, 5)} call (017) 555-7713 or mail jo.doe [at] posteo [dot] de {prose(rng, 5)}", "en", "s", 1))
    found = pii.op13(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(found) == len(rows)
    want = []
    for doc, text, *_ in rows:
        base = plain_spans(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        want.append((doc, *(sum(k == x for _, x, _ in base) for k in PLAIN), digest))
    assert sorted((tuple(r)[:6] for r in found), key=repr) == sorted(want, key=repr)
    extra = {r.doc_id: r.spans for r in found if r.spans.count(":") > 2 * (r.n_email + r.n_ip + r.n_card + r.n_phone)}
    assert set(extra) == {500} and extra[500].startswith("phone:") and ",email:" in extra[500]


def test_masked_and_columns(spark, awkward_docs, no_docs, field):
    named = awkward_docs.withColumnRenamed("lang", "_text").withColumnRenamed("source", "SPANS")
    found = pii.personal_data(named, field)
    assert found.columns == ["doc_id", "text", "_text", "n_chars", "spans"] and found.count() == awkward_docs.count()
    rows = [(1, "ä mail a@b.de or a@c.de!", "en", "s", 1), (2, "none", "en", "s", 1), (3, None, None, None, None)]
    texts = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, DOCS), field).collect()}
    assert texts == {1: "ä mail <email> or <email>!", 2: "none", 3: None}
    assert pii.op13(no_docs).count() == 0
