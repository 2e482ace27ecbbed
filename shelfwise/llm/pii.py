"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns find well-formed addresses and numbers. The field labels every word of a text with the first or a
further word of a kind, or with none, from features of its shape (letters, digits and signs, with and without their
numbers), of the check digit, of cue words, of repeats, and of its neighbours' shapes and cues. It is trained in numpy, by the
gradient of the likelihood from forward and backward sums, on a small labelled table and on words of a bounded sample
of the corpus; the spans it finds beside the patterns' own are added to them.

Decoding is Viterbi's. A word whose score for no kind leads by more than any neighbour's label could make up for has no
kind on every best path, so only the stretches between such words are decoded, many at a time, with the same result as
for the whole text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.stage import free_name
from shelfwise.llm.text import U64, mixed, slices, words

KINDS = ("email", "ip", "card", "phone", "id")
LABELS = 1 + 2 * len(KINDS)  # none, then each kind's first and further words
#: rows of the labelled table that are used, documents and their words that background comes from
TABLE_ROWS = 4_000
BACKGROUND_DOCS = 200
BACKGROUND_WORDS = 60
EPOCHS = 60
RATE = 0.5
DECAY = 2e-3

# The base patterns, written so that they need one pass over any text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TELLING = re.compile(rb"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if place % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the patterns find, leftmost and without overlaps within a kind."""
    out = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            ends = [p.end() for p in re.finditer(r"[0-9]+", m.group())]
            starts = [p.start() for p in re.finditer(r"[0-9]+", m.group())]
            for i in range(0, len(ends) - 3, 4):  # a match takes four numbers, the next begins behind them
                parts = [m.group()[starts[j] : ends[j]].lstrip("0") for j in range(i, i + 4)]
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                    out.append((m.start() + starts[i], "ip", m.start() + ends[i + 3]))
    for m in _NUMBER.finditer(text):
        held = m.group()
        if len(held) >= 12 and 12 <= len(digits := _digits(held)) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


# -- the labelled table --------------------------------------------------------------------------------------------

# Sentences in which a rule puts made-up values, {kind} marked as personal data and <kind> as none.
_SENTENCES = """
call {phone} today
phone: {phone} or write to {email} please
tel. {phone} and fax {phone}
reach us at {phone}
her number is {phone} until friday
mobile {phone}
mail {email} for details
contact {email} or {phone}
e-mail: {email}, web <word>
write to {email}
from {email} sent on <date>
the host {ip} answered
client {ip} connected at <time>
logged in from {ip} on <date>
server address {ip} port <small>
paid with card {card} yesterday
card number {card} expires <month>
visa {card} was charged <price>
ssn {id} on file
social security number: {id}
passport no. {id} issued <date>
iban {id} for the transfer
transfer to {id} by <date>
signed by <name> on <date>
<name> wrote to {email} about it
<repeated>
<word> <repeated> <word>
<word> {email} <word>
<word> {phone} <word> <word>
<word> {ip} <word>
<word> {card} <word>
<word> <order> <word>
<word> <version> <word>
<word> <date> <word> <time>
order <order> of <date> for <price>
version <version> released <date>
licensed under version <version> of the license
page <small> of <small>
see chapter <version> and table <small>
isbn <isbn> printed <date>
token = <secret> <word>
password=<secret> <word>
key <secret> <word>
commit <secret> by <word>
it costs <price> and weighs <small> kg
from <time> to <time> on <date>
add <small> + <small> to get <small>
follow <handle> for more
the decorator <handle> is used
temperatures of <small>-<small> degrees
serial <order> and part <order>
account balance <price> on <date>
number <long> in the list
<word> <long> <word> <word>
the years <year>-<year> and <year>
ratio <small>:<small> or <version>
mr <word> said no
<word> dr <word> <word>
the <word> st <word>
""".split("\n")[1:-1]  # fmt: skip


_SLOT = re.compile(r"\{(\w+)\}|<(\w+)>")
#: cue words: those of the sentences and of the written-out forms
_CUES = sorted({w for s in _SENTENCES for w in _SLOT.sub(" ", s).split()} | set("at dot (at) [at] [dot] @".split()))

def _number(rng: random.Random, n: int) -> str:
    return "".join(str(rng.randrange(10)) for _ in range(n))


def _pseudo(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "ie", "ou", "an", "er"]) for _ in range(rng.randrange(1, 5)))


def _checked(rng: random.Random, n: int, right: bool = True) -> str:
    while True:
        made = str(rng.randrange(1, 10)) + _number(rng, n - 1)
        if luhn(made) == right:
            return made


def _value(rng: random.Random, kind: str) -> str:
    """A made-up value of a kind, in one of its usual forms."""
    d, word = lambda n: _number(rng, n), lambda: _pseudo(rng)
    pick = rng.choice
    host = f"{word()}{pick(['', d(1), '-' + word()])}"
    if kind == "email":
        local = f"{word()}{pick(['', '.', '_', '-', '+'])}{pick([word(), d(2)])}"
        end = pick(["com", "org", "net", "de", "fr", "example.com", "co.uk"])
        plain = f"{local}@{host}.{end}"
        return pick(
            [plain, plain, plain, f"{local} at {host} dot {end}", f"{local} [at] {host} [dot] {end}", f"{local}(at){host}.{end}",
             f"{local} (at) {host}.{end}", f"{local}[at]{host}[dot]{end}", f"{local} @ {host}.{end}"]
        )
    if kind == "ip":
        octets = [str(rng.randrange(256)) for _ in range(4)]
        groups = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        return pick([".".join(octets)] * 3 + [":".join(groups), ":".join(groups[:3]) + "::" + groups[4]])
    if kind == "card":
        c = _checked(rng, 16)
        parts = [c[i : i + 4] for i in range(0, 16, 4)]
        return pick([c, c, " ".join(parts), "-".join(parts), ".".join(parts), "/".join(parts), "_".join(parts)])
    if kind == "phone":
        a, b, c = d(3), d(3), d(4)
        return pick(
            [f"+{pick(['1', '44', '49', '33', '34'])} ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+49{d(10)}", f"({a}) {b}-{c}", f"({a}) {b}-{c}",
             f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"0049 {a} {b}{c}", f"0{d(3)} / {d(6)}"]
        )
    if kind == "id":
        country = pick(["DE", "FR", "ES", "GB"]) + d(2)
        return pick([f"{d(3)}-{d(2)}-{d(4)}"] * 3 + [" ".join([country, *(d(4) for _ in range(4)), d(2)]), country + d(18)])
    if kind == "date":
        return pick([f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}/{d(2)}/20{d(2)}", f"{d(1)}.{d(1)}.19{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"19{d(2)}"])
    forms = {
        "name": ["Mr. " + word().capitalize(), "Dr " + word().capitalize() + " " + word().capitalize()],
        "repeated": [" ".join([pick([word(), word().capitalize(), word() + ".", pick(_CUES), "at", d(rng.randrange(1, 9))])] * rng.randrange(2, 40))],
        "time": [f"1{d(1)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}pm"],
        "month": [f"0{d(1)}/2{d(1)}", f"1{d(1)}/{d(2)}"],
        "small": [d(1), d(2), d(3), d(2) + "%", d(1) + "." + d(1), "1," + d(3)],
        "year": ["19" + d(2), "20" + d(2)],
        "price": [f"${d(2)}.{d(2)}", f"{d(3)},{d(2)} €", f"£{d(1)},{d(3)}.{d(2)}", f"${d(3)}"],
        "version": [f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(1)}.{d(1)}-rc{d(1)}", f"{d(1)}."],
        "order": [f"#{d(5)}", f"{d(5)}-{d(3)}", f"A{d(4)}-{d(2)}", f"{d(2)}-{d(5)}", f"no.{d(6)}", d(8), d(10)],
        "isbn": [f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}"],
        "long": [_checked(rng, 16, False), _checked(rng, 15, False), _checked(rng, 13, False), d(6), d(20), d(24)],
        "secret": [f'"{rng.randbytes(20).hex()}"', rng.randbytes(9).hex(), rng.randbytes(16).hex(), "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))],
        "handle": ["@" + word(), "@" + word() + d(2), word() + "@" + word()],
        "word": [word(), word(), word() + ",", word() + ".", word().capitalize(), word() + "ñé", f"({word()})", word() + "-" + word(), word() + pick(["!!", "%%%", "###"])],
    }
    return pick(forms[kind])


def labelled_table(rows: int = 3_000, seed: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) of ``rows`` sentences: each of the fixed ones in turn with values made by rule."""
    rng = random.Random(seed)
    out = []
    for n in range(rows):
        sentence, text, spans, at = _SENTENCES[n % len(_SENTENCES)], "", [], 0
        before = " ".join(_value(rng, "word") for _ in range(rng.randrange(3)))
        text = before + " " if before else ""
        for m in _SLOT.finditer(sentence):
            text += sentence[at : m.start()]
            value = _value(rng, m[1] or m[2])
            if m[1]:
                spans.append((m[1], len(text), len(text) + len(value)))
            text += value + (rng.choice(["", "", "", ".", ",", "!!", "%%%"]) if m[1] and m.end() == len(sentence) else "")
            at = m.end()
        text += sentence[at:]
        for _ in range(rng.randrange(3)):
            text += " " + _value(rng, "word")
        out.append((text, spans))
    return out


# -- features ------------------------------------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = ord("a"), ord("A"), ord("0"), 0x80
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[ord("a"), ord("A"), 0x80]] = True
#: for the set of signs of a word: one bit for each class that matters, one for all others
_BIT = np.full(256, 1 << 15, dtype=np.int32)
for _n, _c in enumerate(b"aA0@.-+():/,\"'"):
    _BIT[_c] = 1 << _n
_BIT[0x80] = 1 << 14
_SIGN = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_STEP = U64(0xD6E8FEB86659FD93)


def _hash_kept(classes: np.ndarray, keep: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each word's kept classes, in order."""
    number = np.cumsum(keep)
    before = number[first] - keep[first]
    place = number - 1 - np.repeat(before, lengths)
    power = np.full(int(place.max(initial=0)) + 2, _STEP, dtype=U64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mixed(np.add.reduceat(np.where(keep, _SIGN[classes] * power[np.maximum(place, 0)], U64(0)), first))


@dataclass
class Shapes:
    """Feature hashes of the words of a slice: own (one row a feature), and what neighbours see."""

    own: np.ndarray
    seen: np.ndarray


def features(data: np.ndarray, found, cues: np.ndarray) -> Shapes:
    """``cues`` are the sorted hashes of the cue words, lower-cased."""
    if not len(found.starts):
        return Shapes(np.zeros((6, 0), dtype=U64), np.zeros((2, 0), dtype=U64))
    lengths = found.ends - found.starts
    first = np.cumsum(lengths) - lengths
    held = data[np.repeat(found.starts - first, lengths) + np.arange(int(lengths.sum()))]
    classes = _CLASS[held]
    fresh = np.ones(len(classes), dtype=bool)
    fresh[1:] = classes[1:] != classes[:-1]
    fresh[first] = True
    coarse = _hash_kept(classes, fresh, first, lengths)
    digit = classes == ord("0")
    fine = _hash_kept(classes, fresh | digit | ~_LETTER[classes], first, lengths)
    signs = np.bitwise_or.reduceat(_BIT[classes], first).astype(U64)
    size = np.minimum(np.log2(lengths + 1).astype(np.int64), 5).astype(U64)
    ends = classes[first].astype(U64) << U64(8) | classes[first + lengths - 1].astype(U64)
    spread = mixed((signs << U64(24) | ends << U64(4) | size) * U64(2) + U64(1))
    digits = np.add.reduceat(digit, first)
    check = np.zeros(len(first), dtype=np.int64)
    for i in np.flatnonzero((digits >= 12) & (digits <= 19)).tolist():  # long numbers are rare
        raw = held[first[i] : first[i] + lengths[i]].tobytes()
        check[i] = 1 + luhn("".join(chr(c) for c in raw if 48 <= c <= 57))
    count = mixed((np.minimum(digits, 24) * 4 + check).astype(U64) * U64(0x9E3779B1) + U64(7))
    place = np.minimum(np.searchsorted(cues, found.hashes), len(cues) - 1)
    cue = np.where(cues[place] == found.hashes, found.hashes, U64(0))
    inner = np.ones(len(first) + 1, dtype=bool)
    inner[found.bounds] = False
    same = np.concatenate([[False], found.hashes[1:] == found.hashes[:-1], [False]]) & inner
    again = mixed((same[:-1] * 2 + same[1:]).astype(U64) + U64(11))
    return Shapes(np.stack([spread, coarse, fine, count, cue, again]), np.stack([coarse, cue]))


def _salted(hashes: np.ndarray, row: int) -> np.ndarray:
    return np.where(hashes == 0, U64(0), mixed(hashes ^ U64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))))


class Table:
    """Feature hash -> row of weights, by one look-up; a hash that training didn't meet has the row of zeros."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys[keys != 0])
        bits = max(12, int(len(keys)).bit_length() + 3)
        self.mask = U64((1 << bits) - 1)
        slot = keys & self.mask
        _, once = np.unique(slot, return_index=True)  # of two keys in one slot the first stays
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.rows = np.zeros(1 << bits, dtype=np.int32)
        self.keys[slot[once]] = keys[once]
        self.rows[slot[once]] = np.arange(1, len(once) + 1)
        self.size = len(once) + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & self.mask
        return np.where((self.keys[slot] == hashes) & (hashes != 0), self.rows[slot], 0)


@dataclass
class Field:
    """A trained field: weights of features and of label pairs."""

    table: Table
    weights: np.ndarray
    pairs: np.ndarray
    cues: np.ndarray

    def scores(self, shapes: Shapes, bounds: np.ndarray) -> np.ndarray:
        """Each word's score for each label."""
        n = shapes.own.shape[1]
        if not n:
            return np.zeros((0, LABELS))
        # words alike in all features are scored once
        key = np.zeros(n, dtype=U64)
        for part in shapes.own:
            key = mixed(key + part)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        rows = [[self.weights[self.table.find(_salted(h[first], r))] for r, h in _rows(part)] for part in _views(shapes)]
        own, before, after = (np.sum(r, axis=0) for r in rows)
        out = own[which] + self.weights[-1]
        opens, ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
        out[1:] += np.where(opens[1:, None], 0, before[which[:-1]])
        out[:-1] += np.where(ends[:-1, None], 0, after[which[1:]])
        return out


def _views(shapes: Shapes) -> list[tuple[int, np.ndarray]]:
    """(first feature row, hashes) of a word's own features, those it lends the next word, and the word before."""
    return [(0, shapes.own), (6, shapes.seen), (8, shapes.seen)]


def _rows(view: tuple[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    return [(view[0] + i, h) for i, h in enumerate(view[1])]


# -- training ------------------------------------------------------------------------------------------------------


def tags(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """The label of each word: words that a span reaches into are of its kind."""
    out = []
    opened = -1
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        label = 0
        for n, (kind, a, b) in enumerate(spans):
            if a < m.end() and b > m.start():
                label = 1 + 2 * KINDS.index(kind) + (opened == n)
                opened = n
                break
        out.append(label)
    return out


def likelihood(scores: np.ndarray, pairs: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded sequences and its gradients by the scores and the pairs.

    Sequences begin after, and end before, a word of no kind. Forward and backward sums are scaled at every word.
    """
    n, length, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, t = np.exp(scores - top), np.exp(pairs)
    forward, scale = np.zeros((n, length, labels)), np.ones((n, length))
    state = np.zeros((n, labels))
    state[:, 0] = 1
    for i in range(length):
        now = state @ t * e[:, i]
        scale[:, i] = np.where(real[:, i], now.sum(axis=1), 1)
        # beyond a sequence's end the state stays as it is
        state = forward[:, i] = np.where(real[:, i, None], now / scale[:, i, None], state)
    closing = forward[:, -1] @ t[:, 0]
    value = float((np.log(scale) + np.where(real, top[:, :, 0], 0)).sum() + np.log(closing).sum())
    backward = np.zeros((n, length + 1, labels))
    backward[:, length] = t[:, 0] / closing[:, None]
    expected, mutual = np.zeros_like(scores), np.zeros_like(pairs)
    for i in range(length - 1, -1, -1):
        after = backward[:, i + 1]
        here = forward[:, i] * after
        expected[:, i] = np.where(real[:, i, None], here, 0)
        flow = e[:, i] * after / scale[:, i, None]
        before = np.zeros((n, labels)) if i == 0 else forward[:, i - 1]
        if i == 0:
            before[:, 0] = 1
        mutual += (before * real[:, i, None]).T @ flow * t
        backward[:, i] = np.where(real[:, i, None], flow @ t.T, after)
    mutual[:, 0] += (forward[:, -1] * t[:, 0] / closing[:, None]).sum(axis=0)
    held = np.zeros_like(scores)
    rows, cols = np.nonzero(real)
    held[rows, cols, gold[rows, cols]] = 1
    seen = np.zeros_like(pairs)
    tail = np.zeros(n, dtype=np.int64)
    for i in range(length):
        np.add.at(seen, (tail[real[:, i]], gold[real[:, i], i]), 1)
        tail = np.where(real[:, i], gold[:, i], tail)
    np.add.at(seen, (tail, np.zeros(n, dtype=np.int64)), 1)
    return float((scores * held).sum() + (pairs * seen).sum()) - value, held - expected, seen - mutual


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS) -> Field:
    """A field from labelled texts (the first ``TABLE_ROWS``), by full-batch steps of adaptive size."""
    rows = [r for r in rows[:TABLE_ROWS] if r[0]] or [("-", [])]
    joined = pa.array([t for t, _ in rows], pa.string())
    cue_words = np.concatenate([words(d, o, lower=True).hashes for _, _, d, o in slices(pa.array(_CUES, pa.string()))])
    cues = np.unique(cue_words)
    _, _, data, offsets = next(slices(joined, limit=1 << 62))
    found = words(data, offsets, lower=True)
    shapes = features(data, found, cues)
    gold_flat = np.array([g for t, spans in rows for g in tags(t, spans)], dtype=np.int64)
    sizes = np.diff(found.bounds)
    n, length = len(rows), int(sizes.max())
    real = np.arange(length) < sizes[:, None]
    gold = np.zeros((n, length), dtype=np.int64)
    gold[real] = gold_flat
    own, before, after = ([_salted(h, r) for r, h in _rows(v)] for v in _views(shapes))
    flat = len(found.starts)
    opens = np.zeros(flat + 1, dtype=bool)
    opens[found.bounds] = True
    parts = list(own)
    for h in before:  # what the word before lends
        parts.append(np.where(opens[:-1], U64(0), np.concatenate([[U64(0)], h[:-1]])))
    for h in after:
        parts.append(np.where(opens[1:], U64(0), np.concatenate([h[1:], [U64(0)]])))
    table = Table(np.concatenate(parts))
    used = np.stack([table.find(h) for h in parts], axis=1)
    weights, pairs = np.zeros((table.size + 1, LABELS)), np.zeros((LABELS, LABELS))
    speed_w, speed_p = np.full(weights.shape, 1e-8), np.full(pairs.shape, 1e-8)
    for _ in range(epochs):
        scores = np.zeros((n, length, LABELS))
        scores[real] = weights[used].sum(axis=1) + weights[-1]
        _, by_score, by_pair = likelihood(scores, pairs, gold, real)
        slope = by_score[real]
        step = np.zeros_like(weights)
        for label in range(LABELS):
            step[:, label] = np.bincount(used.ravel(), np.repeat(slope[:, label], used.shape[1]), minlength=len(weights))
        step[0], step[-1] = 0, slope.sum(axis=0)
        step = step / n - DECAY * weights / 10
        by_pair = by_pair / n - DECAY * pairs / 10
        speed_w += step**2
        speed_p += by_pair**2
        weights += RATE * step / np.sqrt(speed_w)
        pairs += RATE * by_pair / np.sqrt(speed_p)
    return Field(table, weights.astype(np.float32), pairs.astype(np.float32), cues)


# -- decoding ------------------------------------------------------------------------------------------------------


def viterbi(scores: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of the sequences between ``bounds``, all sequences a word at a time; of equal ones the lower label."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    length = int(sizes.max(initial=0))
    back = np.zeros((len(scores), scores.shape[1]), dtype=np.int8)
    best = np.repeat(pairs[:1], len(sizes), axis=0)
    final = np.zeros((len(sizes), scores.shape[1]), dtype=scores.dtype)
    for i in range(length):
        live = int(np.searchsorted(-sizes, -i, side="left"))  # longest first: those with more than i words
        at = starts[:live] + i
        if i:
            ways = best[:live, :, None] + pairs[None]
            back[at] = ways.argmax(axis=1)
            best = ways.max(axis=1)
        best = best[:live] + scores[at]
        done = sizes[:live] == i + 1
        final[:live][done] = best[done]
    out = np.zeros(len(scores), dtype=np.int64)
    if length:
        label = (final + pairs[:, 0]).argmax(axis=1)
        for i in range(length - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -i, side="left"))
            at = starts[:live] + i
            out[at] = label[:live]
            if i:
                label[:live] = back[at, label[:live]]
    return out


def decode(scores: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of all words, as `viterbi` gives them, from the doubtful stretches alone."""
    # what a label can gain from its neighbours at most over no kind
    gain = (pairs - pairs[:, :1]).max(axis=0) + (pairs - pairs[:1]).max(axis=1)
    doubtful = np.flatnonzero((scores[:, 1:] + gain[1:] + 1e-4 >= scores[:, :1]).any(axis=1))
    out = np.zeros(len(scores), dtype=np.int64)
    if len(doubtful):
        opens = np.zeros(len(scores) + 1, dtype=bool)
        opens[bounds] = True
        new = np.ones(len(doubtful), dtype=bool)
        new[1:] = (np.diff(doubtful) > 1) | opens[doubtful[1:]]
        cuts = np.append(np.flatnonzero(new), len(doubtful))
        out[doubtful] = viterbi(scores[doubtful], pairs, cuts)
    return out


_INNER = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))


def _trimmed(raw: bytes, kind: str) -> tuple[int, int]:
    """The span without signs around it; a phone keeps its plus and an opening bracket that is closed within."""
    a, b = 0, len(raw)
    while a < b and raw[a] not in _INNER:
        if kind == "phone" and (raw[a] == 0x2B or raw[a] == 0x28 and 0x29 in raw[a:b]):
            break
        a += 1
    while b > a and raw[b - 1] not in _INNER:
        b -= 1
    return a, b


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, str, int]]]:
    """For each text of a slice in which the field finds any: (start, kind, end) in characters, without overlaps."""
    found = words(data, offsets, lower=True)
    labels = decode(field.scores(features(data, found, field.cues), found.bounds), field.pairs, found.bounds)
    at = np.flatnonzero(labels)
    out: dict[int, list] = {}
    if not len(at):
        return out
    text = np.searchsorted(found.bounds, at, side="right") - 1
    kind = (labels[at] - 1) // 2
    first = np.ones(len(at), dtype=bool)
    first[1:] = (labels[at][1:] % 2 == 1) | (np.diff(at) > 1) | (np.diff(kind) != 0) | (np.diff(text) != 0)
    begin = np.flatnonzero(first)
    for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(at)]):
        start, end, name = int(found.starts[at[b]]), int(found.ends[at[e - 1]]), KINDS[kind[b]]
        x, y = _trimmed(data[start:end].tobytes(), name)
        if y > x:
            base = int(offsets[text[b]])
            out.setdefault(int(text[b]), []).append((start + x - base, name, start + y - base))
    for t, spans in out.items():
        held = data[offsets[t] : offsets[t + 1]]
        chars = np.concatenate([[0], np.cumsum((held & 0xC0) != 0x80)])
        out[t] = [(int(chars[a]), k, int(chars[b])) for a, k, b in spans]
    return out


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False),
         T.StructField("end", T.LongType(), False), T.StructField("base", T.BooleanType(), False)]
    ),
    False,
)


def _stretch(text: str) -> tuple[str, list[tuple[str, int, int]]] | None:
    """Words of the text around its first base span, or its middle, with the base spans among them."""
    found = base_spans(text)
    near = found[0][0] if found else len(text) // 2
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    middle = sum(a < near for a, _ in places)
    held = places[max(0, middle - BACKGROUND_WORDS // 2) :][:BACKGROUND_WORDS]
    if not held:
        return None
    a, b = held[0][0], held[-1][1]
    return text[a:b], [(k, max(s, a) - a, min(e, b) - a) for s, k, e in found if s < b and e > a]


def background(docs: DataFrame) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Stretches of the first different texts by hash, labelled by the base patterns alone."""
    schema = "text string, spans array<struct<kind: string, start: long, end: long>>"
    to = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x for t in batch.column("text") if (x := _stretch(t.as_py()))]
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in x[1]] for x in made]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], to.field(0).type), pa.array(spans, to.field(1).type)], schema=to)

    hashed = docs.where("text is not null and text <> ''").select("text", F.xxhash64("text").alias("turn"))
    turns = hashed.select("turn").distinct().orderBy("turn").limit(BACKGROUND_DOCS)
    some = hashed.join(F.broadcast(turns), "turn").groupBy("turn").agg(F.any_value("text").alias("text"))
    rows = some.select("text").mapInArrow(run, schema).collect()  # BACKGROUND_DOCS stretches at most
    return sorted((r.text, [tuple(s) for s in r.spans]) for r in rows)


def train(docs: DataFrame, table: list[tuple[str, list[tuple[str, int, int]]]] | None = None) -> Field:
    """The field from the labelled ``table`` (text and spans; by default `labelled_table`) and the background."""
    return fit(background(docs) + (labelled_table() if table is None else table))


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (characters, end exclusive) and base, by start and then kind.

    All spans of the base patterns (``base``) are there, and the field's that overlap none of them. Null and empty texts
    have none. Every row is judged by itself: repeated rows and ids, and null ids, pass through; a column named ``spans``, in
    any case, is replaced. A text of any length is searched whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs) if field is None else field)  # size bound by the table
    kept = [f.name for f in docs.schema if f.name.lower() != "spans"]
    schema = T.StructType([docs.schema[k] for k in kept] + [T.StructField("spans", SPANS)])
    sent = free_name("_text", kept)
    fields = [pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False), pa.field("base", pa.bool_(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(sent)
            for first, end, data, offsets in slices(texts):
                extra = field_spans(model.value, data, offsets)
                ends, flat = [0], []
                for i in range(end - first):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    # every base span holds a digit or an at sign
                    base = base_spans(raw.decode()) if _TELLING.search(raw) else []
                    mine = [(a, k, b, True) for a, k, b in base]
                    mine += [(a, k, b, False) for a, k, b in extra.get(i, ()) if not any(a < y and b > x for x, _, y in base)]
                    flat += sorted(mine, key=lambda s: (s[0], KINDS.index(s[1])))
                    ends.append(len(flat))
                columns = [[s[1] for s in flat], [s[0] for s in flat], [s[2] for s in flat], [s[3] for s in flat]]
                inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, end - first) for k in kept), lists], names=[*kept, "spans"])

    return docs.select(*(F.col(f"`{k}`") for k in kept), F.col("text").alias(sent)).mapInArrow(run, schema)


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; of overlapping spans the first."""
    found = personal_data(docs.drop("spans"), field)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done, s):
        piece = F.concat(done.out, F.substring(F.col("text"), (done.at + 1).cast("int"), (s.start - done.at).cast("int")), F.lit("<"), s.kind, F.lit(">"))
        return F.when(s.start >= done.at, F.struct(s.end.alias("at"), piece.alias("out"))).otherwise(done)

    text = F.aggregate("spans", zero, step, lambda d: F.concat(d.out, F.substring(F.col("text"), (d.at + 1).cast("int"), F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans")


def op13(docs: DataFrame) -> DataFrame:
    found = personal_data(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.base)
    counts = [number(kind) for kind in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
