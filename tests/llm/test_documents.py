"""Operators on single documents: packing, fingerprints, licenses, classifiers, pages."""

from __future__ import annotations

import hashlib
import html as entities
import random
import textwrap
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from corpus import DOCS, prose

from shelfwise.llm import fingerprint, html, language, licenses, packing, quality, toxicity
from shelfwise.llm.oracle import ORACLE

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


# --- packing


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_is_whole_gapless_and_tight(spark, awkward_docs, awkward_rows):
    found = packing.op7(awkward_docs).collect()
    tokenizer, want = _tokenizer(), []
    for doc, text, *_ in awkward_rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024


def test_ids_of_cut_texts_equal_the_tokenizers():
    import public_tokenizers

    encode, tokenizer = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), _tokenizer()
    rng = random.Random(5)
    alphabet = ["a", "Zé", "ß", "'s", "'ll", "'", " ", "  ", "\n", "\t\r", "7", "42", "_", "...", "ñ", "÷", "²", "\x1f", "漢", " ", "x" * 30]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_pretokens_of_plain_texts_skip_the_tokenizers_cutting(monkeypatch):
    """Every plain character in pre-tokens met the first time: the model's ids are the tokenizer's, which is asked for no text."""
    import public_tokenizers
    import tokenizers

    whole, asked = _tokenizer(), []

    class Watched:
        @staticmethod
        def from_file(path):
            return Watched()

        def encode(self, text, **options):
            asked.append(text)
            return whole.encode(text, **options)

        def __getattr__(self, name):
            return getattr(whole, name)

    monkeypatch.setattr(tokenizers, "Tokenizer", Watched)
    encode = packing.encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"))
    plain = [c for c in map(chr, range(0x250)) if packing._PLAIN.fullmatch(c)]
    for text in ("".join(plain), *plain, *(f"{c}{c} blean{c}ste {c}9" for c in plain)):
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert len(plain) > 500 and not asked
    assert np.frombuffer(encode("漢 a"), "<u4").tolist() == whole.encode("漢 a", add_special_tokens=False).ids and asked == ["漢 a"]


@pytest.mark.parametrize("seed", range(6))
def test_fullest_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(20, 90)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * i for s in sums for i in range(n + 1)}
    chosen = packing.fullest(counts, room)
    assert sum(chosen) == max(s for s in sums if s <= room)
    assert all(chosen.count(x) <= counts[x] for x in chosen)


def test_combinations_use_every_piece_once():
    rng = random.Random(8)
    counts = {rng.randrange(1, 1025): rng.randrange(1, 30) for _ in range(200)}
    bins = packing.combinations(counts)
    used: dict[int, int] = {}
    for chosen, times in bins:
        assert sum(chosen) <= 1024
        for x in chosen:
            used[x] = used.get(x, 0) + times
    assert used == counts
    rooms: list[int] = []  # best fit, largest first
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(1024 - x)
    assert sum(t for _, t in bins) <= len(rooms)


# --- fingerprints


def test_fingerprints_and_edited_texts(spark, awkward_rows):
    rows = sorted({r[0]: r for r in awkward_rows if r[0] is not None}.values())
    found = fingerprint.op9(spark.createDataFrame(rows, DOCS).repartition(4)).orderBy("doc_id").collect()
    texts = [r[1] or "" for r in rows]
    for r, text, after in zip(found, texts, texts[1:] + texts[:1]):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other, edited = (bytes.fromhex(x) for x in (r.fingerprint, found[(found.index(r) + 1) % len(found)].fingerprint, r.edited_fingerprint))
        same = lambda a, b: sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / (len(a) // 2)
        assert (r.near_edited, r.near_next) == (same(own, edited), same(own, other))
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].fingerprint == by_id[14].fingerprint and by_id[1].class_id == by_id[14].class_id == 1
    assert by_id[5].fingerprint == by_id[6].fingerprint == by_id[7].fingerprint
    alone = fingerprint.op9(spark.createDataFrame(rows[:1], DOCS)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_likeness_estimates_jaccard():
    rng = random.Random(6)
    for share in (0.2, 0.5, 0.9):
        words = prose(rng, 1500).split()
        other = words[: int(1500 * share)] + prose(rng, 1500 - int(1500 * share)).split()
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        made = fingerprint.signatures(pa.array([" ".join(words), " ".join(other)]))
        assert abs(fingerprint.likeness(made[:1], made[1:])[0] - len(a & b) / len(a | b)) < 0.2


def test_minhash_classes_join_near_copies_only(spark):
    rng = random.Random(7)
    rows = []
    for group in range(5):
        base = prose(rng, 200).split()
        for copy in range(12):
            words = list(base)
            for _ in range(copy % 3):
                words[rng.randrange(len(words))] = "other"
            rows.append((group * 100 + copy, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "band")
    found = fingerprint.op9(docs).collect()
    assert len(found) == 60 and all(r.class_id == r.doc_id // 100 * 100 for r in found)


def _over_boilerplate(pairs: int, seed: int) -> list[tuple]:
    """Pairs of near copies; all hold one passage, by which they meet in bands without being near each other."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 200), []
    for i in range(pairs):
        own = prose(rng, rng.randrange(40, 56)).split()
        for doc in (1 + i, 1000 - i):
            words = list(own)
            words[rng.randrange(len(words))] = f"w{doc}"
            rows.append((doc, f"{passage} {' '.join(words)}", "en", "s", 1))
    return rows


def _alike(rows: list[tuple], threshold: float) -> set[tuple[int, int]]:
    held = []
    for doc, text, *_ in rows:
        words = text.lower().split()
        held.append((doc, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    return {
        (min(a, b), max(a, b))
        for n, (a, x) in enumerate(held)
        for b, y in held[n + 1 :]
        if len(x & y) >= threshold * len(x | y) - 1e-9
    }


def test_minhash_classes_of_bands_led_by_another_text(spark):
    rows = _over_boilerplate(60, 8)
    links = _alike(rows, 0.8)
    assert links == {(1 + i, 1000 - i) for i in range(60)}
    docs = spark.createDataFrame(rows, DOCS)
    found = fingerprint.op9(docs).collect()
    assert {(r.class_id, r.doc_id) for r in found} == links | {(a, a) for a, _ in links}


def test_rare_shingles_miss_no_pair(spark):
    rng = random.Random(9)
    rows = _over_boilerplate(30, 10)
    for doc in range(2000, 2060):  # many sizes around one text
        words = rows[0][1].split()[: rng.randrange(120, 240)]
        rows.append((doc, " ".join(words + prose(rng, rng.randrange(30)).split()), "en", "s", 1))
    comp = {doc: doc if doc % 3 else 2000 for doc, *_ in rows}
    want = {(a, b) for a, b in _alike(rows, 0.8) if comp[a] != comp[b]}
    assert len(want) > 100
    texts = spark.createDataFrame([(doc, comp[doc], text) for doc, text, *_ in rows], "doc long, comp long, text string")
    for frequent in (1, 1000):  # the shingles of the passage count as frequent, or none
        got = fingerprint.similar_pairs(texts, 0.8, 1 << 14, frequent)
        got = {(r.a, r.b) for r in got.collect()}
        assert want <= got and all(comp[a] != comp[b] for a, b in got)


# --- licenses


def test_license_scan_equals_sql(spark, awkward_rows):
    lines = [
        "Licensed under the Apache License, Version 2.0.", "apache   license, apache license; CC BY-NC 4.0", "MIT License mit", "gnu general public\nlicense",
        "This program is free software: you can redistribute it and/or modify it\nunder the terms of the GNU General Public License as published by the Free Software Foundation", "cc by cc by cc",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files", "Copyright 2020. All rights reserved.", "the license of the public",
    ]
    rng = random.Random(11)
    rows = list({r[0]: r for r in awkward_rows if r[0] is not None}.values())
    rows += [(100 + i, "\n".join([prose(rng, 8), rng.choice(lines), prose(rng, 8), rng.choice(lines)]), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert difference(licenses.op5(docs.withColumnRenamed("lang", "row")).toPandas(), con.execute(ORACLE["op5_licenses"]).df()) is None
    found = {r.labels for r in licenses.op5(docs).collect()}
    assert {"", "apache", "mit", "gpl", "rights-reserved"} <= found
    repeated = spark.createDataFrame([(1, "mit license", None, None, None)] * 2 + [(None, None, None, None, None)], DOCS)
    assert sorted(r.n_base for r in licenses.op5(repeated).collect()) == [0, 1, 1]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
GPL = licenses.TEMPLATES[0][1]


def test_license_templates_are_found_however_they_are_wrapped(spark):
    def laid_out(text: str, width: int, between: str) -> str:
        return between.join(textwrap.wrap(text, width))

    rng = random.Random(5)
    rows, want = [], {}
    for text, label in ((MIT, "mit"), (GPL, "gpl")):
        for width in (20, 40, 60, 80, 200):
            for between in ("\n", "\n\n", "\r\n * ", " "):
                for before in (0, 7, 33):
                    want[len(rows)] = label
                    rows.append((len(rows), f"{prose(rng, before)}\n{laid_out(text, width, between)}\n{prose(rng, 20)}", "en", "s", 1))
        want[len(rows)] = label
        rows.append((len(rows), text.replace(" ", "\n"), "en", "s", 1))
    far = len(rows)
    rows.append((far, " ".join(f"{w} {prose(rng, 7000)}" for w in ("copyright", "all", "rights", "reserved")), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in licenses.op5(docs).collect()}
    assert all(label in got[i].labels.split(",") for i, label in want.items())
    assert got[far].labels == "" and got[far].score < 0.9
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert difference(licenses.op5(docs).toPandas(), con.execute(ORACLE["op5_licenses"]).df()) is None


def test_license_scan_of_no_documents(spark):
    assert licenses.op5(spark.createDataFrame([], DOCS)).count() == 0


# --- classifiers


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_and_toxicity_on_the_held_out_fold(spark):
    docs, labels = _table(spark, "documents"), _table(spark, "labels")
    for op, label, least in ((quality.op4, "quality", 0.95), (toxicity.op2, "toxic", 0.92)):
        found = op(docs, labels).toPandas()
        assert len(found) == 1000 and found.score.between(0, 1).all()
        both = found[found.held_out].merge(labels.toPandas(), on="doc_id")
        assert (both.predicted == both[label]).mean() >= least
        assert ((found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0) == found.held_out).all()


def test_language_on_the_held_out_fold(spark):
    docs = _table(spark, "documents")
    found = language.op3(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and found.score.between(0, 1).all()


def test_scores_do_not_read_labels_of_the_held_out_fold(spark):
    docs, labels = _table(spark, "documents"), _table(spark, "labels")
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) quality", "toxic")
    one, other = (quality.op4(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert one.equals(other)


def test_classifiers_on_awkward_rows(spark, awkward_docs, no_docs, awkward_rows):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 0, 1), (4, 1, 0), (9, 7, 1)], LABELS)
    none = spark.createDataFrame([], LABELS)
    n = len(awkward_rows)
    for op in (quality.op4, toxicity.op2):
        for held in (labels, none):
            found = op(awkward_docs, held).collect()
            assert len(found) == n and all(0 <= r.score <= 1 for r in found)
        assert op(no_docs, labels).count() == 0
    found = language.op3(awkward_docs).collect()
    assert len(found) == n and {r.lang_pred for r in found if r.doc_id in (5, 6, 7)} == {"und"}
    assert language.op3(no_docs).count() == 0
    assert {r.lang_pred for r in language.op3(awkward_docs.withColumn("lang", awkward_docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    named = awkward_docs.withColumnRenamed("lang", "quality_score").withColumnRenamed("source", "c1")
    assert quality.accepted(named, none).count() == n and quality.accepted(named, none).columns == named.columns


def test_segments_equal_brute_force():
    rng = np.random.default_rng(1)

    def brute(values, a, b):
        """Maximal segments by definition: the best sub-run, shortest first, then both sides."""
        best, where = 0.0, None
        for i in range(a, b):
            for j in range(i, b):
                s = values[i : j + 1].sum()
                if s > best + 1e-9 or (where and abs(s - best) < 1e-9 and j - i < where[1] - where[0]):
                    best, where = s, (i, j)
        return [] if where is None else [*brute(values, a, where[0]), where, *brute(values, where[1] + 1, b)]

    for _ in range(60):
        values = np.where(rng.random(25) < 0.3, rng.normal(2, 1, 25), rng.normal(-0.7, 0.3, 25))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(values)] == brute(values, 0, 25)


def test_network_gradients():
    rng = np.random.default_rng(2)
    net = language.Network.fresh(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    held, y = rng.integers(1, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2])
    loss = lambda: -net.forward(held)[np.arange(3), y].mean()
    grads = net.gradient(held, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w, step = net.weights[name], 1e-5
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert abs((up - down) / (2 * step) - g[at]) < 1e-4, name


# --- pages


def test_pages_of_the_table(spark):
    found = html.op1(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    right = 0
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"<p>|</p>|</?h1>", article)
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        right += r.text == "\n".join(b for b in want if b)
        assert r.n_chars == len(r.text)
    assert len(found) == len(pages) and right >= 0.99 * len(pages)


def test_deeply_nested_blocks_are_told_by_their_outer_containers(spark):
    net = html.model(spark.read.parquet(f"{SF}/pages.parquet"))
    layout = ["div class='container'", "div class='row'", "div class='col-md-4 col-sm-6'", "div class='inner'", "div class='wrap'", "div class='grid'"] * 2
    rng = random.Random(12)
    deep = lambda texts: "".join(f"<{x}>" for x in layout) + "".join(f"<p>{t}</p>" for t in texts) + "</div>" * len(layout)
    assert len(html.leaves(f"<footer>{deep(['x'])}</footer>")[0].path) > 20
    for order in range(6):
        texts = {k: [prose(rng, 20).capitalize() + "." for _ in range(3)] for k in ("article", "footer", "comments")}
        parts = [
            f"<article>{deep(texts['article'])}</article>",
            f"<footer>{deep(texts['footer'])}</footer>",
            f"<div class='comments'>{deep(texts['comments'])}</div>",
        ]
        rng.shuffle(parts)
        page = html.leaves(f"<html><body>{''.join(parts)}</body></html>")
        marks = html.labelled([page], net)[0]
        assert [l.text for l, m in zip(page, marks) if m] == texts["article"], order


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h2>Site name</h2></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav><div class="cookie-notice"><p>We use cookies here.</p></div>
<main><h1>Heading</h1><p>First   para &amp; more &#233; text.<!-- hidden --><div class="ad-box">Buy now cheap</div>
<p>Second with <b>bold</b>
text &lt;x&gt;.<aside><p>Side text</p></aside><ul><li>point one<li>point two</ul></main>
<section id="comments"><p>Reader says this is a very good article.</p></section><form><p>Your name</p><textarea>x</textarea></form>
<footer>&copy; x</footer>"""


def test_blocks_beside_the_article_go(spark):
    net = html.model(spark.read.parquet(f"{SF}/pages.parquet"))
    schema = "page_id long, url string, html string, main_text string"
    rows = [(1, "u", PAGE, "clash"), (2, None, None, None), (3, "u", "", ""), (None, "u", "plain words only", ""), (5, "u", "<p>a<br>b</p>" * 3000, ""), (1, "u", PAGE, "clash")]
    found = html.extract(spark.createDataFrame(rows, schema), net).collect()
    texts = [r.main_text for r in found]
    assert texts[0] == texts[5] == "Heading\nFirst para & more é text.\nSecond with bold text <x>.\npoint one\npoint two"
    assert texts[1] == texts[2] == "" and len(found[4].blocks) == 3000
    assert html.op1(spark.createDataFrame([], schema)).count() == 0


def _paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


#: page layouts by name: a template over the article's paragraphs and those beside it, and the article's other blocks
NAV, FOOT = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>", "<footer><p>Copyright us</p></footer>"
LAYOUTS = {
    "names of the body": ("<body class='post page has-sidebar with-comments'>{nav}<article><h1>Top</h1>{p}</article><aside>{s}</aside>{foot}", ["Top"], []),
    "form around all": ("<body><form id='aspnetForm'>{nav}<article><h1>Top</h1>{p}</article>{foot}</form>", ["Top"], []),
    "comments as articles": ("<body>{nav}<article><h1>Top</h1>{p}</article><ol class='comments'><li><article>{s}</article></ol>{foot}", ["Top"], []),
    "comments in the article": ("<body>{nav}<article><h1>Top</h1>{p}<div class='comments'>{s}</div></article>{foot}", ["Top"], []),
    "header in the article": ("<body>{nav}<article><header class='entry-header'><h1>Top</h1></header>{p}</article>{foot}", ["Top"], []),
    "header of the site": ("<body><header><h1>Site name</h1>{s}</header>{nav}<main><h1>Top</h1>{p}</main>{foot}", ["Top"], []),
    "unquoted attributes": ("<body>{nav}<article><p>one <a title=don't href=a/b>two</a> three</p>{p}<p>it's four</p></article>{foot}", ["one two three"], ["it's four"]),
    "bare paragraphs": ("<body>{nav}<div>{p}</div>{foot}", [], []),
    "content of the sidebar": ("<body>{nav}<div class='content'><h1>Top</h1>{p}</div><div class='sidebar-content'>{s}</div>{foot}", ["Top"], []),
    "formulas and drawings": (
        "<body>{nav}<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>See <object data=a><param name=b>a "
        "fallback</object> here</p><p>A <svg><title>no</title><text>label</text></svg> drawn</p><svg><path d=1>{p}</article>{foot}",
        ["So x=1 holds", "See a fallback here", "A label drawn"],
        [],
    ),
    "unclosed script": ("<body>{nav}<div><script>var x=1;</div><article><h1>Top</h1>{p}</article>{foot}", ["Top"], []),
}


def test_other_layouts(spark):
    net = html.model(spark.read.parquet(f"{SF}/pages.parquet"))
    rng = random.Random(31)
    for name, (layout, before, after) in LAYOUTS.items():
        inside, beside = ([prose(rng, 20).capitalize() + "." for _ in range(n)] for n in (4, 3))
        page = html.leaves("<html>" + layout.format(nav=NAV, foot=FOOT, p=_paragraphs(inside), s=_paragraphs(beside)))
        marks = html.labelled([page], net)[0]
        assert [l.text for l, m in zip(page, marks) if m] == [*before, *inside, *after], name
        if name != "bare paragraphs":
            assert html.named(page) == [int(m) for m in marks], name


def test_attributes_and_raw_elements():
    read = lambda page: [l.text for l in html.leaves(page)]
    assert read("<p>a <a title=don't>b</a> c</p><p>d's</p>") == ["a b c", "d's"]
    assert read("<p title='x > y'>a</p><p title=\"it's\">b</p>") == ["a", "b"]
    assert read("<div><style>p{}</div><p>a</p><script>x") == ["a"]
    assert read("<script>a</script><p>b</p>" * 3) == ["b"] * 3
    assert html.leaves("<div data-id=ad class='Main-Col x1' title='class=menu'>a</div>")[0].path == ("div", ".main", ".col", ".x", ".1")
    many = "<div>" * 2000 + "<script>" * 2000 + "x"
    assert read(many) == []


def test_order_of_the_path_is_read():
    within, around = (html.told([html.Leaf(path, "x", 0.0)])[0].told for path in (("article", "div", ".comments", "p"), ("div", ".comments", "article", "p")))
    assert set(within) != set(around)
    assert html.named([html.Leaf(("article", "header", x), "t", 0.0) for x in ("h1", "p")]) == [1, 0]


def test_labeller_gradients():
    rng = np.random.default_rng(4)
    net = html.Labeller.fresh()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    pages = [[html.Leaf(("html", rng.choice(["p", "nav", "div"]), ".ad"), prose(random.Random(i), 5), 0.1) for i in range(n)] for n in (4, 7, 1)]
    batch, y = html.encode(pages), rng.integers(0, 2, 12)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(batch).astype(np.float64)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in net.gradients(batch, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w, step = net.weights[name], 1e-3
        w[at] += step
        up = loss()
        w[at] -= 2 * step
        down = loss()
        w[at] += step
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3, name
