"""The pipeline's stages, one after the other, against brute force on a small corpus."""

from __future__ import annotations

import random

import pytest
from corpus import DOCS, prose
from test_pairs import ITEMS, _brute_components, _brute_removal, _grams, _words

import corpus_pipeline
from shelfwise.llm import simhash

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, awkward_rows):
    """Good and bad documents (bad ones shout), near copies, a shared passage, a leaked item, awkward rows."""
    rng = random.Random(21)
    rows, labels = [], []
    passage, item = prose(rng, 64), prose(rng, 30)
    for i in range(240):
        text = prose(rng, rng.randrange(80, 160))
        if i % 4 == 0:
            text = "!! ".join(text.upper().split()) + "!!"
        elif i % 10 == 1:
            text = f"{text}\n{passage}\n{prose(rng, 10)}"
        elif i % 30 == 2:
            text = f"{text} {item}"
        elif i % 40 == 3 and rows:
            text = rows[-2][1] + "."
        rows.append((1000 + i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((1000 + i, int(i % 4 != 0), 0))
    rows += awkward_rows
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_equal_brute_force(spark, folder, tmp_path):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before, schema = _rows(docs), docs.schema
    kept = []
    for n, (name, step) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = step(spark, docs, path)
        assert docs.schema == schema, name
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(_rows(docs))
    # quality: what shouts goes, all other rows stay as they are
    shouts = [r for r in before if r[1] and r[1].count("!! ") > 40]
    assert len(shouts) == 60 and kept[0] == [r for r in before if r not in shouts]
    # simhash: the row of the least id of each group
    prints = [(r[0], simhash.fingerprint_of((r[1] or "").encode())) for r in kept[0]]
    least = _brute_components(prints)
    want = {r for r, p in zip(kept[0], prints) if r[0] is None or least[p] is None or least[p] >= r[0]}
    ids = lambda rows: sorted(((r[0], r[1]) for r in rows), key=repr)
    assert ids(kept[1]) == ids(set((r[0], r[1]) for r in want))
    # substring: the words that brute force leaves
    gone = _brute_removal(kept[1])
    left = {key: v for key, v in gone.items() if v[1] == 0 or v[1] < v[0]}
    assert len(kept[2]) == len(left) and sum(v[1] for v in gone.values()) > 500
    assert {r[0]: len((r[1] or "").split()) for r in kept[2] if r[0] and r[0] >= 1000} == {
        i: v[0] - v[1] for (i, _), v in left.items() if i and i >= 1000
    }
    # decontamination: no row that holds the item
    grams = _grams(_words(item), 5)
    leaks = [r for r in kept[2] if len(grams & _grams(_words(r[1]), 5)) >= 0.8 * len(grams)]
    assert len(leaks) >= 4 and kept[3] == [r for r in kept[2] if r not in leaks]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    assert sorted({r.doc_id for r in packed}, key=repr) == sorted({r[0] for r in kept[3]}, key=repr)


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    found = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100


def test_empty_tables_pass_every_stage(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
