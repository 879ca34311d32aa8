"""The pipeline on empty tables, null and repeated ids, null and very long texts, and columns with clashing names."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from rolespark.llm import quality

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = ", _row string, text_hash string, kept boolean, secrets string, removed int"


def prose(rng, n):
    sentences = []
    while n > 0:
        k = rng.randint(6, 14)
        words = [rng.choice(quality.STOP_WORDS) if rng.random() < 0.3 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(k)]
        sentences.append(" ".join(words).capitalize() + ".")
        n -= k
    return " ".join(sentences)


def tables(spark, path, rows, items, more=False):
    extra = ("x", "y", True, "z", 7) if more else ()
    spark.createDataFrame([(*r, *extra) for r in rows], DOCUMENTS + (MORE if more else "")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("more", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, more):
    rng = random.Random(2)
    a, b, c, d, leak = (prose(rng, 120) for _ in range(5))
    item = prose(rng, 20)
    long = prose(rng, 30_000)
    texts = [(1, a), (2, a), (1, b), (None, c), (None, d), (5, None), (None, None), (6, ""), (7, f"{leak} {item} {leak[::-1]}"), (8, long), (9, "too short"), (1, b)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts]
    path = tables(spark, tmp_path, rows, [(1, item), (2, None), (3, "a")], more)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        docs = corpus_pipeline.materialize(kept, "odd")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(1, a), (1, b), (0, c), (0, d), (8, long)])
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == {1, None, 8}
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(x[1] == 0 or (y[0] == x[0] and y[1] + y[2] == x[1]) for y, x in zip([(None, 0, 0), *places], places))


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [], [])).count() == 0
    text = prose(random.Random(3), 100)
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", [(4, text, "en", "s", len(text))], [])).count() == 1
