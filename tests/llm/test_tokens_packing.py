"""Token files and packing: exact round trips and packing rules."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rolespark.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
TEXTS = ["Hello, wörld!  it's 12 o'clock", None, "", "same", "same", " \n\t", "é" * 50, "<|endoftext|> x", "long " * 900, "日本語 テキスト 🙂"]


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_like_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    got = next(iter(tokens.encoder_for(PATH)(pa.array([text]))))
    assert got == np.array(ids(text), dtype="<u4").tobytes()


def test_planes():
    block = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32).tobytes()
    assert tokens.from_planes(tokens.to_planes(block)) == block


@pytest.mark.parametrize("block", [7, 65_536])
def test_round_trip(spark, tmp_path, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same"), (-5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body").withColumnRenamed("body", "text").repartition(3)
    path = str(tmp_path / f"t{block}")
    tokens.write_tokens(docs, path, PATH, 2, block=block)
    out = sorted(tokens.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(r.doc_id is not None, r.doc_id or 0) for r in out]  # ascending, nulls first
    at = 0
    wanted = collections.Counter((i, tuple([*ids(t), 2])) for i, t in rows)
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        wanted[(r.doc_id, tuple(r.ids))] -= 1
        at += r.n_tokens
    assert not +wanted and len(out) == len(rows)
    index = {(r.doc_id, r.start): r.n_tokens for r in tokens.read_index(spark, path).collect()}
    assert index == {(r.doc_id, r.start): r.n_tokens for r in out}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "e"), PATH, 2)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0
    assert packing.pack(docs, PATH, 0).count() == 0


def check_plan(histogram, plan):
    ranks, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, n, first, offset in plan.intervals:
        ranks[length].append((rank, n))
        for k in range(n):
            sequences[first + k].append((offset, length))
    for length, n in histogram.items():
        at = 0
        for rank, count in sorted(ranks[length]):
            assert rank == at
            at += count
        assert at == n
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert len(sequences) == plan.sequences


@pytest.mark.parametrize("seed", range(8))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 2048])
    histogram = collections.Counter(min(capacity - 1, max(1, int(rng.lognormvariate(6.3 if capacity > 64 else 3, 1)))) for _ in range(rng.choice([5, 300, 8000])))
    plan = packing.make_plan(dict(histogram), capacity)
    check_plan(histogram, plan)
    total = sum(k * n for k, n in histogram.items())
    large = sum(n for k, n in histogram.items() if 2 * k > capacity)
    assert plan.sequences <= 1.01 * max(-(-total // capacity), large) + 2


def test_plan_does_not_grow_with_counts():
    few, many = (packing.make_plan({k: n for k in range(1, 2048)}, 2048) for n in (10, 1_000_000))
    assert len(many.intervals) < 4 * len(few.intervals)


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "same"), (99, "many words " * 2500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 0).collect()
    wanted = collections.Counter()
    for i, t in rows:
        whole = [*ids(t), 0]
        for k in range(0, len(whole), 2048):
            piece = whole[k : k + 2048]
            wanted[(i, k // 2048, k, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == wanted
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_plans_are_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(0)
    lengths = {
        "log-normal": np.clip(np.exp(rng.normal(5.6, 0.9, 30_000)).astype(int), 1, 2047),
        "900 to 1200": rng.integers(900, 1201, 20_000),
        "1 to 2047": rng.integers(1, 2048, 20_000),
        "400 to 800": rng.integers(400, 801, 20_000),
        "below 300": rng.integers(1, 300, 20_000),
    }
    for name, x in lengths.items():
        histogram = dict(collections.Counter(x.tolist()))
        decreasing = packing.Plan(2048)
        for length in sorted(histogram, reverse=True):
            decreasing.best_fit(length, histogram[length])
        assert packing.make_plan(histogram).sequences <= 1.0005 * decreasing.sequences, name
