"""The similarity join and decontamination against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolespark.llm import decontaminate, ngram_join


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus():
    """Random texts, chains of edited copies, exact copies, a passage that many share, and odd rows."""
    rng = random.Random(4)
    texts = []
    passage = " ".join(prose(rng, 60))
    for _ in range(12):
        words = prose(rng, rng.randint(30, 300))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(prose(rng, 80)) for _ in range(15)]
    texts += ["A b C", "a B c", "a b", None, "", "  ", texts[0], texts[0].upper(), "one two three four five"]
    return list(enumerate(texts)) + [(None, texts[0]), (0, "another text under a used id"), (1, texts[1])]


def brute(rows, threshold=0.8):
    shingler = ngram_join.Shingler()
    sets = [set(shingler(t).tolist()) for _, t in rows]
    links = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b):
                links[i].add(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        part, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in part if rows[j][0] is not None]
        out.append((doc_id, min(ids) if len(part) > 1 else doc_id, len(links[i])))
    return collections.Counter(out)


@pytest.mark.parametrize("options", [{}, {"small": 3, "depth": 2, "block": 5, "recall": 0.9999}])
def test_join_is_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash")).repartition(4)
    got = ngram_join.near_duplicates(docs, **({"recall": 0.999} | options)).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_recall_of_crowded_pairs(spark):
    """Default recall and depth: a text that others contain, just at the threshold, and nodes too large to be compared
    before the last level."""
    assert [ngram_join.runs_for(ngram_join.RECALL, depth) for depth in (1, 2, 3)] == [5, 8, 10]
    texts, groups = [], 600
    for g in range(groups):
        inner = [f"g{g}i{k}" for k in range(84)]  # 80 shingles
        texts += [" ".join(inner)] + [" ".join(inner + [f"g{g}t{b}e{k}" for k in range(20)]) for b in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = ngram_join.near_duplicates(docs, small=2).collect()
    assert len(rows) == len(texts) and max(r.n_links for r in rows) == 2
    assert sum(r.n_links for r in rows) >= 0.98 * 4 * groups


def test_pairs_with_a_common_passage(spark):
    """Default settings: a fifth to nearly all of each text is a passage that all share; linked pairs are found all the same."""
    rng = random.Random(11)
    passage, texts, pairs = [f"p{k}" for k in range(60)], [], 400
    for g in range(pairs):
        own = [f"g{g}w{k}" for k in range(rng.choice([20, 40, 60, 120, 240]))]
        texts.append(" ".join(passage + own))
        texts.append(" ".join(passage + own + [f"g{g}e{k}" for k in range((len(own) + 56) // 4 - 4)]))  # just above the threshold
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    common = ngram_join.common_shingles(docs, 512, 5)
    assert set(common) == set(ngram_join.Shingler()(" ".join(passage)).tolist())
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    assert sum(rows[2 * g].class_id == rows[2 * g + 1].class_id for g in range(pairs)) >= 0.98 * pairs


def test_shingles_of_a_batch():
    texts = ["A b  c D\ne f G", None, "", " \t", "a b c d e", "x", "\u00c4 \u00e4", "a b c d e f a b c d e", "ab c d e f", "abcdef" * 50, "word " * 9]
    shingler = ngram_join.Shingler()
    shingler.WINDOW = 7
    for found, text in zip(shingler.batch(pa.array(texts)), texts, strict=True):
        words = (text or "").lower().split()
        n = min(5, len(words))
        want = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
        assert len(found) == len(want) and (found == ngram_join.Shingler()(text)).all() and (np.diff(found) > 0).all() if want else not len(found)
    same = list(shingler.batch(pa.array(["A b c d e", "a B c d e", "b a c d e", "a b", "b a", "ab"])))
    assert len({s[0] for s in same}) == 5 and same[0] == same[1]


def test_sampling_expects_a_shared_shingle():
    """For linked sets the shingles that both sample number one at least on average, whatever they have in common with others."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        u = rng.permutation(500).astype(np.uint64)[: rng.integers(20, 500)]
        cut = rng.integers(0, len(u) // 5 + 1)
        a = rng.integers(0, cut + 1)
        x, y = np.sort(u[: len(u) - a]), np.sort(u[cut - a :])
        common = np.sort(rng.permutation(500).astype(np.uint64)[: rng.integers(0, 500)])
        p, q = (ngram_join.sampling(ngram_join.common_of(s, common), 0.8).astype(float) / 2**64 for s in (x, y))
        both, i, j = np.intersect1d(x, y, return_indices=True)
        assert len(both) >= 0.8 * len(u) - 1e-9 and np.minimum(p[i], q[j]).sum() >= 1 - 1e-6


def test_a_large_group_of_near_copies(spark):
    """Members near their centre are counted without comparison; a few stand apart from it, and have links of their own."""
    rng = random.Random(12)
    base, texts = [f"b{k}" for k in range(200)], []
    for k in range(4000):
        words = list(base)
        for _ in range(1 if k % 100 else 3):
            words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    shingler = ngram_join.Shingler()
    sets = [shingler(t) for t in texts]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    matrix = np.zeros((len(sets), column.max() + 1), dtype=np.float32)
    matrix[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    shared, size = matrix @ matrix.T, np.array([len(s) for s in sets])
    want = (shared * 1.8 >= 0.8 * (size[:, None] + size[None, :]) - 1e-6).sum(axis=1) - 1
    got = np.array([rows[k].n_links for k in range(len(texts))])
    assert 0 < want.min() and (got <= want).all() and got.sum() >= 0.995 * want.sum()
    assert {r.class_id for r in rows.values()} == {0}


def shuffled(spark, make):
    """Bytes that the stages of make() shuffle."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = written()
    make()
    return written() - before


def test_a_crowd_does_not_deal_the_other_documents_again(spark):
    """A node too large to be compared at once: what is done for it moves its own members, not all steps of all documents."""
    rng = random.Random(13)
    base = prose(rng, 60)
    texts = [" ".join(prose(rng, 60)) for _ in range(6000)] + [" ".join(base + [f"e{k}"]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {}
        size = {small: shuffled(spark, lambda n=small: found.update({n: ngram_join.near_duplicates(docs, small=n, depth=1).collect()})) for small in (512, 8)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
        docs.unpersist()
    assert sorted(found[8]) == sorted(found[512]) and sum(r.n_links for r in found[8]) == 40 * 39
    assert size[8] < 1.15 * size[512], size


def test_members_without_a_partner_of_their_size_leave_a_node(spark):
    sizes = {1: [100, 79], 2: [100, 80], 3: [10, 20, 30, 33], 4: [5, 5, 50], 5: [1, 2, 4], 6: [64, 80, 100, 126]}
    rows = [(node, 10 * node + k, n) for node, found in sizes.items() for k, n in enumerate(found)]
    kept = ngram_join._with_partners(spark.createDataFrame(rows, "node long, class_no long, size long"), 0.8).collect()
    assert sorted(map(tuple, kept)) == [(2, 20, 100), (2, 21, 80), (3, 32, 30), (3, 33, 33), (4, 40, 5), (4, 41, 5), (6, 60, 64), (6, 61, 80), (6, 62, 100)]


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = ngram_join.keep_one(docs, recall=0.999)
    assert kept.columns == docs.columns
    classes = {(r[0], r[1]) for r in brute(rows) if r[0] is not None}
    have = [r.doc_id for r in kept.collect()]
    assert set(have) - {None} == {i for i, c in classes if i == c}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def test_keep_one_of_ids_that_are_used_twice(spark):
    a, b, other = (" ".join(f"{x}{k}" for k in range(30)) for x in "aBc")
    rows = [(3, a, "x"), (5, b, "y"), (5, a, "z"), (7, other, "2"), (7, other, "1"), (9, other + " more", "3"), (None, a, "n"), (7, None, "w"), (7, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(3, a, "x"), (5, b, "y"), (7, other, "1"), (None, a, "n"), (7, None, "w"), (7, None, "w")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5)]
    out = ngram_join.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.id, r.root) for r in out.collect()} == {(i, 0) for i in range(1, 31)} | {(100 + i, 100) for i in range(1, 20)}


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def plain_distance(pattern, text):
    """Short items have no edits and keep to words; one word is a whole document."""
    if len(pattern) >= decontaminate.SHORT_CHARS:
        return edit_distance_inside(pattern, text)
    words = re.search(rf"(?<![^\W_]){re.escape(pattern)}(?![^\W_])", text) if " " in pattern else pattern == text
    return 0 if words else len(pattern)


def test_short_items_remove_what_the_rule_names(spark):
    items = [(1, "a"), (2, "the"), (3, "New  York"), (4, "x + y"), (5, "A"), (6, "seventeen letters")]
    texts = {10: "a cat on the mat in town", 11: "A", 12: " the\n", 13: "old new york town", 14: "renew york", 15: "new yorker", 16: "so x + y!", 17: "x + yy", 18: "seventeen lettres", 19: "", 20: None, 21: "seventeen letters"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert found == {(11, 1), (11, 5), (12, 2), (13, 3), (16, 4), (21, 6)}
    assert {r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()} == {10, 14, 15, 17, 18, 19, 20}


def test_matches_are_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, rng.randint(1, 30)))) for k in range(8)] + [(8, None), (9, " "), (10, "Zz"), (0, "second text of an id in use, long enough")]
    texts = []
    for _ in range(60):
        words = list(rng.choice([t for _, t in items if t and len(t) > 3]))
        for _ in range(rng.randint(0, max(1, len(words) // 9))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "7"])
        texts.append(" ".join(prose(rng, 5)) + " " + "".join(words).upper() + "\n" + " ".join(prose(rng, 5)))
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (70, None), (71, ""), (72, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for doc_id, text in rows:
        t = decontaminate.normalized(text or "")
        for item_id, item in items:
            p = decontaminate.normalized(item or "")
            if p and t and (d := plain_distance(p, t)) <= int(decontaminate.ERROR * len(p)):
                want[(doc_id, item_id, d)] += 1
    for chars in (decontaminate.BLOCK_CHARS, 200):  # also in blocks
        got = decontaminate.matches(docs, bench, block_chars=chars).collect()
        assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got) == want and want
    clean = decontaminate.remove_leaks(docs, bench)
    dirty = {(i, t) for i, t in rows if any(decontaminate.Matcher(items[:8] + items[10:], decontaminate.ERROR).find(t or ""))}
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(r for r in rows if r not in dirty)
    assert decontaminate.matches(docs.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_default_budget_is_a_tenth(spark):
    rng = random.Random(9)
    item = "".join(rng.choices("abcdefghijklmnopqrst", k=250))
    rows = []
    for edits in (0, 21, 25, 26):
        text = list(item)
        for k in range(edits):
            text[k * 250 // edits + 3] = "z"
        rows.append((edits, "before " + "".join(text) + " after"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.distance) for r in decontaminate.matches(docs, bench).collect()) == [(0, 0), (21, 21), (25, 25)]
    assert [r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()] == [26]
