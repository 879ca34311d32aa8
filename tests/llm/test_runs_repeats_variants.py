"""Periodic runs, repeated strings and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from rolespark.llm import periodic_runs, queries, repeats, spelling

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, found string, runs long, n long"


def documents(spark, path, texts, ids=None):
    """A table of documents with columns whose names the operators use themselves."""
    rows = [(k, t, "en", "src", len(t or ""), "x", 1, 2) for k, t in zip(ids or range(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(i - q + p, j)) for p in range(1, q)):
                found.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_op13(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng):
    n, letters = rng.choice([0, 3, 20, 60, 150]), rng.choice([1, 2, 2, 3, 6])
    w = [rng.choice("abcdefß")[:1] * rng.randint(1, 1 + letters % 3) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            s, p = rng.randrange(n), rng.randint(1, 12)
            for i in range(s + p, min(n, s + p * rng.randint(2, 9))):
                w[i] = w[i - p]
    return w


def test_periodic_runs_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    spaces = [" ", "\n", "\t", "  ", " \x0b", "\x0c", "\r\n"]
    texts = ["".join(x + rng.choice(spaces) for x in random_words(rng)) for _ in range(300)]
    texts += [None, "", " \n", "a\x1cb a\x1cb", " lead a a a a a a", "a a a a a", "é é " * 9, "x " * 3000, texts[3], texts[3]]
    ids = [*range(len(texts) - 2), 7, None]
    path = documents(spark, tmp_path, texts, ids)
    found = queries.op13_periodic_run_detection(spark, path)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in found.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    want = [plain_op13(k, t) for k, t in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 100


def test_periodic_runs_of_an_empty_table(spark, tmp_path):
    assert queries.op13_periodic_run_detection(spark, documents(spark, tmp_path, [])).count() == 0


def test_runs_and_collapsed_text(spark):
    found = spark.createDataFrame([("say it say it say it say it now",)], "text string").select(periodic_runs.detect("text").alias("r")).first().r
    assert ([tuple(x) for x in found.runs], found.collapsed) == ([(0, 8, 2)], "say it now")


def plain_vocabulary(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                counts[word] = counts.get(word, 0) + 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, found = {}, {}
    for w, n in counts.items():
        mates = [x for x in counts if near(w, x)]
        best = min(mates, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best
        found[w] = len(mates)
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, found[w], counts[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("small_filters", [False, True])
def test_spelling_variants_against_brute_force(spark, tmp_path, monkeypatch, small_filters):
    """Also with many small filters in many rounds."""
    if small_filters:
        monkeypatch.setattr(spelling, "FILTER_WORDS", 20)
        monkeypatch.setattr(spelling, "ROUND_BYTES", 400)
        monkeypatch.setattr(spelling, "EDITS_AT_ONCE", 500)
    rng = random.Random(9)
    base = ["".join(rng.choice("abéßcAÀ÷") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    pool = base * 30
    for word in base * 8:
        for _ in range(rng.choice([1, 1, 2])):
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abéé") + word[i:], word[:i] + rng.choice("abc") + word[i + 1 :]])
        pool += [word] * rng.choice([1, 4, 6, 40])
    long = "ab" * 2000
    pool += [long] * 30 + [long[1:]] * 5 + ["aaaaaa"] * 60 + ["aaaaaaa"] * 9 + ["qqqqqq"] * 400 + ["qqqqqqr"] * 60 + ["qqqqqqrs"] * 7
    rng.shuffle(pool)
    texts = [" 1".join(pool[k::200]) for k in range(200)] + [None, "", "short é", "x" * 400]
    ids = [*range(200), 5, None, 6, None]
    counts = plain_vocabulary(zip(ids, texts, strict=True))
    found = queries.op11_spelling_variant_grouping(spark, documents(spark, tmp_path, texts, ids))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(counts)
    assert {tuple(r) for r in found.collect()} == want
    assert len(want) > 80 and any(r[1] and r[1] != r[2] for r in want)


def test_spelling_variants_of_an_empty_table(spark, tmp_path):
    assert queries.op11_spelling_variant_grouping(spark, documents(spark, tmp_path, [None])).count() == 0


def test_variants_follow_forms_to_the_last(spark):
    rows = [("abcdef" + "x" * k, 5**k) for k in range(6)] + [(None, 3), ("abcdef", 0)]
    found = {r.word: (r.form, r.root) for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found["abcdef"] == ("abcdefx", "abcdefxxxxx") and found["abcdefxxxxx"] == (None, "abcdefxxxxx")


def plain_repeats(texts, least):
    """Per text: removed stretches and the kept bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\x01" * least
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((len(t), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


def repeating_texts(rng, size, n):
    """Texts of few letters with shared passages, copies, near copies and repetition inside."""
    letters = "abcdeé \n"
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [make(rng.randint(size // 2, 3 * size)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [make(rng.randint(0, size))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            i = rng.randint(0, len(passage) // 4)
            parts += [passage[i : rng.randint(len(passage) // 2, len(passage))], make(rng.randint(0, size))]
        texts.append("".join(parts))
    for _ in range(n // 5):
        t = rng.choice(texts)
        i = rng.randint(0, len(t))
        texts += [t, t[:i] + "x" + t[i + 1 :]]
    return [*texts, None, "", "a" * (5 * size), "ab" * (2 * size), make(3) * size, "é" * size]


@pytest.mark.parametrize("shard", [1000, 4])
def test_repeats_against_brute_force(spark, tmp_path, monkeypatch, shard):
    """Also with anchors that are split over shards, and with segments and parts of texts that are cut short."""
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", shard)
    if shard < 1000:
        monkeypatch.setattr(repeats, "RANGE_FINGERPRINTS", 2000)
    rng = random.Random(shard)
    texts = repeating_texts(rng, 400, 60)
    ids = [*range(len(texts) - 3), 3, 3, None]
    found = queries.op12_suffix_array_dedup(spark, documents(spark, tmp_path, texts, ids))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(k, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, spans, kept) in zip(ids, plain_repeats(texts, 400), strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sum(0 < r[2] < r[1] for r in want) > 20


@pytest.mark.parametrize("least", [10, 33, 70])
def test_repeats_keep_the_table_and_take_any_length(spark, tmp_path, least):
    rng = random.Random(least)
    texts = repeating_texts(rng, least, 80)
    docs = spark.read.parquet(documents(spark, tmp_path, texts) + "/documents.parquet")
    found = repeats.remove_repeats(docs.select("*", docs.lang.alias("k"), docs.lang.alias("_spans")), least=least)
    rows = {r._row.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in found.collect()}
    assert [f.name for f in found.schema["_row"].dataType] == [*docs.columns, "k", "_spans"]
    assert [rows[k] for k in range(len(texts))] == [(spans, kept) for _, spans, kept in plain_repeats(texts, least)]


def test_repeats_of_an_empty_table(spark, tmp_path):
    assert queries.op12_suffix_array_dedup(spark, documents(spark, tmp_path, [])).count() == 0


def test_segments_are_all_windows(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT_WINDOWS", 50)
    monkeypatch.setattr(repeats, "TEXT_BYTES", 1000)
    rng = random.Random(3)
    for data in (b"", b"x" * 399, b"x" * 400, b"ab" * 3000, bytes(rng.choice(b"abc") for _ in range(9000))):
        start, count, anchor, twice = repeats.segments(data, 400)
        assert [i for s, c in zip(start.tolist(), count.tolist(), strict=True) for i in range(s, s + c)] == list(range(max(0, len(data) - 399)))
        assert len(anchor) == len(start) == len(twice) and (count <= 50).all()
        windows = [data[i : i + 400] for i in range(max(0, len(data) - 399))]
        assert all(t for s, c, t in zip(start.tolist(), count.tolist(), twice.tolist(), strict=True) if len(set(windows[s : s + c])) < c)
