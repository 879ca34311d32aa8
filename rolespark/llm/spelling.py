"""Grouping of spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point makes one of the other. Each word's deletions and
replacements are hashed, not built: a word's hash is the sum of a random number for each (place, code point), so an edit
changes it by a few additions, and a batch of words has all its edits' hashes in array operations. The hashes are probed
against Bloom filters of the vocabulary, one set of filters for each word length; only the positives become strings, go
through a shuffle and meet the vocabulary in an exact join, which takes the false ones away. An insertion is the deletion
of the other word, so it need not be generated.

The filters are built in groups of at most FILTER_WORDS words of one length, 20 bits a word, and broadcast in rounds of
at most ROUND_BYTES: a larger vocabulary takes more rounds over itself, and the broadcast never grows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolespark.llm.common import materialize

#: Words of one length in one filter, and bytes of filters broadcast at once.
FILTER_WORDS, ROUND_BYTES = 1 << 18, 64 << 20
#: A block has four lanes of 64 bits; a word sets two bits in each. 12.8 words a block are 20 bits a word.
LANES, BLOCK_WORDS = 4, 12.8
#: Edits whose hashes are in memory at once, and different words that a counting task holds at once.
EDITS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def _number(place: np.ndarray, point: np.ndarray) -> np.ndarray:
    return _mix((place.astype(_U) << _U(32)) | point.astype(_U))


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def _hashes(points: np.ndarray) -> np.ndarray:
    return _number(np.arange(points.shape[1])[None, :], points).sum(axis=1, dtype=_U)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _U(40)) % _U(parts)).astype(np.int64)


def _block(h: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    return (((h & _U(0xFFFFFFFF)) * np.asarray(blocks, dtype=_U)) >> _U(32)).astype(np.int64)


def _lane(g: np.ndarray, k: int) -> np.ndarray:
    return (_U(1) << ((g >> _U(12 * k)) & _U(63))) | (_U(1) << ((g >> _U(12 * k + 6)) & _U(63)))


def _filter(h: np.ndarray) -> np.ndarray:
    """The filter of some hashes, as blocks of LANES numbers in a row."""
    blocks = int(len(h) / BLOCK_WORDS) + 1
    out = np.zeros(blocks * LANES, dtype=_U)
    at, g = _block(h, blocks) * LANES, _mix(h)
    for k in range(LANES):
        np.bitwise_or.at(out, at + k, _lane(g, k))
    return out


class Filters:
    """The filters of one word length that are in the round, one for each part of the hashes."""

    def __init__(self, parts: int, bits: dict[int, bytes]):
        data = [np.frombuffer(bits.get(k, b""), dtype=_U) for k in range(parts)]
        self._parts = parts
        self._blocks = np.array([len(x) // LANES for x in data], dtype=np.int64)
        self._base = np.concatenate([[0], np.cumsum(self._blocks)])[:-1]
        self._data = np.concatenate(data).reshape(-1, LANES)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places in h (flat) of hashes that may be in the vocabulary."""
        if self._parts == 1:
            at, block = np.arange(h.size), _block(h, self._blocks[0])
        else:
            part = _part(h, self._parts)
            at = np.flatnonzero(self._blocks[part])
            part = part[at]
            block = self._base[part] + _block(h[at], self._blocks[part])
        g = _mix(h[at])
        for k in range(LANES):
            bits = _lane(g, k)
            hit = np.flatnonzero((self._data[block, k] & bits) == bits)
            at, block, g = at[hit], block[hit], g[hit]
        return at


def count_words(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", change: Callable[[str], Callable[[str], str]] | None = None, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n, length of all words of at least so many code points and occurrences. Words are maximal runs of the character
    class pattern in whole texts, A to Z in lower case. change(key as text) gives what turns a word of that row into
    another, no longer one (as a model of typing errors does); a null key is empty.
    Null and empty texts have no words; repeated rows count each; an empty table has no words."""
    runs = re.compile(f"{pattern}{{{least_length},}}")
    upper = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}

    def lower(run: str) -> str:
        return run.lower() if run.isascii() else run.translate(upper)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for name, body in zip(batch["key"], batch["text"], strict=True):
                if not (found := runs.findall(body.as_py() or "")):
                    continue
                edit = change(name.as_py()) if change else None
                for run, n in Counter(found).items():
                    word = lower(run)
                    if edit:
                        word = edit(word)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > WORDS_AT_ONCE:
                    yield flush()
        if total:
            yield flush()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    words = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= least_count).withColumn("length", F.length("word"))


def _build_filters(vocabulary: DataFrame) -> DataFrame:
    """length, part, parts, bits for each filter."""
    # one row a word length, so it may be broadcast; a join by length would put the words of a length into one task
    sizes = F.broadcast(vocabulary.groupBy("length").agg(F.ceil(F.count("*") / FILTER_WORDS).cast("int").alias("parts")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, parts = batch["length"].to_numpy(), batch["parts"].to_numpy()
            words = batch["word"].to_pylist()
            h = np.empty(len(words), dtype=_U)
            part = np.empty(len(words), dtype=np.int32)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                h[rows] = _hashes(_points([words[r] for r in rows], int(size)))
                part[rows] = _part(h[rows], int(parts[rows[0]]))
            yield pa.RecordBatch.from_pydict({"length": batch["length"], "part": part, "parts": batch["parts"], "h": h.view(np.int64)})

    def built(rows: pa.Table) -> pa.Table:
        bits = _filter(rows["h"].to_numpy().view(_U)).tobytes()
        return pa.table({"length": rows["length"][:1], "part": rows["part"][:1], "parts": rows["parts"][:1], "bits": pa.array([bits], pa.binary())})

    hashes = vocabulary.join(sizes, "length").select("word", "length", "parts").mapInArrow(hashed, "length int, part int, parts int, h long")
    return hashes.groupBy("length", "part", "parts").applyInArrow(built, "length int, part int, parts int, bits binary")


def _positives(words: list[str], length: int, letters: np.ndarray, same: Filters | None, shorter: Filters | None) -> Iterator[tuple[int, str, bool]]:
    """(number of the word, edit, whether it is a deletion) for the edits of words of one length that the filters hold."""
    points = _points(words, length)
    at_once = max(1, EDITS_AT_ONCE // max(1, len(words) * len(letters)))
    total = _hashes(points)
    own = _number(np.arange(length)[None, :], points)
    if same is not None:
        for first in range(0, length, at_once):
            places = np.arange(first, min(first + at_once, length))
            h = (total[:, None] - own[:, places])[:, :, None] + _number(places[:, None], letters[None, :])[None]
            w, i, a = np.unravel_index(same.holds(h.reshape(-1)), h.shape)
            other = points[w, places[i]] != letters[a]
            for x, y, z in zip(w[other].tolist(), places[i[other]].tolist(), letters[a[other]].tolist(), strict=True):
                yield x, words[x][:y] + chr(z) + words[x][y + 1 :], False
    if shorter is not None:
        before = np.cumsum(own, axis=1, dtype=_U) - own
        moved = _number(np.arange(length - 1)[None, :], points[:, 1:])
        after = np.zeros_like(own)
        after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=_U)[:, ::-1]
        h = before + after
        w, i = np.unravel_index(shorter.holds(h.reshape(-1)), h.shape)
        once = (i == 0) | (points[w, i] != points[w, i - 1])  # of equal neighbours the first one goes
        for x, y in zip(w[once].tolist(), i[once].tolist(), strict=True):
            yield x, words[x][:y] + words[x][y + 1 :], True


def _rounds(filters: DataFrame) -> list[list[tuple[int, int]]]:
    """The filters' (length, part), dealt to rounds of at most ROUND_BYTES. One row a filter comes to the driver."""
    rounds, size = [[]], 0
    for row in filters.select("length", "part", F.length("bits").alias("size")).orderBy("length", "part").collect():
        if rounds[-1] and size + row["size"] > ROUND_BYTES:
            rounds.append([])
            size = 0
        rounds[-1].append((row["length"], row["part"]))
        size += row["size"]
    return rounds


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: each ordered pair of near words. vocabulary: word (each once), n, length."""
    spark = vocabulary.sparkSession
    filters = materialize(_build_filters(vocabulary), "filters")
    letters = np.array(sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.split("word", ""))).filter("col <> ''").distinct().collect()), dtype=np.int64)
    found = None
    for chosen in _rounds(filters):
        lengths = sorted({length for length, _ in chosen})
        rows = filters.filter(F.col("length").between(lengths[0], lengths[-1])).collect() if chosen else []
        wanted, bits, parts = set(chosen), {}, {}
        for r in rows:
            if (r["length"], r["part"]) in wanted:
                bits.setdefault(r["length"], {})[r["part"]] = bytes(r["bits"])
                parts[r["length"]] = r["parts"]
        sent = spark.sparkContext.broadcast((bits, parts))

        def probed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bits, parts = sent.value
            ready = {length: Filters(parts[length], of) for length, of in bits.items()}
            for batch in batches:
                length, words, n = batch["length"].to_numpy(), batch["word"].to_pylist(), batch["n"].to_pylist()
                for size in np.unique(length).tolist():
                    rows = np.flatnonzero(length == size)
                    step = max(1, EDITS_AT_ONCE // max(size, 2 * len(letters)))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step].tolist()
                        hits = list(_positives([words[r] for r in some], size, letters, ready.get(size), ready.get(size - 1)))
                        if hits:
                            of, edit, deleted = zip(*hits, strict=True)
                            yield pa.RecordBatch.from_pydict({"word": [words[some[k]] for k in of], "n": [n[some[k]] for k in of], "near": list(edit), "deleted": list(deleted)})

        asked = vocabulary.filter(F.col("length").between(lengths[0], lengths[-1] + 1)) if chosen else vocabulary.limit(0)
        part = asked.select("word", "n", "length").mapInArrow(probed, "word string, n long, near string, deleted boolean")
        found = part if found is None else found.unionByName(part)
    exact = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    one = F.struct(F.col("word"), F.col("near"), F.col("near_n"))
    other = F.when(F.col("deleted"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return exact.select(F.explode(F.array_compact(F.array(one, other))).alias("p")).select("p.*")


def group_variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n. vocabulary: word, n (rows of one word are added up, null words left out).
    A word's form is its near word of largest n (ties: the first in code-point order) if that n is at least ratio (over 1)
    times its own, else null; its root is where the forms lead, or the word itself. No near words: n_near is 0. An empty
    vocabulary gives an empty result; other columns are left out."""
    words = vocabulary.filter("word is not null and word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.withColumn("length", F.length("word")).orderBy("length", "word"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    led = -F.col("best.minus") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.minus")).alias("form_n")
    )
    joined = materialize(joined, "forms")
    roots = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each turn doubles the steps; n grows by ratio at each step, so few turns suffice
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    done = joined.join(roots.select("word", "root"), "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
