"""Interpolated modified Kneser-Ney language model (bigrams over words), counted in Spark.

Words are 64-bit hashes, a bigram is the upper halves of its two words' hashes. Counting tasks add up what they read and
send it, packed, to shards by the hash of the key; each shard is added up in one task and stored as arrays sorted by
hash, in files of the shared folder that scoring tasks map into memory. Statistics of contexts and continuations are
added up from the shards in the same way. The driver sees a handful of sums only.

Two words share a place in the bigram part with probability (distinct words) / 2**32; word counts use all 64 bits."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolespark.llm.common import materialize, scratch

END, START = b"\n", b"\r"  # white space, so no word is equal to them
#: Tokens that a task gathers before it adds them up and sends them on.
GATHER = 2_000_000
CACHE_WORDS = 400_000
STATS = ("total", "n1", "n2", "n3", "preceding")  # of a context: its count, followers seen once, twice, more; of a word: words before it


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end of the text."""
    return [*text.encode().lower().split(), END] if text else [END]


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns (the first ascending) as zstandard-compressed byte planes of its differences and the others."""
    first = columns[0].astype(np.uint64)
    planes = [np.diff(first, prepend=np.uint64(0)), *(c.astype(np.uint32) for c in columns[1:])]
    raw = b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in planes)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, n: int, more: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)

    def plane(at: int, width: int, kind) -> np.ndarray:
        return np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel()

    return [np.cumsum(plane(0, 8, np.uint64), dtype=np.uint64), *(plane(n * (8 + 4 * k), 4, np.uint32) for k in range(more))]


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of each value."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
    return [keys[starts], *(np.add.reduceat(v[order].astype(np.int64), starts) if len(keys) else v for v in values)]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def split(keys: np.ndarray, columns: list[np.ndarray], shards: int) -> Iterator[tuple[int, int, bytes]]:
    """(shard, rows, packed rows) of ascending keys."""
    place = shard_of(keys, shards)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(shards + 1))
    for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        rows = order[bounds[s] : bounds[s + 1]]
        yield s, len(rows), pack(keys[rows], *(c[rows] for c in columns))


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array under its final name at once, so a task that runs twice leaves one whole file."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        os.makedirs(url.path, exist_ok=True)
        part = f"{url.path}/.{name}.{os.getpid()}.{os.urandom(4).hex()}.npy"
        np.save(part, array)
        os.replace(part, f"{url.path}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    held = io.BytesIO()
    np.save(held, array)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}.npy") as out:
        out.write(held.getvalue())


def load(folder: str, name: str) -> np.ndarray:
    """Maps a stored array into memory; from a store without local paths it is read instead."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = f"{url.path}/{name}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, dtype=np.uint64)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{name}.npy").type != fs.FileType.File:
        return np.empty(0, dtype=np.uint64)
    with store.open_input_stream(f"{path}/{name}.npy") as source:
        return np.load(io.BytesIO(source.read()))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries seen one to four times; where a formula has no basis or
    leaves its range, half of the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    pairs = ((n1, n2), (n2, n3), (n3, n4))
    found = [k - (k + 1) * y * b / a if a and b else k / 2 for k, (a, b) in enumerate(pairs, start=1)]
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, start=1))


@dataclass
class Model:
    folder: str
    shards: int  # of words and of pairs
    stat_shards: int
    tokens: int
    vocabulary: int
    types: int  # distinct bigrams
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_rest: float  # mass of the continuation distribution that goes to the uniform one


PACKED = "kind string, shard int, n int, blob binary, sums array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=["kind", "shard", "n", "blob", "sums"])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all texts of docs (null: empty) and stores the model in the shared folder."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, stat_shards, folder = 2 * parts, max(4, parts // 8), scratch(spark, "kneser-ney")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {START: xxhash.xxh64_intdigest(START)}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            start = np.uint64(xxhash.xxh64_intdigest(START))
            upper = h >> np.uint64(32)
            pairs = (upper[:-1] << np.uint64(32)) | upper[1:]
            inner = h[1:] != start  # no pair ends in a start mark
            rows = []
            for kind, keys in (("pair", pairs[inner]), ("word", h[h != start])):
                keys, n = np.unique(keys, return_counts=True)
                rows += [(kind, s, m, blob, None) for s, m, blob in split(keys, [n], shards)]
            return _rows(rows)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if len(cache) > CACHE_WORDS:
                    cache = {START: cache[START]}
                for w in words:
                    if w not in cache:
                        cache[w] = xxhash.xxh64_intdigest(w)
                h = np.empty(len(words) + 1, dtype=np.uint64)
                h[0] = cache[START]
                h[1:] = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
                held.append(h)
                size += len(h)
                if size >= GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, shard, blobs in _by_shard(batches, 1):
            keys, n = sum_by_key(np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs]))
            save(folder, f"{kind}-{shard}-keys", keys)
            save(folder, f"{kind}-{shard}-counts", np.minimum(n, 65535).astype(np.uint16))
            if (over := n >= 65535).any():
                save(folder, f"{kind}-{shard}-large", np.stack([keys[over], n[over].astype(np.uint64)]))
            if kind == "word":
                yield _rows([("word", shard, 0, None, [len(keys), int(n.sum()), 0, 0, 0])])
                continue
            before, after = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            zero = np.zeros(len(keys), dtype=np.int64)
            sums = sum_by_key(
                np.concatenate([before, after]), *(np.concatenate([v, zero]) for v in (n, n == 1, n == 2, n > 2)), np.concatenate([zero, zero + 1])
            )
            rows = [("pair", shard, 0, None, [*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(keys)])]
            yield _rows(rows + [("stats", s, m, blob, None) for s, m, blob in split(sums[0], sums[1:], stat_shards)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, blobs in _by_shard(batches, len(STATS)):
            keys, *columns = sum_by_key(np.concatenate([b[0] for b in blobs]), *(np.concatenate([b[k] for b in blobs]) for k in range(1, len(STATS) + 1)))
            save(folder, f"stats-{shard}-keys", keys)
            save(folder, f"stats-{shard}-values", np.stack(columns).astype(np.float64))
            preceding = columns[-1]
            yield _rows([("stats", shard, 0, None, [*(int((preceding == k).sum()) for k in (1, 2, 3, 4)), int((preceding > 2).sum())])])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, PACKED)
    dealt = counted.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard")
    added = materialize(dealt.mapInArrow(add, PACKED), "kn-counts")
    stats = added.filter("kind = 'stats'").repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard")
    merged = materialize(stats.mapInArrow(merge, PACKED).select("kind", "sums"), "kn-stats")
    sums = added.filter("sums is not null").select("kind", "sums").unionByName(merged)
    totals = sums.groupBy("kind").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(5)])
    found = {r["kind"]: [int(r[f"s{k}"]) for k in range(5)] for r in totals.collect()}  # three rows
    word, pair, low = found.get("word", [0] * 5), found.get("pair", [0] * 5), found.get("stats", [0] * 5)
    d = discounts(low[:4])
    rest = (d[0] * low[0] + d[1] * low[1] + d[2] * low[4]) / pair[4] if pair[4] else 1.0
    return Model(folder, shards, stat_shards, word[1], word[0], pair[4], discounts(pair[:4]), d, rest)


def _by_shard(batches: Iterator[pa.RecordBatch], more: int) -> Iterator[tuple[str, int, list[list[np.ndarray]]]]:
    """The unpacked rows of each (kind, shard) of a sorted partition."""
    key, held = None, []
    for batch in batches:
        for kind, shard, n, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "n", "blob")), strict=True):
            if (kind, shard) != key:
                if held:
                    yield *key, held
                key, held = (kind, shard), []
            held.append(unpack(blob, n, more))
    if held:
        yield *key, held


class Scorer:
    """Looks words and pairs up in the mapped arrays; one in each worker. What is known of a word is kept for a bounded
    number of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.count = np.empty(0)
        self.upper = np.empty(0, dtype=np.uint64)
        self.total, self.rest, self.low = np.empty(0), np.empty(0), np.empty(0)
        self._learn([START, END])

    def _find(self, kind: str, keys: np.ndarray, value: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in keys, rows in the shard, the shard's values) for the keys that are there; keys ascending."""
        shards = self.model.stat_shards if kind == "stats" else self.model.shards
        place = shard_of(keys, shards)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(shards + 1))
        for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            mine = order[bounds[s] : bounds[s + 1]]
            stored = load(self.model.folder, f"{kind}-{s}-keys")
            if not len(stored):
                continue
            row = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
            hit = stored[row] == keys[mine]
            if hit.any():
                yield s, mine[hit], row[hit], load(self.model.folder, f"{kind}-{s}-{value}")

    def counts(self, kind: str, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        for s, at, row, values in self._find(kind, keys, "counts"):
            out[at] = values[row]
            if (over := out[at] == 65535).any():
                large = load(self.model.folder, f"{kind}-{s}-large")
                out[at[over]] = large[1][np.searchsorted(large[0], keys[at[over]])].astype(np.int64)
        return out

    def _learn(self, words: list[bytes]) -> None:
        m = self.model
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        for w in words:
            self.number[w] = len(self.number)
        order = np.argsort(h)
        count = np.zeros(len(h), dtype=np.int64)
        count[order] = self.counts("word", h[order])
        upper = h >> np.uint64(32)
        order = np.argsort(upper)
        stats = np.zeros((len(STATS), len(h)))
        for _, at, row, values in self._find("stats", upper[order], "values"):
            stats[:, order[at]] = values[:, row]
        total, n1, n2, n3, preceding = stats
        seen = total > 0
        rest = np.ones(len(h))
        rest[seen] = ((m.high[0] * n1 + m.high[1] * n2 + m.high[2] * n3) / np.where(seen, total, 1))[seen]
        d = np.array([0.0, *m.low])[np.minimum(preceding, 3).astype(np.int64)]
        low = (preceding - d) / max(1, m.types) + m.low_rest / (m.vocabulary + 1)
        for name, new in (("count", count), ("upper", upper), ("total", total), ("rest", rest), ("low", low)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        if len(self.number) > CACHE_WORDS:
            self._clear()
        m = self.model
        split_texts = [words_of(t) for t in texts]
        fresh = {w for words in split_texts for w in words if w not in self.number}
        if fresh:
            self._learn(list(fresh))
        sizes = np.array([len(w) for w in split_texts])
        get = self.number.__getitem__
        ids = np.fromiter((i for words in split_texts for i in map(get, words)), dtype=np.int64, count=int(sizes.sum()))
        firsts = np.cumsum(sizes) - sizes
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[firsts] = self.number[START]
        keys, back = np.unique((self.upper[before] << np.uint64(32)) | self.upper[ids], return_inverse=True)
        c = self.counts("pair", keys)
        less = (c - np.array([0.0, *m.high])[np.minimum(c, 3)])[back]
        p = less / np.maximum(self.total[before], 1) + self.rest[before] * self.low[ids]
        known = self.count[ids] > 0
        base = np.log10((self.count[ids] + 1) / (m.tokens + m.vocabulary + 1))
        return sizes, np.add.reduceat(known.astype(np.int64), firsts), np.add.reduceat(base, firsts), np.add.reduceat(np.log10(p), firsts)


def score(docs: DataFrame, model: Model, held_out: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text, held_out).

    A null or empty text is its end alone. Words not seen in training share one place of the uniform part. A model of no
    text gives every token 1 / (words + 1). Rows are scored each by itself; other columns are not read."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 6_000_000:
                    size += len(texts[end] or "")
                    end += 1
                n, known, base, full = scorer(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(full)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                at = end

    rows = docs.select(F.col("doc_id").cast("long"), F.col(held_out).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(tell, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
