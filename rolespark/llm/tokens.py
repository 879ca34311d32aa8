"""Token ids by a public tokenizer, and a binary file format of byte planes with a chunk index."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolespark.llm.common import scratch

#: Ids in a block; every block is transposed and compressed by itself.
BLOCK = 65_536
ID_BYTES = 4


class WordEncoder:
    """Encodes texts word by word, each word once as long as it is in a bounded cache. The tokenizer drops white space and
    never joins across it, so the ids of a text are those of its words, one after the other (tests compare with
    whole-text encoding). Arrow finds the distinct words of a batch; the ids are gathered as arrays."""

    def __init__(self, path: str, cache_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._bound = cache_words
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._ids = np.empty(0, dtype="<u4")
        self._starts = np.zeros(1, dtype=np.int64)  # of each word's ids; the last is the end

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self._number) > self._bound:
            self._clear()
        known = self._number
        if missing := [w for w in words if w not in known]:
            fresh, sizes = [], []
            for at in range(0, len(missing), 4096):
                found = [e.ids for e in self._tokenizer.encode_batch_fast(missing[at : at + 4096], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
                fresh.append(np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(sizes[-1].sum())))
            known.update(zip(missing, range(len(known), len(known) + len(missing)), strict=True))
            self._ids = np.concatenate([self._ids, *fresh])
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.concatenate(sizes))])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    @staticmethod
    def _strings(words: pa.Array) -> list[str]:
        """No word holds a blank, so one string of all of them, split, is much cheaper than a conversion of each."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], type=pa.int32()), words), " ")[0].as_py().split(" ")

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        each = words.flatten().dictionary_encode()
        number = self._numbers(self._strings(each.dictionary))[each.indices.to_numpy()] if len(each) else np.empty(0, dtype=np.int64)
        starts, sizes = self._starts[number], self._starts[number + 1] - self._starts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[words.offsets.to_numpy()]

    def __call__(self, texts: pa.Array, characters: int = 6_000_000) -> Iterator[bytes]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, size[at] + characters, side="right")) - 1)
            ids, bounds = self._encode(texts.slice(at, end - at))
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield ids[first:last].tobytes()
            at = end


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder for each worker process, so its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def to_planes(ids: bytes) -> list[bytes]:
    """A block of ids as zstandard-compressed byte planes, lowest byte first."""
    planes = np.frombuffer(ids, dtype=np.uint8).reshape(-1, ID_BYTES).T
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes]) -> bytes:
    unpack = zstandard.ZstdDecompressor()
    return np.stack([np.frombuffer(unpack.decompress(p), dtype=np.uint8) for p in planes]).T.tobytes()


#: One row a block: shard and block number, ids, the documents that begin in it (with their place in the shard), planes.
CHUNK_SCHEMA = (
    "shard int, block int, first_id long, n_ids int, first_doc long, doc_ids array<long>, doc_starts array<long>, "
    "doc_lens array<long>, planes array<binary>"
)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Writes the ids of all documents, in ascending order of id_col, to a folder of Parquet files whose rows are the
    blocks of CHUNK_SCHEMA: shard n holds the n-th range of documents, blocks follow each other in it, a document may
    run over several blocks. Rows with equal ids stand by the hash of their text; null ids come first; a null text is
    just the end id. An empty table leaves a folder without blocks; other columns are not read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = encoder_for(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        buffer, buffered = [], 0
        written = number = doc = first_doc = 0
        starts: list[tuple[int | None, int, int]] = []

        def rows(ids: bytes) -> pa.RecordBatch:
            n = len(ids) // ID_BYTES
            begun = [s for s in starts if s[1] < written + n]
            values = [[shard], [number], [written], [n], [first_doc], [[s[0] for s in begun]], [[s[1] for s in begun]], [[s[2] for s in begun]], [to_planes(ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types, strict=True)], names=names)

        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                ids += end
                starts.append((doc_id, written + buffered // ID_BYTES, len(ids) // ID_BYTES))
                doc += 1
                buffer.append(ids)
                buffered += len(ids)
                if buffered >= block * ID_BYTES:
                    joined, at = b"".join(buffer), 0
                    while len(joined) - at >= block * ID_BYTES:
                        yield rows(joined[at : at + block * ID_BYTES])
                        at += block * ID_BYTES
                        written, number = written + block, number + 1
                        starts = [s for s in starts if s[1] >= written]
                        first_doc = doc - len(starts)
                    buffer, buffered = [joined[at:]], len(joined) - at
        if buffered:
            yield rows(b"".join(buffer))

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: a row for each document with its shard and its place in all ids. No planes are read."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    docs = chunks.select("shard", F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_lens")).alias("d"))
    return docs.join(shard_bases(spark, path), "shard").select(
        F.col("d.doc_ids").alias("doc_id"), "shard", (F.col("base") + F.col("d.doc_starts")).alias("start"), F.col("d.doc_lens").alias("n_tokens")
    )


def shard_bases(spark: SparkSession, path: str) -> DataFrame:
    """shard, base: the ids of all shards before it. One row a shard, so the running sum is over a few rows."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int). Blocks are
    decoded where they are read; the parts of a document that runs over several blocks meet by (shard, document). A folder
    without blocks gives an empty table."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, first, end = from_planes(row["planes"]), row["first_id"], row["first_id"] + row["n_ids"]
                out = []
                number, begun = row["first_doc"], row["doc_starts"]
                head = (begun[0] if begun else end) - first
                if head:  # the rest of a document that began before
                    out.append((row["shard"], number - 1, row["block"], None, None, None, ids[: head * ID_BYTES]))
                for k, (doc_id, start, n) in enumerate(zip(row["doc_ids"], begun, row["doc_lens"], strict=True)):
                    part = ids[(start - first) * ID_BYTES : (start + n - first) * ID_BYTES]
                    out.append((row["shard"], number + k, row["block"], doc_id, start, n, part))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=t) for v, t in zip(zip(*out, strict=True), part_types, strict=True)] if out else [pa.array([], type=t) for t in part_types], names=part_names)

    part_names = ["shard", "number", "block", "doc_id", "start", "n_tokens", "part"]
    part_types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode(batches):
            crc, rest = [], []
            for n, part in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                whole = n is not None and n * ID_BYTES == len(part)
                crc.append(zlib.crc32(part) if whole else None)
                rest.append(part if with_ids or not whole else None)
            columns = [*batch.columns[:6], pa.array(rest, type=pa.binary()), pa.array(crc, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part_names, "crc"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["n_tokens"] is not None:  # a document begins
                    if open_row:
                        done.append(open_row)
                    open_row = row
                    if row["crc"] is None:
                        row["crc"] = zlib.crc32(row["part"])
                        row["part"] = [row["part"]] if with_ids else None
                    elif with_ids:
                        row["part"] = [row["part"]]
                else:
                    open_row["crc"] = zlib.crc32(row["part"], open_row["crc"])
                    if with_ids:
                        open_row["part"].append(row["part"])
            yield out(done)
        if open_row:
            yield out([open_row])

    def out(rows: list[dict]) -> pa.RecordBatch:
        columns = [
            pa.array([r["shard"] for r in rows], type=pa.int32()),
            pa.array([r["doc_id"] for r in rows], type=pa.int64()),
            pa.array([r["start"] for r in rows], type=pa.int64()),
            pa.array([r["n_tokens"] for r in rows], type=pa.int64()),
            pa.array([r["crc"] for r in rows], type=pa.int64()),
        ]
        names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(b"".join(r["part"]), dtype="<u4").astype(np.int32) for r in rows], type=pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    parts = chunks.mapInArrow(compact, "shard int, number long, block int, doc_id long, start long, n_tokens long, part binary, crc long")
    dealt = parts.repartition("shard", "number").sortWithinPartitions("shard", "number", "block")
    schema = "shard int, doc_id long, place long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = dealt.mapInArrow(assemble, schema).join(shard_bases(spark, path), "shard")
    return docs.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """What read_tokens reads from the files that write_tokens makes of docs, in a scratch folder; see both for nulls, ties,
    repeated rows and empty tables."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path)
