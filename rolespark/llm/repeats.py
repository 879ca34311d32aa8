"""Removal of repeated strings by suffix arrays.

A byte goes if a string of `least` bytes that covers it also starts anywhere else. To sort every suffix of a corpus would
be too much, and to search each shard's suffixes in every other shard would grow with the square of the shards. So windows
(strings of `least` bytes) are dealt to shards by what they hold, and shards that need not be sorted are not:

1. Anchors. A window's anchor is the least hash of its 32-byte grams, so equal windows have equal anchors. Neighbouring
   windows mostly share theirs; a stretch of them is a segment, on average some 185 windows. Of each segment only its anchor
   and a hash of its bytes are kept, and counted.
2. A segment that stands more than once is repeated as a whole. An anchor with one segment only has nothing else to meet,
   unless it stands in it more than once. The bytes of one copy of each other segment are cut out of its text.
3. Shards. Segments meet by anchor in shards of about SHARD_SEGMENTS. Each shard has a suffix array, sorted by
   Larsson-Sadakane refinement (groups that are not sorted yet are sorted by the ranks of what follows, twice as far each
   time) and common prefixes by Kasai's scan, both in array operations. Neighbours with `least` bytes in common are repeated.
4. An anchor with more segments than a shard holds is split over shards. Each sends the fingerprints of its different
   windows, sorted and cut by range; a range's fingerprints of one shard are searched in those of the others by bisection.
5. The repeated stretches go back to the texts that hold the segments.

Only step 5 and the cutting move texts, each once. Copies of a text have the same anchors, so they are counted as one row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolespark.llm.common import materialize

#: Bytes in a gram; windows in a segment at most; segments in a shard, about.
GRAM, SEGMENT_WINDOWS, SHARD_SEGMENTS = 32, 1024, 1000
#: Bytes of a text whose grams are hashed at once.
TEXT_BYTES = 4 << 20
#: Symbols in the first sort key: seven of nine bits.
FIRST = 7
#: Places in a lane of the scan for common prefixes.
LANE = 96
#: Fingerprints in a range, about.
RANGE_FINGERPRINTS = 1 << 19

_U = np.uint64
_COVERED = "h long, g long, begins array<int>, ends array<int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, 8 bytes at a time."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()
    eight = _mix(eight * _U(0x9E3779B97F4A7C15) + _U(1))
    n = len(data) - gram + 1
    out = eight[:n].copy()
    for at in [*range(8, gram - 7, 8), gram - 8][: (gram - 1) // 8]:
        out *= _U(0xD1342543DE82EF95)
        out += eight[at : at + n]
    return _mix(out)


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: blocks of that width, least from the left and from the right."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _stands_twice(hashes: np.ndarray, width: int, edge: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether a segment has its anchor more than once. All its windows have the anchor, so the leftmost one is in the first
    window and the rightmost one in the last."""
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    left = (windows[edge] == anchor[:, None]).argmax(axis=1)
    right = width - 1 - (windows[edge + count - 1] == anchor[:, None])[:, ::-1].argmax(axis=1)
    return edge + left < edge + count - 1 + right


def segments(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, anchor of the segments of a text, and whether the anchor stands in it more than once (if not, no two
    windows of the segment are equal). The segments' windows are all windows of the text, each once."""
    gram = min(GRAM, max(8, least // 2))
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=_U), np.empty(0, dtype=bool))]
    for base in range(0, len(data) - least + 1, TEXT_BYTES):
        part = np.frombuffer(data, dtype=np.uint8, count=min(TEXT_BYTES + least - 1, len(data) - base), offset=base)
        hashes, width = _gram_hashes(part, gram), least - gram + 1
        low = _least_of(hashes, width)
        edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.concatenate([edge, [len(low)]]))
        pieces = -(-count // SEGMENT_WINDOWS)
        if (pieces > 1).any():
            of = np.repeat(np.arange(len(edge)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = count[of] - nth * SEGMENT_WINDOWS
            edge, count = edge[of] + nth * SEGMENT_WINDOWS, np.minimum(left, SEGMENT_WINDOWS)
        found.append((edge + base, count, low[edge], _stands_twice(hashes, width, edge, count, low[edge])))
    start, count, anchor, twice = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, count, anchor, twice


def suffix_array(symbols: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes (equal ones by place), and each place's rank. symbols: over 0, with FIRST zeros
    after each string; end: for each place the end of its string; depth: the longest string's length.

    Larsson-Sadakane: a rank is the first place of its group in the array. Groups of one are done; the others are sorted by
    (own rank, rank of what stands `size` further on), which doubles the size."""
    n = len(symbols)
    key = _keys(symbols)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    place = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = place
    bits, size = max(1, int(n).bit_length()), FIRST
    unsorted = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    unsorted = unsorted[symbols[order[unsorted]] > 0]
    while size < depth and len(unsorted):
        at = order[unsorted]
        beyond = np.minimum(at + size, end[at])
        follow = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        if 3 * bits <= 63:
            packed = np.sort(rank[at] << (2 * bits) | follow << bits | at)
            at, pair = packed & ((1 << bits) - 1), packed >> bits
        else:
            o = np.lexsort((follow, rank[at]))
            pair = rank[at][o] * (n + 2) + follow[o]
            at = at[o]
        order[unsorted] = at
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(first, unsorted, 0))
        alone = first & np.concatenate([first[1:], [True]])
        unsorted = unsorted[~alone]
        size *= 2
    exact = np.empty(n, dtype=np.int64)
    exact[order] = np.arange(n)
    return order, exact


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The FIRST symbols from each place on, as one number."""
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(FIRST, dtype=np.int64)])
    key = np.zeros(len(symbols), dtype=np.int64)
    for k in range(FIRST):
        key = key << 9 | padded[k : k + len(symbols)]
    return key


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """For each place that is one of the first `count` of its string the length, `most` at most, that it shares with the
    suffix before it in the array (other places: 0). Kasai: the next place shares at most one less. Stretches of at most
    LANE places are scanned side by side; a stretch begins with nothing known, and its first prefix is found FIRST symbols
    at a time."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(most + FIRST, dtype=symbols.dtype)])
    key = _keys(padded)
    pieces = -(-count // LANE)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, count = np.repeat(begin, pieces) + nth * LANE, np.minimum(np.repeat(count, pieces) - nth * LANE, LANE)
    out = np.zeros(n, dtype=np.int32)
    lanes = np.argsort(-count, kind="stable")
    begin, count = begin[lanes], count[lanes]
    k = np.zeros(len(begin), dtype=np.int64)
    for step in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -step, side="left"))
        at = begin[:live] + step
        r = rank[at]
        mate = order[np.maximum(r - 1, 0)]
        shared = np.where(r > 0, np.maximum(k[:live] - 1, 0), 0)
        going = np.flatnonzero(r > 0)
        for width in (FIRST, 1):
            going_on = going
            while len(going_on):
                x, z = at[going_on], shared[going_on]
                same = (key[x + z] == key[mate[going_on] + z]) if width > 1 else (padded[x + z] == padded[mate[going_on] + z])
                going_on = going_on[same & (z < most) & (padded[x + z + width - 1] > 0)]
                shared[going_on] += width
        k[:live] = np.minimum(shared, most)
        out[at] = k[:live]
    return out


class Shard:
    """Segments side by side, with their suffix array; repeated: for each place whether its window stands elsewhere too."""

    def __init__(self, texts: list[bytes], count: np.ndarray, least: int):
        self.least, self.count = least, count
        size = np.array([len(t) for t in texts], dtype=np.int64)
        joined = np.frombuffer((b"\0" * FIRST).join(texts) + b"\0" * FIRST, dtype=np.uint8)
        self.begin = np.cumsum(size + FIRST) - size - FIRST
        inside = np.repeat(np.tile(np.array([True, False]), len(size)), np.stack([size, np.full(len(size), FIRST)], axis=1).reshape(-1))
        self.symbols = np.where(inside, joined.astype(np.int16) + 1, 0).astype(np.int16)
        end = np.repeat(self.begin + size, size + FIRST)
        self.order, rank = suffix_array(self.symbols, end, int(size.max()))
        shared = common_prefixes(self.symbols, self.order, rank, self.begin, count, least)
        long = np.flatnonzero(shared >= least)
        self.repeated = np.zeros(len(self.symbols), dtype=bool)
        self.repeated[long] = True
        self.repeated[self.order[rank[long] - 1]] = True
        self.again = shared >= least  # windows that an earlier one of the array equals

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, segment and place in it of the different windows, by fingerprint."""
        powers, inverses = (np.full(len(self.symbols) + 1, f, dtype=_U) for f in (0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)))
        for row in (powers, inverses):
            row[0] = 1
            np.multiply.accumulate(row, out=row)
        table = _mix((np.arange(257, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(table[self.symbols] * powers[:-1], dtype=_U)])
        segment = np.repeat(np.arange(len(self.begin)), self.count)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        at = self.begin[segment] + offset
        fresh = ~self.again[at]
        at, segment, offset = at[fresh], segment[fresh], offset[fresh]
        marks = _mix((sums[at + self.least] - sums[at]) * inverses[at])
        by = np.argsort(marks)
        return marks[by], segment[by], offset[by]


def _stretches(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Ascending numbers as stretches, ends exclusive."""
    if not len(at):
        return [], []
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist()


def _shard_rows(least: int):
    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("g", "ascending")])
        h, g, count = (table[c].to_numpy() for c in ("h", "g", "windows"))
        shard = Shard(table["bytes"].to_pylist(), count.astype(np.int64), least)
        out: dict[str, list] = {c: [] for c in ("h", "g", "begins", "ends", "range", "salt", "marks", "gs", "places")}

        def add(**values: object) -> None:
            for c, column in out.items():
                column.append(values.get(c))

        for k in range(len(h)):
            begins, ends = _stretches(np.flatnonzero(shard.repeated[shard.begin[k] : shard.begin[k] + count[k]]))
            if begins:
                add(h=h[k], g=g[k], begins=begins, ends=ends)
        salt, ranges = table["salt"][0].as_py(), table["ranges"][0].as_py()
        if salt >= 0:
            marks, segment, place = shard.windows()
            cut = np.searchsorted(marks >> _U(44), (np.arange(ranges + 1, dtype=np.int64) << 20) // ranges)
            for k in range(ranges):
                s = slice(int(cut[k]), int(cut[k + 1]))
                if s.stop > s.start:
                    add(h=h[0], range=k, salt=salt, marks=marks[s].tobytes(), gs=g[segment[s]].tobytes(), places=place[s].astype("<i4").tobytes())
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return rows


_SHARD_SCHEMA = _COVERED + ", range int, salt int, marks binary, gs binary, places binary"


def _merged(table: pa.Table) -> pa.Table:
    """Windows of one range of fingerprints that stand in more than one shard: each shard's are searched by bisection in
    those that came before, and those before are marked with them."""
    marks = [np.frombuffer(x, dtype=_U) for x in table["marks"].to_pylist()]
    base = np.cumsum([0] + [len(x) for x in marks])
    hit = np.zeros(base[-1], dtype=bool)
    known, owner = np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    for k, mine in enumerate(marks):
        at = np.searchsorted(known, mine)
        same = np.flatnonzero(at < len(known))
        same = same[known[at[same]] == mine[same]]
        hit[base[k] + same] = True
        hit[owner[at[same]]] = True
        fresh = np.ones(len(mine), dtype=bool)
        fresh[same] = False
        known, owner = np.insert(known, at[fresh], mine[fresh]), np.insert(owner, at[fresh], base[k] + np.flatnonzero(fresh))
    g = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table["gs"].to_pylist()])[hit]
    place = np.concatenate([np.frombuffer(x, dtype="<i4") for x in table["places"].to_pylist()])[hit]
    by = np.lexsort((place, g))
    g, place = g[by], place[by]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
    found = [_stretches(place[a:b]) for a, b in zip(edge, np.append(edge[1:], len(g))[: len(edge)], strict=True)]
    return pa.table([pa.array([table["h"][0].as_py()] * len(edge), pa.int64()), pa.array(g[edge]), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int32()))], names=["h", "g", "begins", "ends"])


def _text_key(text):
    return F.unhex(F.md5(text))


def _anchors(texts: DataFrame, least: int) -> DataFrame:
    """k (the text's hash), d (least id of its rows), start, windows, h (anchor), twice, g (hash of the bytes), n (rows) for
    the segments of all different texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, count, anchor, twice, hashes = [], [], [], [], [], []
            bodies = batch["text"].cast(pa.binary())
            for k in range(len(batch)):
                data = bodies[k].as_py()
                s, c, a, t = segments(data, least)
                of.append(np.full(len(s), k))
                start.append(s)
                count.append(c)
                anchor.append(a)
                twice.append(t)
                view = memoryview(data)
                hashes += [hashlib.blake2b(view[x : x + y + least - 1], digest_size=8).digest() for x, y in zip(s.tolist(), c.tolist(), strict=True)]
            of = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [batch["k"].take(of), batch["d"].take(of), pa.array(np.concatenate(start)), pa.array(np.concatenate(count).astype(np.int32)), pa.array(np.concatenate(anchor).view(np.int64)), pa.array(np.concatenate(twice)), pa.array(np.frombuffer(b"".join(hashes), dtype="<i8"))],
                names=["k", "d", "start", "windows", "h", "twice", "g"],
            )

    able = texts.filter(F.octet_length("text") >= least)
    found = able.mapInArrow(rows, "k binary, d string, start long, windows int, h long, twice boolean, g long")
    return found.groupBy("k", "start", "windows", "h", "twice", "g").agg(F.min("d").alias("d"), F.count("*").alias("n"))


def _cut(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """wanted (k, d and a segment's columns) with the segment's bytes, each (h, g) once."""
    columns = [c for c in wanted.columns if c not in ("k", "d")]
    listed = wanted.groupBy("k", "d").agg(F.collect_list(F.struct(*columns)).alias("s"))
    place = F.substr(F.col("text").cast("binary"), (F.col("x.start") + 1).cast("int"), F.col("x.windows") + least - 1)
    cut = texts.join(listed, ["k", "d"]).select("text", F.explode("s").alias("x")).select("x.*", place.alias("bytes"))
    return cut.groupBy("h", "g").agg(*[F.first(c).alias(c) for c in [*columns, "bytes"] if c not in ("h", "g")])


def repeated_stretches(texts: DataFrame, least: int = 400) -> DataFrame:
    """k, spans (array of start, end) of the repeated windows' bytes in each text that has some; spans are in no order and
    may overlap. texts: k (hash of the text), d (an id as text, never null), text."""
    anchors = materialize(_anchors(texts, least), "anchors")
    segment = F.struct("k", "d", "start", "windows")
    parts = materialize(anchors.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min(segment).alias("s"), F.bool_or("twice").alias("twice")), "segments")
    meeting = parts.groupBy("h").agg(F.count("*").alias("n_g")).filter("n_g > 1")
    alone = F.col("n_g").isNull() & F.col("twice") & (F.col("n") == 1)
    met = parts.join(meeting, "h", "left").filter(F.col("n_g").isNotNull() | alone)
    wanted = materialize(met.select("h", "g", F.coalesce("n_g", F.lit(1)).alias("n_g"), "s.*"), "meeting")
    shards = max(1, wanted.count() // SHARD_SEGMENTS)
    hot = F.col("n_g") > SHARD_SEGMENTS
    dealt = wanted.withColumns(
        {
            "shard": F.when(hot, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))),
            "salt": F.when(hot, F.pmod("g", F.ceil(F.col("n_g") / SHARD_SEGMENTS))).otherwise(-1).cast("int"),
            "ranges": F.ceil(F.col("n_g") * 256 / RANGE_FINGERPRINTS).cast("int"),
        }
    ).drop("n_g")
    sorted_shards = materialize(_cut(texts, dealt, least).groupBy("shard", "salt").applyInArrow(_shard_rows(least), _SHARD_SCHEMA), "shards")
    inside = sorted_shards.filter("g is not null").select("h", "g", "begins", "ends")
    across = sorted_shards.filter("range is not null").groupBy("h", "range").applyInArrow(_merged, _COVERED)
    covered = inside.unionByName(across).select("h", "g", F.arrays_zip("begins", "ends").alias("parts"))
    whole = parts.filter("n > 1").select("h", "g", F.array(F.struct(F.lit(0).alias("begins"), F.col("s.windows").alias("ends"))).alias("parts"))
    marked = whole.unionByName(covered).groupBy("h", "g").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    spans = F.transform("parts", lambda p: F.struct((F.col("start") + p["begins"]).alias("start"), (F.col("start") + p["ends"] + least - 1).alias("end")))
    return anchors.join(marked, ["h", "g"]).groupBy("k").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def _removal(text: str):
    """Takes the spans out of the text, one of the fields of _row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for body, spans in zip(batch["_row"].field(text).cast(pa.binary()), batch["_spans"], strict=True):
                data, gone, left, at = body.as_py() or b"", [], [], 0
                if spans.is_valid:
                    inner = spans.values
                    for s, e in sorted(zip(inner.field("start").to_pylist(), inner.field("end").to_pylist(), strict=True)):
                        if gone and s <= gone[-1]["end"]:
                            gone[-1]["end"] = max(gone[-1]["end"], e)
                        else:
                            gone.append({"start": s, "end": e})
                for x in gone:
                    left.append(data[at : x["start"]])
                    at = x["end"]
                left.append(data[at:])
                removed.append(gone)
                kept.append(b"".join(left))
            spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch["_row"], spans, pa.array(kept, pa.binary())], names=["_row", "removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400) -> DataFrame:
    """Every row of docs as a struct _row, with removed (array of start, end in UTF-8 bytes, maximal stretches in order) and
    kept (the remaining bytes; a stretch may begin inside a character).

    A null text is empty: nothing is removed, kept is empty. Rows of one text each lose all of it, if it has `least` bytes.
    Texts are looked at whole, matches never cross rows, ties cannot arise; ids may be null or used twice, they only choose
    the copy of a segment that is cut. Other columns stay in _row whatever their names are. An empty table stays empty.
    Strings are judged by the input, not by what is left. Exact but for hash collisions: a gram's hash decides only what
    meets what; segments of one anchor are taken as equal by 64 bits, windows of an anchor that is split likewise."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(_text_key(body).alias("k"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), body.alias("text"))
    spans = repeated_stretches(texts, least)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _text_key(body).alias("k"))
    joined = rows.join(spans.withColumnRenamed("spans", "_spans"), "k", "left").select("_row", "_spans")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([joined.schema["_row"], T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_removal(text), schema)
