"""Best-fit packing of token pieces by linear grouping.

The plan is made on the histogram of piece lengths, which has at most `capacity` entries for any number of documents.
Large lengths are cut into groups of equal cardinality and rounded up to the largest length of their group; sequences
are filled by configurations of these few sizes; then the group's real pieces take the places of its rounded ones, and
small pieces go best-fit into what is left. Sequences with equal contents are kept as one run, so planning does not
depend on how many there are. The plan says for each length which ranks go to which sequences, and a join by
(length, rank) carries it out."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolespark.llm.common import materialize
from rolespark.llm.tokens import ID_BYTES, encoder_for

CAPACITY = 2048
#: Groups of equal cardinality. Groups of one largest length are joined, so a plan has at most `capacity` sizes whatever this
#: is; with so many only lengths of which there are few are rounded up.
GROUPS = 65_536
PIECE_SCHEMA = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: only documents of more than capacity ids are cut. nth counts pieces of
    equal length in a task's part. Written to the shared folder, so parts and nth stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, end = encoder_for(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), capacity * ID_BYTES)):
                    piece = ids[at : at + capacity * ID_BYTES]
                    n = len(piece) // ID_BYTES
                    rows.append((part, doc_id, k, at // ID_BYTES, n, zlib.crc32(piece), seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(v), type=t) for v, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], type=t) for t in types], names=names)

    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)
    return materialize(found, "pieces")


class Plan:
    """Places for every (length, rank): intervals of ranks that go to consecutive sequences at one offset."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sequences = 0
        self.intervals: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self._next_rank: dict[int, int] = defaultdict(int)
        self._left: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left: runs (first sequence, count)

    def open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.intervals.append((length, self._next_rank[length], count, first, offset))
        self._next_rank[length] += count

    def leave(self, space: int, first: int, count: int) -> None:
        if space and count:
            self._left[space].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """Puts count pieces of one length where the least space remains; opens sequences when none has room."""
        spaces = sorted(s for s, runs in self._left.items() if runs and s >= length)
        at = 0
        while count and at < len(spaces):
            space = spaces[at]
            runs = self._left[space]
            if not runs:
                at += 1
                continue
            first, n = runs.pop()
            each = min(space // length, max(1, count // n))
            used = min(n, count)
            for k in range(each):
                self.put(length, used, first, self.capacity - space + k * length)
            count -= used * each
            if used < n:
                runs.append((first + used, n - used))
            rest = space - each * length
            self.leave(rest, first, used)
            if rest >= length and rest not in spaces[: at + 1]:
                spaces = sorted({*spaces, rest})
                at = min(at, spaces.index(rest))
        if count:
            each = self.capacity // length
            full, rest = divmod(count, each)
            for n, slots in ((full, each), (1 if rest else 0, rest)):
                if n:
                    first = self.open(n)
                    for k in range(slots):
                        self.put(length, n, first, k * length)
                    self.leave(self.capacity - slots * length, first, n)

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.intervals), dtype=np.int64).reshape(-1, 5)
        return {"key": (rows[:, 0] << 44) | rows[:, 1], "sequence": rows[:, 3], "offset": rows[:, 4]}


def group(histogram: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: lengths in descending order, cut into groups of equal cardinality; each is (largest length,
    [[length, count], ...]). A length may be split between groups; groups of one size are joined."""
    total = sum(histogram.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not room and (not out or out[-1][0] != length):
                out.append((length, []))
                room = each
            elif not room:
                room = each
            take = min(room, count)
            members = out[-1][1]
            if members and members[-1][0] == length:
                members[-1][1] += take
            else:
                members.append([length, take])
            room, count = room - take, count - take
    return out


def best_configuration(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """How many of each size to put beside one of sizes[first] so that the sequence is as full as it can be: reachable
    sums as bit sets, sizes in descending order."""
    room = capacity - sizes[first]
    reached, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for k in range(first, len(sizes)):
        have = counts[k] - (k == first)
        layers.append(reached)
        most, step = min(have, room // sizes[k]), 1
        while most > 0:
            take = min(step, most)
            reached |= (reached << (take * sizes[k])) & mask
            most, step = most - take, step * 2
    at = reached.bit_length() - 1
    chosen = [0] * len(sizes)
    chosen[first] = 1
    for k in range(len(sizes) - 1, first - 1, -1):
        before = layers[k - first]
        n = 0
        while not (before >> (at - n * sizes[k])) & 1:
            n += 1
        chosen[k] += n
        at -= n * sizes[k]
    return chosen


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> Plan:
    """Histogram: pieces of each length from 1 to capacity - 1. small: the largest length that is placed best-fit."""
    small = capacity // 16 if small is None else small
    plan = Plan(capacity)
    grouped = group({k: n for k, n in histogram.items() if k > small}, groups)
    sizes, counts = [g[0] for g in grouped], [sum(n for _, n in g[1]) for g in grouped]
    first = 0
    while first < len(sizes):
        if not counts[first]:
            first += 1
            continue
        chosen = best_configuration(sizes, counts, first, capacity)
        times = min(counts[k] // n for k, n in enumerate(chosen) if n)
        slots = [k for k, n in enumerate(chosen) for _ in range(n)]
        _substitute(plan, grouped, slots, times)
        for k, n in enumerate(chosen):
            counts[k] -= n * times
    for length in sorted((k for k in histogram if k <= small), reverse=True):
        plan.best_fit(length, histogram[length])
    return plan


def _substitute(plan: Plan, grouped: list, slots: list[int], times: int) -> None:
    """Real pieces take the rounded ones' places in `times` sequences of one configuration."""
    first = plan.open(times)
    runs = [(first, times, 0)]  # first sequence, count, ids in it
    for k in slots:
        queue, after = grouped[k][1], []
        for start, count, used in runs:
            while count:
                length, have = queue[0]
                take = min(have, count)
                plan.put(length, take, start, used)
                after.append((start, take, used + length))
                start, count = start + take, count - take
                queue[0][1] -= take
                if not queue[0][1]:
                    queue.pop(0)
        runs = after
    for start, count, used in runs:
        plan.leave(plan.capacity - used, start, count)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every id of every document, once.

    A null or empty text is one piece of the end id. Pieces of full length are sequences by themselves. Rows with equal
    or null ids are documents of their own; other columns are not read. An empty table gives an empty table."""
    cut = pieces(docs, tokenizer_path, end_id, capacity)
    full = cut.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    partial = cut.filter(F.col("length") < capacity)
    tally = partial.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(tally.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"), "bases")
    # at most capacity - 1 rows, whatever the input
    histogram = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}
    places = make_plan(histogram, capacity, groups).arrays()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            key = (batch.column("length").to_numpy() << 44) | rank
            at = np.searchsorted(places["key"], key, side="right") - 1
            sequence = places["sequence"][at] + key - places["key"][at]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(places["offset"][at])], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ranked = partial.join(bases.drop("n"), ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", "base").mapInArrow(place, schema).unionByName(full.select(*names))
