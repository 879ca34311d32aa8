"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ in k = error * n edits. Cut into k + 1 pieces, at least one piece of an occurrence
within k edits is intact, so an Aho-Corasick automaton over all pieces finds every candidate, and Myers' bit-parallel
distance verifies it. Documents stay where they are read: no shuffle, whatever passages they share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = 0.1
#: Items of fewer characters (normalized) match without edits and between word boundaries only; such an item of one word
#: only a document that holds nothing else, as a single word is no evidence of a leak.
SHORT_CHARS = 20
#: Characters of benchmark text that go to the workers at once; a larger benchmark is matched in blocks.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text, and the end of the first such one."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = pattern_masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Node:
    """Pattern characters a to b, which p pieces make up, and the p - 1 edits they may have."""

    __slots__ = ("a", "b", "budget", "masks")

    def __init__(self, pattern: str, a: int, b: int, budget: int):
        self.a, self.b, self.budget, self.masks = a, b, budget, masks(pattern[a:b])


def chains(pattern: str, pieces: int) -> list[list[Node]]:
    """For each piece the nodes above it, from its parent to the whole pattern. If a node is within its budget, so is one
    of its two halves; hence an occurrence shows a piece that is intact with all nodes above it within their budgets."""
    at = [len(pattern) * i // pieces for i in range(pieces + 1)]
    out: list[list[Node]] = [[] for _ in range(pieces)]

    def halve(first: int, last: int) -> None:
        if last - first < 2:
            return
        node = Node(pattern, at[first], at[last], last - first - 1)
        middle = (first + last) // 2
        halve(first, middle)
        halve(middle, last)
        for k in range(first, last):
            out[k].append(node)

    halve(0, pieces)
    return out


class Matcher:
    """Finds every item within its error budget in a text; one is built in each worker process (see matcher)."""

    def __init__(self, items: list[tuple[int, str]], error: float):
        import ahocorasick

        self.items = []
        self.short: list[tuple[int, int]] = []  # ids and lengths of short items
        self.words: dict[str, list[int]] = {}  # ids of one-word items
        places: dict[str, list[tuple[int, int, list[Node]]]] = {}
        for item_id, text in items:
            text = normalized(text)
            if not text:
                continue
            if len(text) < SHORT_CHARS:
                if " " not in text:
                    self.words.setdefault(text, []).append(item_id)
                else:
                    places.setdefault(text, []).append((-1 - len(self.short), 0, []))
                    self.short.append((item_id, len(text)))
                continue
            pieces = int(error * len(text)) + 1
            at = [len(text) * i // pieces for i in range(pieces + 1)]
            for k, chain in enumerate(chains(text, pieces)):
                places.setdefault(text[at[k] : at[k + 1]], []).append((len(self.items), at[k], chain))
            self.items.append((item_id, text, pieces - 1, masks(text), masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _candidates(self, text: str) -> dict[int, set[int]]:
        """For each item the beginnings that an intact piece suggests and all nodes above it but the last confirm. Short
        items have negative numbers, and their beginnings are at word boundaries."""
        found: dict[int, set[int]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for item, offset, chain in where:
                begin = last - n + 1 - offset
                if item < 0 and (text[begin - 1 : begin].isalnum() or text[last + 1 : last + 2].isalnum()):
                    continue
                if begin in found.get(item, ()):
                    continue
                for node in chain[:-1]:
                    e = node.budget
                    window = text[max(0, begin + node.a - e) : begin + node.b + e]
                    if myers(node.masks, node.b - node.a, window)[0] > e:
                        break
                else:
                    found.setdefault(item, set()).add(begin)
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for the best occurrence of each item, in the normalized text."""
        text = normalized(text)
        out = [(item_id, 0, 0, len(text)) for item_id in self.words.get(text, ())]
        if not self.items and not self.short:
            return out
        for item, begins in self._candidates(text).items():
            if item < 0:
                item_id, m = self.short[-1 - item]
                out.append((item_id, 0, min(begins), min(begins) + m))
                continue
            item_id, pattern, k, forward, backward = self.items[item]
            m, best, high = len(pattern), None, -len(text) - len(pattern)
            exact = text.find(pattern)
            if exact >= 0:
                out.append((item_id, 0, exact, exact + m))
                continue
            for begin in sorted(begins):
                if begin <= high:
                    continue
                high = begin + k  # one window serves the next k beginnings
                low = max(0, begin - k)
                window = text[low : begin + m + 2 * k]
                distance, end = myers(forward, m, window)
                if distance <= k and (best is None or distance < best[0]):
                    _, back = myers(backward, m, window[:end][::-1])
                    best = (distance, low + end - back, low + end)
            if best:
                out.append((item_id, *best))
        return sorted(out)


_built: dict[tuple[str, float], Matcher] = {}


def matcher(sent: Broadcast, error: float) -> Matcher:
    """The matcher of a broadcast (name, items), built once in a worker process and kept until another one is asked for."""
    name, items = sent.value
    if (name, error) not in _built:
        _built.clear()
        _built[name, error] = Matcher(items, error)
    return _built[name, error]


def matches(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item that occurs in it within int(error * length) edits (see SHORT_CHARS for
    short ones): the least distance and the place of that occurrence in the text, lower-cased and with white space squeezed.

    Empty tables of documents or items give an empty result. Null and blank texts and items match nothing; repeated document rows give repeated result rows; repeated items (same
    id and text) count once; other columns are not read. Whole texts are searched."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(chars) // block_chars
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        one = _match_block(rows, [(r[0], r[1]) for r in part.collect()], error)
        found = one if found is None else found.unionByName(one)
    return found


def _match_block(rows: DataFrame, items: list[tuple[int, str]], error: float) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matcher(sent, error)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    out += [(doc_id, *x) for x in found.find(text)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

    return rows.mapInArrow(search, SCHEMA)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """docs without those in which a benchmark item occurs, as matches() tells. The flag is made where the text is read, so
    rows with null or repeated ids keep their own verdict, and nothing is shuffled. Without items all rows stay; rows
    without a text stay; all columns are kept whatever their names are."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    blocks = 1 + int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // BLOCK_CHARS
    for block in range(blocks):
        part = [(r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        docs = _drop_block(docs, part, error)
    return docs


def _drop_block(docs: DataFrame, items: list[tuple[int, str]], error: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matcher(sent, error)
        for batch in batches:
            yield batch.filter(pa.array([not (t and found.find(t)) for t in batch.column("text").to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
