"""N-gram Jaccard join by chosen paths.

Documents with equal sets of word shingles form a class; the join runs on one set for each class. In every run a set
samples each of its shingles with probability 1 / (threshold * size), so sets as similar as the threshold share a
sampled shingle with good odds; sets that do, meet in a node. A node with more members than `small` is split again by
the members' next sampled shingles, down to `depth`; small nodes are compared in full. Runs with new seeds repeat until
the target recall. A pair that meets in several nodes counts in the first of them only, so links are counted without
listing them: what leaves a node is a row for each member. Members that are too short or too long for any other member
of a small node leave it before texts are sent.

Two things keep crowds linear. Shingles that very many documents have (a passage, a line) split nothing: where enough of
a set is left, only its rarer shingles are sampled, so much oftener that the expected number of shared samples is no
smaller. And in a node that stays large the shingles that most members have are its centre; members within half the
allowed distance of one centre are a ball, all of whose pairs are links by the triangle inequality, counted without a
comparison. The other members of the node are compared with all, in blocks of even size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolespark.llm.common import materialize

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99
SMALL = 512
DEPTH = 3
BLOCK = 512
#: Shingles of a block at most, unless one document has more.
BLOCK_SHINGLES = 4_000_000
#: A shingle is common if more than `small` documents and this share of all have it. So common shingles number at most
#: 2 / COMMON_SHARE times the mean size of a set, whatever the number of documents.
COMMON_SHARE = 1 / 1024
#: Shingles that are counted together when common ones are looked for.
COUNTED = 2_000_000
#: Members of a large node from which its centre is taken. The centre decides only which pairs need no comparison.
CENTRE_OF = 128


def runs_for(recall: float, depth: int) -> int:
    """Runs until two sets of at least the threshold's similarity have met with probability recall on the last of depth
    levels. The sampled shingles they share number (size of the union) / (size of the larger) a level on average: 1 at
    least, if one set contains the other and they are just at the threshold; a path must survive every level."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-survive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survive)))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of texts: lower-cased words between ASCII white space. A text with
    fewer words than a shingle has one shingle, all its words; a text without words, or null, has none.

    A word's hash is a polynomial over its bytes, each byte by a random coefficient, so all words of a batch are hashed
    in a few array operations: the difference of two running sums, moved to the word's start by a power of the inverse."""

    WINDOW = 500_000  # bytes hashed at once, unless one word has more
    CHARACTERS = 2_000_000  # bytes of texts taken together, unless one text has more

    def __init__(self, words: int = WORDS):
        self._n = words
        self._byte = self._mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._power = self._inverse = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(32))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def _hashed(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), dtype=np.uint64)
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + self.WINDOW, side="right")))
            base, size = begin[at], int(end[to - 1] - begin[at])
            if len(self._power) < size:
                for name, factor in (("_power", 0xD1342543DE82EF95), ("_inverse", pow(0xD1342543DE82EF95, -1, 2**64))):
                    row = np.full(size, factor, dtype=np.uint64)
                    row[0] = 1
                    setattr(self, name, np.multiply.accumulate(row))
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(self._byte[data[base : base + size]] * self._power[:size], out=sums[1:])
            first = begin[at:to] - base
            out[at:to] = (sums[end[at:to] - base] - sums[first]) * self._inverse[first]
            at = to
        return self._mix(out)

    def _rolled(self, h: np.ndarray, n: int) -> np.ndarray:
        out = h
        for k in range(1, n):
            out = self._mix(out[:-1]) + h[k:]
        return self._mix(out ^ np.uint64(n))

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, size[at] + self.CHARACTERS, side="right")) - 1)
            yield from self._some(texts.slice(at, to - at))
            at = to

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        place = np.frombuffer(low.buffers()[1], dtype=np.int64 if pa.types.is_large_string(low.type) else np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        data = np.frombuffer(low.buffers()[2] or b"", dtype=np.uint8)[place[0] : place[-1]]
        place -= place[0]
        edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins, or a white space stands before
        edge[place] = True
        word = (data != 32) & ((data < 9) | (data > 13))
        edge[1:] |= ~word
        begin = np.flatnonzero(word & edge[:-1])
        edge[:-1] |= ~word
        end = np.flatnonzero(word & edge[1:]) + 1
        h = self._hashed(data, begin, end)
        whole = self._rolled(h, self._n) if len(h) >= self._n else h
        bounds = np.searchsorted(begin, place).tolist()
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if last - first >= self._n:
                yield np.unique(whole[first : last - self._n + 1])
            else:
                yield self._rolled(h[first:last], last - first) if last > first else np.empty(0, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.batch(pa.array([text], type=pa.string())))


def signature(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def common_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the shingles are common ones."""
    if not len(common):
        return np.zeros(len(shingles), dtype=bool)
    return common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles


def shares(threshold: float) -> tuple[float, float]:
    """The shares of common shingles up to which a set samples the rarer ones only, and from which it samples all alike."""
    high = threshold - 0.2
    return high - (1 - threshold), high


def sampling(is_common: np.ndarray, threshold: float) -> np.ndarray:
    """The probability, as a share of 2^64, with which each shingle of a set is sampled.

    Of a set of n shingles, c of them common, x shares at least threshold * n - c rarer ones with a partner; sampled with
    probability 1 / (threshold * n - c) one is expected. Sets with a small share of common shingles sample the rarer ones
    only, sets with a large share all as if none were common, those between in both ways. Two linked sets cannot be one
    of the first kind and one of the second: their shares differ by less than 1 - threshold."""
    n, c = len(is_common), int(is_common.sum())
    rate = np.full(n, 1 / (threshold * max(1, n)))
    low, high = shares(threshold)
    if 0 < c < high * n:
        rate[~is_common] = 1 / (threshold * n - c)
        if c <= low * n:
            rate[is_common] = 0
    return np.minimum(rate * 2.0**64, np.nextafter(2.0**64, 0)).astype(np.uint64)


def _seeds(runs: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([xxhash.xxh64_intdigest(name, seed=run) | 1 for run in range(runs)], dtype=np.uint64) for name in (b"run", b"node"))


def paths(shingles: np.ndarray, bound: np.ndarray, runs: int, depth: int, width: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """level, parent node and node of the steps of all runs."""
    odd, mark = _seeds(runs)
    parent, factor = np.zeros(runs, dtype=np.uint64), odd
    found = []
    for level in range(depth):
        step = max(1, width // max(1, len(shingles)))
        hits = [np.nonzero(shingles[None, :] * factor[at : at + step, None] < bound[None, :]) for at in range(0, len(factor), step)]
        path = np.concatenate([h[0] + k * step for k, h in enumerate(hits)]) if hits else np.empty(0, dtype=np.int64)
        picked = shingles[np.concatenate([h[1] for h in hits])] if hits else shingles[:0]
        odd, mark, above = odd[path], mark[path], parent[path]
        parent = Shingler._mix(Shingler._mix((picked ^ above) + mark) * np.uint64(0x9E3779B97F4A7C15) + mark)
        factor = (parent * np.uint64(2) + odd) | np.uint64(1)
        found.append((np.full(len(path), level, dtype=np.int32), above, parent))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common_shingles(docs: DataFrame, small: int, words: int) -> np.ndarray:
    """Sorted shingles that more than `small` documents and COMMON_SHARE of all have, counted over all documents: a
    shingle that reaches this share of all reaches it among the documents of some task, and only there it is passed on
    to be added up. Half the share is enough at the end, since the rest of its documents may not have been passed on."""
    n = docs.count()
    if n <= small:
        return np.empty(0, dtype=np.uint64)
    share = max(small / n, COMMON_SHARE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def often() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= max(2.0, share * len(held))
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for shingles in shingler.batch(batch.column(0)):
                held.append(shingles)
                size += len(shingles)
                if size >= COUNTED:
                    yield often()
                    held, size = [], 0
        if held:
            yield often()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= share * n / 2).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def sketch(docs: DataFrame, common: np.ndarray, threshold: float, runs: int, depth: int, words: int) -> DataFrame:
    """doc_id, text_hash, sig (null without words), size, the paths, and content: the shingles of those sets that sample
    common ones, as they will stand in large nodes. One narrow pass over the texts, written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    low, _ = shares(threshold)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = list(shingler.batch(batch.column(2)))
            found, content = [], []
            for s in sets:
                is_common = common_of(s, sent.value)
                found.append(paths(s, sampling(is_common, threshold), runs, depth))
                content.append(s.tobytes() if is_common.sum() > low * len(s) else None)
            level, parent, node = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0), np.empty(0), np.empty(0))
            ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
            steps = pa.StructArray.from_arrays([pa.array(level, type=pa.int32()), pa.array(parent.view(np.int64)), pa.array(node.view(np.int64))], names=["level", "parent", "node"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([signature(s) for s in sets], type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), steps), pa.array(content, type=pa.binary()),
                ],
                names=["doc_id", "text_hash", "sig", "size", "paths", "content"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(make, "doc_id long, text_hash long, sig binary, size long, paths array<struct<level:int,parent:long,node:long>>, content binary"), "sketch")


#: A document's place: its id, which may be null or used twice, and the hash of its text.
PLACE = ("rep", "text_hash")


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, which name documents by PLACE, with their texts. Only copies of a text can share a place."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.join(rows, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_hash") == F.col("text_hash"))).drop("_id", "_hash")


def with_sets(docs: DataFrame, classes: DataFrame, rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """rows (keys and class_no), with content: their shingles, from the classes or else from the texts."""
    rows = materialize(rows.select(*keys, "class_no").join(classes.select("class_no", "sig", *PLACE), "class_no"), "rows")
    known = classes.filter("content is not null").select("class_no", "content")
    held = rows.join(known, "class_no").select(*keys, "class_no", "content")
    rest = rows.join(known, "class_no", "left_anti")
    if rest.isEmpty():
        return held

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = list(shingler.batch(batch.column("text")))
            content = [x.tobytes() if signature(x) == sig else None for x, sig in zip(sets, batch.column("sig").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "class_no")), pa.array(content, type=pa.binary())], names=[*keys, "class_no", "content"])

    texts = with_text(docs, rest).select(*keys, "class_no", "sig", "text")
    return held.unionByName(texts.mapInArrow(read, held.schema).filter("content is not null"))


def balls(docs: DataFrame, classes: DataFrame, crowd: DataFrame, threshold: float, words: int) -> DataFrame:
    """class_no, ball: sets within half the allowed distance of a centre; of several the one with the most sets.

    crowd: node, n_members, class_no, size of the members of large nodes. A node's centre is the set of shingles that
    most of about CENTRE_OF members have, those with the least hashes, so that nodes of one dense group have the same
    centre as a rule."""
    at_least = (1 + threshold) / 2
    some = crowd.filter(F.pmod(F.xxhash64("class_no"), F.col("n_members")) < CENTRE_OF)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(node: int, sets: list[bytes]) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in sets]), return_counts=True)
            found = found[times * 2 > len(sets)]
            return pa.RecordBatch.from_arrays([pa.array([node], type=pa.int64()), pa.array([found.tobytes()], type=pa.binary()), pa.array([len(found)], type=pa.int64())], names=["node", "centre", "n"])

        node, sets = None, []
        for batch in batches:
            for now, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != node and sets:
                    yield finish(node, sets)
                    sets = []
                node = now
                sets.append(content)
        if sets:
            yield finish(node, sets)

    dealt = with_sets(docs, classes, some, ["node"], words).select("node", "content").repartition("node").sortWithinPartitions("node")
    centres = materialize(dealt.mapInArrow(centre, "node long, centre binary, n long").filter("n > 0").withColumn("ball", F.xxhash64("centre")), "centres")
    near = (
        crowd.join(centres.select("node", "ball", "n"), "node")
        .filter((F.col("size") >= at_least * F.col("n")) & (F.col("n") >= at_least * F.col("size")))
        .select("ball", "class_no")
        .distinct()
    )
    near = materialize(near, "near")
    parts = near.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = with_sets(docs, classes, near.join(parts, "ball").withColumn("part", F.pmod(F.xxhash64("class_no"), F.col("parts")).cast("int")), ["ball", "part"], words)
    heads = centres.select("ball", "centre").dropDuplicates(["ball"]).join(parts, "ball")
    heads = heads.select("ball", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("class_no"), F.col("centre").alias("content"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, middle = None, None
        for batch in batches:
            out = []
            for now, class_no, content in zip(*(batch.column(c).to_pylist() for c in ("ball", "class_no", "content")), strict=True):
                s = np.frombuffer(content, dtype=np.uint64)
                if class_no is None:
                    ball, middle = now, s
                    continue
                shared = len(np.intersect1d(s, middle, assume_unique=True))
                if now == ball and shared >= at_least * (len(s) + len(middle) - shared) + 1e-9:
                    out.append((class_no, now))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int64())], names=["class_no", "ball"])

    dealt = heads.unionByName(members).repartition("ball", "part").sortWithinPartitions("ball", "part", F.col("class_no").asc_nulls_first())
    held = materialize(dealt.mapInArrow(hold, "class_no long, ball long").distinct(), "held")
    tally = held.groupBy("ball").agg(F.count("*").alias("n"))
    return materialize(held.join(tally.filter("n > 1"), "ball").groupBy("class_no").agg(F.min_by("ball", F.struct(-F.col("n"), "ball")).alias("ball")), "balls")


def _with_partners(members: DataFrame, threshold: float) -> DataFrame:
    """The members of small nodes (node, class_no, size) whose size lets them be linked with another member: a set of less
    than threshold times another's size cannot be. The next smaller and the next larger member decide."""
    by_size = Window.partitionBy("node").orderBy("size")
    sizes = members.select("node", "class_no", "size", F.lag("size").over(by_size).alias("less"), F.lead("size").over(by_size).alias("more"))
    able = (F.col("less") >= threshold * F.col("size") - 1e-6) | (F.col("size") >= threshold * F.col("more") - 1e-6)
    return sizes.filter(able).select("node", "class_no", "size")


def _leaves(docs: DataFrame, classes: DataFrame, threshold: float, small: int, depth: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The members of every node that is compared (leaf, class_no, ball, inner: in the node's main ball, n_outer, n_inner,
    shingles), and the balls.

    Level by level: a node is compared if at most `small` members are outside its main ball, or on the last level; below
    it nothing is followed. Nodes with the same members are one leaf. A level's steps are dealt twice, to count nodes and
    to find their members; all that follows, for large nodes too, reads only the members of nodes that have several."""
    steps = classes.select("class_no", "size", F.explode("paths").alias("p")).select("class_no", "size", "p.level", "p.parent", "p.node")
    spread = classes.filter(F.lit(False)).select("class_no", F.lit(None).cast("long").alias("ball"))
    leaves, above = None, None
    for level in range(depth):
        here = steps.filter(F.col("level") == level)
        if above is not None:
            here = materialize(here.join(above, here["parent"] == above["large"], "left_semi").select("node", "class_no", "size"), "below")
        here = here.select("node", "class_no", "size")
        # the nodes grow with the documents, so they are never broadcast
        nodes = materialize(here.groupBy("node").agg(F.count("*").alias("n_members")).filter("n_members > 1"), "nodes")
        met = materialize(here.join(nodes.hint("merge"), "node"), "met")
        members = materialize(_with_partners(met.filter(F.col("n_members") <= small), threshold), "partners")
        crowd = met.filter(F.col("n_members") > small)
        crowded = not crowd.isEmpty()

        def facts_of(rows: DataFrame) -> DataFrame:
            number = F.xxhash64("class_no")
            return rows.groupBy("node").agg(
                F.count("*").alias("n_members"), F.sum("size").alias("shingles"), F.sum(number.bitwiseAND(0xFFFFFFFF)).alias("a"), F.sum(F.shiftrightunsigned(number, 32)).alias("b")
            )

        facts = facts_of(members).select("*", F.lit(None).cast("long").alias("main"), F.lit(0).cast("long").alias("n_inner"))
        if crowded:
            if level == 0:
                spread = balls(docs, classes, crowd, threshold, words)
            inside = crowd.join(spread, "class_no").groupBy("node", "ball").agg(F.count("*").alias("k"))
            inside = inside.groupBy("node").agg(F.max_by("ball", F.struct("k", "ball")).alias("main"), F.max("k").alias("n_inner"))
            ruled = facts_of(crowd).join(inside, "node", "left").withColumn("n_inner", F.coalesce("n_inner", F.lit(0).cast("long")))
            ruled = materialize(ruled, "ruled")
            ends = F.lit(level == depth - 1) | (F.col("n_members") - F.col("n_inner") <= small)
            facts = facts.unionByName(ruled.filter(ends))
            above = ruled.filter(~ends).select(F.col("node").alias("large"))
            members = members.unionByName(crowd.select("node", "class_no", "size"))
        one = facts.groupBy("n_members", "shingles", "a", "b").agg(F.min(F.struct("node", "main", "n_inner")).alias("x")).select("x.*", "n_members", "shingles")
        found = members.join(one.filter("n_inner < n_members").hint("merge"), "node").select(F.col("node").alias("leaf"), "class_no", "main", "n_inner", (F.col("n_members") - F.col("n_inner")).alias("n_outer"), "shingles")
        leaves = found if leaves is None else leaves.unionByName(found)
        if not crowded:
            break
    leaves = leaves.join(spread, "class_no", "left").withColumn("inner", F.coalesce(F.col("ball") == F.col("main"), F.lit(False))).drop("main")
    return leaves, spread


def compare(sets: list[np.ndarray], leaves: list[list[int]], copies: np.ndarray, ball: np.ndarray, side: np.ndarray | None, leaf: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members that have a link, the root of each (least member of its connected part), and the links to count for it:
    not those in one ball (0: none), and not those of an earlier leaf. side: 0 or 1 for the two blocks of a pair of
    blocks, whose inner pairs are compared elsewhere."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((m, m), dtype=np.float32)
    width, at = 4096, 0
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        end = np.searchsorted(column, first + width)
        part = np.zeros((m, min(width, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[owner[at:end], column[at:end] - first] = 1
        shared += part @ part.T
        at = end
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    linked = shared.astype(np.float64) * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    have = np.flatnonzero(linked.any(axis=1))
    if not len(have):
        return have, have, have
    linked = linked[np.ix_(have, have)]
    label = np.arange(len(have))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(have)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    before = {x for i in have for x in leaves[i] if x < leaf}
    number = {x: k for k, x in enumerate(before)}
    met = np.zeros((len(have), max(1, len(before))), dtype=np.float32)
    for row, i in enumerate(have):
        met[row, [number[x] for x in leaves[i] if x < leaf]] = 1
    own = ball[have]
    counted = linked & ((met @ met.T) == 0) & ((own[:, None] != own[None, :]) | (own[:, None] == 0))
    return have, have[label], counted @ copies[have]


def links(docs: DataFrame, classes: DataFrame, threshold: float, small: int, depth: int, words: int, block: int = BLOCK) -> DataFrame:
    """sig, root, n: the compared nodes' members that have links, each with the root of its part and the copies it links
    to; and the members of balls, with the copies in their ball.

    A leaf's outer members stand in blocks of their own, its inner ones (of its main ball) in others. Every outer block
    is compared with itself and all other blocks; two inner blocks never meet, so a member of a ball is sent to a leaf
    as often as the leaf has outer blocks."""
    leaves, spread = _leaves(docs, classes, threshold, small, depth, words)
    leaves = materialize(leaves, "leaves")
    members = leaves.groupBy("class_no", "ball").agg(
        F.sort_array(F.collect_set("leaf")).alias("leaves"), F.collect_set(F.struct("leaf", "inner", "n_outer", "n_inner", "shingles")).alias("nodes")
    )
    members = members.join(classes.select("class_no", "sig", *PLACE, "n_copies"), "class_no").drop("class_no")

    def blocks(n: Column) -> Column:
        return F.greatest(F.ceil(n / block), F.ceil(F.col("node.shingles") * n / (F.col("node.n_outer") + F.col("node.n_inner")) / BLOCK_SHINGLES)).cast("int")

    place = F.xxhash64("sig")
    inner = F.col("node.inner")
    dealt = (
        with_text(docs, members)
        .select("sig", "text", "n_copies", "ball", "leaves", F.explode("nodes").alias("node"))
        .withColumns({"outer": blocks(F.col("node.n_outer")), "more": blocks(F.col("node.n_inner"))})
        .withColumn("mine", F.when(inner, F.col("outer") + F.pmod(place, F.col("more"))).otherwise(F.pmod(place, F.col("outer"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("outer")).otherwise(F.col("outer") + F.col("more")) - 1)))
        .select(F.col("node.leaf").alias("leaf"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sig", "text", "n_copies", F.coalesce("ball", F.lit(0).cast("long")).alias("ball"), "leaves")
    )

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)

        def finish(key: tuple, held: dict) -> pa.RecordBatch:
            sigs = list(held)
            have = roots = n = np.empty(0, dtype=np.int64)
            if len(sigs) > 1:
                sets, copies, own, mine, ball = zip(*held.values(), strict=True)
                side = np.array(mine) if key[1] != key[2] else None
                have, roots, n = compare(list(sets), list(own), np.array(copies, dtype=np.float64), np.array(ball, dtype=np.int64), side, key[0], threshold)
            return pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in have], type=pa.binary()), pa.array([sigs[i] for i in roots], type=pa.binary()), pa.array(n.astype(np.int64))], names=["sig", "root", "n"])

        key, held = None, {}
        for batch in batches:
            leaf, i, j, mine, sig, n_copies, ball, own = (batch.column(c).to_pylist() for c in ("leaf", "i", "j", "mine", "sig", "n_copies", "ball", "leaves"))
            sets = shingler.batch(batch.column("text"))
            for k, shingles in enumerate(sets):
                if (now := (leaf[k], i[k], j[k])) != key:
                    if held:
                        yield finish(key, held)
                    key, held = now, {}
                if sig[k] not in held:
                    if signature(shingles) == sig[k]:  # another text may have the same hash
                        held[sig[k]] = (shingles, n_copies[k], own[k], mine[k], ball[k])
        if held:
            yield finish(key, held)

    dealt = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    compared = dealt.mapInArrow(brute, "sig binary, root binary, n long")
    held = spread.join(classes.select("class_no", "sig", "n_copies"), "class_no")
    whole = held.groupBy("ball").agg(F.min("sig").alias("root"), F.sum("n_copies").alias("copies"))
    return compared.unionByName(held.join(whole, "ball").select("sig", "root", (F.col("copies") - F.col("n_copies")).alias("n")))


def components(edges: DataFrame) -> DataFrame:
    """id, root for every end of the edges (u, v): large-star and small-star steps, as joins with the least neighbour,
    until nothing changes. No node's neighbours are ever gathered in one place."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFFFF))).first())

    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while True:
        all_ways = both(edges)
        least = all_ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = all_ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")  # u > v: every end points at its least neighbour's least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after


def _classified(docs: DataFrame, threshold: float, recall: float, words: int, small: int, depth: int, block: int) -> DataFrame:
    """The columns of near_duplicates with text_hash and class_hash: the class's first row is (class_id, class_hash)."""
    common = common_shingles(docs, small, words)
    rows = sketch(docs, common, threshold, runs_for(recall, depth), depth, words)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")  # null ids last
    groups = rows.filter("sig is not null").groupBy("sig").agg(first, F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("paths").alias("paths"), F.first("content").alias("content"))
    classes = materialize(groups.select(F.monotonically_increasing_id().alias("class_no"), "sig", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n_copies", "size", "paths", "content"), "classes")
    found = materialize(links(docs, classes, threshold, small, depth, words, block), "links")
    tally = found.groupBy("sig").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("sig").alias("u"), F.col("root").alias("v")))
    known = (
        classes.select("sig", "rep", F.col("text_hash").alias("rep_hash"), "n_copies")
        .join(tally, "sig", "left")
        .join(parts.select(F.col("id").alias("sig"), "root"), "sig", "left")
        .filter("n_copies > 1 or n is not null")
        .withColumn("root", F.coalesce("root", "sig"))
    )
    known = materialize(known, "known")
    least = known.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "rep_hash")).alias("least"))
    known = known.join(least, "root").select("sig", "rep", "n_copies", "n", F.col("least.rep").alias("class_id"), F.col("least.rep_hash").alias("class_hash"))
    alone = F.col("n_copies").isNull()
    return rows.select("doc_id", "text_hash", "sig").join(known, "sig", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.coalesce("n_copies", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        "text_hash",
        F.when(alone, F.col("text_hash")).otherwise(F.col("class_hash")).alias("class_hash"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (least doc_id of all documents that links connect with it), copy_id
    (least doc_id with the same shingle set), n_copies, n_links (rows it is at least threshold-similar to, copies
    included).

    Null, blank or otherwise wordless texts link to nothing: class_id and copy_id are their own id. Repeated rows and
    repeated ids are rows of their own; a class whose ids are all null has a null id. Other columns are not read."""
    return _classified(docs, threshold, recall, words, small, depth, block).drop("text_hash", "class_hash")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """docs with one document of each class of near duplicates: the one with the least id, in all its columns. Rows without
    words or without an id stay. A row goes by its id and its text, so one whose id stands on another text too stays if its
    own text does; of rows with one id and one text the first in the order of their JSON stays."""
    found = _classified(docs, threshold, recall, words, small, depth, block).filter("doc_id is not null")
    wins = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    losers = found.filter(~F.coalesce(wins, F.lit(False))).select("doc_id", "text_hash").distinct()
    repeated = found.filter(wins & (F.col("n_copies") > 1)).groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    keys = ["doc_id", "text_hash"]
    kept = rows.join(losers, keys, "left_anti")
    once = kept.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.join(repeated, keys, "left_anti").select("_row").unionByName(once.select("_row")).select("_row.*")
