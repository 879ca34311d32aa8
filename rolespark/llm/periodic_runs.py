"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least max(6, 4 q) that
cannot be made longer. On the diagonal of lag q it is a match of length - q words in a row.

The DP goes over the words of a text. Its state is the active lag of a word and for how many words in a row that lag has
been active; when the lag changes, the diagonal ends, and it emits a run if it is long enough. To follow every earlier
occurrence of a word would cost the square of the count of a frequent word, so the lag of a word is the distance to the
nearest earlier occurrence of the 2^j words that begin with it, for each j by itself. That misses nothing: take the j
with 2^j / 2 < q <= 2^j. Within the run the 2^j words at a place hold a whole period, and a period that is no smaller
period's multiple does not occur in its own repetition but at multiples of q, so the nearest earlier occurrence lies q
back, at each word from the run's second period to 2^j words before its end (at least q words, as the length is 4 q).
The diagonal is active exactly there, so its two ends give the run's two ends. Contexts that stand once in a text are
left out of the next j, so the work is about one sort of the words, and n log n at worst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least length of a run: in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _by_key(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key and at in the order of (key, at); at is ascending. Both are packed into one integer where they fit."""
    bits = int(at[-1]).bit_length()
    if int(key.max()) < 1 << (63 - bits):
        packed = np.sort(key << bits | at)
        return packed >> bits, packed & ((1 << bits) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], at[order]


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (place in words), length, period of all runs of texts that stand one after the other. words: a number for
    each word, ends: for each word the end of its text."""
    n = len(words)
    none = np.empty(0, dtype=np.int64)
    found = [(none, none, none)]
    at, key, size = np.arange(n), words.astype(np.int64), 1
    while len(at):
        key, at = _by_key(key, at)
        same = (key[1:] == key[:-1]) & (ends[at[1:]] == ends[at[:-1]])
        lag = np.zeros(n, dtype=np.int64)
        lag[at[1:][same]] = (at[1:] - at[:-1])[same]
        active = np.flatnonzero((lag > size // 2) & (lag <= size))
        if len(active):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(active) != 1) | (np.diff(lag[active]) != 0)]))
            last = active[np.concatenate([begins[1:], [len(active)]]) - 1]
            first, period = active[begins], lag[active[begins]]
            length = last + size - first + period
            long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append(((first - period)[long], length[long], period[long]))
        # contexts of twice the size: both halves stand more than once in the text
        fresh = np.concatenate([[True], ~same])
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        number = np.full(n, -1, dtype=np.int64)
        number[at[again]] = (np.cumsum(fresh) - 1)[again]
        at = np.flatnonzero(number >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[number[at + size] >= 0]
        _, dense = np.unique(number[np.concatenate([at, at + size])], return_inverse=True)
        key = dense[: len(at)] * (int(dense.max(initial=0)) + 1) + dense[len(at) :]
        size *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunk(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values
    filled = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False))
    bounds = np.searchsorted(filled, bounds)  # without the empty words at the ends of texts
    flat = flat.take(pa.array(filled))
    n = len(flat)
    if n:
        start, length, period = find_runs(flat.dictionary_encode().indices.to_numpy(), np.repeat(bounds[1:], np.diff(bounds)))
    else:
        start = length = period = np.empty(0, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept))), " ")
    of = np.searchsorted(start, bounds)
    fields = [pa.array(start - bounds[np.searchsorted(bounds, start, side="right") - 1]), pa.array(length), pa.array(period)]
    runs = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return runs, joined


def _pieces(texts: pa.Array, characters: int = 6_000_000) -> Iterator[pa.Array]:
    """Slices of so many bytes, or of one longer text."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + characters, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


@F.arrow_udf(T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]))
def _detect(texts: pa.Array) -> pa.Array:
    found = [_chunk(x) for x in _pieces(texts)] or [(pa.array([], _RUNS), pa.array([], pa.string()))]
    runs, collapsed = (pa.concat_arrays(list(x)) for x in zip(*found, strict=True))
    return pa.StructArray.from_arrays([runs.cast(_RUNS), collapsed], names=["runs", "collapsed"])


def detect(text: Column) -> Column:
    """Struct of a text's runs and of its collapsed text. Words are what blanks, tabs, line feeds, vertical tabs, form feeds
    and carriage returns leave between them.

    runs: (start, length, period) in words from 0, by start, then period; runs may overlap, and each is listed.
    collapsed: the words that no run contains after its first period, joined by one blank.
    A null, empty or blank text has no runs and an empty collapsed text. A text is looked at whole, however long, and each
    row by itself: repeated rows, ties and the other columns of a table make no difference."""
    return _detect(text)
