"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives the longest match at any place of an unknown text. Parsing
a text into longest matches, one after the other, needs fewer phrases the closer the text is to the language; a phrase
costs the logarithm of the language's text length, and the cheapest language wins. Each language has its own letters:
a letter that a language's sample lacks ends the phrase in that language alone, so no script crowds out another. Texts
are parsed in segments that run side by side as lanes of arrays; the end of a segment ends a phrase, which adds at most
one phrase for each further segment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: documents a language, characters of each, and characters of all automata together.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 400
MODEL_CHARS = 4_000_000
#: Widest alphabet whose transitions are a table; wider ones are sorted keys.
TABLE_WIDTH = 96
SEGMENT = 512
LANES = 4096
UNDETERMINED = "und"


def letters(text: str) -> str:
    """Lower-cased, every run of other characters than letters one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@dataclass
class Automaton:
    """Transitions from states by codes. keys are state * width + code of all transitions, ascending, and ends their
    states; a narrow alphabet has them as a table of states by codes instead, -1 where there is none."""

    own: np.ndarray  # the code here of each code of the model; 0 for blanks, the last for letters not in this language
    width: int
    table: np.ndarray | None
    keys: np.ndarray | None
    ends: np.ndarray | None

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = state * self.width + code
        if self.table is not None:
            return self.table[at]
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[place] == at, self.ends[place], -1)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def packed(go: list[dict[int, int]], own: np.ndarray, width: int) -> Automaton:
    if width <= TABLE_WIDTH:
        table = np.full((len(go), width), -1, dtype=np.int32)
        for state, out in enumerate(go):
            for c, to in out.items():
                table[state, c] = to
        return Automaton(own, width, table.ravel(), None, None)
    flat = np.array(sorted((state * width + c, to) for state, out in enumerate(go) for c, to in out.items()), dtype=np.int64)
    return Automaton(own, width, None, flat[:, 0].copy(), flat[:, 1].astype(np.int32))


@dataclass
class Model:
    """The languages in ascending order, their automata, and the code of each code point: 0 for blanks, 1 to n for the
    letters of all samples, n + 1 for other letters (they match nothing)."""

    languages: list[str]
    codes: np.ndarray
    automata: list[Automaton]
    cost: np.ndarray  # bits of a phrase

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = self.codes[points]
        blank = codes == 0
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        kept = codes[keep]
        return kept[:-1] if len(kept) and kept[-1] == 0 else kept

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text for each language; every segment of a text is parsed by itself."""
        owner, parts = [], []
        for k, codes in enumerate(texts):
            for at in range(0, len(codes), SEGMENT):
                owner.append(k)
                parts.append(codes[at : at + SEGMENT])
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
        for first in range(0, len(order), LANES):
            lanes = order[first : first + LANES]
            sizes = np.array([len(parts[i]) for i in lanes])
            block = np.zeros((sizes[0], len(lanes)), dtype=np.int64)
            for lane, i in enumerate(lanes):
                block[: sizes[lane], lane] = parts[i]
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than each step
            who = np.array([owner[i] for i in lanes])
            for k, one in enumerate(self.automata):
                np.add.at(out[:, k], who, self._parse(one.own[block], active, one))
        return out

    @staticmethod
    def _parse(block: np.ndarray, active: np.ndarray, one: Automaton) -> np.ndarray:
        root = np.maximum(one.step(np.zeros(one.width, dtype=np.int64), np.arange(one.width)), 0).astype(np.int64)
        state = np.zeros(block.shape[1], dtype=np.int64)
        count = np.zeros(block.shape[1], dtype=np.int64)
        for step, n in enumerate(active):
            c = block[step, :n]
            to = one.step(state[:n], c)
            count[:n] += (to < 0) | (state[:n] == 0)  # a phrase begins
            state[:n] = np.where(to < 0, root[c], to)
        return count


def learn(docs: DataFrame, id_col: str = "doc_id") -> Model:
    """Fits on a bounded sample of the labelled rows of docs (columns id_col, text, lang): for each language about
    SAMPLE_DOCS documents by the hash of their id and text, SAMPLE_CHARS characters of each, copies once. Which rows
    are taken depends on ids and texts alone, not on how the rows lie, and for each language by itself. All samples
    together have at most MODEL_CHARS characters: from 105 languages on, each has fewer."""
    named = docs.filter("lang is not null")
    sizes = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], np.zeros(0x110000, dtype=np.uint32), [], np.zeros(0))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_DOCS / n))).otherwise(share)
    place = F.pmod(F.xxhash64(id_col, "text"), F.lit(1 << 30))
    picked = named.filter("text is not null").select(place.alias("place"), "lang", "text").filter(F.col("place") <= share * float(1 << 30))
    parts = picked.select("lang", "place", F.substring("text", 1, SAMPLE_CHARS).alias("part")).groupBy("lang", "part").agg(F.min("place").alias("place"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "part"))
    rows = parts.withColumn("turn", turn).filter(F.col("turn") <= 4 * SAMPLE_DOCS).orderBy("lang", "turn").collect()
    each = min(SAMPLE_DOCS * SAMPLE_CHARS, MODEL_CHARS // len(sizes))
    texts: dict[str, str] = {}
    for lang in sorted(sizes):
        parts = dict.fromkeys(letters(r["part"]) for r in rows if r["lang"] == lang)
        joined = " ".join(p for p in parts if p)[:each]
        if joined:
            texts[lang] = joined
    return fit(texts)


def fit(texts: dict[str, str]) -> Model:
    names = sorted(texts)
    alphabet = sorted({c for text in texts.values() for c in text} - {" "})
    other = len(alphabet) + 1
    codes = np.fromiter((other if chr(p).isalpha() else 0 for p in range(0x110000)), dtype=np.uint32, count=0x110000)
    codes[[ord(c) for c in alphabet]] = np.arange(1, other)
    automata = []
    for name in names:
        mine = sorted(set(texts[name]) - {" "})
        number = {" ": 0} | {c: k + 1 for k, c in enumerate(mine)}
        own = np.full(other + 1, len(mine) + 1, dtype=np.int64)
        own[0] = 0
        own[codes[[ord(c) for c in mine]]] = np.arange(1, len(mine) + 1)
        automata.append(packed(automaton([number[c] for c in texts[name]]), own, len(mine) + 2))
    return Model(names, codes, automata, np.array([np.log2(max(2, len(texts[n]))) for n in names]))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row. lang_pred is `und` (score 0) for a null text, a text without letters, or a
    model without languages; ties go to the first language in ascending order. score: 1 - cost of the best / cost of
    the next language, 1 if there is one language. Only doc_id and text are read; rows are judged each by itself."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(1).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            held: list[tuple[int, np.ndarray]] = []
            room = 0
            for k, t in enumerate([*texts, None]):
                if k < len(texts) and t is not None and model.languages:
                    held.append((k, codes := model.encode(t)))
                    room += len(codes)
                if held and (room > LANES * SEGMENT or k == len(texts)):
                    cost = model.phrases([c for _, c in held]) * model.cost
                    for (i, _), row in zip(held, cost, strict=True):
                        best = int(np.argmin(row))
                        rest = np.delete(row, best)
                        names[i] = model.languages[best]
                        scores[i] = float(1 - row[best] / rest.min()) if len(rest) else 1.0
                    held, room = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tell, "doc_id long, lang_pred string, score double")
