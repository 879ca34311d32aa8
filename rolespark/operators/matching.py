"""Matching of company names with filing employers: alias, then exact, then fuzzy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from rolespark.config import DEFAULT, Config
from rolespark.functions.helpers import rarest_pieces, token_sort_ratio
from rolespark.storage import shuffles_removed, written


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.sort_array(F.array_remove(F.split(name, r"\s+"), "")), " ")


def _longest(n: Column, share: float) -> Column:
    """Length of the longest text that a text of n characters can match, share being 1 - cutoff / 100."""
    return F.floor(n * (1 + share) / (1 - share) + 1e-9).cast("int")


def _budget(n: Column, share: float) -> Column:
    """Most characters inserted and deleted between a text of n characters and any text that it can match."""
    return F.floor(share * (n + _longest(n, share)) + 1e-9).cast("int")


def _piece_length(n: Column, share: float) -> Column:
    """Length of the pieces if a text of n characters is cut into one more than its budget."""
    return F.greatest(F.floor(n / (_budget(n, share) + 1)), F.lit(1)).cast("int")


def _cut_lengths(share: float) -> tuple[Column, Column]:
    """Shortest and longest piece that a text may be cut into."""
    length = _piece_length(F.col("n"), share)
    return F.greatest(length - 1, F.lit(1)), F.least(length + 1, F.col("n"))


def _met_lengths(share: float) -> tuple[Column, Column]:
    """Shortest and longest piece that a partner of a text may be cut into, up to the text's own length."""
    partners = F.transform(F.sequence(F.ceil(F.col("n") * (1 - share) / (1 + share) - 1e-9).cast("int"), _longest(F.col("n"), share)), lambda n: _piece_length(n, share))
    return F.greatest(F.array_min(partners) - 1, F.lit(1)), F.least(F.array_max(partners) + 1, F.col("n"))


def _substrings(shortest: Column, longest: Column) -> Column:
    """Number of substrings of these lengths."""
    return ((longest - shortest + 1) * (2 * F.col("n") + 2 - shortest - longest) / 2).cast("long")


def _hashes(by: list[str], shortest: Column, longest: Column) -> Column:
    """Hashes (with by) of all substrings of these lengths, by length and place."""
    return F.flatten(F.transform(F.sequence(shortest, longest), lambda q: F.transform(F.sequence(F.lit(0), F.col("n") - q), lambda pos: F.xxhash64(*by, F.substr("text", pos + 1, q)))))


_WORDS = 4


def _signature(text: Column, n: Column) -> list[Column]:
    """The text's bigrams as bits of _WORDS longs, each bigram one bit."""
    bits = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(2))), F.lit(64 * _WORDS)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(k: int) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / 64) == k)
        return F.aggregate(mine, none, lambda x, b: x.bitwiseOR(F.call_function("shiftleft", one, F.pmod(b, F.lit(64)).cast("int"))))

    return [word(k) for k in range(_WORDS)]


def _index(names: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, name, text, n, id and the signature _0, _1, ... of each name, written once."""
    each = names.select(*by, F.col(column).alias("name")).filter("name is not null").distinct().withColumn("text", sorted_tokens(F.col("name")))
    each = each.filter("text <> ''").withColumns({"n": F.length("text"), "id": F.xxhash64(*by, "name")})
    return written(each.withColumns({f"_{k}": word for k, word in enumerate(_signature(F.col("text"), F.col("n")))}), "names")


#: Places in which occurrences of substrings are counted, and the most bits that tell which substrings are pieces.
COUNTERS, MOST_BITS = 1 << 20, 1 << 28
PIECES = ArrayType(StructType([StructField("pos", IntegerType()), StructField("q", IntegerType())]))


def _pieces(cut: DataFrame, met: DataFrame, share: float, by: list[str]) -> DataFrame:
    """cut with the array p of each text's pieces (pos, q), those with the fewest occurrences in met. Occurrences are counted
    by hash in COUNTERS places: which pieces are taken decides how many pairs meet, not which are found."""
    places = met.select(F.explode(_hashes(by, *_met_lengths(share))).alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).cast("int").alias("at")).count()
    found = places.toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[found["at"].to_numpy()] = found["count"].to_numpy()
    sent, kept = cut.sparkSession.sparkContext.broadcast(counts), cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often = pd.Series([sent.value[h % COUNTERS] for h in batch["_h"].to_numpy(zero_copy_only=False)], dtype=object)
            chosen = rarest_pieces(often, *(batch[c].to_pandas() for c in ("n", "_pieces", "_length")))
            p = pa.array(list(chosen), pa.list_(pa.struct([("pos", pa.int32()), ("q", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, p], names=[*kept, "p"])

    n = F.col("n")
    asked = cut.withColumns({"_h": _hashes(by, *_cut_lengths(share)), "_pieces": _budget(n, share) + 1, "_length": _piece_length(n, share)})
    return written(asked.mapInArrow(run, StructType([*cut.schema.fields, StructField("p", PIECES)])), "pieces")


def _meeting(pieces: DataFrame, met: DataFrame, share: float, by: list[str]) -> DataFrame:
    """id, n, the signature, pos and h of those substrings of met that may be pieces: eight bits or more a piece, up to
    MOST_BITS, tell which, so few of the others are sent anywhere. pieces: h of each piece."""
    bits = min(MOST_BITS, 1 << max(16, (8 * pieces.count() - 1).bit_length()))
    bit = F.pmod("h", F.lit(bits))
    words = pieces.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("word")).toArrow()
    held = np.zeros(bits // 64, dtype=np.int64)
    held[words["at"].to_numpy()] = words["word"].to_numpy()
    sent = met.sparkSession.sparkContext.broadcast(held)
    carried = ["id", "n", *[f"_{k}" for k in range(_WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            h, sizes = batch["h"].flatten().to_numpy(), pc.list_value_length(batch["h"]).to_numpy()
            bit = h % bits
            hits = np.flatnonzero((held[bit >> 6] >> (bit & 63)) & 1)
            row = np.repeat(np.arange(len(sizes)), sizes)[hits]
            pos, q = hits - (np.cumsum(sizes) - sizes)[row], batch["shortest"].to_numpy()[row]
            room = batch["n"].to_numpy()[row] + 1 - q  # substrings of this length
            while (over := pos >= room).any():
                pos, room = np.where(over, pos - room, pos), np.where(over, room - 1, room)
            yield pa.RecordBatch.from_arrays([*batch.select(carried).take(pa.array(row)).columns, pa.array(pos.astype(np.int32)), pa.array(h[hits])], names=[*carried, "pos", "h"])

    shortest, longest = _met_lengths(share)
    schema = ", ".join(f"{c} {'int' if c == 'n' else 'long'}" for c in carried) + ", pos int, h long"
    return met.select(*carried, shortest.alias("shortest"), _hashes(by, shortest, longest).alias("h")).mapInArrow(run, schema)


def _candidates(left: DataFrame, right: DataFrame, share: float, by: list[str]) -> DataFrame:
    """fuzzy_candidates of two indexes."""
    sizes = [F.coalesce(F.sum(c), F.lit(0)) for c in (_budget(F.col("n"), share) + 1, _substrings(*_met_lengths(share)))]
    (left_cut, left_met), (right_cut, right_met) = (x.agg(*sizes).first() for x in (left, right))
    turned = right_cut + left_met < left_cut + right_met
    cut, met = (right, left) if turned else (left, right)
    pieces = _pieces(cut, met, share, by).select("id", "text", "n", *by, *[f"_{k}" for k in range(_WORDS)], F.explode("p").alias("p")).withColumn("h", F.xxhash64(*by, F.substr("text", F.col("p.pos") + 1, F.col("p.q"))))
    y = _meeting(pieces.select("h"), met, share, by)
    x = pieces.select("h", F.col("id").alias("x"), F.col("n").alias("ln"), F.col("p.pos").alias("at"), *[F.col(f"_{k}").alias(f"l{k}") for k in range(_WORDS)])
    y = y.select("h", F.col("id").alias("y"), F.col("n").alias("rn"), "pos", *[F.col(f"_{k}").alias(f"r{k}") for k in range(_WORDS)])
    edits = F.floor(share * (F.col("ln") + F.col("rn")) + 1e-9).cast("int")
    gone, come = F.floor((edits + F.col("ln") - F.col("rn")) / 2), F.floor((edits + F.col("rn") - F.col("ln")) / 2)
    near = (gone >= 0) & (come >= 0) & (F.col("pos") - F.col("at")).between(-gone, come)
    lacking = sum((F.bit_count(F.col(f"l{k}").bitwiseAND(F.bitwise_not(F.col(f"r{k}")))) for k in range(_WORDS)), F.lit(0))
    pairs = x.join(y.hint("merge"), "h").filter(near).filter(lacking <= 2 * gone + come).select("x", "y").distinct()
    l, r = (i.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in by], F.col("name").alias(f"{side}_name"), F.col("text").alias(f"{side[0]}t")) for i, key, side in ((left, "y" if turned else "x", "left"), (right, "x" if turned else "y", "right")))
    named = pairs.join(l.hint("merge"), "y" if turned else "x").join(r.hint("merge"), "x" if turned else "y")
    for c in by:
        named = named.filter(F.col(f"{c}_left") == F.col(f"{c}_right")).withColumnRenamed(f"{c}_left", c)
    return named.select(*by, "left_name", "right_name", "lt", "rt")


def fuzzy_candidates(left: DataFrame, right: DataFrame, cutoff: float = 90.0, by: list[str] | None = None) -> DataFrame:
    """by, left_name, right_name, lt, rt: all pairs at or above the cutoff, and few others, found without a user function on
    pairs. by: columns that a pair must have in common (such as the company of two titles); a large group of them is dealt
    by its pieces like everything else.

    A pair at the cutoff differs by at most d inserted or deleted characters, and each spoils one of d + 1 disjoint pieces
    of one text at most: one piece stands in the other text, shifted by no more than the characters inserted or deleted
    before it. The pieces are those with the fewest occurrences among the other side's texts; the side is cut that makes
    the fewer rows. A pair that meets must also not lack more of the cut text's bigrams than its edits spoil.

    A name has some hundred substrings. What is dealt out of them is hashes and numbers, not texts, and only of those that
    may be pieces; names come back to the pairs at the end. Equal hashes of different substrings or names only add pairs,
    which the score takes away. A piece that very many texts have makes a large join partition, which Spark splits (its skew
    join is on by default). Spark's size estimates leave the substrings out, so their join is a sort-merge join by hint."""
    by = by or []
    return _candidates(_index(left, "left_name", by), _index(right, "right_name", by), 1 - cutoff / 100, by)


def fuzzy_pairs(left: DataFrame, right: DataFrame, cutoff: float = 90.0, by: list[str] | None = None) -> DataFrame:
    """by, left_name, right_name, score for all pairs with a token-sorted Indel similarity of at least cutoff."""
    return _scored(fuzzy_candidates(left, right, cutoff, by), cutoff, by or [])


def _scored(pairs: DataFrame, cutoff: float, by: list[str]) -> DataFrame:
    scored = pairs.withColumn("score", token_sort_ratio("lt", "rt"))
    return scored.filter(F.col("score") >= cutoff).select(*by, "left_name", "right_name", "score")


#: Bounds of the rounds before the one at the cutoff.
BOUNDS = (96.0,)


def fuzzy_match_topone(left: DataFrame, right: DataFrame, cutoff: float = 90.0, by: list[str] | None = None, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """The best partner of each left name (within by); ties to the least name.

    Rounds go from the highest bound down. A round finds all pairs at or above its bound, with fewer and longer pieces the
    higher it is, so a name that has one has its best partner, and leaves. Only the others meet the short pieces of the
    cutoff."""
    by = by or []
    keys = [*by, "left_name"]
    best = F.min_by(F.struct("right_name", "score"), F.struct(-F.col("score"), F.col("right_name")))
    found = None
    with shuffles_removed(left.sparkSession):
        rest, partners = _index(left, "left_name", by), _index(right, "right_name", by)
        for bound in [*sorted((b for b in bounds if b > cutoff), reverse=True), cutoff]:
            pairs = _scored(_candidates(rest, partners, 1 - bound / 100, by), bound, by)
            won = pairs.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.right_name", "m.score")
            if bound > cutoff:
                won = written(won, "matches")
                rest = written(rest.join(won.select(*by, F.col("left_name").alias("name")), [*by, "name"], "left_anti"), "rest")
            found = won if found is None else found.unionByName(won)
    return found


MATCH_COLUMNS = ("lca_match_name", "lca_match_score", "filings_total", "filings_relevant_soc", "ny_nj_filings", "match_source", "entities")


def match_employer(names: DataFrame, employers: DataFrame, aliases: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """company_norm and MATCH_COLUMNS for each distinct name that matches. aliases: alias_norm, target_norm, pos. An alias
    adds up those of its targets that exist; without any it falls through to the exact and the fuzzy step."""
    wanted = names.select("company_norm").filter("company_norm is not null").distinct()
    facts = employers.select("employer_norm", "employer_raw", "filings_total", "filings_relevant_soc", "ny_nj_filings")
    by_alias = (
        wanted.join(aliases, wanted["company_norm"] == aliases["alias_norm"])
        .join(facts, F.col("target_norm") == facts["employer_norm"])
        .groupBy("company_norm")
        .agg(
            *[F.sum(c).alias(c) for c in ("filings_total", "filings_relevant_soc", "ny_nj_filings")],
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "employer_raw"))), lambda x: x["employer_raw"]).alias("entities"),
        )
        .select("company_norm", F.col("company_norm").alias("lca_match_name"), F.lit(100.0).alias("lca_match_score"), "filings_total", "filings_relevant_soc", "ny_nj_filings", F.lit("alias").alias("match_source"), "entities")
    )

    def direct(pairs: DataFrame, source: str) -> DataFrame:
        return pairs.select("company_norm", F.col("employer_raw").alias("lca_match_name"), "score", "filings_total", "filings_relevant_soc", "ny_nj_filings", F.lit(source).alias("match_source"), F.array("employer_raw").alias("entities")).withColumnRenamed("score", "lca_match_score")

    rest = wanted.join(by_alias.select("company_norm"), "company_norm", "left_anti")
    exact = direct(rest.join(facts, F.col("company_norm") == F.col("employer_norm")).withColumn("score", F.lit(100.0)), "exact")
    rest = rest.join(facts, F.col("company_norm") == F.col("employer_norm"), "left_anti")
    best = fuzzy_match_topone(rest.withColumnRenamed("company_norm", "left_name"), facts.select(F.col("employer_norm").alias("right_name")), config.fuzzy_cutoff)
    fuzzy = direct(best.join(facts, best["right_name"] == facts["employer_norm"]).withColumnRenamed("left_name", "company_norm"), "fuzzy")
    return by_alias.unionByName(exact).unionByName(fuzzy)


def apply_lca(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """Fills the filing columns of kept jobs; without a match they stay null, never 0."""
    found = matches.select("company_norm", F.col("filings_total").alias("_f"), F.col("filings_relevant_soc").alias("_r"), F.col("lca_match_name").alias("_n"), F.col("lca_match_score").alias("_s"))
    kept = F.col("status") != "excluded"
    out = jobs.drop("lca_filings", "lca_relevant_soc", "lca_match_name", "lca_match_score").join(found, "company_norm", "left")
    return out.select(
        *[c for c in out.columns if c not in ("_f", "_r", "_n", "_s")],
        F.when(kept, F.col("_f")).cast("int").alias("lca_filings"),
        F.when(kept, F.col("_r")).cast("int").alias("lca_relevant_soc"),
        F.when(kept, F.col("_n")).alias("lca_match_name"),
        F.when(kept, F.col("_s")).alias("lca_match_score"),
    )


#: Titles of one company's history that a title is compared with one by one.
DIRECT_TITLES = 200


def already_applied(jobs: DataFrame, history: DataFrame, cutoff: float = 90.0) -> DataFrame:
    """Distinct (company_norm, title_norm) of jobs that the history has: equal titles of one company by a join, the others
    by the fuzzy score within the company. Where a company's history is short a title is compared with all of it; where it
    is long the titles meet on pieces, so no company is compared each with each."""
    keys = ["company_norm", "title_norm"]
    wanted = written(jobs.select(*keys).filter("company_norm is not null and title_norm is not null").distinct(), "titles")
    known = history.select(*keys).filter("title_norm is not null").distinct()
    same = wanted.join(known, keys, "left_semi")
    rest = wanted.join(known, keys, "left_anti")
    sizes = known.groupBy("company_norm").agg(F.count("*").alias("_n"))
    long = sizes.filter(F.col("_n") > DIRECT_TITLES).select("company_norm")
    listed = known.join(long, "company_norm", "left_anti").withColumnRenamed("title_norm", "known")
    a, b = F.length(F.col("title_norm")), F.length(F.col("known"))
    able = 200.0 * F.least(a, b) >= cutoff * (a + b)
    near = rest.join(listed, "company_norm").filter(able).filter(token_sort_ratio("title_norm", "known") >= cutoff).select(*keys).distinct()
    if not long.isEmpty():
        left, right = (x.join(long, "company_norm", "left_semi").withColumnRenamed("title_norm", name) for x, name in ((rest, "left_name"), (known, "right_name")))
        near = near.unionByName(fuzzy_match_topone(left, right, cutoff, ["company_norm"]).select("company_norm", F.col("left_name").alias("title_norm")))
    return same.unionByName(near)
