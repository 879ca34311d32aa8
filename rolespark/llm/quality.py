"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.llm.common import let, words_of

SYMBOLS = "#*$%&|<>"
# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the be to of and that have with this for is was in it on are as at by from "
    "de la le les et des en un une du que est pour qui dans par sur au avec "
    "el los las y se del una por con no su para al lo como "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine"
).split()
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= measure <= high; a missing bound does not limit."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value = F.col(self.measure)
        below = F.lit(False) if self.low is None else value < F.lit(self.low)
        above = F.lit(False) if self.high is None else value > F.lit(self.high)
        return below | above


#: The production table. The first two are the base rules.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "repeat_percent", high=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols", "symbols_per_word", high=0.2),
    Rule("exclamations", "exclamations_per_word", high=0.3),
    Rule("capitals", "capital_ratio", high=0.4),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)
BASE_RULES = ("too_short", "repeated_windows")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Each window becomes one long: the upper bits of its hash, then its place in as many bits as the text needs. Sorting
    these puts equal windows side by side (n log n for any text); neighbours are compared word by word."""
    places = F.size(words)
    bits = F.ceil(F.log2(places + 1)).cast("int")

    def window(w: Column, i: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long"))

    packed = F.transform(F.slice(words, F.lit(1), F.greatest(places - 2, F.lit(0))), window)
    low = F.call_function("shiftleft", F.lit(1), bits) - 1

    def same(i: Column, j: Column) -> Column:
        match = F.get(words, i) == F.get(words, j)
        for k in (1, 2):
            match = match & (F.get(words, i + k) == F.get(words, j + k))
        return match

    def repeated(s: Column) -> Column:
        def beside(x: Column, k: Column) -> Column:
            y = F.get(s, k)
            near = F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
            return near & same(x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int"))

        marked = F.transform(s, lambda x, k: F.when(beside(x, k - 1) | beside(x, k + 1), x.bitwiseAND(low).cast("int")))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        let(F.sort_array(packed), repeated),
        start,
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    )
    return covered.cast("long")


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts and ratios of its texts. A null text counts as empty; ratios of a text without words
    are 0. Columns of docs with the name of a measure are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)
    with_word = F.filter(F.split(text, "\n"), lambda x: _without(x, " \t\n\x0b\x0c\r") > 0)
    lines = let(with_word, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            _repeat_words(w).alias("repeat"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("stop"),
        ),
    )
    characters = F.length(text)
    # a filter on what follows is not pushed below a column that is not deterministic; else each rule would count anew
    out = docs.withColumns({"_rule_w": counted, "_rule_l": lines, "word_chars": _without(text, " \t\n\x0b\x0c\r").cast("long"), "_rule_once": F.monotonically_increasing_id()})
    out = out.withColumns(
        {
            "n_words": F.col("_rule_w.n"),
            "n_symbols": (characters - _without(text, SYMBOLS)).cast("long"),
            "n_dup_lines": F.col("_rule_l.dup").cast("long"),
            "n_repeat_words": F.col("_rule_w.repeat"),
            "_rule_n": F.greatest(F.col("_rule_w.n"), F.lit(1)),
            "_rule_c": F.greatest(F.col("word_chars"), F.lit(1)),
            "_rule_exclamations": characters - _without(text, "!"),
            "_rule_capitals": characters - _without(text, CAPITALS),
        }
    )
    return out.withColumns(
        {
            "repeat_percent": 100 * F.col("n_repeat_words") / F.col("_rule_n"),
            "mean_word_chars": F.col("word_chars") / F.col("_rule_n"),
            "symbols_per_word": F.col("n_symbols") / F.col("_rule_n"),
            "exclamations_per_word": F.col("_rule_exclamations") / F.col("_rule_n"),
            "capital_ratio": F.col("_rule_capitals") / F.col("_rule_c"),
            "stop_word_ratio": F.col("_rule_w.stop") / F.col("_rule_n"),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_rule_l.n"), F.lit(1)),
        }
    ).drop("_rule_w", "_rule_l", "_rule_n", "_rule_c", "_rule_exclamations", "_rule_capitals")


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, failed_rules (names in table order, empty array if none), base_failed and kept.

    Null or empty text: no words, so it fails too_short. Repeated rows are judged each by itself; other columns
    pass through (a column with the name of an output is replaced; names
    that begin with _rule_ are used inside). An empty table gives an empty table."""
    measured = measure(docs, text_col)
    named = F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules])
    base = [r.failed() for r in rules if r.name in BASE_RULES]
    failed = base[0] if base else F.lit(False)
    for other in base[1:]:
        failed = failed | other
    judged = measured.withColumns({"failed_rules": F.array_compact(named), "base_failed": failed})
    return judged.withColumn("kept", (F.size("failed_rules") == 0) & (F.col("_rule_once") >= 0)).drop("_rule_once")
