"""The registered queries of this package: thin wrappers that give each operator its contract's columns."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.llm import decontaminate, html_extract, kneser_ney, langid, licenses, ngram_join, packing, periodic_runs, quality, repeats, secrets, spelling, tokens
from rolespark.llm.common import table, words_of

TOKENIZER = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    return kneser_ney.score(docs, kneser_ney.train(docs.filter("not held_out")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.apply_rules(table(spark, sf_dir, "documents"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.learn(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out("doc_id", 4, 2)
    model = langid.learn(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _typing_errors(doc_id: str):
    """One word in 199 (by a hash of document and word) loses a code point."""
    start = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        at = h % len(word)
        return word if h % 199 else word[:at] + word[at + 1 :]

    return change


def op11_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), "[A-Za-z\u00C0-\u00FF]", change=_typing_errors)
    return spelling.group_variants(words)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select(
        "_row.doc_id",
        F.coalesce(F.octet_length("_row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one text in ten (by the id's hash) the words from a place on repeat a stretch of itself, so that there are runs of
    every period."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    g, words, n = F.floor(hashed / 10), F.col("words"), F.size("words")
    chosen = table(spark, sf_dir, "documents").select("doc_id", "text", g.alias("g"), F.when(hashed % 10 == 0, words_of(F.col("text"))).alias("words"))
    placed = chosen.select("doc_id", "text", "words", F.when(n > 0, F.pmod("g", n)).alias("a"), "g").withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= F.col("a"), F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).otherwise(i).cast("int")))
    planted = placed.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
    found = planted.select("doc_id", periodic_runs.detect(F.col("text")).alias("found"))
    runs, best = F.col("found.runs"), F.array_max(F.transform("found.runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.array_join(F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("found.collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_best_fit_packing, op3_ngram_jaccard_join, op4_quality_rules, op5_html_extraction, op6_secret_scans, op7_license_scans, op8_language_id, op9_token_output, op10_decontamination, op11_spelling_variant_grouping, op12_suffix_array_dedup, op13_periodic_run_detection)}

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(characters: str) -> str:
    return f"(length(t) - length(translate(t, {_quote(characters)}, '')))"


_LISTED = "[" + ", ".join(map(_quote, quality.STOP_WORDS)) + "]"
_RULED = {r.name: " OR ".join(x for x in ("" if r.low is None else f"{r.measure} < {r.low}", "" if r.high is None else f"{r.measure} > {r.high}") if x) for r in quality.RULES}
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _RULED.items()) + "], lambda x: x IS NOT NULL)"

_QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, {_count(quality.SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(len(words), 1) AS n, len(lines) AS n_lines, {_count("!")} AS marks, {_count(quality.CAPITALS)} AS capitals,
  len(list_filter(words, lambda x: list_contains({_LISTED}, x))) AS stops FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, 100.0 * n_repeat_words / n AS repeat_percent, word_chars / n AS mean_word_chars, n_symbols / n AS symbols_per_word, marks / n AS exclamations_per_word, capitals / greatest(word_chars, 1) AS capital_ratio,
  stops / n AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio FROM m),
v AS (SELECT *, {_FAILED} AS failed_rules FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(failed_rules) = 0 AS kept, failed_rules FROM v"""


def _places(pattern: str, kind: str, keep: str = "true") -> str:
    """The spans of one kind: places are sums of the lengths of matches and of the parts between them."""
    p = _quote(pattern)
    start = "list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {start} AS s, {secrets.KINDS.index(kind)} AS kind, {start} + length(hits[k]) AS e, hits[k] AS v FROM (SELECT doc_id, hits, string_split_regex(t, {p}) AS parts, unnest(range(1, len(hits) + 1)) AS k
 FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS hits FROM t) WHERE len(hits) > 0) WHERE {keep}"""


_ALLOWED = " OR ".join(f"regexp_matches(v, {_quote(p)})" for p in secrets.ALLOW)
_PEAK = f"list_max(list_transform(range(1, length(v) - {secrets.WINDOW - 2}), lambda i: list_entropy(string_split(substr(v, i, {secrets.WINDOW}), ''))))"
_LEAST = f"CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN {secrets.THRESHOLDS['hex']} WHEN regexp_matches(v, '^[0-9A-Za-z]+$') THEN {secrets.THRESHOLDS['alphanumeric']} ELSE {secrets.THRESHOLDS['base64']} END"
_NAMED = "['" + "', '".join(secrets.KINDS) + "'][kind + 1] || ':' || s || ':' || e"
_SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_places(secrets.ASSIGN, "assign", f"length(regexp_extract(hits[k], {_quote(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}")} UNION ALL {_places(secrets.ACCESS, "access")} UNION ALL {_places(secrets.HEX, "hex")}),
c AS ({_places("[A-Za-z0-9+/_=-]{20,}", "entropy")}),
n AS (SELECT * FROM c WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({_ALLOWED}) AND {_PEAK} >= {_LEAST} AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM n)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg({_NAMED}, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
 coalesce(string_agg({_NAMED}, ',' ORDER BY s, kind), '') AS spans FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d WHERE len(w) > 0),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, k = nx AND k = ny AS same FROM p WHERE 9 * k >= 4 * (nx + ny)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n, count(*) FILTER (same) AS same, min(y) FILTER (same) AS copy FROM l GROUP BY x)
SELECT doc_id, least(doc_id, c.y) AS class_id, least(doc_id, n.copy) AS copy_id, 1 + coalesce(n.same, 0) AS n_copies, coalesce(n.n, 0) AS n_links FROM documents LEFT JOIN c ON doc_id = c.x LEFT JOIN n ON doc_id = n.x"""

#: SQL for the queries that it can express.
ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": _JACCARD, "op4_quality_rules": _QUALITY, "op6_secret_scans": _SECRETS}
