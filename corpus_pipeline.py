"""From raw documents to packed training sequences, in five stages over the operators of rolespark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of documents. A stage's result is written as Parquet to the shared folder and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolespark.llm import decontaminate, ngram_join, packing, quality, secrets
from rolespark.llm.common import materialize, table

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go (null and empty texts among them)."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return quality.apply_rules(rows).filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id; a row goes by its id and its text. Rows
    without an id or without words stay; of a row repeated in full one stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go. Rows without a text and, where there are no items, all rows stay; each
    row has its own verdict, whatever its id."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become <kind>, and n_chars follows the text (null for a null text). Repeated
    rows are scanned each by itself."""
    scanned = secrets.scan(docs.select(F.struct(*docs.columns).alias("_row"), "text"), out="_spans")
    text = secrets.redact(F.col("text"), F.col("_spans"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return scanned.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens. A null or empty text is one piece,
    of the end id; rows of one id are documents of their own; no documents give no pieces."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the join, the edit matching or the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again. Null ids, ids that are used twice,
    empty tables and further columns are what the stages say; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
