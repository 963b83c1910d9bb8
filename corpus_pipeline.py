"""The corpus pipeline: quality rules, near-dedup, substring dedup and packing, each over what came before."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import minhash, packing, quality, substrings
from kinfold.llm.common import stored, table
from kinfold.llm.queries import PACK_RANKS, PACK_SPECIAL, SEED

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are near-duplicates from this similarity of their shingles on; op4's contract has its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, unchanged.

    A null text counts as empty, and fails as any text of fewer than 50 words does. Null languages and sources are
    groups of their own; repeated rows are judged each for itself; an empty table gives an empty result; other columns
    than those of documents are dropped.
    """
    return quality.filter_quality(docs.select(*COLUMNS), ["lang", "source"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Rows are judged each for itself, so of rows that share a doc_id those with another text stay; rows of one
    doc_id and text are one document, of which one row (the least by its other columns) stays. A row without a
    doc_id stays unless its group has a document with one. Null and blank texts are near to nothing; an empty
    table gives an empty result; other columns than those of documents are dropped.
    """
    keyed = docs.select(*COLUMNS).withColumn("_text", F.md5("text"))
    judged = minhash.near_duplicates(keyed, percent=NEAR_PERCENT, carry=("_text",))
    dropped = judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key")).distinct()
    left = keyed.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_key")), "left_anti")
    rest = [c for c in COLUMNS if c != "doc_id"]
    return left.groupBy("doc_id", "_text").agg(F.min(F.struct(*rest)).alias("_row")).select("doc_id", "_row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; those of which nothing is left go.

    A text of which nothing was removed stays as it is, also in its white space, null and blank texts included. Rows
    without a doc_id stay as they are; rows that share one share its places (see ``remove_repeats``). An empty table
    gives an empty result; other columns than those of documents are dropped.
    """
    cleaned = substrings.remove_repeats(docs.select(*COLUMNS), leave_whole=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where("n_removed = 0 or n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents.

    A null text counts as empty: its one piece is the end id alone. Rows without a doc_id are packed too; repeated rows
    are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    pieces = packing.cut_pieces(docs.select("doc_id", "text"), public_tokenizers.path(PACK_RANKS), public_tokenizers.PATTERN, PACK_SPECIAL)
    slim = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign_sequences(slim, packing.groups_for(docs.count()), SEED)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]
#: Robust estimates and packing by tokens can't be written as SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
