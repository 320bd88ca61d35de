"""A corpus pipeline of five operators: quality rules, language, near duplicates, benchmark leaks, token ids.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the stage before it kept, and is written as
Parquet and read again for the next one. All but the last return the columns of ``documents``.

Rows are decided on one by one: rows without a doc_id and rows that share one go or stay for their own text, and rows that
are alike in every column share a verdict, but for near duplicates, of which one stays. A null or empty text, and one
without letters, fails the quality rules or has no language. Ties between near duplicates go to the smallest doc_id, rows
without one come last. Very long texts are worked on whole. Extra columns pass through unread, whatever their names. An
empty table gives an empty table in every stage.

The first two stages carry the row along, so no text is shuffled. The next two find what goes by id and take it out: with the
rows' own ids where every row has one of its own, else with numbers that are given out first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright.llm import bpe, decontamination, language_id, near_duplicates, quality_rules
from routewright.llm.queries import PIECES, WORD_BPE, table
from routewright.session import cut_lineage

#: Texts whose language is less sure than this go.
LEAST_LANGUAGE_SCORE = 0.5
#: Up to so many ids are sent to the texts where they lie; more of them are joined by shuffling both.
SENT_IDS = 500_000


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row in ``_row``."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows, each with a number of its own for a doc_id, in the order of the doc_ids; the row as it was in ``_row``."""
    rows = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64(F.col("text")))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.struct("*").alias("_row")))


def _without(docs: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows but those whose doc_id is in what ``gone`` finds among them."""
    counts = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct(F.col("doc_id").cast("long"))).first()
    own_ids = counts[0] == counts[1] == counts[2]
    rows = docs if own_ids else _numbered(docs)
    ids = cut_lineage(gone(rows).select(F.col("doc_id").alias("_gone")).distinct())
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    left = rows.join(ids, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    return left if own_ids else left.select("_row.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and come from hosts that are not rejected."""
    return quality_rules.judge_documents(_carried(docs), carry=["_row"]).where("kept").select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    found = language_id.predict(_carried(docs), language_id.fit_languages(docs, PIECES), carry=["_row"])
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; rows without an id come last."""
    return _without(docs, lambda rows: near_duplicates.near_duplicates(rows).where("NOT kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, lambda rows: decontamination.find_leaks(rows, table(spark, sf_dir, "benchmark")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them."""
    return bpe.digests(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("bpe", token_stage),
]

#: The language model and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
