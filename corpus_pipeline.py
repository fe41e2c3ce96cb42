"""A corpus from raw documents to packed sequences: language, exact copies, near copies, benchmark passages, packing.

Each stage reads what the stage before kept, and its decision takes effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.llm import language_id, ngram_join
from paysieve.llm.common import table, workspace
from paysieve.llm.decontaminate import decontaminate
from paysieve.llm.exact_dedup import keep_documents
from paysieve.llm.packing import pack

#: Least share of a text's trigrams that its language must hold, of the share that it holds of its own texts; below it the text is in
#: none of the languages learned.
LEAST_SCORE = 0.2
#: Near copies: words of a shingle and similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: A document of which this share of words lies in benchmark passages goes altogether; of others the passages go.
MOST_COVERED = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; null texts, texts without letters and texts like no language go."""
    model = language_id.learn(docs.filter(~language_id.is_held_out(F.col("doc_id"))).select("text", "lang"))
    told = language_id.identify(docs, model, carry=True)
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE * F.col("usual"))).select("given.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return keep_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, that with the smallest doc_id; null ids stand last."""
    return ngram_join.keep_documents(docs, SHINGLE, PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; documents that are mostly such passages go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), texts=True, carry=True)
    kept = found.filter(F.col("n_hit") <= MOST_COVERED * F.col("n_words"))
    cut = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    old = lambda c: F.col("given")[c]
    return kept.select(*((F.when(F.col("n_hit") > 0, cut[c]).otherwise(old(c)) if c in cut else old(c)).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("decontaminate", benchmark_passages), ("best_fit_packing", packing)]

#: Language identification and packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's documents."""
    ws = workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
