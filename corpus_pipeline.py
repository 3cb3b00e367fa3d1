"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage works on what its predecessor kept. The first four return the columns of
`documents`, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonolith.llm import decontaminate, gam, linededup, simhash, tokenpack
from sonolith.llm.common import materialise
from sonolith.llm.queries import TOKENIZER, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labels outside its held-out fold, accepts."""
    return gam.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document, or an earlier line, has or nearly has."""
    return linededup.dedup_lines(docs, width=5, short=True).selectExpr(*(f"cast(length(text) as {kind}) n_chars" if c == "n_chars" else f"`{c}`" for c, kind in docs.dtypes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages cover less than a twentieth of the words."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=13, coverage=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences and offsets."""
    return tokenpack.pack_documents(docs, TOKENIZER, capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL expresses none of these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
