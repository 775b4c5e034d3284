"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents.

1. language_id: a conditional random field tells each document's language; texts
   without letters, and those that no language covers by half, go.
2. line_dedup: lines that repeat an earlier line (within one word) go; documents
   that have nothing left go with them.
3. near_duplicates: documents are joined on five-word shingles at a similarity of
   0.8; of each group of linked documents the one with the smallest doc_id stays.
4. mixture: sources are interleaved to target weights (the square roots of their
   sizes); what is left over of over-full sources when the mixture ends goes.
5. packing: token ids are packed into sequences of at most 4096.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import crf, line_dedup, packing, pfair, set_join
from quarry.llm.common import scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, a null lang filled in.

    Null and empty texts and texts without letters go; very long texts are labelled whole; repeated rows are judged
    alike; a null doc_id is kept; an empty table stays empty; columns of any name are carried through.
    """
    return crf.accept(docs, crf.fit(docs.select("doc_id", "text", "lang")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; n_chars is counted again.

    Documents that lose all their text go, those that had none stay; rows of one doc_id don't take each other's lines;
    a null doc_id comes first; columns of any name are carried through.
    """
    dropped = "n_dropped" + "_" * sum(map(len, docs.columns))  # no column has this name
    out = line_dedup.dedup(docs, n_lines=dropped + "_", n_dropped=dropped)
    kept = out.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\s]"))
    return kept.select(*[F.length("text").cast("long").alias(c) if c.lower() == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: all rows of the smallest doc_id.

    Null and empty texts and null doc_ids are linked with nothing and stay; rows that repeat a doc_id stay or go
    together; an empty table stays empty; columns of any name are carried through.
    """
    groups = set_join.near_components(docs.select("doc_id", "text"), width=5, per_cent=80)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row).join(gone, "doc_id", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture; a null source counts as one named by the empty string, a null doc_id comes first,
    rows of one doc_id and source stay or go together; an empty table stays empty; columns of any name are carried through."""
    return pfair.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; null and empty texts are the end id alone, long ones several pieces."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", pack),
]

#: SQL can't express the random field, the schedule, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
