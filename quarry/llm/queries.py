"""The queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, boilerplate, crf, fixity, iblt, line_dedup, neural_index, packing, pfair, set_join, treap, vector_codes, word_table
from .common import table


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neural_index.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(spark, table(spark, sf_dir, "pages")).select("file_no", "record_no", "page_id", "url", "kind")


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = crf.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return crf.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "words", "switches")


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.schedule(table(spark, sf_dir, "documents"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, per_cent=85)


def op8_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    codes = vector_codes.learn(vectors)
    if codes is None:
        none = vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = vector_codes.with_group_error(vector_codes.encode(codes, vectors), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_table.decode(word_table.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = treap.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return treap.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_iblt": op2_iblt,
    "op3_bitplanes": op3_bitplanes,
    "op4_fixity": op4_fixity,
    "op5_crf_language": op5_crf_language,
    "op6_pfair": op6_pfair,
    "op7_shingle_join": op7_shingle_join,
    "op8_boilerplate": op8_boilerplate,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_word_table": op12_word_table,
    "op13_treap": op13_treap,
}

ORACLES: dict[str, str] = {
    "op4_fixity": fixity.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op13_treap": treap.ORACLE,
}
