"""One query per operator over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import brown, chat, language, merkle, toxicity
from pagewright.llm.common import fold, read
from pagewright.llm.licenses import scan_licenses
from pagewright.llm.minhash import MinHashParams, near_duplicates
from pagewright.llm.mixing import mix
from pagewright.llm.packing import pack
from pagewright.llm.quality import judge
from pagewright.llm.spans import remove_repeats
from pagewright.llm.spelling import SpellingParams, spelling_forms
from pagewright.llm.sql import ORACLE_SQL
from pagewright.llm.vectors import similar_vectors


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("notices")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language.identify(docs, language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    model, rest = brown.fit(docs.where("not held_out"))
    return brown.score(docs, model, rest)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc.doc_id", "size", "source_size", "target", "taken")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed", "words_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(toxicity.labelled_documents(docs, read(spark, sf_dir, "labels").where(~held_out)))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(read(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), MinHashParams(percent=85))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_log(chat.events_of_turns(turns)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = merkle.leaves(docs, fold(F.col("doc_id"), 5) == 0, merkle.lower_cased(F.col("text")))
    return merkle.audit(merkle.build_manifest(rows))


def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(read(spark, sf_dir, "documents"), SpellingParams(slips=199))


__all__ = ["ORACLE_SQL", "REGISTRY"]

REGISTRY = {f.__name__: f for f in (
    op1_license_scan, op2_quality_divergence, op3_language_ppm, op4_brown_lm, op5_mix_sources,
    op6_pack_sequences, op7_span_dedup, op8_toxicity, op9_vector_dedup, op10_minhash_dedup,
    op11_chat_format, op12_merkle_manifest, op13_spelling_forms)}

