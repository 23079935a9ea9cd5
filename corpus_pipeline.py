"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import toxicity
from pagewright.llm.common import fold, read
from pagewright.llm.minhash import MinHashParams, near_duplicates
from pagewright.llm.mixing import mixed_documents
from pagewright.llm.packing import pack
from pagewright.llm.spans import remove_repeats
from pagewright.session import materialize


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` renewed, in the order of ``columns``."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go; all others stay as they are.

    The score learns from labelled rows of three in four ids. Null and empty
    texts, and rows without an id, are judged like others; repeated rows alike.
    Very long texts are judged whole. No rows give none.
    """
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    return toxicity.clean_documents(docs, toxicity.fit(toxicity.labelled_documents(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 80 % of their word shingles the rows with the smallest id stay.

    Rows that repeat an id are one document and stay or go together. Rows
    without an id, and texts without words, have no duplicates and stay.
    """
    copies = near_duplicates(docs, MinHashParams(percent=80)).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier text has leave the text; every row stays, maybe with an empty text.

    ``n_chars`` is counted anew. A null text stays null; rows without an id stay
    as they are; rows that repeat an id lose the same passages.
    """
    return _recounted(remove_repeats(docs), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: rows are kept, cut to words, repeated or left out by their source's quota.

    Rows without a source are a source. Null and empty texts have no words and
    take no part in a quota. ``n_chars`` is counted anew.
    """
    return _recounted(mixed_documents(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows packed into sequences, one row per piece, see ``pack``.

    Null and empty texts are pieces of the end mark alone. Rows that repeat an
    id are packed each; very long texts are cut into pieces.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_spans),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
