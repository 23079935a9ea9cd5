"""The TF-IDF index.

Terms are counted and weighed where their page is, so text is never shuffled. What is: term counts, combined on the map side and without pairs of
rare words; when an index is stored, the postings, once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.counts import bit_filter, document_counts, scored_rows, term_arrays, term_rows, weighed_rows
from pagewright.functions.text import bigrams, computed, tokens, weighted_text, with_words
from pagewright.functions.urls import fill_domain
from pagewright.params import IndexParams
from pagewright.session import materialize, work_path
from pagewright.sources.buckets import BucketTable, create_buckets, open_buckets
from pagewright.sources.files import delete, finished, numbered

_FILTER_BITS = 1 << 23  # at most so many bits, a megabyte, travel with the tasks


def index_docs(pages: DataFrame) -> DataFrame:
    """The columns the index reads: page_id, url, title, content, domain."""
    return pages.select(
        "page_id", "url", "title", "content", fill_domain("domain", "url").alias("domain")
    )


def doc_words(docs: DataFrame, params: IndexParams, *keep: str) -> DataFrame:
    """page_id and the array of words without stop words."""
    text = weighted_text("title", "content")
    return with_words(docs, text, params.stop_list(), "page_id", *keep)


def word_positions(docs: DataFrame) -> DataFrame:
    """All words with their positions: page_id, pos, word."""
    words = tokens(weighted_text("title", "content"))
    return docs.select("page_id", F.posexplode(words).alias("pos", "word"))


def ngram_positions(docs: DataFrame, params: IndexParams) -> DataFrame:
    """Words and word pairs with the position of their first word."""
    words = doc_words(docs, params)
    single = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    double = F.transform(bigrams("words"), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    rows = words.select("page_id", F.explode(F.concat(single, double)).alias("_t"))
    return rows.select("page_id", "_t.pos", "_t.term")


def term_freq(docs: DataFrame, params: IndexParams, *keep: str) -> DataFrame:
    """page_id, term, tf of all words and word pairs."""
    return term_rows(doc_words(docs, params, *keep), "page_id", *keep)


def _within_bounds(counts: DataFrame, docs: DataFrame, params: IndexParams) -> DataFrame:
    n_docs = docs.agg(F.count("*").alias("n"))
    return counts.where(
        (F.col("df") >= params.min_df) & (F.col("df") <= params.max_df * n_docs.scalar())
    )


def doc_freq(docs: DataFrame, params: IndexParams) -> DataFrame:
    """term, df, cf of all terms within the document-frequency bounds."""
    return _within_bounds(document_counts(doc_words(docs, params)), docs, params)


def _word_filter(words: DataFrame) -> Callable[[str], bool]:
    """A test that holds for all of ``words(term)`` and for few others.

    Each word sets a bit by its hash; there are at least 64 bits for a word, up
    to the size that tasks may carry. The bits travel with the tasks.
    """
    n = words.count()
    bits = min(_FILTER_BITS, max(1 << 12, 1 << (64 * n).bit_length()))
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(bits))
    mask = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = words.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(mask).alias("mask")).collect()
    cells = [0] * (bits // 64)
    for row in rows:
        cells[row["cell"]] = row["mask"]
    return bit_filter(cells)


def frequent_terms(docs: DataFrame, params: IndexParams) -> DataFrame:
    """``doc_freq`` without word pairs that cannot enter the vocabulary."""
    return _frequent_terms(_stored_words(docs, params), docs, params)


def _stored_words(docs: DataFrame, params: IndexParams) -> DataFrame:
    """``doc_words`` with the domain, written: several passes read them, and text is cut into words once."""
    return materialize(doc_words(docs, params, "domain"), "words")


def _frequent_terms(words: DataFrame, docs: DataFrame, params: IndexParams) -> DataFrame:
    """A pair is no more frequent than either of its words. So once the
    ``max_features``-th most frequent word is known, only pairs of words at
    least as frequent can enter, and the long tail of pairs, most of all terms,
    is dropped inside the page's row. With fewer words than that, none is. The
    test may let a pair pass that cannot enter; it is counted like the others.
    """
    single = materialize(document_counts(words, pairs=False), "word-counts")
    allowed = _within_bounds(single, docs, params)
    weakest = vocabulary(allowed, params).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
    holds = _word_filter(single.where(F.col("cf") >= weakest.cf).select("term")) if weakest.n == params.max_features else None
    return allowed.unionByName(_within_bounds(document_counts(words, singles=False, holds=holds), docs, params))


def vocabulary(frequencies: DataFrame, params: IndexParams) -> DataFrame:
    """The ``max_features`` most frequent terms, ties by term.

    A plain top-k would send that many rows from every task to one. The counts
    of counts first give the corpus frequency at the cut, so that only terms at
    or above it take part.
    """
    k = params.max_features
    levels = frequencies.groupBy("cf").agg(F.count("*").alias("terms"))
    # Each level holds at least one term, so k levels are enough.
    top_levels = levels.orderBy(F.desc("cf")).limit(k)
    above = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1)
    reached = top_levels.withColumn("_above", F.coalesce(F.sum("terms").over(above), F.lit(0)))
    cut = reached.where(F.col("_above") < k).agg(F.min("cf").alias("cut"))
    candidates = frequencies.where(F.col("cf") >= cut.scalar())
    return candidates.orderBy(F.desc("cf"), "term").limit(k)


def with_idf(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the smoothed inverse document frequency."""
    n_docs = docs.agg(F.count("*").alias("n"))
    return vocab.withColumn("idf", F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1)


def _term_weights(vocab: DataFrame) -> Callable[[Column], Column]:
    """A look-up of a term's idf, null for terms outside the vocabulary.

    The vocabulary, which ``max_features`` bounds, becomes a hash table that is a
    constant of the plan: a page's terms are weighed where they are counted.
    """
    rows = vocab.select("term", "idf", F.xxhash64("term").alias("hash")).collect()
    slots = 1 << max(4, (2 * len(rows)).bit_length())
    cells: list[list[dict]] = [[] for _ in range(slots)]
    for row in rows:
        cells[row["hash"] % slots].append({"t": row["term"], "w": row["idf"]})
    table = F.from_json(F.lit(json.dumps(cells, ensure_ascii=False)), "array<array<struct<t:string,w:double>>>")

    def idf(term: Column) -> Column:
        cell = F.get(table, F.pmod(F.xxhash64(term), F.lit(slots)).cast("int"))
        return F.get(F.filter(cell, lambda entry: entry["t"] == term), F.lit(0))["w"]

    return idf


def weigh(words: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """``keep``, term, tf, weight: L2-normalised TF-IDF weights of each row's words.

    ``words`` has ``keep`` and the array ``words``. A row's terms are filtered,
    counted, weighed and normalised inside the row.
    """
    return weighed_rows(words, _idf(vocab), *keep)


def _idf(vocab: DataFrame) -> dict[str, float]:
    return {row["term"]: row["idf"] for row in vocab.select("term", "idf").collect()}


def score_words(words: DataFrame, vocab: DataFrame, vectors: DataFrame, least: float | None = None, best: int | None = None) -> DataFrame:
    """query_id, page_id, score of each row of ``words``, see ``scored_rows``; ``vectors`` must be few."""
    asked = vectors.select(F.col("query_id").cast("long").alias("query_id"), "key", "term", "weight").toArrow()
    return scored_rows(words, _idf(vocab), asked, least, best)


def _weigh_counts(counted: DataFrame, idf: Callable[[Column], Column], *keep: str) -> DataFrame:
    """``keep``, term, tf, weight from ``counts``; terms without an idf drop out."""
    weights = F.transform("counts", lambda c: F.struct(
        c["term"].alias("term"), c["tf"].alias("tf"), (c["tf"] * idf(c["term"])).alias("w")))
    raw = counted.select(*keep, F.filter(weights, lambda c: c["w"].isNotNull()).alias("_raw"))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, c: total + c["w"] * c["w"]))
    normed = raw.select(*keep, "_raw", norm.alias("_norm"))
    return normed.select(*keep, "_norm", F.explode(computed("_raw")).alias("_c")).select(
        *keep, "_c.term", "_c.tf", (F.col("_c.w") / F.col("_norm")).alias("weight"))


@dataclass(frozen=True)
class Index:
    """docs: page_id, url, title, content, domain. vocab: term, df, cf, idf.
    postings: page_id, domain, term, tf, weight.

    A stored index was read from ``path``. Its postings are in shards by page
    and, inside, in ``domain_parts`` folders by domain. One that was built from
    texts has their ``words`` (page_id, domain, words), from which postings are
    worked out.
    """

    docs: DataFrame
    vocab: DataFrame
    postings: DataFrame
    params: IndexParams
    path: str | None = None
    domain_parts: int = 0
    words: DataFrame | None = None


def build_index(pages: DataFrame, params: IndexParams = IndexParams()) -> Index:
    """Index over page records (page_id, url, title, content, domain).

    The vocabulary is written to the shared folder: it is small, used on both
    sides of a search, and cuts the passes over the text apart. An empty corpus
    gives an empty index, and so does a corpus of one document, where no term
    can satisfy both frequency bounds.
    """
    docs = index_docs(pages)
    words = _stored_words(docs, params)
    top = vocabulary(_frequent_terms(words, docs, params), params)
    vocab = materialize(with_idf(top, docs), "vocabulary")
    return Index(docs, vocab, weigh(words, vocab, "page_id", "domain"), params, words=words)


_POSTINGS = "page_id BIGINT, domain STRING, term STRING, tf BIGINT, weight DOUBLE, domain_part INT"


def domain_part(domain: Column, parts: int) -> Column:
    """The folder of a domain's postings."""
    return F.pmod(F.xxhash64(F.coalesce(domain, F.lit(""))), F.lit(parts)).cast("int")


def store_index(index: Index, path: str | None = None, shards: int | None = None, domain_parts: int = 8) -> Index:
    """Store an index under ``path``, from which ``open_index`` reads it, and open it.

    Postings are dealt into ``shards`` by page, so that a search adds up a
    page's score where its postings are, and in each shard into folders by
    domain, sorted by term. A store is a version of its own, read once it is
    complete; the version before it stays for searches that still read it, older
    ones go.
    """
    spark = index.vocab.sparkSession
    path = path or work_path(spark, "index")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = max(finished(spark, path, "version=*/meta"), default=0) + 1
    folder, table = f"{path}/version={number}", f"pagewright_{uuid.uuid4().hex}"
    index.docs.write.mode("overwrite").parquet(f"{folder}/docs")
    index.vocab.write.mode("overwrite").parquet(f"{folder}/vocab")
    dealt = index.postings.select(
        F.col("page_id").cast("long").alias("page_id"), "domain", "term", "tf", "weight",
        domain_part(F.col("domain"), domain_parts).alias("domain_part")).repartition(shards, "page_id")
    (dealt.write.mode("overwrite").partitionBy("domain_part").bucketBy(shards, "page_id").sortBy("term")
     .option("path", f"{folder}/postings").saveAsTable(table))
    spark.sql(f"DROP TABLE {table}")
    meta = {"shards": shards, "domain_parts": domain_parts, "params": asdict(index.params)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    for old in numbered(spark, path, "version=*"):
        if old < number - 1:
            delete(spark, f"{path}/version={old}")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The newest complete index under ``path``."""
    versions = finished(spark, path, "version=*/meta")
    if not versions:
        raise FileNotFoundError(f"no complete index under {path}")
    folder, table = f"{path}/version={versions[-1]}", f"pagewright_{uuid.uuid4().hex}"
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    stop = meta["params"]["stop_words"]
    params = IndexParams(**meta["params"] | {"stop_words": None if stop is None else tuple(stop)})
    place = f"{folder}/postings".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({_POSTINGS}) USING parquet PARTITIONED BY (domain_part) "
              f"CLUSTERED BY (page_id) SORTED BY (term) INTO {meta['shards']} BUCKETS LOCATION '{place}'")
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return Index(spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/vocab"), spark.table(table),
                 params, path, meta["domain_parts"])


_DOCS = "page_id long, url string, title string, content string, domain string"
_COUNTS = "page_id long, domain string, counts array<struct<term:string,tf:bigint>>"
_TERMS = "term string, df long, cf long"


@dataclass(frozen=True)
class CountStore:
    """What an index is made of, kept up to date: docs, term counts of each page, and df and cf of each term."""

    docs: BucketTable
    counts: BucketTable
    terms: BucketTable


def count_store(spark: SparkSession, path: str, buckets: int = 32) -> CountStore:
    """The store at ``path``, made where there is none yet."""
    def table(name: str, schema: str, key: str) -> BucketTable:
        try:
            return open_buckets(spark, f"{path}/{name}")
        except FileNotFoundError:
            return create_buckets(spark, f"{path}/{name}", schema, key, buckets)

    return CountStore(table("docs", _DOCS, "page_id"), table("counts", _COUNTS, "page_id"), table("terms", _TERMS, "term"))


def _replaced_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("page_id"), "page_id", "left_anti").select(*new.columns).unionByName(new)


def add_pages(store: CountStore, pages: DataFrame, params: IndexParams = IndexParams()) -> CountStore:
    """The store with ``pages`` (page_id, url, title, content, domain) new or in place of those with their ids.

    Only these pages are tokenised. A term's counts change by what the pages
    have now, less what their former versions had; counts add up, so no other
    page is read.
    """
    docs = materialize(index_docs(pages).withColumn("page_id", F.col("page_id").cast("long")), "new-docs")
    words = doc_words(docs, params, "domain")
    new = materialize(term_arrays(words, "page_id", "domain"), "new-counts")
    old = store.counts.read(store.counts.touched(new)).join(new.select("page_id"), "page_id", "left_semi")

    def change(rows: DataFrame, sign: int) -> DataFrame:
        flat = rows.select(F.explode(computed("counts")).alias("c"))
        return flat.select("c.term", F.lit(sign).cast("long").alias("df"), (sign * F.col("c.tf")).alias("cf"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    changes = summed(change(new, 1).unionByName(change(old, -1))).where("df <> 0 or cf <> 0")
    terms = store.terms.update(changes, lambda stored, delta: summed(stored.unionByName(delta.select(*stored.columns))).where("df > 0"))
    return CountStore(store.docs.update(docs, _replaced_pages), store.counts.update(new, _replaced_pages), terms)


def index_of_counts(store: CountStore, params: IndexParams = IndexParams()) -> Index:
    """The index of the stored pages, equal to one built from their texts, from counts alone."""
    docs = store.docs.read()
    allowed = _within_bounds(store.terms.read(), docs, params)
    vocab = materialize(with_idf(vocabulary(allowed, params), docs), "vocabulary")
    postings = _weigh_counts(store.counts.read(), _term_weights(vocab), "page_id", "domain")
    return Index(docs, vocab, postings, params)


def index_summary(index: Index) -> DataFrame:
    """Documents, terms and postings of an index, as metric rows."""
    def metric(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))

    return (
        metric("documents", index.docs)
        .unionByName(metric("terms", index.vocab))
        .unionByName(metric("postings", index.postings))
    )
