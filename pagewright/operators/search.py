"""Batch search: a table of queries against an index.

``queries`` has query_id, query and domain_filter. Domain filters ``None``,
``''`` and ``'all'`` mean no filter. Blank queries match every page of their
domain with score 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import snippet, strip, with_words
from pagewright.operators.index import Index, domain_part, score_words, weigh
from pagewright.params import SearchParams
from pagewright.session import materialize

_SALTS = 64
_SLICE_ROWS = 100_000  # terms of queries, some megabytes, that are sent to all tasks at once


def with_filter_key(queries: DataFrame) -> DataFrame:
    """Adds ``blank`` and ``key``, the domain to match or ``all``."""
    key = F.coalesce(F.nullif("domain_filter", F.lit("")), F.lit("all"))
    return queries.withColumn("blank", strip("query") == "").withColumn("key", key)


def query_vectors(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, key, term, tf, weight; unknown terms and stop words drop out."""
    asked = with_filter_key(queries).where(~F.col("blank"))
    words = with_words(asked, F.col("query"), index.params.stop_list(), "query_id", "key")
    return weigh(words, index.vocab, "query_id", "key")


def _scores(postings: DataFrame, vectors: DataFrame) -> DataFrame:
    d, q = postings.alias("d"), vectors.alias("q")
    within = (F.col("q.key") == "all") | (F.col("d.domain") == F.col("q.key"))
    return d.join(q, (F.col("d.term") == F.col("q.term")) & within).groupBy("q.query_id", "d.page_id").agg(
        F.sum(F.col("d.weight") * F.col("q.weight")).alias("score")
    )


def cosine_scores(
    postings: DataFrame, vectors: DataFrame, index: Index | None = None, least: float | None = None, best: int | None = None
) -> DataFrame:
    """query_id, page_id, score of every pair that shares a term, or of those above ``least``.

    Both sides are unit vectors, so the sum of products is the cosine. Queries
    within a domain meet its postings only. Of a stored ``index`` they read only
    the folders that hold their domains.

    The query vectors are written first and go to the postings in slices of
    bounded size: so postings stay where they are, and in a stored index, whose
    shards hold whole pages, scores are complete before anything moves.

    An ``index`` that has its pages' words is scored from them, each page in its
    row; with ``best``, rows that are not among so many best ones of their query
    may be left out there. Only rows of pages whose id repeats are added up.
    """
    vectors = materialize(vectors, "query-vectors")
    slices = -(-vectors.count() // _SLICE_ROWS)
    scores = again = None
    for k in range(max(slices, 1)):
        mine = vectors if slices <= 1 else vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k)
        if index is not None and index.words is not None:
            again = _repeated_pages(index) if again is None else again
            some = _word_scores(index, again, mine, least, best)
        else:
            some = _slice_scores(postings, F.broadcast(mine), index)
            some = some if least is None else some.where(F.col("score") > least)
        scores = some if scores is None else scores.unionByName(some)
    return scores


def _repeated_pages(index: Index) -> DataFrame:
    """``_id``: page ids of more than one row."""
    rows = index.words.groupBy(F.col("page_id").alias("_id")).agg(F.count("*").alias("n"))
    return materialize(rows.where("n > 1").select("_id"), "repeated-pages")


def _word_scores(index: Index, again: DataFrame, vectors: DataFrame, least: float | None, best: int | None) -> DataFrame:
    """Scores from the words of pages; a page that is one row is scored, and left out, where it is."""
    if again.isEmpty():
        return score_words(index.words, index.vocab, vectors, least, best)
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    once = score_words(index.words.join(again, same, "left_anti"), index.vocab, vectors, least, best)
    often = score_words(index.words.join(again, same, "left_semi"), index.vocab, vectors)
    often = often.groupBy("query_id", "page_id").agg(F.sum("score").alias("score"))
    return once.unionByName(often if least is None else often.where(F.col("score") > least))


def _slice_scores(postings: DataFrame, vectors: DataFrame, index: Index | None) -> DataFrame:
    """Postings that are worked out are read once; a stored index once for all domains, and some folders again."""
    if index is None or not index.domain_parts:
        return _scores(postings, vectors)
    inside = vectors.where(F.col("key") != "all")
    part = domain_part(F.col("key"), index.domain_parts)
    # At most as many rows as an index has folders.
    parts = [r[0] for r in inside.select(part).distinct().collect()]
    found = postings.where(F.col("domain_part").isin(parts))
    everywhere = _scores(postings, vectors.where(F.col("key") == "all"))
    return everywhere.unionByName(_scores(found, inside))


def keyword_hits(queries: DataFrame, index: Index, params: SearchParams, best: int | None = None) -> DataFrame:
    """All hits of the non-blank queries above the threshold, or at least the ``best`` of each query."""
    return cosine_scores(index.postings, query_vectors(queries, index), index, params.threshold, best)


def _docs_by_key(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id and key for each filter key that some blank query uses."""
    keys = with_filter_key(queries).where("blank").select("key").distinct()
    keyed = docs.select(
        "page_id", F.explode(F.array_distinct(F.array("domain", F.lit("all")))).alias("key")
    )
    return keyed.join(keys, "key", "left_semi")


def blank_hits(queries: DataFrame, docs: DataFrame, limit: int | None) -> DataFrame:
    """Hits of the blank queries: the first pages by id, or all of them.

    The first pages are found once per distinct filter, not once per query.
    """
    asked = with_filter_key(queries).where("blank").select("query_id", "key")
    matches = _docs_by_key(queries, docs)
    if limit is not None:
        matches = top_rows(matches, "key", [F.col("page_id")], limit, "_r").drop("_r")
    return asked.join(matches, "key").select("query_id", "page_id", F.lit(1.0).alias("score"))


def top_rows(df: DataFrame, group: str, order: list[Column], limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows of each group, numbered from one.

    The group is cut in parts by task first, so no later task holds a whole
    group; of each only its first rows leave the task.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    salted = salted.withColumn("_part", F.row_number().over(part))
    df = salted.where(F.col("_part") <= limit).drop("_salt", "_part")
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.where(F.col(name) <= limit)


def rank_order() -> list[Column]:
    """Best score first, ties by newest page id.

    Scores are compared to nine digits so that sums taken in another order do
    not change the ranking.
    """
    return [F.desc(F.round("score", 9)), F.desc("page_id")]


def ranked_hits(queries: DataFrame, index: Index, params: SearchParams) -> DataFrame:
    """query_id, rank, page_id, score: the best hits of each query."""
    hits = keyword_hits(queries, index, params, params.limit)
    scored = top_rows(hits, "query_id", rank_order(), params.limit, "rank")
    blank = blank_hits(queries, index.docs, params.limit)
    listed = top_rows(blank, "query_id", [F.col("page_id")], params.limit, "rank")
    columns = ["query_id", "rank", "page_id", "score"]
    return scored.select(*columns).unionByName(listed.select(*columns))


def total_found(queries: DataFrame, index: Index, params: SearchParams) -> DataFrame:
    """query_id, total_found: matches before the limit, 0 where none."""
    scored = keyword_hits(queries, index, params).groupBy("query_id").agg(
        F.count("*").alias("n")
    )
    keys = _docs_by_key(queries, index.docs).groupBy("key").agg(F.count("*").alias("n"))
    asked = with_filter_key(queries)
    blank = asked.where("blank").join(keys, "key").select("query_id", "n")
    found = scored.unionByName(blank)
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("total_found")
    )


def search(queries: DataFrame, index: Index, params: SearchParams = SearchParams()) -> DataFrame:
    """Ranked hits with url, title, domain and snippet.

    The kept hits are written first: they are few, and with their size known
    the join with the pages need not shuffle the pages.
    """
    return describe_hits(materialize(ranked_hits(queries, index, params), "hits"), index.docs, params)


def describe_hits(ranked: DataFrame, docs: DataFrame, params: SearchParams) -> DataFrame:
    details = docs.select(
        "page_id", "url", "title", "domain",
        snippet("content", params.snippet_chars).alias("content_snippet"),
    )
    return ranked.join(details, "page_id").select(
        "query_id", "rank", "page_id", "score", "url", "title", "domain", "content_snippet"
    )


def search_results(
    queries: DataFrame,
    index: Index,
    pages: DataFrame,
    routes,
    params: SearchParams = SearchParams(),
) -> DataFrame:
    """The full result record: hits with details, route and crawl time.

    ``pages`` has page_id and crawl_time; ``routes`` maps a table of wanted
    page ids to their routes, so only the pages shown are walked.
    """
    ranked = materialize(ranked_hits(queries, index, params), "hits")
    return with_route_and_time(describe_hits(ranked, index.docs, params), ranked, pages, routes)


def with_route_and_time(shown: DataFrame, ranked: DataFrame, pages: DataFrame, routes) -> DataFrame:
    """Adds ``route`` and ``last_crawled`` to described hits."""
    ways = routes(ranked.select("page_id").distinct())
    times = pages.select("page_id", F.col("crawl_time").alias("last_crawled"))
    return shown.join(ways, "page_id", "left").join(times, "page_id", "left")


def result_page(
    results: DataFrame, size: int, page: int, domain: str = "all"
) -> DataFrame:
    """One display page of each query's ranked results.

    Filters by domain, renumbers what is left, clamps ``page`` to the pages
    there are, and adds ``pages``, their number.
    """
    kept = results if domain == "all" else results.where(F.col("domain") == domain)
    pages = kept.groupBy("query_id").agg(F.ceil(F.count("*") / size).alias("pages"))
    order = Window.partitionBy("query_id").orderBy("rank")
    numbered = kept.withColumn("position", F.row_number().over(order)).join(pages, "query_id")
    current = F.greatest(F.least(F.lit(page), F.col("pages")), F.lit(1))
    last = current * size
    return numbered.where(F.col("position").between(last - size + 1, last))
