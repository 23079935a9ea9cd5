"""One query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as V
from pagewright.functions import formats, html, text, urls
from pagewright.operators import cache as C
from pagewright.operators import extract, history, links, search, stats, traverse
from pagewright.operators import index as ix
from pagewright.operators.dfs import crawl_dfs
from pagewright.operators.ordinals import global_ordinal
from pagewright.operators.routes import page_routes
from pagewright.params import IndexParams, SearchParams
from pagewright.plans.crawl import PAGE_COLUMNS, crawl, link_table, page_table, store_crawl
from pagewright.session import materialize, work_path
from pagewright.sources import tables
from pagewright.sources.buckets import create_buckets

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

NOW = "2024-06-01 00:00:00"
INDEX = IndexParams()
SEARCH = SearchParams()


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


# Sources, sinks, table maintenance


@query
def scan_pages(spark, sf):
    pages = tables.scan_pages(V.table(spark, sf, "pages"))
    return pages.select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


@query
def scan_index_docs(spark, sf):
    return ix.index_docs(V.docs(spark, sf))


@query
def extract_pages(spark, sf):
    records = extract.page_records(V.table(spark, sf, "pages"))
    return records.select(
        "page_id", "url", "title", "content", "domain", "status_code",
        F.size("hrefs").cast("long").alias("anchors"), F.array_join("links", " ").alias("links"),
    )


@query
def page_defaults(spark, sf):
    """Pages without markup, without a title, and with nothing but a title."""
    third = F.col("page_id") % 3
    html = F.when(third == 2, F.regexp_extract("html", "(?is)<title.*?</title>", 0)).when(
        third == 1, F.concat(F.lit("<p>"), F.col("page_id"), F.lit("</p>")))
    pages = V.table(spark, sf, "pages").select("page_id", "url", html.alias("html"))
    return extract.extract_text(pages, links=False).select("page_id", "title", F.length("content").cast("long").alias("content_chars"))


def _stored_pages(spark, sf):
    """All but the last page of each larger domain, as an older crawl left them."""
    old = V.crawl_pages(spark, sf).where("k < n - 1 OR n = 1")
    return old.select(
        "page_id", "url", F.lit("stored").alias("title"), F.lit("").alias("content"), "domain",
        "crawl_time", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"),
        F.lit(200).alias("status_code"), F.col("crawl_time").alias("created_at"),
        F.col("crawl_time").alias("updated_at"),
    )


def _visits(spark, sf):
    """Every edge as a visit of its target, in edge order."""
    seq = F.col("f") * 10 + F.col("pos")
    return V.edges(spark, sf).select(
        F.col("t").alias("page_id"), F.col("t_url").alias("url"),
        F.concat(F.lit("visit "), seq).alias("title"), F.lit("seen").alias("content"),
        (V.ntz(NOW) + F.make_dt_interval(secs=seq.cast("decimal(18,6)"))).alias("crawl_time"),
        F.lit(1).alias("depth"), F.col("f_url").alias("parent_url"),
        F.lit(200).alias("status_code"), seq.alias("seq"),
    )


@query
def upsert_pages(spark, sf):
    """An older crawl stored in the page table, then the visits over it."""
    table = page_table(spark, work_path(spark, "page-table"))
    table = table.update(_stored_pages(spark, sf), lambda old, new: new)
    visits = _visits(spark, sf).withColumn("domain", urls.extract_domain("url"))
    return table.update(visits, lambda old, new: tables.upsert_pages(old, new, "seq", V.ntz(NOW))).read()


@query
def page_links(spark, sf):
    """The link table that storing the visits leaves, over pages an older crawl stored."""
    path = work_path(spark, "page-table")
    pages = V.crawl_pages(spark, sf).select(
        "page_id", "url", F.lit("").alias("title"), F.lit("").alias("content"), "crawl_time", F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_url"), F.lit(200).alias("status_code"), F.lit(0).alias("crawl_order"))
    store_crawl(pages, path, V.ntz(NOW))
    store_crawl(_visits(spark, sf).withColumn("crawl_order", F.col("seq")), path, V.ntz(NOW))
    return link_table(spark, path).read()


@query
def export_pages(spark, sf):
    path = work_path(spark, "export")
    tables.export_pages(_crawled_records(spark, sf), path)
    schema = "url string, title string, content string, domain string, crawl_time timestamp_ntz, depth int, parent_url string"
    return spark.read.schema(schema).json(path)


@query
def history_append(spark, sf):
    path = work_path(spark, "history")
    history.append_history(V.search_history(spark, sf), path)
    searches = V.queries(spark, sf).select(
        (F.col("query_id") + 1_000_000_000).alias("id"), "query", "domain_filter",
        F.lit(0).alias("results_count"), F.lit(1.5).alias("execution_time"),
        F.lit(False).alias("cached"),
    )
    history.append_history(history.history_rows(searches, V.ntz(NOW)), path)
    return spark.read.parquet(path)


@query
def cache_upsert(spark, sf):
    """The searches in two batches, odd ids first, into a table in buckets of their keys."""
    rows = C.header_rows(V.search_history(spark, sf), "searched_at", SEARCH)
    table = create_buckets(spark, work_path(spark, "cache"), rows.schema, "query_hash", 16)
    for part in (1, 0):
        table = table.update(rows.where(F.col("id") % 2 == part), lambda old, new: C.upsert_header(old, new.select(*old.columns), ["created_at", "id"]))
    return table.read().select("query_hash", "query", "domain_filter", "results_count", "created_at", "expires_at")


@query
def backfill_domain(spark, sf):
    known = urls.extract_domain("url")
    third = F.col("page_id") % 3
    domain = F.when(third == 0, F.lit("")).when(third == 1, known)
    pages = V.table(spark, sf, "pages").select("page_id", "url", domain.alias("domain"))
    return tables.backfill_domain(pages)


@query
def parse_seed_list(spark, sf):
    per_domain = V.seeds(spark, sf).select(
        F.col("ord").alias("list_id"),
        F.concat(F.lit("\n  \n"), F.col("url"), F.lit("\n\n"), F.upper("url"), F.lit(" \n")).alias("text"),
    )
    rows = tables.parse_lines(per_domain, "text")
    return rows.select("list_id", F.col("ord").cast("long").alias("ord"), "line")


# URL, HTML, text and format functions


@query
def extract_domain(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", urls.extract_domain("url").alias("domain")
    )


@query
def valid_url(spark, sf):
    return extract.anchors(V.extracted(spark, sf)).select(
        "page_id", F.col("pos").cast("long").alias("pos"),
        urls.is_web_url("href").alias("href_valid"), urls.is_web_url("url").alias("url_valid"),
    )


@query
def allowed_domain_filter(spark, sf):
    allowed = V.seeds(spark, sf).where(F.col("url").like("%.example.net/%")).select(
        F.concat(F.lit("WWW."), urls.extract_domain("url")).alias("domain")
    )
    named = spark.createDataFrame([("www.Example.ORG",)], "domain string")
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    return links.filter_allowed(pages, "url", allowed.unionByName(named))


@query
def extract_anchors(spark, sf):
    rows = extract.anchors(V.extracted(spark, sf)).drop("url")
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query
def resolve_links(spark, sf):
    rows = extract.resolved_links(V.extracted(spark, sf))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "link")


@query
def canonical_url(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", urls.canonical_url("url").alias("canonical")
    )


@query
def page_outlinks(spark, sf):
    rows = extract.page_outlinks(V.extracted(spark, sf))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def _marked(spark, sf):
    return extract.with_markup(V.table(spark, sf, "pages"))


@query
def page_title(spark, sf):
    return _marked(spark, sf).select("page_id", html.page_title("markup").alias("title"))


@query
def strip_boilerplate(spark, sf):
    return _marked(spark, sf).select("page_id", "body")


@query
def page_text(spark, sf):
    return _marked(spark, sf).select("page_id", html.page_text("body").alias("text"))


@query
def page_content(spark, sf):
    return _marked(spark, sf).select("page_id", html.page_content("body").alias("content"))


@query
def clean_text(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", text.clean_text("text").alias("cleaned")
    )


@query
def weighted_text(spark, sf):
    return V.docs(spark, sf).select(
        "page_id", text.weighted_text("title", "content").alias("weighted")
    )


@query
def snippet(spark, sf):
    return V.docs(spark, sf).select("page_id", text.snippet("content").alias("content_snippet"))


@query
def cache_key(spark, sf):
    searches = V.search_history(spark, sf).select("id", "query", "domain_filter")
    asked = V.queries(spark, sf).select(F.col("query_id").alias("id"), "query", "domain_filter")
    return searches.unionByName(asked).select(
        "id", "query", text.cache_key("query", "domain_filter").alias("query_hash")
    )


@query
def results_json(spark, sf):
    """Results as one JSON text per hit, decoded again."""
    found = search.search(V.queries(spark, sf), V.doc_index(spark, sf), SEARCH)
    record = F.struct("url", "title", "domain", "content_snippet")
    schema = "url string, title string, domain string, content_snippet string"
    encoded = found.select("query_id", "rank", F.to_json(record).alias("json"))
    decoded = encoded.select("query_id", "rank", F.from_json("json", schema).alias("r"))
    return decoded.select("query_id", F.col("rank").cast("long").alias("rank"), "r.*")


@query
def iso_time(spark, sf):
    return V.table(spark, sf, "events").select("event_id", formats.iso_time("ts").alias("iso"))


@query
def score_percent(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id",
        formats.score_percent(F.col("value") / 1000).alias("percent"),
        formats.milliseconds("value").alias("ms"),
    )


@query
def display_domain(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", urls.display_domain("url").alias("domain")
    )


# Text index and retrieval


@query
def tokens(spark, sf):
    rows = ix.word_positions(V.docs(spark, sf))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query
def tokens_no_stop(spark, sf):
    words = ix.doc_words(V.docs(spark, sf), INDEX)
    rows = words.select("page_id", F.posexplode(text.computed("words")).alias("pos", "word"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query
def ngrams(spark, sf):
    rows = ix.ngram_positions(V.docs(spark, sf), INDEX)
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query
def term_freq(spark, sf):
    return ix.term_freq(V.docs(spark, sf), INDEX)


@query
def doc_freq(spark, sf):
    return ix.doc_freq(V.docs(spark, sf), INDEX)


@query
def vocabulary(spark, sf):
    return ix.vocabulary(ix.frequent_terms(V.docs(spark, sf), INDEX), INDEX)


@query
def vocabulary_pruned(spark, sf):
    """The same vocabulary, dropping hopeless word pairs before the shuffle."""
    params = IndexParams()
    return ix.vocabulary(ix.frequent_terms(V.docs(spark, sf), params), params)


@query
def idf(spark, sf):
    vocab = ix.vocabulary(ix.frequent_terms(V.docs(spark, sf), INDEX), INDEX)
    return rounded(ix.with_idf(vocab, V.docs(spark, sf)).select("term", "df", "idf"), "idf")


@query
def tfidf_postings(spark, sf):
    return rounded(V.doc_index(spark, sf).postings, "weight")


@query
def index_summary(spark, sf):
    return ix.index_summary(V.doc_index(spark, sf))


@query
def index_size(spark, sf):
    return V.doc_index(spark, sf).vocab.agg(F.count("*").alias("index_size"))


@query
def query_vectors(spark, sf):
    vectors = search.query_vectors(V.queries(spark, sf), V.doc_index(spark, sf))
    return rounded(vectors.drop("key"), "weight")


@query
def cosine_scores(spark, sf):
    index = V.doc_index(spark, sf)
    vectors = search.query_vectors(V.queries(spark, sf), index)
    return rounded(search.cosine_scores(index.postings, vectors, index), "score")


def _ranked(found):
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), "score")


@query
def search_ranked(spark, sf):
    return _ranked(search.search(V.queries(spark, sf), V.doc_index(spark, sf), SEARCH))


REGISTRY["search"] = REGISTRY.pop("search_ranked")


@query
def search_stored_index(spark, sf):
    """The same search over an index stored and opened again from its path."""
    path = ix.store_index(V.doc_index(spark, sf)).path
    return _ranked(search.search(V.queries(spark, sf), ix.open_index(spark, path), SEARCH))


@query
def search_stored_domain(spark, sf):
    """Totals of a stored index for one domain and for all, which read the postings' folders they need."""
    index = ix.store_index(V.doc_index(spark, sf))
    filtered = V.queries(spark, sf).where("domain_filter = 'src1'")
    return search.total_found(filtered.unionByName(V.queries(spark, sf).where("domain_filter = 'all'")), index, SEARCH)


@query
def total_found(spark, sf):
    return search.total_found(V.queries(spark, sf), V.doc_index(spark, sf), SEARCH)


@query
def search_domain(spark, sf):
    filtered = V.queries(spark, sf).where(~F.coalesce("domain_filter", F.lit("")).isin("", "all"))
    return _ranked(search.ranked_hits(filtered, V.doc_index(spark, sf), SEARCH))


@query
def search_empty(spark, sf):
    """Blank queries: every one, and one per source."""
    per_source = V.table(spark, sf, "documents").groupBy(F.col("source").alias("domain_filter")).agg(
        (F.min("doc_id") + 100_000).alias("query_id"), F.lit(" ").alias("query")
    )
    asked = V.literal_queries(spark).unionByName(per_source).where(F.trim("query") == "")
    index = V.doc_index(spark, sf)
    return _ranked(search.ranked_hits(asked, index, SearchParams(limit=50)))


@query
def search_no_match(spark, sf):
    totals = search.total_found(V.queries(spark, sf), V.doc_index(spark, sf), SEARCH)
    return totals.where("total_found = 0")


def _crawled_records(spark, sf):
    pages = V.crawl_pages(spark, sf).select("page_id", "url", "html", "crawl_time")
    records = crawl(V.seeds(spark, sf), pages, V.FULL_CRAWL, V.graph_links(spark, sf))
    return materialize(records, "records")


@query
def search_results(spark, sf):
    """Pages crawled, extracted, indexed, then searched for their seeds' titles."""
    records = _crawled_records(spark, sf)
    index = ix.build_index(records, INDEX)
    roots = records.where("depth = 0")
    asked = roots.select(
        F.col("page_id").alias("query_id"), F.col("title").alias("query"),
        F.when(F.col("page_id") % 2 == 0, F.col("domain")).alias("domain_filter"),
    )
    blank = spark.createDataFrame([(-1, "", None)], asked.schema)
    found = search.search_results(
        asked.unionByName(blank), index, records, lambda wanted: page_routes(records, wanted), SEARCH
    )
    route = F.array_join("route.url", " > ")
    return _ranked(found.withColumn("route", route))


# Graph traversal


@query
def seed_frontier(spark, sf):
    frontier = traverse.seed_frontier(V.seeds(spark, sf), V.FULL_CRAWL)
    return frontier.select("url", "depth", "parent_url", F.get("path", F.lit(0)).alias("ord"))


def _bfs(spark, sf, params=V.FULL_CRAWL):
    corpus = V.table(spark, sf, "pages")
    return traverse.bfs(V.seeds(spark, sf), corpus, V.graph_links(spark, sf), params)


def _bfs_crawl(spark, sf, params=V.FULL_CRAWL):
    corpus = V.table(spark, sf, "pages")
    return traverse.crawl_bfs(V.seeds(spark, sf), corpus, V.graph_links(spark, sf), params)


@query
def bfs_depths(spark, sf):
    return _bfs(spark, sf).where("fetched").select("url", "depth")


@query
def bfs_visited(spark, sf):
    return _bfs(spark, sf).select("url", "depth", "fetched")


@query
def bfs_parents(spark, sf):
    return _bfs_crawl(spark, sf)


@query
def bfs_budget(spark, sf):
    return _bfs_crawl(spark, sf, V.SMALL_CRAWL)


@query
def page_routes_query(spark, sf):
    reached = _bfs(spark, sf).where("fetched").select("url", "parent_url")
    pages = V.table(spark, sf, "pages").select("page_id", "url", F.lit("").alias("title"))
    routes = page_routes(materialize(pages.join(reached, "url"), "tree"))
    return routes.select("page_id", F.array_join("route.url", " > ").alias("route"))


REGISTRY["page_routes"] = REGISTRY.pop("page_routes_query")


def _dfs(spark, sf, params):
    corpus = V.table(spark, sf, "pages")
    return crawl_dfs(
        V.seeds(spark, sf), corpus, V.graph_links(spark, sf), params, links_stay_in_site=True
    )


@query
def dfs_crawl(spark, sf):
    return _dfs(spark, sf, V.FULL_CRAWL)


@query
def dfs_tree_order(spark, sf):
    tree = _bfs(spark, sf).where("fetched").select("url", "depth", "path")
    return global_ordinal(tree, [F.col("path")], "visit").drop("path")


@query
def crawl_status(spark, sf):
    return rounded(stats.crawl_status(V.crawls(spark, sf)), "progress_percentage")


@query
def crawl_eta(spark, sf):
    return stats.crawl_eta(V.crawls(spark, sf), V.ntz("2024-01-01 03:00:00"))


@query
def crawl_job(spark, sf):
    """A crawl stored in an empty table, then a second one over it."""
    pages = V.crawl_pages(spark, sf).select("page_id", "url", "html", "crawl_time")
    found, start = V.graph_links(spark, sf), V.seeds(spark, sf)
    path = work_path(spark, "page-table")
    for params, now in ((V.FULL_CRAWL, NOW), (V.SMALL_CRAWL, "2024-06-02 00:00:00")):
        stored = store_crawl(crawl(start, pages, params, found), path, V.ntz(now))
    return stored.select(*PAGE_COLUMNS)


REGISTRY["crawl"] = REGISTRY.pop("crawl_job")


@query
def coverage_compare(spark, sf):
    return traverse.coverage(_bfs_crawl(spark, sf), _dfs(spark, sf, V.FULL_CRAWL))


@query
def depth_histogram(spark, sf):
    return traverse.depth_histogram(_bfs(spark, sf).where("fetched"))


@query
def recommend_traversal(spark, sf):
    sizes = V.table(spark, sf, "pages").groupBy(urls.extract_domain("url").alias("domain")).agg(
        F.count("*").alias("n")
    )
    kinds = F.array(*[F.lit(k) for k in ("catalog", "documentation", "hierarchical", "interconnected", "other")])
    profiles = sizes.select(
        "domain",
        F.get(kinds, (F.col("n") % 5).cast("int")).alias("website_type"),
        F.when(F.length("domain") % 2 == 0, "deep").otherwise("shallow").alias("content_depth"),
        F.when(F.col("n") > 8, "low").otherwise("high").alias("memory"),
    )
    return traverse.recommend(profiles)


@query
def frontier_width(spark, sf):
    return traverse.frontier_width(_bfs(spark, sf).where("fetched"))


# Cache, history, statistics, paging


@query
def cache_lookup(spark, sf):
    asked = V.queries(spark, sf).unionByName(history.replay_queries(V.search_history(spark, sf)))
    found = C.lookup(asked, V.search_cache(spark, sf), V.as_of(spark, sf))
    return found.select("query_id", "query_hash", "cached", "expires_at")


@query
def search_cached(spark, sf):
    """The batch queries fill the cache; then all queries run against it."""
    index = ix.store_index(V.doc_index(spark, sf))
    empty = C.empty_cache(spark)
    filled = C.search_cached(V.batch_queries(spark, sf), index, empty, V.ntz(NOW), SEARCH).new
    later = V.ntz("2024-06-01 00:30:00")
    found = C.search_cached(V.queries(spark, sf), index, filled, later, SEARCH)
    return _ranked(found.results.drop("route", "last_crawled"))


@query
def cache_purge(spark, sf):
    return C.purge(V.search_cache(spark, sf), V.as_of(spark, sf))


@query
def cache_clear(spark, sf):
    rest, deleted = C.clear(V.search_cache(spark, sf))
    left = rest.agg(F.count("*").alias("value")).select(F.lit("left").alias("metric"), "value")
    gone = deleted.select(F.lit("deleted").alias("metric"), F.col("deleted").alias("value"))
    return left.unionByName(gone)


@query
def history_view(spark, sf):
    return history.history_view(V.search_history(spark, sf))


@query
def history_delete(spark, sf):
    searches = V.search_history(spark, sf)
    return history.delete_entries(searches, searches.where("query = ''").select("id"))


@query
def stats_counts(spark, sf):
    return stats.counts(
        V.table(spark, sf, "pages"), V.search_history(spark, sf), V.search_cache(spark, sf),
        V.as_of(spark, sf),
    )


@query
def domains(spark, sf):
    return stats.domains(V.table(spark, sf, "pages").select(urls.extract_domain("url").alias("domain")))


@query
def domain_stats(spark, sf):
    return stats.domain_stats(V.table(spark, sf, "pages").select(urls.extract_domain("url").alias("domain")))


@query
def stats_record(spark, sf):
    return stats.stats(
        V.crawl_pages(spark, sf), V.search_history(spark, sf), V.search_cache(spark, sf),
        V.doc_index(spark, sf).vocab, V.as_of(spark, sf), stats.overall_status(V.crawls(spark, sf)),
    )


REGISTRY["stats"] = REGISTRY.pop("stats_record")


@query
def result_page(spark, sf):
    index = V.doc_index(spark, sf)
    found = search.search(V.queries(spark, sf), index, SearchParams(limit=100))
    page = search.result_page(found.drop("content_snippet", "title"), size=5, page=3)
    return _ranked(page).withColumn("position", F.col("position").cast("long"))


@query
def result_page_domain(spark, sf):
    """The first display page of one domain's results."""
    found = search.search(V.queries(spark, sf), V.doc_index(spark, sf), SearchParams(limit=100))
    page = search.result_page(found.drop("content_snippet", "title"), size=5, page=1, domain="src1")
    return _ranked(page).withColumn("position", F.col("position").cast("long"))


@query
def page_by_url(spark, sf):
    """The pages that edges point to, looked up by url."""
    wanted = V.edges(spark, sf).select(F.col("t_url").alias("url"))
    return V.table(spark, sf, "pages").select("page_id", "url").join(wanted, "url", "left_semi")


@query
def replay_history(spark, sf):
    """Past searches again: those of the events, and one for each benchmark text, which find pages."""
    past = V.search_history(spark, sf).select("id", "query", "domain_filter")
    batch = V.batch_queries(spark, sf).select((F.col("query_id") + 1_000_000_000).alias("id"), "query", "domain_filter")
    asked = history.replay_queries(past.unionByName(batch))
    return _ranked(search.ranked_hits(asked, V.doc_index(spark, sf), SEARCH))
