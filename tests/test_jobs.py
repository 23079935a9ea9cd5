from pyspark.sql import functions as F

from pagewright.operators import index as ix
from pagewright.operators.history import history_view
from pagewright.operators.index import build_index
from pagewright.params import CrawlParams, IndexParams, SearchParams
from pagewright.plans import serve
from pagewright.plans.crawl import corpus_links, crawl, open_raw_pages, store_crawl, store_raw_pages
from pagewright.sources.buckets import open_buckets
from pagewright.streaming.ingest import ingest
from tests.test_search import PAGES, QUERIES, SCHEMA


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_serve_keeps_cache_and_history(spark, tmp_path):
    root = str(tmp_path / "state")
    index = build_index(spark.createDataFrame(PAGES, SCHEMA))
    asked = spark.createDataFrame([(1, "kayak", None), (2, "zzz", None), (3, "", "charts.example")], QUERIES)
    found, summary = serve.serve(asked, index, root, at("2024-01-01 00:00:00"), SearchParams(limit=1))
    assert {(r.query_id, r.url[-5:]) for r in found.collect()} == {(1, "addle"), (3, "/maps")}
    assert {(r.query_id, r.total_found, r.cached) for r in summary.collect()} == {
        (1, 2, False), (2, 0, False), (3, 1, False)
    }
    _, again = serve.serve(asked, index, root, at("2024-01-01 00:30:00"))
    assert {(r.query_id, r.total_found, r.cached) for r in again.collect()} == {
        (1, 2, True), (2, 0, False), (3, 1, True)
    }
    uncached, plain = serve.serve(asked, index, root, at("2024-01-01 00:40:00"), use_cache=False)
    assert uncached.count() == 3 and not plain.where("cached").count()
    history = spark.read.parquet(f"{root}/history")
    assert history.count() == 9 and history.select("id").distinct().count() == 9
    assert history_view(history, 3).where("NOT cached").count() == 3
    assert serve.load_cache(spark, root).header.count() == 2
    last = history.orderBy(F.desc("id")).limit(1)
    serve.delete_history(spark, root, last)
    assert serve.load_history(spark, root).count() == 8 and serve.load_history(spark, root).join(last, "id", "left_semi").isEmpty()
    serve.delete_history(spark, root)
    assert serve.load_history(spark, root).isEmpty()
    assert serve.purge_cache(spark, root, at("2024-01-01 00:59:00")) == 0
    assert serve.purge_cache(spark, root, at("2024-01-01 01:00:00")) == 2
    serve.serve(asked, index, root, at("2024-01-01 02:00:00"))
    assert serve.clear_cache(spark, root) == 2
    assert serve.load_cache(spark, root).header.isEmpty() and serve.load_cache(spark, root).records.isEmpty()


def test_serve_gives_routes_and_crawl_times(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("crawl_time", at("2024-01-01 00:00:00")).withColumn(
        "parent_url", F.when(F.col("page_id") == 2, PAGES[0][1]))
    index = build_index(pages)
    asked = spark.createDataFrame([(1, "river trips", None), (2, "", "charts.example")], QUERIES)
    for day in ("2024-02-01 00:00:00", "2024-02-01 00:01:00"):
        found, summary = serve.serve(asked, index, str(tmp_path / "state"), at(day), pages=pages)
        got = {r.query_id: (r.page_id, [s.url for s in r.route], str(r.last_crawled)[:10]) for r in found.collect()}
        assert got == {1: (2, [PAGES[0][1], PAGES[1][1]], "2024-01-01"), 2: (3, [PAGES[2][1]], "2024-01-01")}
    assert summary.where("cached").count() == 2


def test_stream_upserts_arriving_pages(spark, tmp_path):
    incoming, table = str(tmp_path / "in"), str(tmp_path / "table")

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), "page_id long, url string, html string, status_code int, t string")
        df.select(
            "page_id", "url", "html", "status_code", F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("parent_url"), F.col("t").cast("timestamp_ntz").alias("crawl_time"),
        ).write.mode("append").parquet(incoming)
        query = ingest(spark, incoming, table, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    arrive((1, "http://a.x/1", "<title>One</title>", 200, "2024-01-01"), (2, "http://a.x/2", "", 404, "2024-01-01"))
    arrive((1, "http://a.x/1", "<title>New</title>", 200, "2024-01-03"), (1, "http://a.x/1", "<title>Mid</title>", 200, "2024-01-02"))
    rows = open_buckets(spark, table).read().collect()
    assert [(r.url, r.title, r.domain) for r in rows] == [("http://a.x/1", "New", "a.x")]


def test_stores_bring_the_index_up_to_date(spark, tmp_path, monkeypatch):
    table, index = str(tmp_path / "pages"), str(tmp_path / "index")
    params = IndexParams(max_features=40)

    def crawled(version, *numbers):
        rows = [(i, f"http://s{i % 3}.x/{i}", f"Title {i % 4} {version}", f"common word{i % 5} pair{i % 5} {version} only{i}") for i in numbers]
        df = spark.createDataFrame(rows, "page_id long, url string, title string, content string")
        return df.select("*", at("2024-01-01 00:00:00").alias("crawl_time"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"),
                         F.lit(200).alias("status_code"), F.col("page_id").alias("crawl_order"))

    tokenised = []
    real = ix.doc_words
    monkeypatch.setattr(ix, "doc_words", lambda docs, *more: tokenised.append(docs.count()) or real(docs, *more))
    for day, (version, numbers) in enumerate((("first", range(30)), ("second", range(25, 40)), ("third", [3])), 1):
        pages = store_crawl(crawled(version, *numbers), table, at(f"2024-01-0{day} 00:00:00"), index, params)
    assert tokenised == [30, 15, 1]
    got, whole = ix.open_index(spark, f"{index}/index"), ix.build_index(pages, params)
    assert got.params == params and sorted(got.docs.collect()) == sorted(whole.docs.collect())

    def rounded(df, name):
        return sorted(tuple(r) for r in df.withColumn(name, F.round(name, 9)).collect())

    assert rounded(got.vocab, "idf") == rounded(whole.vocab, "idf")
    assert rounded(got.postings.drop("domain_part"), "weight") == rounded(whole.postings, "weight")


def test_crawls_over_stored_pages_move_no_html(spark, tmp_path):
    html = {f"http://a.x/{i}": f"<title>Page {i}</title><a href='/{2 * i + 1}'>l</a><a href='/{2 * i + 2}'>r</a>" for i in range(40)}
    raw = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string").withColumn(
        "crawl_time", at("2024-01-01 00:00:00"))
    seeds = spark.createDataFrame([("http://a.x/0", 0)], "url string, ord long")
    store_raw_pages(raw, str(tmp_path / "raw"))
    pages, buckets = open_raw_pages(spark, str(tmp_path / "raw"))
    links = corpus_links(raw)
    expected = sorted(crawl(seeds, raw, CrawlParams(), links).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = crawl(seeds, pages, CrawlParams(), links, buckets=buckets)
        assert sorted(found.select(*crawl(seeds, raw, CrawlParams(), links).columns).collect()) == expected
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Whatever is exchanged lies above a scan without html.
    for part in plan.split("Exchange ")[1:]:
        assert "html" not in part.split("FileScan", 1)[1].split("ReadSchema", 1)[1].split("\n")[0]
    allowed = spark.createDataFrame([("b.x",)], "domain string")
    assert crawl(seeds, pages, CrawlParams(), links, allowed=allowed, buckets=buckets).isEmpty()
    assert crawl(seeds, pages, CrawlParams(), links, allowed=allowed.select(F.lit("a.x").alias("domain")), buckets=buckets).count() == len(expected)
