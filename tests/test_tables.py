import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import cache as C
from pagewright.operators import history, links, stats
from pagewright.params import SearchParams
from pagewright.plans.crawl import SUMMARY, link_table, page_table, store_crawl
from pagewright.sources import tables
from pagewright.sources.buckets import create_buckets, open_buckets

PAGE = (
    "page_id long, url string, title string, content string, domain string, crawl_time timestamp_ntz, "
    "depth int, parent_url string, status_code int, created_at timestamp_ntz, updated_at timestamp_ntz"
)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def stored(spark, *urls):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    t = at("2024-01-01 00:00:00")
    return rows.select(
        "page_id", "url", F.lit("old").alias("title"), F.lit("").alias("content"),
        F.lit("a.x").alias("domain"), t.alias("crawl_time"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_url"), F.lit(200).alias("status_code"),
        t.alias("created_at"), t.alias("updated_at"),
    )


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), "url string, title string, parent_url string, seq long")
    return df.select(
        "url", "title", F.lit("").alias("content"), at("2024-02-01 00:00:00").alias("crawl_time"),
        F.lit(1).alias("depth"), "parent_url", F.lit(200).alias("status_code"), "seq",
    )


def test_upsert_keeps_ids_and_is_idempotent(spark):
    base = stored(spark, "http://a.x/0", "http://a.x/1")
    new = batch(
        spark, ("http://a.x/1", "first", None, 1), ("http://a.x/1", "last", None, 2), ("http://b.x/", "new", None, 1)
    )
    now = at("2024-02-02 00:00:00")
    once = tables.upsert_pages(base, new, "seq", now)
    twice = tables.upsert_pages(once, new, "seq", now)
    assert sorted(once.collect()) == sorted(twice.collect())
    got = {r.url: r for r in once.collect()}
    assert (got["http://a.x/0"].title, got["http://a.x/1"].title) == ("old", "last")
    assert got["http://a.x/1"].page_id == 1
    assert got["http://a.x/1"].created_at.month == 1 and got["http://a.x/1"].updated_at.month == 2
    assert got["http://b.x/"].domain == "b.x" and got["http://b.x/"].created_at.month == 2
    hashed = spark.range(1).select(F.xxhash64(F.lit("http://b.x/"))).first()[0]
    assert got["http://b.x/"].page_id == hashed
    numbered = {r.url: r.page_id for r in tables.upsert_pages(base, new.withColumn("page_id", F.lit(7)), "seq", now).collect()}
    assert numbered == {"http://a.x/0": got["http://a.x/0"].page_id, "http://a.x/1": 1, "http://b.x/": 7}


def test_equal_times_have_one_winner(spark):
    rows = [("http://b.x/", "p", None, 1), ("http://b.x/", "q", "http://a.x/", 1)]
    now = at("2024-02-02 00:00:00")
    for order in (rows, rows[::-1]):
        got = tables.upsert_pages(stored(spark, "http://a.x/0"), batch(spark, *order), "seq", now)
        assert [r.title for r in got.where("url = 'http://b.x/'").collect()] == ["q"]


def test_page_links_need_the_parent(spark):
    pages = spark.createDataFrame([(1, "u1"), (2, "u2")], "page_id long, url string")
    found = spark.createDataFrame(
        [(2, "u1"), (2, "u1"), (1, "gone"), (1, None), (1, "")], "page_id long, parent_url string"
    )
    assert [tuple(r) for r in links.page_links(found, pages).collect()] == [(1, 2)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, path)
    assert tables.write_snapshot(spark.range(3), path) == 1
    assert tables.write_snapshot(tables.read_snapshot(spark, path).where("id > 0"), path) == 2
    (tmp_path / "t" / "snapshot=3").mkdir()  # a job lost halfway
    assert sorted(r.id for r in tables.read_snapshot(spark, path).collect()) == [1, 2]
    assert tables.table_size(spark, path).first().size_bytes > 0


def test_export(spark, tmp_path):
    path = str(tmp_path / "export")
    pages = stored(spark, "http://a.x/é")
    tables.export_pages(pages, path)
    [line] = [x for f in (tmp_path / "export").glob("part-*") for x in f.read_text("utf-8").splitlines()]
    assert "é" in line
    assert json.loads(line) == {
        "url": "http://a.x/é", "title": "old", "content": "", "domain": "a.x",
        "crawl_time": "2024-01-01T00:00:00.000000", "depth": 0, "parent_url": None,
    }


def test_backfill_and_seed_lists(spark):
    df = spark.createDataFrame([(1, "http://www.A.x/p")], "page_id long, url string")
    assert tables.backfill_domain(df).first().domain == "a.x"
    text = spark.createDataFrame([("http://a\n\n  \t\nhttp://b \n",)], "seeds string")
    assert [(r.ord, r.line) for r in tables.parse_lines(text, "seeds").collect()] == [(0, "http://a"), (1, "http://b ")]


def test_cache_lives_for_its_ttl(spark):
    asked = spark.createDataFrame(
        [("A", None, 1), ("a ", "all", 2), ("b", None, 3)], "query string, domain_filter string, id long"
    )
    rows = C.header_rows(asked, at("2024-01-01 23:30:00"), SearchParams(cache_ttl_seconds=3600))
    header = C.upsert_header(None, rows, ["id"])
    assert sorted(r.query for r in header.collect()) == ["a ", "b"]
    assert C.purge(header, at("2024-01-02 00:29:59")).count() == 2
    assert C.purge(header, at("2024-01-02 00:30:00")).count() == 0
    found = C.lookup(asked.drop("id"), header, at("2024-01-02 00:00:00"))
    assert all(r.cached for r in found.collect())
    left, deleted = C.clear(header)
    assert (left.count(), deleted.first().deleted) == (0, 2)


def test_history(spark, tmp_path):
    rows = [(1, "python", None, 5, 100.0, False), (2, "", "x.com", 3, 150.06, True), (3, "python", "all", 0, 1.0, False)]
    asked = spark.createDataFrame(
        rows, "id long, query string, domain_filter string, results_count int, execution_time double, cached boolean"
    )
    path = str(tmp_path / "history")
    for i in (1, 2, 3):
        history.append_history(history.history_rows(asked.where(f"id = {i}"), at("2024-01-01 00:00:00")), path)
    stored_rows = spark.read.parquet(path)
    view = history.history_view(stored_rows, 2).collect()
    assert [(r.id, r.query_label, r.time_label) for r in view] == [(3, "python", "1.0ms"), (2, "(empty query)", "150.1ms")]
    assert view[1].cached is True
    ids = spark.createDataFrame([(2,)], "id long")
    assert history.delete_entries(stored_rows, ids).count() == 2
    assert history.delete_entries(stored_rows).count() == 0
    assert {(r.query_id, r.query, r.domain_filter) for r in history.replay_queries(stored_rows).collect()} == {
        (1, "python", "all"), (2, "", "x.com")
    }


def test_stats(spark):
    pages = stored(spark, "http://a.x/0", "http://a.x/1")
    searches = spark.range(4)
    header = spark.range(3).select(
        F.when(F.col("id") == 0, at("2024-01-01")).otherwise(at("2024-01-03")).alias("expires_at")
    )
    record = stats.stats(pages, searches, header, spark.range(7), at("2024-01-02"), "crawling", 1048576)
    assert {(r.metric, r.key): r.value for r in record.collect()} == {
        ("total_pages", ""): "2", ("total_searches", ""): "4", ("cached_queries", ""): "2",
        ("last_crawl", ""): "2024-01-01T00:00:00", ("index_size", ""): "7",
        ("crawl_status", ""): "crawling", ("domains", "a.x"): "a.x", ("domain_stats", "a.x"): "2", ("database_size", ""): "1.0 MB",
    }
    crawls = spark.createDataFrame([(True, 0), (False, 3)], "is_crawling boolean, pages_crawled long")
    for kept, state in (("true", "crawling"), ("not is_crawling", "completed"), ("pages_crawled = 9", "idle")):
        assert stats.overall_status(crawls.where(kept)).first().status == state


def test_crawl_status_and_eta(spark):
    rows = [("run", 5, 20, True), ("done", 3, 20, False), ("idle", 0, 20, False), ("none", 0, 0, False), ("new", 0, 9, True)]
    crawls = spark.createDataFrame(
        rows, "crawl_id string, pages_crawled long, total_pages long, is_crawling boolean"
    ).withColumn("start_time", at("2024-01-01 00:00:00"))
    status = {r.crawl_id: (r.status, r.progress_percentage) for r in stats.crawl_status(crawls).collect()}
    assert status == {
        "run": ("crawling", 25.0), "done": ("completed", 15.0), "idle": ("idle", 0.0),
        "none": ("idle", 0.0), "new": ("crawling", 0.0),
    }
    eta = {r.crawl_id: r.estimated_completion for r in stats.crawl_eta(crawls, at("2024-01-01 00:10:00")).collect()}
    assert str(eta["run"]) == "2024-01-01 00:40:00"
    assert {k for k, v in eta.items() if v is None} == {"done", "idle", "none", "new"}


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("part-*")}


def test_updates_write_only_the_buckets_of_their_keys(spark, tmp_path):
    pages = spark.range(4000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://s"), F.col("id") % 100, F.lit(".x/"), F.col("id")).alias("url"), F.lit("old").alias("title"),
        F.concat(F.lit("s"), F.col("id") % 100, F.lit(".x")).alias("domain"))
    table = create_buckets(spark, str(tmp_path), pages.schema, "url", 256, "domain", 4).update(pages, lambda old, new: new)
    before, first = files(tmp_path), {tuple(r) for r in table.read().collect()}
    assert first == {tuple(r) for r in pages.collect()}
    batch = pages.where("domain = 's7.x'").withColumn("title", F.lit("new"))  # a hundredth of the urls

    def merge(old, new):
        return old.join(new.select("url"), "url", "left_anti").select(*new.columns).unionByName(new)

    later = table.update(batch, merge)
    assert 0 < len(later.touched(batch)) <= 4 and set(later.held) == set(table.held)
    written = {f for f in files(tmp_path / "data") if f.startswith("version=3/")}
    assert len(written) <= 4 and {tuple(r) for r in table.read().collect()} == first
    expected = {(i, u, "new" if d == "s7.x" else t, d) for i, u, t, d in first}
    assert {tuple(r) for r in later.read().collect()} == expected
    assert {tuple(r) for r in open_buckets(spark, str(tmp_path)).read(later.touched(batch)).where("domain = 's7.x'").collect()} == {
        r for r in expected if r[3] == "s7.x"}
    twice = later.update(batch, merge)
    assert {tuple(r) for r in twice.read().collect()} == expected
    # The first files of the changed buckets are gone, the others are still those.
    now = files(tmp_path)
    assert len(before - now) >= len(written) and len([f for f in now if "version=2/" in f]) >= 0.9 * len([f for f in before if "version=2/" in f])
    (tmp_path / "manifest" / "version=99").mkdir()  # an update lost halfway
    assert open_buckets(spark, str(tmp_path)).version == twice.version
    assert twice.update(batch.limit(0), merge).version == twice.version
    with pytest.raises(ValueError):
        twice.replace([0], pages)
    cleared = twice.clear()
    assert cleared.read().isEmpty() and cleared.held == {}
    assert {tuple(r) for r in cleared.update(batch, merge).read().collect()} == {tuple(r) for r in batch.collect()}


def test_stored_statistics_add_up(spark, tmp_path):
    table = str(tmp_path / "pages")

    def crawl_of(day, *urls):
        rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "crawl_order long, url string")
        return rows.select(
            "url", F.xxhash64("url").alias("page_id"), F.lit("t").alias("title"), F.lit("").alias("content"), at(day).alias("crawl_time"),
            F.lit(0).alias("depth"), F.lit("http://a.x/0" if day > "2024-01-01" else None).cast("string").alias("parent_url"),
            F.lit(200).alias("status_code"), "crawl_order")

    store_crawl(crawl_of("2024-01-01", "http://a.x/0", "http://a.x/1", "http://b.x/"), table, at("2024-01-01"))
    store_crawl(crawl_of("2024-01-05", "http://b.x/", "http://b.x/2", "http://c.x/"), table, at("2024-01-05"))
    summary = page_table(spark, table).summary(SUMMARY)
    assert {(r.domain, r.n) for r in summary.groupBy("domain").agg(F.sum("pages").alias("n")).collect()} == {("a.x", 2), ("b.x", 2), ("c.x", 1)}
    none = spark.createDataFrame([], "expires_at timestamp_ntz")
    record = stats.stats_of_summary(summary, spark.range(0), none, spark.range(3), at("2024-01-02"))
    whole = stats.stats(page_table(spark, table).read(), spark.range(0), none, spark.range(3), at("2024-01-02"))
    assert sorted(record.collect()) == sorted(whole.collect())
    ids = {r.url: r.page_id for r in page_table(spark, table).read().collect()}
    assert {tuple(r) for r in link_table(spark, table).read().collect()} == {
        (ids["http://a.x/0"], ids[u]) for u in ("http://b.x/", "http://b.x/2", "http://c.x/")}
