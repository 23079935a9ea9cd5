import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.operators import index as ix
from pagewright.operators import search as se
from pagewright.operators.cache import empty_cache, merged, search_cached
from pagewright.params import IndexParams, SearchParams, default_stop_words

PAGES = [
    (1, "https://trips.example/paddle", "Kayak Lessons",
     "Kayak lessons start on calm lakes. Our kayak school lends boats, helmets and maps of every lake.", "trips.example"),
    (2, "https://trips.example/rivers", "River Trips by Kayak",
     "River trips ask for experience. Guides lead river trips in spring and rent a kayak to guests.", "trips.example"),
    (3, "https://charts.example/maps", "Maps for Sailors",
     "Maps of coasts and harbours. Printed maps show depths, lights and currents.", "charts.example"),
]
SCHEMA = "page_id long, url string, title string, content string, domain string"
QUERIES = "query_id long, query string, domain_filter string"
NO_LIMIT = SearchParams(threshold=-1.0)


@pytest.fixture(scope="module")
def index(spark):
    return ix.build_index(spark.createDataFrame(PAGES, SCHEMA))


def ask(spark, *queries):
    rows = [(i, *(q if isinstance(q, tuple) else (q, None))) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, QUERIES)


def expected(query):
    """Cosines of TF-IDF vectors of words and word pairs, titles counted with their weight, by plain Python."""
    stop = set(default_stop_words())

    def counts(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))

    def unit(terms):
        weights = {t: n * (math.log((1 + len(PAGES)) / (1 + df[t])) + 1) for t, n in terms.items() if t in kept}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    docs = {p[0]: counts(f"{p[2]} {p[2]} {p[3]}") for p in PAGES}
    df = Counter(t for d in docs.values() for t in d)
    kept = {t for t, n in df.items() if n <= 0.95 * len(PAGES)}
    asked = unit(counts(query))
    scores = {i: sum(w * asked.get(t, 0) for t, w in unit(d).items()) for i, d in docs.items()}
    return {i: round(s, 6) for i, s in scores.items() if s > 0.001}


def test_scores_are_those_of_plain_python(spark, index):
    asked = ["kayak", "Kayak lessons", "river trips", "maps", "the", "zzz"]
    hits = se.keyword_hits(ask(spark, *asked), index, SearchParams()).collect()
    for i, query in enumerate(asked):
        assert {h.page_id: round(h.score, 6) for h in hits if h.query_id == i} == expected(query)
    assert set(expected("kayak")) == {1, 2} and not expected("the")


def test_postings_are_unit_vectors(index):
    norms = index.postings.groupBy("page_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 3 and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_empty_and_single_document(spark):
    for rows in ([], PAGES[:1]):
        index = ix.build_index(spark.createDataFrame(rows, SCHEMA))
        assert index.vocab.isEmpty() and index.postings.isEmpty()
        totals = se.total_found(ask(spark, "kayak"), index, SearchParams()).collect()
        assert [t.total_found for t in totals] == [0]


def test_vocabulary_cap_and_ties(spark):
    docs = spark.createDataFrame(PAGES, SCHEMA)
    for k in (1, 5, 20, 60, 500):
        params = IndexParams(max_features=k)
        every = sorted((-r.cf, r.term, r.df) for r in ix.doc_freq(docs, params).collect())
        likely = ix.frequent_terms(docs, params)
        got = sorted((-r.cf, r.term, r.df) for r in ix.vocabulary(likely, params).collect())
        assert got == every[:k]


def test_filters_blank_queries_and_totals(spark, index):
    queries = ask(
        spark, ("maps", "charts.example"), ("maps", "all"), ("", None), ("  ", "trips.example"), ("maps", "none"), ("", "none"),
    )
    ranked = se.ranked_hits(queries, index, SearchParams()).orderBy("query_id", "rank").collect()
    pages = {}
    for r in ranked:
        pages.setdefault(r.query_id, []).append(r.page_id)
    assert pages == {0: [3], 1: [3, 1], 2: [1, 2, 3], 3: [1, 2]}
    totals = {r.query_id: r.total_found for r in se.total_found(queries, index, SearchParams()).collect()}
    assert totals == {0: 1, 1: 2, 2: 3, 3: 2, 4: 0, 5: 0}
    one = se.ranked_hits(queries, index, SearchParams(limit=1)).collect()
    assert sorted((r.query_id, r.page_id) for r in one) == [(0, 3), (1, 3), (2, 1), (3, 1)]


def test_large_limits_take_the_salted_way(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    small = se.top_rows(df, "g", [F.desc("v")], 1200, "r")
    assert small.count() == 2400
    assert small.agg(F.min("v")).first()[0] == 5000 - 2400


def test_stored_index_gives_the_same_results(spark, index, tmp_path):
    queries = ask(spark, "kayak", "river trips", "", ("maps", "charts.example"), ("maps", "all"), ("maps", "none"))
    stored = ix.store_index(index, str(tmp_path / "index"))
    for some in (stored, ix.open_index(spark, str(tmp_path / "index"))):
        assert some.params == index.params and some.path
        a = se.search(queries, index).orderBy("query_id", "rank").collect()
        b = se.search(queries, some).orderBy("query_id", "rank").collect()
        assert a == b
        assert se.total_found(queries, index, SearchParams()).collect() == se.total_found(queries, some, SearchParams()).collect()
    for _ in range(2):
        ix.store_index(stored, str(tmp_path / "index"))
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["version=2", "version=3"]
    (tmp_path / "index" / "version=4" / "meta").mkdir(parents=True)  # a store lost halfway
    assert ix.open_index(spark, str(tmp_path / "index")).vocab.count() == index.vocab.count()
    with pytest.raises(FileNotFoundError):
        ix.open_index(spark, str(tmp_path / "none"))


def test_stored_index_moves_only_scores_and_reads_only_domains(spark, tmp_path):
    rows = [(i, f"u{i}", f"word{i % 40} thing{i % 7}", f"text word{i % 11} again{i % 5}", f"d{i % 20}") for i in range(400)]
    built = ix.build_index(spark.createDataFrame(rows, SCHEMA))
    stored = ix.store_index(built, str(tmp_path / "i"), shards=3, domain_parts=5)
    queries = ask(spark, "word3 thing4", ("word3 again1", "d7"))
    vectors = se.query_vectors(queries, stored)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def scores(index):
        return {(r.query_id, r.page_id): round(r.score, 9) for r in se.keyword_hits(queries, index, SearchParams()).collect()}

    assert scores(stored) == scores(built) and len(scores(stored)) > 20
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        hits = se.keyword_hits(queries, stored, SearchParams())
        assert "Exchange hashpartitioning" not in plan(hits) and "BroadcastHashJoin" in plan(hits)
        top = se.top_rows(hits, "query_id", se.rank_order(), 2, "rank")
        assert "WindowGroupLimit" in plan(top)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    inside = stored.postings.where(F.col("domain_part") == spark.range(1).select(ix.domain_part(F.lit("d7"), 5)).first()[0])
    assert 0 < len(inside.inputFiles()) < len(stored.postings.inputFiles())
    assert f"PartitionFilters: [isnotnull(domain_part" in plan(se.cosine_scores(stored.postings, vectors.where("key = 'd7'"), stored)) or (
        "domain_part" in plan(se.cosine_scores(stored.postings, vectors.where("key = 'd7'"), stored)).split("PartitionFilters: [")[-1].split("]")[0])


def test_queries_in_slices_give_the_same_scores(spark, index, monkeypatch):
    queries = ask(spark, "kayak", "river trips", ("maps", "charts.example"), "lessons", "guides spring")
    whole = sorted((r.query_id, r.page_id, round(r.score, 9)) for r in se.keyword_hits(queries, index, SearchParams()).collect())
    monkeypatch.setattr(se, "_SLICE_ROWS", 2)
    assert whole == sorted((r.query_id, r.page_id, round(r.score, 9)) for r in se.keyword_hits(queries, index, SearchParams()).collect())


def test_pages_are_scored_in_their_row(spark, monkeypatch):
    rows = [(i, f"u{i}", f"word{i % 9} thing{i % 7}", f"text word{i % 11} again{i % 5}", f"d{i % 4}" if i % 13 else None) for i in range(120)]
    queries = ask(spark, "word3 thing4", ("word3 again1", "d2"), "text", ("again1 thing2", "none"), "word3 thing4").unionByName(
        spark.createDataFrame([(0, "again1", "d3"), (None, "word5", "d1")], QUERIES))
    monkeypatch.setattr("pagewright.functions.counts._PRODUCTS", 50)

    def rounded(scores):
        return sorted((r.query_id or -1, r.page_id or -1, round(r.score, 9)) for r in scores.collect())

    for more in ([], [rows[3], rows[3], (None, *rows[5][1:]), (None, *rows[6][1:])]):
        index = ix.build_index(spark.createDataFrame(rows + more, SCHEMA))
        vectors = se.query_vectors(queries, index)
        hits = se.cosine_scores(index.postings, vectors, index)
        assert rounded(hits) == rounded(se.cosine_scores(index.postings, vectors)) and hits.count() > 50
        if not more:
            assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
        best = se.cosine_scores(index.postings, vectors, index, best=3)
        assert hits.count() > best.count()
        assert rounded(se.top_rows(best, "query_id", se.rank_order(), 3, "rank")) == rounded(se.top_rows(hits, "query_id", se.rank_order(), 3, "rank"))


def test_pairs_are_dropped_inside_their_page(spark):
    rows = [(i, f"u{i}", f"common shared{i % 3}", f"rare{i} common shared{i % 3} rare{i + 1}", "d") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    params = IndexParams(max_features=4, max_df=1.0)
    likely = ix.frequent_terms(docs, params)
    assert ix.doc_freq(docs, params).where("term like '% %'").count() > 100 > likely.where("term like '% %'").count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert "SortMergeJoin" not in ix.frequent_terms(docs, params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cache_first_search(spark, index):
    empty = empty_cache(spark)
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    queries = ask(spark, "kayak", "KAYAK ", "zzz", "")
    cold = search_cached(queries, index, empty, at("2024-01-01 00:00:00"))
    assert {r.query_id for r in cold.results.where("NOT cached").collect()} == {0, 1, 3}
    assert {(r.query_id, r.total_found, r.cached) for r in cold.totals.collect()} == {(0, 2, False), (1, 2, False), (2, 0, False), (3, 3, False)}
    cache = merged(empty, cold.new)
    assert cache.header.count() == 2  # equal keys share an entry; nothing found stores nothing
    assert cache.records.count() == 2 and cache.header.where("blank").count() == 1  # a blank query is a marker only
    one = SearchParams(limit=1)
    warm = search_cached(queries, index, cache, at("2024-01-01 00:59:59"), one)
    assert {(r.query_id, r.page_id, r.total_found, r.cached) for r in warm.results.collect()} == {
        (0, 1, 2, True), (1, 1, 2, True), (3, 1, 3, True)
    }
    assert warm.new.header.isEmpty()
    late = search_cached(queries, index, cache, at("2024-01-01 01:00:00"))
    assert not late.results.where("cached").count()


def test_cached_results_are_those_of_their_time(spark, index):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    queries = ask(spark, "kayak")
    few = SearchParams(limit=1, cache_rows=1)
    cache = search_cached(queries, index, empty_cache(spark), at("2024-01-01 00:00:00"), few).new
    gone = ix.Index(index.docs.where("page_id <> 1"), index.vocab, index.postings.where("page_id <> 1"), index.params)
    [hit] = search_cached(queries, gone, cache, at("2024-01-01 00:10:00"), few).results.collect()
    assert (hit.page_id, hit.url, hit.title, hit.total_found, hit.cached) == (1, PAGES[0][1], "Kayak Lessons", 2, True)
    # More rows than the entry holds are searched for anew.
    more = search_cached(queries, gone, cache, at("2024-01-01 00:10:00"), SearchParams(limit=2, cache_rows=1))
    assert [(r.page_id, r.cached) for r in more.results.collect()] == [(2, False)]
    assert [r.total_found for r in merged(cache, more.new).header.collect()] == [1]


def test_result_page_clamps(spark):
    rows = [(1, i, f"d{i % 2}") for i in range(1, 8)]
    results = spark.createDataFrame(rows, "query_id long, rank int, domain string")
    last = se.result_page(results, size=3, page=9).collect()
    assert [(r.rank, r.pages) for r in last] == [(7, 3)]
    odd = se.result_page(results, size=3, page=2, domain="d1").collect()
    assert [(r.rank, r.pages) for r in odd] == [(7, 2)]
