"""Term counts and weights of Arrow batches, against counts of plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.functions import counts
from pagewright.operators import index as ix
from pagewright.operators import search as se
from pagewright.params import IndexParams, SearchParams

SCHEMA = "page_id long, domain string, words array<string>"
ROWS = [
    (1, "a", ["x", "y", "x", "y", "für"]), (1, "a", ["x", "y", "x", "y", "für"]), (None, None, ["y", "z"]),
    (2, "b", []), (3, "b", None), (4, None, ["z"]), (5, "c", ["x", "y"] * 40),
]


def plain(words):
    words = words or []
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[1, 6, 1 << 19])
def rows(spark, request, monkeypatch):
    monkeypatch.setattr(counts, "_WORDS", request.param)
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def test_rows_and_arrays_of_counts(rows):
    expected = Counter((p, d, t, n) for p, d, words in ROWS for t, n in plain(words).items())
    assert Counter(tuple(r) for r in counts.term_rows(rows, "page_id", "domain").collect()) == expected
    arrays = counts.term_arrays(rows, "page_id", "domain").collect()
    assert len(arrays) == len(ROWS)
    assert Counter((r.page_id, r.domain, c.term, c.tf) for r in arrays for c in r.counts) == expected


def test_document_counts(rows):
    df, cf = Counter(), Counter()
    for _, _, words in ROWS:
        df.update(plain(words).keys())
        cf.update(plain(words))
    assert {r.term: (r.df, r.cf) for r in counts.document_counts(rows).collect()} == {t: (df[t], cf[t]) for t in cf}
    xy = counts.document_counts(rows, singles=False, holds=lambda word: word in "xy").collect()
    assert {r.term: (r.df, r.cf) for r in xy} == {"x y": (3, cf["x y"]), "y x": (3, cf["y x"])}


def test_weights_of_known_terms(rows):
    idf = {"x": 1.5, "x y": 2.0, "y z": 0.5, "other x": 9.0}
    expected = []
    for p, d, words in ROWS:
        known = {t: n for t, n in plain(words).items() if t in idf}
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in known.items()))
        expected += [(p, d, t, n, round(n * idf[t] / norm, 9)) for t, n in known.items()]
    got = counts.weighed_rows(rows, idf, "page_id", "domain").withColumn("weight", F.round("weight", 9)).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert counts.weighed_rows(rows, {}, "page_id").isEmpty()


def test_bit_filter_keeps_its_words(spark):
    words = spark.createDataFrame([(f"wört{i}",) for i in range(500)], "term string")
    holds = ix._word_filter(words)
    assert all(holds(f"wört{i}") for i in range(500))
    assert sum(holds(f"other{i}") for i in range(500)) < 50


def test_pages_are_counted_and_weighed_without_sorting_arrays(spark, monkeypatch):
    pages = spark.createDataFrame(
        [(i, f"u{i}", f"title{i % 5}", f"text word{i % 7} more{i % 3}", "d") for i in range(40)],
        "page_id long, url string, title string, content string, domain string")
    index = ix.build_index(pages, IndexParams(max_features=30))
    for df in (ix.term_freq(pages, index.params), ix.doc_freq(pages, index.params), index.postings):
        assert "array_sort" not in plan(df) and "sort_array" not in plan(df) and "MapInArrow" in plan(df)
    assert "regexp" not in plan(index.postings) and "split(" not in plan(index.postings)  # text is cut into words once


def test_scores_do_not_move_postings_to_query_terms(spark):
    rows = [(i, f"u{i}", f"title{i % 5}", f"text word{i % 7} more{i % 3}", "d") for i in range(40)]
    index = ix.build_index(spark.createDataFrame(rows, "page_id long, url string, title string, content string, domain string"))
    queries = spark.createDataFrame([(1, "title1 word2", None), (2, "more1", "d")], "query_id long, query string, domain_filter string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        scores = se.cosine_scores(index.postings, se.query_vectors(queries, index))
        assert "SortMergeJoin" not in plan(scores) and scores.count() > 10
        hits = plan(se.keyword_hits(queries, index, SearchParams()))
        assert hits.count("MapInArrow") == 1  # one pass serves the queries of all domains and of one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
