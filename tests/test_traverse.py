import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagewright.operators import routes, traverse
from pagewright.operators.dfs import crawl_dfs
from pagewright.operators.ordinals import global_ordinal, ordinal_in_group
from pagewright.operators.routes import page_routes
from pagewright.params import CrawlParams
from pagewright.plans.crawl import crawl, store_crawl
from pagewright.session import bucketed, materialize

ROOT = "https://example.com"
SITES = {
    "tree": (
        {"": ["crete", "malta"], "crete": ["crete/ports", "crete/towns"], "malta": ["malta/ports"],
         "crete/ports": [], "crete/towns": [], "malta/ports": []},
        ["", "crete", "malta", "crete/ports", "crete/towns", "malta/ports"],
        ["", "crete", "crete/ports", "crete/towns", "malta", "malta/ports"],
    ),
    "levels": (
        {"": ["north", "south"], "north": ["fjord"], "south": ["dunes"],
         "fjord": [], "dunes": []},
        ["", "north", "south", "fjord", "dunes"],
        ["", "north", "fjord", "south", "dunes"],
    ),
    "star": ({"": ["crete", "malta"], "crete": [], "malta": []}, ["", "crete", "malta"], ["", "crete", "malta"]),
    "chain": ({"": ["crete"], "crete": []}, ["", "crete"], ["", "crete"]),
}


def url(name):
    return f"{ROOT}/{name}" if name else ROOT


def frames(spark, seeds, site):
    """seeds, corpus, links of a dictionary of pages to link lists."""
    rows = [(u, p, link) for u, out in site.items() for p, link in enumerate(out)]
    return (
        spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "url string, ord long"),
        spark.createDataFrame([(u,) for u in site], "url string"),
        spark.createDataFrame(rows, "url string, pos int, link string"),
    )


def queue_crawl(seeds, site, max_pages, max_depth):
    queue, seen, out = deque((s, 0, None) for s in seeds), set(), []
    while queue and len(out) < max_pages:
        u, depth, parent = queue.popleft()
        if u in seen or depth > max_depth:
            continue
        seen.add(u)
        if u in site:
            out.append((u, depth, parent))
            if depth < max_depth:
                queue.extend((x, depth + 1, u) for x in site[u] if x not in seen)
    return out


def recursive_crawl(seeds, site, max_pages, max_depth):
    seen, out = set(), []

    def visit(u, depth, parent):
        if len(out) >= max_pages or depth > max_depth or u in seen:
            return
        seen.add(u)
        if u in site:
            out.append((u, depth, parent))
            for x in site[u]:
                visit(x, depth + 1, u)

    for s in seeds:
        visit(s, 0, None)
    return out


def rows(crawled):
    return [(r.url, r.depth, r.parent_url) for r in crawled.orderBy("crawl_order").collect()]


@pytest.mark.parametrize("name", SITES)
def test_mock_sites(spark, name):
    links, bfs_order, dfs_order = SITES[name]
    site = {url(k): [url(v) for v in vs] for k, vs in links.items()}
    params = CrawlParams(max_pages=10, max_depth=2, allowed_domains=("example.com",))
    parts = frames(spark, [ROOT], site)
    assert [r[0] for r in rows(traverse.crawl_bfs(*parts, params))] == [url(n) for n in bfs_order]
    assert [r[0] for r in rows(crawl_dfs(*parts, params))] == [url(n) for n in dfs_order]


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs_match_queue_and_recursion(spark, seed):
    rng = random.Random(seed)
    names = [f"http://s{i % 3}.x/{i}" for i in range(40)]
    site = {
        n: list(dict.fromkeys(rng.choice([*names, "http://gone.x/1"]) for _ in range(rng.randint(0, 5))))
        for n in names
    }
    seeds = [names[3], "http://gone.x/seed", names[0], names[3], names[17]]
    parts = frames(spark, seeds, site)
    for max_pages, max_depth in ((1000, 3), (12, 3), (7, 1), (25, 6)):
        params = CrawlParams(max_pages=max_pages, max_depth=max_depth)
        assert rows(traverse.crawl_bfs(*parts, params)) == queue_crawl(seeds, site, max_pages, max_depth)
        assert rows(crawl_dfs(*parts, params)) == recursive_crawl(seeds, site, max_pages, max_depth)


def test_sites_walked_side_by_side(spark):
    rng = random.Random(9)
    site = {}
    for s in range(3):
        names = [f"http://s{s}.x/{i}" for i in range(15)]
        site |= {n: [rng.choice(names) for _ in range(3)] for n in names}
        site = {n: list(dict.fromkeys(out)) for n, out in site.items()}
    seeds = ["http://s1.x/0", "http://s0.x/3", "http://s2.x/1", "http://s1.x/7"]
    parts = frames(spark, seeds, site)
    for budget in (5, 30, 100):
        params = CrawlParams(max_pages=budget, max_depth=4)
        got = rows(crawl_dfs(*parts, params, links_stay_in_site=True))
        assert got == recursive_crawl(seeds, site, budget, 4)


def test_visited_covers_failures_and_budget_stops_early(spark):
    parts = frames(spark, ["http://a.x"], {"http://a.x": ["http://b.x", "http://c.x"], "http://b.x": []})
    seen = traverse.bfs(*parts, CrawlParams(max_pages=None))
    assert {(r.url, r.depth, r.fetched) for r in seen.collect()} == {
        ("http://a.x", 0, True), ("http://b.x", 1, True), ("http://c.x", 1, False)
    }
    assert traverse.bfs(*parts, CrawlParams(max_pages=1)).count() == 1


def test_unbounded_crawl_is_numbered(spark):
    site = {f"http://a.x/{i}": [f"http://a.x/{2 * i + 1}", f"http://a.x/{2 * i + 2}"] for i in range(31)}
    parts = frames(spark, ["http://a.x/0"], site)
    got = traverse.crawl_bfs(*parts, CrawlParams(max_pages=None, max_depth=9))
    assert [r[0] for r in rows(got)] == [f"http://a.x/{i}" for i in range(31)]
    assert sorted(r.crawl_order for r in got.collect()) == list(range(1, 32))
    assert crawl_dfs(*parts, CrawlParams(max_depth=9)).count() == 31


def test_repeated_links_take_no_budget(spark):
    parts = frames(spark, ["http://a.x/"], {"http://a.x/": ["http://a.x/a"] * 3 + ["http://a.x/b"], "http://a.x/a": [], "http://a.x/b": []})
    for walk in (traverse.crawl_bfs, crawl_dfs):
        assert [r[0] for r in rows(walk(*parts, CrawlParams(max_pages=3)))] == ["http://a.x/", "http://a.x/a", "http://a.x/b"]


def test_routes(spark):
    pages = [
        (1, "p1", "A", None), (2, "p2", "B", "p1"), (3, "p3", "C", "p2"), (4, "p4", "D", "gone"),
        (5, "c1", "E", "c2"), (6, "c2", "F", "c1"), (7, "s", "G", "s"), (8, "p8", "H", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, title string, parent_url string")
    got = {r.page_id: [s.url for s in r.route] for r in page_routes(df).collect()}
    assert got == {
        1: ["p1"], 2: ["p1", "p2"], 3: ["p1", "p2", "p3"], 4: ["p4"],
        5: ["c2", "c1"], 6: ["c1", "c2"], 7: ["s"], 8: ["p8"],
    }
    wanted = spark.createDataFrame([(3,)], "page_id long")
    [row] = page_routes(df, wanted).collect()
    assert [s.title for s in row.route] == ["A", "B", "C"]


def test_long_routes_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(routes, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    pages = spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("p"), "id").alias("url"), F.lit("t").alias("title"),
        F.when(F.col("id") > 0, F.concat(F.lit("p"), F.col("id") - 1)).alias("parent_url"))
    [row] = page_routes(pages, spark.createDataFrame([(2999,)], "page_id long")).collect()
    assert [s.url for s in row.route] == [f"p{i}" for i in range(3000)]
    assert len([r for r in rounds if r.startswith("ways")]) <= 14


def test_levels_move_neither_links_nor_urls(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(traverse, "bucketed", lambda df, key, label: plans.append(
        (label, df._jdf.queryExecution().executedPlan().toString())) or bucketed(df, key, label))
    site = {f"http://a.x/{i}": [f"http://a.x/{2 * i + 1}", f"http://a.x/{2 * i + 2}"] for i in range(31)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert traverse.bfs(*frames(spark, ["http://a.x/0"], site), CrawlParams(max_depth=3)).count() == 15
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Only the links found at a level are exchanged, once.
    assert [plan.count("Exchange hashpartitioning") for label, plan in plans if label.startswith("bfs-level")][1:] == [1, 1, 1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagewright_bfs")]


def test_ordinals(spark):
    df = spark.range(1000).select((F.col("id") % 7 % 3).alias("g"), (F.col("id") * 13).alias("v"))
    got = {}
    for r in ordinal_in_group(df, "g", "v", "k", width=50).collect():
        got.setdefault(r.g, []).append((r.v, r.k, r.n))
    for group in got.values():
        group.sort()
        assert [k for _, k, _ in group] == list(range(len(group)))
        assert {n for _, _, n in group} == {len(group)}
    placed = global_ordinal(df, [F.desc("v")], "o").orderBy("o").collect()
    assert [r.o for r in placed] == list(range(1, 1001))
    assert [r.v for r in placed] == sorted((r.v for r in placed), reverse=True)


def test_recommendations_and_widths(spark):
    cases = [
        ("catalog", "shallow", "high", "BFS"), ("documentation", "deep", "high", "DFS"),
        ("hierarchical", "shallow", "high", "BFS"), ("any", "any", "low", "DFS"),
        ("interconnected", "deep", "high", "DFS"), ("interconnected", "shallow", "high", "BFS"),
    ]
    df = spark.createDataFrame(cases, "website_type string, content_depth string, memory string, want string")
    assert all(r.want == r.algorithm for r in traverse.recommend(df).collect())
    depths = spark.createDataFrame([(0,), (1,), (1,), (2,)], "depth int")
    assert traverse.frontier_width(depths).first()[0] == 2


def test_crawl_job_dispatches_and_stores(spark, tmp_path):
    html = {
        "http://a.x/": "<title>Root</title><a href='/one'>1</a><a href='/two'>2</a>",
        "http://a.x/one": "<title>One</title><a href='three'>3</a><p>first</p>",
        "http://a.x/two": "<title>Two</title>",
        "http://a.x/three": "<title>Three</title>",
    }
    raw = spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate(html.items())], "page_id long, url string, html string"
    )
    seeds = spark.createDataFrame([("http://a.x/", 0)], "url string, ord long")
    now = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz")
    for algorithm, order in (("DFS", ["Root", "One", "Three", "Two"]), ("bfs", ["Root", "One", "Two", "Three"])):
        params = CrawlParams(algorithm=algorithm)
        found = crawl(seeds, raw, params)
        assert [r.title for r in found.orderBy("crawl_order").collect()] == order
    table = str(tmp_path / "pages")
    store_crawl(crawl(seeds, raw, CrawlParams(max_pages=2)), table, now(1))
    first = {r.url: r.page_id for r in store_crawl(crawl(seeds, raw, CrawlParams()), table, now(2)).collect()}
    again = store_crawl(crawl(seeds, raw, CrawlParams()), table, now(2))
    rows_again = again.collect()
    assert {r.url: r.page_id for r in rows_again} == first and len(first) == 4
    assert sorted(str(r.created_at)[:10] for r in rows_again) == ["2024-01-01"] * 2 + ["2024-01-02"] * 2
