"""SQL that states what each query of ``checks.queries`` must return.

Written independently of the Spark code: sequential element removal instead of
one alternation, list functions instead of expressions, window functions
instead of in-row counting, unrolled levels instead of a loop. Common table
expressions are included where a query names them.
"""

from __future__ import annotations

import re

from checks.views import BATCH_QUERY_BASE, DERIVED_LINK_BASE, LITERAL_QUERIES
from pagewright.params import default_stop_words

_WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NL = r"\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
_WORD = r"[\p{L}\p{N}_]{2,}"


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _remove(expr: str, *tags: str) -> str:
    for tag in tags:
        expr = f"regexp_replace({expr}, '(?is)<{tag}(?:[\\s/][^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    return expr


def _decode(expr: str) -> str:
    names = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"),
             ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    for name, char in names:
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def _domain(url: str) -> str:
    host = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    return f"regexp_replace({host}, '^www\\.', '')"


def _clean(expr: str) -> str:
    collapsed = _strip(f"regexp_replace({expr}, '[{_WS}]+', ' ', 'g')")
    return f"lower(regexp_replace({collapsed}, '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g'))"


def _key(query: str, domain: str) -> str:
    return f"md5({_strip(f'lower({query})')} || '|' || coalesce(nullif({domain}, ''), 'all'))"


def _snippet(expr: str) -> str:
    return f"CASE WHEN length({expr}) > 200 THEN substring({expr}, 1, 200) || '...' ELSE {expr} END"


def _one_decimal(expr: str) -> str:
    # printf rounds the exact value, but halves to even; exact halves are odd quarters.
    half = f"(({expr}) * 4 = floor(({expr}) * 4) AND floor(({expr}) * 4)::BIGINT % 2 = 1)"
    return f"printf('%.1f', CASE WHEN {half} THEN ({expr}) + 0.001 ELSE ({expr}) END)"


_ISO = (
    "strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
    "CASE WHEN strftime({ts}, '%f') = '000000' THEN '' ELSE '.' || strftime({ts}, '%f') END"
)
_AS_OF = "(SELECT max(ts) + INTERVAL 30 MINUTE FROM events)"
_NOW = "TIMESTAMP '2024-06-01 00:00:00'"
_LITERALS = ", ".join(f"({i}, {_quote(q)}, {_quote(d)})" for i, q, d in LITERAL_QUERIES)
_STOP = ", ".join(f"({_quote(w)})" for w in default_stop_words())


def _index_ctes(p: str, docs: str) -> dict[str, str]:
    """TF-IDF over ``docs`` (page_id, url, title, content, domain)."""
    return {
        f"{p}words": f"""
            SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, w AS word
            FROM (SELECT page_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
                  FROM (SELECT page_id, regexp_extract_all({_clean("title || ' ' || title || ' ' || content")}, '{_WORD}') AS l
                        FROM {docs}))""",
        f"{p}kept": f"""
            SELECT page_id, word, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos
            FROM {p}words WHERE word NOT IN (SELECT w FROM stop_words)""",
        f"{p}ngrams": f"""
            SELECT page_id, pos, word AS term FROM {p}kept
            UNION ALL
            SELECT page_id, pos, word || ' ' || next FROM
              (SELECT *, lead(word) OVER (PARTITION BY page_id ORDER BY pos) AS next FROM {p}kept)
            WHERE next IS NOT NULL""",
        f"{p}tf": f"SELECT page_id, term, count(*) AS tf FROM {p}ngrams GROUP BY ALL",
        f"{p}df": f"""
            SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}tf GROUP BY term
            HAVING count(*) >= 1 AND count(*) <= 0.95 * (SELECT count(*) FROM {docs})""",
        f"{p}vocab": f"SELECT * FROM {p}df ORDER BY cf DESC, term LIMIT 10000",
        f"{p}idf": f"""
            SELECT *, ln((1 + (SELECT count(*) FROM {docs})) / (1 + df)) + 1 AS idf FROM {p}vocab""",
        f"{p}raw": f"SELECT page_id, term, tf, tf * idf AS w FROM {p}tf JOIN {p}idf USING (term)",
        f"{p}norm": f"SELECT page_id, sqrt(sum(w * w)) AS norm FROM {p}raw GROUP BY page_id",
        f"{p}postings": f"""
            SELECT r.page_id, d.domain, r.term, r.tf, r.w / n.norm AS weight
            FROM {p}raw r JOIN {p}norm n USING (page_id) JOIN {docs} d USING (page_id)""",
    }


def _search_ctes(p: str, docs: str, queries: str, idx: str) -> dict[str, str]:
    """Queries (query_id, query, domain_filter) against the index ``idx``."""
    return {
        f"{p}asked": f"""
            SELECT *, {_strip('query')} = '' AS blank,
                   coalesce(nullif(domain_filter, ''), 'all') AS key FROM {queries}""",
        f"{p}qtf": f"""
            SELECT query_id, key, term, count(*) AS tf FROM (
              WITH w AS (SELECT query_id, key, unnest(l) AS word, generate_subscripts(l, 1) AS i
                         FROM (SELECT query_id, key, regexp_extract_all({_clean('query')}, '{_WORD}') AS l
                               FROM {p}asked WHERE NOT blank)),
                   k AS (SELECT * FROM w WHERE word NOT IN (SELECT w FROM stop_words)),
                   b AS (SELECT *, lead(word) OVER (PARTITION BY query_id ORDER BY i) AS next FROM k)
              SELECT query_id, key, word AS term FROM k
              UNION ALL SELECT query_id, key, word || ' ' || next FROM b WHERE next IS NOT NULL)
            GROUP BY ALL""",
        f"{p}qv": f"""
            SELECT query_id, key, term, tf,
                   tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS weight
            FROM {p}qtf JOIN {idx}idf USING (term)""",
        f"{p}scores": f"""
            SELECT q.query_id, d.page_id, sum(d.weight * q.weight) AS score
            FROM {idx}postings d JOIN {p}qv q ON d.term = q.term AND (q.key = 'all' OR q.key = d.domain)
            GROUP BY ALL""",
        f"{p}hits": f"""
            SELECT query_id, page_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id DESC) AS rank
            FROM {p}scores WHERE score > 0.001
            UNION ALL
            SELECT query_id, page_id, 1.0::DOUBLE,
                   row_number() OVER (PARTITION BY query_id ORDER BY page_id)
            FROM {p}asked JOIN {docs} ON blank AND (key = 'all' OR key = domain)""",
        f"{p}totals": f"""
            SELECT query_id, coalesce(n, 0) AS total_found FROM {queries}
            LEFT JOIN (SELECT query_id, count(*) AS n FROM {p}hits GROUP BY 1) USING (query_id)""",
    }


def _level(n: int) -> str:
    seen = " UNION ALL ".join(f"SELECT url FROM level{i}" for i in range(n))
    return f"""
        SELECT url, {n} AS depth, min(path) AS path, arg_min(parent_url, path) AS parent_url
        FROM (SELECT l.link AS url, list_append(v.path, l.pos) AS path, v.url AS parent_url
              FROM level{n - 1} v JOIN pages p ON p.url = v.url JOIN graph_links l ON l.url = v.url)
        WHERE url NOT IN ({seen}) GROUP BY url"""


CTES: dict[str, str] = {
    "stop_words": f"SELECT * FROM (VALUES {_STOP}) t(w)",
    "crawl_pages": f"""
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS k,
               count(*) OVER (PARTITION BY domain) AS n,
               TIMESTAMP '2024-01-01' + to_seconds(page_id) AS crawl_time
        FROM (SELECT page_id, url, html, {_domain('url')} AS domain FROM pages)""",
    "edges": """
        SELECT f, t, f_url, t_url, row_number() OVER (PARTITION BY f ORDER BY t) AS pos
        FROM (SELECT DISTINCT a.page_id AS f, b.page_id AS t, a.url AS f_url, b.url AS t_url
              FROM crawl_pages a JOIN crawl_pages b
                ON a.domain = b.domain AND a.page_id <> b.page_id
               AND (b.k IN (3*a.k+1, 3*a.k+2, 3*a.k+3) OR b.k = (7*a.k+3) % a.n))""",
    "seeds": "SELECT url, page_id AS ord, domain FROM crawl_pages WHERE k = 0",
    "v_markup": f"""
        SELECT page_id, url,
          {_remove("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')", 'script', 'style')} AS markup
        FROM pages""",
    "v_body": f"""
        SELECT page_id, url, {_remove('markup', 'nav', 'header', 'footer', 'aside', 'template', 'rt', 'rp')} AS body
        FROM v_markup""",
    "titles": f"""
        SELECT page_id, url,
          CASE WHEN regexp_matches(markup, '(?i)<title[^>]*>')
               THEN {_strip(_decode("regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"))}
               ELSE 'No Title' END AS title FROM v_markup""",
    "texts": f"""
        SELECT page_id, url, {_decode("regexp_replace(body, '<[A-Za-z/!?][^>]*>', '', 'g')")} AS text FROM v_body""",
    "contents": f"""
        SELECT page_id, url, array_to_string(list_filter(list_transform(
                 string_split_regex(text, '[{_NL}]'), lambda x: {_strip('x')}), lambda x: x <> ''), ' ') AS content
        FROM texts""",
    "anchors": f"""
        SELECT page_id, url, i - 1 AS pos, {_decode("regexp_replace(v, '^[\"'']|[\"'']$', '', 'g')")} AS href
        FROM (SELECT page_id, url, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (
          SELECT page_id, url, regexp_extract_all(markup,
            '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1) AS l FROM v_markup))""",
    "resolved": """
        SELECT page_id, url, pos, href,
               regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(href, '#.*$', '') AS link
        FROM anchors WHERE href LIKE '/%'""",
    "outlinks": """
        SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS pos
        FROM resolved GROUP BY page_id, url, link""",
    "graph_links": f"""
        SELECT url, pos, link FROM outlinks
        UNION ALL SELECT f_url, pos + {DERIVED_LINK_BASE}, t_url FROM edges""",
    "level0": "SELECT url, 0 AS depth, [min(ord)] AS path, NULL::VARCHAR AS parent_url FROM seeds GROUP BY url",
    "level1": _level(1),
    "level2": _level(2),
    "level3": _level(3),
    "visited": " UNION ALL ".join(
        f"SELECT url, depth, path, parent_url FROM level{i}" for i in range(4)
    ),
    "reached": """
        SELECT v.*, p.page_id, row_number() OVER (ORDER BY depth, path) AS crawl_order
        FROM visited v JOIN pages p USING (url)""",
    "records": """
        SELECT r.page_id, r.url, t.title, c.content, g.domain, g.crawl_time, r.depth, r.parent_url,
               r.crawl_order
        FROM reached r JOIN titles t USING (page_id) JOIN contents c USING (page_id)
        JOIN crawl_pages g USING (page_id)""",
    "visits": f"""
        SELECT t AS page_id, t_url AS url, f_url AS parent_url, f * 10 + pos AS seq,
               {_NOW} + to_seconds(f * 10 + pos) AS crawl_time FROM edges""",
    "docs": """
        SELECT doc_id AS page_id, 'doc:' || doc_id AS url, substring(text, 1, 60) AS title,
               text AS content, source AS domain FROM documents""",
    "batch": f"""
        SELECT item_id + {BATCH_QUERY_BASE} AS query_id, text AS query,
               CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END AS domain_filter FROM benchmark""",
    "literals": f"SELECT query_id::BIGINT AS query_id, query, domain_filter FROM (VALUES {_LITERALS}) t(query_id, query, domain_filter)",
    "all_queries": "SELECT * FROM literals UNION ALL SELECT * FROM batch",
    "search_history": """
        SELECT event_id AS id,
               CASE WHEN user_id % 10 = 0 THEN '' ELSE 'query ' || (user_id % 50) END AS query,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'example.com' END AS domain_filter,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS results_count,
               value AS execution_time, event_type = 'view' AS cached, ts AS searched_at
        FROM events""",
    "search_cache": f"""
        SELECT {_key('query', 'domain_filter')} AS query_hash,
               query, domain_filter, results_count, searched_at AS created_at,
               searched_at + to_seconds(3600) AS expires_at
        FROM search_history
        QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY searched_at DESC, id DESC) = 1""",
    "crawls": f"""
        SELECT domain AS crawl_id, count(*) AS pages_crawled, min(crawl_time) AS start_time,
               CASE WHEN count(*) = 1 THEN 0 ELSE 20 END AS total_pages,
               count(*) > 1 AND count(*) < 5 AS is_crawling
        FROM crawl_pages GROUP BY domain""",
    "replayed": """
        SELECT min(id) AS query_id, query, coalesce(domain_filter, 'all') AS domain_filter
        FROM search_history GROUP BY 2, 3""",
    "replayed_all": f"""
        SELECT min(id) AS query_id, query, coalesce(domain_filter, 'all') AS domain_filter
        FROM (SELECT id, query, domain_filter FROM search_history
              UNION ALL SELECT query_id + 1000000000, query, domain_filter FROM batch)
        GROUP BY query, coalesce(domain_filter, 'all')""",
    "source_blanks": """
        SELECT min(doc_id) + 100000 AS query_id, ' ' AS query, source AS domain_filter
        FROM documents GROUP BY source
        UNION ALL SELECT * FROM literals WHERE trim(query) = ''""",
    "root_queries": """
        SELECT page_id AS query_id, title AS query,
               CASE WHEN page_id % 2 = 0 THEN domain END AS domain_filter FROM records WHERE depth = 0
        UNION ALL SELECT -1, '', NULL""",
    "adjacent": """
        SELECT l.url, list(l.link ORDER BY l.pos) AS kids
        FROM graph_links l JOIN pages p ON p.url = l.link GROUP BY l.url""",
    "dfs_walk": """
        SELECT 0 AS step, list({'url': url, 'depth': 0, 'parent': NULL::VARCHAR} ORDER BY ord) AS stack,
               []::VARCHAR[] AS seen, NULL::VARCHAR AS url, 0 AS depth, NULL::VARCHAR AS parent_url, false AS fresh
        FROM seeds
        UNION ALL
        SELECT step + 1,
               CASE WHEN known OR top.depth >= 3 OR kids IS NULL THEN stack[2:]
                    ELSE list_concat(list_transform(kids, lambda k:
                           {'url': k, 'depth': top.depth + 1, 'parent': top.url}), stack[2:]) END,
               CASE WHEN known THEN seen ELSE list_append(seen, top.url) END,
               top.url, top.depth, top.parent, NOT known
        FROM (SELECT *, stack[1] AS top, list_contains(seen, stack[1].url) AS known
              FROM dfs_walk WHERE len(stack) > 0) d
        LEFT JOIN adjacent a ON a.url = d.top.url""",
    "dfs_reached": """
        SELECT url, depth, parent_url, row_number() OVER (ORDER BY step) AS crawl_order
        FROM dfs_walk WHERE fresh""",
    **_index_ctes("d_", "docs"),
    **_search_ctes("s_", "docs", "all_queries", "d_"),
    **_search_ctes("e_", "docs", "source_blanks", "d_"),
    **_search_ctes("h_", "docs", "replayed_all", "d_"),
    **_index_ctes("p_", "records"),
    **_search_ctes("r_", "records", "root_queries", "p_"),
    "routes": """
        SELECT r.page_id, CASE WHEN r.depth = 0 THEN r.url
                               WHEN r.depth = 1 THEN a.url || ' > ' || r.url
                               WHEN r.depth = 2 THEN b.url || ' > ' || a.url || ' > ' || r.url
                               ELSE c.url || ' > ' || b.url || ' > ' || a.url || ' > ' || r.url END AS route
        FROM reached r LEFT JOIN reached a ON a.url = r.parent_url
        LEFT JOIN reached b ON b.url = a.parent_url LEFT JOIN reached c ON c.url = b.parent_url""",
}
_NAME = re.compile(r"\b[a-z_][a-z_0-9]*\b")


def _needed(sql: str, found: list[str], inside: tuple[str, ...] = ()) -> None:
    for name in _NAME.findall(sql):
        if name in CTES and name not in found and name not in inside:
            _needed(CTES[name], found, (*inside, name))
            found.append(name)


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the views it names, in order of dependency."""
    names: list[str] = []
    _needed(sql, names)
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH RECURSIVE {parts}\n{sql}" if parts else sql


_RANKED = "SELECT query_id, rank, page_id, round(score, 6) AS score"
_DETAILS = f"""
    {_RANKED}, url, title, domain, {_snippet('content')} AS content_snippet
    FROM s_hits JOIN docs USING (page_id) WHERE rank <= 10"""
_STORED_PAGES = "SELECT * FROM crawl_pages WHERE k < n - 1 OR n = 1"

FINAL: dict[str, str] = {
    "scan_pages": "SELECT page_id, url, length(html) AS html_chars FROM pages",
    "scan_index_docs": "SELECT page_id, url, title, content, domain FROM docs",
    "extract_pages": f"""
        SELECT t.page_id, t.url, t.title, c.content, {_domain('t.url')} AS domain, 200 AS status_code,
               (SELECT count(*) FROM anchors a WHERE a.page_id = t.page_id) AS anchors,
               coalesce((SELECT string_agg(o.link, ' ' ORDER BY o.pos) FROM outlinks o WHERE o.page_id = t.page_id), '') AS links
        FROM titles t JOIN contents c USING (page_id)""",
    "page_defaults": """
        SELECT page_id, CASE WHEN page_id % 3 = 2 THEN title ELSE 'No Title' END AS title,
               CASE WHEN page_id % 3 = 1 THEN length(page_id::VARCHAR)
                    WHEN page_id % 3 = 2 AND title <> 'No Title' THEN length(title) ELSE 0 END AS content_chars
        FROM titles""",
    "upsert_pages": f"""
        WITH stored AS ({_STORED_PAGES}),
             last AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)
        SELECT page_id, url, 'stored' AS title, '' AS content, domain, crawl_time, 0 AS depth, NULL AS parent_url,
               200 AS status_code, crawl_time AS created_at, crawl_time AS updated_at
        FROM stored WHERE url NOT IN (SELECT url FROM last)
        UNION ALL
        SELECT l.page_id, l.url, 'visit ' || l.seq, 'seen', {_domain('l.url')}, l.crawl_time, 1, l.parent_url, 200,
               coalesce(s.crawl_time, {_NOW}), {_NOW}
        FROM last l LEFT JOIN stored s USING (url)""",
    "page_links": "SELECT DISTINCT f AS from_page_id, t AS to_page_id FROM edges",
    "export_pages": "SELECT url, title, content, domain, crawl_time, depth, parent_url FROM records",
    "history_append": f"""
        SELECT * FROM search_history
        UNION ALL SELECT query_id + 1000000000, query, domain_filter, 0, 1.5::DOUBLE, false, {_NOW} FROM all_queries""",
    "cache_upsert": "SELECT * FROM search_cache",
    "backfill_domain": f"SELECT page_id, url, {_domain('url')} AS domain FROM pages",
    "parse_seed_list": """
        SELECT ord AS list_id, 0::BIGINT AS ord, url AS line FROM seeds
        UNION ALL SELECT ord, 1, upper(url) || ' ' FROM seeds""",
    "extract_domain": f"SELECT page_id, {_domain('url')} AS domain FROM pages",
    "valid_url": """
        SELECT page_id, pos, regexp_matches(href, '(?i)^https?://[^/?#]+') AS href_valid,
               regexp_matches(url, '(?i)^https?://[^/?#]+') AS url_valid FROM anchors""",
    "allowed_domain_filter": f"""
        SELECT page_id, url FROM crawl_pages p
        WHERE domain = 'example.org' OR domain LIKE '%.example.org' OR EXISTS (
          SELECT 1 FROM seeds s WHERE s.url LIKE '%.example.net/%'
          AND (p.domain = s.domain OR ends_with(p.domain, '.' || s.domain)))""",
    "extract_anchors": "SELECT page_id, pos, href FROM anchors",
    "resolve_links": "SELECT page_id, pos, href, link FROM resolved",
    "canonical_url": r"""
        SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''),
                 '^([^?#]*/[^/?#;]*);[^/?#]*', '\1') AS canonical FROM pages""",
    "page_outlinks": "SELECT page_id, pos, link FROM outlinks",
    "page_title": "SELECT page_id, title FROM titles",
    "strip_boilerplate": "SELECT page_id, body FROM v_body",
    "page_text": "SELECT page_id, text FROM texts",
    "page_content": "SELECT page_id, content FROM contents",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "weighted_text": "SELECT page_id, title || ' ' || title || ' ' || content AS weighted FROM docs",
    "snippet": f"SELECT page_id, {_snippet('content')} AS content_snippet FROM docs",
    "cache_key": f"""
        SELECT id, query, {_key('query', 'domain_filter')} AS query_hash FROM (
          SELECT id, query, domain_filter FROM search_history
          UNION ALL SELECT query_id, query, domain_filter FROM all_queries)""",
    "results_json": f"SELECT query_id, rank, url, title, domain, content_snippet FROM ({_DETAILS})",
    "iso_time": f"SELECT event_id, {_ISO.format(ts='ts')} AS iso FROM events",
    "score_percent": f"""
        SELECT event_id, {_one_decimal('(value / 1000 * 100)')} || '%' AS percent,
               {_one_decimal('value')} || 'ms' AS ms FROM events""",
    "display_domain": r"""
        SELECT page_id, regexp_replace(lower(regexp_extract(url,
                 '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), 'www\.', '') AS domain FROM pages""",
    "tokens": "SELECT page_id, pos, word FROM d_words",
    "tokens_no_stop": "SELECT page_id, pos, word FROM d_kept",
    "ngrams": "SELECT page_id, pos, term FROM d_ngrams",
    "term_freq": "SELECT page_id, term, tf FROM d_tf",
    "doc_freq": "SELECT term, df, cf FROM d_df",
    "vocabulary": "SELECT term, df, cf FROM d_vocab",
    "vocabulary_pruned": "SELECT term, df, cf FROM d_vocab",
    "idf": "SELECT term, df, round(idf, 6) AS idf FROM d_idf",
    "tfidf_postings": "SELECT page_id, domain, term, tf, round(weight, 6) AS weight FROM d_postings",
    "index_summary": """
        SELECT 'documents' AS metric, count(*) AS value FROM docs
        UNION ALL SELECT 'terms', count(*) FROM d_vocab
        UNION ALL SELECT 'postings', count(*) FROM d_raw""",
    "index_size": "SELECT count(*) AS index_size FROM d_vocab",
    "query_vectors": "SELECT query_id, term, tf, round(weight, 6) AS weight FROM s_qv",
    "cosine_scores": "SELECT query_id, page_id, round(score, 6) AS score FROM s_scores",
    "search": _DETAILS,
    "search_stored_index": _DETAILS,
    "total_found": "SELECT query_id, total_found FROM s_totals",
    "search_domain": f"""
        {_RANKED} FROM s_hits JOIN all_queries USING (query_id)
        WHERE rank <= 10 AND coalesce(domain_filter, '') NOT IN ('', 'all')""",
    "search_empty": f"{_RANKED} FROM e_hits WHERE rank <= 50",
    "search_no_match": "SELECT query_id, total_found FROM s_totals WHERE total_found = 0",
    "search_results": f"""
        {_RANKED}, r.url, title, domain, {_snippet('content')} AS content_snippet, route,
        crawl_time AS last_crawled
        FROM r_hits JOIN records r USING (page_id) JOIN routes USING (page_id) WHERE rank <= 10""",
    "seed_frontier": "SELECT url, 0 AS depth, NULL::VARCHAR AS parent_url, ord FROM seeds",
    "bfs_depths": "SELECT url, depth FROM reached",
    "bfs_visited": """
        SELECT url, depth, url IN (SELECT url FROM pages) AS fetched FROM visited""",
    "bfs_parents": "SELECT url, depth, parent_url, crawl_order FROM reached",
    "bfs_budget": "SELECT url, depth, parent_url, crawl_order FROM reached WHERE crawl_order <= 100",
    "page_routes": "SELECT page_id, route FROM routes",
    "dfs_crawl": "SELECT url, depth, parent_url, crawl_order FROM dfs_reached",
    "coverage_compare": """
        SELECT count(b.url) FILTER (d.url IS NOT NULL) AS both,
               count(b.url) FILTER (d.url IS NULL) AS bfs_only,
               count(d.url) FILTER (b.url IS NULL) AS dfs_only
        FROM (SELECT url FROM reached) b
        FULL JOIN dfs_reached d ON b.url = d.url""",
    "dfs_tree_order": "SELECT url, depth, row_number() OVER (ORDER BY path) AS visit FROM reached",
    "crawl_status": f"""
        SELECT crawl_id, CASE WHEN is_crawling THEN 'crawling' ELSE 'completed' END AS status,
               pages_crawled, total_pages::BIGINT AS total_pages, round(p, 6) AS progress_percentage,
               {_one_decimal('p')} || '%' AS progress_label
        FROM (SELECT *, CASE WHEN total_pages > 0 THEN pages_crawled * 100.0::DOUBLE / total_pages ELSE 0 END AS p
              FROM crawls)""",
    "crawl_eta": """
        SELECT crawl_id, start_time, CASE WHEN is_crawling AND pages_crawled > 0 THEN
          start_time + to_microseconds(CAST(round(
            (epoch_us(TIMESTAMP '2024-01-01 03:00:00') - epoch_us(start_time)) / pages_crawled * total_pages) AS BIGINT))
          END AS estimated_completion FROM crawls""",
    "crawl": f"""
        SELECT page_id, url, title, content, domain, crawl_time, depth, parent_url, 200 AS status_code,
               {_NOW} AS created_at,
               CASE WHEN crawl_order <= 100 THEN TIMESTAMP '2024-06-02 00:00:00' ELSE {_NOW} END AS updated_at
        FROM records""",
    "depth_histogram": "SELECT depth, count(*) AS pages FROM reached GROUP BY depth",
    "recommend_traversal": """
        SELECT *, CASE WHEN memory = 'low' THEN 'DFS'
                       WHEN website_type = 'hierarchical' AND content_depth = 'shallow' THEN 'BFS'
                       WHEN website_type = 'interconnected' AND content_depth = 'deep' THEN 'DFS'
                       WHEN website_type = 'catalog' THEN 'BFS'
                       WHEN website_type = 'documentation' THEN 'DFS' ELSE 'BFS' END AS algorithm
        FROM (SELECT domain,
                ['catalog', 'documentation', 'hierarchical', 'interconnected', 'other'][count(*) % 5 + 1] AS website_type,
                CASE WHEN length(domain) % 2 = 0 THEN 'deep' ELSE 'shallow' END AS content_depth,
                CASE WHEN count(*) > 8 THEN 'low' ELSE 'high' END AS memory
              FROM crawl_pages GROUP BY domain)""",
    "frontier_width": """
        SELECT max(c) AS max_width FROM (SELECT count(*) AS c FROM reached GROUP BY depth)""",
    "cache_lookup": f"""
        SELECT q.query_id, q.query_hash, c.expires_at IS NOT NULL AS cached, c.expires_at
        FROM (SELECT *, {_key('query', 'domain_filter')} AS query_hash
              FROM (SELECT * FROM all_queries UNION ALL SELECT * FROM replayed)) q
        LEFT JOIN search_cache c ON c.query_hash = q.query_hash AND c.expires_at > {_AS_OF}""",
    "search_cached": f"""
        {_RANKED}, d.url, d.title, d.domain, {_snippet('content')} AS content_snippet, total_found, {_key('query', 'domain_filter')} IN (
          SELECT {_key('b.query', 'b.domain_filter')} FROM batch b) AS cached
        FROM s_hits JOIN s_totals USING (query_id) JOIN all_queries USING (query_id) JOIN docs d USING (page_id)
        WHERE rank <= 10""",
    "cache_purge": f"SELECT * FROM search_cache WHERE expires_at > {_AS_OF}",
    "cache_clear": """
        SELECT 'left' AS metric, 0::BIGINT AS value
        UNION ALL SELECT 'deleted', count(*) FROM search_cache""",
    "history_view": f"""
        SELECT *, coalesce(nullif(query, ''), '(empty query)') AS query_label,
               {_one_decimal('execution_time')} || 'ms' AS time_label
        FROM search_history ORDER BY searched_at DESC, id DESC LIMIT 50""",
    "history_delete": "SELECT * FROM search_history WHERE query <> ''",
    "stats_counts": f"""
        SELECT 'total_pages' AS metric, count(*) AS value FROM pages
        UNION ALL SELECT 'total_searches', count(*) FROM search_history
        UNION ALL SELECT 'cached_queries', count(*) FROM search_cache WHERE expires_at > {_AS_OF}""",
    "domains": "SELECT DISTINCT domain FROM crawl_pages",
    "domain_stats": "SELECT domain, count(*) AS pages FROM crawl_pages GROUP BY domain",
    "stats": f"""
        SELECT 'total_pages' AS metric, '' AS key, count(*)::VARCHAR AS value FROM pages
        UNION ALL SELECT 'total_searches', '', count(*)::VARCHAR FROM search_history
        UNION ALL SELECT 'cached_queries', '', count(*)::VARCHAR FROM search_cache WHERE expires_at > {_AS_OF}
        UNION ALL SELECT 'last_crawl', '', {_ISO.format(ts='max(crawl_time)')} FROM crawl_pages
        UNION ALL SELECT 'index_size', '', count(*)::VARCHAR FROM d_vocab
        UNION ALL SELECT 'crawl_status', '', CASE WHEN bool_or(is_crawling) THEN 'crawling'
          WHEN sum(pages_crawled) > 0 THEN 'completed' ELSE 'idle' END FROM crawls
        UNION ALL SELECT DISTINCT 'domains', domain, domain FROM crawl_pages
        UNION ALL SELECT 'domain_stats', domain, count(*)::VARCHAR FROM crawl_pages GROUP BY domain""",
    "result_page": f"""
        WITH f AS (SELECT h.*, d.url, d.domain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position,
                          count(*) OVER (PARTITION BY query_id) AS c
                   FROM s_hits h JOIN docs d USING (page_id) WHERE rank <= 100)
        SELECT query_id, rank, page_id, round(score, 6) AS score, url, domain, position,
               CAST(ceil(c / 5) AS BIGINT) AS pages
        FROM f WHERE ceil(position / 5) = least(3, ceil(c / 5))""",
    "page_by_url": "SELECT page_id, url FROM pages WHERE url IN (SELECT t_url FROM edges)",
    "result_page_domain": """
        WITH f AS (SELECT h.*, d.url, d.domain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position,
                          count(*) OVER (PARTITION BY query_id) AS c
                   FROM s_hits h JOIN docs d USING (page_id) WHERE rank <= 100 AND d.domain = 'src1')
        SELECT query_id, rank, page_id, round(score, 6) AS score, url, domain, position,
               CAST(ceil(c / 5) AS BIGINT) AS pages
        FROM f WHERE position <= 5""",
    "search_stored_domain": """
        SELECT query_id, total_found FROM s_totals JOIN all_queries USING (query_id) WHERE domain_filter IN ('src1', 'all')""",
    "replay_history": f"{_RANKED} FROM h_hits WHERE rank <= 10",
}


def oracle_sql() -> dict[str, str]:
    return {name: _compose(sql) for name, sql in FINAL.items()}


def _compose(sql: str) -> str:
    full = with_ctes(sql.strip())
    # A query with a WITH clause of its own continues the list of views.
    return full.replace("\nWITH ", ",\n", 1) if sql.strip().startswith("WITH ") else full
