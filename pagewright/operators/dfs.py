"""Depth-first traversal of a page corpus.

Which pages a depth-capped depth-first crawl reaches depends on each decision
before it, so one crawl cannot be split up: a site is one walk, in one task, and
so is a crawl whose links leave their sites. Use breadth-first crawls at scale.
The job does not ship whole sites. It loads the links of pages as the walk asks for them: each round runs the
walk over what is loaded, treats pages not loaded yet as having no links, and
fetches the links of those with one distributed join. The walk is final when it
asks for nothing. Sites are walked in parallel.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import extract_domain, in_allowed_domains, is_web_url
from pagewright.operators.traverse import cut_to_budget
from pagewright.params import CrawlParams
from pagewright.session import materialize

_WALK_SCHEMA = "site string, url string, depth int, parent_url string, ord long, step long, asks boolean"


def _walk(seeds, children, max_pages, max_depth):
    """Pre-order rows (url, depth, parent, ord, asks) of the known pages."""
    seen: set[str] = set()
    rows = []
    for order, seed in seeds:
        stack = [(seed, 0, None)]
        while stack and len(rows) < max_pages:
            url, depth, parent = stack.pop()
            if url in seen:
                continue
            seen.add(url)
            below = children.get(url)
            rows.append((url, depth, parent, order, depth < max_depth and below is None))
            if depth < max_depth and below is not None:
                stack.extend((child, depth + 1, url) for child in reversed(below))
    return rows


def _walk_sites(max_pages: int, max_depth: int):
    def walk_site(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds = pdf[pdf["ord"].notna()].sort_values("ord")
        loaded = pdf[pdf["children"].notna()]
        rows = _walk(
            list(zip(seeds["ord"].astype("int64"), seeds["url"])),
            {url: list(kids) for url, kids in zip(loaded["url"], loaded["children"])},
            max_pages,
            max_depth,
        )
        out = pd.DataFrame(rows, columns=["url", "depth", "parent_url", "ord", "asks"])
        out["site"] = pdf["site"].iloc[0]
        out["step"] = range(len(out))
        return out[["site", "url", "depth", "parent_url", "ord", "step", "asks"]]

    return walk_site


def crawl_dfs(
    seeds: DataFrame,
    corpus: DataFrame,
    links: DataFrame,
    params: CrawlParams,
    links_stay_in_site: bool = False,
) -> DataFrame:
    """Crawl results: url, depth, parent_url, crawl_order.

    ``links_stay_in_site`` promises that no followed link leaves its host, so
    that hosts can be walked side by side; otherwise the crawl is one walk.
    """
    budget = params.max_pages
    known = corpus.select("url")
    site = extract_domain("url") if links_stay_in_site else F.lit("")
    valid = is_web_url("url") & in_allowed_domains("url", params.allowed_domains)
    starts = (
        seeds.where(valid)
        .join(known, "url", "left_semi")
        .groupBy("url")
        .agg(F.min("ord").cast("long").alias("ord"))
    )
    starts = materialize(starts.select(site.alias("site"), "url", "ord"), "dfs-seeds")
    allowed = is_web_url("link") & in_allowed_domains("link", params.allowed_domains)
    out = links.where(allowed).select("url", "pos", "link")
    no_children = starts.select(
        "site", "url", "ord", F.lit(None).cast("array<string>").alias("children")
    )
    loaded: DataFrame | None = None
    round_no = 0
    while True:
        state = no_children
        if loaded is not None:
            state = state.unionByName(
                loaded.select("site", "url", F.lit(None).cast("long").alias("ord"), "children")
            )
        walked = materialize(
            state.groupBy("site").applyInPandas(
                _walk_sites(math.inf if budget is None else budget, params.max_depth), _WALK_SCHEMA
            ),
            f"dfs-walk-{round_no}",
        )
        asked = walked.where("asks").select("site", "url")
        if asked.isEmpty():
            break
        more = materialize(_children(asked, out, known), f"dfs-links-{round_no}")
        loaded = more if loaded is None else loaded.unionByName(more)
        round_no += 1
    numbered = cut_to_budget(walked, [F.col("ord"), F.col("step")], budget)
    return numbered.select("url", "depth", "parent_url", "crawl_order")


def _children(asked: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """site, url and the corpus links of each asked page, each where it stands first."""
    targets = known.select(F.col("url").alias("link"))
    found = asked.join(links, "url").join(targets, "link", "left_semi")
    first = found.groupBy("site", "url", "link").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("site", "url").agg(
        F.sort_array(F.collect_list(F.struct("pos", "link"))).alias("_l")
    )
    cut = lists.select("site", "url", F.col("_l.link").alias("_c"))
    none = F.array().cast("array<string>")
    return asked.join(cut, ["site", "url"], "left").select(
        "site", "url", F.coalesce("_c", none).alias("children")
    )
