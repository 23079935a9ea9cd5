"""Link tables and allow lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import extract_domain, host_suffixes


def page_links(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovery edges: from_page_id, to_page_id, each once.

    ``results`` has page_id and parent_url. An edge exists only when the parent
    page does.
    """
    parents = pages.select(F.col("page_id").alias("from_page_id"), F.col("url").alias("parent_url"))
    found = results.where(F.col("parent_url") != "").select(
        F.col("page_id").alias("to_page_id"), "parent_url"
    )
    joined = found.join(parents, "parent_url").select("from_page_id", "to_page_id")
    return joined.dropDuplicates(["from_page_id", "to_page_id"])


def filter_allowed(rows: DataFrame, url: str, allowed: DataFrame) -> DataFrame:
    """Rows whose host equals or lies below a domain of the table ``allowed``.

    Decided once per distinct host: hosts are far fewer than URLs, and a host
    with very many URLs counts once. Suffix matching becomes an equi-join on
    the host's suffixes. An empty table allows nothing; to allow all, do not
    call this.
    """
    names = allowed.select(
        F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("_suffix")
    ).distinct()
    with_host = rows.withColumn("_host", extract_domain(url))
    hosts = with_host.select("_host").distinct()
    suffixes = hosts.select("_host", F.explode(host_suffixes("_host")).alias("_suffix"))
    good = suffixes.join(names, "_suffix", "left_semi").select("_host").distinct()
    return with_host.join(good, "_host", "left_semi").drop("_host")
