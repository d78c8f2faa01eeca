"""Operators on stored pages: e-mail addresses, anchors, hosts and the reach of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of an address, of an anchor's target and of a host.
EMAIL = r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_.+\-]+\.[A-Za-z0-9_]+"
ANCHOR = r'<a[^>]*href="([^"]*)"'
HOST = r"^[a-z]+://([^/?#]+)"

EMAIL_SQL = rf"SELECT mail, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '{EMAIL}')) AS mail FROM pages) GROUP BY mail"
LINK_SQL = rf"SELECT DISTINCT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE href END AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS href FROM pages) WHERE href NOT LIKE '%.%'"
HOST_SQL = rf"SELECT lower(regexp_extract(url, '{HOST}', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1"


def emails(pages: DataFrame) -> DataFrame:
    """Addresses and the number of pages that hold them."""
    found = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(EMAIL), F.lit(0)))).alias("mail"))
    return found.groupBy("mail").agg(F.countDistinct("page_id").alias("pages"))


def links(pages: DataFrame) -> DataFrame:
    """Targets of a page's anchors, relative ones resolved against its site; those with a point in them aren't followed."""
    found = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0).alias("site"), F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("href")).where(~F.col("href").contains("."))
    return found.select("page_id", F.when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.col("href")).alias("target")).distinct()


def hosts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.lower(F.regexp_extract("url", HOST, 1)).alias("host")).agg(F.count("*").alias("pages"))


def reached(pages: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """url and round of the stored pages that following links from start's urls reaches within so many rounds."""
    from ..storage import stored

    edges = links(pages).join(pages.select("page_id", "url"), "page_id").select("url", "target").distinct()
    seen = stored(start.select("url").distinct().withColumn("round", F.lit(0)), "seen")
    for k in range(1, rounds + 1):
        fresh = seen.where(F.col("round") == k - 1).join(edges, "url").select(F.col("target").alias("url")).distinct().join(pages.select("url"), "url", "left_semi").join(seen, "url", "left_anti")
        fresh = stored(fresh.withColumn("round", F.lit(k)), "fresh")
        if not fresh.limit(1).count():
            break
        seen = seen.union(fresh)
    return seen
