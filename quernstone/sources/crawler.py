"""Crawling by levels: admission, fetching and extraction as DataFrame steps. Fetching itself is a function of the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.html import extracted
from quernstone.functions.urls import disallowed, embedded_links, host, in_domains, navigable, normalize_url, part, text_like, url_hash
from quernstone.operators.crawl import admitted
from quernstone.session import ship_package, written
from quernstone.sources.store import decode_body

#: What a fetch function returns for a url: (status, headers with lower-case names, body).
Fetch = Callable[[str], tuple[int, dict[str, str], bytes]]
LOG = "url string, depth int, status int, content_type string, html string"


def fetched(frontier: DataFrame, fetch: Fetch) -> DataFrame:
    """LOG of the urls of a level. A host's urls come to one task, as politeness asks for; failures have status 0."""
    ship_package(frontier.sparkSession)

    def run(frames):
        for frame in frames:
            rows = []
            for url, depth in zip(frame["url"], frame["depth"]):
                try:
                    status, headers, body = fetch(url)
                    html = (decode_body(body, headers.get("content-encoding")) or b"").decode("utf-8", "replace")
                    rows.append((url, depth, status, headers.get("content-type"), html))
                except Exception:
                    rows.append((url, depth, 0, None, None))
            yield pd.DataFrame(rows, columns=["url", "depth", "status", "content_type", "html"])

    hosts = frontier.select("url", "depth", host(F.col("url")).alias("host")).repartition("host").drop("host")
    return hosts.mapInPandas(run, LOG)


def crawl(spark: SparkSession, seeds: list[str], fetch: Fetch, max_depth: int = 3, budget: int = 0, allow: list[str] = (), disallow: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, log). Level by level from the seeds: new urls of the level before that are allowed, up to ``budget`` queued in all
    (0: no bound) and ``max_depth`` (0: seeds only). Each level is written, so nothing is fetched twice."""
    candidates = spark.createDataFrame([(u, None, 0, 0) for u in seeds], "url string, parent string, depth int, priority int")
    seen = spark.createDataFrame([], "url string")
    pages = log = None
    queued = 0
    for depth in range(max_depth + 1):
        level = admitted(candidates, seen, max(budget - queued, 0) if budget else 0, depth) if not budget or queued < budget else candidates.limit(0)
        level = written(level.select("url", "depth"))
        size = level.count()
        if not size:
            break
        queued += size
        seen = seen.unionByName(level.select("url"))
        got = written(fetched(level, fetch))
        log = got.drop("html") if log is None else log.unionByName(got.drop("html"))
        good = got.where((F.col("status") == 200) & text_like(F.col("content_type")) & F.col("html").isNotNull())
        found = written(extracted(good).join(good.select("url", "depth", "html"), "url"))
        own = found.select(url_hash(F.col("url")).alias("id"), "url", "title", "content_markdown", "links", F.current_timestamp().alias("crawled_at"), "depth")
        pages = own if pages is None else pages.unionByName(own)
        links = F.array_union(F.coalesce("links", F.array().cast("array<string>")), embedded_links(F.col("html"), F.col("url")))
        out = found.select(F.col("url").alias("parent"), F.explode(links).alias("url")).select(normalize_url(F.col("url")).alias("url"), "parent")
        ok = in_domains(host(F.col("url")), list(allow)) & ~disallowed(part(F.col("url"), 3), list(disallow)) & navigable(F.col("url"))
        candidates = out.where(ok).select("url", "parent", F.lit(depth + 1).alias("depth"), F.lit(depth + 1).alias("priority"))
    empty = "id string, url string, title string, content_markdown string, links array<string>, crawled_at timestamp, depth int"
    return (pages if pages is not None else spark.createDataFrame([], empty)), (log if log is not None else spark.createDataFrame([], "url string, depth int, status int, content_type string"))
