"""Link graph: degrees, PageRank, breadth-first depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.urls import normalize_url, url_hash
from quernstone.session import written, written_by


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from pages (id, links): one edge per link, ids of targets from their normalised urls. A bag: repeats stay."""
    return pages.select(F.col("id").alias("src"), F.explode("links").alias("link")).where("src is not null and link is not null").select("src", url_hash(normalize_url(F.col("link"))).alias("dst"))


def good_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst")


def nodes_of(edges: DataFrame) -> DataFrame:
    e = good_edges(edges)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_links, in_links), repeats counted."""
    e = good_edges(edges)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """(id, score): power iteration from 1/N until no score changes by the tolerance; the mass of nodes without links is lost.

    Repeated edges are counted into a weight first, so a target of a third of all edges gets one pre-aggregated sum per
    partition. Edges stay where their source is and nodes where their id is: a round shuffles the pre-aggregated sums and nothing
    else. Ranks are written every few rounds, where the
    change is looked at; the rounds before the one that settled are then gone through one by one, so the result is that of the first
    round after which nothing moves. ValueError on an empty graph.
    """
    e = good_edges(edges).groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("all"))
    shares = written_by(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("share")), "src")
    nodes = written_by(nodes_of(shares), "id")
    n = nodes.count()
    if not n:
        raise ValueError("the graph is empty")

    def step(ranks: DataFrame) -> DataFrame:
        sums = shares.hint("merge").join(ranks, shares.src == ranks.id).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        return nodes.hint("merge").join(sums, nodes.id == sums.dst, "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))

    def settled(ranks: DataFrame, before: DataFrame) -> tuple[DataFrame, bool]:
        both = written_by(ranks.join(before.withColumnRenamed("score", "old"), "id"), "id")
        return both.select("id", "score"), both.agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("d")).first()["d"] < tolerance

    ranks, done = nodes.select("id", F.lit(1.0 / n).alias("score")), 0
    while done < iterations:
        start, rounds = ranks, min(every, iterations - done)
        for _ in range(rounds):
            before, ranks = ranks, step(ranks)
        done += rounds
        if tolerance > 0:
            ranks, end = settled(ranks, before)
            if end:
                # the first round of these after which nothing moves any more
                ranks = start
                for _ in range(rounds):
                    ranks, end = settled(step(ranks), ranks)
                    if end:
                        break
                break
        elif done < iterations:
            ranks = written_by(ranks, "id")
    return ranks


def normalized(ranks: DataFrame) -> DataFrame:
    """Scores as shares of their sum."""
    total = ranks.agg(F.sum("score")).scalar()
    return ranks.select("id", F.when(total > 0, F.col("score") / total).otherwise(F.col("score")).alias("score"))


def scaled(ranks: DataFrame, factor: float) -> DataFrame:
    return ranks.select("id", (F.col("score") * factor).alias("score"))


def top(ranks: DataFrame, n: int) -> DataFrame:
    return ranks.orderBy(F.desc("score"), "id").limit(n)


def boosted(scores: DataFrame, ranks: DataFrame, factor: float) -> DataFrame:
    """(id, score): base score times 1 + factor * rank / highest rank; unchanged if the highest is 0."""
    best = ranks.agg(F.coalesce(F.max("score"), F.lit(0.0))).scalar()
    rows = scores.join(ranks.select("id", F.col("score").alias("pr")), "id", "left")
    lift = F.when(best > 0, 1 + factor * F.coalesce("pr", F.lit(0.0)) / best).otherwise(F.lit(1.0))
    return rows.select("id", (F.col("score") * lift).alias("score"))


def depths(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, depth): rounds from the seeds (id), at most ``most``. Each round joins only the last level's ids; levels are written."""
    links = good_edges(edges).distinct()
    seen = written(seeds.where("id is not null").select("id").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, most + 1):
        reached = links.join(level.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        level = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def resolve_links(pages: DataFrame) -> DataFrame:
    """(src, dst, known): links of pages with whether the target is a page, by normalised url."""
    known = pages.where("url is not null").select(url_hash(normalize_url(F.col("url"))).alias("dst")).distinct().withColumn("known", F.lit(True))
    return page_edges(pages).join(known, "dst", "left").select("src", "dst", F.coalesce("known", F.lit(False)).alias("known"))


