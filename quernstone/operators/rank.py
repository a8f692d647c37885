"""Ranking: TF-IDF, BM25, vectors and cosine, and the combined score of several signals."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import alnum
from quernstone.functions.urls import host_label, is_homepage, url_depth
from quernstone.operators.index import SearchIndex
from quernstone.plans.query import query_signals


@dataclass(frozen=True)
class ScorerConfig:
    """Weights of the combined score; times in days."""

    tfidf_weight: float = 0.7
    pagerank_weight: float = 0.3
    title_boost: float = 1.5
    depth_weight: float = 0.1
    freshness_weight: float = 0.1
    freshness_days: float = 30.0
    domain_boost: float = 0.2
    homepage_boost: float = 0.8


def idf(df: Column, n: Column) -> Column:
    """ln(n / df), 0 without documents: a term of every document scores 0."""
    return F.when((df > 0) & (n > 0), F.log(n / df)).otherwise(F.lit(0.0))


def _query_terms(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(term, doc_id, tf, idf, times) of the query's terms; ``times``: how often the query has the term."""
    times = Counter(terms)
    rows = index.postings.where(F.col("term").isin(sorted(times)))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    n = index.doc_info.agg(F.count("*")).scalar()
    count = F.element_at(F.create_map(*[x for t, k in times.items() for x in (F.lit(t), F.lit(k))]), F.col("term"))
    known = df.select("term", idf(F.col("df"), n).alias("idf"))  # at most one row a query term
    return rows.join(F.broadcast(known), "term").select("term", "doc_id", "tf", "idf", count.alias("times"))


def tfidf_scores(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(doc_id, score): sum of tf * idf; a term given twice counts twice."""
    if not terms:
        return index.doc_info.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return _query_terms(index, terms).groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("times")).alias("score"))


def bm25_scores(index: SearchIndex, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) by BM25 with the same idf; the average size of no documents or tokens counts as 1."""
    if not terms:
        return index.doc_info.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    mean = index.doc_info.agg((F.sum("token_count") / F.count("*")).alias("mean"))
    mean = mean.select(F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0)).alias("mean")).scalar()
    rows = _query_terms(index, terms).join(index.doc_info.select("doc_id", F.coalesce("token_count", F.lit(0)).alias("size")), "doc_id")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
    return rows.groupBy("doc_id").agg(F.sum(F.col("idf") * tf * F.col("times")).alias("score"))


def document_vectors(index: SearchIndex) -> DataFrame:
    """(doc_id, term, weight): tf * idf of every document."""
    n = index.doc_info.agg(F.count("*")).scalar()
    return index.postings.join(index.terms, "term").select("doc_id", "term", (F.col("tf") * idf(F.col("df"), n)).alias("weight"))


def query_vector(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(term, weight): times a term comes in the query, times idf; terms the index does not know are left out."""
    return _query_terms(index, terms).select("term", (F.col("idf") * F.col("times")).alias("weight")).distinct()


def cosine_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, other, cosine) of sparse vectors a (doc_id, term, weight) and b (doc_id, term, weight) that share a term, for a
    stated set of vectors b against all of a; zero vectors give 0."""
    norm = lambda v, name: v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))
    left, right = a.select("doc_id", "term", F.col("weight").alias("wa")), b.select(F.col("doc_id").alias("other"), "term", F.col("weight").alias("wb"))
    dots = left.join(right, "term").groupBy("doc_id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    both = dots.join(norm(a, "na"), "doc_id").join(norm(b, "nb").withColumnRenamed("doc_id", "other"), "other")
    return both.select("doc_id", "other", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(F.lit(0.0)).alias("cosine"))


def cosine_to_query(index: SearchIndex, terms: list[str]) -> DataFrame:
    """(doc_id, cosine) of the documents that share a term with the query; a zero vector gives 0."""
    vectors = document_vectors(index)
    norms = vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    rows = _query_terms(index, terms).withColumn("q", F.col("idf") * F.col("times"))
    dots = rows.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))
    length = rows.select("term", "q").distinct().agg(F.sqrt(F.sum(F.col("q") * F.col("q")))).scalar()
    value = F.when((F.col("norm") > 0) & (length > 0), F.col("dot") / (F.col("norm") * length)).otherwise(F.lit(0.0))
    return dots.join(norms, "doc_id").select("doc_id", value.alias("cosine"))


def squash(score: Column) -> Column:
    """s / (1 + s); below 0 it is 0."""
    return F.when(score < 0, F.lit(0.0)).otherwise(score / (1 + score))


def title_boost(title: Column, terms: list[str], weight: float) -> Column:
    """Share of the query's terms that stand in the title, also with all but letters and digits left out of both."""
    if not terms:
        return F.lit(0.0)
    low, plain = F.lower(title), alnum(title)
    hits = [F.contains(low, F.lit(t.lower())) | (F.lit(bool(a := "".join(c for c in t.lower() if c.isascii() and c.isalnum()))) & F.contains(plain, F.lit(a or " "))) for t in terms]
    total = sum((F.coalesce(h, F.lit(False)).cast("int") for h in hits), F.lit(0))
    return F.lit(weight) * total / len(terms)


def depth_boost(url: Column, weight: float) -> Column:
    depth = url_depth(F.coalesce(url, F.lit("")))
    return F.lit(weight) / F.greatest(depth, F.lit(1)) if weight > 0 else F.lit(0.0)


def freshness_boost(indexed_at: Column, as_of: Column, weight: float, days: float) -> Column:
    """Falls to 0 over ``days``; 0 without a time."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(indexed_at.cast("timestamp"))) / 86_400e6
    return F.when(age < days, F.lit(weight) * (1 - age / days)).otherwise(F.lit(0.0))


def navigation_boost(url: Column, terms: list[str], domain: float, homepage: float) -> Column:
    """For queries that name the site: more if the page is its front page."""
    signals = query_signals(terms)
    if not signals:
        return F.lit(0.0)
    return F.when(host_label(url).isin(signals), F.lit(domain) + F.when(is_homepage(url), F.lit(homepage)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def combined_scores(index: SearchIndex, candidates: DataFrame, terms: list[str], config: ScorerConfig = ScorerConfig(), pagerank: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """(doc_id, score) of the candidates that have an info: weighted TF-IDF and PageRank plus the boosts.

    ``pagerank``: (id, score); ``as_of``: the time freshness is seen from. Without them both signals are 0."""
    c = config
    rows = index.doc_info.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").join(tfidf_scores(index, terms).withColumnRenamed("score", "tfidf"), "doc_id", "left")
    if pagerank is not None:
        rows = rows.join(pagerank.select(F.col("id").alias("doc_id"), F.col("score").alias("pr")), "doc_id", "left")
    else:
        rows = rows.withColumn("pr", F.lit(0.0))
    zero = F.lit(0.0)
    fresh = freshness_boost(F.col("indexed_at"), as_of, c.freshness_weight, c.freshness_days) if as_of is not None else zero
    score = (
        c.tfidf_weight * squash(F.coalesce("tfidf", zero))
        + c.pagerank_weight * squash(F.coalesce("pr", zero))
        + title_boost(F.coalesce("title", F.lit("")), terms, c.title_boost)
        + depth_boost(F.col("url"), c.depth_weight)
        + F.coalesce(fresh, zero)
        + F.coalesce(navigation_boost(F.col("url"), terms, c.domain_boost, c.homepage_boost), zero)
    )
    return rows.select("doc_id", score.alias("score"))


def ranked(scores: DataFrame, n: int | None = None) -> DataFrame:
    """Best first, ties by doc_id; with ``n`` a top-k without a full sort."""
    rows = scores.orderBy(F.desc("score"), "doc_id")
    return rows.limit(n) if n else rows
