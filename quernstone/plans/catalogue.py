"""Queries over the driver's tables, one or more per operator, each over whole tables. Their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import codec, fuzzy, text, urls
from quernstone.functions.html import extracted
from quernstone.operators import cluster, crawl, graph, rank, retrieve, search
from quernstone.operators.index import SearchIndex, from_tables, latest, tokens
from quernstone.plans.oracle import SQL
from quernstone.plans.query import SearchConfig, parse
from quernstone.session import shared_folder, spread
from quernstone.sources import seeds
from quernstone.sources.store import hadoop_path
from quernstone.streaming import live

__all__ = ["QUERIES", "SQL", "flagship"]

AS_OF = "2024-03-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(_read(spark, d, "documents").select("doc_id", "text", "url", "n_chars"))


def _index(spark: SparkSession, d: str) -> SearchIndex:
    """Index of the documents, which have no titles."""
    return SearchIndex.build(_read(spark, d, "documents").select("doc_id", "url", F.lit(None).cast("string").alias("title"), F.col("text").alias("content")))


def _stored(spark: SparkSession, d: str) -> SearchIndex:
    return from_tables(_read(spark, d, "postings"), _read(spark, d, "doc_info"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return latest(_read(spark, d, "docs"))


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Pages as HTML: the title element and the text, which holds anchors, tags and scripts, as body."""
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body>"), F.coalesce("content_markdown", F.lit("")), F.lit("</body></html>"))
    return _pages(spark, d).select("id", "url", html.alias("html"))


def _joined(positions) -> F.Column:
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",")


# -- index


@query
def tokenize_documents(spark, d):
    return tokens(_documents(spark, d), F.col("text"))


@query
def postings_build(spark, d):
    return _index(spark, d).postings.select("term", "doc_id", "tf", _joined(F.col("positions")).alias("positions"))


@query
def postings_pages(spark, d):
    index = SearchIndex.build_pages(_read(spark, d, "docs"))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("pos_sum"))


@query
def doc_info_build(spark, d):
    return _index(spark, d).doc_info.select("doc_id", "token_count", "length")


@query
def index_stats(spark, d):
    return _index(spark, d).stats().select("documents", "terms", "postings", F.round("avg_postings", 6).alias("avg_postings"))


@query
def top_terms_df(spark, d):
    return _index(spark, d).top_terms(10)


@query
def index_validate(spark, d):
    return _stored(spark, d).validate()


def _parity(spark, d):
    """The documents in two halves by id, with the even ones also in the second, their texts doubled."""
    rows = _read(spark, d, "documents").select("doc_id", "url", F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    even = rows.where("doc_id % 2 = 0")
    return SearchIndex.build(rows), SearchIndex.build(even.withColumn("content", F.concat("content", F.lit(" "), "content"))), even


def _counts(index: SearchIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def index_delete(spark, d):
    index, _, even = _parity(spark, d)
    return _counts(index.delete(even.select("doc_id")))


@query
def index_upsert(spark, d):
    index, doubled, _ = _parity(spark, d)
    return _counts(index.upsert(doubled))


@query
def index_merge(spark, d):
    index, doubled, _ = _parity(spark, d)
    return _counts(index.merge(doubled))


# -- retrieval


def _found(spark, d, text_: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    return retrieve.find(_index(spark, d), parse(text_, config), config)[0]


@query
def search_and(spark, d):
    return _found(spark, d, "driver packet")


@query
def search_or(spark, d):
    return _found(spark, d, "driver OR packet OR datei")


@query
def search_not(spark, d):
    return _found(spark, d, "driver NOT packet")


@query
def search_mixed(spark, d):
    return _found(spark, d, "driver AND packet OR kernel NOT cache")


@query
def postings_set_operations(spark, d):
    post = _index(spark, d).postings
    a, b = (post.where(F.col("term") == t).select("doc_id", "term", "tf") for t in ("driver", "packet"))
    parts = {"intersect": retrieve.intersect(a, b), "union": retrieve.union(a, b), "difference": retrieve.difference(a, b)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("operation"), "doc_id", "term", "tf")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def phrase_compat(spark, d):
    return _found(spark, d, '"rule of thumb"', SearchConfig(exact_phrases=False))


@query
def phrase_exact(spark, d):
    return retrieve.phrase_positions(_index(spark, d).postings, parse('"rule of thumb"').terms)


@query
def proximity(spark, d):
    post = _index(spark, d).postings
    return retrieve.near(post.where("term = 'driver'"), post.where("term = 'packet'"), 5)


# -- ranking


@query
def tfidf_topk(spark, d):
    scores = rank.tfidf_scores(_index(spark, d), ["driver", "packet", "driver"])
    return rank.ranked(scores.select("doc_id", F.round("score", 6).alias("score")), 20)


@query
def bm25_topk(spark, d):
    scores = rank.bm25_scores(_index(spark, d), ["driver", "packet", "kernel"])
    return rank.ranked(scores.select("doc_id", F.round("score", 6).alias("score")), 20)


@query
def bm25_all(spark, d):
    return rank.bm25_scores(_index(spark, d), ["driver", "packet", "kernel"]).select("doc_id", F.round("score", 6).alias("score"))


@query
def doc_vectors(spark, d):
    return rank.document_vectors(_index(spark, d)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def cosine_query(spark, d):
    return rank.cosine_to_query(_index(spark, d), ["driver", "packet"]).select("doc_id", F.round("cosine", 6).alias("cosine"))


@query
def combined_rank(spark, d):
    """Search of the stored index with every signal: PageRank of the link graph, and freshness seen from a fixed time."""
    ranks = graph.pagerank(_read(spark, d, "edges"), iterations=3, tolerance=0)
    searcher = search.Searcher(_stored(spark, d), pagerank=ranks, as_of=F.lit(AS_OF).cast("timestamp"))
    return searcher.scores("packet driver").select("doc_id", F.round("score", 6).alias("score"))


@query
def ranked_results(spark, d):
    """Result rows with positions; scores are rounded before ranking, so that ties are the same everywhere."""
    index = _stored(spark, d)
    rows = search.Searcher(index).scores("packet OR driver").select("doc_id", F.round("score", 6).alias("score"))
    return search.rank_all(rows).where("position <= 50").join(index.doc_info.select("doc_id", "title"), "doc_id").select("position", "doc_id", "score", text.title_snippet(F.col("title")).alias("snippet"))


@query
def navigational_rank(spark, d):
    return _pages(spark, d).select("id", F.round(rank.navigation_boost(F.col("url"), ["docs", "blog"], 0.2, 0.8), 6).alias("boost"), F.round(rank.title_boost(F.coalesce("title", F.lit("")), ["tuning", "first look"], 1.5), 6).alias("title_boost"), F.round(rank.depth_boost(F.col("url"), 0.1), 6).alias("depth_boost"))


# -- pages and urls


@query
def title_extract(spark, d):
    return _html(spark, d).select("id", text.html_title(F.col("html")).alias("title"))


@query
def body_text(spark, d):
    return _html(spark, d).select("id", text.html_text(F.col("html")).alias("body"))


@query
def page_extract(spark, d):
    title, body = text.page_text(F.col("html"), F.col("url"))
    return _html(spark, d).select("id", title.alias("title"), F.length(body).alias("chars"))


@query
def markdown_plain(spark, d):
    return _pages(spark, d).select("id", text.markdown_text(F.col("content_markdown")).alias("plain"))


@query
def markdown_normal(spark, d):
    return _pages(spark, d).select("id", text.normalize_markdown(F.col("content_markdown")).alias("markdown"))


@query
def sanitize_titles(spark, d):
    return _pages(spark, d).select("id", text.sanitize(F.col("title")).alias("title"), F.md5(text.sanitize(F.col("content_markdown"))).alias("content_md5"))


@query
def page_links(spark, d):
    rows = _html(spark, d).where("url is not null")
    return rows.select("id", F.posexplode(urls.anchor_links(F.col("html"), F.col("url"))).alias("place", "link"))


@query
def embedded_links(spark, d):
    rows = _html(spark, d).where("url is not null")
    return rows.select("id", F.posexplode(urls.embedded_links(F.col("html"), F.col("url"))).alias("place", "link"))


@query
def url_normalize(spark, d):
    links = _pages(spark, d).select(F.explode("links").alias("url"))
    return links.select("url", urls.normalize_url(F.col("url")).alias("normal"), urls.url_hash(urls.normalize_url(F.col("url"))).alias("hash"))


@query
def url_parts(spark, d):
    u = F.col("url")
    return _read(spark, d, "docs").select("url", urls.url_depth(u).alias("depth"), urls.host_label(u).alias("label"), urls.is_homepage(u).alias("home"), urls.domain(u).alias("domain"), urls.navigable(u).alias("navigable")).distinct()


@query
def url_filters(spark, d):
    u = F.col("url")
    rows = _pages(spark, d).where("url is not null")
    return rows.select("id", urls.in_domains(urls.host(u), ["test", "Docs.sovubumeta.example"]).alias("allowed"), urls.disallowed(urls.part(u, 3), ["/blog", "/shop/"]).alias("disallowed"), urls.host_matches(urls.host(u), "sovubumeta.example.").alias("matches"))


@query
def text_types(spark, d):
    kinds = F.when(F.col("event_type") == "view", "Text/HTML; charset=utf-8").when(F.col("event_type") == "click", "application/LD+json").when(F.col("event_type") == "error", "image/png").when(F.col("event_type") == "signup", "")
    return _read(spark, d, "events").select("event_id", text_like_of(kinds).alias("text_like"))


def text_like_of(kind):
    return urls.text_like(kind)


@query
def export_names(spark, d):
    return _pages(spark, d).where("url is not null").select("id", urls.slug(F.col("url")).alias("slug"), urls.export_name(F.col("url"), F.col("id")).alias("file_name"))


@query
def domain_export(spark, d):
    export = search.domain_export(_stored(spark, d).doc_info, _pages(spark, d), "sovubumeta.example")
    return export.select("doc_id", "file_name", F.length("content").alias("chars"), "missing")


@query
def export_totals(spark, d):
    return search.export_summary(search.domain_export(_stored(spark, d).doc_info, _pages(spark, d), "test"))


# -- similarity


@query
def fuzzy_terms(spark, d):
    found = fuzzy.similar_terms(_index(spark, d).terms, ["paket", "drivre"], 0.6, 10)
    return found.select("query", "term", "distance", F.round("similarity", 6).alias("similarity"), "place")


@query
def fuzzy_search(spark, d):
    index = _index(spark, d)
    return retrieve.find(index, parse("pakcet~"))[0]


@query
def suggest(spark, d):
    words = search.Searcher(_index(spark, d)).suggest("driver paket", 5)
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "place int, term string")


def _pairs(spark, d) -> DataFrame:
    """Names of parts, word against the word before it."""
    words = _read(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    return words.where(F.size("w") > 1).select(F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b")).where("a <> '' and b <> ''").distinct()


@query
def jaro_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(fuzzy.jaro(F.col("a"), F.col("b")), 6).alias("jaro"))


@query
def jaro_winkler_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(fuzzy.jaro_winkler(F.col("a"), F.col("b")), 6).alias("jaro_winkler"))


@query
def levenshtein_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", fuzzy.distance(F.col("a"), F.col("b")).alias("distance"), F.round(fuzzy.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query
def osa_pairs(spark, d):
    return _pairs(spark, d).select("a", "b", fuzzy.osa(F.col("a"), F.col("b")).alias("osa"))


# -- graph


@query
def pagerank_fixed(spark, d):
    ranks = graph.pagerank(_read(spark, d, "edges"), iterations=5, tolerance=0)
    return ranks.select("id", F.round("score", 9).alias("score"))


@query
def pagerank_shares(spark, d):
    ranks = graph.pagerank(_read(spark, d, "edges"), iterations=3, tolerance=0)
    base = ranks.select("id", F.lit(1.0).alias("score"))
    both = graph.normalized(ranks).withColumnRenamed("score", "share").join(graph.boosted(base, ranks, 0.5), "id")
    return both.select("id", F.round("share", 9).alias("share"), F.round("score", 6).alias("boosted"))


@query
def pagerank_converged(spark, d):
    return graph.pagerank(_read(spark, d, "edges"))


@query
def link_degrees(spark, d):
    return graph.degrees(_read(spark, d, "edges"))


@query
def links_resolved(spark, d):
    return graph.resolve_links(_pages(spark, d)).groupBy("src").agg(F.count("*").alias("links"), F.count_if("known").alias("known"))


@query
def bfs_depth(spark, d):
    seeds_ = _pages(spark, d).where("depth = 0").select("id")
    return graph.depths(_read(spark, d, "edges"), seeds_, 2)


# -- results


@query
def snippet_content(spark, d):
    return _documents(spark, d).select("doc_id", text.snippet(F.col("text"), ["driver", "packet"]).alias("snippet"))


@query
def snippet_phrase(spark, d):
    return _documents(spark, d).select("doc_id", text.phrase_snippet(F.col("text"), "Rule of Thumb").alias("snippet"))


@query
def snippet_title(spark, d):
    return _pages(spark, d).select("id", text.title_snippet(F.col("title"), 30).alias("snippet"), F.length(text.preview(F.col("content_markdown"), 20, 600)).alias("preview"))


@query
def paginate(spark, d):
    """The third page of twenty documents by size."""
    rows = _documents(spark, d).select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return search.rank_all(rows).where("position > 40 and position <= 60").select("position", "doc_id")


# -- crawling


def _candidates(spark, d) -> DataFrame:
    """Links of the pages with the page as parent, a level below it; priority by the kind of target."""
    rows = _pages(spark, d).select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"), F.explode("links").alias("url"))
    return rows.withColumn("priority", F.when(F.contains("url", F.lit("/docs/")), 0).otherwise(1))


@query
def url_dedupe(spark, d):
    return crawl.deduplicated(_candidates(spark, d))


@query
def admission(spark, d):
    return crawl.admitted(_candidates(spark, d), _pages(spark, d).where("url is not null"), budget=100, depth=3).select("url", "depth", "priority")


@query
def frontier_order(spark, d):
    return crawl.frontier(crawl.deduplicated(_candidates(spark, d))).limit(50).select("url", "priority", "depth")


@query
def politeness_schedule(spark, d):
    return crawl.schedule(crawl.deduplicated(_candidates(spark, d)), 1000).groupBy("host").agg(F.count("*").alias("urls"), F.max("start_ms").alias("last_ms"), F.countDistinct("start_ms").alias("slots"))


@query
def backoff_fold(spark, d):
    events = _read(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("domain"), "ts", "event_id")
    return crawl.backoffs(events, 3600 * 24, 3600 * 24 * 16).select("domain", "event_id", "backoff")


@query
def retry_policy(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in (429, 503, 500, 404, 0)]), F.pmod(F.col("event_id"), F.lit(5)).cast("int") + 1)
    attempt = F.pmod(F.col("user_id"), F.lit(5)).cast("int")
    after = F.when(F.col("value") > 15, F.floor("value").cast("string"))
    server = F.when(F.col("event_type") == "view", "CloudFlare-nginx")
    rows = _read(spark, d, "events").select("event_id", status.alias("status"), attempt.alias("attempt"), after.alias("after"), server.alias("server"))
    return rows.select("event_id", crawl.should_retry(F.col("status"), F.col("attempt")).alias("retry"), crawl.retry_delay(F.col("status"), F.col("attempt"), F.col("after")).alias("delay"), crawl.block_class(F.col("status"), F.col("server"), F.lit(False)).alias("block"))


@query
def robots_filter(spark, d):
    rules = spark.createDataFrame([("docs.sovubumeta.example", "/posts/", False), ("docs.sovubumeta.example", "/posts/s", True), ("bozokuluro.test", "/", False)], "host string, prefix string, allow boolean")
    return crawl.allowed_by_robots(_pages(spark, d).where("url is not null"), rules)


@query
def crawl_counters(spark, d):
    status = F.when(F.col("depth") > 3, 404).otherwise(200)
    return crawl.counters(_read(spark, d, "docs").where("url is not null").select("url", status.alias("status")))


@query
def seed_sets(spark, d):
    return seeds.valid(seeds.seed_table(spark)).groupBy("set_name").agg(F.count("*").alias("urls"))


# -- codecs


@query
def gap_encode(spark, d):
    sizes = F.aggregate(codec.gaps(F.col("positions")), F.lit(0), lambda a, g: a + codec.int_size(g).cast("int"))
    rows = _index(spark, d).postings.select("term", F.size("positions").alias("n"), sizes.alias("bytes"))
    out = rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return out.select("term", "n", "bytes", F.round(codec.compress_ratio(F.col("n") * 4, F.col("bytes")), 6).alias("ratio"), codec.estimated_size(F.col("n")).alias("estimate"))


@query
def codec_roundtrip(spark, d):
    rows = _stored(spark, d).postings.select("term", "doc_id", codec.encode_ints_column(codec.gaps(F.col("positions"))).alias("data"), "positions")
    back = codec.decode_ints_column(F.col("data"))
    return rows.select("term", "doc_id", F.octet_length("data").alias("bytes"), (back == codec.gaps(F.col("positions")).cast("array<bigint>")).alias("same"))


# -- clusters and summaries


@query
def clean_documents(spark, d):
    return _pages(spark, d).select("id", text.clean_markdown(F.col("content_markdown")).alias("clean"))


@query
def documents_long_enough(spark, d):
    return _documents(spark, d).where(text.long_enough(F.col("text"), 900, 120)).select("doc_id")


@query
def content_titles(spark, d):
    return _documents(spark, d).select("doc_id", text.title_from_content(F.col("text"), F.concat(F.lit("note-"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("title"))


@query
def key_terms(spark, d):
    return cluster.key_terms(_documents(spark, d), 10)


@query
def key_points(spark, d):
    return cluster.key_points(_documents(spark, d), 5)


@query
def topics(spark, d):
    terms = cluster.key_terms(_documents(spark, d), 10).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t"))
    return terms.select("doc_id", cluster.topic(F.col("t.term")).alias("topic"))


@query
def kmeans_clusters(spark, d):
    return cluster.clusters(_documents(spark, d), k=20, max_iter=20)


@query
def cluster_report(spark, d):
    docs = _documents(spark, d)
    return cluster.report(cluster.describe(docs, docs.select("doc_id", F.pmod(F.col("doc_id"), F.lit(10)).alias("cluster"))))


@query
def cluster_terms(spark, d):
    docs = _documents(spark, d)
    found = cluster.describe(docs, docs.select("doc_id", F.pmod(F.col("doc_id"), F.lit(10)).alias("cluster")), summary_sentences=0)  # it has no summary column
    return found.select("cluster", "docs", F.array_join("key_terms", ",").alias("key_terms"), "topic", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


@query
def html_markdown(spark, d):
    return extracted(_html(spark, d)).select("url", "title", F.length("content_markdown").alias("chars"), F.size("links").alias("links"))


@query
def lexrank_summaries(spark, d):
    return cluster.summaries(_documents(spark, d), 8)


# -- streams


@query
def stream_new_urls(spark, d):
    """New urls of the docs table read as a stream of files, run to its end into a table of files."""
    source = spark.readStream.schema(_read(spark, d, "docs").schema)
    path, fs = hadoop_path(spark, f"{d}/docs.parquet")
    folder = source.parquet(f"{d}/docs.parquet") if fs.getFileStatus(path).isDirectory() else source.option("pathGlobFilter", "docs.parquet").parquet(d)
    out = shared_folder(spark)
    live.new_urls(folder.select("url")).writeStream.format("parquet").option("path", f"{out}/urls").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/urls")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents of a query by the combined score, with positions."""
    return search.Searcher(_index(spark, d)).search("driver packet")


@query
def search_flagship(spark, d):
    return flagship(spark, d).select("position", "doc_id", F.round("score", 6).alias("score"))


