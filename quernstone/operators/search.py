"""A search session over an index: search, pages of results, suggestions, single results, export."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.fuzzy import similar_terms
from quernstone.functions.text import DEFAULT, TokenizerConfig, driver_terms, markdown_text, snippet, title_snippet
from quernstone.functions.urls import export_name, host, host_matches, normalize_domain
from quernstone.operators.index import NotFound, SearchIndex
from quernstone.operators.rank import ScorerConfig, combined_scores
from quernstone.operators.retrieve import find
from quernstone.plans.query import QueryType, SearchConfig, cache_key, parse
from quernstone.session import written


@dataclass
class ResultCache:
    """Results by normalised query, kept as persisted DataFrames for a while."""

    seconds: float = 3600.0
    held: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def get(self, query: str) -> DataFrame | None:
        found = self.held.get(cache_key(query))
        if found and found[0] > time.time():
            return found[1]
        if found:
            self.delete(query)
        return None

    def put(self, query: str, results: DataFrame) -> DataFrame:
        self.delete(query)
        kept = results.persist()
        self.held[cache_key(query)] = (time.time() + self.seconds, kept)
        return kept

    def delete(self, query: str) -> None:
        if old := self.held.pop(cache_key(query), None):
            old[1].unpersist()

    def clear(self) -> None:
        for _, kept in self.held.values():
            kept.unpersist()
        self.held.clear()

    def stats(self) -> dict[str, int]:
        now = time.time()
        return {"entries": len(self.held), "expired": sum(until <= now for until, _ in self.held.values())}


@dataclass
class Searcher:
    index: SearchIndex
    config: SearchConfig = SearchConfig()
    scorer: ScorerConfig = ScorerConfig()
    pagerank: DataFrame | None = None
    as_of: Column | None = None
    tokenizer: TokenizerConfig = DEFAULT
    cache: ResultCache | None = None

    def candidates(self, text: str) -> DataFrame:
        return find(self.index, parse(text, self.config, self.tokenizer), self.config)[0]

    def scores(self, text: str) -> DataFrame:
        query = parse(text, self.config, self.tokenizer)
        docs, words = find(self.index, query, self.config)
        terms = words if words and self.config.fuzzy_ranks_matches else query.ranking_terms()
        return combined_scores(self.index, docs, terms, self.scorer, self.pagerank, self.as_of)

    def search(self, text: str, limit: int = 10, offset: int = 0) -> DataFrame:
        """(position, doc_id, url, title, score, snippet), best first, ties by doc_id. The top-k is cut before infos are joined.

        ``limit`` 0: all (up to the configured most). An offset behind the last result gives none."""
        if self.cache and (kept := self.cache.get(f"{text}\x00{limit}\x00{offset}")) is not None:
            return kept
        most = self.config.max_results
        wanted = limit + offset if limit else 0
        wanted = min(x for x in (wanted, most) if x) if wanted or most else 0
        rows = self.scores(text)
        if wanted:
            rows = rows.orderBy(F.desc("score"), "doc_id").limit(wanted)
        place = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) if wanted else None
        if place is None:
            place = rank_all(rows)
            rows = place
        else:
            rows = rows.withColumn("position", place)
        rows = rows.where(F.col("position") > offset).join(self.index.doc_info.select("doc_id", "url", "title"), "doc_id")
        out = rows.select("position", "doc_id", "url", "title", "score", title_snippet(F.col("title")).alias("snippet"))
        return self.cache.put(f"{text}\x00{limit}\x00{offset}", out) if self.cache else out

    def total(self, text: str) -> int:
        return self.candidates(text).join(self.index.doc_info, "doc_id", "left_semi").count()

    def suggest(self, text: str, limit: int = 5) -> list[str]:
        """Terms like those of the query, each once: the ``limit`` most similar of each term, without the term itself."""
        query = parse(text, self.config, self.tokenizer)
        terms = query.terms if query.type is QueryType.FUZZY else driver_terms(text, self.tokenizer)
        found = similar_terms(self.index.terms, terms, 0.6, limit).where("term <> query").collect()  # at most limit rows a term
        by = {t: [] for t in terms}
        for r in sorted(found, key=lambda r: r.place):
            by[r["query"]].append(r.term)
        return list(dict.fromkeys(t for own in by.values() for t in own))[:limit]

    def item(self, text: str, rank: int, pages: DataFrame) -> DataFrame:
        """One row (json): the result at a rank with its page's whole text and links. NotFound if there are fewer."""
        if rank < 1:
            raise ValueError("rank starts at 1")
        row = self.search(text, limit=1, offset=rank - 1)
        if row.isEmpty():
            raise NotFound(f"rank {rank} of {text!r}")
        page = row.join(pages.select(F.col("id").alias("doc_id"), "content_markdown", "links"), "doc_id", "left")
        return page.select(F.to_json(F.struct("position", "doc_id", "url", "title", "score", F.col("content_markdown").alias("content"), "links")).alias("json"))

    def with_content_snippets(self, text: str, results: DataFrame, pages: DataFrame, length: int = 220) -> DataFrame:
        """Results with a window of their page's text around the first match instead of the title."""
        from quernstone.plans.query import snippet_terms

        body = pages.select(F.col("id").alias("doc_id"), snippet(markdown_text(F.col("content_markdown")), snippet_terms(text), length).alias("found"))
        return results.join(body, "doc_id", "left").withColumn("snippet", F.coalesce(F.nullif("found", F.lit("")), "snippet")).drop("found")


def rank_all(scores: DataFrame, parts: int = 64) -> DataFrame:
    """Scores with their position among all, without one task for all rows: ranges of the order by score and id are ranked by
    themselves and moved by the sizes of the ranges before. Rows of equal scores spread over ranges like any others."""
    rows = written(scores.repartitionByRange(parts, F.desc("score"), "doc_id").withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), "doc_id"))
    # at most `parts` rows
    return rows.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("position", (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def total_pages(n: int, size: int) -> int:
    return max(math.ceil(n / size), 1) if size > 0 else 1


def page_bounds(n: int, size: int, page: int) -> tuple[int, int]:
    """First and end of a page, counted from 0, held within the pages there are."""
    page = min(max(page, 0), total_pages(n, size) - 1)
    return min(page * size, n), min((page + 1) * size, n)


def domain_export(doc_info: DataFrame, pages: DataFrame, target: str) -> DataFrame:
    """(doc_id, file_name, content, missing) of the indexed documents of a domain and the hosts below it."""
    name = normalize_domain(target)
    rows = doc_info.where(host_matches(host(F.col("url")), name)).select("doc_id", "url").join(pages.select(F.col("id").alias("doc_id"), F.col("content_markdown").alias("content")), "doc_id", "left")
    return rows.select("doc_id", export_name(F.col("url"), F.col("doc_id").cast("string")).alias("file_name"), "content", F.col("content").isNull().alias("missing"))


def export_summary(export: DataFrame) -> DataFrame:
    return export.agg(F.count("*").alias("matched"), F.count_if(~F.col("missing")).alias("written"), F.count_if("missing").alias("skipped_missing"))


def write_export(export: DataFrame, path: str) -> None:
    """Each document as a row of text files in a folder of its file name. NotFound if nothing matches."""
    if export.isEmpty():
        raise NotFound("no indexed document of this domain")
    export.where(~F.col("missing")).select("file_name", F.col("content").alias("value")).write.mode("overwrite").partitionBy("file_name").text(path)
