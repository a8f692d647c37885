"""The index: terms with positions, postings, document infos, statistics, and how they are kept up.

An index is a pair of DataFrames, postings(term, doc_id, positions, tf) and doc_info(doc_id, url, title, token_count,
length, indexed_at); everything else is derived. Operations return new indexes, so nothing needs locks or copies.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.text import DEFAULT, TokenizerConfig, markdown_text, term_array

POSTINGS = "term string, doc_id string, positions array<int>, tf int"


class NotFound(KeyError):
    """No such document or term."""


def tokens(docs: DataFrame, *texts: Column, config: TokenizerConfig = DEFAULT) -> DataFrame:
    """(doc_id, term, pos): the terms of the texts one after another; positions count kept terms from 0."""
    arrays = [term_array(t, config) for t in texts]
    return docs.select("doc_id", F.posexplode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("pos", "term")).select("doc_id", "term", "pos")


def postings_of(rows: DataFrame) -> DataFrame:
    """Postings of (doc_id, term, pos); a group is bounded by its document."""
    grouped = rows.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count("*").cast("int").alias("tf"))
    return grouped.select("term", "doc_id", "positions", "tf")


def content_of(markdown: Column, url: Column) -> Column:
    """What is indexed of a page besides its title: plain text, then the url."""
    return F.concat_ws(" ", F.nullif(markdown_text(markdown), F.lit("")), F.nullif(url, F.lit("")))


@dataclass
class SearchIndex:
    postings: DataFrame
    doc_info: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, config: TokenizerConfig = DEFAULT, indexed_at: Column | None = None) -> SearchIndex:
        """From (doc_id, url, title, content). Rows without doc_id are left out; one row per doc_id is expected (see ``latest``).

        Texts are partitioned by document before they are cut into terms: they are smaller than their terms with positions, and
        grouping by document and term, and joins on documents, then need no further shuffle."""
        good = docs.where("doc_id is not null").repartition("doc_id")
        title = term_array(F.col("title"), config)
        terms = good.select("doc_id", "url", "title", F.concat(title, term_array(F.col("content"), config)).alias("terms"))
        info = terms.select("doc_id", "url", "title", F.size("terms").alias("token_count"), F.size(F.array_distinct("terms")).alias("length"), (indexed_at if indexed_at is not None else F.lit(None).cast("timestamp")).alias("indexed_at"))
        return cls(postings_of(terms.select("doc_id", F.posexplode("terms").alias("pos", "term"))), info)

    @classmethod
    def build_pages(cls, pages: DataFrame, config: TokenizerConfig = DEFAULT) -> SearchIndex:
        """From pages (id, url, title, content_markdown, crawled_at): Markdown as plain text, followed by the url."""
        docs = latest(pages).select(F.col("id").alias("doc_id"), "url", "title", content_of(F.col("content_markdown"), F.col("url")).alias("content"))
        return cls.build(docs, config)

    @cached_property
    def terms(self) -> DataFrame:
        """(term, df)."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def document_count(self) -> int:
        return self.doc_info.count()

    def term_count(self) -> int:
        return self.postings.select("term").distinct().count()

    def has_document(self, doc_id) -> bool:
        return not self.doc_info.where(F.col("doc_id") == doc_id).isEmpty()

    def has_term(self, term: str) -> bool:
        return not self.postings.where(F.col("term") == term.lower()).isEmpty()

    def get_postings(self, term: str) -> DataFrame:
        found = self.postings.where(F.col("term") == term.lower())
        if found.isEmpty():
            raise NotFound(term)
        return found

    def get_doc_info(self, doc_id) -> DataFrame:
        found = self.doc_info.where(F.col("doc_id") == doc_id)
        if found.isEmpty():
            raise NotFound(doc_id)
        return found

    def stats(self) -> DataFrame:
        """One row: documents, terms, postings, average postings per term (0 without terms)."""
        sums = self.terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        average = F.when(F.col("terms") > 0, F.col("postings") / F.col("terms")).otherwise(F.lit(0.0))
        documents = self.doc_info.agg(F.count("*")).scalar()
        return sums.select(documents.alias("documents"), "terms", "postings", average.alias("avg_postings"))

    def top_terms(self, n: int = 10) -> DataFrame:
        return self.terms.orderBy(F.desc("df"), "term").limit(n)

    def validate(self) -> DataFrame:
        """(problem, doc_id, n): documents of postings without info, with their postings; infos without postings."""
        seen = self.postings.groupBy("doc_id").agg(F.count("*").alias("n"))
        orphans = seen.join(self.doc_info.select("doc_id").distinct(), "doc_id", "left_anti").select(F.lit("orphan_posting").alias("problem"), "doc_id", "n")
        bare = self.doc_info.select("doc_id").distinct().join(seen, "doc_id", "left_anti").select(F.lit("no_terms").alias("problem"), "doc_id", F.lit(0).cast("bigint").alias("n"))
        return orphans.unionByName(bare)

    def delete(self, ids: DataFrame) -> SearchIndex:
        """Without the documents of ``ids`` (doc_id); terms without documents go with them."""
        gone = ids.select("doc_id").distinct()
        return SearchIndex(self.postings.join(gone, "doc_id", "left_anti"), self.doc_info.join(gone, "doc_id", "left_anti"))

    def delete_document(self, doc_id) -> SearchIndex:
        if not self.has_document(doc_id):
            raise NotFound(doc_id)
        return SearchIndex(self.postings.where(F.col("doc_id") != doc_id), self.doc_info.where(F.col("doc_id") != doc_id))

    def upsert(self, other: SearchIndex) -> SearchIndex:
        """Documents of ``other`` replace those of the same id."""
        kept = self.delete(other.doc_info.select("doc_id"))
        return SearchIndex(kept.postings.unionByName(other.postings), kept.doc_info.unionByName(other.doc_info))

    def merge(self, other: SearchIndex) -> SearchIndex:
        """Both indexes; an own info wins, postings of a pair in both are added up with positions sorted."""
        both = self.postings.unionByName(other.postings)
        merged = both.groupBy("term", "doc_id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("tf").cast("int").alias("tf"))
        new = other.doc_info.join(self.doc_info.select("doc_id"), "doc_id", "left_anti")
        return SearchIndex(merged, self.doc_info.unionByName(new))

    def optimize(self) -> SearchIndex:
        """Postings partitioned and sorted by term, so that files written from them can be skipped by term."""
        return SearchIndex(self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), self.doc_info)

    def save(self, path: str) -> None:
        """Overwrites the index at ``path``; nothing stale stays behind."""
        self.optimize().postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.doc_info.write.mode("overwrite").parquet(f"{path}/doc_info")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_info"))


def open_or_build(spark: SparkSession, path: str, pages: DataFrame, rebuild: bool = False) -> SearchIndex:
    """The index at ``path``; built from all pages and saved first if there is none, if it is empty, or if asked for."""
    if not rebuild:
        try:
            found = SearchIndex.load(spark, path)
            if not found.doc_info.isEmpty():
                return found
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    SearchIndex.build_pages(pages).save(path)
    return SearchIndex.load(spark, path)


def latest(pages: DataFrame) -> DataFrame:
    """Of the rows of one id the one crawled last (a null time counts as earliest)."""
    at = F.coalesce(F.col("crawled_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    return pages.where("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def from_tables(postings: DataFrame, doc_info: DataFrame) -> SearchIndex:
    """An index from stored tables with repeats: of a document's infos the one indexed last; positions of a pair once."""
    at = F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    info = doc_info.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("url", "title", "token_count", "length", "indexed_at"), F.struct(at, F.coalesce("token_count", F.lit(-1)))).alias("i")).select("doc_id", "i.*")
    rows = postings.where("term is not null and doc_id is not null and positions is not null").groupBy("term", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return SearchIndex(rows.select("term", "doc_id", "positions", F.size("positions").alias("tf")), info)
