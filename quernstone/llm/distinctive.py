"""Problem 2: how distinctive a term is of a document against the whole collection.

Score: term frequency over the document's size, times a smoothed logarithmic inverse document
frequency, ln((N + 1) / (df + 1)) + 1, from distributed counts of distinct (term, document) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import EPOCH

#: Parameters of a case: occurrences, documents with the term, and how many times its share in the collection its share in the document must be.
LEAST_OCCURRENCES, LEAST_DOCUMENTS, LIFT = 4, 2, 12


def live_documents(doc_info: DataFrame) -> DataFrame:
    """(doc_id, token_count): ids with a row in doc_info, the count of the row indexed last (null counts as earliest; of equal times the larger count). Null ids are left out."""
    when = F.coalesce("indexed_at", F.lit(EPOCH).cast("timestamp"))
    rows = doc_info.where("doc_id is not null").groupBy("doc_id")
    return rows.agg(F.max_by("token_count", F.struct(when, F.coalesce("token_count", F.lit(-1)))).alias("token_count"))


def occurrences(postings: DataFrame) -> DataFrame:
    """(term, doc_id, n): distinct positions over all rows of the pair. Null positions count nothing.

    Repeated rows fall together before the shuffle, which is on the pair, so neither a term nor a document of a third of all
    rows makes a hot group; a group holds the distinct position lists of one term in one document. The document comes first in
    the key: the aggregate sorts by it, and what is shuffled compresses well."""
    rows = postings.where("term is not null and doc_id is not null and positions is not null").select("term", "doc_id", F.filter("positions", lambda p: p.isNotNull()).alias("positions"))
    pairs = rows.groupBy("doc_id", "term").agg(F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).alias("n"))
    return pairs.where("n > 0")


def distinctive_terms(postings: DataFrame, doc_info: DataFrame) -> DataFrame:
    """(doc_id, term, n, token_count, documents, in_all, of_all, tf, idf, score, lift) for every pair of live documents.

    ``n``: occurrences; ``documents``: live documents with the term; ``in_all``: its occurrences in all of them; ``of_all``:
    occurrences of all terms. A document of null or no tokens has tf, score and lift null. Empty tables give no row.
    """
    live = live_documents(doc_info)
    pairs = occurrences(postings).join(live, "doc_id")
    # counts of (term, document) pairs are pre-aggregated before the shuffle on term
    terms = pairs.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("in_all"))
    of_all, size = terms.agg(F.sum("in_all")).scalar(), live.agg(F.count("*")).scalar()
    joined = pairs.join(terms, "term").withColumn("of_all", of_all)
    tf = F.when(F.col("token_count") > 0, F.col("n") / F.col("token_count"))
    idf = F.log((size + 1) / (F.col("documents") + 1)) + 1
    return joined.select("doc_id", "term", "n", "token_count", "documents", "in_all", "of_all", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("score"), (tf * F.col("of_all") / F.col("in_all")).alias("lift"))


def cases(scored: DataFrame) -> DataFrame:
    # whole numbers on both sides, so that a ratio of exactly LIFT is in
    lifted = F.col("n").cast("decimal(19,0)") * F.col("of_all") >= F.lit(LIFT) * F.col("token_count").cast("decimal(19,0)") * F.col("in_all")
    return scored.where((F.col("token_count") > 0) & (F.col("n") >= LEAST_OCCURRENCES) & (F.col("documents") >= LEAST_DOCUMENTS) & lifted)
