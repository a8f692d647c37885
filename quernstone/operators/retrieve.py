"""Retrieval: which documents a query finds. Sets of documents are DataFrames (doc_id)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.fuzzy import similar_terms
from quernstone.operators.index import SearchIndex
from quernstone.plans.query import BooleanQuery, ParsedQuery, QueryType, SearchConfig


def boolean_documents(postings: DataFrame, query: BooleanQuery) -> DataFrame:
    """(all of must) or any of should, without any of must_not, in one pass over the postings of the query's terms.

    Without must and should nothing is found. The filter on term reaches the scan of stored postings."""
    must, should, bad = (list(dict.fromkeys(x)) for x in (query.must, query.should, query.must_not))
    every = sorted({*must, *should, *bad})
    if not (must or should):
        return postings.select("doc_id").limit(0)
    # a bit per term: repeats do no harm, so one partial and one final aggregate are all there is
    place = {t: i for i, t in enumerate(every)}
    masks = [every[i : i + 60] for i in range(0, len(every), 60)]
    bit = lambda group: F.coalesce(*[F.when(F.col("term") == t, F.lit(1 << (place[t] % 60)).cast("bigint")) for t in group], F.lit(0).cast("bigint"))
    seen = postings.where(F.col("term").isin(every)).groupBy("doc_id").agg(*[F.bit_or(bit(g)).alias(f"m{i}") for i, g in enumerate(masks)])

    def held(words: list[str], every_one: bool) -> Column:
        tests = []
        for i in range(len(masks)):
            want = sum(1 << (place[w] % 60) for w in words if place[w] // 60 == i)
            if want:
                both = F.col(f"m{i}").bitwiseAND(F.lit(want).cast("bigint"))
                tests.append(both == want if every_one else both != 0)
        return reduce(and_ if every_one else or_, tests, F.lit(every_one))

    wanted = (held(must, True) if must else F.lit(False)) | held(should, False)
    return seen.where(wanted & ~held(bad, False)).select("doc_id")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose document is in ``right``."""
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, and of ``right`` those of other documents."""
    return left.unionByName(right.join(left.select("doc_id").distinct(), "doc_id", "left_anti"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_anti")


def near(left: DataFrame, right: DataFrame, distance: int = 0) -> DataFrame:
    """(doc_id, pos): positions of ``left`` terms with a ``right`` term 1 to distance + 1 places behind; each once.

    Both sides are (doc_id, positions); positions are compared within the row, so a document's pairs are never rows."""
    both = left.select("doc_id", F.col("positions").alias("a")).join(right.select("doc_id", F.col("positions").alias("b")), "doc_id")
    reach = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(distance + 1)), lambda d: F.array_intersect(F.col("a"), F.transform("b", lambda p: p - d))))
    return both.select("doc_id", F.explode(F.array_sort(F.array_distinct(reach))).alias("pos"))


def phrase_positions(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, pos): where the terms stand one after another. One shuffle for any number of terms: starts a term allows are
    its positions minus its place in the phrase; a start all terms allow is a match."""
    if not terms:
        return postings.select("doc_id", F.lit(0).alias("pos")).limit(0)
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    rows = postings.where(F.col("term").isin(sorted(set(terms)))).select("doc_id", "positions", F.explode(F.filter(places, lambda p: p["t"] == F.col("term"))).alias("p"))
    starts = rows.select("doc_id", F.col("p.i").alias("i"), F.explode("positions").alias("x")).select("doc_id", (F.col("x") - F.col("i")).alias("pos"))
    return starts.groupBy("doc_id", "pos").count().where(F.col("count") == len(terms)).select("doc_id", "pos")


def find(index: SearchIndex, query: ParsedQuery, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, list[str] | None]:
    """Documents of a parsed query, and for fuzzy queries the terms it stands for (else None)."""
    if query.type is QueryType.BOOLEAN and query.boolean:
        return boolean_documents(index.postings, query.boolean), None
    if query.type is QueryType.PHRASE and config.exact_phrases:
        return phrase_positions(index.postings, query.terms).select("doc_id").distinct(), None
    if query.type is QueryType.FUZZY:
        # at most config.fuzzy_terms words come to the driver
        words = [r.term for r in similar_terms(index.terms, [query.fuzzy_term], config.fuzzy_threshold, config.fuzzy_terms).select("term").collect()]
        return boolean_documents(index.postings, BooleanQuery(should=words)), words
    return boolean_documents(index.postings, BooleanQuery(must=query.terms)), None
