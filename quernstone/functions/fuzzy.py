"""String similarity. Levenshtein is built in; the others are Arrow-batched functions, worked out once per distinct pair of a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.session import ship_package


def similarity(a: Column, b: Column) -> Column:
    """1 - distance over the longer byte length; equal strings 1, never below 0."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance(a, b) / longest))


def distance(a: Column, b: Column) -> Column:
    """Levenshtein by characters; against an empty string the byte length of the other."""
    return F.when(a == "", F.octet_length(b)).when(b == "", F.octet_length(a)).otherwise(F.levenshtein(a, b))


def osa_distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no substring edited twice."""
    if not a or not b:
        return len((a or b).encode())
    before, last = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def jaro_similarity(a: str, b: str) -> float:
    """Jaro; half the number of characters out of order is rounded down; two equal strings, also empty ones, are 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = 1
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for j, y in enumerate(b) if taken[j]))) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_similarity(a: str, b: str) -> float:
    """Jaro, raised by a tenth of the rest per common leading character, four at most, from 0.7 on."""
    base = jaro_similarity(a, b)
    if base < 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


def _pairwise(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], object] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if None in pair else f(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return run


def osa(a: Column, b: Column) -> Column:
    ship_package(SparkSession.active())
    return _pairwise(osa_distance, "int")(a, b)


def jaro(a: Column, b: Column) -> Column:
    ship_package(SparkSession.active())
    return _pairwise(jaro_similarity, "double")(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    ship_package(SparkSession.active())
    return _pairwise(jaro_winkler_similarity, "double")(a, b)


def similar_terms(vocabulary: DataFrame, words: list[str], threshold: float, n: int | None = None) -> DataFrame:
    """(query, term, distance, similarity, place): terms of the vocabulary at least so similar to each word, best first, ties by term.

    The words (a query's, given by the caller) become literals: one pass over the vocabulary, no join. Terms whose
    length alone rules them out are skipped, and the edit distance stops at the most that is allowed.
    """
    if not words:
        words = []
    wanted = F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(words)]).cast("array<string>"))
    pairs = vocabulary.select("term", wanted.alias("query"))
    longest = F.greatest(F.octet_length("term"), F.octet_length("query"))
    pairs = pairs.where(F.abs(F.octet_length("term") - F.octet_length("query")) <= (1 - threshold) * longest + 1e-9)
    scored = pairs.withColumn("distance", distance(F.col("query"), F.col("term"))).withColumn("similarity", similarity(F.col("query"), F.col("term"))).where(F.col("similarity") >= threshold)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "term"))
    ranked = scored.withColumn("place", place)
    return ranked.where(F.col("place") <= n) if n else ranked
