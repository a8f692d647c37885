import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import codec, fuzzy

words = st.text("abcdé", max_size=8)


def lev(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.distance(F.col("a"), F.col("b")).alias("d"), fuzzy.similarity(F.col("a"), F.col("b")).alias("s")).first()


@pytest.mark.parametrize("a, b, d", [("hello", "hello", 0), ("", "", 0), ("", "hello", 5), ("cat", "bat", 1), ("cat", "cats", 1), ("kitten", "sitting", 3), ("abc", "xyz", 3), ("algorithm", "alogrithm", 2), ("Hello", "hello", 1), ("café", "cafe", 1), ("ab", "ba", 2), ("longerstring", "short", 10)])
def test_levenshtein(spark, a, b, d):
    assert lev(spark, a, b).d == d


@pytest.mark.parametrize("a, b, s", [("x", "x", 1), ("", "", 1), ("", "hello", 0), ("cat", "bat", 2 / 3), ("test", "tent", 0.75), ("abc", "xyz", 0), ("kitten", "sitting", 1 - 3 / 7)])
def test_similarity(spark, a, b, s):
    assert lev(spark, a, b).s == pytest.approx(s)


@pytest.mark.parametrize("a, b, d", [("cat", "bat", 1), ("kitten", "sitting", 3), ("ab", "ba", 1), ("ca", "ac", 1), ("recieve", "receive", 1), ("abcd", "badc", 2), ("algorithm", "alogrithm", 1), ("ca", "abc", 3)])
def test_osa(a, b, d):
    assert fuzzy.osa_distance(a, b) == d


@pytest.mark.parametrize("a, b, s", [("", "", 1), ("", "hello", 0), ("abcd", "wxyz", 0), ("MARTHA", "MARHTA", 0.9444), ("DWAYNE", "DUANE", 0.8222), ("DIXON", "DICKSONX", 0.7667), ("test", "text", 0.8333)])
def test_jaro(a, b, s):
    assert fuzzy.jaro_similarity(a, b) == pytest.approx(s, abs=1e-3)


@pytest.mark.parametrize("a, b, s", [("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133), ("testing", "test", 0.9143), ("precise", "precis", 0.9714), ("abc", "xyz", 0)])
def test_jaro_winkler(a, b, s):
    assert fuzzy.jaro_winkler_similarity(a, b) == pytest.approx(s, abs=1e-3)


@settings(max_examples=60, deadline=None)
@given(words, words, words)
def test_properties(a, b, c):
    d = fuzzy.osa_distance
    assert d(a, b) == d(b, a) >= 0 and d(a, a) == 0
    assert 0 <= fuzzy.jaro_similarity(a, b) <= fuzzy.jaro_winkler_similarity(a, b) <= 1
    assert fuzzy.jaro_similarity(a, b) == pytest.approx(fuzzy.jaro_similarity(b, a))


@pytest.mark.parametrize("q, t, n, size, first", [("apple", 0.5, 5, 4, "apple"), ("appl", 0.5, 5, 4, "apple"), ("apple", 0.9, 5, 1, "apple"), ("apple", 0.1, 10, 7, "apple"), ("appl", 0.3, 2, 2, "apple"), ("xyz", 0.5, 5, 0, None), ("a", 0.1, 5, 5, "ape")])
def test_similar_terms(spark, q, t, n, size, first):
    vocabulary = spark.createDataFrame([(w,) for w in "apple application apply ape orange banana applet".split()], "term string")
    rows = fuzzy.similar_terms(vocabulary, [q], t, n).orderBy("place").collect()
    assert len(rows) == size and (not rows or rows[0].term == first)


def test_columns(spark):
    rows = spark.createDataFrame([("MARTHA", "MARHTA"), (None, "x")], "a string, b string")
    assert [r.x for r in rows.select(fuzzy.jaro(F.col("a"), F.col("b")).alias("x")).collect()][0] == pytest.approx(0.9444, abs=1e-3)
    assert rows.select(fuzzy.osa(F.col("a"), F.col("b")).alias("x")).first().x == 1
    assert rows.select(fuzzy.jaro_winkler(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(0.9611, abs=1e-3)


@pytest.mark.parametrize("values", [[5], [127], [128], [16383], [2097151], [1, 2, 3, 4, 5], [5, 128, 3, 16384, 1], [1, 5, 12, 100, 500]])
def test_ints(values):
    assert codec.decode_ints(codec.encode_ints(values)) == values


def test_ints_edges():
    assert codec.encode_ints([]) == codec.encode_ints(None) == b"" and codec.decode_ints(None) == []
    assert codec.encode_ints([128]) == b"\x80\x01"
    with pytest.raises(codec.CodecError):
        codec.decode_ints(b"\x80")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=6), st.lists(st.integers(0, 2**32 - 1), max_size=5)), max_size=5))
def test_postings_round_trip(rows):
    postings = [(d, len(p), p) for d, p in rows]
    assert codec.decode_postings(codec.encode_postings(postings)) == postings


@pytest.mark.parametrize("data", [b"\x01", b"\x00\x01", b"\x00\x01\x04d"])
def test_postings_truncated(data):
    with pytest.raises(codec.CodecError):
        codec.decode_postings(data)


def test_hash_and_sizes(spark):
    assert [codec.id_hash(x) for x in ("", "doc1", "doc2", "abc")] == [0, 3088889, 3088890, 96354]
    rows = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (7, 10), (10, 15), (100, 150)], "n int, want int")
    assert all(r.x == r.want for r in rows.select("want", codec.estimated_size(F.col("n")).alias("x")).collect())
    ratios = spark.createDataFrame([(0, 100, 1.0), (1000, 500, 0.5), (1000, 1200, 1.2), (4000, 1000, 0.25)], "a int, b int, want double")
    assert all(r.x == pytest.approx(r.want) for r in ratios.select("want", codec.compress_ratio(F.col("a"), F.col("b")).alias("x")).collect())
    numbers = [0, 1, 127, 128, 2**14 - 1, 2**14, 2**40, 2**62]
    sized = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", codec.int_size(F.col("n")).alias("s")).collect()
    assert all(r.s == len(codec.encode_ints([r.n])) for r in sized)
