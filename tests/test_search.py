import pytest
from pyspark.sql import functions as F

from quernstone.operators import rank, retrieve
from quernstone.operators.index import NotFound, SearchIndex, from_tables
from quernstone.operators.search import ResultCache, Searcher, domain_export, export_summary, page_bounds, rank_all, total_pages, write_export
from quernstone.plans.query import BooleanQuery, SearchConfig

DOC = "doc_id string, url string, title string, content string"
PAGE = "id string, url string, title string, content_markdown string, links array<string>, crawled_at timestamp, depth int"


def index(spark, rows):
    return SearchIndex.build(spark.createDataFrame([(i, u, t, c) for i, u, t, c in rows], DOC))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def fruit(spark):
    return index(spark, [("1", None, "A", "apple banana"), ("2", None, "B", "banana cherry"), ("3", None, "C", "apple cherry date")])


def test_boolean(fruit):
    found = lambda **q: ids(retrieve.boolean_documents(fruit.postings, BooleanQuery(**q)))
    assert found(must=["apple"]) == ["1", "3"]
    assert found(must=["apple", "banana"]) == ["1"]
    assert found(should=["banana", "date"]) == ["1", "2", "3"]
    assert found(must=["apple"], must_not=["date"]) == ["1"]
    assert found(must=["apple", "banana"], should=["date"]) == ["1", "3"]
    assert found(must_not=["date"]) == [] and found(must=["apple", "absent"]) == []


def test_tfidf(fruit):
    scores = {r.doc_id: r.score for r in rank.tfidf_scores(fruit, ["apple"]).collect()}
    assert set(scores) == {"1", "3"} and scores["1"] == pytest.approx(0.405, abs=1e-3)
    twice = {r.doc_id: r.score for r in rank.tfidf_scores(fruit, ["apple", "apple"]).collect()}
    assert twice["1"] == pytest.approx(2 * scores["1"])
    assert rank.tfidf_scores(fruit, []).collect() == []


def test_index_lookups(fruit):
    assert fruit.document_count() == 3 and fruit.term_count() == 4 and fruit.has_term("Apple") and not fruit.has_term("x") and fruit.has_document("1")
    with pytest.raises(NotFound):
        fruit.get_postings("nothing")
    with pytest.raises(NotFound):
        fruit.get_doc_info("9")
    with pytest.raises(NotFound):
        fruit.delete_document("9")
    stats = fruit.stats().first()
    assert (stats.documents, stats.terms, stats.postings) == (3, 4, 7) and stats.avg_postings == pytest.approx(1.75)


def test_delete_upsert_merge(spark, fruit):
    gone = fruit.delete_document("3")
    assert not gone.has_term("date") and gone.document_count() == 2
    new = index(spark, [("1", None, "", "elder elder"), ("4", None, "", "apple")])
    upserted = fruit.upsert(new)
    assert upserted.document_count() == 4 and ids(upserted.get_postings("apple")) == ["3", "4"] and upserted.get_postings("elder").first().tf == 2
    merged = fruit.merge(index(spark, [("1", None, "", "apple pie")]))
    row = merged.get_postings("apple").where("doc_id = '1'").first()
    assert row.tf == 2 and row.positions == [0, 0] and merged.get_doc_info("1").first().token_count == 2


def test_validate_and_tables(spark):
    postings = spark.createDataFrame([("a", "1", [0, 2, 2], None), ("a", "1", [0], 9), ("b", "7", [1], 1), (None, "1", [1], 1), ("c", "1", None, 1)], "term string, doc_id string, positions array<int>, tf int")
    info = spark.createDataFrame([("1", 5), ("2", 0), (None, 1)], "doc_id string, token_count int").selectExpr("doc_id", "null url", "null title", "token_count", "1 length", "cast(null as timestamp) indexed_at")
    stored = from_tables(postings, info)
    assert stored.postings.where("doc_id = '1'").first().positions == [0, 2]
    assert {(r.problem, r.doc_id, r.n) for r in stored.validate().collect()} == {("orphan_posting", "7", 1), ("no_terms", "2", 0)}


def test_save_and_load(spark, fruit, tmp_path):
    fruit.save(str(tmp_path / "i"))
    fruit.delete_document("3").save(str(tmp_path / "j"))
    again = SearchIndex.load(spark, str(tmp_path / "i"))
    assert again.document_count() == 3 and ids(again.get_postings("date")) == ["3"]
    assert not SearchIndex.load(spark, str(tmp_path / "j")).has_term("date")


def test_empty_index(spark):
    empty = SearchIndex.build(spark.createDataFrame([], DOC))
    assert empty.stats().first().avg_postings == 0 and empty.validate().collect() == []
    assert Searcher(empty).search("x").collect() == [] and rank.bm25_scores(empty, ["x"]).collect() == []


def test_searcher(spark):
    i = index(spark, [("1", None, "Go Guide", "Go is a statically typed language"), ("2", None, "Python Guide", "Python is a dynamic language"), ("3", None, "Rust Guide", "Rust is a systems language")])
    s = Searcher(i)
    assert ids(s.search("Go")) == ["1"] and s.total("statically AND typed") == 1
    assert ids(s.search('"dynamic language"')) == ["2"] and ids(s.search('"language dynamic"')) == []
    assert ids(Searcher(i, SearchConfig(exact_phrases=False)).search('"language dynamic"')) == ["2"]
    assert ids(s.search("pytho~")) == ["2"]
    assert s.suggest("pyhton") == ["python"]
    one = s.search("language", limit=1, offset=1).collect()
    assert [r.position for r in one] == [2] and s.search("language", limit=5, offset=9).collect() == []
    assert [r.position for r in s.search("language", limit=0).orderBy("position").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        s.item("language", 0, spark.createDataFrame([], PAGE))
    with pytest.raises(NotFound):
        s.item("language", 9, spark.createDataFrame([], PAGE))
    assert '"rank' not in s.item("Go", 1, spark.createDataFrame([], PAGE)).first().json
    assert ids(Searcher(i, SearchConfig(max_results=2)).search("language", limit=0)) == ["1", "2"]


def test_cache(spark):
    i = index(spark, [("1", None, "t", "apple")])
    s = Searcher(i, cache=ResultCache())
    first = s.search("Apple")
    assert s.search("apple ") is not None and s.cache.stats()["entries"] >= 1
    assert s.search("Apple") is first
    s.cache.seconds = -1
    s.cache.put("q", first)
    assert s.cache.get("q") is None
    s.cache.clear()
    assert s.cache.stats()["entries"] == 0


def test_navigation(spark):
    i = index(
        spark,
        [
            ("home", "https://examplesite.com/", "Example Site", "examplesite official store"),
            ("product", "https://examplesite.com/products/test-item", "Test Item - Example Site", "examplesite test item"),
            ("other", "https://other.com/examplesite-review", "ExampleSite Review", "examplesite review"),
        ],
    )
    assert Searcher(i).search("examplesite").orderBy("position").first().doc_id == "home"


def test_boosts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), (None,), ("2020-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    found = [r.b for r in rows.select(rank.freshness_boost(F.col("t"), F.lit("2024-01-16").cast("timestamp"), 0.1, 30).alias("b")).collect()]
    assert found == [pytest.approx(0.05), 0, 0]
    assert spark.range(1).select(rank.squash(F.lit(-1.0)).alias("x")).first().x == 0


def test_near_and_phrase(spark):
    i = index(spark, [("1", None, "", "alpha beta gamma alpha zeta beta"), ("2", None, "", "beta alpha")])
    a, b = (i.postings.where(F.col("term") == t) for t in ("alpha", "beta"))
    assert sorted((r.doc_id, r.pos) for r in retrieve.near(a, b, 0).collect()) == [("1", 0)]
    assert sorted((r.doc_id, r.pos) for r in retrieve.near(a, b, 1).collect()) == [("1", 0), ("1", 3)]
    assert [(r.doc_id, r.pos) for r in retrieve.phrase_positions(i.postings, ["alpha", "beta", "gamma"]).collect()] == [("1", 0)]
    assert retrieve.phrase_positions(i.postings, []).collect() == []


def test_pages():
    assert [total_pages(n, 10) for n in (0, 7, 20, 21)] == [1, 1, 2, 3]
    assert page_bounds(0, 10, 0) == (0, 0) and page_bounds(7, 10, 0) == (0, 7) and page_bounds(20, 10, 1) == (10, 20) and page_bounds(21, 10, 2) == (20, 21) and page_bounds(21, 10, 9) == (20, 21)


def test_rank_all_equals_sort(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score"))
    got = {r.doc_id: r.position for r in rank_all(rows, 5).collect()}
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id))
    assert [got[r.doc_id] for r in want] == list(range(1, 501))


def test_export(spark, tmp_path):
    pages = spark.createDataFrame([("1", "https://a.example.com/x", "t", "one", None, None, 0), ("2", "https://example.com/", "t", "two", None, None, 0), ("3", "https://other.org/", "t", "three", None, None, 0)], PAGE)
    info = spark.createDataFrame([("1", "https://a.example.com/x"), ("2", "https://example.com/"), ("3", "https://other.org/"), ("4", "https://example.com/gone")], "doc_id string, url string")
    export = domain_export(info, pages, "Example.com")
    assert {r.file_name for r in export.collect()} == {"x-1.md", "index-2.md", "gone-4.md"}
    assert export_summary(export).first().asDict() == {"matched": 3, "written": 2, "skipped_missing": 1}
    write_export(export, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(NotFound):
        write_export(domain_export(info, pages, "absent.net"), str(tmp_path / "none"))


def test_content_snippets(spark):
    pages = spark.createDataFrame([("1", "https://a.b/", "t", "# Head\n" + "word " * 100 + "needle here", ["https://a.b/c"], None, 0)], PAGE)
    i = SearchIndex.build_pages(pages)
    s = Searcher(i)
    assert "needle" in s.with_content_snippets("needle", s.search("needle"), pages).first().snippet
