import json

import pytest
from pyspark.sql import functions as F

from quernstone.api import SearchAPI
from quernstone.functions import codec
from quernstone.operators import cluster, rank
from quernstone.operators.index import SearchIndex
from quernstone.operators.search import Searcher
from quernstone.session import spread

PAGE = "id string, url string, title string, content_markdown string, links array<string>, crawled_at timestamp, depth int"


def test_requests(spark, tmp_path):
    pages = spark.createDataFrame([("1", "https://a.b/", "<b>One</b>", "apple pie", [], None, 0), ("2", "https://a.b/2", None, "apple", [], None, 0)], PAGE)
    api = SearchAPI(Searcher(SearchIndex.build_pages(pages)), str(tmp_path / "i"), pages)
    status, body = api.handle("GET", "/api/v1/search", {"q": "apple", "limit": "1"})
    found = json.loads(body)
    assert status == 200 and found["total"] == 2 and len(found["results"]) == 1
    assert json.loads(api.handle("POST", "/api/v1/search", {"query": "pie"})[1])["results"][0]["title"] == "One"
    assert "plan" in json.loads(api.search("apple", explain=True))
    assert json.loads(api.handle("GET", "/api/v1/stats")[1])["documents"] == 2 and json.loads(api.handle("GET", "/health")[1])["indexed"]
    assert json.loads(api.handle("POST", "/api/v1/index/rebuild")[1]) == {"documents": 2}
    assert [api.handle(*x)[0] for x in (("GET", "/x"), ("DELETE", "/health"), ("GET", "/api/v1/search", {"q": " "}), ("GET", "/api/v1/search", {"q": "a", "limit": "0"}), ("GET", "/api/v1/search", {"zzz": 1}))] == [404, 405, 400, 400, 400]


def test_vectors(spark):
    index = SearchIndex.build(spark.createDataFrame([("1", None, None, "apple banana"), ("2", None, None, "banana cherry"), ("3", None, None, "date")], "doc_id string, url string, title string, content string"))
    assert {r.term: r.weight for r in rank.query_vector(index, ["apple", "apple", "zzz"]).collect()} == pytest.approx({"apple": 2 * 1.0986122887})
    v = rank.document_vectors(index)
    got = {(r.doc_id, r.other): r.cosine for r in rank.cosine_similarity(v, v.where("doc_id = '1'")).collect()}
    assert got["1", "1"] == pytest.approx(1) and 0 < got["2", "1"] < 1 and ("3", "1") not in got
    zero = v.withColumn("weight", F.lit(0.0))
    assert all(r.cosine == 0 for r in rank.cosine_similarity(zero, zero).collect())


def test_small_things(spark):
    assert codec.decode_ints(codec.encode_ids(["doc1", "abc"])) == [3088889, 96354] and codec.encode_ids(None) == b""
    files = spark.createDataFrame([("a-b.md", "# Head\n" + "word here stands " * 40), ("c.md", "short")], "file string, text string")
    assert [(r.doc_id, r.title) for r in cluster.prepared(files).collect()] == [("a-b.md", "Head")]
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4 and spread(spark.range(0, 10, 1, 4)).rdd.getNumPartitions() == 4
