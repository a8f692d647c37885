import datetime
import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from quernstone.operators.index import SearchIndex
from quernstone.sources import seeds, store
from quernstone.streaming import live

PAGE = store.PAGE


def page(i, text, day=1):
    return (str(i), f"https://a.com/{i}", f"t{i}", text, [], datetime.datetime(2024, 1, day), 0)


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_page_store(spark, tmp_path, kind):
    s = store.PageStore(spark, str(tmp_path / "p"), kind)
    assert s.count() == 0
    s.save(spark.createDataFrame([page(1, "old"), page(2, "two")], PAGE))
    s.save(spark.createDataFrame([page(1, "new", 2), (None, "https://a.com/z", "z", "zz", None, None, 0)], PAGE))
    assert s.count() == 3 and s.get("1").first().content_markdown == "new" and s.get_by_url("https://a.com/z").first().title == "z"
    assert s.existing(spark.createDataFrame([("1",), ("9",)], "id string")).count() == 1
    s.backup(str(tmp_path / "b"))
    s.delete(spark.createDataFrame([("1",)], "id string"))
    assert s.count() == 2 and s.get("1").isEmpty()
    assert store.PageStore(spark, str(tmp_path / "b"), kind).count() == 3


def test_backup_restore_and_schema(spark, tmp_path):
    index = SearchIndex.build(spark.createDataFrame([("1", None, None, "apple")], "doc_id string, url string, title string, content string"))
    index.save(str(tmp_path / "i"))
    store.copy(spark, str(tmp_path / "i"), str(tmp_path / "b"))
    index.delete_document("1").save(str(tmp_path / "i"))
    store.restore(spark, str(tmp_path / "b"), str(tmp_path / "i"))
    assert SearchIndex.load(spark, str(tmp_path / "i")).document_count() == 1
    assert SearchIndex.load(spark, str(tmp_path / "i.before-restore")).document_count() == 0
    with pytest.raises(store.StoreError):
        store.check_schema_version(spark, str(tmp_path / "i"))
    store.write_schema_version(spark, str(tmp_path / "i"))
    store.check_schema_version(spark, str(tmp_path / "i"))
    with pytest.raises(store.StoreError):
        store.copy(spark, str(tmp_path / "absent"), str(tmp_path / "c"))
    assert {r.name: r.rows for r in store.table_counts(a=spark.range(3), b=spark.range(0)).collect()} == {"a": 3, "b": 0}


def test_bodies(spark):
    raw = b"hello"
    deflated = zlib.compressobj(wbits=-15)
    bare = deflated.compress(raw) + deflated.flush()
    cases = [(gzip.compress(raw), "gzip"), (zlib.compress(raw), "deflate"), (bare, "deflate"), (zlib.compress(gzip.compress(raw)), "x-gzip, deflate"), (raw, "br"), (raw, None)]
    assert all(store.decode_body(b, e) == raw for b, e in cases) and store.decode_body(None, "gzip") is None
    rows = spark.createDataFrame(cases, "b binary, e string").select(store.decode_body_column(F.col("b"), F.col("e")).alias("x")).collect()
    assert all(bytes(r.x) == raw for r in rows)


def test_seeds(spark, tmp_path):
    text = "# note\ndefault=Two\n[one]\nhttps://a.com\n# c\n\n[two]\nhttps://b.com\nhttps://c.com\n[none]\n"
    sets, default = seeds.parse_seed_file(text)
    assert sets == {"one": ["https://a.com"], "two": ["https://b.com", "https://c.com"]} and default == "two"
    (tmp_path / "s.txt").write_text(text)
    table, d = seeds.read_seed_file(spark, str(tmp_path / "s.txt"))
    assert table.count() == 3 and d == "two"
    assert seeds.resolve_seeds(["https://x.y"]) == ["https://x.y"]
    assert seeds.resolve_seeds(set_name="general")[0] == "https://example.com"
    assert seeds.resolve_seeds(file_sets=sets, default=d) == sets["two"]
    for bad in (lambda: seeds.parse_seed_file("x"), lambda: seeds.resolve_seeds(["ftp://x"]), lambda: seeds.resolve_seeds(set_name="nope")):
        with pytest.raises(seeds.SeedError):
            bad()
    assert {k: len(v) for k, v in seeds.SEEDS.items()} == {"general": 10, "programming": 18, "academic": 17}
    assert seeds.valid(spark.createDataFrame([(" https://a",), ("x",)], "url string")).count() == 1


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.file, r.text) for r in store.read_markdown_files(spark, str(tmp_path)).collect()] == [("a.md", "# A\nx")]


def test_index_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([page(1, "apple pie"), page(2, "pear")], PAGE).coalesce(1).write.parquet(source)

    def run():
        live.index_stream(spark.readStream.schema(PAGE).parquet(source), path, str(tmp_path / "ck")).awaitTermination()
        return live.LiveIndex(spark, path).load()

    assert run().document_count() == 2
    spark.createDataFrame([page(1, "cherry", 2), page(3, "plum", 2)], PAGE).coalesce(1).write.mode("append").parquet(source)
    index = run()
    assert index.document_count() == 3 and not index.has_term("pie") and index.has_term("cherry")
    again = live.upsert_pages(spark, path)
    again(spark.createDataFrame([page(3, "plum", 2)], PAGE), 7)
    assert live.LiveIndex(spark, path).load().document_count() == 3


def test_stream_urls_and_blocks(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("https://A.com/x/", t), ("https://a.com/x", t), (None, t), ("https://b.com", t)]
    spark.createDataFrame(rows, "url string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "u"))
    for delay, name in ((None, "urls_all"), ("1 hour", "urls_late")):
        stream = live.new_urls(spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "u")), delay)
        stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() == 2
    events = [("h", t + datetime.timedelta(seconds=s)) for s in (0, 100, 200, 5000)] + [(None, t)]
    spark.createDataFrame(events, "domain string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    states = live.block_states(spark.readStream.schema("domain string, ts timestamp").parquet(str(tmp_path / "e")))
    states.writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "bc")).trigger(availableNow=True).start().awaitTermination()
    assert [r.backoff for r in spark.table("blocks").orderBy("ts").collect()] == [300, 600, 1200, 300]
