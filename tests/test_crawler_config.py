import gzip

import pytest

from quernstone.config import Config, ConfigError
from quernstone.functions.html import html_to_markdown
from quernstone.operators.cluster import describe, report
from quernstone.operators.index import SearchIndex, open_or_build
from quernstone.sources.crawler import crawl
from quernstone.streaming.live import LiveIndex

SITE = {
    "https://s.test/": '<html><head><title>Home</title><script>x</script></head><body><nav><a href="/nav">n</a></nav><main><h1>Welcome</h1><p>A page with <b>bold</b> words and <a href="/a#x">a link</a>.</p></main><a href="/deep/1">d</a></body></html>',
    "https://s.test/a": '<body><p>Second page</p><a href="https://s.test/b">b</a><a href="/x.png">p</a><a href="https://other.test/">o</a><script>{"u":"/from-script"}</script></body>',
    "https://s.test/b": "<body>third <a href='/c'>c</a></body>",
    "https://s.test/c": "<body>fourth</body>",
    "https://s.test/nav": "<body>nav</body>",
    "https://s.test/from-script": "<body>script</body>",
}


def of_site(site):
    def get(url):  # nested, so that it is sent by value
        if url not in site:
            raise OSError(url)
        return 200, {"content-type": "text/html", "content-encoding": "gzip"}, gzip.compress(site[url].encode())

    return get


fetch = of_site(SITE)


def test_markdown():
    html = SITE["https://s.test/"]
    got = html_to_markdown(html, "https://s.test/")
    assert got == "# Welcome\n\nA page with **bold** words and [a link](https://s.test/a#x)."
    rest = html_to_markdown("<h2>T</h2><ul><li>one<li>two</ul><ol><li>x</li></ol><pre>a  b\n c</pre><p>q <code>k</code><br>z</p><table><tr><td>1</td><td>2</td></tr></table><img src='/i.png' alt='A'>", "https://s.test/")
    for part in ("## T", "- one", "- two", "1. x", "```\na  b\n c\n```", "q `k`\nz", "| 1 | 2 |", "![A](https://s.test/i.png)"):
        assert part in rest
    assert html_to_markdown("", None) == html_to_markdown(None, None) == ""
    html_to_markdown("<div><p><b>broken </i></div></div> <a href=''>x", "::bad")


def test_crawl(spark):
    pages, log = crawl(spark, ["https://S.test/"], fetch, max_depth=1, allow=["s.test"])
    assert {r.url for r in pages.collect()} == {"https://s.test/", "https://s.test/a", "https://s.test/nav"}
    assert {(r.url, r.status) for r in log.collect()} >= {("https://s.test/deep/1", 0), ("https://s.test/a", 200)}
    pages, _ = crawl(spark, ["https://s.test/"], fetch, max_depth=3, allow=["s.test"], disallow=["/nav"])
    assert {r.url for r in pages.collect()} == {"https://s.test/", "https://s.test/a", "https://s.test/b", "https://s.test/c", "https://s.test/from-script"}
    _, log = crawl(spark, ["https://s.test/"], fetch, max_depth=3, budget=2)
    assert log.count() == 2
    pages, log = crawl(spark, [], fetch)
    assert pages.count() == log.count() == 0


def test_open_or_build(spark, tmp_path):
    pages, _ = crawl(spark, ["https://s.test/"], fetch, max_depth=0)
    index = open_or_build(spark, str(tmp_path / "i"), pages)
    assert index.has_term("welcome") and open_or_build(spark, str(tmp_path / "i"), pages.limit(0)).document_count() == 1
    assert open_or_build(spark, str(tmp_path / "i"), pages.limit(0), rebuild=True).document_count() == 0


def test_live_index(spark, tmp_path):
    def batch(*rows):
        return SearchIndex.build(spark.createDataFrame([(i, None, None, t) for i, t in rows], "doc_id string, url string, title string, content string"))

    live = LiveIndex(spark, str(tmp_path / "live"))
    live.append(batch(("1", "apple"), ("2", "pear")), 0)
    live.append(batch(("1", "cherry")), 1)
    live.append(batch(("1", "cherry")), 1)
    for _ in range(2):
        index = live.load()
        assert index.document_count() == 2 and not index.has_term("apple") and index.get_postings("cherry").first().tf == 1
        live.compact()


def test_config(tmp_path, monkeypatch):
    c = Config(data_dir="/d")
    assert c.index_path == "/d/index" and c.pages_path == "/d/pages"
    c.save(str(tmp_path / "c.json"))
    monkeypatch.setenv("QUERNSTONE_MAX_DEPTH", "5")
    monkeypatch.setenv("QUERNSTONE_NO_CACHE", "true")
    loaded = Config.load(str(tmp_path / "c.json"), max_workers=7, max_depth=None)
    assert (loaded.data_dir, loaded.max_depth, loaded.no_cache, loaded.max_workers) == ("/d", 5, True, 7)
    assert Config.load(max_depth=2).max_depth == 2
    for bad in ({"max_workers": 0}, {"max_workers": 101}, {"crawl_delay_ms": -1}, {"max_depth": "x"}, {"nothing": 1}, {"data_dir": ""}):
        with pytest.raises(ConfigError):
            Config.load(**bad)
    with pytest.raises(ConfigError):
        Config.load(str(tmp_path / "absent.json"))


def test_report(spark):
    docs = spark.createDataFrame([(i, f"# Title {i}\nYou must install the tool number {i} before the first run of it. It is good.") for i in range(12)], "doc_id bigint, text string")
    row = report(describe(docs, docs.selectExpr("doc_id", "1 as cluster"))).first()
    for part in ("=== Title 0 ===", "TOPIC: Installation", "DOCUMENTS: 12", "• ", "... and 2 more"):
        assert part in row.text
