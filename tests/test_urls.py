import pytest
from pyspark.sql import functions as F

from quernstone.functions import urls


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://Example.COM:443/a/b/#top", "https://example.com/a/b"),
        ("http://a.com:80/", "http://a.com/"),
        ("http://a.com", "http://a.com"),
        ("http://a.com:8080/x//?q=A/", "http://a.com:8080/x/?q=A/"),
        ("::bad", "::bad"),
        (None, None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "link, want",
    [
        ("/about", "https://e.com/about"),
        ("//h.com/p", "https://h.com/p"),
        ("c", "https://e.com/a/c"),
        ("../c?x=1", "https://e.com/c?x=1"),
        ("./c", "https://e.com/a/c"),
        ("/x/../../y/./z", "https://e.com/y/z"),
        ("?q=2", "https://e.com/a/b?q=2"),
        ("mailto:a@b", None),
        ("HTTP://o.com/", "HTTP://o.com/"),
    ],
)
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve(F.col("l"), F.col("p")), l=link, p="https://e.com/a/b?q=1") == want


def test_links(spark):
    html = """<a href="/about">x</a> <A class=k HREF='https://external.example/path#f'>y</A> <a href="/about">z</a> <a href="mailto:q">m</a>"""
    assert one(spark, urls.anchor_links(F.col("h"), F.col("p")), h=html, p="https://example.com/store") == ["https://example.com/about", "https://external.example/path"]
    script = r"""{"a":"/product/lip-gloss-P123?skuId=1","b":"\/shop\/fragrance-value-sets-gifts","c":"https://e.com/x","d":"/contentimages/a.png","e":"/js/app.js","f":"/x/y.svg"}"""
    assert one(spark, urls.embedded_links(F.col("h"), F.col("p")), h=script, p="https://e.com/") == ["https://e.com/product/lip-gloss-P123?skuId=1", "https://e.com/shop/fragrance-value-sets-gifts", "https://e.com/x"]


@pytest.mark.parametrize("text, want", [("example.com", "example.com"), ("https://Example.COM/products", "example.com"), ("example.com.", "example.com"), ("www.example.com:8443", "www.example.com")])
def test_domain_input(text, want):
    assert urls.normalize_domain(text) == want


@pytest.mark.parametrize("text", ["", "  ", "http:///path"])
def test_domain_input_refused(text):
    with pytest.raises(ValueError):
        urls.normalize_domain(text)


def test_hosts(spark):
    names = ["example.com", "www.example.com", "blog.api.Example.com", "example.com.", "fakeexample.com", "example.org", ""]
    rows = spark.createDataFrame([(n,) for n in names], "h string")
    assert [r.m for r in rows.select(urls.host_matches(F.col("h"), "example.com").alias("m")).collect()] == [True, True, True, True, False, False, False]
    assert [r.m for r in rows.select(urls.in_domains(F.col("h"), []).alias("m")).collect()] == [True] * 7


def test_names(spark):
    u, i = F.col("u"), F.col("i")
    assert one(spark, urls.export_name(u, i), u="https://e.com/Products/Lip Gloss/", i="abcdef1234567890") == "products-lip-gloss-abcdef123456.md"
    assert one(spark, urls.export_name(u, i), u="https://e.com/", i="abc") == "index-abc.md"
    assert one(spark, urls.export_name(u, i), u="https://e.com/", i="") == "index-unknown.md"
    assert one(spark, urls.host_label(u), u="https://www.Example-Site.co/") == "examplesite"
    assert one(spark, urls.url_depth(u), u="https://a.com/b/c?d=/e") == 3
    assert one(spark, urls.url_depth(u), u="a/b") == 0
    assert one(spark, urls.text_like(u), u="Text/HTML; charset=x") and one(spark, urls.text_like(u), u="") and not one(spark, urls.text_like(u), u="image/png")
    assert not one(spark, urls.navigable(u), u="https://e.com/Images/x.svg") and one(spark, urls.navigable(u), u="https://e.com/a.html")
    assert one(spark, urls.disallowed(u, ["/a"]), u="/ab") and not one(spark, urls.disallowed(u, []), u="/ab")
