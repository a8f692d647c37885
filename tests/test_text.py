import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.functions.text import TokenizerConfig, driver_terms

CASES = [
    ("Hello World", ["hello", "world"]),
    ("Hello, World!", ["hello", "world"]),
    ("Hello   World", ["hello", "world"]),
    ("", []),
    (None, []),
    ("the quick brown fox", ["quick", "brown", "fox"]),
    ("GOLANG", ["golang"]),
    ("Café", ["caf"]),
    ("a 42 b2b x", ["b2b"]),
    ("don't", []),
    ("state-of-the-art", ["state-of-the-art"]),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", CASES)
def test_terms(spark, given, want):
    assert one(spark, text.term_array(F.col("t")), t=given) == want
    assert driver_terms(given or "") == want


def test_stopwords():
    assert len(text.STOPWORDS) == 174
    config = TokenizerConfig().with_stopword("Fox").without_stopword("the")
    assert driver_terms("the fox ran", config) == ["the", "ran"]
    assert config.is_stopword("FOX") and not config.is_stopword("the")


def test_markdown_text(spark):
    md = "# Title\n\nThis is **bold** text and [a link](https://a.b/c).\n\n```go\nfmt.Println(\"hello\")\n```\n<https://x.y/z>"
    found = one(spark, text.markdown_text(F.col("t")), t=md)
    for part in ("Title", "This is", "bold", "text", "a link", 'fmt.Println("hello")'):
        assert part in found
    assert "https://" not in found and "```" not in found
    assert one(spark, text.markdown_text(F.col("t")), t="  \n ") == ""


def test_html(spark):
    html = "<html><head><title> A <b>b</b>\n c</title><script>var x</script></head><BODY class=x><h1>Welcome</h1><script>bad()</script> <p>to you</p></body></html>"
    assert one(spark, text.html_title(F.col("t")), t=html) == "A b c"
    assert one(spark, text.html_text(F.col("t")), t=html) == "Welcome to you"
    title, body = text.page_text(F.col("t"), F.col("u"))
    assert one(spark, title, t="<p>x</p>", u="::bad") == "::bad"
    assert one(spark, body, t="", u="http://a") == "http://a"


def test_normalize_markdown(spark):
    assert one(spark, text.normalize_markdown(F.col("t")), t="a  \r\nb\r\n\r\n\r\n\r\nc\n") == "a\nb\n\nc"


def test_sanitize(spark):
    assert one(spark, text.sanitize(F.col("t")), t="<b>a</b> & <script>x</script>'q'") == "a &amp; &#39;q&#39;"


def test_snippets(spark):
    long = "word " * 60 + "here is a test phrase inside " + "tail " * 60
    found = one(spark, text.snippet(F.col("t"), ["test", "phrase"], 140), t=long)
    assert "test phrase" in found and found.startswith("...") and found.endswith("...")
    none = one(spark, text.snippet(F.col("t"), ["absent"], 140), t=long)
    assert long.startswith(none[:-3]) and none.endswith("...")
    assert one(spark, text.snippet(F.col("t"), [], 140), t="  ") == ""
    assert "TEST" in one(spark, text.phrase_snippet(F.col("t"), "test p"), t=long.replace("test p", "TEST P"))
    assert one(spark, text.title_snippet(F.col("t")), t="x" * 201) == "x" * 200 + "..."


def test_clean_markdown(spark):
    md = "[a](b) text\n\n---\n404\nWas this helpful?\nhttp http http http\n\n\n\nend"
    assert one(spark, text.clean_markdown(F.col("t")), t=md) == "a text\n\nend"


def test_title_from_content(spark):
    assert one(spark, text.title_from_content(F.col("t"), F.col("f")), t="x\n## Head \ny", f="a-b.md") == "Head"
    assert one(spark, text.title_from_content(F.col("t"), F.col("f")), t="x", f="a-b.md") == "A B"
