import pytest

from quernstone.plans.query import BooleanQuery, QueryType, SearchConfig, cache_key, normalize_query, parse, query_signals, snippet_terms

RAW = SearchConfig(plain_not=False)


@pytest.mark.parametrize(
    "text, kind, must, should, bad",
    [
        ("apple OR banana", QueryType.BOOLEAN, [], ["apple", "banana"], []),
        ("apple NOT banana", QueryType.BOOLEAN, ["apple"], [], ["banana"]),
        ("apple AND banana OR cherry NOT date", QueryType.BOOLEAN, [], ["apple", "banana", "cherry"], ["date"]),
        ("apple -banana", QueryType.BOOLEAN, ["apple"], [], ["banana"]),
        ("-foo bar", QueryType.BOOLEAN, ["bar"], [], ["foo"]),
        ("cat NOT Foo", QueryType.BOOLEAN, ["cat"], [], ["foo"]),
        ("-", QueryType.BOOLEAN, [], [], []),
        ("apple OR  OR banana", QueryType.BOOLEAN, [], ["apple", "banana"], []),
    ],
)
def test_boolean(text, kind, must, should, bad):
    q = parse(text)
    assert (q.type, q.boolean.must, q.boolean.should, q.boolean.must_not) == (kind, must, should, bad)
    assert q.ranking_terms() == must + should


def test_raw_operands():
    assert parse("cat NOT Foo", RAW).boolean.must_not == ["Foo"]
    assert parse("-foo bar", RAW).boolean.must == ["foo", "bar"]


def test_others():
    assert parse("apple").terms == ["apple"] and parse("apple AND banana").terms == ["apple", "banana"] and parse("apple AND banana").type is QueryType.TERM
    p = parse('"Quick Fox"')
    assert p.type is QueryType.PHRASE and p.terms == ["quick", "fox"] and p.phrase == "Quick Fox"
    f = parse("Golang~1")
    assert f.type is QueryType.FUZZY and f.fuzzy_term == "Golang"
    assert parse("").type is QueryType.TERM and parse("  ").terms == []
    assert parse('"a b"', SearchConfig(phrases=False)).type is QueryType.TERM
    assert parse("a~", SearchConfig(fuzzy=False)).type is QueryType.TERM
    assert BooleanQuery().is_empty() and not BooleanQuery(["x"]).is_empty()
    copy = (q := BooleanQuery(["x"])).copy()
    copy.must.append("y")
    assert q.must == ["x"]


def test_helpers():
    assert normalize_query("  A  b ") == "a b" and cache_key("A  b") == cache_key("a b")
    assert query_signals(["Exa-mple", "site", "site"]) == ["example", "site", "examplesitesite"]
    assert snippet_terms("apple OR banana OR apple") == ["apple", "banana"]
    with pytest.raises(ValueError):
        SearchConfig(fuzzy_threshold=2)
