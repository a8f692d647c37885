"""Query strings into plans: term, phrase, boolean and fuzzy queries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from quernstone.functions.text import DEFAULT, TokenizerConfig, driver_terms


class QueryType(str, Enum):
    TERM = "term"
    PHRASE = "phrase"
    BOOLEAN = "boolean"
    FUZZY = "fuzzy"


@dataclass
class BooleanQuery:
    """Documents with all of ``must`` or any of ``should``, without any of ``must_not``."""

    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (self.must or self.should or self.must_not)

    def copy(self) -> BooleanQuery:
        return BooleanQuery(list(self.must), list(self.should), list(self.must_not))


@dataclass(frozen=True)
class SearchConfig:
    """Switches of parsing and searching. ``plain_not``: operands of NOT are tokenized like other terms; without it they
    are taken as typed, so that upper case or several words exclude nothing. ``fuzzy_ranks_matches``: a fuzzy query is
    ranked by the terms it matched instead of the term as typed."""

    phrases: bool = True
    fuzzy: bool = True
    booleans: bool = True
    exact_phrases: bool = True
    plain_not: bool = True
    fuzzy_ranks_matches: bool = True
    fuzzy_threshold: float = 0.7
    fuzzy_terms: int = 10
    max_results: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.fuzzy_threshold <= 1 or self.fuzzy_terms < 0 or self.max_results < 0:
            raise ValueError("fuzzy_threshold must lie in 0..1, counts must not be negative")


@dataclass(frozen=True)
class ParsedQuery:
    type: QueryType
    terms: list[str]
    original: str
    boolean: BooleanQuery | None = None
    phrase: str = ""
    fuzzy_term: str = ""

    def ranking_terms(self) -> list[str]:
        return [*self.boolean.must, *self.boolean.should] if self.boolean else self.terms


def normalize_query(text: str) -> str:
    return " ".join(text.split()).lower()


def cache_key(text: str) -> str:
    return f"search:{normalize_query(text)}"


_OR = re.compile(r" or ", re.I)
_NOT = re.compile(r" not | -|^-", re.I)


def parse(text: str, config: SearchConfig = SearchConfig(), tokens: TokenizerConfig = DEFAULT) -> ParsedQuery:
    """Precedence: phrase (in double quotes), fuzzy (has ~), boolean (OR, NOT or a hyphen), term.

    Several OR groups flatten: all terms of all groups are alternatives. An empty group adds nothing.
    A leading hyphen with ``plain_not`` excludes the operand; without it the text behind counts as wanted.
    """
    text = text.strip()
    if not text:
        return ParsedQuery(QueryType.TERM, [], text)
    if config.phrases and len(text) >= 2 and text[0] == text[-1] == '"':
        return ParsedQuery(QueryType.PHRASE, driver_terms(text[1:-1], tokens), text, phrase=text[1:-1])
    if config.fuzzy and "~" in text:
        term = text.split("~")[0].strip()
        return ParsedQuery(QueryType.FUZZY, [term], text, fuzzy_term=term)
    if config.booleans and (_OR.search(text) or "-" in text or re.search(" not ", text, re.I)):
        query = BooleanQuery()
        groups = _OR.split(text)
        for group in groups:
            wanted, *unwanted = _not_parts(group.strip(), config.plain_not)
            (query.must if len(groups) == 1 else query.should).extend(driver_terms(wanted, tokens))
            for part in unwanted:
                query.must_not += driver_terms(part, tokens) if config.plain_not else [part.strip()] if part.strip() else []
        return ParsedQuery(QueryType.BOOLEAN, [*query.must, *query.should], text, boolean=query)
    return ParsedQuery(QueryType.TERM, driver_terms(text, tokens), text)


def _not_parts(group: str, leading: bool) -> list[str]:
    parts = _NOT.split(group)
    if group.startswith("-") and not leading:
        parts = parts[1:] or [""]
    if leading and group.startswith("-") and len(parts) > 1:
        # "-foo bar": only the word behind the hyphen is unwanted
        head, _, rest = parts[1].partition(" ")
        parts = [rest, head, *parts[2:]]
    return parts


def snippet_terms(text: str) -> list[str]:
    """Terms of a query as they are looked for in snippets: lower case, trimmed, each once, in order."""
    return list(dict.fromkeys(t for t in (x.strip().lower() for x in parse(text).ranking_terms()) if t))


def query_signals(terms: list[str]) -> list[str]:
    """Letters and digits of each term, each once, and of all terms together: what a site's name is compared with."""
    plain = [re.sub("[^a-z0-9]", "", t.lower()) for t in terms]
    return list(dict.fromkeys(x for x in [*plain, "".join(plain)] if x))
