"""Text functions as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down during "
    "each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's "
    "me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's "
    "which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()


@dataclass(frozen=True)
class TokenizerConfig:
    """What counts as a term: shortest length in characters, and words left out (compared in lower case)."""

    min_length: int = 2
    stopwords: frozenset[str] = field(default_factory=lambda: frozenset(STOPWORDS))

    def __post_init__(self) -> None:
        object.__setattr__(self, "stopwords", frozenset(w.lower() for w in self.stopwords))

    def with_stopword(self, word: str) -> TokenizerConfig:
        return TokenizerConfig(self.min_length, self.stopwords | {word.lower()})

    def without_stopword(self, word: str) -> TokenizerConfig:
        return TokenizerConfig(self.min_length, self.stopwords - {word.lower()})

    def is_stopword(self, word: str) -> bool:
        return word.lower() in self.stopwords


DEFAULT = TokenizerConfig()


def term_array(text: Column, config: TokenizerConfig = DEFAULT) -> Column:
    """Terms of a text in order. A term is a run of ASCII letters, digits, apostrophes and hyphens, lower-cased, that
    has a letter, is long enough and no stop word; any other character separates. Null gives an empty array."""
    # the pattern takes whole runs, and only those with a letter
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9'-]*[A-Za-z][A-Za-z0-9'-]*)"), F.lit(1)), lambda x: F.lower(x))

    def keep(x: Column) -> Column:
        good = F.length(x) >= config.min_length
        return good & ~x.isin(sorted(config.stopwords)) if config.stopwords else good

    return F.filter(runs, keep)


def driver_terms(text: str, config: TokenizerConfig = DEFAULT) -> list[str]:
    """The same rule for a query on the driver."""
    import re

    runs = (r.lower() for r in re.findall(r"[A-Za-z0-9'-]+", text or ""))
    return [r for r in runs if len(r) >= config.min_length and re.search("[a-z]", r) and r not in config.stopwords]


def _chain(text: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " "))


def markdown_text(markdown: Column) -> Column:
    """Plain text of Markdown: fences, emphasis, heading and quote marks, link targets, autolinks and raw tags go; link
    texts, image texts and code stay; white space is squeezed."""
    steps = [
        ("(?m)^[ ]{0,3}(```|~~~)[^\\n]*$", " "),
        ("<[a-zA-Z][a-zA-Z0-9+.-]*:[^<>\\s]*>", " "),
        ("<!--[^>]*-->", " "),
        ("</?[a-zA-Z][^<>]*>", " "),
        ("!?\\[([^\\[\\]]*)\\]\\([^()]*\\)", "$1"),
        ("(?m)^[ ]{0,3}#{1,6}[ \\t]+", " "),
        ("(?m)^[ ]{0,3}>[ ]?", " "),
        ("(?m)^[ \\t]*[-*+][ \\t]+", " "),
        ("(?m)^[ ]{0,3}([-*_][ \\t]*){3,}$", " "),
        ("\\*\\*([^*\\n]+)\\*\\*", "$1"),
        ("\\*([^*\\n]+)\\*", "$1"),
        ("`([^`\\n]*)`", "$1"),
    ]
    return squeeze(_chain(markdown, steps))


def normalize_markdown(markdown: Column) -> Column:
    """Line ends as LF, lines right-trimmed, at most one blank line in a row, trimmed."""
    text = _chain(markdown, [("\\r\\n?", "\n"), ("(?m)[ \\t]+$", ""), ("\\n{3,}", "\n\n")])
    return F.regexp_replace(text, "^[ \\t\\n]+|[ \\t\\n]+$", "")


def html_title(html: Column) -> Column:
    """Text of the first title element, without tags, squeezed; empty if there is none."""
    return squeeze(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", " "))


def html_body(html: Column) -> Column:
    """Inside of the first body element (or everything) without scripts, styles and noscript blocks."""
    body = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    inner = F.when(html.rlike("(?is)<body[^>]*>.*?</body>"), body).otherwise(html)
    for tag in ("script", "style", "noscript"):
        inner = F.regexp_replace(inner, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return inner


def html_text(html: Column) -> Column:
    return squeeze(F.regexp_replace(html_body(html), "<[^>]*>", " "))


def page_text(html: Column, url: Column) -> tuple[Column, Column]:
    """(title, text) of a page with fallbacks: no title, the url; no text, the title."""
    title = F.coalesce(F.nullif(html_title(html), F.lit("")), url)
    return title, F.coalesce(F.nullif(html_text(html), F.lit("")), title)


def sanitize(text: Column) -> Column:
    """Scripts, styles and tags removed, the rest escaped."""
    plain = _chain(text, [("(?is)<script[^>]*>.*?</script>", ""), ("(?is)<style[^>]*>.*?</style>", ""), ("(?s)<!--.*?-->", ""), ("</?[A-Za-z!][^<>]*>", "")])
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        plain = F.replace(plain, F.lit(sign), F.lit(name))
    return plain


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def snippet(text: Column, terms: list[str], length: int = 220, before: int = 80) -> Column:
    """A window around the earliest match of any term; a text without one gives its beginning. Cut sides get an ellipsis."""
    length = max(length, 80)
    body = F.trim(text)
    low = F.lower(body)
    places = [F.instr(low, t) for t in terms if t]
    first = F.least(*[F.when(p > 0, p) for p in places], F.lit(None).cast("int")) if places else F.lit(None).cast("int")
    hit = F.coalesce(first - 1, F.lit(0))
    size = F.length(body)
    start = F.greatest(hit - before, F.lit(0))
    end = F.least(start + length, size)
    start = F.greatest(F.least(start, end - length), F.lit(0)) if length < before else start
    inner = F.trim(F.substring(body, start + 1, end - start))
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), inner, F.when(end < size, F.lit("...")).otherwise(F.lit("")))
    return F.when(size == 0, F.lit("")).when(inner == "", F.lit("")).otherwise(cut)


def phrase_snippet(text: Column, phrase: str, length: int = 200, before: int = 50) -> Column:
    """A window around the first match of a whole phrase, any case; without a match the beginning."""
    size = F.length(text)
    place = F.instr(F.lower(text), phrase.lower()) if phrase else F.lit(0)
    start = F.when(place > 0, F.greatest(place - 1 - before, F.lit(0))).otherwise(F.lit(0))
    end = F.least(start + length, size)
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substring(text, start + 1, end - start), F.when(end < size, F.lit("...")).otherwise(F.lit("")))


def title_snippet(title: Column, length: int = 200) -> Column:
    return F.when(F.length(title) > length, F.concat(F.substring(title, 1, length), F.lit("..."))).otherwise(title)


def preview(text: Column, lines: int = 140, chars: int = 12_000) -> Column:
    """The first lines of a text, cut to a number of characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)


def clean_markdown(text: Column) -> Column:
    """Markdown without navigation: links as their text, no rules; lines full of addresses, crumbs, error and
    feedback lines are dropped; blank lines are squeezed."""
    text = _chain(text, [("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("\\n---+\\n", "\n"), ("\\n{3,}", "\n\n")])

    def keep(line: Column) -> Column:
        plain = F.regexp_replace(line, "^[ \\t\\r\\f]+|[ \\t\\r\\f]+$", "")
        links = (F.length(plain) - F.length(F.replace(plain, F.lit("http"), F.lit("")))) / 4
        bad = (links > 3) | plain.rlike("^[\\[/\\] \\t>-]+$") | (plain == "404") | F.contains(F.lower(plain), F.lit("couldn't find the page")) | (F.contains(F.lower(plain), F.lit("helpful")) & (F.length(plain) < 50))
        return (plain == "") | ~bad

    lines = F.transform(F.filter(F.split(text, "\n"), keep), lambda x: F.when(x.rlike("^[ \\t\\r\\f]*$"), F.lit("")).otherwise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")


def title_from_content(text: Column, fallback: Column) -> Column:
    """The first heading of level one or two in the first ten lines; else the fallback name in title case."""
    lines = F.transform(F.slice(F.split(F.trim(text), "\n"), 1, 10), lambda x: F.trim(x))
    heads = F.filter(lines, lambda x: F.startswith(x, F.lit("# ")) | F.startswith(x, F.lit("## ")))
    named = F.initcap(F.replace(F.regexp_replace(fallback, "\\.md$", ""), F.lit("-"), F.lit(" ")))
    return F.when(F.size(heads) > 0, F.trim(F.regexp_replace(F.get(heads, F.lit(0)), "^##? ", ""))).otherwise(named)


def long_enough(text: Column, chars: int = 200, words: int = 50) -> Column:
    """Not a short document: so many characters, and words once marks are squeezed."""
    plain = F.trim(F.regexp_replace(text, "[ \\t\\n\\r*|-]+", " "))
    return (F.length(text) >= chars) & (F.size(F.split(plain, " ")) >= words)
