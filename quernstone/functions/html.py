"""HTML pages into Markdown with the standard library's parser, as an Arrow-batched function."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import html_body, html_title, normalize_markdown, squeeze
from quernstone.functions.urls import anchor_links
from quernstone.session import ship_package

_HIDDEN = {"script", "style", "noscript", "template", "head", "svg", "iframe"}
_FRAME = {"nav", "header", "footer", "aside", "form"}
_MAIN = {"main", "article"}
_BLOCK = {"p", "div", "section", "article", "main", "table", "ul", "ol", "dl", "figure", "header", "footer", "nav", "aside", "address", "form", "fieldset"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Writer(HTMLParser):
    """Markdown of what is inside the wanted elements (all, if none are named)."""

    def __init__(self, page: str, inside: set[str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.inside = page, inside
        self.out: list[str] = []
        self.open: list[str] = []
        self.lists: list[int] = []
        self.links: list[str | None] = []
        self.cells = 0

    def _live(self) -> bool:
        hidden = _HIDDEN | (_FRAME if self.inside else set())
        return not any(t in hidden for t in self.open) and (not self.inside or any(t in self.inside for t in self.open))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _VOID:
            self.open.append(tag)
        if not self._live():
            return
        own = dict(attrs)
        put = self.out.append
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ul" else 1)
            put("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            n = self.lists[-1] if self.lists else 0
            put("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{n}. " if n else "- "))
            if n:
                self.lists[-1] += 1
        elif tag == "a":
            href = (own.get("href") or "").strip()
            self.links.append(urljoin(self.page, href) if href and not href.lower().startswith(("javascript:", "#")) else None)
            put("[" if self.links[-1] else "")
        elif tag == "img":
            if own.get("src"):
                put(f"![{own.get('alt') or ''}]({urljoin(self.page, own['src'] or '')})")
        elif tag in ("strong", "b"):
            put("**")
        elif tag in ("em", "i"):
            put("*")
        elif tag == "pre":
            put("\n\n```\n")
        elif tag == "code" and "pre" not in self.open[:-1]:
            put("`")
        elif tag == "blockquote":
            put("\n\n> ")
        elif tag == "br":
            put("\n")
        elif tag == "hr":
            put("\n\n---\n\n")
        elif tag == "tr":
            self.cells = 0
            put("\n|")
        elif tag in ("td", "th"):
            self.cells += 1
            put(" ")
        elif tag in _BLOCK:
            put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        live = self._live()
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        if not live:
            return
        put = self.out.append
        if tag == "a" and self.links:
            target = self.links.pop()
            put(f"]({target})" if target else "")
        elif tag in ("strong", "b"):
            put("**")
        elif tag in ("em", "i"):
            put("*")
        elif tag == "pre":
            put("\n```\n\n")
        elif tag == "code" and "pre" not in self.open:
            put("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            put("\n")
        elif tag in ("td", "th"):
            put(" |")
        elif tag == "tr" and self.cells:
            put("")
        elif tag in _BLOCK or tag == "blockquote" or (len(tag) == 2 and tag[0] == "h"):
            put("\n\n")

    def handle_data(self, data: str) -> None:
        if self._live():
            self.out.append(data if "pre" in self.open else re.sub(r"\s+", " ", data))


def _write(html: str, page: str, inside: set[str] | None) -> str:
    writer = _Writer(page, inside)
    writer.feed(html)
    writer.close()
    parts = "".join(writer.out).split("```")
    for i in range(0, len(parts), 2):  # outside code
        text = re.sub(r"\[\s*\]\([^)]*\)|\*\*\s*\*\*", "", parts[i])
        parts[i] = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+(?![-\d ])", "\n", text))
    text = "```".join(parts)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_to_markdown(html: str | None, page: str | None) -> str:
    """Markdown of a page: of its main or article element without navigation and forms if it has a readable one, else of the whole body."""
    if not html:
        return ""
    html, page = html.replace("\x00", " "), page or ""
    found = _write(html, page, _MAIN)
    return found if len(re.findall(r"\w+", found)) >= 5 else _write(html, page, None)


def markdown_of(html: Column, page: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def convert(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([html_to_markdown(h, u) for h, u in zip(pages, urls)])

    return convert(html, page)


def extracted(pages: DataFrame) -> DataFrame:
    """(url, title, content_markdown, links) of pages (url, html).

    Without a title the url stands for it; without Markdown the stripped text, and without any the title."""
    html, url = F.col("html"), F.col("url")
    title = F.coalesce(F.nullif(html_title(html), F.lit("")), url)
    plain = squeeze(F.regexp_replace(html_body(html), "<[^>]*>", " "))
    markdown = F.coalesce(F.nullif(normalize_markdown(markdown_of(html, url)), F.lit("")), F.nullif(plain, F.lit("")), title)
    return pages.select("url", title.alias("title"), markdown.alias("content_markdown"), anchor_links(html, url).alias("links"))
