"""Problem 4: HTML, wiki and LaTeX markup left in Markdown texts.

A text is scanned once, token by token: words, markup of the three kinds, links, formulas, code and
other marks. Words, code and formulas score positive, markup, links and marks negative, with weights
learned from labelled pages (log odds of a token class in prose pages against the other pages, sign
held; a mark is what separates the items of a line); the maximum-scoring run of tokens, found in the same linear scan, is the content region. The
kinds of foreign markup are those of the tokens the scan consumed. The text is cut to the region
(whole lines, whole code blocks), and its markup turned into plain text or the Markdown that means
the same: headings, lists, table rows, code and formulas stay, tags, comments, templates and
references go.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quernstone.llm.boilerplate import labelled_pages
from quernstone.llm.common import current_pages, map_rows

# Names of HTML elements.
HTML_TAGS = """a abbr address article aside audio b blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form
h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param pre q s samp script section select small source
span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr track tt u ul var video wbr""".split()
_TAG = r"</?(?:" + "|".join(sorted(HTML_TAGS, key=lambda t: (-len(t), t))) + r")(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>"
_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]+|#\d+|#[xX][0-9A-Fa-f]+);"
_HTML = rf"(?i:{_TAG}|<!--|<!DOCTYPE\b|{_ENTITY})"
# Namespaces of media and categories in wiki links.
_MEDIA = r"(?:file|image|category|media|datei|bild|kategorie|fichier|catégorie|archivo|imagen|categoría)"
_WIKI = (
    r"\[\[(?![ \t])[^\[\]\n]+\]\](?!\()|(?<![\w'])'''?(?=[^\W_])[^'\n]+(?<=[\w.,!?;:)])'''?(?!')|^(?P<eq>={2,6})(?!=)(?=[ \t]*[^=\s])[^=\n]+(?P=eq)(?!=)[ \t]*$|^\{\|(?=[ \t\n]|$)|^\|\}[ \t]*$"
    r"|\{\{[A-Za-z][^{}|\n]*\|[^{}\n]*=[^{}\n]*\}\}|(?<![\]\w!])\[https?://[^\s\]]+ [^\]\n]+\](?!\()|^#REDIRECT\b|__(?:TOC|NOTOC|NOEDITSECTION)__|</?(?:ref|nowiki|gallery)\b[^<>\n]*>"
)
# Commands and environments of LaTeX.
_COMMANDS = """alpha approx backslash bar begin beta bf bibitem bullet cap caption cdot cdots centering chi circ cite citep citet cos cup delta det documentclass emph end epsilon equiv eta exists exp
footnote forall frac gamma ge geq hat hline hspace in includegraphics infty int item itshape kappa label lambda ldots le left leq lim ln log mapsto mathbb mathbf mathcal mathrm max min mu nabla ne
neq newcommand newline noindent nu omega overline pageref paragraph partial phi pi pm prod psi qquad quad ref rho right section sigma sim sin sqrt subset subsection subsubsection sum tableofcontents tan tau textbf textit
textrm textsc texttt theta times title tilde to underline usepackage varepsilon vec vspace wedge xi zeta chapter eqref""".split()
_CMD = r"(?<![\w:\\/.])\\(?:" + "|".join(sorted(_COMMANDS, key=lambda t: (-len(t), t))) + r")(?![A-Za-z\\])"
_COMMAND = rf"{_CMD}|(?<![\w:\\/.])\\[A-Za-z]+\{{[^{{}}\n]*\}}"
_FORMULA = r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*[\\^_][^$\n]*(?<=[^\s$])\$(?![\w$])|\$\$(?=[^$]*(?:\\[A-Za-z]|[A-Za-z0-9}][ ]?[\^_]))[^$]+\$\$|\\\([^\n]*?\\\)|^[ \t]*\\\["
# Symbols without one of which no markup of any kind stands in a text.
_HINTS = ("<", "&", "[[", "''", "==", "{|", "|}", "{{", "[http", "__", "#REDIRECT", "\\", "$")

_INLINE = re.compile(r"(?<!`)(?:``(?!`)(?:[^`\n]|`(?!`))+``|`[^`\n]+`)(?!`)")
_FENCE = re.compile(r"^ *(```|~~~)")


def pieces(text: str) -> list[tuple[bool, str]]:
    """Text as (is a fenced block, its text) in order; lines keep their breaks."""
    if "```" not in text and "~~~" not in text:
        return [(False, text)]
    out, own, fence = [], [], ""
    for line in text.splitlines(keepends=True) if "\r" in text else [x + "\n" for x in text.split("\n")]:
        m = _FENCE.match(line) if line.lstrip(" ")[:3] in ("```", "~~~") else None
        if fence:
            own.append(line)
            if m and m.group(1) == fence:
                out.append((True, "".join(own)))
                own, fence = [], ""
        elif m:
            if own:
                out.append((False, "".join(own)))
            own, fence = [line], m.group(1)
        else:
            own.append(line)
    if own:
        out.append((bool(fence), "".join(own)))
    if "\r" not in text and out:
        code, last = out[-1]
        out[-1] = (code, last[:-1])
    return out


KINDS = ("html", "wiki", "latex")
_SCAN = re.compile(
    rf"(?P<word>[^\W\d_]{{2,}})|(?P<code>{_INLINE.pattern})|(?P<html>{_HTML})|(?P<wiki>{_WIKI})|(?P<formula>{_FORMULA})|(?P<latex>{_COMMAND})|(?P<link>\]\([^)\s]*\)|https?://\S+)|(?P<mark>(?<=\S) [|>»›/→] (?=\S))",
    re.M,
)
_INSIDE = {"html": re.compile(_HTML), "wiki": re.compile(_WIKI, re.M), "latex": re.compile(f"{_COMMAND}|{_FORMULA}", re.M)}
_WORD = re.compile(r"[^\W\d_]{2,}")
_MARK = re.compile(r"(?<=\S) [|>»›/→] (?=\S)")

#: Classes of tokens. Formulas and code count as words.
CLASSES = ("word", "tag", "link", "mark")


def scan(parts: list[tuple[bool, str]]) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Kinds of foreign markup met outside code, and tokens: (place in the text, class, how many in a row of them)."""
    kinds: set[str] = set()
    tokens: list[tuple[int, int, int]] = []
    base = 0
    for code, text in parts:
        if code:
            tokens.append((base, 0, max(len(_WORD.findall(text)), 1)))
        elif any(h in text for h in _HINTS):
            for m in _SCAN.finditer(text):
                kind = m.lastgroup if m.lastgroup != "eq" else "wiki"
                at = base + m.start()
                if kind in ("word", "code"):
                    tokens.append((at, 0, 1))
                elif kind == "link":
                    tokens.append((at, 2, 1))
                elif kind == "mark":
                    # bars of table rows are structure
                    if text[text.rfind("\n", 0, m.start()) + 1] != "|":
                        tokens.append((at, 3, 1))
                else:
                    own = m.group()
                    kinds.add("latex" if kind == "formula" else kind)
                    # markup of another kind may stand within
                    kinds.update(k for k, form in _INSIDE.items() if k not in kinds and len(own) > 4 and form.search(own, 1))
                    tokens.append((at, 0 if kind == "formula" else 1, 1))
                    if kind == "wiki" and (words := len(_WORD.findall(own))):
                        tokens.append((at, 0, words))
        else:
            at = base
            for line in text.split("\n"):
                if line:
                    counts = (len(_WORD.findall(line)), 0, line.count("](") + line.count("://"), 0 if line[0] == "|" else len(_MARK.findall(line)))
                    tokens += [(at, c, n) for c, n in enumerate(counts) if n]
                at += len(line) + 1
        base += len(text)
    return [k for k in KINDS if k in kinds], tokens


def kinds_of(parts: list[tuple[bool, str]]) -> list[str]:
    """Kinds of foreign markup outside code, in the order html, wiki, latex."""
    return scan(parts)[0]


def _outside_inline(text: str, change) -> str:
    """Apply ``change`` to the text between inline code."""
    if "`" not in text:
        return change(text)
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out += [change(text[at : m.start()]), m.group(0)]
        at = m.end()
    return "".join([*out, change(text[at:])])


_HTML_STEPS = [
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    (re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I), ""),
    (re.compile(r"<h([1-6])\b[^>]*>\s*(.*?)\s*</h\1\s*>", re.S | re.I), lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2) + "\n"),
    (re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", re.S | re.I), lambda m: "\n```\n" + m.group(1).strip("\n") + "\n```\n"),
    (re.compile(r"<code\b[^>]*>([^<\n]*)</code\s*>", re.I), r"`\1`"),
    (re.compile(r"<li\b[^>]*>\s*", re.I), "\n- "),
    (re.compile(r"</(?:td|th)\s*>\s*<(?:td|th)\b[^>]*>", re.I), " | "),
    (re.compile(r"<tr\b[^>]*>\s*(?:<(?:td|th)\b[^>]*>)?", re.I), "\n| "),
    (re.compile(r"(?:</(?:td|th)\s*>\s*)?</tr\s*>", re.I), " |"),
    (re.compile(r"</?(?:br|p|div|ul|ol|table|tbody|thead|blockquote|section|article|hr)\b[^>]*>", re.I), "\n"),
    (re.compile(_TAG, re.I), ""),
]
_WIKI_STEPS = [
    (re.compile(rf"\[\[\s*:?{_MEDIA}:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I), ""),
    (re.compile(r"\{\{[A-Za-z][^{}|\n]*\|[^{}\n]*=[^{}\n]*\}\}"), ""),
    (re.compile(r"\[\[(?![ \t])[^\[\]|\n]*\|([^\[\]\n]*)\]\](?!\()"), r"\1"),
    (re.compile(r"\[\[(?![ \t])([^\[\]\n]*)\]\](?!\()"), r"\1"),
    (re.compile(r"(?<![\]\w!])\[https?://[^\s\]]+ ([^\]\n]+)\](?!\()"), r"\1"),
    (re.compile(r"^(={2,6})(?!=)(?=[ \t]*[^=\s])([^=\n]+)\1(?!=)[ \t]*$", re.M), lambda m: "#" * len(m.group(1)) + " " + m.group(2).strip()),
    (re.compile(r"(?<![\w'])('''?)(?=[^\W_])([^'\n]+)(?<=[\w.,!?;:)])\1(?!')"), r"\2"),
    (re.compile(r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?", re.M), ""),
    (re.compile(r"^![ \t]*([^\n]*!![^\n]*)$", re.M), lambda m: "| " + m.group(1).replace("!!", "|") + " |"),
    (re.compile(r"^\|[ \t]*([^|\n]+\|\|[^\n]*)$", re.M), lambda m: "| " + m.group(1).replace("||", "|") + " |"),
    (re.compile(r"</?(?:ref|nowiki|gallery)\b[^<>\n]*>|__(?:TOC|NOTOC|NOEDITSECTION)__"), ""),
]
def _table(m: re.Match) -> str:
    rows = [row for row in m.group(1).replace("\\hline", "").split("\\\\") if row.strip()]
    return "\n".join(f"| {' | '.join(cell.strip() for cell in row.split('&'))} |" for row in rows)


_LATEX_STEPS = [
    (re.compile(r"\\(sub)?(sub)?section\*?\{([^{}\n]*)\}"), lambda m: "#" * (2 + bool(m.group(1)) + bool(m.group(2))) + " " + m.group(3)),
    (re.compile(r"\\begin\{(?:equation|align|displaymath|gather)\*?\}\s*(.*?)\s*\\end\{(?:equation|align|displaymath|gather)\*?\}", re.S), r"$$\1$$"),
    (re.compile(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\n?\\end\{(?:verbatim|lstlisting)\}", re.S), r"```\n\1\n```"),
    (re.compile(r"\\begin\{tabular\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?(.*?)\\end\{tabular\*?\}", re.S), _table),
    (re.compile(r"^[ \t]*\\item(?:\[[^\]\n]*\])?[ \t]*", re.M), "- "),
    (re.compile(r"^[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*\n?", re.M), ""),
    (re.compile(r"~?\\(?:ref|cite[pt]?|label|pageref|eqref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:emph|text(?:bf|it|rm|sc|tt)|underline|footnote|caption)\{([^{}\n]*)\}"), r"\1"),
]
_BLANK = re.compile(r"\n{3,}")


def clean(parts: list[tuple[bool, str]], kinds: list[str]) -> str:
    """The text with foreign markup turned into plain text; code is left as it is."""

    def change(text: str) -> str:
        if "html" in kinds:
            for form, to in _HTML_STEPS:
                text = form.sub(to, text)
            text = html.unescape(text)
        if "wiki" in kinds:
            for form, to in _WIKI_STEPS:
                text = form.sub(to, text)
        if "latex" in kinds:
            for form, to in _LATEX_STEPS:
                text = form.sub(to, text)
        return text

    if not kinds:
        return "".join(x for _, x in parts)
    return _BLANK.sub("\n\n", "".join(x if code else _outside_inline(x, change) for code, x in parts)).strip("\n")


@dataclass(frozen=True)
class Weights:
    """Scores of a word (positive) and of tags, links and marks (negative)."""

    word: float = 1.0
    tag: float = -0.5
    link: float = -3.0
    mark: float = -0.8

    @classmethod
    def learn(cls, rows: list[tuple[str, str]], prior: float = 50.0) -> Weights:
        """From (text, label): log odds of the classes in prose pages against the others; ``prior`` tokens of each class are given to both sides. Signs are held."""
        start = cls()
        if not rows:
            return start
        count = {True: [prior] * 4, False: [prior] * 4}
        for text, label in rows:
            for _, c, n in scan(pieces(text or ""))[1]:
                count[label == "prose"][c] += n
        odds = [math.log((count[True][i] / sum(count[True])) / (count[False][i] / sum(count[False]))) for i in range(4)]
        return cls(max(odds[0], 0.05), *(min(x, -0.02) for x in odds[1:]))


def best_region(tokens: list[tuple[int, int, int]], w: Weights) -> tuple[int, int, float]:
    """Place of the first and the last token of the maximum-scoring run and its score; (0, 0, 0.0) if no token scores above 0. Of equal runs the first."""
    score = (w.word, w.tag, w.link, w.mark)
    best, first, last, run, start = 0.0, 0, 0, 0.0, 0
    for at, c, n in tokens:
        own = score[c] * n
        if run <= 0:
            run, start = own, at
        else:
            run += own
        if run > best:
            best, first, last = run, start, at
    return first, last, best


def cut(parts: list[tuple[bool, str]], first: int, last: int) -> tuple[list[tuple[bool, str]], int, int]:
    """The parts from the line of place ``first`` to that of ``last``, code blocks whole, and the numbers of these lines from 1."""
    out, base, line, low, high = [], 0, 1, 0, 0
    for code, text in parts:
        end = base + len(text)
        if end > first and base <= last:
            a = 0 if code or first <= base else text.rfind("\n", 0, first - base) + 1
            b = len(text) if code or last >= end else text.find("\n", last - base)
            b = len(text) if b < 0 else b
            out.append((code, text[a:b]))
            low = low or line + text.count("\n", 0, a)
            high = line + text.count("\n", 0, b) - text[:b].endswith("\n")
        base = end
        line += text.count("\n")
    return out, low, high


_HEADING = re.compile(r"\s*(?:#{1,6}[ \t]|<h[1-6]\b|={2,6}[^=\n]|\\(?:sub)*section\*?\{)", re.I)


def _with_heading(text: str, at: int) -> int:
    """Start of a region with the headings right above it, whose own markup may outweigh their words."""
    start = text.rfind("\n", 0, at) + 1
    while start > 0:
        above = text[:start].rstrip("\n \t")
        line = above.rfind("\n") + 1
        if not above or not _HEADING.match(above, line):
            break
        start = at = line
    return at


def cleaned(raw: str | None, weights: Weights) -> tuple[str, list[str], int, int, float]:
    """(clean text of the content region, kinds of foreign markup of the whole text, first and last line of the region, its score)."""
    parts = pieces(raw or "")
    kinds, tokens = scan(parts)
    first, last, score = best_region(tokens, weights)
    if score <= 0:
        return "", kinds, 0, 0, 0.0
    region, low, high = cut(parts, _with_heading(raw, first), last)
    return clean(region, kinds), kinds, low, high, score


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000) -> Weights:
    """Weights from at most ``sample`` labelled pages (see boilerplate.labelled_pages)."""
    return Weights.learn([(r.content_markdown, r.kind) for r in labelled_pages(docs, labels, sample)])


def cleaned_pages(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row per current page: clean text of the content region, kinds of foreign markup, lines of the region (0 if none: no word scores). Null texts give empty ones."""
    pages = current_pages(docs, "content_markdown")

    def make():
        def work(b):
            rows = [cleaned(raw, weights) for raw in b["content_markdown"]]
            return {"id": b["id"], **{k: [r[i] for r in rows] for i, k in enumerate(("text", "markup", "first_line", "last_line", "score"))}}

        return work

    return map_rows(pages, make, "id string, text string, markup array<string>, first_line int, last_line int, score double")
