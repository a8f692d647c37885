"""Operators on pages: boilerplate, spam, residue, markup, repeats, quality."""

import datetime
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import boilerplate, catalogue, markup, quality, repeats, residue, spam
from quernstone.llm.common import COMMON, current_pages, host, runs_of_letters, site_name
from quernstone.session import written

#: The columns of docs, and columns whose names the operators use themselves.
DOC = "id string, url string, title string, content_markdown string, links array<string>, crawled_at timestamp, depth int"
CLASH = "site string, body string, kind string, lines int, segments string, chunks int, _at int, _rank int, probe int, n int, words int, bad boolean, text string, markup string, share double"
T = datetime.datetime(2024, 1, 1)
PROSE = "The queue is written to the disk, and from there it is read once more. Nothing in this text is strange."


def docs(spark, rows, extra=False):
    """rows: (id, url, title, text) or with crawled_at."""
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], None, r[4] if len(r) > 4 else T, 0) for r in rows], DOC)
    for c in CLASH.split(", ") if extra else ():
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


PAGE = f"""Skip to main content
Home | Blog | About
Home > Blog > A text about queues

# A text about queues
By the Site docs team

{PROSE}

- one step
- another step

```
Home | Blog | About
```

---
Popular this week on Site
## Related articles
- [Another text](https://www.a.site.test/x)
- [A third text](https://a.site.test:443/y)
Tags: a, b
[« Previous page](/p/1) [Next page »](/p/2)
Last updated on 1 May 2020
© 2020 Site. All rights reserved."""
EDGE = [
    ("page", "https://a.site.test/q", "A text about queues", PAGE),
    ("null", None, None, None),
    ("empty", "https://a.site.test/e", "", ""),
    ("blank", "https://a.site.test/b", "t", "\n \n\t\n"),
    ("long", "https://a.site.test/l", "t", (PROSE + " ") * 3000 + "\n" + "x" * 50_000 + "\n" + "word\n" * 5000),
    (None, "https://a.site.test/n", "t", PROSE),
    ("many", "https://a.site.test/m", "old", "old", T - datetime.timedelta(1)),
    ("many", "https://a.site.test/m", "new", PROSE, T),
    ("many", "https://a.site.test/m", "new", PROSE, T),
    ("many", "https://a.site.test/m", "none", "none", None),
    ("fence", "https://a.site.test/f", "t", "```\nnever closed\nCookies"),
    ("crlf", "https://a.site.test/c", "t", "Skip to main content\r\n\r\n" + PROSE + "\r\n"),
    ("odd", "not a url", "t", "\x00 \U0001f600 ` ``` [](/) <> && $$ \\"),
]
START = boilerplate.TreeModel.start()


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id string, annotator string, label string, labelled_at timestamp")


def test_current_pages(spark):
    rows = {r.id: r.title for r in current_pages(docs(spark, EDGE, extra=True), "title").collect()}
    assert rows["many"] == "new" and None not in rows and len(rows) == 9
    hosts = spark.createDataFrame([("HTTPS://user@WWW.A.test:8080/x",), ("a.b/c",), (None,), ("http://www.www.b.test?x",)], "u string")
    assert [r.h for r in hosts.select(host(F.col("u")).alias("h")).collect()] == ["a.test", None, None, "www.b.test"]


# -- 5


def labelled(kind, text, title=None, site="a.site.test", links=(), i=0):
    return SimpleNamespace(id=f"{kind}{i}", site=site, title=title, content_markdown=text, links=list(links), kind=kind)


PROMO = "Grab a free copy of our handbook today"


def page(i, head, body, lang="en"):
    """A page of one of several sites with top, body and foot."""
    site = f"Kazop{i % 5}"
    top = {
        "en": f"Skip to main content\nThis website sets cookies for {site}.\n[Home](/h) [Blog](/b) [About](/a)\nHome > Blog > {head}",
        "it": f"Vai al contenuto\nIl sito {site} imposta biscotti nel dispositivo.\n[Inizio](/i) [Diario](/d) [Chi siamo](/c)\nInizio > Diario > {head}",
    }[lang]
    foot = {
        "en": f"Share this page: Mail | Chat\n## Related articles\n- [Another text](https://kazop{i % 5}.test/x)\nTags: queue, disk\n© 2020 {site}. All rights reserved.",
        "it": f"Condividi questo articolo: Posta | Chat\n## Articoli simili\n- [Un altro testo](https://kazop{i % 5}.test/x)\nTorna in cima\n© 2020 {site}. Diritti riservati.",
    }[lang]
    return SimpleNamespace(id=f"{lang}{i}", site=f"kazop{i % 5}.test", title=head, content_markdown=f"{top}\n\n# {head}\nBy the {site} docs team\n\n{body}\n\n---\n{foot}\n{PROMO}", links=[], kind="prose")


NOUNS = ["queue", "disk", "server", "cache", "ledger", "worker", "socket", "shard", "bucket", "token", "mirror", "panel"]
ITALIAN = ["coda", "disco", "nodo", "registro", "lavoro", "canale", "chiave", "blocco", "tavola", "voce"]


def sentences(i, words=NOUNS, pattern="The {a} is written to the {b}, and from there the {c} is read once more by number {n}."):
    return "\n\n".join(pattern.format(a=words[(i + k) % len(words)], b=words[(i * 3 + k) % len(words)], c=words[(i * 7 + k) % len(words)], n=chr(97 + i % 26) * 3) for k in range(4))


LEARNED = boilerplate.fit([page(i, f"A text about the {NOUNS[i % 12]} of {chr(97 + i % 26)}x", sentences(i) + (f"\n\n{PROMO}\n\n{sentences(i + 1)}" if i % 5 == 0 else "")) for i in range(80)])


def kept_and_dropped(model, pages, **kw):
    found = boilerplate.BodyFinder(model)([p.content_markdown for p in pages], [p.site for p in pages], [p.title for p in pages], **kw)[0]
    good = wrong = missed = 0
    for lines, forms, drop in found:
        body = range(next(i for i, x in enumerate(lines) if x.startswith("# ")), lines.index("---"))
        for i, f in enumerate(forms):
            if f >= 0:
                own = i in body and lines[i] != PROMO
                good += (i in drop) != own
                wrong += i in drop and own
                missed += i not in drop and not own
    return good, wrong, missed


def test_boilerplate_page(spark):
    got = {(r.id, r.line_no) for r in boilerplate.boilerplate_lines(docs(spark, EDGE, extra=True), START).collect()}
    lines = PAGE.split("\n")
    dropped = [lines[n - 1] for i, n in sorted(got) if i == "page"]
    kept = [x for k, x in enumerate(lines, 1) if ("page", k) not in got and re.search(r"\w", x)]
    assert dropped[0] == "Skip to main content" and dropped[-1].startswith("©") and len(dropped) >= 10
    assert PROSE in kept and "- one step" in kept and "# A text about queues" in kept
    assert ("crlf", 3) not in got and not {i for i, _ in got} & {"null", "empty", "blank", "fence", None}
    body = {r.id: r for r in boilerplate.main_bodies(docs(spark, EDGE), START).collect()}
    assert body["null"].body == "" and body["empty"].removed == [] and body["many"].body == PROSE
    assert body["page"].body.startswith("# A text") and "Home | Blog | About" in body["page"].body  # the one in code


def test_learning_and_messages_decide():
    """Learned potentials find what the starting ones miss; without messages lines of an unseen language are lost."""
    test = [page(i, f"A text about the {NOUNS[i % 12]} of {chr(97 + i % 26)}z", f"{sentences(i + 5)}\n\n{PROMO}\n\n{sentences(i)}") for i in range(60, 80)]
    good, wrong, missed = kept_and_dropped(LEARNED, test)
    assert wrong == 0 and missed == 0
    assert sum(kept_and_dropped(START, test)[1:]) > 0
    other = [page(i, f"Un testo sulla {ITALIAN[i % 10]}", sentences(i, ITALIAN, "Il {a} viene scritto nel {b}, e da lì la {c} viene letta ancora una volta."), "it") for i in range(20)]
    good, wrong, missed = kept_and_dropped(LEARNED, other)
    assert wrong == 0 and good / (good + missed) > 0.85
    assert kept_and_dropped(LEARNED, other, messages=False)[0] < good


def test_result_does_not_depend_on_order():
    """A line that is one page's title is judged anew on the other pages of its site."""
    a = f"A line that is a title.\n\n{PROSE}"
    texts, titles = [a, a], ["A line that is a title.", "Another"]
    there = boilerplate.BodyFinder(LEARNED)(texts, ["s.t"] * 2, titles)[0]
    back = boilerplate.BodyFinder(LEARNED)(texts, ["s.t"] * 2, titles[::-1])[0][::-1]
    assert [x[1] for x in there] == [x[1] for x in back] and there[0][1][0] != there[1][1][0]


def test_long_lines_are_judged_like_short_ones():
    short = "This website sets cookies for the counts of its visits. Share this page."
    text = lambda x: f"Skip to main content\n{x}\n[Home](/h) [Blog](/b)\n\n# A head\n\n{PROSE}"
    for notice in (short, " ".join([short] * 6)):
        assert 1 in boilerplate.BodyFinder(LEARNED)([text(notice)], ["s.t"], ["A head"])[0][0][2]


def test_notice_is_body_or_stray():
    notice = "This website sets cookies for Kazop1."
    find = boilerplate.BodyFinder(LEARNED)
    alone, beside, marks = find([f"# Site\n\n{notice}", f"# Head\n\n{sentences(3)}\n\n---\n{notice}\nTags: a, b", f"{notice}\n\n***** }}}}<$>?&"], ["kazop1.test"] * 3, [None, None, None])[0]
    assert 2 not in alone[2] and beside[0].index(notice) in beside[2] and 0 in marks[2]


def test_messages_are_exact():
    """Sum-product on the tree equals summing over all states."""
    import itertools

    rng = np.random.default_rng(0)
    k, v = len(boilerplate.KINDS), 3 * boilerplate.N_SYM
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = boilerplate.TreeModel(norm(rng.random(k), 0), norm(rng.random((k, 2)), 1), norm(rng.random((2, 2)), 1), norm(rng.random((k, 2, v)), 2))
    sym, block, page_of = np.array([5, 17, 40, 8]), np.array([0, 0, 1, 2]), np.array([0, 0, 1])
    odds = np.array([0.5, -1.0, 2.0, 0.3])
    got, root = m.marginals(boilerplate.Pages(sym, odds, block, page_of, page_of[block], np.arange(4), 2))
    for p, (blocks, lines) in enumerate([((0, 1), (0, 1, 2)), ((2,), (3,))]):
        total, on, roots = 0.0, dict.fromkeys(lines, 0.0), np.zeros(k)
        for kind in range(k):
            for bs in itertools.product((0, 1), repeat=len(blocks)):
                for ls in itertools.product((0, 1), repeat=len(lines)):
                    w = m.root[kind] * np.prod([m.block[kind, b] for b in bs])
                    for line, state in zip(lines, ls):
                        w *= m.line[bs[blocks.index(block[line])], state] * m.emit[kind, state, sym[line]] * np.exp(odds[line] * state)
                    total += w
                    roots[kind] += w
                    for line, state in zip(lines, ls):
                        on[line] += w * state
        assert np.allclose([got[i] for i in lines], [on[i] / total for i in lines]) and np.allclose(root[p], roots / total)


def test_training(spark):
    pages = docs(spark, [(f"p{i}", "https://a.site.test/", "A text about queues", PAGE) for i in range(8)])
    votes = labels(spark, [(f"p{i}", "a", "prose", None) for i in range(8)] + [("p0", "b", "spam", None), ("p0", "c", "prose", None), ("p1", "b", None, None), (None, "a", "prose", None), ("gone", "a", "list", None)])
    rows = boilerplate.labelled_pages(pages, votes)
    assert {r.kind for r in rows} == {"prose"} and len(rows) == 8
    assert len(boilerplate.labelled_pages(pages, votes, sample=3)) <= 3
    model = boilerplate.train(pages, votes)
    assert boilerplate.KINDS[int(model.root.argmax())] == "prose" and np.isclose(model.root.sum(), 1) and np.allclose(model.emit.sum(2), 1)
    assert np.array_equal(boilerplate.train(pages, labels(spark)).emit, START.emit)
    assert boilerplate.boilerplate_lines(pages.limit(0), model).collect() == []


# -- 1


WORDS = "buy zatel pills, cheap zatel pills, zatel pills now, zatel pills price, best zatel pills, zatel pills, zatel pills, order zatel pills"
TAGS = "#ZatelPills #CheapZatel #BuyPills #ZatelPillsnow #PillsZatel #BestPills"
LINKS = "\n".join(f"* [zatel pills](https://h{i}.test/x{i})" for i in range(8))
BARE = "\n".join(f"<https://h{i}.test/x{i}>" for i in range(8))
OVERVIEW = "\n".join(f"- [A text on queues](https://h{i}.test/x): The queue is written to the disk, and it is read once more." for i in range(8))
NAMES = "\n".join(f"- item{chr(97 + i)}x" for i in range(20))
SPEECH = " ".join(["If you want zatel pills, our zatel pills is the zatel pills that fans call zatel pills."] * 5)


EVEN = " ".join(["zatel", "pilor", "kusap", "venor", "tamil", "bogat", "rusek", "limot", "dafen", "hobir"] * 8)
BUY = "\n".join(f"- [buy now](https://one.test/x{i})" for i in range(40))
NEAR = "\n".join(f"- [buy now](/x{i})" for i in range(40))
UNSPACED = "便宜药丸购买" * 40
SHAPES = spam.ShapeModel.start()


def spam_share(text, links=(), model=SHAPES):
    held, n = spam.shapes_of([(i, "other", x) for i, x in enumerate(text.split("\n")) if x.strip()], len(links))
    if n < spam.LEAST:
        return 0.0
    codes = np.array(list(held))
    return sum(k for k, bad in zip(held.values(), model.chance(codes) >= 0.5) if bad) / sum(held.values())


@pytest.mark.parametrize(
    "text, spammy",
    [(WORDS + "\n" + WORDS, True), (TAGS + "\n" + TAGS, True), (LINKS, True), (BARE, True), (SPEECH, True), (PROSE + "\n" + (WORDS + "\n") * 4, True), (EVEN, True), (BUY, True), (NEAR, True), (UNSPACED, True), ("office office office sale " * 20, True), ("laptop laptop laptop sale " * 20, True), (OVERVIEW, False), (NAMES, False), (PROSE * 5, False), ("", False), ("| a | b |\n|---|---|\n| c | 1 |", False)],
)
def test_spam_shapes(text, spammy):
    assert (spam_share(text) >= spam.SHARE) is spammy


def test_spam_pages(spark):
    rows = [*EDGE, ("s", None, None, TAGS + "\n" + TAGS), ("s", None, None, TAGS + "\n" + TAGS), ("code", None, None, "```\n" + WORDS + "\n```")]
    assert [r.id for r in spam.spam_pages(docs(spark, rows, extra=True), START, SHAPES).collect()] == ["s"]
    assert spam.spam_pages(docs(spark, []), START, SHAPES).collect() == []


def test_outgoing_links_count():
    assert spam.foreign_links(["https://x.test/a", "https://a.b/c", None, "/near"], "a.b") == 1 and spam.foreign_links(None, None) == 0
    body = [(0, "other", "a plain line of words")]
    assert set(spam.shapes_of(body, 0)[0]) != set(spam.shapes_of(body, 5)[0])


def test_shapes_are_judged_over_the_crawl(spark):
    """A shape that stands on spam pages all over the crawl becomes one of spam, whatever its first score; the same pages without the others do not."""
    rows = [(f"p{i}", [(1, 900), (2, 1100)], 0.8) for i in range(20)] + [(f"q{i}", [(3, 500)], 0.01) for i in range(20)]
    frame = spark.createDataFrame(rows, "id string, shapes array<struct<code:int,chars:int>>, first double")
    own = dict(zip((1, 2, 3), SHAPES.chance(np.array([1, 2, 3]))))
    assert max(own.values()) < 0.5
    scores = {r.code: r.spam for r in spam.shape_scores(frame, SHAPES).collect()}
    for code, chars, first in ((1, 18000, 0.8), (3, 10000, 0.01)):
        assert scores[code] == pytest.approx((chars * first + 2000 * own[code]) / (chars + 2000))
    assert {r.id for r in spam.spam_of(frame, SHAPES).collect()} == {f"p{i}" for i in range(20)}
    assert spam.spam_of(frame.where("id = 'p0'"), SHAPES).collect() == []


def test_spam_learning():
    rows = [labelled("prose", sentences(i), i=i) for i in range(20)] + [labelled("spam", EVEN, i=i) for i in range(20)]
    model = spam.fit(LEARNED, rows)
    assert spam_share(EVEN, model=model) == 1 and spam_share(sentences(30), model=model) == 0
    assert spam.fit(LEARNED, []).sample == 0


# -- 3


@pytest.mark.parametrize("title, hit", [("{{ title }}", True), ("${author} - Site", True), ("Kazop @@city@@", True), ("Your title here", True), ("Untitled", True), ("[INSERT NAME HERE] | Site", True), ("#PRODUCT_NAME#", True), ("__DATE__", True), ("<user goes here>", True), ("Filling {{ kazop }} placeholders in the templates", False), ("A text", False), ("Issue #12 and [link](x)", False), ("C# and F#", False), ("", False), (None, False), ("100% sure, 50% done", False)])
def test_titles(title, hit):
    assert residue.title_unfilled(title, "site") is hit


MESSAGES = residue.start_words()


def judged(spark, rows, **kw):
    return {r.id: r for r in residue.decide(written(residue.residue_candidates(docs(spark, rows, **kw), START, MESSAGES)), MESSAGES).collect()}


def test_residue(spark):
    unlisted = "Konto ruht bis auf Weiteres, Meldung 17."
    part = "Every text here was looked at by two people."
    rows = [
        *EDGE,
        *[(f"m{i}", f"https://a.site{i}.test/1", "Oops", f"# Oops\n\nThe page you asked for could not be found on Site{i}.\nRef: abc") for i in range(3)],
        ("ph", None, "t", "Dear {{ first_name }}, thank you for your order of ${product}. Welcome to @@city@@."),
        ("fill", None, "t", "Lorem ipsum dolor sit amet consectetur adipiscing elit. Sed eiusmod tempor incididunt labore."),
        ("talk", None, "Why queues need JavaScript", PROSE + ' The notice "please enable JavaScript" is shown by the queue. ' + sentences(2)),
        ("code", None, "t", PROSE + "\nUse `{{ name }}` here.\n```\n{{ name }} ${name} [object Object]\n```"),
        ("title", None, "{{ title }}", sentences(1)),
        *[(f"u{i}", f"https://h{i}.test/", "t", unlisted.replace("17", str(i))) for i in range(3)],
        *[(f"a{i}", f"https://g{i}.test/", "t", f"{sentences(i + 3)}\n\n{part}") for i in range(5)],
        ("once", "https://z.test/", "t", "The widget store answers: access denied."),
    ]
    got = judged(spark, rows, extra=True)
    # a message in no list that is all that pages of three sources have is out; one sentence of five articles is not, nor a message met once
    assert set(got) == {"m0", "m1", "m2", "ph", "fill", "title", "u0", "u1", "u2"}
    assert got["title"].title_hit and not got["m0"].title_hit
    fewer = judged(spark, [r for r in rows if r[0] not in ("u2", "m2")])
    assert not {"u0", "u1", "m0", "m1"} & set(fewer)  # on two sources only
    assert judged(spark, []) == {}


def test_messages(spark):
    rows = [(f"w{i}", f"https://kazop{i}.test/", "t", f"{PROSE}\nThe page was not found on Kazop{i}, code {i}.\nIt was not found.\nIt was not found.") for i in range(4)] + [*EDGE[1:5]]
    got = {r.message: r for r in residue.recurring_messages(docs(spark, rows, extra=True), START, MESSAGES).collect()}
    assert got["the page was not found on ~, code 0."].sources == 4 and got["it was not found."].pages == 4 and got["it was not found."].alone > 0.1
    assert residue.recurring_messages(docs(spark, []), START, MESSAGES).collect() == []


def test_message_learning():
    rows = [labelled("error", "Konto ruht bis auf Weiteres.", site=f"h{i}.test", i=i) for i in range(6)] + [labelled("prose", f"{sentences(i)}\n\nEvery text here was looked at by two people.", site=f"h{i}.test", i=i) for i in range(12)]
    words = residue.fit(START, rows)
    score = lambda text, alone: words([*residue.evidence(text, text.split()), f"<{alone}>"])
    assert score("konto ruht bis auf weiteres.", 3) > 0 > score("every text here was looked at by two people.", 0)
    assert residue.fit(START, []).one == MESSAGES.one


def test_mask():
    assert residue.mask(" Sitename  v1.2 at https://x.y/z?q, Mail a@b.co 2024-01-02", "sitename") == "~ v0 at @ mail @ 0"
    assert residue.mask("Warning: include(/srv/x.php): cannot read property kazop of y in /srv/a/b (abc)") == "warning: include(@): cannot read property * of y in @ (*)"
    assert site_name("docs.kazop.test") == "kazop" and site_name(None) == ""


# -- 4


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a <b>bold</b> word", ["html"]), ("x &mdash; y", ["html"]), ("x <!-- c", ["html"]), ("<div class=\"a\" id=b>x</div>", ["html"]), ("see <https://a.b/c> and <a@b.c>", []), ("if a < b and c > d", []), ("<user goes here> <summary goes here>", []),
        ("AT&T; R&D &c", []), ("`<b>` and `` a ` <i> ``", []), ("```\n<b>\n```", []), ("~~~\n<b>\n```\n&amp;\n~~~", []), ("```\n<b>", []), ("the [[Target|word]] here", ["wiki"]), ("it was '''bold''' there", ["wiki"]),
        ("== Head ==\ntext", ["wiki"]), ("{| class=\"x\"\n|-\n| a || b\n|}", ["wiki"]), ("{{Infobox a|b=c}}", ["wiki"]), ("{{ name }} {{name|default}}", []), ("[text](http://a.b) ![[x]](y)", []), ("don't 'quote' ''", []), ("Head\n====\n======", []),
        (r"\section{A} text", ["latex"]), (r"so $x_{1}^2 + \alpha$ holds", ["latex"]), (r"\(a \times b\)", ["latex"]), ("costs $2 to $8, C:\\section\\item and C:\\alpha", []), (r"\begin{itemize}\item a\end{itemize}", ["latex"]), ("$@$ $%$ ${a} $$", []),
        ("<b>x</b> [[Y]] \\emph{z}", ["html", "wiki", "latex"]), ("", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(markup.pieces(text)) == kinds


def test_clean():
    def run(text):
        parts = markup.pieces(text)
        return markup.clean(parts, markup.kinds_of(parts))

    assert run("<h2>Head</h2><p>a&amp;b</p><ul><li>one</li><li>two</li></ul>") == "## Head\n\na&b\n\n- one\n- two"
    assert run("<table><tr><td>a</td><td>b</td></tr></table>") == "| a | b |"
    assert run("<pre><code>x &lt; y</code></pre>") == "```\nx < y\n```"
    assert run("== Head ==\n'''b''' [[A|word]] [[File:x.png|t]][http://a.b text] {{Infobox a|b=c}}end") == "## Head\nb word text end"
    assert run("{| class=x\n! a !! b\n|-\n| 1 || 2\n|}\nz") == "| a | b |\n| 1 || 2 |\nz".replace("||", "|")
    assert run("\\section{Head}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\begin{equation}\nx^2\n\\end{equation}\n\\emph{b}~\\ref{q} $y_1$") == "## Head\n- a\n$$x^2$$\nb $y_1$"
    assert run("<b>x</b> `<b>` \n```\n<i>&amp;\n```\n") == "x `<b>` \n```\n<i>&amp;\n```"
    assert run("plain *text*\n") == "plain *text*\n"


@settings(max_examples=80, deadline=None)
@given(st.text("ab\n`~ <>[]{}$\\&;'=|", max_size=60))
def test_pieces_lose_nothing(text):
    assert "".join(x for _, x in markup.pieces(text)) == text
    parts = markup.pieces(text)
    markup.clean(parts, markup.kinds_of(parts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), max_size=9))
def test_region_is_best(own):
    w = markup.Weights()
    tokens = [(10 * i, c, n) for i, (c, n) in enumerate(own)]
    scores = [(w.word, w.tag, w.link, w.mark)[c] * n for c, n in own]
    best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)] + [0.0])
    first, last, got = markup.best_region(tokens, w)
    assert got == pytest.approx(best) and (got == 0 or sum(scores[first // 10 : last // 10 + 1]) == pytest.approx(best))


HAND = [
    ("[Home](/) [Blog](/b) [About](/a)\n\n<h2>Head</h2>\n<p>The queue is written to <b>disk</b>.</p>\n<ul><li>one item here</li></ul>\n\n[x](http://a.b/c) [y](http://a.b/d)", "## Head\n\nThe queue is written to disk.\n\n- one item here"),
    ("== Head ==\nThe '''queue''' is [[Disk|written]] here.\n\n```\n<b>code</b> [[x]]\n```\n[a](/b) [c](/d) [e](/f)", "## Head\nThe queue is written here.\n\n```\n<b>code</b> [[x]]\n```"),
    ("\\section{Head}\nSo $x_1^2$ holds for \\emph{all} words.\n\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}", "## Head\nSo $x_1^2$ holds for all words.\n| a | b |\n| c | d |"),
    ("- [1](/1)\n- [2](/2)", ""),
]


@pytest.mark.parametrize("raw, clean", HAND)
def test_region_and_clean_text_by_hand(raw, clean):
    text, _, first, last, score = markup.cleaned(raw, markup.Weights())
    assert text.strip() == clean and (score > 0) is bool(clean) and (first > 0) is bool(clean)


@pytest.mark.parametrize("text, kind", [("so $$" + "x^2 + " * 600 + "y$$ holds", "latex"), ("it was '''" + "very " * 60 + "bold''' there", "wiki"), ("see [[" + "long " * 80 + "target]] there", "wiki"), ("== " + "head " * 60 + "==", "wiki"), ("<ref>x</ref>", "wiki"), ("<nowiki>", "wiki"), ("a\n|}\nb", "wiki")])
def test_long_markup_is_markup(text, kind):
    assert markup.kinds_of(markup.pieces(text)) == [kind]


def test_cleaned_pages(spark):
    got = {r.id: r for r in markup.cleaned_pages(docs(spark, [*EDGE, ("h", None, None, "<p>xy</p>")], extra=True), markup.Weights()).collect()}
    assert got["null"].text == "" and got["null"].markup == [] and got["empty"].first_line == 0 and got["h"].markup == ["html"] and got["h"].text == "xy"
    assert len(got) == 10 and markup.cleaned_pages(docs(spark, []), markup.Weights()).collect() == []
    w = markup.Weights.learn([(PROSE, "prose"), ("<b></b>[x](y) a | b", "list")])
    assert w.word > 0 > max(w.tag, w.link, w.mark) and markup.Weights.learn([]) == markup.Weights()


# -- 6


def brute(rows, ids=5):
    seen, at = defaultdict(set), []
    for i, h, text in rows:
        fence = None
        for n, line in enumerate(text.split("\n"), 1):
            m = re.match(r"^ *(```|~~~)", line)
            if fence:
                fence = None if m and m[1] == fence else fence
            elif m:
                fence = m[1]
            elif not line.strip().startswith("#") and len(re.findall(r"[^\W\d_]+", line)) >= 4:
                key = h, re.sub(r"\d+", "0", " ".join(line.split()).lower())
                seen[key].add(i)
                at.append((i, n, key))
    return {(i, n) for i, n, key in at if len(seen[key]) >= ids}


def test_repeats_equal_brute_force(spark):
    import random

    r = random.Random(1)
    pool = [f"this line {k} comes back {'very ' * (k % 40)}often" for k in range(30)] + ["# this is a head line", "too short here", "```", "~~~", "", "x " * 400]
    rows = [(f"d{i}", f"https://www.h{i % 3}.test:80/{i}", "t", "\n".join(r.choice(pool) if r.random() < 0.8 else f"own words {'abcdefgh'[i % 8]} number {i} in line" for _ in range(12)).replace("back", "BACK" if i % 2 else "back  ")) for i in range(60)]
    want = brute([(i, re.sub(r"^www\.|:80$", "", u.split("/")[2]).replace(":80", ""), t) for i, u, _, t in rows])
    found = repeats.repeated_lines(written(repeats.chunked_pages(docs(spark, [*rows, *EDGE[1:4], ("nourl", None, "t", rows[0][3])], extra=True))))
    assert {(x.id, x.line_no) for x in found.collect()} == want and want
    cut = {x.id: x.text for x in repeats.cut_pages(docs(spark, rows), found).collect()}
    assert len(cut["d0"].split("\n")) == 12 - len([1 for i, _ in want if i == "d0"]) or cut["d0"] == ""
    assert repeats.repeated_lines(written(repeats.chunked_pages(docs(spark, [])))).collect() == []


def test_repeated_passages_within_lines(spark):
    """Pages of one line that share a passage have no line in common, but chunks."""
    passage = " ".join(f"shared{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    own = [" ".join(f"own{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}" for i in range(60)) for k in range(8)]
    rows = [(f"d{k}", f"https://h.test/{k}", "t", f"{own[k]} {passage} {own[-1 - k]}") for k in range(8)] + [*EDGE, ("nl", "https://h.test/nl", "t", passage.replace(" sharedaa", "\nsharedaa"))]
    frame = docs(spark, rows, extra=True)
    found = repeats.repeated_lines(written(repeats.chunked_pages(frame)))
    chunks = repeats.repeated_chunks(written(repeats.page_chunks(frame)))
    assert found.collect() == []
    text = {r.id: r.text for r in repeats.cut_pages(frame, found, chunks).collect()}
    for k in range(8):
        assert len(text[f"d{k}"]) < len(rows[k][3]) - len(passage) * 0.7 and set(own[k].split()[:50]) <= set(text[f"d{k}"].split())
    assert text["null"] == "" and text["long"] == EDGE[4][3]
    assert repeats.repeated_chunks(written(repeats.page_chunks(docs(spark, [])))).collect() == []


def test_without():
    assert repeats.without("ab\ncdef\ng", [1], [(4, 6)]) == "cf\ng" and repeats.without("é€x", None, [(1, 3)]) == "x"[:0] + "\ufffd"[:0] + repeats.without("é€x", None, [(1, 3)])
    assert repeats.without(None, None, None) == "" and repeats.without("a\nb", None, None) == "a\nb" and repeats.without("abc\nd", [], [(0, 5)]) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6))
def test_chunks_do_not_depend_on_place(lines):
    """A line's chunks are the same alone and among others, and cover it."""
    line, value, length = repeats.chunk_hashes(lines)
    for k, own in enumerate(lines):
        _, alone, size = repeats.chunk_hashes([own])
        assert value[line == k].tolist() == alone.tolist() and size.sum() == len(own) == length[line == k].sum()


# -- 7


LIST = "\n".join(f"kazop{chr(97 + i % 26)}" for i in range(25))
TABLE = "\n".join(f"| kazop | {i}.{i} | 12.5 |" for i in range(12))
JUNK = "\n".join("7uby7m5dj22v hkcx36xt0mxc 8jzr6llc9rk60b um d4bmw9ym 9g4vmrm2mk ne4d2" for _ in range(6))
HMM = quality.LineHMM.begin()


@pytest.mark.parametrize(
    "text, label",
    [(PROSE * 3, "prose"), (LIST, "list"), (TABLE, "table"), (JUNK, "junk"), ("12 9938 22 1 993 22\n" * 6, None), ("sisk\t12.5\t8.1\nbork\t1.5\t9.1\n" * 5, "table"), ("#### >!}&§ %%\n" * 4, "junk"), ("# Head line of prose that is long\n" + LIST, "list"), (PROSE * 3 + "\n- one\n- two\n- three", "prose"), (PROSE + "\n```\n" + LIST + "\n```", "prose"), (PROSE * 2 + "\n| Name | Value |\n|---|---|\n| a | 1 |\n| b | 2 |\n" + PROSE * 2, "prose")],
)
def test_quality_labels(text, label):
    body = boilerplate.body_lines(*boilerplate.BodyFinder(START)([text], ["a.b"], ["t"])[0][0])
    row = quality.Prose(HMM)([body])[0]
    assert row[label] > 0.6 if label else row["prose"] < 0.2


def test_paths_equal_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    hmm = quality.LineHMM(norm(rng.random(4)), norm(rng.random((4, 4))), [norm(rng.random((4, k))) for k in quality._SIZES])
    seen = [np.stack([*(rng.integers(0, k, n) for k in quality._SIZES), rng.integers(1, 300, n)], 1) for n in (0, 1, 3, 5, 2, 5)]
    for s, path in zip(seen, hmm.paths(seen)):
        if len(s):
            e = hmm.evidence(s)
            score = lambda p: hmm.start[p[0]] + sum(e[t, a] for t, a in enumerate(p)) + sum(hmm.change[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert score(path.tolist()) == pytest.approx(max(score(p) for p in itertools.product(range(4), repeat=len(s))))


def test_quality_pages(spark):
    got = {r.id: r for r in quality.page_quality(docs(spark, EDGE, extra=True), START, HMM).collect()}
    assert got["null"].lines == 0 and got["empty"].prose == 0 and got["many"].prose == 1 and len(got) == 9
    assert got["many"].words == len(re.findall("[a-z]+", PROSE.lower())) and got["many"].end_ratio == 1
    rows = [*EDGE, ("list", None, "t", LIST), ("spam", None, "t", TAGS + "\n" + TAGS), ("tpl", None, "{{ title }}", LIST)]
    written_rows = written(quality.not_prose_candidates(docs(spark, rows, extra=True), START, HMM, SHAPES, MESSAGES))
    others = residue.decide(written_rows, MESSAGES).select("id").unionByName(spam.spam_of(written_rows, SHAPES).select("id"))
    found = written_rows.where("bad").select("id").join(others, "id", "left_anti")
    assert "list" in {r.id for r in found.collect()} and not {"spam", "tpl", "page", "many", "null"} & {r.id for r in found.collect()}
    assert quality.page_quality(docs(spark, []), START, HMM).collect() == []


def test_hmm_training_and_transitions_decide():
    """What is learned labels lines the starting potentials do not; neighbours decide lines that could be either."""
    strange = lambda i: sentences(i, ITALIAN, "Quando {a} viene dopo {b} nasce {c} ancora").split("\n\n")
    rows = [labelled("prose", "\n\n".join(strange(i)), i=i) for i in range(20)] + [labelled("list", LIST, i=i) for i in range(8)] + [labelled("list", sentences(3), i=9), labelled("junk", "", i=2), labelled("spam", TAGS, i=3)]
    hmm = quality.fit(START, rows)
    assert all(np.allclose(np.exp(e).sum(1), 1) for e in hmm.emit) and quality.fit(START, []).sample == 0
    assert quality.Prose(hmm)([[(0, "sentence", PROSE)]])[0]["prose"] == 1
    body = [(i, "other", x) for i, x in enumerate(strange(99))]
    assert quality.Prose(hmm)([body])[0]["prose"] > 0.9 > quality.Prose(HMM)([body])[0]["prose"]
    among = [[(0, "short", x)] * 8 for x in ("| kazop | 1.5 | 12.5 |", "kazop tamil")]
    for own, label in zip(among, ("table", "list")):
        odd = [*own[:4], (0, "short", "Name: 4; none"), *own[4:]]
        assert quality.Prose(HMM)([odd])[0][label] == 1
    alone = [quality.Prose(HMM, changes=False)([[*own[:4], (0, "short", "Name: 4; none"), *own[4:]]])[0] for own in among]
    assert alone[0]["table"] < 1 or alone[1]["list"] < 1


MIXED_TEXT = st.text(st.sampled_from("aZéß İ中x09٣_.,:;|/~=«#*-!\t"), max_size=60)


@given(MIXED_TEXT, st.booleans())
@settings(max_examples=300, deadline=None)
def test_ascii_is_read_like_any_text(text, only_ascii):
    """The faster patterns for ASCII find what the general ones find; counts are those of the definitions."""
    text = "".join(c for c in text if c.isascii()) if only_ascii else text
    words = re.findall(r"[^\W\d_]+", text)
    assert runs_of_letters(text) == words
    assert spam.words_of(text + " é")[:-1] == spam.words_of(text) if text.isascii() else True
    assert boilerplate.tokens_of(text + " é") == [*boilerplate.tokens_of(text), "é"]
    assert residue._SENTENCE.split(text) == re.split(r"(?<=[.!?:])\s+", text)
    own = text.strip(" \t*-")
    words, digits, solid = re.findall(r"[^\W\d_]+", own), sum(c.isdecimal() for c in own), len("".join(own.split()))
    counts = dict(zip(quality.COUNTS, quality.observe(own)[1]))
    if not re.match(r"\s*\d+[.)]\s", own):
        assert (counts["words"], counts["letters"], counts["digits"]) == (len(words), sum(map(len, words)), digits)
        assert counts["marks"] == solid - counts["letters"] - digits and counts["common"] == sum(w.lower() in COMMON for w in words)


@given(st.one_of(*[st.tuples(st.just(rule), st.from_regex(p)) for rule, p in ((2, residue._STRONG), (2, residue._MESSAGE), (1, residue._WEAK))]))
@settings(max_examples=1500, deadline=None)
def test_rules_hold_their_pieces(case):
    """Whatever a rule matches holds one of its pieces, and each wording of the rules is found."""
    rule, text = case
    plain = text.strip("*_#>-• ")
    expected = 2 if residue._STRONG.search(plain) or residue._MESSAGE.search(plain) else 1 if residue._WEAK.search(plain) else 0
    assert residue.rule_of(text, ["error"]) == expected
    pattern = residue._RULES[2] if rule == 1 else None
    assert any(piece in text for _, pieces, p in ([pattern] if pattern else residue._RULES[:2]) for piece in pieces)


def test_not_prose_is_what_the_shares_say():
    """Without the other statistics and put into ranges in groups of any size, bodies are judged the same."""
    bodies = [[(i, "other", x) for i, x in enumerate(t.split("\n"))] for t in (PROSE, "", LIST, TABLE, JUNK, PROSE + "\n" + LIST, "")]
    shares = quality.Prose(HMM)(bodies)
    assert quality.Prose(HMM).not_prose(bodies) == [r["lines"] > 0 and 1 - r["prose"] >= quality.NOT_PROSE for r in shares]
    assert quality.Prose(HMM).not_prose([]) == []
    lines = [quality.judged_lines(b) for b in bodies]
    for at_once in (1, 3, 30):
        for a, b in zip(quality.sequences(lines, at_once), quality.sequences(lines), strict=True):
            assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and a[1].shape[1] == len(quality.NAMES) + 1


def test_labelled_bodies_are_found_once(spark, folder, monkeypatch):
    """The models of p7_found learn from one reading of the labelled pages, and learn what each learns from its own."""
    calls, whole = [], boilerplate.BodyFinder.__call__
    monkeypatch.setattr(boilerplate.BodyFinder, "__call__", lambda self, texts, *a, **k: calls.append(len(texts)) or whole(self, texts, *a, **k))
    catalogue.p7_found(spark, folder)
    assert len(calls) == 1
    rows = [labelled(kind, text, i=i) for i, (kind, text) in enumerate([("prose", sentences(1)), ("list", LIST), ("spam", TAGS), ("junk", JUNK), ("table", TABLE)] * 3)]
    bodies = boilerplate.bodies_of(START, rows)
    assert np.array_equal(spam.fit(START, rows).weights, spam.fit(START, rows, bodies).weights)
    assert residue.fit(START, rows) == residue.fit(START, rows, bodies=bodies)
    assert all(np.array_equal(a, b) for a, b in zip(quality.fit(START, rows).emit, quality.fit(START, rows, bodies).emit))


# -- queries, held-out accuracy


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if re.match(r"p[134567]_", n)])
def test_queries(spark, folder, name):
    df = catalogue.QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert df.columns == {"p1_found": ["id"], "p3_found": ["id"], "p4_found": ["id", "markup"], "p5_found": ["id", "line_no"], "p6_found": ["id", "line_no"], "p7_found": ["id"]}[name]
        assert len(set(rows)) == len(rows)


def test_agreement_with_labels_held_out(spark):
    """Models learned from one half of the labelled pages agree with the labels of the other, which are partly wrong by design."""
    folder = "/root/testdata/sf0.1"
    pages, votes = spark.read.parquet(f"{folder}/docs.parquet"), spark.read.parquet(f"{folder}/page_labels.parquet")
    half = F.pmod(F.crc32(F.col("doc_id").cast("binary")), F.lit(2))
    rows = boilerplate.labelled_pages(pages, votes.where(half == 0))
    test = boilerplate.labelled_pages(pages, votes.where(half == 1))
    tree = boilerplate.fit(rows)
    shapes, words, hmm = spam.fit(tree, rows), residue.fit(tree, rows), quality.fit(tree, rows)
    chosen = pages.join(F.broadcast(spark.createDataFrame([(r.id,) for r in test], "id string")), "id")
    kept = written(quality.not_prose_candidates(chosen, tree, hmm, shapes, words))
    said = {r.id: "other" for r in kept.where("bad").collect()} | {r.id: "error" for r in residue.decide(kept, words).collect()} | {r.id: "spam" for r in spam.spam_of(kept, shapes).collect()}
    right = sum(said.get(r.id, "prose") == ("other" if r.kind in ("list", "table", "junk") else r.kind) for r in test)
    assert right / len(test) > 0.85


@pytest.mark.parametrize("text", ["[" * 60_000, "[[a|" * 20_000, "x" * 100_000, "<a " * 30_000, "`a" * 30_000, "''a" * 30_000, "a " * 40_000, "$x" * 30_000, "](http://" * 10_000, "#a " * 30_000])
def test_hostile_texts_take_linear_time(text):
    import time

    began = time.process_time()
    body = boilerplate.body_lines(*boilerplate.BodyFinder(START)([text], ["a.b"], ["t"])[0][0])
    spam.shapes_of(body)
    residue.candidate(residue.Judge(), "i", "a.b", text, body)
    quality.Prose(HMM)([body])
    parts = markup.pieces(text)
    markup.clean(parts, ["html", "wiki", "latex"])
    markup.cleaned(text, markup.Weights())
    repeats.chunk_hashes([x.encode() for _, x in repeats.lines_of(text)])
    assert time.process_time() - began < 8
