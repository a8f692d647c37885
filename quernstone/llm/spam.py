"""Problem 1: pages of stuffed keywords, link lists or product tags, by the shapes of their lines.

Each line of the main body (headings and code aside) is reduced to a shape: links and what stands
beside them, tags, how much its words echo the rest of the page, number of words, capitals,
separators, how it ends, and how many outgoing links the page has for its lines. A shape is one
of ``CODES`` numbers, so a table of all shapes is bounded whatever the crawl is.

Which shapes are those of sentences is learned: a logistic model over the parts of a shape, from a
bounded sample of labelled pages, gives every shape a first score; then shapes are grouped over
the whole crawl, and each is judged by the company it keeps: the share of spam on all the pages it is
on. A page is spam if shapes that are not those of sentences hold most of its text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.boilerplate import BodyFinder, TreeModel, bodies_of, body_lines
from quernstone.llm.common import COMMON, map_rows, page_texts, runs_of_letters
from quernstone.session import written

# In ASCII: the capital at the beginning of a word.
_CAPITAL = re.compile(r"[A-Z](?<![A-Za-z][A-Z])")
# Scripts written without spaces: a run of them is cut into pairs of characters.
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^)\s]*[^)\n]*\)|<?(https?://[^\s>)]+)>?")
_TAG = re.compile(r"(?<![^\s,;|])#[^\W_]\w*")
_MARKS = re.compile(r"[★»•]")

#: Sizes of the parts of a shape: links, tags, echo, words, capitals, separators, sentence end, outgoing links of the page.
PARTS = (5, 3, 6, 6, 3, 5, 2, 4)
CODES = int(np.prod(PARTS))
ECHO = (0.008, 0.02, 0.04, 0.07, 0.12)
#: Parameters: share of the body's characters that spam shapes must hold; characters of a shape's first score beside those of the crawl.
SHARE, PRIOR_CHARS = 0.5, 2000
#: Pages of a kind below which the starting weights count for more than the labels.
FEW = 10
#: A body with fewer words and links than this is not judged.
LEAST = 5


def _bucket(x: float, bounds: tuple) -> int:
    return bisect_right(bounds, x)


def words_of(text: str, raw: list[str] | None = None) -> list[str]:
    """Lower-cased words (``raw``: if they are known already); where a script has no spaces, pairs of characters."""
    if text.isascii():
        return runs_of_letters(text.lower())
    words = list(map(str.lower, runs_of_letters(text) if raw is None else raw))
    if _UNSPACED.search(text):
        words = [p for w in words for p in ([w[i : i + 2] for i in range(max(len(w) - 1, 1))] if _UNSPACED.match(w) else [w])]
    return words


def shapes_of(body: list[tuple[int, str, str]], outgoing: int = 0) -> tuple[dict[int, int], int]:
    """Characters by shape code, and the words and links of the body. ``outgoing``: links of the page to other hosts."""
    parsed, everything, n_links = [], [], 0
    for _, sym, line in body:
        if sym in ("heading", "code"):
            continue
        text, links = line, []
        if "](" in line or "://" in line:
            links = _LINK.findall(line)
            text = _LINK.sub(" ", line)
            n_links += len(links)
        anchors = " ".join(a for a, _ in links)
        tags = _TAG.findall(text) if "#" in text else []
        raw = None if text.isascii() else runs_of_letters(text)
        upper = len(_CAPITAL.findall(text)) if raw is None else sum([w[0].isupper() for w in raw])
        beside, inside = words_of(text, raw), words_of(anchors) if anchors else []
        everything += beside
        everything += inside
        parsed.append((line, text, links, tags, beside, inside, upper))
    count, total = Counter(everything), len(everything)
    held: dict[int, int] = defaultdict(int)
    load = _bucket(outgoing / max(len(parsed), 1), (0.01, 0.5, 0.9))
    scale = 1 / max(total, 1)
    for line, text, links, tags, beside, inside, upper in parsed:
        words = beside + inside
        n = len(words)
        link = 0
        if links:
            link = 4 if not inside and len(beside) < 3 * len(links) else 3 - _bucket(len(beside) / len(links), (3, 8))
        tag = 0 if not tags else 2 if sum(map(len, tags)) * 2 >= len(text.strip()) else 1
        # how often a word of the line is met again on the page, per word of the page: prose says most of its words once or twice
        own = [w for w in words if w not in COMMON]
        echo = _bucket((sum(map(count.__getitem__, own)) - len(own)) / len(own) * scale, ECHO) if own else 0
        capitals = 0 if not upper else 2 if upper * 2 > len(beside) else 1
        seps = 1 if " | " in text or ">>" in text or not text.isascii() and _MARKS.search(text) else 2 if text.count(",") * 4 >= max(n, 1) and "," in text else 3 if text.count("/") + text.count(";") >= 2 else 4 if "!" in text or "%" in text else 0
        ends = text.rstrip()[-1:] in (".", "!", "?", "。", "！", "？")
        code = 0
        for size, x in zip(PARTS, (link, tag, echo, _bucket(n, (1, 3, 7, 16, 41)), capitals, seps, int(ends), load)):
            code = code * size + x
        held[code] += len(line)
    return held, total + n_links


def parts_of(codes: np.ndarray) -> np.ndarray:
    out = []
    for size in reversed(PARTS):
        out.append(codes % size)
        codes = codes // size
    return np.stack(out[::-1], 1)


_OFFSET = np.r_[0, np.cumsum(PARTS)]
# Pairs of parts that tell more together: echo with length, with the end and with separators; links with outgoing links and with length.
_PAIRS = ((2, 3), (2, 6), (2, 5), (0, 7), (0, 3))


def _features(codes: np.ndarray) -> np.ndarray:
    """Columns of the features of each code, one a part and one a pair."""
    parts = parts_of(np.asarray(codes, np.int64))
    cols = [_OFFSET[i] + parts[:, i] for i in range(len(PARTS))]
    base = int(_OFFSET[-1])
    for a, b in _PAIRS:
        cols.append(base + parts[:, a] * PARTS[b] + parts[:, b])
        base += PARTS[a] * PARTS[b]
    return np.stack(cols, 1)


N_FEATURES = int(_OFFSET[-1]) + sum(PARTS[a] * PARTS[b] for a, b in _PAIRS)


@dataclass
class ShapeModel:
    """Log odds of a line of a shape to be spam: a weight for each part and pair of parts, and a base."""

    weights: np.ndarray
    base: float = -2.2
    sample: int = 0

    @classmethod
    def start(cls) -> ShapeModel:
        """Weights before anything is learned: links without words beside them, tags and echo speak for spam, a sentence's end against it."""
        w = np.zeros(N_FEATURES)
        w[_OFFSET[0] : _OFFSET[1]] = (0, -1.0, -1.0, 3.0, 4.5)
        w[_OFFSET[1] : _OFFSET[2]] = (0, 0.3, 4.0)
        w[_OFFSET[2] : _OFFSET[3]] = (-0.5, -0.3, 0.2, 1.6, 3.2, 3.6)
        w[_OFFSET[3] : _OFFSET[4]] = (-1.0, -1.2, 0, 0.3, 0.6, 0.6)
        w[_OFFSET[6] : _OFFSET[7]] = (0, -0.4)
        w[_OFFSET[7] : _OFFSET[8]] = (0, 0, 0.1, 0.4)
        return cls(w)

    def chance(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.weights[_features(codes)].sum(1)))) if len(codes) else np.zeros(0)

    def learn(self, pages: list[dict[int, int]], spam: list[bool], steps: int = 300, decay: float = 1.0) -> ShapeModel:
        """Logistic regression over the lines of labelled pages, a line weighing its share of its page; drawn to the starting weights."""
        weight: dict[tuple[int, bool], float] = defaultdict(float)
        for held, y in zip(pages, spam):
            whole = sum(held.values())
            for code, n in held.items():
                weight[code, y] += n / whole
        if not weight:
            return self
        codes, y, v = np.array([c for c, _ in weight]), np.array([float(t) for _, t in weight]), np.array(list(weight.values()))
        # both kinds of pages weigh the same, however rare spam is in the sample, unless it holds hardly any
        v *= np.where(y > 0, (v[y == 0].sum() + FEW) / (v[y > 0].sum() + FEW), 1.0)
        cols = _features(codes)
        start, w, base = self.weights, self.weights.copy(), self.base
        first, second = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
        for step in range(1, steps + 1):
            error = v * (1 / (1 + np.exp(-(base + w[cols].sum(1)))) - y)
            slope = np.r_[np.bincount(cols.reshape(-1), np.repeat(error, cols.shape[1]), N_FEATURES) + decay * (w - start), error.sum() + decay * (base - self.base)]
            first, second = 0.9 * first + 0.1 * slope, 0.98 * second + 0.02 * slope**2
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-9)
            w, base = w - move[:-1], base - float(move[-1])
        return ShapeModel(w, base, len(pages))


def foreign_links(links: list | None, site: str | None) -> int:
    """Links of a page that lead to other hosts; without a host of its own all do."""
    return sum(bool(x) and x[:4].lower() == "http" and (not site or f"{site}/" not in f"{x}/") for x in links or ())


def fit(tree: TreeModel, rows: list, bodies: list | None = None) -> ShapeModel:
    """Shapes of sentences and of spam, from the labelled pages (see boilerplate.labelled_pages); without any the starting weights stand.
    ``bodies``: of the rows, if they are known."""
    start = ShapeModel.start()
    if not rows:
        return start
    shapes = [shapes_of(body, foreign_links(r.links, r.site)) for body, r in zip(bodies or bodies_of(tree, rows), rows)]
    judged = [(held, r.kind == "spam") for (held, n), r in zip(shapes, rows) if held and n >= LEAST]
    return start.learn([h for h, _ in judged], [y for _, y in judged])


SHAPES = "shapes array<struct<code:int,chars:int>>, first double"


class Shaper:
    """Columns of SHAPES for bodies. ``first``: share of spam by the first scores; null for a body that is not judged."""

    def __init__(self, model: ShapeModel) -> None:
        self.model = model
        self.met: dict[int, float] = {}

    def __call__(self, bodies: list, links: list, sites: list) -> dict[str, list]:
        out: dict[str, list] = {"shapes": [], "first": []}
        for body, own, site in zip(bodies, links, sites):
            held, n = shapes_of(body, foreign_links(own, site))
            whole = sum(held.values())
            if not whole or n < LEAST:
                out["shapes"].append([])
                out["first"].append(None)
                continue
            new = [c for c in held if c not in self.met]
            if new:
                self.met.update(zip(new, self.model.chance(np.array(new)).tolist()))
            out["shapes"].append([{"code": c, "chars": k} for c, k in held.items()])
            out["first"].append(sum(self.met[c] * k for c, k in held.items()) / whole)
        return out


def page_shapes(docs: DataFrame, tree: TreeModel, model: ShapeModel) -> DataFrame:
    """(id, SHAPES) of the current pages whose body can be judged."""

    def make():
        find, shape = BodyFinder(tree), Shaper(model)

        def work(b):
            bodies = [body_lines(*f) for f in find(b["content_markdown"], b["site"], b["title"])[0]]
            out = {"id": b["id"], **shape(bodies, b["links"], b["site"])}
            keep = [i for i, x in enumerate(out["shapes"]) if x]
            return {k: [v[i] for i in keep] for k, v in out.items()}

        return work

    return map_rows(page_texts(docs, "links"), make, "id string, " + SHAPES)


def shape_scores(pages: DataFrame, model: ShapeModel, prior: int = PRIOR_CHARS) -> DataFrame:
    """(code, spam): how much of the text around a shape is spam over the whole crawl, drawn to the shape's first score. At most CODES rows.

    Counts are summed before the shuffle, which holds at most CODES rows of each task."""
    parts = pages.where("first is not null").select("first", F.explode("shapes").alias("s"))
    sums = parts.groupBy(F.col("s.code").alias("code")).agg(F.sum(F.col("s.chars") * F.col("first")).alias("spam"), F.sum("s.chars").alias("chars"))
    return sums.select("code", _drawn(model, prior).alias("spam"))


def _drawn(model: ShapeModel, prior: int) -> Column:
    """The sum of spam of a shape with ``prior`` characters of its first score, as an expression over the parts of its code."""
    code, logit, place = F.col("code"), F.lit(model.base), []
    for size in reversed(PARTS):
        place.append(F.pmod(code, F.lit(size)).cast("int"))
        code = F.floor(code / size).cast("int")
    place = place[::-1]
    weights = model.weights.tolist()
    take = lambda a, b, i: F.element_at(F.array(*[F.lit(x) for x in weights[a:b]]), i + 1)
    for i, p in enumerate(place):
        logit = logit + take(int(_OFFSET[i]), int(_OFFSET[i + 1]), p)
    base = int(_OFFSET[-1])
    for a, b in _PAIRS:
        logit = logit + take(base, base + PARTS[a] * PARTS[b], place[a] * PARTS[b] + place[b])
        base += PARTS[a] * PARTS[b]
    return (F.col("spam") + prior / (1 + F.exp(-logit))) / (F.col("chars") + prior)


def spam_of(pages: DataFrame, model: ShapeModel, share: float = SHARE) -> DataFrame:
    """(id, shapes, share) of the pages that shapes of spam dominate: how many such shapes there are, and their share of the text.

    ``pages`` is read twice: give it written or checkpointed."""
    scores = shape_scores(pages, model).where(F.col("spam") >= 0.5).select("code")
    parts = pages.where("first is not null").select("id", F.aggregate("shapes", F.lit(0), lambda a, s: a + s["chars"]).alias("whole"), F.explode("shapes").alias("s")).select("id", "whole", F.col("s.code").alias("code"), F.col("s.chars").alias("chars"))
    # at most CODES numbers: safe to broadcast at any size of the crawl
    held = parts.join(F.broadcast(scores), "code").groupBy("id").agg(F.count("*").cast("int").alias("shapes"), (F.sum("chars") / F.first("whole")).alias("share"))
    return held.where(F.col("share") >= share)


def spam_pages(docs: DataFrame, tree: TreeModel, model: ShapeModel) -> DataFrame:
    """spam_of the current pages. Pages without content are none."""
    return spam_of(written(page_shapes(docs, tree, model)), model)
