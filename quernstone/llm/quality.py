"""Problem 7: statistics of a page's text, and its lines labelled prose, list, table or junk by a hidden Markov model.

What is seen of a line are its statistics, each in a few ranges: shares of letters, digits, other marks
and common words, number and length of words, fields, numbers among the tokens, words mixed with
digits or broken by marks, how it begins and ends. States are the four labels; transitions and the
chances of every range are learned on a bounded sample of labelled pages: the pages' labels name the
states of their lines at first, then most likely paths correct them (Viterbi training, which lets
short lists within prose, headings in tables and wrong labels go their own way). The most likely path
of all pages of a batch is found together, step by step, with numpy. Shares are by characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quernstone.llm.boilerplate import BodyFinder, TreeModel, Words, bodies_of, body_lines
from quernstone.llm.common import COMMON, map_rows, page_texts, runs_of_letters
from quernstone.llm.residue import CANDIDATES, Judge, candidate
from quernstone.llm.spam import SHAPES, ShapeModel, Shaper

LABELS = ("prose", "list", "table", "junk")

_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_LINK = re.compile(r"\[([^\[\]\n]*)\]\([^)\s]*\)|<?https?://[^\s>]+>?")
_MOJIBAKE = re.compile(r"[ÃÂ][\x80-\xbf©¨¼¶¤Ÿ±³¡\xad]|â€|ï¿½|�")
_NUMBER = re.compile(r"(?<![^\s|;,(])[-+]?[$€£]?\d[\d.,:%/-]*(?![^\s|;,)])")
_INNER = re.compile(r"[^\W\d_][^\w\s'’.,/@&:;+)(\-\]\[]+(?=[^\W_])|[^\W\d_][01](?=[^\W\d_])")
_MIXED = re.compile(r"\b(?:[^\W\d_]+\d|\d+[^\W\d_])\w*")
# Markup is no sign of broken text.
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--|-->|&#?\w+;|\[\[(?:[^\[\]|\n]*\|)?|\]\]|\'\'\'?|\{\{|\}\}|\\[A-Za-z]+|\$[^$\n]*[\\^_][^$\n]*\$|\\[()]")
# In second place what finds the same in ASCII, only faster.
_DIGITS = re.compile(r"\d+"), re.compile(r"[0-9]+")
_ENDS = frozenset(".!?:…\"”»")

#: What is counted of a line.
COUNTS = ("chars", "words", "letters", "digits", "marks", "common")
#: Bounds of the ranges of each statistic of a line.
RANGES = {
    "letters": (0.2, 0.45, 0.65, 0.75),
    "digits": (0.01, 0.08, 0.2, 0.4),
    "marks": (0.02, 0.06, 0.12, 0.3),
    "common": (0.01, 0.1, 0.2, 0.35),
    "words": (1, 3, 5, 10, 25),
    "length": (2.5, 4.0, 6.0, 9.0),
    "fields": (1, 2, 4),
    "numbers": (0.1, 0.3, 0.6),
    "mixed": (0.05, 0.2, 0.4),
    "broken": (0.02, 0.06, 0.15),
    "longest": (16, 30, 50),
    "ends": (1,),
    "item": (1,),
}
NAMES = tuple(RANGES)
_BOUNDS = [np.array(RANGES[k]) for k in NAMES]
_SIZES = [len(b) + 1 for b in _BOUNDS]


def observe(line: str) -> tuple[list[float], tuple[int, ...]]:
    """Statistics of a line in the order of RANGES, and the COUNTS they come from."""
    text = _LINK.sub(r"\1", line) if "](" in line or "://" in line else line
    bullet = _BULLET.match(text)
    text = (text[bullet.end() :] if bullet else text).strip()
    if "<" in text or "\\" in text or "[[" in text or "''" in text or "&" in text or "$" in text or "{{" in text:
        text = _MARKUP.sub(" ", text).strip()
    size = max(len(text), 1)
    ascii_ = text.isascii()
    words = runs_of_letters(text.lower() if ascii_ else text)
    tokens = text.split()
    n, letters = len(words), len("".join(words))
    digits = len("".join(_DIGITS[ascii_].findall(text)))
    marks = max(len("".join(tokens)) - letters - digits, 0)
    common = sum(map(COMMON.__contains__, words if ascii_ else map(str.lower, words)))
    fields = text.strip("|").count("|") + text.count("\t") + text.count(";") + (line.lstrip()[:1] == "|")
    count = max(len(tokens), 1)
    broken = len(_INNER.findall(text)) if digits or marks * 25 >= size else 0
    if not ascii_:
        broken += len(_MOJIBAKE.findall(text))
    numbers = len(_NUMBER.findall(text)) if digits else 0
    mixed = len(_MIXED.findall(text)) if digits else 0
    seen = [letters / size, digits / size, marks / size, common / max(n, 1), n, letters / max(n, 1), fields, numbers / count, mixed / count, broken / count, max(map(len, tokens), default=0), text[-1:] in _ENDS and n > 4, bool(bullet)]
    return seen, (size, n, letters, digits, marks, common)


_RULE = re.compile(r"^[\s|:*_=-]*$")


def judged_lines(body: list[tuple[int, str, str]]) -> list[str]:
    """The lines that are judged: no headings, code or rules."""
    return [line for _, sym, line in body if sym not in ("heading", "code") and (sym or not _RULE.match(line))]


def sequences(lines: list[list[str]], at_once: int = 10_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each body's judged lines their COUNTS, and their rows of ranges with the number of characters last. ``at_once``: lines put into ranges together."""
    out, seen, first = [], [], 0
    for i, own in enumerate(lines):
        seen += map(observe, own)
        if len(seen) >= at_once or i + 1 == len(lines):
            cuts = np.cumsum([len(x) for x in lines[first:i]], dtype=np.int64)
            raw, counts = np.array([x for x, _ in seen], float).reshape(-1, len(NAMES)), np.array([x for _, x in seen], np.int64).reshape(-1, len(COUNTS))
            ranges = np.stack([*(np.searchsorted(b, raw[:, j], side="right") for j, b in enumerate(_BOUNDS)), counts[:, 0]], 1).astype(np.int64)
            out += zip(np.split(counts, cuts), np.split(ranges, cuts))
            seen, first = [], i + 1
    return out


#: Chances of ranges before anything is learned, where they are not even: by label, statistic and range.
_START = {
    "prose": {"common": (0.05, 0.15, 0.3, 0.3, 0.2), "words": (0.01, 0.03, 0.06, 0.3, 0.4, 0.2), "ends": (0.15, 0.85), "letters": (0.01, 0.04, 0.15, 0.3, 0.5), "fields": (0.94, 0.03, 0.02, 0.01), "numbers": (0.9, 0.08, 0.01, 0.01), "mixed": (0.9, 0.08, 0.01, 0.01), "broken": (0.85, 0.1, 0.04, 0.01)},
    "list": {"common": (0.85, 0.06, 0.04, 0.03, 0.02), "letters": (0.01, 0.03, 0.1, 0.26, 0.6), "marks": (0.6, 0.25, 0.1, 0.04, 0.01), "words": (0.03, 0.55, 0.3, 0.1, 0.015, 0.005), "ends": (0.97, 0.03), "fields": (0.94, 0.03, 0.02, 0.01), "numbers": (0.9, 0.05, 0.03, 0.02), "mixed": (0.9, 0.06, 0.02, 0.02), "broken": (0.85, 0.1, 0.04, 0.01), "longest": (0.9, 0.08, 0.01, 0.01)},
    "table": {"common": (0.85, 0.06, 0.04, 0.03, 0.02), "words": (0.15, 0.35, 0.25, 0.15, 0.07, 0.03), "longest": (0.88, 0.1, 0.01, 0.01), "broken": (0.85, 0.1, 0.04, 0.01), "mixed": (0.85, 0.1, 0.03, 0.02), "ends": (0.97, 0.03), "digits": (0.1, 0.2, 0.25, 0.25, 0.2), "fields": (0.1, 0.22, 0.36, 0.32), "numbers": (0.15, 0.15, 0.3, 0.4)},
    "junk": {"common": (0.8, 0.1, 0.06, 0.03, 0.01), "letters": (0.3, 0.25, 0.25, 0.15, 0.05), "fields": (0.8, 0.1, 0.06, 0.04), "mixed": (0.3, 0.15, 0.2, 0.35), "broken": (0.25, 0.15, 0.25, 0.35), "longest": (0.5, 0.15, 0.15, 0.2), "marks": (0.2, 0.15, 0.15, 0.25, 0.25)},
}
#: Parameter: what the evidence of one line is worth; the statistics are not independent of each other.
TEMPER = 0.5


@dataclass
class LineHMM:
    """Log potentials: start (4), change (4 x 4), and for each statistic 4 x its ranges."""

    start: np.ndarray
    change: np.ndarray
    emit: list[np.ndarray]
    sample: int = 0

    @classmethod
    def begin(cls) -> LineHMM:
        """Potentials without any labelled page; the pseudo-counts of learning."""
        emit = []
        for name, size in zip(NAMES, _SIZES):
            rows = np.array([_START[label].get(name, (1 / size,) * size) for label in LABELS], float) + 0.004
            emit.append(np.log(rows / rows.sum(1, keepdims=True)))
        change = np.full((4, 4), 0.03) + np.eye(4) * 0.88
        return cls(np.log(np.full(4, 0.25)), np.log(change / change.sum(1, keepdims=True)), emit)

    def evidence(self, seen: np.ndarray) -> np.ndarray:
        """Log evidence of lines for each label. A long line weighs more, with the logarithm of its length."""
        total = sum(e[:, seen[:, j]] for j, e in enumerate(self.emit)).T
        return total * TEMPER * (1 + np.log2(np.maximum(seen[:, -1] / 64, 1)))[:, None]

    def paths(self, seen: list[np.ndarray], changes: bool = True) -> list[np.ndarray]:
        """Most likely states of each sequence. Sequences are sorted by length, so that a step only touches those still running.
        Without ``changes`` every line is judged by itself."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
        if not any(len(s) for s in seen):
            return out
        whole = self.evidence(np.concatenate([s for s in seen if len(s)]))
        at, own = 0, []
        for s in seen:
            own.append(whole[at : at + len(s)])
            at += len(s)
        if not changes:
            return [(e + self.start).argmax(1) if len(e) else o for e, o in zip(own, out)]
        order = sorted((i for i in range(len(seen)) if len(seen[i])), key=lambda i: -len(seen[i]))
        at = 0
        while at < len(order):
            steps = len(seen[order[at]])
            group = order[at : at + max(1, 1_000_000 // steps)]  # memory: about a million cells at once
            n = np.array([len(seen[i]) for i in group])
            grid = np.zeros((len(group), steps, 4))
            for r, i in enumerate(group):
                grid[r, : n[r]] = own[i]
            score = self.start + grid[:, 0]
            back = np.zeros((len(group), steps, 4), np.int8)
            for t in range(1, steps):
                live = int(np.searchsorted(-n, -t, side="left"))  # sequences longer than t
                step = score[:live, :, None] + self.change[None]
                best = step.argmax(1)
                back[:live, t] = best
                score[:live] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + grid[:live, t]
            state = score.argmax(1)
            path = np.zeros((len(group), steps), np.int64)
            for t in range(steps - 1, -1, -1):
                ends = n - 1 == t
                inside = n - 1 > t
                path[ends, t] = state[ends]
                if t + 1 < steps:
                    path[inside, t] = back[inside, t + 1, path[inside, t + 1]]
            for r, i in enumerate(group):
                out[i] = path[r, : n[r]]
            at += len(group)
        return out

    def counted(self, seen: list[np.ndarray], paths: list[np.ndarray], weight: float = 30.0) -> LineHMM:
        """Potentials counted on lines with states, over the starting ones as pseudo-counts. Every page counts for its lines' square root."""
        prior = LineHMM.begin()
        start, change = np.exp(prior.start) * 8, np.exp(prior.change) * 100
        emit = [np.exp(e) * weight for e in prior.emit]
        for s, path in zip(seen, paths):
            if len(s):
                share = len(s) ** -0.5
                start[path[0]] += 1
                np.add.at(change, (path[:-1], path[1:]), share)
                for j, e in enumerate(emit):
                    np.add.at(e, (path, s[:, j]), share)
        return LineHMM(np.log(start / start.sum()), np.log(change / change.sum(1, keepdims=True)), [np.log(e / e.sum(1, keepdims=True)) for e in emit], len(seen))

    def learn(self, seen: list[np.ndarray], labels: list[int], rounds: int = 3) -> LineHMM:
        """States of the labelled pages' lines are the page's label at first; then the most likely paths, with the label favoured,
        less in each round and not at all in the last, so that wrong labels wash out."""
        model = self
        for step in range(rounds):
            paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
            for label in range(4):
                own = [i for i, x in enumerate(labels) if x == label]
                if not step:
                    for i in own:
                        paths[i] = np.full(len(seen[i]), label)
                    continue
                lift = np.zeros((4, 1))
                lift[label] = 3.0 * (1.0 - step / max(rounds - 1, 1)) / len(NAMES)
                lean = LineHMM(model.start, model.change, [e + lift for e in model.emit])
                for i, path in zip(own, lean.paths([seen[i] for i in own])):
                    paths[i] = path
            model = self.counted(seen, paths)
        return model


def fit(model: TreeModel, rows: list, bodies: list | None = None) -> LineHMM:
    """From the labelled pages (see boilerplate.labelled_pages) whose kind is prose, list, table or junk; without any the starting potentials stand.
    ``bodies``: of the rows, if they are known."""
    own = [i for i, r in enumerate(rows) if r.kind in LABELS]
    if not own:
        return LineHMM.begin()
    rows = [rows[i] for i in own]
    bodies = [bodies[i] for i in own] if bodies else bodies_of(model, rows)
    seen = [ranges for _, ranges in sequences([judged_lines(body) for body in bodies])]
    return LineHMM.begin().learn(seen, [LABELS.index(r.kind) for r in rows])


class Prose:
    """Statistics and label shares of bodies, many at once."""

    def __init__(self, hmm: LineHMM, changes: bool = True) -> None:
        self.hmm, self.changes = hmm, changes

    def __call__(self, bodies: list[list[tuple[int, str, str]]]) -> list[dict[str, float]]:
        judged = [judged_lines(body) for body in bodies]
        out = []
        for lines, (counts, path) in zip(judged, self._labelled(judged)):
            size, total = counts[:, 0], dict(zip(COUNTS, counts.sum(0).tolist()))
            chars, words = max(total["chars"], 1), max(total["words"], 1)
            ends = sum(line.rstrip()[-1:] in (".", "!", "?", ":") for line in lines)
            row = {"lines": len(lines), "words": total["words"], "mean_word": total["letters"] / words, "mark_ratio": total["marks"] / chars, "digit_ratio": total["digits"] / chars, "end_ratio": ends / max(len(lines), 1), "common_ratio": total["common"] / words}
            for i, label in enumerate(LABELS):
                row[label] = float(size[path == i].sum() / size.sum()) if len(lines) else 0.0
            out.append(row)
        return out

    def _labelled(self, judged: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = sequences(judged)
        return list(zip([counts for counts, _ in found], self.hmm.paths([ranges for _, ranges in found], self.changes)))

    def not_prose(self, bodies: list[list[tuple[int, str, str]]]) -> list[bool]:
        """Whether lists, tables and junk hold NOT_PROSE of the characters of each body, without its other statistics."""
        size = [(counts[:, 0], path) for counts, path in self._labelled([judged_lines(body) for body in bodies])]
        return [len(n) > 0 and 1 - float(n[path == 0].sum() / n.sum()) >= NOT_PROSE for n, path in size]


STATS = ("lines", "words", "mean_word", "mark_ratio", "digit_ratio", "end_ratio", "common_ratio", *LABELS)
#: Parameter: a body is not prose if lists, tables and junk hold this share of its characters.
NOT_PROSE = 0.65


def page_quality(docs: DataFrame, model: TreeModel, hmm: LineHMM) -> DataFrame:
    """One row of statistics and label shares per current page. Empty pages have zeros."""

    def make():
        find, prose = BodyFinder(model), Prose(hmm)

        def work(b):
            rows = prose([body_lines(*f) for f in find(b["content_markdown"], b["site"], b["title"])[0]])
            return {"id": b["id"], **{k: [r[k] for r in rows] for k in STATS}}

        return work

    return map_rows(page_texts(docs), make, "id string, lines int, words int, mean_word double, mark_ratio double, digit_ratio double, end_ratio double, common_ratio double, prose double, list double, table double, junk double")


def not_prose_candidates(docs: DataFrame, model: TreeModel, hmm: LineHMM, shapes: ShapeModel, messages: Words) -> DataFrame:
    """Current pages with whether their body is mostly list, table or junk, and with what spam.spam_of and residue.decide need, from one pass:
    messages and shapes are counted over all pages."""

    def make():
        find, prose, judge, shape = BodyFinder(model), Prose(hmm), Judge(messages), Shaper(shapes)

        def work(b):
            bodies = [body_lines(*f) for f in find(b["content_markdown"], b["site"], b["title"])[0]]
            rows = [candidate(judge, i, s, t, body) for i, s, t, body in zip(b["id"], b["site"], b["title"], bodies)]
            out = {k: [r[k] for r in rows] for k in ("id", "site", "title_hit", "words", "blank", "segments")}
            return out | shape(bodies, b["links"], b["site"]) | {"bad": prose.not_prose(bodies)}

        return work

    return map_rows(page_texts(docs, "links"), make, f"{CANDIDATES}, {SHAPES}, bad boolean")
