"""Problem 5: the main body of a page, by a tree-structured graphical model over its blocks and lines.

A page is a tree: the root (the kind of page), below it blocks (runs of lines between blank lines,
rules and headings), below them lines, below each line two pieces of evidence: its form (what it
is built like, and whether it stands before, within or after the running text) and its words.
Root states are the label kinds, block and line states are content or boilerplate. Parent-child
potentials join root and block, block and line, line and evidence. Sum-product messages go up
(lines to blocks to root) and down again, which is exact on a tree, and give the marginal of
every line: a line no word of which was met in learning follows its form, its place and its block.

Potentials are learned by EM from a bounded sample of the labelled pages: the root is observed
there (majority label), line states are hidden. The word evidence is a logistic model over words
and pairs of words, fitted in each round to the expected states. No line is held fast and no phrase
is looked up: a few seed words only set the weights learning starts from.

All messages of one Arrow batch are computed together with numpy, so the work is linear in the
number of lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import current_pages, host, map_rows, page_texts, site_name

KINDS = ("prose", "list", "table", "junk", "spam", "error")

# Words of site text and of an article's own notes, from which learning of the words starts.
SEED_BOILERPLATE = frozenset(
    """about account archive blog careers community contact docs faq forum guides home imprint jobs login menu navigation news partners press pricing products register search services shop status support
    anleitungen anmelden archiv hilfe impressum inhalt konto kontakt menü preise produkte startseite suche accueil aide archives boutique connexion contenu compte légal recherche tarifs
    acceso archivo ayuda buscar contacto contenido cuenta foro guías inicio menú precios productos tienda
    skip jump toggle cookie cookies browser privacy consent newsletter copyright © rights reserved terms tags keywords related share shared previous next updated popular trending follow helpful subscribe
    datenschutz gewähr teilen geteilt schlagworte ähnliche vorherige nächste geändert aktualisiert beliebt folgen hilfreich rechte vorbehalten springen
    navigateur droits réservés légales garantie partager partagé liés précédente suivante suivez inscrivez aidé abonnez
    navegador derechos reservados aviso garantía comparta compartido relacionados anterior siguiente siga útil suscríbase boletín « »""".split()
)
SEED_CONTENT = frozenset("team staff editor redaktion rédaction redacción équipe equipo views steps opinions meinung schritte avis étapes opiniones pasos thanks advice copied".split())
#: Parameter: a line this likely to be boilerplate is none's only body.
SURE = 0.9999
#: Weights that seed words have before anything is learned, and the weight of a line without any.
SEED_WEIGHT, SEED_BASE = 1.6, -1.0

SYMBOLS = ("navlinks", "pipes", "crumb", "nearlink", "farlink", "anylink", "title", "heading", "code", "row", "bullet", "word", "short", "sentence", "text", "figures", "other")
_SYM = {s: i for i, s in enumerate(SYMBOLS)}
N_SYM = len(SYMBOLS)
_CODE, _HEADING, _TITLE, _FIGURES = (_SYM[s] for s in ("code", "heading", "title", "figures"))
#: Forms of running text, which tell where the body begins and ends if their words do not speak against it.
_BODY = np.zeros(N_SYM, bool)
_BODY[[_SYM[s] for s in ("title", "heading", "code", "row", "sentence", "text", "figures", "farlink")]] = True
#: Chance of boilerplate by form before anything is learned.
_START = {"navlinks": 0.9, "pipes": 0.8, "crumb": 0.85, "nearlink": 0.85, "word": 0.4, "short": 0.3, "bullet": 0.3, "other": 0.3, "anylink": 0.5, "farlink": 0.15, "title": 0.1, "heading": 0.2, "code": 0.02, "row": 0.05, "sentence": 0.15, "text": 0.15, "figures": 0.1}

_FENCE = re.compile(r"^ *(```|~~~)")
_RULE = re.compile(r"^[\s*_=-]*$")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]")
_NAVLINK = re.compile(r"\[([^\]\[]+)\]\(/[^)\s]*\)")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_ONE_LINK = re.compile(r"^\s*(?:(?:[-*+•]|\d+[.)])\s+)?\[[^\]]+\]\((https?://[^)\s]*)\)\s*$")
_HOST = re.compile(r"^https?://(?:[^/?#@]*@)?([^/?#:]+)")
_CRUMB_CUT = re.compile(r" (?:›|»|>|/|→) ")
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"\]\([^)\s]*\)|https?://\S+")
# With a pattern that finds the same in ASCII, only faster, in second place.
_DIGITS = re.compile(r"\d+"), re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[©«»›|~/=]"), re.compile(r"[A-Za-z]+|[0-9]+|[|~/=]")
_ENDS = frozenset(".!?:;…\"”»')")


def plain(line: str) -> str:
    """A line without marks around it, lower-cased, with single spaces."""
    return _SPACE.sub(" ", line.strip().strip("*_#").strip()).lower()


def tokens_of(line: str, name: str = "", head: str = "") -> list[str]:
    """Words, numbers (as 0) and a few marks of a line, lower-cased; ~ stands for the site's name, = for the page's title, addresses are left out."""
    low = line.lower()
    if "://" in low or "](" in low:
        low = _URL.sub(" ", low)
    if head:
        low = _SPACE.sub(" ", low).replace(head, " = ")
    if name and name in low:
        low = low.replace(name, " ~ ")
    plain_text = low.isascii()
    if (digits := _DIGITS[plain_text]).search(low):
        low = digits.sub("0", low)
    return _TOKEN[plain_text].findall(low)


def holds_title(line: str, head: str) -> bool:
    if len(line) < len(head):
        return False
    low = line.lower()
    return head in low or "  " in low and head in " ".join(low.split())


def line_form(line: str, site: str | None) -> int:
    """What a line with letters or digits, outside code, is built like. ``site``: host of the page, to tell its own links."""
    low = line.strip()
    if low[0] == "#" and low.lstrip("#")[:1].isspace():
        return _HEADING
    if low[0] == "|":
        return _SYM["row"]
    if "](/" in low and not _ALNUM.search(_NAVLINK.sub("", line)):
        return _SYM["navlinks"]
    if "://" in low:
        if m := _ONE_LINK.match(line):
            if not site:
                return _SYM["anylink"]
            h = _HOST.match(m.group(1).lower())
            h = h.group(1) if h else ""
            return _SYM["nearlink" if h.removeprefix("www.") == site else "farlink"]
        if len(_WORD.findall(_URL.sub(" ", low))) <= 9 * low.count("://"):
            return _SYM["farlink"]
    words = low.split()
    n = len(words)
    ends = low[-1] in _ENDS
    if n >= 3 and not ends and _CRUMB_CUT.search(line) and len(_CRUMB_CUT.split(line)[0].split()) <= 3:
        return _SYM["crumb"]
    if " | " in low and (parts := low.split(" | ")) and n <= 4 * len(parts):
        return _SYM["pipes"]
    if not _WORD.search(low):
        return _FIGURES
    if n >= 6 and ends:
        return _SYM["sentence"]
    if n >= 16:
        return _SYM["text"]
    if _BULLET.match(line):
        return _SYM["bullet"]
    return _SYM["word" if n == 1 else "short" if n <= 4 else "other"]


@dataclass
class Words:
    """Word evidence: log odds of boilerplate against content, a sum of weights of words and pairs of words."""

    base: float = SEED_BASE
    one: dict[str, float] = field(default_factory=lambda: {w: SEED_WEIGHT for w in SEED_BOILERPLATE} | {w: -SEED_WEIGHT for w in SEED_CONTENT})
    two: dict[tuple[str, str], float] = field(default_factory=dict)

    def __call__(self, tokens: list[str]) -> float:
        one, two = self.one, self.two
        own = list(map(one.get, set(tokens)))
        unknown = own.count(None)
        total = self.base + sum(filter(None, own))
        for f in self.strange(len(own), unknown):
            total += one.get(f, 0.0)
        if two:
            total += sum(filter(None, map(two.get, set(zip(("^", *tokens), (*tokens, "$"))))))
        return total

    @staticmethod
    def strange(words: int, unknown: int) -> tuple[str, ...]:
        """Features that tell how many of a line's words were never met."""
        return () if not unknown else ("?",) if unknown * 2 <= words else ("?", "??")


class WordFit:
    """Logistic regression of expected states on the words and pairs of words of lines, carried on from round to round.

    Features on fewer than ``least`` lines are left out. The penalty draws weights to the seeds, so words never met keep theirs."""

    def __init__(self, lines: list[list[str]], weight: np.ndarray, least: int = 3, decay: float = 1.0, seeds: Words | None = None) -> None:
        self.seeds = seeds = seeds or Words()
        count: dict = {}
        rows = [[*set(t), *set(zip(("^", *t), (*t, "$")))] for t in lines]
        for own, n in zip(rows, weight.tolist()):
            for f in own:
                count[f] = count.get(f, 0) + n
        self.place = {f: i for i, f in enumerate(["?", "??", *(f for f, n in count.items() if n >= least)])}
        size, cols = [0] * len(rows), []
        for i, own in enumerate(rows):
            words = [f for f in own if isinstance(f, str)]
            known = [self.place[f] for f in (*own, *Words.strange(len(words), sum(f not in self.place and f not in seeds.one for f in words))) if f in self.place]
            size[i] = len(known)
            cols += known
        self.weight, self.total, self.decay = weight, weight.sum(), decay
        self.at, self.col = np.repeat(np.arange(len(rows)), size), np.array(cols, np.int64)
        self.prior = np.array([seeds.one.get(f, 0.0) if isinstance(f, str) else 0.0 for f in self.place])
        self.w, self.base = self.prior.copy(), seeds.base
        self.first, self.second, self.step = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1), 0

    def odds(self) -> np.ndarray:
        return self.base + np.bincount(self.at, self.w[self.col], len(self.weight))

    def move(self, target: np.ndarray, steps: int) -> np.ndarray:
        """Steps of descent with momentum and scaled slopes; gives the evidence of each line."""
        for _ in range(steps):
            self.step += 1
            error = self.weight * (1 / (1 + np.exp(-self.odds())) - target)
            slope = np.r_[np.bincount(self.col, error[self.at], len(self.w)) + self.decay * (self.w - self.prior), error.sum() + self.decay * (self.base - self.seeds.base)]
            self.first = 0.8 * self.first + 0.2 * slope
            self.second = 0.95 * self.second + 0.05 * slope**2
            move = 0.25 * (self.first / (1 - 0.8**self.step)) / (np.sqrt(self.second / (1 - 0.95**self.step)) + 1e-9)
            self.w -= move[:-1]
            self.base -= move[-1]
        # the tree holds how much of the text is boilerplate: the evidence is what the words say beyond that
        share = min(max(float(self.weight @ target / self.total), 0.01), 0.99)
        self.shift = float(np.log(share / (1 - share)))
        return self.odds() - self.shift

    def words(self) -> Words:
        one, two = dict(self.seeds.one), {}
        for f, x in zip(self.place, self.w.tolist()):
            if isinstance(f, str):
                one[f] = x
            else:
                two[f] = x
        return Words(float(self.base - self.shift), one, two)


class LineReader:
    """Splits pages into lines with forms and word evidence. Lines met before are not looked at again (a bounded table)."""

    LIMIT = 200_000

    def __init__(self, words: Words) -> None:
        self.words = words
        self.met: dict[tuple[str | None, str], tuple[int, float]] = {}

    def page(self, text: str | None, site: str | None, title: str | None) -> tuple[list[str], list[int], list[int], list[float]]:
        """Lines; the form of each (-1: nothing to judge, as blank or a rule); the block of each (from 0); its word evidence."""
        lines = (text or "").replace("\r\n", "\n").split("\n") if "\r" in (text or "") else (text or "").split("\n")
        forms, blocks, odds, block, fence, met, fresh = [], [], [], 0, "", self.met, True
        name, head = site_name(site), plain(title or "")
        for line in lines:
            m = _FENCE.match(line) if line.lstrip(" ")[:3] in ("```", "~~~") else None
            word = 0.0
            if fence:
                form = _CODE
                if m and m.group(1) == fence:
                    fence = ""
                    fresh = False
            elif m:
                fence = m.group(1)
                block += not fresh
                fresh = False
                form = _CODE
            else:
                found = met.get((site, line))
                if found is None:
                    if _ALNUM.search(line):
                        found = line_form(line, site), self.words(tokens_of(line, name))
                    else:
                        found = (-2 if _RULE.match(line) else -1), 0.0
                    if len(line) < 120:
                        if len(met) > self.LIMIT:
                            met.clear()
                        met[site, line] = found
                form, word = found
                # that a line holds the page's own title is no property of the line, and is never remembered with it
                if head and form >= 0 and holds_title(line, head):
                    form, word = _TITLE if plain(line) == head else form, self.words(tokens_of(line, name, head))
                if form == -2:
                    block += not fresh
                    fresh, form = True, -1
                else:
                    if form in (_HEADING, _TITLE) and not fresh:
                        block += 1
                    fresh = False
            forms.append(form)
            blocks.append(block)
            odds.append(word)
        return lines, forms, blocks, odds


def _zones(form: np.ndarray, odds: np.ndarray, page: np.ndarray, n_pages: int) -> np.ndarray:
    """0 before the first line that looks like body, 2 after the last, 1 between."""
    at = np.arange(len(form))
    body = _BODY[form] & (odds <= 0)
    first = np.full(n_pages, len(form))
    last = np.full(n_pages, -1)
    np.minimum.at(first, page[body], at[body])
    np.maximum.at(last, page[body], at[body])
    return np.where(at < first[page], 0, np.where(at > last[page], 2, 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Pages:
    """Lines of many pages as a forest: symbol (form and zone), word evidence, block, page and place of each line."""

    sym: np.ndarray
    odds: np.ndarray
    block: np.ndarray
    page_of_block: np.ndarray
    page: np.ndarray
    where: np.ndarray
    size: int


@dataclass
class TreeModel:
    """Potentials. States 0 content, 1 boilerplate; K kinds of page; forms tripled by zone."""

    root: np.ndarray  # K
    block: np.ndarray  # K x 2
    line: np.ndarray  # 2 x 2, from block to line
    emit: np.ndarray  # K x 2 x (3 * N_SYM)
    words: Words = field(default_factory=Words)
    sample: int = 0

    @classmethod
    def start(cls) -> TreeModel:
        """Where learning starts: the chances of forms, a little boilerplate more outside the body."""
        k = len(KINDS)
        odds = np.repeat(np.array([_START[s] for s in SYMBOLS])[:, None], 3, 1)
        odds[:, 0] = np.minimum(odds[:, 0] * 1.3 + 0.05, 0.97)
        odds[:, 2] = np.minimum(odds[:, 2] * 1.3 + 0.05, 0.97)
        odds = odds.reshape(-1)
        emit = np.stack([1 - odds, odds])
        emit = np.repeat((emit / emit.sum(1, keepdims=True))[None], k, 0)
        return cls(np.full(k, 1 / k), np.full((k, 2), 0.5), np.array([[0.98, 0.02], [0.02, 0.98]]), emit)

    def marginals(self, x: Pages, kind: np.ndarray | None = None, full: bool = False, messages: bool = True):
        """Sum-product over a forest; blocks and pages are numbered without gaps, in order.

        ``kind`` (-1: open) fixes roots. Returns P(boilerplate) of each line and the roots' marginals. Without ``messages``
        every line is judged by its own evidence alone."""
        leaf = np.log(self.emit)[:, :, x.sym].transpose(2, 0, 1)  # lines, K, line state
        leaf = leaf + np.stack([np.zeros_like(x.odds), x.odds], 1)[:, None, :]
        if not messages:
            prior = (self.root[:, None] * self.block).sum(0) @ self.line
            own = (leaf + np.log(self.root)[None, :, None]).transpose(0, 2, 1)
            both = _log_sum(own, 2) + np.log(prior)[None]
            return np.exp(both[:, 1] - _log_sum(both, 1)), np.tile(self.root, (x.size, 1))
        joint = leaf[:, :, None, :] + np.log(self.line)[None, None]  # lines, K, block state, line state
        up = np.logaddexp(joint[..., 0], joint[..., 1])
        side = np.exp(joint[..., 1] - up)  # P(line is boilerplate | kind, block)
        n_blocks = len(x.page_of_block)
        below = np.zeros((n_blocks, len(KINDS), 2))
        self._sum(below, x.block, up)
        below += np.log(self.block)[None]
        to_root = _log_sum(below, 2)
        root = np.zeros((x.size, len(KINDS)))
        self._sum(root, x.page_of_block, to_root)
        root += np.log(self.root)[None]
        if kind is not None:
            known = kind >= 0
            mask = np.zeros((x.size, len(KINDS)))
            mask[known] = -1e9
            mask[np.flatnonzero(known), kind[known]] = 0
            root = root + mask
        root = np.exp(root - _log_sum(root, 1)[:, None])
        # down: root without the block's own message, times the block's messages
        given = np.exp(below - to_root[:, :, None])  # P(block state | kind, below)
        both = root[x.page_of_block][:, :, None] * given
        chance = (both[x.block] * side).sum((1, 2))
        return (chance, root, both, side) if full else (chance, root)

    @staticmethod
    def _sum(out: np.ndarray, key: np.ndarray, rows: np.ndarray) -> None:
        """out[key] += rows for ascending keys."""
        if len(key):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out[key[starts]] += np.add.reduceat(rows, starts, axis=0)

    def counted(self, x: Pages, kind: np.ndarray, prior: TreeModel) -> TreeModel:
        """One round of EM: expected states by messages, then counts, smoothed with the starting potentials as pseudo-counts."""
        _, root, both, side = self.marginals(x, kind, full=True)
        line = both[x.block][..., None] * np.stack([1 - side, side], -1)  # lines, K, block, line
        root_n = root.sum(0) + 1
        block_n = both.sum(0) + 2
        line_n = line.sum((0, 1)) + (20 + 0.5 * len(x.sym)) * prior.line
        emit_n = 30 * prior.emit + 0.0
        flat = line.sum(2)  # lines, K, line
        shared = np.zeros((2, emit_n.shape[2]))
        for state in (0, 1):
            shared[state] = np.bincount(x.sym, flat[:, :, state].sum(1), emit_n.shape[2])
            for k in range(len(KINDS)):
                emit_n[k, state] += np.bincount(x.sym, flat[:, k, state], emit_n.shape[2])
        # kinds with few pages lean on all pages together
        shared /= shared.sum(1, keepdims=True) + 1e-9
        emit_n += 50 * shared[None]
        return TreeModel(root_n / root_n.sum(), block_n / block_n.sum(1, keepdims=True), line_n / line_n.sum(1, keepdims=True), emit_n / emit_n.sum(2, keepdims=True), sample=len(kind))


class BodyFinder:
    """Pages in, for each line whether it is boilerplate. One object per task."""

    def __init__(self, model: TreeModel) -> None:
        self.model, self.reader = model, LineReader(model.words)

    def read(self, texts: list, sites: list, titles: list) -> tuple[list, Pages]:
        pages, form, odds, block, page_of_block, page, where = [], [], [], [], [], [], []
        base = 0
        for p, (text, site, title) in enumerate(zip(texts, sites, titles)):
            lines, forms, blocks, own = self.reader.page(text, site, title)
            pages.append((lines, forms))
            last = -1
            for i, s in enumerate(forms):
                if s >= 0:
                    if blocks[i] != last:
                        last = blocks[i]
                        page_of_block.append(p)
                        base += 1
                    form.append(s)
                    odds.append(own[i])
                    block.append(base - 1)
                    page.append(p)
                    where.append(i)
        form, odds, page = np.asarray(form, np.int64), np.asarray(odds, float), np.asarray(page, np.int64)
        sym = form * 3 + _zones(form, odds, page, len(pages)) if len(form) else form
        return pages, Pages(sym, odds, np.asarray(block, np.int64), np.asarray(page_of_block, np.int64), page, np.asarray(where, np.int64), len(pages))

    @staticmethod
    def _only_bodies(pages: list, x: Pages, chance: np.ndarray, drop: list[set[int]]) -> None:
        """A page has a body: where nothing but headings is left, the block that looks most like content stays, if it is of text.

        So a notice that is all a page has is its body, and the same notice beside real content is none."""
        form = x.sym // 3
        text = np.isin(form, [_SYM[s] for s in ("sentence", "text", "other", "short")])
        kept = np.bincount(x.page, (chance <= 0.5) & (form != _HEADING) & (form != _TITLE), x.size)
        open_ = np.flatnonzero(text & (kept[x.page] == 0) & (chance < SURE))
        best: dict[int, tuple[float, int]] = {}
        # lines of nothing but marks are not judged, and are a body all the same
        marks = {p for p in set(x.page[open_].tolist()) if any(f == -1 and not _RULE.match(line) for line, f in zip(*pages[p]))}
        open_ = open_[[p not in marks for p in x.page[open_].tolist()]]
        for n in open_.tolist():
            own = (float(chance[n]), int(x.block[n]))
            p = int(x.page[n])
            if p not in best or own < best[p]:
                best[p] = own
        for n in open_.tolist():
            if best[int(x.page[n])][1] == x.block[n]:
                drop[int(x.page[n])].discard(int(x.where[n]))

    def __call__(self, texts: list, sites: list, titles: list, messages: bool = True):
        """For each page its lines, their forms, and the set of the indices of boilerplate lines; then the roots' marginals."""
        pages, x = self.read(texts, sites, titles)
        drop: list[set[int]] = [set() for _ in pages]
        root = np.tile(self.model.root, (len(pages), 1))
        if len(x.sym):
            chance, root = self.model.marginals(x, messages=messages)
            for p, i in zip(x.page[chance > 0.5].tolist(), x.where[chance > 0.5].tolist()):
                drop[p].add(i)
            self._only_bodies(pages, x, chance, drop)
        return [(lines, forms, out) for (lines, forms), out in zip(pages, drop)], root


def body_lines(lines: list[str], forms: list[int], drop: set[int]) -> list[tuple[int, str, str]]:
    """The main body: (index, form, line) of each line with letters, digits or other marks that is not boilerplate; blank lines are left out, the title is a heading."""
    return [(i, "" if forms[i] < 0 else "heading" if forms[i] == _TITLE else SYMBOLS[forms[i]], line) for i, line in enumerate(lines) if i not in drop and (forms[i] >= 0 or line.strip())]


def bodies_of(model: TreeModel, rows: list) -> list[list[tuple[int, str, str]]]:
    """body_lines of labelled pages, from which the models that judge main bodies are learned."""
    found = BodyFinder(model)([r.content_markdown for r in rows], [r.site for r in rows], [r.title for r in rows])[0]
    return [body_lines(*f) for f in found]


def labelled_pages(docs: DataFrame, labels: DataFrame, sample: int = 2000, max_chars: int = 50_000) -> list:
    """Rows (id, site, title, content_markdown, links, kind) of at most ``sample`` labelled pages, those of the smallest hashed ids, of
    at most ``max_chars`` characters. Null labels are left out; of several labels of a page the most frequent counts, then the
    first by name. Only this bounded sample reaches the driver; it is where all models here are learned."""
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(*KINDS)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("kind"))
    chosen = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "kind")
    # at most `sample` rows of two short strings: safe to broadcast at any size of the tables
    few = docs.select("id", "url", "title", "content_markdown", "links", "crawled_at").join(F.broadcast(chosen), "id")
    rows = current_pages(few, "url", "title", "content_markdown", "links", "kind").where(F.length("content_markdown") <= max_chars)
    return sorted(rows.select("id", host(F.col("url")).alias("site"), "title", "content_markdown", "links", "kind").collect(), key=lambda r: r.id)


def fit(rows: list, rounds: int = 8, steps: int = 20) -> TreeModel:
    """Potentials from labelled pages by EM; without any the starting potentials stand."""
    start = TreeModel.start()
    kind = np.array([KINDS.index(r.kind) for r in rows])
    texts, sites, titles = [r.content_markdown for r in rows], [r.site for r in rows], [r.title for r in rows]
    pages, x = BodyFinder(start).read(texts, sites, titles)
    own = x.sym // 3 != _CODE
    if not own.any():
        return start
    # each distinct line once, by its tokens
    distinct: dict[tuple[str, ...], int] = {}
    names, heads = [site_name(s) for s in sites], [plain(t or "") for t in titles]
    of = np.array([distinct.setdefault(tuple(tokens_of(pages[p][0][i], names[p], heads[p])), len(distinct)) for p, i in zip(x.page[own].tolist(), x.where[own].tolist())])
    times = np.bincount(of).astype(float)
    words, model = WordFit([list(t) for t in distinct], times), start
    for _ in range(rounds):
        chance, _ = model.marginals(x, kind)
        model = model.counted(x, kind, start)
        # equal lines lean on each other: what most places of a line say is sharpened before the words learn it
        share = np.bincount(of, chance[own]) / times
        x.odds[own] = words.move(share**2 / (share**2 + (1 - share) ** 2), steps)[of]
        x.sym = x.sym // 3 * 3 + _zones(x.sym // 3, x.odds, x.page, x.size)
    return replace(model.counted(x, kind, start), words=words.words())


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, max_chars: int = 50_000) -> TreeModel:
    return fit(labelled_pages(docs, labels, sample, max_chars))


def boilerplate_lines(docs: DataFrame, model: TreeModel) -> DataFrame:
    """(id, line_no) of the boilerplate lines of current pages. Null or empty content gives no line."""
    def make():
        find = BodyFinder(model)

        def work(b):
            ids, numbers = [], []
            for page_id, (_, _, drop) in zip(b["id"], find(b["content_markdown"], b["site"], b["title"])[0]):
                ids += [page_id] * len(drop)
                numbers += [i + 1 for i in sorted(drop)]
            return {"id": ids, "line_no": numbers}

        return work

    return map_rows(page_texts(docs), make, "id string, line_no int")


def main_bodies(docs: DataFrame, model: TreeModel) -> DataFrame:
    """(id, body, removed): each current page's main body and the numbers of the lines taken away."""
    def make():
        find = BodyFinder(model)

        def work(b):
            found = find(b["content_markdown"], b["site"], b["title"])[0]
            return {"id": b["id"], "body": ["\n".join(x for i, x in enumerate(lines) if i not in drop).strip("\n") for lines, _, drop in found], "removed": [[i + 1 for i in sorted(drop)] for _, _, drop in found]}

        return work

    return map_rows(page_texts(docs), make, "id string, body string, removed array<int>")
