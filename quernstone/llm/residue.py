"""Problem 3: unfilled templates, filler, failed output and error messages in place of content.

The main body is cut into segments (lines, and sentences within them). In a segment numbers, dates,
addresses and the name of the site are masked and the rest is hashed; equal hashes of all bodies are
counted over distinct sources, with how much of their pages they hold. Only messages that recur
widely are classified: by their words, by phrase rules as one piece of evidence among these, and by
how alone they stand (a message that is all its pages have is no part of an article), with weights
learned from a bounded sample of labelled pages. Unfilled placeholders and filler words differ from
page to page, so they are told by rules of their own. A page is out if such segments hold most of its
words, or if its title is an unfilled placeholder.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.boilerplate import BodyFinder, TreeModel, WordFit, Words, bodies_of, body_lines, tokens_of
from quernstone.llm.common import filler_words, map_rows, page_texts, runs_of_letters, site_name

#: Parameters: sources on which a message must recur to be judged; share of the words that residue must hold.
SOURCES, SHARE = 3, 0.5

# Ways to write a template's placeholder. The first group that is set is its name.
_PLACEHOLDER = re.compile(
    r"\{\{\s*([A-Za-z_][\w.]*)\s*(?:\|\s*[\w.]+\s*)?\}\}|\$\{\s*([A-Za-z_][\w.]*)\s*\}|<%=?\s*([A-Za-z_][\w.]*)\s*%>|@@([A-Za-z_]\w*)@@"
    r"|(?<![\w#])#([A-Z][A-Z_]*)#(?!\w)|\[(?:INSERT |insert |Insert )([^\]\[]+?)(?: HERE| here)?\](?!\()|\[([A-Z][A-Z_]{2,})\](?!\()|(?<!\w)__([A-Z][A-Z_]*[A-Z])__(?!\w)"
    r"|<([A-Za-z_]+) goes here>|(?<![\w%])%([A-Za-z_]{3,})%(?!\w)|(?<![\w${#\\])\{([a-z]+(?:_[a-z]+)*)\}"
)
_OPENS = re.compile(r"[{$<@#\[_%]")
# Usual names of template fields.
_FIELDS = frozenset("author category city company country customer date default description email first_name headline last_name name order page page_title phone price product product_name subject summary tagline text title url user user_name username".split())

# Titles left as a template has them.
_BLANK_TITLES = re.compile(r"^(your (title|headline|heading|text) here|title here|sample (page|post)|new (page|post|document)|untitled( (page|document|post))?|heading \d+|page title|lorem ipsum.*|insert title.*|hello world!?)$")

# Usual wordings of failed output and of messages, on a masked lower-cased segment: one piece of evidence. ~ stands for the site's name.
_STRONG = re.compile(
    r"\[object object\]|\bundefined undefined\b|\binvalid date\b.*|\bhello (null|undefined)\b|\b(null|undefined|nan) (items?|messages|results) in (null|undefined)\b|^(uncaught )?(typeerror|referenceerror|syntaxerror|valueerror|keyerror|attributeerror|nullpointerexception|runtimeerror)\b ?:?|cannot read propert(y|ies)\b|^(warning|fatal|fatal error|notice|parse error|critical): .*|could not connect to (the )?(database|server|host)\b|failed to open stream|^traceback \(most recent|stack trace:|^exception in thread|sql syntax|sqlstate\["
    r"|\btodo write\b|\bthis is (sample|placeholder|dummy) text\b|goes in this place\b|^click edit to change\b|^add a short description of your\b|replace it with your own\b|lorem ipsum"
)
_MESSAGE = re.compile(
    r"\bpage (you|that you).*(not be found|not found|no longer|is gone)|\bcould not be found\b|^(\W*\d+\W*)?page not found|\bthis page is gone\b|\bsession has (ended|expired)\b|^session expired|^checking your browser\b|^this can take a few seconds|^just a moment|^loading\b"
    r"|\bjavascript\b.*\b(to run|switched off|enable|turn on|required|disabled)\b|\b(enable|activate|turn on) (javascript|scripts)\b|\bbrowser is (not supported|out of date|too old)|\b(do not|don't) have (permission|access|the right)\b|^access (denied|forbidden)|^forbidden\b|\bsomething went wrong\b|^please try again later|\bdown for (planned )?maintenance\b|^service unavailable|\bsent more requests than\b|^too many requests|\brate limit\b|^we looked everywhere\b|^try the search box\b|^internal server error|^bad gateway|^gateway time-?out"
    r"|\bkeine berechtigung\b|^zugriff verweigert|\baktivieren sie (bitte )?(javascript|skripte)|\binterner fehler\b|^bitte versuchen sie es später|\bgesuchte seite\b.*\bnicht\b|^seite nicht gefunden|\bwartungsarbeiten\b|\bsitzung ist abgelaufen\b"
    r"|\bn'existe plus sur\b|^la page que vous cherchez|\ble service est fermé\b|^revenez plus tard|\bpas le droit de voir\b|\bdevez activer (javascript|les scripts)|^accès refusé|^page introuvable|^une erreur\b.*\bs'est produite|\bvotre session a expiré"
    r"|\bno tiene permiso\b|\bya no existe en\b|^la página que busca|\bha fallado en el servidor\b|^inténtelo de nuevo|\bdebe activar (javascript|los scripts)|^acceso denegado|^página no encontrada|\bsu sesión ha (caducado|expirado)|\ben mantenimiento\b"
)
_WEAK = re.compile(r"\b(error|not found|denied|forbidden|unavailable|expired|maintenance|unsupported|try again|reload|sign in again|captcha|fehler|verweigert|abgelaufen|nicht gefunden|erreur|refusé|introuvable|indisponible|denegado|no encontrada|caducad[oa]|no disponible)\b")
# Pieces of text one of which every match of the rules holds. They are looked for first, since that takes a tenth of the time.
_STRONG_PIECES = tuple(
    """[object object]|undefined undefined|invalid date|hello | in null| in undefined|eerror|xerror|yerror|nullpointerexception|cannot read propert|warning: |fatal: |error: |notice: |critical: |could not connect to
    |failed to open stream|traceback (most recent|stack trace:|exception in thread|sql syntax|sqlstate[|todo write|this is sample|this is placeholder|this is dummy|goes in this place|click edit to change
    |add a short description of your|replace it with your own|lorem ipsum""".replace("\n    ", "").split("|")
)
_MESSAGE_PIECES = tuple(
    """page you|page that you|could not be found|page not found|this page is gone|session has |session expired|checking your browser|this can take a few seconds|just a moment|loading|javascript| scripts|browser is |have permission
    |have access|have the right|access denied|access forbidden|forbidden|something went wrong|please try again later|maintenance|service unavailable|sent more requests than|too many requests|rate limit|we looked everywhere
    |try the search box|internal server error|bad gateway|gateway time|keine berechtigung|zugriff verweigert|aktivieren sie |interner fehler|bitte versuchen sie es später|gesuchte seite|seite nicht gefunden|wartungsarbeiten
    |sitzung ist abgelaufen|n'existe plus sur|la page que vous cherchez|le service est fermé|revenez plus tard|pas le droit de voir|devez activer |accès refusé|page introuvable|s'est produite|votre session a expiré
    |no tiene permiso|ya no existe en|la página que busca|ha fallado en el servidor|inténtelo de nuevo|debe activar |acceso denegado|página no encontrada|su sesión ha |en mantenimiento""".replace("\n    ", "").split("|")
)
_WEAK_PIECES = tuple("error|not found|denied|forbidden|unavailable|expired|maintenance|unsupported|try again|reload|sign in again|captcha|fehler|verweigert|abgelaufen|nicht gefunden|erreur|refusé|introuvable|indisponible|denegado|no encontrada|caducad|no disponible".split("|"))
_RULES = ((2, _STRONG_PIECES, _STRONG), (2, _MESSAGE_PIECES, _MESSAGE), (1, _WEAK_PIECES, _WEAK))
# Words one of which every rule above needs; a segment without any is under no rule, and is not masked.
_HINTS = frozenset(
    """object undefined invalid null nan connect critical typeerror referenceerror syntaxerror valueerror keyerror attributeerror nullpointerexception runtimeerror property properties warning fatal notice parse
    stream traceback stack exception sql sqlstate todo sample placeholder dummy goes edit description replace lorem page found session checking take moment loading javascript scripts browser
    permission access right forbidden wrong try down maintenance service requests rate looked internal gateway berechtigung zugriff skripte fehler versuchen seite wartungsarbeiten sitzung
    existe revenez cherchez droit activer accès erreur expiré permiso busca fallado inténtelo activar acceso página sesión mantenimiento
    error denied unavailable expired unsupported reload sign captcha verweigert abgelaufen gefunden refusé introuvable indisponible denegado encontrada caducado caducada disponible""".split()
)
# A reference beside a message says nothing either way.
_NEUTRAL = re.compile(r"^(ref|reference|path|url|host|server|time|request id|error id|trace|trace id|code|incident|ray id)\b\W*\w+\W*$|^\W*$")
_WORD = re.compile(r"[^\W\d_]+")
# Blanks after a mark. The blank stands first in the pattern, since it is what is looked for fastest.
_SENTENCE = re.compile(r"\s(?<=[.!?:]\s)\s*")
_INLINE = re.compile(r"`[^`\n]*`")
_MASK = re.compile(r"<?(?:https?://|www\.)[^\s>)]+>?|[\w.+-]+@[\w-]+\.[\w.]+|\d+(?:[.,:/-]\d+)*")
# Addresses within a machine: paths and files; and the names of things in program output.
_PATH = re.compile(r"(?:/[\w.-]+)+/?|\b[\w-]+\.(?:[a-z]{2,4}|html)\b")
# A reference in brackets at the end.
_TRAIL = re.compile(r"[(\[][\w-]+[)\]]$")
_DIGIT = re.compile(r"\d")
_THINGS = frozenset("attribute class column database field file function host index key method module object property table user variable".split())
_NAMED = re.compile(rf"\b({'|'.join(sorted(_THINGS))}) ['\"`]?[\w.-]+['\"`]?")
_SPACE = re.compile(r"\s+")


def mask(text: str, name: str = "", words: list[str] | None = None) -> str:
    """Lower-cased, single spaces; addresses, paths and files become @, numbers and dates 0, the site's own name ~, names of things in program output *.
    ``words``: its words if they are known, to tell at once that no things are named."""
    text = " ".join(text.split()).lower()
    if name and name in text:
        text = text.replace(name, "~")
    if "://" in text or "@" in text or _DIGIT.search(text):
        text = _MASK.sub(lambda m: "0" if m.group(0)[0].isdigit() else "@", text)
    if "/" in text or "." in text[:-1]:
        text = _PATH.sub("@", text)
    if text.endswith((")", "]")):
        text = _TRAIL.sub("(*)", text)
    return text if words is not None and _THINGS.isdisjoint(words) else _NAMED.sub(r"\1 *", text)


def placeholders(text: str) -> list[str]:
    return [next(g for g in m.groups() if g) for m in _PLACEHOLDER.finditer(text)] if _OPENS.search(text) else []


def title_unfilled(title: str | None, name: str = "") -> bool:
    """A title that is a blank of the template or holds a placeholder. A title of several words in which
    a placeholder without a usual field name stands talks about placeholders and is none."""
    text = _SPACE.sub(" ", (title or "").strip())
    if not text:
        return False
    head = re.split(r" [-|–] (?=[^-|–]*$)", text)[0]
    if _BLANK_TITLES.match(head.lower()):
        return True
    names = placeholders(text)
    if not names:
        return False
    rest = [w for w in _WORD.findall(_PLACEHOLDER.sub(" ", head)) if w.lower() != name]
    return len(rest) <= 2 or any(n.strip().lower().replace(" ", "_") in _FIELDS for n in names)


#: Bounds of the mean share of its page that a message holds, and the starting weights of their ranges and of the rules.
ALONE = (0.05, 0.15, 0.3)
_SEEDS = {"<0>": -2.5, "<1>": -1.2, "<2>": 0.8, "<3>": 2.5, "<rule>": 2.5, "<weak>": 0.8}


def start_words() -> Words:
    """Evidence before anything is learned."""
    return Words(-0.8, dict(_SEEDS), {})


def rule_of(masked: str, words: set[str] | list[str]) -> int:
    """Phrase rules on a masked segment: 0 none, 1 weak, 2 strong."""
    if _HINTS.isdisjoint(words):
        return 0
    plain = masked.strip("*_#>-• ")
    for rule, pieces, pattern in _RULES:
        for piece in pieces:
            if piece in plain:
                if pattern.search(plain):
                    return rule
                break
    return 0


def unfilled(part: str, words: list[str]) -> bool:
    """A segment of unfilled placeholders or of filler words."""
    held = placeholders(part)
    return bool(held) and len(words) <= 25 * len(held) or len(words) >= 3 and filler_words(words) * 10 >= 6 * len(words)


def segments_of(body: list[tuple[int, str, str]], name: str) -> list[tuple[str, list[str], bool]]:
    """(masked text, words, unfilled) of the segments of a body outside code. Headings count only if nothing else is there; references beside a message do not count."""
    out, heads = [], []
    for _, sym, line in body:
        if sym == "code":
            continue
        if "`" in line:
            line = _INLINE.sub(" ", line)
        if sym == "heading":
            heads.append(line.lstrip("# "))
            continue
        for part in _SENTENCE.split(line.strip()) if len(line) > 40 else (line,):
            if words := runs_of_letters(part.lower()):
                masked = mask(part, name, words)
                if len(words) > 4 or not _NEUTRAL.match(masked):
                    out.append((masked, words, unfilled(part, words)))
    return out or [(mask(x, name), w, unfilled(x, w)) for x in heads if (w := _WORD.findall(x.lower()))]


class Judge:
    """Evidence of masked segments, without how alone they stand. Segments met before are remembered, within a bound."""

    LIMIT = 100_000

    def __init__(self, words: Words | None = None) -> None:
        self.words = words or start_words()
        self.met: dict[str, float] = {}

    def score(self, masked: str, words: list[str]) -> float:
        found = self.met.get(masked)
        if found is None:
            found = self.words(evidence(masked, words))
            if len(masked) <= 200:
                if len(self.met) > self.LIMIT:
                    self.met.clear()
                self.met[masked] = found
        return found


def evidence(masked: str, words: list[str]) -> list[str]:
    rule = rule_of(masked, words)
    return [*tokens_of(masked), *(("<rule>",) if rule == 2 else ("<weak>",) if rule else ())]


def alone_range(share: float) -> int:
    return sum(share >= x for x in ALONE)


def fit(tree: TreeModel, rows: list, steps: int = 120, bodies: list | None = None) -> Words:
    """Evidence of messages from the labelled pages (see boilerplate.labelled_pages): of the segments on two of their sources or more, how
    many of their pages are labelled as errors. Without any the starting weights stand. ``bodies``: of the rows, if they are known."""
    start = start_words()
    if not rows:
        return start
    met: dict[str, list] = {}
    for r, body in zip(rows, bodies or bodies_of(tree, rows)):
        own = segments_of(body, site_name(r.site))
        total = sum(len(w) for _, w, _ in own)
        share: dict[str, float] = defaultdict(float)
        for masked, words, blank in own:
            if not blank:
                share[masked] += len(words) / total
                met.setdefault(masked, [words, set(), 0, 0, 0.0])
        for masked, x in share.items():
            seen = met[masked]
            seen[1].add(r.site or "")
            seen[2] += 1
            seen[3] += r.kind == "error"
            seen[4] += x
    messages = [(m, *x) for m, x in met.items() if len(x[1]) >= 2]
    if not messages:
        return start
    lines = [[*evidence(m, w), f"<{alone_range(share / n)}>"] for m, w, _, n, _, share in messages]
    learned = WordFit(lines, np.array([float(n) ** 0.5 for _, _, _, n, _, _ in messages]), least=2, seeds=start)
    learned.move(np.array([e / n for _, _, _, n, e, _ in messages]), steps)
    learned.shift = 0.0  # nothing else holds how many messages are residue
    return learned.words()


CANDIDATES = "id string, site string, title_hit boolean, words int, blank int, segments array<struct<hash:bigint,words:int,score:float>>"


def candidate(judge: Judge, page_id: str, site: str | None, title: str | None, body) -> dict:
    """A page's row of CANDIDATES: each distinct message of its body once, with all its words there.

    A message's evidence is the same wherever it stands, so it is looked at only where the message holds ``ALONE[1]`` of a page or has a
    word of a rule; one that does so nowhere is part of longer texts and no residue."""
    name = site_name(site)
    total, blank, held = 0, 0, {}
    for masked, words, empty in segments_of(body, name):
        total += len(words)
        if empty:
            blank += len(words)
        else:
            own = held.get(masked)
            held[masked] = (len(words) + (own[0] if own else 0), words)
    least = ALONE[1] * total
    segments = [{"hash": xxhash.xxh64_intdigest(m) - (1 << 63), "words": n, "score": judge.score(m, w) if n >= least or not _HINTS.isdisjoint(w) else None} for m, (n, w) in held.items()]
    return {"id": page_id, "site": site or "", "title_hit": title_unfilled(title, name), "words": total, "blank": blank, "segments": segments}


def _alone_weight(words: Words, share: Column) -> Column:
    weight = [F.lit(words.one[f"<{k}>"]) for k in range(len(ALONE) + 1)]
    out = weight[0]
    for bound, w in zip(ALONE, weight[1:]):
        out = F.when(share >= bound, w).otherwise(out)
    return out


def messages_of(parts: DataFrame, words: Words, sources: int, *keys: str) -> DataFrame:
    """(keys, sources, pages, alone, residue) of the messages on at least so many sources. ``parts``: rows of keys, site, words, n and score.

    Counts are taken by (message, source) first, so that a message on a third of all pages is no hot group."""
    per = parts.groupBy(*keys, "site").agg(F.count("*").alias("pages"), F.sum(F.col("n") / F.greatest("words", F.lit(1))).alias("alone"), F.max("score").alias("score"))
    whole = per.groupBy(*keys).agg(F.count("*").alias("sources"), F.sum("pages").alias("pages"), F.sum("alone").alias("alone"), F.max("score").alias("score")).where(F.col("sources") >= sources)
    alone = F.col("alone") / F.col("pages")
    return whole.select(*keys, "sources", "pages", alone.alias("alone"), F.coalesce(F.col("score") + _alone_weight(words, alone) >= 0, F.lit(False)).alias("residue"))


def decide(candidates: DataFrame, words: Words, sources: int = SOURCES, share: float = SHARE) -> DataFrame:
    """(id, title_hit, share) of the pages to leave out. ``candidates`` is read twice: give it written or checkpointed."""
    parts = candidates.select("id", "site", "words", F.explode("segments").alias("s")).select("id", "site", "words", F.col("s.hash").alias("hash"), F.col("s.words").alias("n"), F.col("s.score").alias("score"))
    known = messages_of(parts, words, sources, "hash").where("residue").select("hash")
    held = parts.select("id", "hash", "n").join(known, "hash").groupBy("id").agg(F.sum("n").alias("held"))
    part = (F.coalesce("held", F.lit(0)) + F.col("blank")) / F.greatest("words", F.lit(1))
    judged = candidates.select("id", "title_hit", "words", "blank").join(held, "id", "left").select("id", "title_hit", part.alias("share"))
    return judged.where(F.col("title_hit") | (F.col("share") >= share))


def residue_candidates(docs: DataFrame, model: TreeModel, words: Words) -> DataFrame:
    """CANDIDATES of the current pages. Null or empty texts have no segments."""

    def make():
        find, judge = BodyFinder(model), Judge(words)

        def work(b):
            rows = [candidate(judge, i, s, t, body_lines(*f)) for i, s, t, f in zip(b["id"], b["site"], b["title"], find(b["content_markdown"], b["site"], b["title"])[0])]
            return {k: [r[k] for r in rows] for k in ("id", "site", "title_hit", "words", "blank", "segments")}

        return work

    return map_rows(page_texts(docs), make, CANDIDATES)


def recurring_messages(docs: DataFrame, model: TreeModel, words: Words, sources: int = SOURCES) -> DataFrame:
    """(message, sources, pages, alone, residue) of all masked segments of main bodies, whatever they are, that stand on at least so many
    sources: the classified messages of the whole crawl. Segments of one page count once; pages without a host share one source."""

    def make():
        find, judge = BodyFinder(model), Judge(words)

        def work(b):
            out = {"site": [], "message": [], "words": [], "n": [], "score": []}
            for site, found in zip(b["site"], find(b["content_markdown"], b["site"], b["title"])[0]):
                own: dict[str, list] = {}
                total = 0
                for masked, w, _ in segments_of(body_lines(*found), site_name(site)):
                    total += len(w)
                    own.setdefault(masked, [0, w])[0] += len(w)
                for masked, (n, w) in own.items():
                    score = judge.score(masked, w) if n >= ALONE[1] * total or not _HINTS.isdisjoint(w) else None
                    for k, v in zip(out, (site or "", masked, total, n, score)):
                        out[k].append(v)
            return out

        return work

    return messages_of(map_rows(page_texts(docs), make, "site string, message string, words int, n int, score double"), words, sources, "message")
