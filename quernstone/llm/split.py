"""Problem 10: texts over a token limit in pieces under it, cut at natural boundaries, with overlap.

For every token position of a text its farthest legal successor is known: the next cut such that
a piece starting ``overlap`` tokens before the position stays within the limit, at the last
paragraph end, line end, sentence end or word end there is, in this order of worth, or after the
last whole character. Squaring the table of successors again and again (pointer doubling) finds
all cuts of the greedy chain from the start in a number of rounds that grows with the logarithm of
the number of pieces; no cut waits for the one before.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import map_rows
from quernstone.llm.tokens import encoding

LIMIT, OVERLAP = 1500, 100
#: A natural boundary counts if it leaves at least this share of the room used.
FILL = 0.5

_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n\s*")
_LINE = re.compile(rb"\n")
_SENTENCE = re.compile(rb"[.!?][\"')\]]*\s|(?:\xe2\x80\xa6|\xe3\x80\x82)\s?")
_SPACE = re.compile(rb"\s(?=\S)")


def chain(successor: np.ndarray) -> np.ndarray:
    """Positions reached from 0 by a table of successors (ends point to themselves), by pointer doubling."""
    reached = np.zeros(len(successor), bool)
    reached[0] = True
    jump = successor
    while True:
        more = np.zeros_like(reached)
        more[jump[np.flatnonzero(reached)]] = True
        if not (more & ~reached).any():
            return np.flatnonzero(reached)
        reached |= more
        jump = jump[jump]


def successors(n: int, ranks: list[np.ndarray], limit: int, overlap: int, fill: float = FILL) -> np.ndarray:
    """Farthest legal next cut of each position 0..n. ``ranks``: sorted positions of the boundaries, best kind first; the last holds all legal ones."""
    here = np.arange(n + 1)
    start = np.maximum(here - overlap, 0)
    far = np.minimum(start + limit, n)
    room = far - here
    out = np.full(n + 1, -1, np.int64)
    for k, bounds in enumerate(ranks):
        at = np.searchsorted(bounds, far, side="right") - 1
        found = np.where(at >= 0, bounds[np.maximum(at, 0)], -1)
        last = k == len(ranks) - 1
        legal = (found > here) & ((found - here >= fill * room) | last)
        out = np.where((out < 0) & legal, found, out)
    out = np.where(out < 0, far, out)
    out[far == n] = n
    return out


def cuts_of(data: bytes, lengths: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Token positions of the cuts (first 0, last n), and the byte offsets of all token positions."""
    offsets = np.r_[0, np.cumsum(lengths)]
    n = len(lengths)
    token_at = np.full(len(data) + 1, -1, np.int64)
    token_at[offsets] = np.arange(n + 1)

    def tokens(ends) -> np.ndarray:
        at = token_at[np.fromiter(ends, np.int64)]
        return np.unique(at[at > 0])

    # a position inside a character is no place to cut
    whole = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    legal = np.unique(np.r_[token_at[whole], n])
    legal = legal[legal > 0]
    # a token often starts with the white space before a word: the place before that space counts as well as the one after
    paragraphs = tokens(p for m in _PARAGRAPH.finditer(data) for p in range(m.start(), m.end() + 1))
    lines = tokens(p for m in _LINE.finditer(data) for p in (m.start(), m.end()))
    sentences = tokens(p for m in _SENTENCE.finditer(data) for p in (m.end() - 1, m.end()))
    words = tokens(p for m in _SPACE.finditer(data) for p in (m.start(), m.end()))
    ends = np.array([n])
    ranks = [np.unique(np.r_[x, ends]) for x in (paragraphs, lines, sentences, words)]
    return chain(successors(n, [*ranks, legal], limit, overlap)), offsets


def pieces_of(text: str, enc, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]]:
    """(piece, tokens, tokens shared with the piece before, its first character's place in the text). A text within the limit is one piece.

    Every piece is counted anew by itself; should one exceed the limit there (cutting can split a merge), the text is cut again
    with a slightly lower one. Where the overlap leaves no room to go lower, a piece that is still too long shares less with the one before.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return [(text, len(ids), 0, 0)]
    data = text.encode()
    whole = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char_at = np.r_[0, np.cumsum(whole)]
    lengths = np.array([len(enc.decode_single_token_bytes(i)) for i in ids], np.int64)
    aim = limit
    while True:
        cuts, offsets = cuts_of(data, lengths, aim, overlap)
        out, fits = [], True
        last = aim <= overlap + 1
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            start = max(a - overlap, 0)
            while start > 0 and not whole[offsets[start]]:
                start -= 1
            piece = data[offsets[start] : offsets[b]].decode()
            n = len(enc.encode_ordinary(piece))
            while last and n > limit and start < a:
                start += 1
                while start < a and not whole[offsets[start]]:
                    start += 1
                piece = data[offsets[start] : offsets[b]].decode()
                n = len(enc.encode_ordinary(piece))
            fits &= n <= limit
            out.append((piece, n, a - start, int(char_at[offsets[start]])))
        if fits or last:
            return out
        aim = max(aim - 16, overlap + 1)


PIECES = "doc_id bigint, piece int, text string, n_tokens int, shared int, start int, doc_tokens int"


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None) -> DataFrame:
    """PIECES of every text over the limit; others give no row. Null texts neither. Rows without doc_id are left out.

    A token has at least one byte, so texts of no more bytes than the limit are told apart without tokenizing.
    """

    def make():
        enc = encoding(vocabulary)

        def work(b):
            out = {k: [] for k in ("doc_id", "piece", "text", "n_tokens", "shared", "start", "doc_tokens")}
            for doc_id, text in zip(b["doc_id"], b["text"]):
                n = len(enc.encode_ordinary(text))
                if n <= limit:
                    continue
                for k, (piece, size, shared, start) in enumerate(pieces_of(text, enc, limit, overlap)):
                    for name, value in zip(out, (doc_id, k, piece, size, shared, start, n)):
                        out[name].append(value)
            return out

        return work

    long = documents.select("doc_id", "text").where("doc_id is not null").where(F.octet_length("text") > limit)
    return map_rows(long, make, PIECES)
