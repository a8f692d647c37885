"""Problem 6: text that comes back on page after page of one host, by content-defined chunks.

Texts are cut into chunks where a rolling hash over the last bytes meets a mask, so that equal text is
cut alike wherever it stands, and documents are counted per (host, chunk). Two results come of it.
``repeated_chunks`` lets chunks run across line breaks and finds passages within lines and over several
lines. ``repeated_lines`` answers in whole lines: there a line break is one more content-defined cut, so a
repeated line has all its chunks repeated wherever it stands; lines whose most telling chunk is not are
out, and what is left is counted exactly per (host, line). ``cut_pages`` takes both out of the texts.
Counts are taken over all documents, and pre-aggregated before the shuffle, so a chunk on a third of all
pages is no hot group.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import current_pages, host, map_rows
from quernstone.llm.markup import pieces

#: Parameters: ids of a host a line must be on; words a line needs; window of the rolling hash in bytes; bits of the cut mask (mean chunk of 2^bits bytes).
IDS, WORDS, WINDOW, BITS = 5, 4, 16, 6

_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^ *(```|~~~)")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GEAR = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64)


def normal(line: str) -> str:
    """A line as it is compared: trimmed, single spaces, lower-cased, runs of digits as 0."""
    return _DIGITS.sub("0", " ".join(line.split()).lower())


def _has_words(line: str, n: int = WORDS) -> bool:
    return next(islice(_WORD.finditer(line), n - 1, None), None) is not None


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(line_no, normalised line) of the lines that can be cases: outside code, not starting with #, of at least four words."""
    out, fence = [], ""
    for number, line in enumerate((text or "").split("\n"), 1):
        m = _FENCE.match(line) if line.lstrip(" ")[:3] in ("```", "~~~") else None
        if fence:
            fence = "" if m and m.group(1) == fence else fence
        elif m:
            fence = m.group(1)
        elif line[:1] != "#" and _has_words(line):
            own = normal(line)
            if own[:1] != "#":
                out.append((number, own))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, _INVERSE, np.uint64)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def chunk_hashes(lines: list[bytes], window: int = WINDOW, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all lines: (line of each chunk, its 64-bit hash, its length). Empty lines have none.

    The rolling hash of a position covers the last ``window`` bytes of its line; the hash of a chunk
    is polynomial, from prefix sums, so both cost a few passes over the bytes however long the lines are.
    """
    data = np.frombuffer(b"".join(lines), np.uint8)
    size = np.array([len(x) for x in lines], np.int64)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    line = np.repeat(np.arange(len(lines)), size)
    into = np.arange(n) - starts[line]
    rolling = np.zeros(n, np.uint64)
    gear = _GEAR[data]
    factor = 1
    for back in range(min(window, n)):
        part = gear[: n - back] * np.uint64(factor)
        rolling[back:] += np.where(into[back:] >= back, part, np.uint64(0))
        factor = factor * int(_BASE) % (1 << 64)
    cut = ((rolling >> np.uint64(40)) & np.uint64((1 << bits) - 1)) == 0
    cut &= into >= window - 1
    cut[ends[size > 0] - 1] = True
    last = np.flatnonzero(cut)
    first = np.r_[0, last[:-1] + 1]
    with np.errstate(over="ignore"):
        up, down = _powers(n)
        prefix = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
        whole = prefix[last] - np.where(first > 0, prefix[np.maximum(first - 1, 0)], np.uint64(0))
        value = whole * down[first]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    return line[last], value, last - first + 1


LINES = "id string, site string, lines array<struct<line_no:int,key:bigint,probe:bigint,once:boolean>>, chunks array<bigint>"


def chunked_pages(docs: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """Per current page with a host: its lines with key and probing chunk (the longest), and its distinct chunks."""
    pages = current_pages(docs, "url", "content_markdown").select("id", host(F.col("url")).alias("site"), "content_markdown").where("site is not null")

    def make():
        def work(b):
            found = [lines_of(t) for t in b["content_markdown"]]
            flat = [x.encode() for lines in found for _, x in lines]
            line, value, length = chunk_hashes(flat, window, bits)
            value = value.view(np.int64)
            bounds = np.searchsorted(line, np.arange(len(flat) + 1))
            order = np.lexsort((-length, line))
            probe = value[order][np.searchsorted(line, np.arange(len(flat)))].tolist() if len(flat) else []
            out = {"id": [], "site": [], "lines": [], "chunks": []}
            at = 0
            for page, site, lines in zip(b["id"], b["site"], found):
                seen, own = set(), []
                for k, (number, _) in enumerate(lines, at):
                    key = xxhash.xxh64_intdigest(flat[k]) - (1 << 63)
                    own.append({"line_no": number, "key": key, "probe": probe[k], "once": key not in seen})
                    seen.add(key)
                chunks = np.unique(value[bounds[at] : bounds[at + len(lines)]]).tolist() if lines else []
                at += len(lines)
                if own:
                    out["id"].append(page)
                    out["site"].append(site)
                    out["lines"].append(own)
                    out["chunks"].append(chunks)
            return out

        return work

    return map_rows(pages, make, LINES)


def repeated_lines(chunked: DataFrame, ids: int = IDS) -> DataFrame:
    """(id, line_no, site, ids): lines on at least ``ids`` pages of their host. ``chunked`` is read twice: give it checkpointed."""
    counts = chunked.select("site", F.explode("chunks").alias("probe")).groupBy("site", "probe").count().where(F.col("count") >= ids).select("site", "probe")
    lines = chunked.select("id", "site", F.explode("lines").alias("l")).select("id", "site", "l.*")
    near = lines.join(counts, ["site", "probe"])
    # the exact check: pages per (host, whole line); `once` marks the first time on a page, so a plain count is one of pages
    exact = near.where("once").groupBy("site", "key").agg(F.count("*").alias("ids")).where(F.col("ids") >= ids)
    return near.join(exact, ["site", "key"]).select("id", "line_no", "site", "ids")


SPANS = "id string, site string, hash bigint, start int, stop int, once boolean"


def page_chunks(docs: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """SPANS: chunks of current pages with a host, cut by content alone, across line breaks, outside code; places are bytes of the text."""
    pages = current_pages(docs, "url", "content_markdown").select("id", host(F.col("url")).alias("site"), "content_markdown").where("site is not null")

    def make():
        def work(b):
            out = {k: [] for k in ("id", "site", "hash", "start", "stop", "once")}
            for page, site, text in zip(b["id"], b["site"], b["content_markdown"]):
                base, seen = 0, set()
                for code, part in pieces(text or ""):
                    data = part.encode()
                    if not code and data:
                        _, value, length = chunk_hashes([data], window, bits)
                        ends = np.cumsum(length)
                        for h, n, end in zip(value.view(np.int64).tolist(), length.tolist(), ends.tolist()):
                            if _has_words(data[end - n : end].decode("utf-8", "ignore")):
                                for k, v in zip(out, (page, site, h, base + end - n, base + end, h not in seen)):
                                    out[k].append(v)
                                seen.add(h)
                    base += len(data)
            return out

        return work

    return map_rows(pages, make, SPANS)


def repeated_chunks(chunks: DataFrame, ids: int = IDS) -> DataFrame:
    """(id, start, stop): chunks of at least four words on at least ``ids`` pages of their host. ``chunks`` is read twice: give it checkpointed."""
    many = chunks.where("once").groupBy("site", "hash").count().where(F.col("count") >= ids).select("site", "hash")
    return chunks.join(many, ["site", "hash"]).select("id", "start", "stop")


def without(text: str | None, gone: list[int] | None, spans: list[tuple[int, int]] | None) -> str:
    """A text without lines (numbers from 1) and spans (of bytes, not overlapping); what a span leaves of a character is left out."""
    lines = (text or "").split("\n")
    if gone or spans:
        drop, spans, at, out = set(gone or ()), sorted(spans or ()), 0, []
        for number, line in enumerate(lines, 1):
            data = line.encode()
            if number not in drop:
                kept, from_ = [], 0
                for a, b in spans:
                    a, b = max(a - at, 0), min(b - at, len(data))
                    if a < b:
                        kept.append(data[from_:a])
                        from_ = b
                if from_:
                    data = b"".join([*kept, data[from_:]])
                if data.strip() or not from_:
                    out.append(data.decode("utf-8", "ignore"))
            at += len(line.encode()) + 1
            while spans and spans[0][1] <= at:
                spans.pop(0)
        return "\n".join(out)
    return text or ""


def cut_pages(docs: DataFrame, found: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(id, text): current pages without the lines in ``found`` and, if given, the ``chunks`` (id, start, stop) within their other lines."""
    pages = current_pages(docs, "content_markdown").join(found.groupBy("id").agg(F.collect_list("line_no").alias("gone")), "id", "left")
    spans = chunks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")) if chunks is not None else None
    pages = pages.join(spans, "id", "left") if spans is not None else pages.withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))

    def make():
        def work(b):
            return {"id": b["id"], "text": [without(t, g, [(s["start"], s["stop"]) for s in sp or ()]) for t, g, sp in zip(b["content_markdown"], b["gone"], b["spans"])]}

        return work

    return map_rows(pages, make, "id string, text string")
