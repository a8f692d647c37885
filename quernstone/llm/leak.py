"""Problem 9: passages of evaluation items inside documents, by spaced seeds.

A seed looks at a window of words through a fixed mask that ignores some positions, so a window still
meets its copy when an ignored word was replaced. Seeds of all windows of the items' passages and
questions are joined with those of every window of every document; what no item can have is put out
before the shuffle by a bit filter of fixed size. Around a hit the two texts are laid side by side and
compared word by word, which gives the longest run of equal words and the share of equal words of the
best stretch.

Words are runs of letters and digits after NFC and lower-casing, compared by 64-bit hashes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import arrow_type, map_rows, schema
from quernstone.session import ship_package, written

#: Masks over 12 words (1: looked at). All ones at the ends only where needed: every mask fits into 12 words.
MASKS = ("110110110011", "111010010111", "101101101101")
SPAN = 12
#: Parameters: words in a row that make a case; stretch and share of a tolerant overlap; bits of the filter of seeds (4 MB).
RUN, STRETCH, SIMILAR, FILTER_BITS = 12, 24, 0.8, 25
#: Parameter: words of all items up to which they are sent to all tasks (8 bytes each); beyond, they are joined by a shuffle.
SENT_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        own = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return own


def seeds_of(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of SPAN words through a mask."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    codes = codes.view(np.uint64)
    value = np.full(n, MASKS.index(mask) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                value *= np.uint64(0x9E3779B97F4A7C15)
                value ^= codes[i : i + n]
                value ^= value >> np.uint64(29)
        value *= np.uint64(0x94D049BB133111EB)
    return (value ^ (value >> np.uint64(31))).view(np.int64)


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, field, words, seeds): the passage and the question of each item, as hashes of words and of windows. Nulls and texts of fewer than SPAN words give no row."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("passage", "question")])
    rows = items.where("item_id is not null").select("item_id", F.explode(fields).alias("x")).select("item_id", "x.*").where("text is not null").distinct()

    def make():
        codes = WordHashes()

        def work(b):
            out = {"item_id": [], "field": [], "words": [], "seeds": []}
            for item, field, text in zip(b["item_id"], b["field"], b["text"]):
                own = np.array([codes[w] for w in words_of(text)], np.int64)
                if len(own) >= SPAN:
                    out["item_id"].append(item)
                    out["field"].append(field)
                    out["words"].append(own.tolist())
                    out["seeds"].append([{"seed": s, "at": k} for mask in MASKS for k, s in enumerate(seeds_of(own, mask).tolist())])
            return out

        return work

    return map_rows(rows, make, "item_id bigint, field string, words array<bigint>, seeds array<struct<seed:bigint,at:int>>")


def seed_filter(rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each seed of the items in 2^bits: what reaches the driver and the tasks is at most 2^bits / 8 bytes however many items there are."""
    slots = rows.select(F.explode("seeds.seed").alias("s")).select(F.expr(f"pmod(s, {1 << bits})").alias("b"))
    words = slots.groupBy(F.floor(F.col("b") / 32).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(b, 32) as int)))").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["slot"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    return out


def hit_documents(documents: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(doc_id, words, hits) of the documents with windows that pass the filter. One pass over the corpus, nothing is shuffled."""
    bits = np.uint64(len(filter_) * 32 - 1)

    def make():
        codes = WordHashes()

        def work(b):
            out = {"doc_id": [], "words": [], "hits": []}
            texts = [words_of(t) for t in b["text"]]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = np.array([codes[w] for t in texts for w in t], np.int64)
            ends = np.cumsum(sizes)
            found: dict[int, list] = {}
            for mask in MASKS:
                seeds = seeds_of(flat, mask)
                slot = seeds.view(np.uint64) & bits
                at = np.flatnonzero((filter_[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + SPAN <= ends[doc]  # a window within one document
                for k, d, s in zip(at[inside].tolist(), doc[inside].tolist(), seeds[at[inside]].tolist()):
                    found.setdefault(d, []).append({"seed": s, "at": k - int(ends[d] - sizes[d])})
            for d in sorted(found):
                out["doc_id"].append(b["doc_id"][d])
                out["words"].append(flat[ends[d] - sizes[d] : ends[d]])
                out["hits"].append(found[d])
            return out

        return work

    return map_rows(documents.select("doc_id", "text").where("doc_id is not null and text is not null"), make, "doc_id bigint, words array<bigint>, hits array<struct<seed:bigint,at:int>>")


def overlaps(doc: np.ndarray, item: np.ndarray, offsets: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid side by side, one pair after the other (from ``offsets[k]`` to ``offsets[k + 1]``): the longest run of equal words,
    where it begins, and the share of equal words of the best stretch. Pairs have a word at least."""
    equal = doc == item
    first, size = offsets[:-1], np.diff(offsets)
    at, pair = np.arange(len(doc)), np.repeat(np.arange(len(size)), size)
    since = np.maximum.accumulate(np.where(equal, np.where(at == first[pair], at - 1, -1), at))
    run = np.where(equal, at - np.maximum(since, first[pair] - 1), 0)
    longest = np.maximum.reduceat(run, first)
    # the first place where the longest run ends
    end = np.minimum.reduceat(np.where(run == longest[pair], at, len(doc)), first)
    total = np.r_[0, np.cumsum(equal)]
    width = np.minimum(stretch, size)[pair]
    near = np.where(at - first[pair] >= width - 1, (total[at + 1] - total[np.maximum(at + 1 - width, 0)]) / width, 0.0)
    return longest, end - longest + 1 - first, np.maximum.reduceat(near, first)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, field, run, doc_word, item_word, similarity): of each document with each passage or question that a seed of it
    met, the longest run and the highest similarity of any alignment, if the one has RUN words or the other is SIMILAR.

    Texts or items of fewer than SPAN words give no row; nulls neither. Repeated rows of a document give repeated rows. The corpus is read once,
    however many items there are: windows whose seed no item has are put out by a filter of fixed size, the others are joined on the seed.
    """
    rows = written(item_rows(items))
    hits = written(hit_documents(documents, seed_filter(rows)).withColumn("key", F.monotonically_increasing_id()))
    seeds = rows.select("item_id", "field", F.explode("seeds").alias("s")).select("item_id", "field", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    near = hits.select("key", F.explode("hits").alias("h")).select("key", F.col("h.seed").alias("seed"), F.col("h.at").alias("at"))
    sides = near.join(seeds.hint("merge"), "seed").select("key", "item_id", "field", (F.col("at") - F.col("item_at")).alias("side")).distinct()
    # the items are sent to all tasks only if their words are few; documents never are
    few = (rows.agg(F.sum(F.size("words"))).first()[0] or 0) <= SENT_WORDS
    own = rows.select("item_id", "field", F.col("words").alias("item"))
    laid = sides.hint("merge").join(hits.select("key", "doc_id", F.col("words").alias("doc")), "key").join(F.broadcast(own) if few else own.hint("merge"), ["item_id", "field"])
    first = F.greatest("side", F.lit(0))
    size = F.least(F.col("side") + F.size("item"), F.size("doc")) - first
    pairs = laid.select("key", "doc_id", "item_id", "field", first.alias("doc_at"), (first - F.col("side")).alias("item_at"), F.slice("doc", first + 1, size).alias("doc"), F.slice("item", first - F.col("side") + 1, size).alias("item"))

    ship_package(documents.sparkSession)
    kinds = schema("key bigint, doc_id bigint, item_id bigint, field string, run int, doc_word int, item_word int, similarity double")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, item = b.column("doc"), b.column("item")
                offsets = doc.offsets.to_numpy()
                run, place, near = overlaps(doc.flatten().to_numpy(), item.flatten().to_numpy(), offsets - offsets[0])
                out = {k: b.column(k) for k in ("key", "doc_id", "item_id", "field")}
                out |= {"run": run, "doc_word": b.column("doc_at").to_numpy() + place, "item_word": b.column("item_at").to_numpy() + place, "similarity": near}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(arrow_type(f.dataType)) for f in kinds.fields], names=kinds.names)

    checked = pairs.where(F.size("doc") > 0).mapInArrow(check, kinds)
    best = checked.groupBy("key", "doc_id", "item_id", "field").agg(F.max(F.struct("run", "doc_word", "item_word")).alias("b"), F.max("similarity").alias("similarity"))
    return best.select("doc_id", "item_id", "field", "b.run", "b.doc_word", "b.item_word", "similarity").where((F.col("run") >= RUN) | (F.col("similarity") >= SIMILAR))
