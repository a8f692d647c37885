"""Problem 8: documents into containers of a fixed number of tokens, with little space left over.

1. Lengths in tokens are counted; a text over the capacity is cut into full parts and a rest.
2. The global histogram of lengths (at most one row per length up to the capacity) goes to the driver, where
   dynamic programming chooses the length buckets with the least padding.
3. Token-budget batches form inside each bucket: as many items as fit by the bucket's upper bound.
   The room such batches leave is given to buckets of shorter items, longest first.
4. Items are ranked within (bucket, salt) groups, so a bucket with a third of all items is no hot group,
   and the plan turns bucket and rank into a container.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import map_rows
from quernstone.llm.tokens import encoding

CAPACITY, BUCKETS = 2048, 192


def token_lengths(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens). A null text has no tokens; rows without doc_id are left out."""

    def make():
        enc = encoding(vocabulary)

        def work(b):
            return {"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]}

        return work

    return map_rows(documents.select("doc_id", "text").where("doc_id is not null"), make, "doc_id bigint, n_tokens int")


def items_of(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens): whole texts as part 0; longer ones in parts of the capacity and a rest. An empty text is an item of 0."""
    parts = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    rows = lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rows.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"))


def choose_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over the lengths seen that minimise the padding summed over items.

    Dynamic programming: best[k][j], the least padding of lengths up to the j-th in k buckets."""
    sizes = np.array(sorted(histogram), np.int64)
    n = len(sizes)
    if n <= buckets:
        return sizes.tolist()
    count = np.array([histogram[int(s)] for s in sizes], np.float64)
    items, tokens = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * sizes)]
    # cost[i, j]: lengths i..j-1 padded to the (j-1)-th
    cost = sizes[None, :] * (items[None, 1:] - items[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.inf)
    best = cost[0].copy()
    back = [np.zeros(n, np.int64)]
    for _ in range(buckets - 1):
        reach = np.r_[np.inf, best[:-1]][:, None] + cost
        start = reach.argmin(0)
        nxt = reach[start, np.arange(n)]
        better = nxt < best
        back.append(np.where(better, start, -1))
        best = np.minimum(best, nxt)
    bounds, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        start = int(back[k][j])
        if start < 0:
            continue
        bounds.append(int(sizes[j]))
        if start == 0:
            break
        j = start - 1
    return bounds[::-1]


@dataclass
class Plan:
    """Runs of ranks of a bucket that go to consecutive containers, so many to each. Sorted by bucket and first rank."""

    bounds: np.ndarray
    bucket: np.ndarray
    rank: np.ndarray
    container: np.ndarray
    each: np.ndarray
    containers: int

    def place(self, bucket: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bucket * (1 << 48) + self.rank, bucket * (1 << 48) + rank, side="right") - 1
        return self.container[at] + (rank - self.rank[at]) // self.each[at]


def make_plan(bounds: list[int], counts: list[int], capacity: int = CAPACITY) -> Plan:
    """Batches inside each bucket from the longest down; what they leave is filled with shorter items. Bounded by the square of the buckets, not by items."""
    left = list(counts)
    used = [0] * len(bounds)
    runs, containers = [], 0
    for k in range(len(bounds) - 1, -1, -1):
        if not left[k]:
            continue
        own = max(capacity // max(bounds[k], 1), 1)
        full, rest = divmod(left[k], own)
        groups = [(containers, full, own)] if full else []
        if rest:
            groups.append((containers + full, 1, rest))
        room: list[tuple[int, int, int, int]] = []
        for first, number, each in groups:
            runs.append((k, used[k], first, each))
            used[k] += number * each
            containers += number
            room.append((first, number, capacity - each * bounds[k], k - 1))
        left[k] = 0
        while room:
            first, number, space, j = room.pop()
            while j >= 0 and (not left[j] or bounds[j] > space):
                j -= 1
            if j < 0:
                continue
            each = min(space // bounds[j] if bounds[j] else left[j], left[j])
            filled = min(number, left[j] // each)
            runs.append((j, used[j], first, each))
            used[j] += filled * each
            left[j] -= filled * each
            room.append((first, filled, space - each * bounds[j], j - 1))
            if filled < number:
                # the bucket ran short: the other containers take what is left of it, then shorter ones
                room.append((first + filled, number - filled, space, j))
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return Plan(np.array(bounds, np.int64), table[:, 0], table[:, 1], table[:, 2], table[:, 3], containers)


def packed(items: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, per_salt: int = 500_000) -> DataFrame:
    """(doc_id, part, n_tokens, container). ``items`` is read twice: give it checkpointed. No items, no rows."""
    sizes = items.groupBy("n_tokens").count().collect()  # at most capacity + 1 rows
    histogram = {r["n_tokens"]: r["count"] for r in sizes}
    if not histogram:
        return items.withColumn("container", F.lit(0).cast("bigint"))
    bounds = choose_bounds(histogram, buckets)
    of = np.searchsorted(bounds, sorted(histogram))
    counts = np.bincount(of, [histogram[s] for s in sorted(histogram)], len(bounds)).astype(int).tolist()
    plan = make_plan(bounds, counts, capacity)
    salts = max(8, sum(counts) // per_salt)
    # bucket of a length: a table of capacity + 1 entries
    table = F.array(*[F.lit(int(b)) for b in np.searchsorted(bounds, np.arange(capacity + 1)).tolist()])
    salted = items.select("doc_id", "part", "n_tokens", F.element_at(table, F.col("n_tokens") + 1).alias("bucket"), F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).alias("salt"))
    sums = salted.groupBy("bucket", "salt").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("bucket", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("inside", inside).join(offsets, ["bucket", "salt"]).select("doc_id", "part", "n_tokens", "bucket", (F.col("inside") + F.col("offset")).alias("rank"))

    def make():
        def work(b):
            own = plan.place(np.array(b["bucket"], np.int64), np.array(b["rank"], np.int64))
            return {"doc_id": b["doc_id"], "part": b["part"], "n_tokens": b["n_tokens"], "container": own.tolist()}

        return work

    return map_rows(ranked, make, "doc_id bigint, part int, n_tokens int, container bigint")
