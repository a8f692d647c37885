"""The data side of crawling: admission, frontier order, politeness, retries, blocks, robots rules, counters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.urls import host, normalize_url, part
from quernstone.session import ship_package

#: Backoffs in seconds: each further block while one lasts doubles the time, up to the most.
BLOCK, BLOCK_MOST = 300, 7200
LIMIT, LIMIT_MOST = 60, 3600


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One row per normalised url: the one of least (priority, depth, parent)."""
    rows = candidates.where("url is not null").withColumn("url", normalize_url(F.col("url")))
    best = F.min(F.struct("priority", "depth", "parent"))
    return rows.groupBy("url").agg(best.alias("b")).select("url", "b.parent", "b.depth", "b.priority")


def admitted(candidates: DataFrame, seen: DataFrame, budget: int = 0, depth: int = 0) -> DataFrame:
    """New urls by priority, depth and url: not seen, within the depth (0: seeds only get in at depth 0), up to the budget (0: no bound)."""
    fresh = deduplicated(candidates.where(F.col("depth") <= depth)).join(seen.select(normalize_url(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    return fresh.orderBy("priority", "depth", "url").limit(budget) if budget else fresh


def frontier(rows: DataFrame, strategy: str = "best-first") -> DataFrame:
    """In the order of visits: lower priority first, then shallower, then by url; ``bfs`` looks at the depth first."""
    order = ("depth", "priority", "url") if strategy == "bfs" else ("priority", "depth", "url")
    return rows.orderBy(*order)


def schedule(rows: DataFrame, delay_ms: int, chunk: int = 100_000) -> DataFrame:
    """(url, host, start_ms): visits of a host at least ``delay_ms`` apart, in url order.

    Places within a host are counted in salted groups and moved by the sizes of those before, so a host of a third of all urls is no hot group."""
    named = rows.select("url", host(F.col("url")).alias("host")).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(max(8, chunk // 10_000))))
    sizes = named.groupBy("host", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("host", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("host", "salt").orderBy("url")) - 1
    return named.withColumn("own", own).join(before, ["host", "salt"]).select("url", "host", ((F.col("own") + F.col("before")) * delay_ms).alias("start_ms"))


def should_retry(status: Column, attempt: Column, most: int = 3) -> Column:
    return (attempt < most) & ((status == 429) | status.between(500, 599) | (status == 0))


def retry_delay(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds: what the server asks for, else a time by status that grows with the attempts."""
    asked = F.regexp_extract(F.coalesce(retry_after, F.lit("")), "^\\s*([0-9]+)", 1)
    step = F.when(status == 429, 30).when(status == 503, 10).otherwise(5)
    return F.when(asked != "", F.try_to_number(asked, F.lit("9999999999")).cast("bigint")).otherwise(((attempt + 1) * step).cast("bigint"))


def block_class(status: Column, server: Column, captcha: Column) -> Column:
    """"rate-limited", "blocked" or null."""
    return F.when(status == 429, "rate-limited").when(status == 403, "blocked").when(status == 503, "rate-limited").when(F.coalesce(captcha, F.lit(False)) | F.contains(F.lower(F.coalesce(server, F.lit(""))), F.lit("cloudflare")), "blocked")


def backoffs(events: DataFrame, base: int = BLOCK, most: int = BLOCK_MOST, unit: str = "day") -> DataFrame:
    """(domain, ts, event_id, backoff) of block events (domain, ts, event_id): the backoff in seconds each one sets.

    An event while the last backoff still runs doubles it up to the most; a later one starts anew. A step depends on the
    one before only through one of few levels, so an event is a map of levels, and maps compose: the units of time of a domain
    are folded side by side, chained through their maps (one row a unit), and only then events get their levels. Events
    stream through sorted partitions and are never gathered, so a hot domain takes a shorter ``unit``, not more memory.
    Equal times are ordered by event_id; rows without domain or time are left out.
    """
    levels = [base]
    while levels[-1] < most:
        levels.append(min(levels[-1] * 2, most))
    count = len(levels)
    micros = [x * 1_000_000 for x in levels]
    rows = events.where("domain is not null and ts is not null").select("domain", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.date_trunc(unit, "ts").alias("part"))
    ends = rows.groupBy("domain", "part").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    gap = F.col("first") - F.lag("last").over(Window.partitionBy("domain").orderBy("part"))
    ends = ends.select("domain", "part", gap.alias("gap"))
    ship_package(events.sparkSession)
    sorted_rows = rows.repartition("domain", "part").sortWithinPartitions("domain", "part", "us", "event_id")

    def fold(batches):
        """Per (domain, part) the level after its last event for each level after its first."""
        key, now, last = None, [], 0
        for batch in batches:
            out = []
            for own, us in zip(zip(batch.column("domain").to_pylist(), batch.column("part").to_pylist()), batch.column("us").to_pylist()):
                if own != key:
                    if key is not None:
                        out.append((key, now))
                    key, now = own, list(range(count))
                else:
                    now = [min(x + 1, count - 1) if us - last < micros[x] else 0 for x in now]
                last = us
            yield _maps(out)
        if key is not None:
            yield _maps([(key, now)])

    def _maps(found):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.string()), pa.array([k[1] for k, _ in found], pa.timestamp("us", "UTC")), pa.array([m for _, m in found], pa.list_(pa.int32()))], names=["domain", "part", "map"])

    maps = sorted_rows.select(F.col("domain").cast("string").alias("domain"), "part", "us").mapInArrow(fold, "domain string, part timestamp, map array<int>")
    # chained per domain over its units: -1 is the level before the first event
    size = F.array(*[F.lit(m) for m in micros])
    chain = maps.join(ends, ["domain", "part"]).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("part", "gap", "map"))).alias("parts"))

    def first_level(level: Column, part: Column) -> Column:
        runs = (level >= 0) & part["gap"].isNotNull() & (part["gap"] < F.element_at(size, F.greatest(level, F.lit(0)) + 1))
        return F.when(runs, F.least(level + 1, F.lit(count - 1))).otherwise(F.lit(0))

    begin = F.struct(F.lit(-1).alias("level"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        "parts",
        begin,
        lambda s, p: F.struct(F.element_at(p["map"], first_level(s["level"], p) + 1).alias("level"), F.concat(s["starts"], F.array(first_level(s["level"], p))).alias("starts")),
    )["starts"]
    starts = chain.select("domain", F.explode(F.arrays_zip(F.col("parts.part").alias("part"), walked.alias("start"))).alias("z")).select("domain", "z.part", "z.start")
    ready = sorted_rows.join(starts, ["domain", "part"]).select("domain", "ts", "event_id", "us", "part", "start").sortWithinPartitions("domain", "part", "us", "event_id")

    def walk(batches):
        key, level, last = None, 0, 0
        for batch in batches:
            out = []
            for own, us, start in zip(zip(batch.column("domain").to_pylist(), batch.column("part").to_pylist()), batch.column("us").to_pylist(), batch.column("start").to_pylist()):
                level = start if own != key else min(level + 1, count - 1) if us - last < micros[level] else 0
                key, last = own, us
                out.append(levels[level])
            yield pa.RecordBatch.from_arrays([batch.column("domain"), batch.column("ts"), batch.column("event_id"), pa.array(out, pa.int32())], names=["domain", "ts", "event_id", "backoff"])

    kinds = dict(ready.dtypes)
    return ready.mapInArrow(walk, f"domain {kinds['domain']}, ts {kinds['ts']}, event_id {kinds['event_id']}, backoff int")


def still_blocked(states: DataFrame, at: Column) -> DataFrame:
    """Domains whose last backoff has not run out at a time."""
    last = states.groupBy("domain").agg(F.max_by(F.struct("ts", "backoff"), F.struct("ts", "event_id")).alias("s")).select("domain", "s.*")
    until = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("backoff").cast("bigint") * 1_000_000)
    return last.withColumn("retry_after", until).where(F.col("retry_after") > at)


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (url) that the rules (host, prefix, allow) allow: the longest prefix of the path decides, an allowing one
    on equal length; no rule allows. The join is on host; rules are few per host."""
    rows = urls.select("url", host(F.col("url")).alias("host"), F.concat(F.when(part(F.col("url"), 3) == "", F.lit("/")).otherwise(part(F.col("url"), 3)), part(F.col("url"), 4)).alias("path")).distinct()
    own = rules.where("host is not null and prefix is not null and prefix <> ''").groupBy("host").agg(F.collect_list(F.struct(F.length("prefix").alias("n"), "allow", "prefix")).alias("rules"))
    hit = F.array_max(F.filter(F.coalesce("rules", F.array().cast("array<struct<n:int,allow:boolean,prefix:string>>")), lambda r: F.startswith(F.col("path"), r["prefix"])))
    return rows.join(own, "host", "left").where(F.coalesce(hit["allow"], F.lit(True))).select("url")


def counters(log: DataFrame) -> DataFrame:
    """(host, crawled, failed) from a fetch log (url, status)."""
    good = F.col("status").between(200, 399)
    return log.groupBy(host(F.col("url")).alias("host")).agg(F.count_if(good).alias("crawled"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))
