"""Structured Streaming: keeping an index up to date, telling new urls, and block state of hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.functions.urls import normalize_url
from quernstone.operators.crawl import BLOCK, BLOCK_MOST
from quernstone.operators.index import SearchIndex
from quernstone.sources.store import swap


class LiveIndex:
    """An index that grows by batches: each batch is a folder of its own, and of a document the rows of its last batch count.

    Taking a batch in costs what the batch costs, not what the index does; ``compact`` folds the batches into one now and then."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, index: SearchIndex, batch: int) -> None:
        """Write a batch. Writing one again replaces it, so that a repeated batch changes nothing. Postings go last but are read
        only through the infos, so a reader between the two sees a document without terms at worst."""
        index.optimize().postings.write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")
        index.doc_info.write.mode("overwrite").parquet(f"{self.path}/doc_info/batch={batch}")

    def load(self) -> SearchIndex:
        """The index as of the last batch. Infos are few against postings: those of the last batches are found first, and
        postings are kept by a semi join on document and batch."""
        info = self.spark.read.parquet(f"{self.path}/doc_info")
        columns = [c for c in info.columns if c not in ("doc_id", "batch")]
        last = info.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by(F.struct(*columns), "batch").alias("i"))
        postings = self.spark.read.parquet(f"{self.path}/postings").join(last.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")
        return SearchIndex(postings.select("term", "doc_id", "positions", "tf"), last.select("doc_id", "i.*"))

    def compact(self) -> None:
        """All batches as one, written beside them and put in their place."""
        newest = self.spark.read.parquet(f"{self.path}/doc_info").agg(F.max("batch")).first()[0]
        LiveIndex(self.spark, self.path + ".new").append(self.load(), newest)
        swap(self.spark, self.path + ".new", self.path)


def upsert_pages(spark: SparkSession, path: str):
    """A foreachBatch function that brings each batch of pages into the live index at ``path``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        LiveIndex(spark, path).append(SearchIndex.build_pages(batch), batch_id)

    return apply


def index_stream(pages: DataFrame, path: str, checkpoint: str, **trigger):
    """Start the stream of pages into the live index at ``path``."""
    return pages.writeStream.foreachBatch(upsert_pages(pages.sparkSession, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def new_urls(discovered: DataFrame, delay: str | None = None, at: str = "ts") -> DataFrame:
    """Each normalised url of a stream once; with ``delay``, once within that time, and older state is dropped."""
    rows = discovered.where("url is not null").withColumn("url", normalize_url(F.col("url")))
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"]) if delay else rows.dropDuplicates(["url"])


def block_states(events: DataFrame, base: int = BLOCK, most: int = BLOCK_MOST, delay: str = "1 hour") -> DataFrame:
    """(domain, ts, backoff) from a stream of block events (domain, ts): state per domain is the last time and backoff.

    An event within the running backoff doubles it, a later one starts anew; state of a domain is dropped once its backoff is over in event time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, backoff = state.get if state.exists else (None, 0)
        out = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            now = ts.timestamp()
            backoff = min(backoff * 2, most) if last is not None and now < last + backoff else base
            last = now
            out.append((key[0], ts, backoff))
        if last is not None:
            state.update((last, backoff))
            state.setTimeoutTimestamp(max(int((last + backoff) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["domain", "ts", "backoff"])

    rows = events.where("domain is not null and ts is not null").select("domain", "ts").withWatermark("ts", delay)
    return rows.groupBy("domain").applyInPandasWithState(step, "domain string, ts timestamp, backoff int", "last double, backoff int", "append", GroupStateTimeout.EventTimeTimeout)
