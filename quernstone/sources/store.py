"""Stores: pages as compressed files by id, and bodies of web responses."""

from __future__ import annotations

import gzip
import os
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.urls import url_hash
from quernstone.operators.index import latest
from quernstone.session import ship_package

PAGE = "id string, url string, title string, content_markdown string, links array<string>, crawled_at timestamp, depth int"
SCHEMA_VERSION = "1-parquet"


class StoreError(RuntimeError):
    """Trouble with a store, with what to do about it."""

    def __init__(self, message: str, suggestion: str = "") -> None:
        super().__init__(f"{message}. {suggestion}".strip(". ") if suggestion else message)
        self.suggestion = suggestion


class PageStore:
    """Pages in a folder of Parquet or gzipped JSON files, spread over folders by the first two digits of the id."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet") -> None:
        self.spark, self.path, self.kind = spark, path, kind

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(PAGE + ", prefix string").format(self.kind).load(self.path).drop("prefix")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], PAGE)
            raise

    def _write(self, pages: DataFrame, path: str, mode: str) -> None:
        rows = pages.withColumn("prefix", F.substring("id", 1, 2))
        # as many tasks as the session shuffles into, however few prefixes there are
        salts = max(1, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 256))
        writer = rows.repartition("prefix", F.pmod(F.xxhash64("id"), F.lit(salts))).write.mode(mode).partitionBy("prefix")
        (writer.option("compression", "gzip") if self.kind == "json" else writer).format(self.kind).save(path)

    def save(self, pages: DataFrame) -> None:
        """Adds pages; ids from urls where missing. Of several rows of an id the latest is what ``get`` and ``pages`` show."""
        self._write(pages.withColumn("id", F.coalesce("id", url_hash(F.col("url")))).select(*[c.split()[0] for c in PAGE.split(", ")]), self.path, "append")

    def pages(self) -> DataFrame:
        return latest(self.read())

    def get(self, page_id: str) -> DataFrame:
        return latest(self.read().where(F.col("id") == page_id))

    def get_by_url(self, url: str) -> DataFrame:
        return latest(self.read().where(F.col("id") == url_hash(F.lit(url))))

    def existing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.read().select("id").distinct(), "id", "left_semi")

    def count(self) -> int:
        return self.read().select("id").distinct().count()

    def delete(self, ids: DataFrame) -> None:
        """Rewrites the store without the ids, beside the old one, which is swapped at the end."""
        kept = self.read().join(ids.select("id").distinct(), "id", "left_anti")
        self._write(kept, self.path + ".new", "overwrite")
        swap(self.spark, self.path + ".new", self.path)

    def backup(self, path: str) -> None:
        self._write(self.read(), path, "overwrite")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def swap(spark: SparkSession, new: str, old: str) -> None:
    """Put ``new`` in the place of ``old``, which is kept aside until then: whenever this ends, one of the two is whole."""
    (a, fs), (b, _), (aside, _) = hadoop_path(spark, new), hadoop_path(spark, old), hadoop_path(spark, old + ".old")
    if fs.exists(aside):  # left by a swap that did not end
        fs.delete(aside, True) if fs.exists(b) else fs.rename(aside, b)
    moved = fs.exists(b) and fs.rename(b, aside)
    if not fs.rename(a, b):
        if moved:
            fs.rename(aside, b)
        raise StoreError(f"{new} could not be moved to {old}", "Check the permissions of the folder")
    fs.delete(aside, True)


def copy(spark: SparkSession, path: str, to: str) -> None:
    """Copy of a folder of tables, for backup and restore."""
    (a, fs), (b, other) = hadoop_path(spark, path), hadoop_path(spark, to)
    if not fs.exists(a):
        raise StoreError(f"{path} is missing", "Build the index first")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, False, True, spark._jsc.hadoopConfiguration())


def restore(spark: SparkSession, backup: str, path: str, keep_current: bool = True) -> None:
    """Put a backup in place; the current index is first copied beside it."""
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        if keep_current:
            copy(spark, path, path + ".before-restore")
        fs.delete(target, True)
    copy(spark, backup, path)


def write_schema_version(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> None:
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema_version")


def check_schema_version(spark: SparkSession, path: str, version: str = SCHEMA_VERSION) -> None:
    """StoreError unless the folder's marker says this version."""
    try:
        found = [r.value for r in spark.read.text(f"{path}/schema_version").collect()]  # one line
    except Exception:
        found = []
    if found != [version]:
        raise StoreError(f"schema version {found[0] if found else 'missing'}, wanted {version}", "Crawl again to rebuild the data")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows)."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def read_markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the Markdown files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def decode_body(body: bytes | None, encodings: str | None) -> bytes | None:
    """A response body with its content encodings undone, last first; unknown ones are passed over."""
    if body is None:
        return None
    for name in reversed([e.strip().lower() for e in (encodings or "").split(",")]):
        if name in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif name == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -zlib.MAX_WBITS)
    return body


def decode_body_column(body: Column, encodings: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("binary")
    def decode(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decode_body(b, e) for b, e in zip(bodies, names)])

    return decode(body, encodings)


def data_dir(flag: str | None = None, default: str = "./data") -> str:
    """Folder of the data: argument, else environment, else default."""
    return flag or os.environ.get("QUERNSTONE_DATA_DIR") or default
