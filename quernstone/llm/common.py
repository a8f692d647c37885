"""Shared pieces of the training-data operators: current pages, hosts, columns, workers' loops."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import ship_package

EPOCH = "0001-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(url: Column) -> Column:
    """Host of a url: lower-cased, without user part, port and a leading ``www.``; null or no scheme gives null."""
    whole = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(whole, r"^www\.", ""), F.lit(""))


def current_pages(docs: DataFrame, *columns: str) -> DataFrame:
    """Of the rows of one ``id`` the one crawled last; a null ``crawled_at`` counts as earliest.

    Rows that tie are equal by the data's contract; if they are not, any one of them is taken.
    Rows without id are left out. One shuffle on id; at most one row per id and map task is
    kept before it (window group limit).
    """
    # only what is asked for goes through the shuffle
    seen = docs.select("id", *columns, F.coalesce("crawled_at", F.lit(EPOCH).cast("timestamp")).alias("_at"))
    seen = seen.where(F.col("id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))
    return seen.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_at")


def page_texts(docs: DataFrame, *more: str) -> DataFrame:
    """(id, site, title, content_markdown, ...) of current pages: what the operators on main bodies read."""
    return current_pages(docs, "url", "title", "content_markdown", *more).select("id", host(F.col("url")).alias("site"), "title", "content_markdown", *more)


def site_name(site: str | None) -> str:
    """The label before the last one of a host, by which a site calls itself."""
    parts = (site or "").split(".")
    return parts[-2] if len(parts) > 1 else ""


_LETTERS, _ASCII_LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]+")


def runs_of_letters(text: str) -> list[str]:
    """Words of a text. In ASCII the same runs are those of a plain class, which is found faster."""
    return (_ASCII_LETTERS if text.isascii() else _LETTERS).findall(text)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], ddl: str) -> DataFrame:
    """Run ``make()`` once per task and its result on each Arrow batch, as columns of Python lists in and out."""
    ship_package(df.sparkSession)
    out = schema(ddl)
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are lists and tuples without cycles, and tables of things met grow large: looking through them often is of no use
        gc.set_threshold(200_000, 50, 100)
        work = make()
        for batch in batches:
            if batch.num_rows:
                found = work(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns))))
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    simple = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}
    return simple[type(kind)]


# Beginnings of the words of the usual filler text, and its short words.
FILLER_STEMS = frozenset("lore loru ipsu ipsa dolo amet siam cons adip veli sedo eius temp inci uten labo magn aliq enim mini veni nost exer ulla nisi comm duis irur repr volu cill fugi null pari exce occa cupi proi culp offi dese moll anim".split())
FILLER_SHORT = frozenset("sit sed elit ut quis aute esse non est et in ad ea ex eu".split())


_STEM = itemgetter(slice(4))


def filler_words(words: list[str]) -> int:
    """How many of the words are of the usual filler text; short ones only count beside a stem."""
    if FILLER_STEMS.isdisjoint(map(_STEM, words)):
        return 0
    return sum(w[:4] in FILLER_STEMS for w in words) + sum(w in FILLER_SHORT for w in words)


# Common words of English, German, French and Spanish.
COMMON = frozenset(
    """the of and to in is that it for was on are as with be by at this have from or had not but what all were when we there can an your which their if do will how about up out them then so some her would make like him into has two more no way could my than been who its now did get may part over
    der die das und ist nicht ein eine den dem des zu mit von für auf im sich es auch als an nach wie bei oder aus wenn nur so war wird sind noch hat man wir sie er aber dass zum zur am denn weil später dabei uns
    le la les de des et est un une du en que qui dans pour pas au sur se ce il ne plus par avec son sont à aux ou mais nous vous on si était être cette fait leur sera tout très
    el los las del y es por con para una su al lo como más pero sus no se ha o este sí porque esta entre cuando muy sin sobre también me hasta hay donde era tan desde nos todo está fue hemos puede""".split()
)
