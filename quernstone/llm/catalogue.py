"""Queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import boilerplate, distinctive, leak, markup, pack, quality, repeats, residue, spam, split
from quernstone.llm.common import read
from quernstone.session import spread, written


@dataclass
class Models:
    """What is learned from one bounded sample of the labelled pages."""

    docs: DataFrame
    rows: list
    tree: boilerplate.TreeModel


def _models(spark: SparkSession, d: str) -> Models:
    docs = read(spark, d, "docs")
    rows = boilerplate.labelled_pages(docs, read(spark, d, "page_labels"))
    return Models(docs, rows, boilerplate.fit(rows))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def p1_spam(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    return spam.spam_pages(m.docs, m.tree, spam.fit(m.tree, m.rows)).select("id", "shapes", F.round("share", 6).alias("share"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_spam(spark, d).select("id")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctive_terms(read(spark, d, "postings"), read(spark, d, "doc_info"))
    return scored.select("doc_id", "term", "n", "documents", F.round("tf", 8).alias("tf"), F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.cases(distinctive.distinctive_terms(read(spark, d, "postings"), read(spark, d, "doc_info"))).select("doc_id", "term")


def p3_residue(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    words = residue.fit(m.tree, m.rows)
    return residue.decide(written(residue.residue_candidates(m.docs, m.tree, words)), words).select("id", "title_hit", F.round("share", 6).alias("share"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_residue(spark, d).select("id")


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    return residue.recurring_messages(m.docs, m.tree, residue.fit(m.tree, m.rows))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "docs")
    return markup.cleaned_pages(docs, markup.train(docs, read(spark, d, "page_labels")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_clean(spark, d).select("id", F.explode("markup").alias("markup"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    return boilerplate.main_bodies(m.docs, m.tree)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    return boilerplate.boilerplate_lines(m.docs, m.tree)


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(written(repeats.chunked_pages(read(spark, d, "docs"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_lines(spark, d).select("id", "line_no")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "docs")
    return repeats.cut_pages(docs, p6_lines(spark, d), repeats.repeated_chunks(written(repeats.page_chunks(docs))))


def p7_quality(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    stats = quality.page_quality(m.docs, m.tree, quality.fit(m.tree, m.rows))
    return stats.select("id", "lines", "words", *[F.round(c, 6).alias(c) for c in quality.STATS[2:]])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    m = _models(spark, d)
    bodies = boilerplate.bodies_of(m.tree, m.rows)
    shapes, words = spam.fit(m.tree, m.rows, bodies), residue.fit(m.tree, m.rows, bodies=bodies)
    rows = written(quality.not_prose_candidates(m.docs, m.tree, quality.fit(m.tree, m.rows, bodies), shapes, words))
    others = residue.decide(rows, words).select("id").unionByName(spam.spam_of(rows, shapes).select("id"))
    return rows.where("bad").select("id").join(others, "id", "left_anti")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack.packed(written(pack.items_of(pack.token_lengths(_documents(spark, d)))))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_documents(spark, d), read(spark, d, "eval_items")).withColumn("similarity", F.round("similarity", 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    # the exact check after the seeds: a run of twelve equal words; one row a document and item
    exact = leak.leaks(_documents(spark, d), read(spark, d, "eval_items")).where(F.col("run") >= leak.RUN)
    return exact.select("doc_id", "item_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(_documents(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pieces(spark, d).where((F.col("piece") == 0) & (F.col("doc_tokens") > split.LIMIT)).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_spam, p2_found, p2_terms, p3_found, p3_residue, p3_messages, p4_found, p4_clean, p5_found, p5_bodies, p6_found, p6_lines, p6_texts, p7_found, p7_quality, p8_pack, p9_found, p9_leaks, p10_found, p10_pieces)}


_P2 = """
WITH live AS (
  SELECT doc_id, arg_max(token_count, row(coalesce(indexed_at, TIMESTAMP '0001-01-01'), coalesce(token_count, -1))) AS token_count
  FROM (SELECT * REPLACE (CAST(indexed_at AS TIMESTAMP) AS indexed_at) FROM doc_info WHERE doc_id IS NOT NULL) GROUP BY doc_id),
occ AS (
  SELECT term, doc_id, count(DISTINCT p) AS n
  FROM (SELECT term, doc_id, unnest(positions) AS p FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL)
  WHERE p IS NOT NULL GROUP BY ALL),
pairs AS (SELECT o.*, l.token_count FROM occ o JOIN live l USING (doc_id)),
terms AS (SELECT term, count(*) AS documents, sum(n) AS in_all FROM pairs GROUP BY term),
whole AS (SELECT sum(n) AS of_all FROM pairs),
size AS (SELECT count(*) AS docs FROM live)
"""

SQL: dict[str, str] = {
    "p2_found": _P2 + """
SELECT doc_id, term FROM pairs JOIN terms USING (term), whole
WHERE token_count > 0 AND n >= 4 AND documents >= 2 AND CAST(n AS HUGEINT) * of_all >= 12 * CAST(token_count AS HUGEINT) * in_all""",
    "p2_terms": _P2 + """
SELECT doc_id, term, n, documents,
  round(CASE WHEN token_count > 0 THEN n / token_count END, 8) AS tf,
  round(ln((docs + 1) / (documents + 1)) + 1, 6) AS idf,
  round(CASE WHEN token_count > 0 THEN n / token_count * (ln((docs + 1) / (documents + 1)) + 1) END, 6) AS score
FROM pairs JOIN terms USING (term), size""",
    "p6_found": r"""
WITH RECURSIVE cur AS (
  SELECT id, nullif(regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', ''), '') AS site, string_split(content_markdown, chr(10)) AS ls
  FROM docs WHERE id IS NOT NULL AND content_markdown IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(CAST(crawled_at AS TIMESTAMP), TIMESTAMP '0001-01-01') DESC) = 1),
lines AS (SELECT id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM cur WHERE site IS NOT NULL),
marks AS (SELECT id, n, regexp_extract(line, '^ *(```|~~~)', 1) AS mark FROM lines WHERE regexp_matches(line, '^ *(```|~~~)')),
fences AS (
  SELECT id, min(n) AS a, arg_min(mark, n) AS mark, (SELECT min(n) FROM marks m2 WHERE m2.id = m1.id AND m2.mark = (SELECT arg_min(m3.mark, m3.n) FROM marks m3 WHERE m3.id = m1.id) AND m2.n > (SELECT min(m4.n) FROM marks m4 WHERE m4.id = m1.id)) AS b
  FROM marks m1 GROUP BY id
  UNION ALL
  SELECT o.id, o.n, o.mark, (SELECT min(c.n) FROM marks c WHERE c.id = o.id AND c.mark = o.mark AND c.n > o.n)
  FROM (SELECT f.id, min(m.n) AS n, arg_min(m.mark, m.n) AS mark FROM fences f JOIN marks m ON m.id = f.id AND m.n > f.b GROUP BY f.id) o),
good AS (
  SELECT l.id, l.site, l.n, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '\d+', '0', 'g') AS own FROM lines l
  WHERE NOT starts_with(line, '#') AND len(regexp_extract_all(line, '\p{L}+')) >= 4
    AND NOT EXISTS (SELECT 1 FROM fences f WHERE f.id = l.id AND l.n >= f.a AND l.n <= coalesce(f.b, 1000000000))),
many AS (SELECT site, own FROM good WHERE NOT starts_with(own, '#') GROUP BY ALL HAVING count(DISTINCT id) >= 5)
SELECT id, CAST(n AS INTEGER) AS line_no FROM good JOIN many USING (site, own)""",
    "p9_found": """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT item_id, regexp_extract_all(lower(nfc_normalize(t)), '[\\p{L}\\p{N}]+') AS w
  FROM (SELECT item_id, unnest([passage, question]) AS t FROM eval_items) WHERE t IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
