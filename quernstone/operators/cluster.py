"""Clusters of documents with key terms, key points, topics and extractive summaries."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import STOPWORDS, clean_markdown, long_enough, title_from_content
from quernstone.session import ship_package, written

# Words of the web that say nothing of a text.
WEB_WORDS = "http https www com org docs page content using can will use also may like get one two see set run file new open".split()
# Words that mark an important sentence.
INDICATORS = "must should need required important note config install setup create enable default option example command".split()
# Parts of key terms and the topics they stand for, in order.
TOPICS = {
    "install": "Installation", "setup": "Setup & Configuration", "config": "Configuration", "api": "API Reference", "guide": "Guide", "cli": "CLI Reference", "command": "CLI Reference", "security": "Security",
    "auth": "Authentication", "database": "Database", "deploy": "Deployment", "docker": "Docker", "channel": "Channels", "webhook": "Webhooks", "plugin": "Plugins", "agent": "Agent", "tool": "Tools",
    "session": "Session", "gateway": "Gateway", "memory": "Memory", "browser": "Browser", "message": "Messaging",
}


def clusters(docs: DataFrame, k: int = 100, features: int = 5000, seed: int = 42, max_iter: int = 300, min_df: float = 2, max_df: float = 0.9) -> DataFrame:
    """(doc_id, cluster) by K-Means over TF-IDF of words and pairs of words. Texts without a feature get the zero vector."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[A-Za-z0-9_]{2,}", gaps=False),
        StopWordsRemover(inputCol="words", outputCol="kept", stopWords=list(STOPWORDS)),
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT doc_id, concat(kept, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=features, minDF=min_df, maxDF=max_df),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
        KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster"),
    ]
    return Pipeline(stages=stages).fit(rows).transform(rows).select("doc_id", "cluster")


def prepared(files: DataFrame) -> DataFrame:
    """(doc_id, title, text) of Markdown files (file, text) fit for clustering: cleaned, and long enough after that."""
    clean = files.select("file", clean_markdown(F.col("text")).alias("text")).where(long_enough(F.col("text")))
    return clean.select(F.col("file").alias("doc_id"), title_from_content(F.col("text"), F.col("file")).alias("title"), "text")


def key_terms(docs: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, term, count, place): most frequent words of three letters or more besides stop and web words; ties by word."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col("text")), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin([*STOPWORDS, *WEB_WORDS]))
    counts = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("count"))
    # the first n of a key are taken per map task already (window group limit)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "term"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def sentences(text: Column) -> Column:
    """Sentences: text after white space squeezed, cut behind . ! or ? and a space."""
    plain = F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
    return F.filter(F.split(F.regexp_replace(plain, "([.!?]) ", "$1\n"), "\n"), lambda s: s != "")


def key_points(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, sentence, score, place): best of the first 50 sentences of 30 to 250 characters, by place, length, marking words and not asking."""
    rows = docs.select("doc_id", F.posexplode(F.slice(sentences(F.col("text")), 1, 50)).alias("i", "sentence"))
    size, low = F.length("sentence"), F.lower("sentence")
    marks = sum((F.contains(low, F.lit(w)).cast("int") * 2 for w in INDICATORS), F.lit(0))
    score = F.greatest(F.lit(0), 10 - F.col("i")) + F.when((size > 50) & (size < 180), 5).otherwise(0) + marks + F.when(F.endswith("sentence", F.lit("?")), 0).otherwise(2)
    rows = rows.where(size.between(30, 250)).withColumn("score", score)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "i"))).where(F.col("place") <= n).select("doc_id", "sentence", "score", "place")


def topic(terms: Column) -> Column:
    """Topic of key terms, best first: that of the first of five with a known part; else the first term in title case; else Documentation."""
    known = F.lit(None).cast("string")
    for i in range(4, -1, -1):
        term = F.get(terms, F.lit(i))
        case = F.lit(None).cast("string")
        for piece, name in reversed(TOPICS.items()):
            case = F.when(F.contains(term, F.lit(piece)), F.lit(name)).otherwise(case)
        known = F.coalesce(case, known)
    return F.coalesce(known, F.initcap(F.get(terms, F.lit(0))), F.lit("Documentation"))


_WORD = re.compile(r"[^\W\d_]+")


def lexrank_order(parts: list[str], damping: float = 0.85, rounds: int = 50) -> np.ndarray:
    """Scores of sentences by their centrality in the graph of TF-IDF cosines.

    The matrix of all pairs is never formed: its product with a vector goes through the terms, so the work is linear in the text."""
    bags = [Counter(w.lower() for w in _WORD.findall(p)) for p in parts]
    df = Counter(w for b in bags for w in b)
    code = {w: i for i, w in enumerate(df)}
    row, col, val = [], [], []
    for i, bag in enumerate(bags):
        own = [(code[w], n * np.log(1 + len(parts) / df[w])) for w, n in bag.items()]
        norm = np.sqrt(sum(v * v for _, v in own)) or 1.0
        row += [i] * len(own)
        col += [c for c, _ in own]
        val += [v / norm for _, v in own]
    row, col, val = np.array(row, int), np.array(col, int), np.array(val)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, val * np.bincount(col, val * x[row], len(df))[col], len(parts)) if len(row) else np.zeros(len(parts))

    degree = np.maximum(times(np.ones(len(parts))), 1e-12)
    score = np.full(len(parts), 1 / max(len(parts), 1))
    for _ in range(rounds):
        new = (1 - damping) / len(parts) + damping * times(score / degree)
        if np.abs(new - score).max() < 1e-9:
            return new
        score = new
    return score


def summaries(docs: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, summary): the n most central sentences in their order; of equal ones the first. Empty texts give empty ones."""
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("parts"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                if len(parts) > n:
                    score = lexrank_order(parts)
                    parts = [parts[i] for i in sorted(np.lexsort((np.arange(len(parts)), -score))[:n])]
                out.append(" ".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "summary"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, summary string")


#: Parameters: characters of a cluster's text that one row holds for the products of ``central_sentences``; change of a score, of mean 1, that ends its rounds.
BLOCK_CHARS, CHANGE = 8_000_000, 1e-6


def _pack(block):
    """The documents of a block as one row: a sparse matrix of sentences by terms with counts, and its terms with the number of sentences that hold them."""
    import pyarrow as pa

    block = block.sort_by("doc_id")
    parts = block.column("parts").to_pylist()
    code: dict[str, int] = {}
    flat: list[int] = []
    size = []
    for sentence in (s for p in parts for s in p):
        words = _WORD.findall(sentence.lower()) if sentence.isascii() else [w.lower() for w in _WORD.findall(sentence)]
        flat += [code.setdefault(w, len(code)) for w in words]
        size.append(len(words))
    width = max(len(code), 1)
    entry, count = np.unique(np.repeat(np.arange(len(size)), size) * width + np.array(flat, np.int64), return_counts=True)
    row, term = entry // width, entry % width
    binary = lambda x: pa.compress(x.astype(np.int32).tobytes(), "zstd", asbytes=True)
    docs = block.column("doc_id")
    columns = {"cluster": block.column("cluster")[:1], "block": block.column("block")[:1], "sentences": [len(size)], "docs": pa.array([docs.to_pylist()], pa.list_(docs.type)), "parts": pa.array([[len(p) for p in parts]], pa.list_(pa.int32()))}
    columns |= {"entries": [len(entry)], "row": [binary(np.bincount(row, minlength=len(size)))], "term": [binary(term)], "count": [binary(count)], "terms": pa.array([list(code)], pa.list_(pa.string())), "df": pa.array([np.bincount(term, minlength=len(code))[: len(code)]], pa.list_(pa.int64()))}
    return pa.table(columns)


def _blocks(batches):
    """Rows of matrices, as dictionaries, with the two products: ``down`` (terms from sentences) and ``across`` (sentences from terms)."""
    import pyarrow as pa

    for b in batches:
        for k in range(b.num_rows):
            r = {name: c[k] for name, c in zip(b.schema.names, b.columns)}
            n, entries = r["sentences"].as_py(), r["entries"].as_py()
            each, term, count = (np.frombuffer(pa.decompress(r[x].as_py(), 4 * m, "zstd", asbytes=True), np.int32) if m else np.zeros(0, np.int32) for x, m in (("row", n), ("term", entries), ("count", entries)))
            row, idf = np.repeat(np.arange(n), each), np.array(r["idf"].values if r["idf"].is_valid else [], float)
            val = count * idf[term] if len(term) else np.zeros(0)
            norm = np.sqrt(np.bincount(row, val * val, n))
            val = val / np.where(norm > 0, norm, 1)[row]
            across = lambda y, row=row, term=term, val=val, n=n: np.bincount(row, val * y[term], n) if len(row) else np.zeros(n)
            down = lambda x, row=row, term=term, val=val, w=len(idf): np.bincount(term, val * x[row], w) if len(row) else np.zeros(w)
            yield r, n, across, down


def central_sentences(rows: DataFrame, n: int = 8, damping: float = 0.85, rounds: int = 50, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(cluster, doc_id, i, score): of all sentences of all documents (cluster, doc_id, text) of a cluster the n most central ones, as by
    ``lexrank_order``, with scores of mean 1; of equal ones the first. The end of a document ends a sentence.

    Sentences lie in blocks of bounded size, matrices in one row each. A round is a product in each block down to its terms, a sum by term
    over the blocks, and a product across to the sentences again; what moves are the blocks' terms."""
    ship_package(rows.sparkSession)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("cluster", "doc_id")}
    shuffles, at = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["cluster", "block"]
    texts = rows.select("cluster", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    many = texts.groupBy("cluster").agg((F.floor(F.sum(F.length("text")) / block_chars) + 1).alias("blocks"))  # a row per cluster
    parts = texts.join(F.broadcast(many), "cluster").select("cluster", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "doc_id", sentences(F.col("text")).alias("parts"))
    ddl = f"cluster {kind['cluster']}, block long, sentences long, entries long, docs array<{kind['doc_id']}>, parts array<int>, row binary, term binary, count binary, terms array<string>, df array<long>"
    packed = written(parts.groupBy(*at).applyInArrow(_pack, ddl))
    words = packed.select(*at, F.posexplode(F.arrays_zip("terms", "df")).alias("pos", "x")).select(*at, "pos", "x.terms", "x.df")
    total = packed.groupBy("cluster").agg(F.sum("sentences").alias("total"))
    known = words.groupBy("cluster", "terms").agg(F.sum("df").alias("df")).join(F.broadcast(total), "cluster")
    known = written(known.select("cluster", "terms", F.monotonically_increasing_id().alias("id"), F.log(1 + F.col("total") / F.col("df")).alias("idf")))
    need = written(words.join(known, ["cluster", "terms"]).select(*at, "pos", "id", "idf").repartition(shuffles, "id"))

    def gathered(table: DataFrame, *names: str) -> DataFrame:
        """The values of each block's terms as arrays, in the order of its terms."""
        found = table.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("x"))
        return found.select(*at, *(F.col(f"x.{c}").alias(c) for c in names))

    matrix = [*at, "sentences", "entries", "docs", "parts", "row", "term", "count"]
    blocks = written(packed.select(*matrix).join(gathered(need, "id", "idf"), at, "left").repartition(shuffles, *at))

    def apply(run, ddl: str, need: DataFrame | None = None, names: tuple[str, ...] = ()) -> DataFrame:
        return (blocks.join(gathered(need, *names), at, "left") if names else blocks).mapInArrow(run, ddl)

    def array(x) -> np.ndarray:
        return np.array(x.values if x.is_valid else [], float)

    def partial(r, change, **values):
        import pyarrow as pa

        ids = pa.array(r["id"].values if r["id"].is_valid else [], pa.int64())
        return pa.RecordBatch.from_pydict({"id": ids, "change": pa.array(np.full(len(ids), change), pa.float64()), **{k: pa.array(v, pa.float64()) for k, v in values.items()}})

    def ones(batches):
        for r, size, _, down in _blocks(batches):
            yield partial(r, 0.0, base=down(np.ones(size)))

    base = apply(ones, "id long, change double, base double").groupBy("id").agg(F.sum("base").alias("base"))  # across, these give the degrees
    need = written(need.select(*at, "pos", "id").join(base, "id").repartition(shuffles, "id"))
    # scores are c plus the product of w across; Chebyshev's acceleration of the power iteration, whose eigenvalues lie between 0 and the damping
    c, last, omega, gamma, sigma = 1.0, 1.0, 1.0, 2 / (2 - damping), damping / (2 - damping)
    state = written(need.select("id").distinct().select("id", F.lit(0.0).alias("w"), F.lit(0.0).alias("before")).repartition(shuffles, "id"))
    for k in range(rounds):

        def turn(batches, c=c, last=last):
            for r, _, across, down in _blocks(batches):
                w, before = array(r["w"]), array(r["before"])
                score, degree = c + across(w), np.maximum(across(array(r["base"])), 1e-12)
                yield partial(r, np.abs(score - last - across(before)).max(initial=0), value=down(score / degree), w=w, before=before)

        omega = 1.0 if k == 0 else 1 / (1 - sigma * sigma / 2) if k == 1 else 1 / (1 - sigma * sigma * omega / 4)
        c, last = omega * (gamma * (1 - damping - c) + c - last) + last, c
        w, before = F.max("w"), F.max("before")
        found = apply(turn, "id long, change double, value double, w double, before double", need.join(state.select("id", "w", "before"), "id"), ("w", "before", "base"))
        found = found.groupBy("id").agg((omega * (gamma * (damping * F.sum("value") - w) + w - before) + before).alias("w"), w.alias("before"), F.max("change").alias("change"))
        state = written(found.repartition(shuffles, "id"))
        if k and (state.agg(F.max("change")).first()[0] or 0) < CHANGE:
            break

    def best(batches, c=c):
        import pyarrow as pa

        for r, size, across, _ in _blocks(batches):
            score = np.round(c + across(array(r["w"])), 7) if r["w"].is_valid else np.full(size, 1 - damping)
            top = np.lexsort((np.arange(size), -score))[:n]
            starts = np.r_[0, np.cumsum(np.array(r["parts"].values, int))]
            doc = np.searchsorted(starts, top, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array([r["cluster"].as_py()] * len(top), r["cluster"].type), r["docs"].values.take(pa.array(doc)), pa.array(top - starts[doc], pa.int32()), pa.array(score[top], pa.float64())], names=["cluster", "doc_id", "i", "score"])

    found = apply(best, f"cluster {kind['cluster']}, doc_id {kind['doc_id']}, i int, score double", need.join(state.select("id", "w"), "id"), ("w",))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "doc_id", "i"))
    return found.withColumn("place", place).where(F.col("place") <= n).drop("place")


def cluster_summaries(rows: DataFrame, n: int = 8, **options) -> DataFrame:
    """(cluster, summary): the n most central sentences of all documents (cluster, doc_id, text) of a cluster, in their order."""
    best = written(central_sentences(rows, n, **options))  # n rows a cluster
    found = rows.select("cluster", "doc_id", "text").join(F.broadcast(best), ["cluster", "doc_id"]).select("cluster", F.struct("doc_id", "i", F.get(sentences(F.col("text")), F.col("i")).alias("sentence")).alias("s"))
    return found.groupBy("cluster").agg(F.sort_array(F.collect_list("s")).alias("s")).select("cluster", F.array_join("s.sentence", " ").alias("summary"))


def describe(docs: DataFrame, assigned: DataFrame, sources: int = 10, points: int = 5, summary_sentences: int = 8, read: int = 50) -> DataFrame:
    """(cluster, title, docs, key_terms, topic, key_points, summary, sources): one row per cluster.

    Terms are counted over all documents of the cluster, with partial sums, and the summary is chosen from the sentences of all of them. Key
    points come from the first 50 sentences of all documents one after another, for which at most ``read`` documents by id are
    put together. Title and ``sources`` name the first documents too. Nothing unbounded is gathered per cluster."""
    rows = docs.join(assigned, "doc_id")
    terms = key_terms(rows, key="cluster").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t")).select("cluster", F.col("t.term").alias("key_terms"))  # at most ten a cluster
    size = rows.groupBy("cluster").agg(F.count("*").alias("docs"))
    first = rows.select("cluster", "doc_id", "text").withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id"))).where(F.col("n") <= read)
    merged = first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("d"))
    merged = merged.select("cluster", F.slice("d.doc_id", 1, sources).alias("sources"), F.array_join("d.text", "\n\n").alias("text"), title_from_content(F.get("d.text", F.lit(0)), F.get("d.doc_id", F.lit(0)).cast("string")).alias("title"))
    whole = merged.select(F.col("cluster").alias("doc_id"), "text")
    best = key_points(whole, points).groupBy(F.col("doc_id").alias("cluster")).agg(F.sort_array(F.collect_list(F.struct("place", "sentence"))).alias("p")).select("cluster", F.col("p.sentence").alias("key_points"))
    summary = cluster_summaries(rows, summary_sentences) if summary_sentences else size.select("cluster", F.lit("").alias("summary"))
    empty = F.array().cast("array<string>")
    joined = size.join(merged.drop("text"), "cluster").join(terms, "cluster", "left").join(best, "cluster", "left").join(summary, "cluster", "left")
    return joined.select("cluster", "title", "docs", F.coalesce("key_terms", empty).alias("key_terms"), topic(F.coalesce("key_terms", empty)).alias("topic"), F.coalesce("key_points", empty).alias("key_points"), F.coalesce("summary", F.lit("")).alias("summary"), "sources")


def report(described: DataFrame) -> DataFrame:
    """(cluster, text): the clusters as readable text."""
    points = F.array_join(F.transform("key_points", lambda p: F.concat(F.lit("• "), F.when(F.length(p) > 200, F.concat(F.substring(p, 1, 197), F.lit("..."))).otherwise(p))), "\n")
    named = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - "), s.cast("string"))), "\n")
    more = F.when(F.col("docs") > F.size("sources"), F.format_string("\n  ... and %d more", F.col("docs") - F.size("sources"))).otherwise(F.lit(""))
    text = F.concat(F.lit("=== "), "title", F.lit(" ===\n\nTOPIC: "), "topic", F.lit("\nDOCUMENTS: "), F.col("docs").cast("string"), F.lit("\n\nKEY POINTS:\n"), points, F.lit("\n\nSUMMARY:\n"), "summary", F.lit("\n\nKEY TERMS: "), F.array_join("key_terms", ", "), F.lit("\n\nSOURCES:\n"), named, more)
    return described.select("cluster", text.alias("text"))
