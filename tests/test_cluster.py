import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import cluster

DOC = "doc_id bigint, text string"


def test_key_terms_and_topic(spark):
    docs = spark.createDataFrame([(1, "Install the setup tool. Tool tool install page"), (2, ""), (3, None)], DOC)
    rows = cluster.key_terms(docs, 2).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.term, r["count"]) for r in rows] == [(1, "tool", 3), (1, "install", 2)]
    cases = [(["tooling"], "Tools"), (["apple", "reinstall"], "Installation"), (["apple"], "Apple"), ([], "Documentation")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "t array<string>").select(cluster.topic(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [w for _, w in cases]


def test_key_points(spark):
    text = "You must set the option before the first run of it. Is this a question that nobody asked before? Short. " + "x" * 300 + ". The plain sentence stands here without any meaning."
    rows = cluster.key_points(spark.createDataFrame([(1, text), (2, None)], DOC), 5).orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3] and rows[0].sentence.startswith("You must")


def test_lexrank_equals_dense(spark):
    import re

    parts = ["apple banana apple", "banana cherry", "apple cherry date", "egg fig"]
    bags = [re.findall("[a-z]+", p) for p in parts]
    words = sorted({w for b in bags for w in b})
    a = np.array([[b.count(w) * np.log(1 + 4 / sum(w in c for c in bags)) for w in words] for b in bags])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    m = a @ a.T
    m /= m.sum(0, keepdims=True)
    x = np.full(4, 0.25)
    for _ in range(200):
        x = 0.15 / 4 + 0.85 * m @ x
    assert np.allclose(cluster.lexrank_order(parts, rounds=200), x, atol=1e-6)
    docs = spark.createDataFrame([(1, "A b c. D e f. A b d."), (2, None)], DOC)
    got = {r.doc_id: r.summary for r in cluster.summaries(docs, 2).collect()}
    assert got[2] == "" and got[1].count(".") == 2


def test_clusters(spark):
    docs = spark.createDataFrame([(i, ("apple pear fruit " if i % 2 else "engine wheel motor ") * 5) for i in range(20)] + [(99, None)], DOC)
    rows = cluster.clusters(docs, k=2, max_iter=20, min_df=1).where("doc_id < 50").collect()
    assert len({r.cluster for r in rows if r.doc_id % 2}) == 1 and len({r.cluster for r in rows}) == 2
    report = cluster.describe(docs, spark.createDataFrame([(r.doc_id, r.cluster) for r in rows], "doc_id bigint, cluster int")).collect()
    assert sum(r.docs for r in report) == 20 and {r.key_terms[0] for r in report} == {"apple", "engine"}


def test_cluster_summary_reads_all_documents(spark):
    """Sixty documents of words of their own, and after them three on one thing, which are the most central."""
    odd = [f"alone{chr(97 + i // 26)}{chr(97 + i % 26)} stands here." for i in range(60)]
    late = ["The river floods the valley. The river floods it.", "The river floods the valley again.", "A river floods the valley."]
    docs = spark.createDataFrame(list(enumerate(odd + late)) + [(90, None), (91, ""), (92, "?!"), (93, "Other words. Of cluster two.")], DOC)
    rows = docs.withColumn("cluster", F.when(F.col("doc_id") == 93, 2).when(F.col("doc_id") == 91, 3).otherwise(1))
    parts = [(i, k, s) for i, t in enumerate(odd + late) for k, s in enumerate(t.replace(". ", ".\n").split("\n"))] + [(92, 0, "?!")]
    want = cluster.lexrank_order([s for _, _, s in parts], rounds=200) * len(parts)
    order = sorted(np.lexsort((np.arange(len(parts)), -np.round(want, 7)))[:3])
    for size in (8_000_000, 300):
        got = {(r.doc_id, r.i): r.score for r in cluster.central_sentences(rows, 100, block_chars=size).where("cluster = 1").collect()}
        assert set(got) == {(i, k) for i, k, _ in parts} and np.allclose([got[i, k] for i, k, _ in parts], want, atol=1e-5)
    found = {r.cluster: r.summary for r in cluster.describe(docs, rows.select("doc_id", "cluster"), summary_sentences=3).collect()}
    assert found == {1: " ".join(parts[i][2] for i in order), 2: "Other words. Of cluster two.", 3: ""} and "river" in found[1]
