"""Operators on the index and on texts: distinctive terms, packing, leaks, splitting."""

import random
import re

import numpy as np
import pytest
from compare import assert_same, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import catalogue, distinctive, leak, pack, split
from quernstone.llm.tokens import encoding
from quernstone.session import written

POST = "term string, doc_id string, positions array<int>, tf int"
INFO = "doc_id string, url string, title string, token_count int, length int, indexed_at timestamp"
DOC = "doc_id bigint, text string"
ITEM = "item_id bigint, task string, prompt string, question string, passage string, answer string"


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit(7))
    return df


# -- 2


def info(spark, *rows):
    return spark.createDataFrame([(d, None, None, n, 0, t) for d, n, t in rows], "doc_id string, url string, title string, token_count int, length int, indexed_at string").withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))


def test_distinctive(spark):
    old, new = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    postings = spark.createDataFrame(
        [("rare", "a", [1, 2, 3, 3], None), ("rare", "a", [1, 2, 3, 4], 8), ("rare", "b", [0], 1), ("all", "a", [5], 1), ("all", "b", list(range(90)), 1), ("rare", "gone", [1], 1), (None, "a", [1], 1), ("nul", None, [1], 1), ("none", "a", None, 1), ("empty", "a", [], 0), ("part", "b", [None, 3], 1), ("zero", "z", [1, 2, 3, 4], 4), ("zero", "b", [99], 1)],
        POST,
    )
    docs = info(spark, ("a", 10, new), ("a", 900, old), ("a", 800, None), ("a", 10, new), ("b", 92, None), ("z", 0, None), (None, 5, None), ("bare", 5, None))
    got = {(r.doc_id, r.term): r for r in distinctive.distinctive_terms(clash(postings, "n", "documents", "docs", "score"), clash(docs, "n", "term", "in_all", "live")).collect()}
    assert set(got) == {("a", "rare"), ("b", "rare"), ("a", "all"), ("b", "all"), ("b", "part"), ("z", "zero"), ("b", "zero")}
    r = got["a", "rare"]
    assert (r.n, r.token_count, r.documents, r.in_all) == (4, 10, 2, 5) and r.of_all == 4 + 1 + 1 + 90 + 1 + 4 + 1
    assert r.idf == pytest.approx(np.log(5 / 3) + 1) and r.score == pytest.approx(0.4 * r.idf) and r.lift == pytest.approx(0.4 * 102 / 5)
    assert got["z", "zero"].score is None and got["a", "all"].lift < r.lift
    cases = distinctive.cases(distinctive.distinctive_terms(postings, docs)).collect()
    assert cases == [] and r.lift < 12
    more = postings.unionByName(spark.createDataFrame([("all", "b", list(range(100, 200)), 1)], POST))
    assert [(c.doc_id, c.term) for c in distinctive.cases(distinctive.distinctive_terms(more, docs)).collect()] == [("a", "rare")]
    assert distinctive.distinctive_terms(postings.limit(0), docs).collect() == [] and distinctive.distinctive_terms(postings, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, folder, name):
    assert_same(catalogue.QUERIES[name](spark, folder), duck(folder), catalogue.SQL[name])


# -- 8


def test_lengths_and_parts(spark):
    texts = [(1, "one two"), (2, None), (3, ""), (4, "word " * 5000), (None, "x"), (5, "<|endoftext|>")]
    lengths = {r.doc_id: r.n_tokens for r in pack.token_lengths(clash(spark.createDataFrame(texts, DOC), "n_tokens", "part", "container")).collect()}
    enc = encoding()
    assert lengths == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary("word " * 5000)), 5: len(enc.encode_ordinary("<|endoftext|>"))}
    items = pack.items_of(spark.createDataFrame([(1, 0), (2, 2048), (3, 2049), (4, 5000)], "doc_id bigint, n_tokens int")).collect()
    assert sorted((r.doc_id, r.part, r.n_tokens) for r in items) == [(1, 0, 0), (2, 0, 2048), (3, 0, 2048), (3, 1, 1), (4, 0, 2048), (4, 1, 2048), (4, 2, 904)]


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in histogram.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_bounds_are_optimal(histogram, k):
    import itertools

    bounds = pack.choose_bounds(histogram, k)
    top = max(histogram)
    best = min(padding(histogram, (*c, top)) for n in range(k) for c in itertools.combinations(histogram, n))
    assert len(bounds) <= k and bounds == sorted(bounds) and bounds[-1] == top and padding(histogram, bounds) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 60), min_size=1, max_size=15), st.integers(1, 6))
def test_plan_places_every_rank(histogram, k):
    bounds = pack.choose_bounds(histogram, k)
    counts = [sum(n for s, n in histogram.items() if s <= b and (i == 0 or s > bounds[i - 1])) for i, b in enumerate(bounds)]
    plan = pack.make_plan(bounds, counts, 40)
    load = np.zeros(plan.containers)
    for b, n in enumerate(counts):
        where = plan.place(np.full(n, b), np.arange(n))
        np.add.at(load, where, bounds[b])
    assert load.max() <= 40 and (load > 0).sum() + (bounds[0] == 0) >= 1


def test_packed(spark):
    r = random.Random(0)
    sizes = [min(int(r.lognormvariate(5.5, 0.8)), 6000) for _ in range(4000)] + [300] * 2000 + [0, 0, 2048, 2049]
    items = written(pack.items_of(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens int")))
    for salt in (500_000, 50):
        rows = pack.packed(items, per_salt=salt).collect()
        assert sum(x.n_tokens for x in rows) == sum(sizes) and len({(x.doc_id, x.part) for x in rows}) == len(rows) == items.count()
        load = np.bincount([x.container for x in rows], [x.n_tokens for x in rows])
        assert load.max() <= 2048 and load.sum() / (2048 * len(load)) > 0.97
        assert {x.doc_id for x in rows} == set(range(len(sizes)))
    assert pack.packed(items.limit(0)).collect() == []


# -- 9


def runs(a, b):
    """Longest run of equal words of two texts, by the plain table."""
    best, last = 0, {}
    for x in a:
        row = {}
        for j, y in enumerate(b):
            if x == y:
                row[j] = last.get(j - 1, 0) + 1
                best = max(best, row[j])
        last = row
    return best


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, "t", "p " * 30, " ".join(r.choices(vocabulary, k=22)), " ".join(r.choices(vocabulary, k=50)) if i % 4 else None, "a") for i in range(12)]
    docs = []
    for d in range(80):
        words = r.choices(vocabulary + ["other", "words"], k=r.choice([0, 5, 60, 200]))
        if d % 3 == 0:
            own = items[d % 12][3 + d % 2] or items[d % 12][3]
            own = own.split()
            a = r.randrange(0, len(own) - 8)
            cut = own[a : a + r.choice([10, 11, 12, 13, 20])]
            at = r.randrange(0, len(words) + 1)
            words[at:at] = [w.upper() + r.choice(["", ",", "**", "\r\n"]) for w in cut]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (902, "é" * 3), (903, docs[0][1])]
    items += [(None, "t", "p", "q " * 20, None, "a"), (50, None, None, None, None, None), (51, "t", "p", "", "too short to count", "a")]
    frame, goods = clash(spark.createDataFrame(docs, DOC), "item_id", "run", "field"), clash(spark.createDataFrame(items, ITEM), "doc_id", "run", "x")
    want = {(d, i) for d, t in docs if d is not None and t for i, _, _, q, p, _ in items if i is not None and max(runs(leak.words_of(t), leak.words_of(x)) if x else 0 for x in (q, p)) >= 12}
    for sent in (2_000_000, 0):  # items sent to all tasks, and joined by a shuffle
        monkeypatch.setattr(leak, "SENT_WORDS", sent)
        got = leak.leaks(frame, goods).where("run >= 12").select("doc_id", "item_id").distinct().collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and want
    assert leak.leaks(frame.limit(0), goods).collect() == [] and leak.leaks(frame, goods.limit(0)).collect() == []


def test_substitutions(spark):
    words = [f"word{i}" for i in range(30)]
    changed = [*words]
    changed[7] = changed[19] = "another"
    got = leak.leaks(spark.createDataFrame([(1, " ".join(changed))], DOC), spark.createDataFrame([(1, "t", "p", "q", " ".join(words), "a")], ITEM)).collect()
    assert len(got) == 1 and got[0].run == 11 and got[0].similarity >= 0.9 and got[0].field == "passage"


def test_words():
    assert leak.words_of("Café **X_y** 2nd—one’s") == ["café", "x", "y", "2nd", "one", "s"] and leak.words_of(None) == []


def test_leaks_keep_similarity_of_another_alignment(spark):
    """A copy with every sixth word replaced, and a phrase of the item elsewhere in the document whose run is longer."""
    words = [f"w{i}" for i in range(40)]
    copy = [f"other{i}" if i % 6 == 5 else w for i, w in enumerate(words)]
    phrase = [words[0], "odd", *words[2:10], "even", words[11]]
    item = spark.createDataFrame([(1, "t", "p", "q", " ".join(words), "a")], ITEM)
    for parts in ((copy, phrase), (phrase, copy)):
        text = " ".join(w for p in parts for w in [*p, *(f"fill{i}" for i in range(50))])
        got = leak.leaks(spark.createDataFrame([(1, text)], DOC), item).collect()
        assert [(r.run, r.item_word) for r in got] == [(8, 2)] and got[0].similarity == pytest.approx(20 / 24)


# -- 10


def greedy(successor):
    out, at = [0], 0
    while successor[at] != at:
        at = int(successor[at])
        out.append(at)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(3, 30), st.integers(0, 2), st.lists(st.integers(1, 400), max_size=30))
def test_doubling_equals_walking(n, limit, overlap, marks):
    every = np.arange(1, n + 1)
    marks = np.unique([*[m for m in marks if m <= n], n])
    table = split.successors(n, [marks, every], limit, overlap)
    cuts = split.chain(table)
    assert cuts.tolist() == greedy(table) and cuts[-1] == n
    starts = np.maximum(cuts[:-1] - overlap, 0)
    assert (cuts[1:] - starts <= limit).all()


@pytest.mark.parametrize("text", ["word " * 3000, "One sentence stands here, as it should. " * 500, "para graph one\n\n" * 900, "x" * 20000, "日本語のテキスト" * 900, "é🙂" * 3000, "a\r\nb\r\n" * 2000, ("Long line of text. " * 20 + "\n\n") * 40])
def test_split_round_trip(text):
    enc = encoding()
    pieces = split.pieces_of(text, enc)
    assert len(pieces) > 1 and all(n <= 1500 and n == len(enc.encode_ordinary(p)) for p, n, _, _ in pieces)
    assert all(100 <= shared <= 104 for _, _, shared, _ in pieces[1:]) and pieces[0][2] == 0
    end = 0
    for piece, _, _, start in pieces:
        assert text[start : start + len(piece)] == piece and start <= end < start + len(piece)
        end = start + len(piece)
    assert end == len(text)


def test_split_at_natural_breaks():
    enc = encoding()
    text = ("The queue is written to the disk and read once more. " * 12 + "\n\n") * 20
    ends = [p[0] for p in split.pieces_of(text, enc)[:-1]]
    assert all(re.search(r"\n\s*$", p) for p in ends)
    assert all(p.rstrip().endswith(".") for p, *_ in split.pieces_of("The queue is written to the disk. " * 800, enc)[:-1])


def test_split_documents(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "word " * 4000), (None, "word " * 4000), (5, "word " * 1499), (6, " word" * 1501), (6, " word" * 1501)]
    got = split.split_documents(clash(spark.createDataFrame(rows, DOC), "piece", "n_tokens", "shared")).collect()
    assert {r.doc_id for r in got} == {4, 6} and max(r.n_tokens for r in got) <= 1500
    assert [r.piece for r in got if r.doc_id == 4] == [0, 1, 2] and sum(r.doc_id == 6 for r in got) == 4
    assert split.split_documents(spark.createDataFrame([], DOC)).collect() == []


@pytest.mark.parametrize("name", ["p8_pack", "p9_leaks", "p10_found", "p10_pieces", "p2_terms"])
def test_queries(spark, folder, name):
    assert catalogue.QUERIES[name](spark, folder).limit(3).collect()
