import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.operators import crawl, graph


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_ring(spark):
    ring = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), (None, "A"), ("A", None))
    scores = [r.score for r in graph.pagerank(ring).collect()]
    assert len(scores) == 3 and all(s == pytest.approx(1 / 3, abs=1e-3) for s in scores)


def test_rank_against_plain_iteration(spark):
    pairs = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("d", "a"), ("e", "a"), ("e", "e")]
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [d for s, d in pairs if s == n] for n in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(6):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for n in nodes:
            for d in out[n]:
                new[d] += 0.85 * want[n] / len(out[n])
        want = new
    got = {r.id: r.score for r in graph.pagerank(edges(spark, *pairs), iterations=6, tolerance=0).collect()}
    assert got == pytest.approx(want)
    assert sum(r.score for r in graph.normalized(graph.pagerank(edges(spark, *pairs), iterations=6, tolerance=0)).collect()) == pytest.approx(1)


def test_empty_graph(spark):
    with pytest.raises(ValueError):
        graph.pagerank(edges(spark, (None, "a")))


def test_boost_top_scale(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "id string, score double")
    base = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0)], "id string, score double")
    assert {r.id: r.score for r in graph.boosted(base, ranks, 0.5).collect()} == pytest.approx({"a": 3.0, "b": 2.5, "c": 2.0})
    assert [r.score for r in graph.boosted(base, ranks.limit(0), 0.5).collect()] == [2.0] * 3
    assert [r.id for r in graph.top(ranks, 1).collect()] == ["a"]
    assert {r.score for r in graph.scaled(ranks, 2).collect()} == {1.0, 0.5}


def test_depths(spark):
    e = edges(spark, ("0", "1"), ("1", "2"), ("2", "3"), ("1", "0"))
    seeds = spark.createDataFrame([("0",), (None,)], "id string")
    assert {r.id: r.depth for r in graph.depths(e, seeds, 2).collect()} == {"0": 0, "1": 1, "2": 2}
    assert {r.id: r.depth for r in graph.depths(e, seeds, 0).collect()} == {"0": 0}
    assert {r.id: (r.out_links, r.in_links) for r in graph.degrees(e).collect()}["1"] == (2, 1)


CAND = "url string, parent string, depth int, priority int"


def test_frontier(spark):
    rows = spark.createDataFrame([("u3", None, 1, 3), ("u1", None, 1, 1), ("u2", None, 1, 2)], CAND)
    assert [r.url for r in crawl.frontier(rows).collect()] == ["u1", "u2", "u3"]
    rows = spark.createDataFrame([("deep", None, 10, 1), ("flat", None, 1, 1), ("late", None, 0, 5)], CAND)
    assert [r.url for r in crawl.frontier(rows).collect()] == ["flat", "deep", "late"]
    assert [r.url for r in crawl.frontier(rows, "bfs").collect()] == ["late", "flat", "deep"]


def test_admission(spark):
    rows = spark.createDataFrame([(f"https://a.com/{i}", "p", 1, 1) for i in range(40)] + [("https://A.com/0/#x", "o", 1, 1), (None, "p", 1, 1), ("https://a.com/deep", "p", 2, 0)], CAND)
    seen = spark.createDataFrame([("https://a.com/3/",)], "url string")
    assert crawl.admitted(rows, seen, budget=25, depth=1).count() == 25
    every = [r.url for r in crawl.admitted(rows, seen, depth=1).collect()]
    assert len(every) == 39 and "https://a.com/3" not in every and "https://a.com/deep" not in every
    assert crawl.admitted(rows, seen, depth=0).count() == 0


def test_schedule(spark):
    rows = spark.createDataFrame([(f"https://a.com/{i}",) for i in range(50)] + [("https://b.com/",)], "url string")
    times = sorted(r.start_ms for r in crawl.schedule(rows, 500).where("host = 'a.com'").collect())
    assert times == [i * 500 for i in range(50)]


def plain_backoffs(times, base, most):
    out, last, b = [], None, 0
    for t in times:
        b = min(b * 2, most) if last is not None and t < last + b else base
        last = t
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_backoffs_against_a_loop(spark, seed):
    import random

    r = random.Random(seed)
    t0 = datetime.datetime(2024, 1, 1)
    rows, want = [], {}
    for d in ("x", "y", "z"):
        at, times = 0, []
        for i in range(60):
            at += r.choice([1, 100, 299, 300, 2000, 9000, 40000])
            times.append(at)
            rows.append((d, t0 + datetime.timedelta(seconds=at), i))
        want[d] = plain_backoffs(times, 300, 7200)
    r.shuffle(rows)
    events = spark.createDataFrame([*rows, (None, t0, 1), ("q", None, 1)], "domain string, ts timestamp, event_id int")
    for unit in ("day", "minute"):
        got = crawl.backoffs(events, unit=unit).collect()
        for d in want:
            assert [x.backoff for x in sorted((g for g in got if g.domain == d), key=lambda g: g.event_id)] == want[d]
        assert len(got) == 180
    assert crawl.backoffs(events.limit(0)).collect() == []


def test_still_blocked(spark):
    t = datetime.datetime(2024, 1, 1)
    states = spark.createDataFrame([("a", t, 1, 300), ("a", t + datetime.timedelta(seconds=10), 2, 600), ("b", t, 1, 60)], "domain string, ts timestamp, event_id int, backoff int")
    rows = crawl.still_blocked(states, F.lit("2024-01-01 00:05:00").cast("timestamp")).collect()
    assert [(r.domain, r.backoff) for r in rows] == [("a", 600)]


def test_retry_and_robots(spark):
    rows = spark.createDataFrame([(429, 0, None, None), (503, 2, None, None), (500, 3, None, None), (404, 0, None, None), (429, 1, "17", None), (200, 0, None, "CloudFlare"), (403, 0, "x", None)], "s int, a int, r string, v string")
    got = rows.select(crawl.should_retry(F.col("s"), F.col("a")).alias("retry"), crawl.retry_delay(F.col("s"), F.col("a"), F.col("r")).alias("delay"), crawl.block_class(F.col("s"), F.col("v"), F.lit(None).cast("boolean")).alias("block")).collect()
    assert [(x.retry, x.delay, x.block) for x in got] == [(True, 30, "rate-limited"), (True, 30, "rate-limited"), (False, 20, None), (False, 5, None), (True, 17, "rate-limited"), (False, 5, "blocked"), (False, 5, "blocked")]
    rules = spark.createDataFrame([("a.com", "/x", False), ("a.com", "/x/y", True), ("a.com", "", False)], "host string, prefix string, allow boolean")
    urls = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/x/y/1",), ("https://a.com/",), ("https://b.com/x",)], "url string")
    assert {r.url for r in crawl.allowed_by_robots(urls, rules).collect()} == {"https://a.com/x/y/1", "https://a.com/", "https://b.com/x"}
