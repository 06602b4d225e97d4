"""Column forms against the plain functions that they stand for, and readers and sinks that must not guess."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakewright import shared
from lakewright.functions import pages as pg, text as tx
from lakewright.operators import conversation as conv, facets, filters, queue as q
from lakewright.sources import readers, sinks
from lakewright.streaming import live


def test_chunks_against_the_fold(spark):
    r = random.Random(2)
    block = lambda: "".join(r.choice(["ab", "c", " ", "  ", "日", "本語", " ", "x" * 9]) for _ in range(r.randint(0, 14)))
    lists = [[block() for _ in range(r.randint(0, 9))] for _ in range(150)] + [None, []]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(lists)], "k int, b array<string>")
    for budget in (1, 3, 7):
        got = {x.k: x.c for x in rows.select("k", tx.chunk_blocks("b", budget).alias("c")).collect()}
        for k, b in enumerate(lists):
            assert got[k] == tx.chunked(b, budget), (b, budget)
    assert spark.createDataFrame([("w " * 20_000,)], "t string").select(F.size(tx.chunk_blocks(F.array("t"), 512))).first()[0] == 40


def test_deltas_against_the_fold(spark):
    r = random.Random(4)
    lists = [["".join(r.choice("abé ") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))] for _ in range(60)] + [None]
    got = {x.k: x.c for x in spark.createDataFrame(list(enumerate(lists)), "k int, d array<string>").select("k", conv.coalesce_deltas("d").alias("c")).collect()}
    assert all(got[k] == (None if d is None else conv.coalesced(d)) for k, d in enumerate(lists))


def test_fallbacks_against_the_replay(spark):
    r = random.Random(5)
    kinds = ["ok", "truncated", "invalid", "rate_limited", "failed"]
    said = {k: [(r.choice("ab"), r.choice(kinds)) for _ in range(r.randint(1, 8))] for k in range(200)}
    rows = spark.createDataFrame([(k, i, m, kind) for k, x in said.items() for i, (m, kind) in enumerate(x)], "request int, seq int, model string, kind string")
    for x in conv.fallbacks(rows, ["a", "b"]).collect():
        want = conv.replay_chain([{"model": m, "kind": kind} for m, kind in said[x.request]], ["a", "b"])
        assert {k: x[k] for k in want} == want, said[x.request]


def test_nth(spark):
    r = random.Random(6)
    values = [r.choice([r.uniform(-5, 5), 1.25, 7.0]) for _ in range(30_000)] + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v double").cache()
    ranked = sorted(v for v in values if v is not None)
    for n in (0, 17, 14_999, 15_000, 29_999):
        assert facets.nth(rows, "v", n) == ranked[n]
    assert facets.nth(rows, "v", 30_000) is None and facets.upper_median(rows, "v") == ranked[15_000]
    assert facets.upper_median(rows.limit(0), "v") is None


def test_trees():
    assert pg.tree_text(None) is None and pg.tree_text("") == ""
    assert pg.tree_text("<body>a<p>b<p>c</body>") == "a\nb\nc"
    assert pg.tree_text("<p>x</p><main>in<br>side<main>deep</main></main><p>y</p>") == "in\n\nside\ndeep"
    assert pg.tree_text("<div aria-hidden='true'>a<div>b</div>c</div>d") == "d"
    page = "<header>h</header><table><tr><th>a<th>b</tr><tr><td>1<td>2 &lt;</table>t"
    assert pg.tree_text(page, pg.SILENT | pg.CHROME, True) == "| a | b |\n|---|---|\n| 1 | 2 < |\n\nt"


def test_scan_ends(spark):
    body = lambda n, total=None: json.dumps({"d": {"results": [{"id": i} for i in range(n)]} | ({"total": total} if total is not None else {})})
    rows = [("short", 1, body(10)), ("short", 2, body(3)), ("short", 3, body(10)), ("told", 1, body(10, 20)), ("told", 2, body(10)), ("told", 3, body(10)), ("empty", 1, body(0, 5)), ("empty", 2, body(10)), ("broken", 1, "x")]
    got = readers.api_scan(spark.createDataFrame(rows, "scan string, page int, body string")).collect()
    assert {(r.scan, r.page, r.is_last) for r in got} == {("short", 1, False), ("short", 2, True), ("told", 1, False), ("told", 2, True), ("empty", 1, True), ("broken", 1, True)}


def test_positions_follow_the_feed(spark, tmp_path):
    """The first file by name is the smaller one, which Spark reads last."""
    (tmp_path / "a.jsonl").write_text(json.dumps({"slug": "s", "title": "first"}) + "\n")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"slug": "s", "title": f"later {i}", "tags": ["x" * 50]}) + "\n" for i in range(2000)))
    assert [r.title for r in readers.catalogue_feed(spark, str(tmp_path)).collect()] == ["first"]


def test_a_table_that_cannot_be_read_stops_the_load(spark, tmp_path):
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "in"))
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part-0.parquet").write_text("no parquet")
    query = live.load_once(live.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "table"), str(tmp_path / "c"), ["k"])
    with pytest.raises(Exception):
        query.awaitTermination()


def test_urls_as_they_stand(spark):
    urls = [" https://a/x.pdf ", "https://a/x.pdf?v=1", "https://a/x.PDF", "ftp://a", None, "https://a/y", "https://a/y "]
    rows = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, position int")
    assert {(r.url, r.position) for r in filters.fetch_targets(rows, only_html=True).collect()} == {("https://a/x.pdf?v=1", 1), ("https://a/y", 5)}
    assert {r.position for r in filters.fetch_targets(rows, only_pdfs=True).collect()} == {0, 2}


def test_a_large_report_is_no_single_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "REPORT_ROWS", 5)
    sinks.report(spark.range(20).repartition(3), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*"))) == 3 and spark.read.json(str(tmp_path / "r")).count() == 20


def test_waits_over_many_days(spark):
    """Days are ordered apart: the same waits as in one order."""
    import datetime as dt

    r = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, k, start + dt.timedelta(seconds=round(r.uniform(0, 5 * 86400), 3))) for i, k in enumerate(r.choice([1, 1, 1, 2, None]) for _ in range(400))]
    got = {x.event_id: x.waited for x in q.bucket_waits(spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp"), 1 / 20, burst=2).collect()}
    s = 1200.0
    for key in (1, 2, None):
        own = sorted((t.timestamp(), i) for i, k, t in rows if k == key)
        lead = -1e18
        for n, (t, i) in enumerate(own):
            lead = max(lead, t - n * s)
            assert abs(got[i] - max(0.0, lead + (n - 1) * s - t)) < 0.01


def test_shared(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not shared.exists(spark, path)
    spark.range(5).write.parquet(path)
    before = shared.stamp(spark, path)
    assert shared.exists(spark, path) and before == shared.stamp(spark, path)
    spark.range(50).write.mode("append").parquet(path)
    assert shared.stamp(spark, path) != before and shared.spread(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert shared.cut(spark.range(3)).count() == 3
