import datetime as dt

from pyspark.sql import Row, functions as F

from lakewright.functions import records as rec
from lakewright.functions.scalars import page_count, percent
from lakewright.operators import audit, conversation as conv, dedup, filters, queue as q, retrieval
from lakewright.schemas import schema


def ranked(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "slug string, position int")


def fused(spark, lists, k=60):
    f = retrieval.fuse([ranked(spark, x) for x in lists], k=k)
    return [r.slug for r in f.orderBy(F.desc("score"), "list", "position").collect()]


def test_fusion(spark):
    assert fused(spark, [["a", "shared", "b"], ["c", "shared", "d"]])[0] == "shared"
    assert fused(spark, [["a", "b"]]) == ["a", "b"]
    assert fused(spark, [["a"], ["b"]]) == ["a", "b"]
    lists = [["solo", "x", "y", "both"], ["p", "q", "r", "both"]]
    assert fused(spark, lists)[0] == "both"
    assert fused(spark, lists, k=0)[0] == "solo"


def test_ranks(spark):
    doc = spark.createDataFrame([(["a", "b", "x", "a"],)], "d array<string>")
    terms = lambda *t: F.array(*[F.lit(x) for x in t])
    got = doc.select(retrieval.any_rank(F.col("d"), terms("a", "z")).alias("any"), retrieval.all_rank(F.col("d"), terms("a", "b")).alias("all"), retrieval.all_rank(F.col("d"), terms("b")).alias("one")).first()
    assert abs(got.any - 0.1 * 1.25 / 1.64493406685 / 2) < 1e-12
    import math

    w = lambda d: 0.1 / math.sqrt(1.005 + 0.05 * math.exp(d / 1.5 - 2))
    assert abs(got.all - (1 - (1 - w(1)) * (1 - w(2)))) < 1e-12
    assert abs(got.one - 0.1 / 1.64493406685) < 1e-12


def test_history(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f" m{i} " + "x" * 900 * (i == 38)) for i in range(40)] + [(1, 40, "system", "no"), (2, 0, "user", "  "), (3, 0, "user", None)]
    got = filters.clean_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [r.turn for r in got] == [35, 36, 37, 38, 39] and len(got[3].content) == 700
    fresh = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "conv_id int, slug string, position int")
    carried = spark.createDataFrame([(1, x, i) for i, x in enumerate("bcdefg")], "conv_id int, slug string, position int")
    assert [r.slug for r in dedup.merge_context(fresh, carried).orderBy("rank").collect()] == list("abcdef")


def test_states(spark):
    rows = spark.createDataFrame([(1, "T", "Goa\nT\nx"), (2, "T", "T\nASSAM"), (3, "T", "T\nx\nGoa"), (4, "T", "y"), (5, "", "Goa"), (6, "T", "people of Goa can\nT"), (7, None, "x")], "slug int, title string, text string")
    assert {r.slug: r.state for r in dedup.state_from_page(rows).collect()} == {1: "Goa", 2: "Assam", 3: "Central", 4: None, 5: None, 6: "Central", 7: None}


def test_newest_and_upsert(spark):
    rows = spark.createDataFrame([("a", False, "3", 0), ("a", True, "1", 1), ("a", True, "2", 2), ("a", True, "2", 3), ("b", True, None, 4)], "slug string, ok boolean, fetched_at string, position int")
    assert {(r.slug, r.position) for r in dedup.newest_ok(rows).collect()} == {("a", 2), ("b", 4)}
    old = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, keep int")
    new = spark.createDataFrame([(2, "z", 0), (2, "zz", 1), (3, "w", 0)], "k int, v string, position int")
    assert {tuple(r) for r in dedup.upsert(old, new, ["k"], "position", keep=["keep"]).collect()} == {(1, "x", 5), (2, "zz", 6), (3, "w", None)}
    assert dedup.insert_ignore(old, new, ["k"]).count() == 1


def test_saturate(spark):
    sweeps = [[1, 2], [2, 3], [3], [3], [1], [2]]
    seen, n = dedup.saturate(lambda i: spark.createDataFrame([(x,) for x in sweeps[i]], "k int"), ["k"])
    assert n == 6 and {r.k for r in seen.collect()} == {1, 2, 3}


def test_confidence_and_snippet(spark):
    names = [f.name for f in schema("payload")]
    make = lambda **k: spark.createDataFrame([(tuple(k.get(n) for n in names), "T", "M", ["c"], "D")], f"p struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in schema('payload'))}>, t string, m string, c array<string>, d string")
    rows = make(fee_amount=0.0, how_to_apply=[], email="", helpline="1")
    assert rows.select(rec.confidence(F.col("p"))).first()[0] == 0.125
    assert make(fee_amount=1.0, page_is_about_a_service=False).select(rec.confidence(F.col("p"))).first()[0] == 0
    said = rows.select(rec.snippet(F.col("t"), F.col("m"), F.col("c"), F.col("d"), F.col("p"))).first()[0]
    assert said == "SCHEME: T\nMinistry: M\nCategory: c\nWhat it is: D\nHelpline: 1"


def test_record_rules(spark):
    r = spark.createDataFrame([({"a": 0, "b": 1}, ["u"], "state", None)], "prov map<string,int>, src array<string>, level string, state string")
    got = r.select(rec.provenance_in_range(F.col("prov"), F.col("src")).alias("ok"), rec.source_of("a", F.col("prov"), F.col("src")).alias("s"), rec.source_of("b", F.col("prov"), F.col("src")).alias("none"), rec.level_has_state(F.col("level"), F.col("state")).alias("level")).first()
    assert tuple(got) == (False, "u", None, False)


def test_queue(spark):
    t = dt.datetime(2024, 1, 1)
    cols = "id long, raw_document_id long, tier int, status string, attempts int, model_used string, last_error string, claimed_at timestamp, completed_at timestamp"
    queue = spark.createDataFrame([(i, i, i % 2, "pending" if i < 4 else "done", 0, None, None, None, None) for i in range(6)], cols)
    now = F.lit(t)
    taken = q.claim(queue, 3, now)
    assert {r.id for r in taken.where("status = 'in_flight'").collect()} == {0, 2, 1}
    results = spark.createDataFrame([(0, "done", None, "m"), (2, "parked", "e", None)], "id long, new_status string, error string, model string")
    after = {r.id: r for r in q.release(taken, results, now).collect()}
    assert after[0].completed_at is not None and after[2].completed_at is None and after[2].last_error == "e" and after[1].status == "in_flight"
    assert q.reclaim(taken).where("status = 'in_flight'").count() == 0


def test_bucket_against_a_fold(spark):
    import random

    r = random.Random(4)
    at = sorted(r.uniform(0, 60) for _ in range(60))
    rows = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=round(a, 3))) for i, a in enumerate(at)], "event_id int, user_id int, ts timestamp")
    got = {x.event_id: x.waited for x in q.bucket_waits(rows, 20).collect()}
    tokens, last, want = 20.0, 0.0, {}
    for i, a in enumerate(round(a, 3) for a in at):
        now = max(a, last)
        tokens = min(20.0, tokens + (now - last) / 3)
        if tokens < 1:
            now += (1 - tokens) * 3
            tokens = 1.0
        tokens, last = tokens - 1, now
        want[i] = now - a
    assert all(abs(got[i] - want[i]) < 0.01 for i in want)


def test_audit(spark):
    nulls = spark.createDataFrame([(1, "fee_amount", "Fee Rs 100 only"), (2, "fee_amount", "nothing"), (3, "fee_amount", "Fee Rs 100"), (4, "fee_amount", "Fee Rs 100"), (5, "fee_amount", "Fee Rs 100"), (6, "fee_amount", "Fee Rs 100 at the desk"), (7, "fee_amount", "Fee Rs 100")], "doc_id int, field string, page string")
    said = spark.createDataFrame([(1, "fee_amount", True, "Fee  Rs 100"), (3, "fee_amount", True, "Fee Rs 999"), (4, "fee_amount", False, None), (6, "fee_amount", True, "at the desk"), (7, "fee_amount", True, None)], "doc_id int, field string, stated boolean, quote string")
    got = {r.doc_id: r.verdict for r in audit.null_audit(nulls, said).collect()}
    assert got == {1: "missed", 2: "confirmed_absent", 3: "uncertain", 4: "confirmed_absent", 5: "uncertain", 6: "confirmed_absent", 7: "uncertain"}
    recall = audit.token_recall(spark.createDataFrame([(1, "aaa bbb bbb", "aaa bbb ccc ddd"), (2, "", "")], "doc_id int, stored string, source string"))
    assert {(r.doc_id, round(r.recall), round(r.extra)) for r in recall.collect()} == {(1, 50, 33), (2, 0, 0)}


def test_quotes_of_any_length(spark):
    texts = {1: "The  quick\nbrown fox jumps", 2: "quick", 3: "ab 😀cd ef", 4: "", 5: None, 6: "one two three four five six", 7: "aaa"}
    said = ["quick", "QUICK brown", "the quick brown", "quick brown fox jumps", "the quick brown fox jumps", "a", "😀", "b 😀c", "ab", "uick br", "wo three fou", "wo three four fi", "wo three four five s", "", None, "none of these", "aaaa", " fox "]
    pages = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    quotes = spark.createDataFrame(list(enumerate(said)), "item_id int, quote string")
    flat = lambda t: " ".join((t or "").lower().split())
    want = {(i, d) for i, q in enumerate(said) for d, t in texts.items() if flat(q) and flat(q) in flat(t)}
    got = audit.find_quotes(pages, quotes, "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert audit.find_quotes(pages, quotes.limit(0), "doc_id", "item_id").collect() == []


def test_replay():
    assert conv.coalesced(["abc", "def", "ghijkl", "m"]) == ["abcdefghijkl", "m"]
    reply = lambda m, k: {"model": m, "kind": k}
    got = conv.replay_chain([reply("a", "invalid"), reply("a", "invalid"), reply("b", "ok")], ["a", "b"])
    assert got["model"] == "b" and got["fell_back"] and got["attempts"] == 3
    assert conv.replay_chain([reply("a", "truncated"), reply("a", "ok")], ["a"])["budget"] == 32_000
    assert conv.replay_stream(False, True) == "next_model" and conv.replay_stream(True, True) == "interrupted"


def test_numbers(spark):
    got = spark.createDataFrame([(0, 25), (49, 24)], "n long, k int").select(page_count(F.col("n"), 24).alias("p"), percent(F.col("n"), F.lit(0)).alias("z")).collect()
    assert [r.p for r in got] == [1, 3] and got[0].z == 0


def test_licence(spark):
    rows = [Row(site="s", path="/terms", body="<p>all rights reserved</p>"), Row(site="s", path="/copyright", body="public  domain; public domain"), Row(site="t", path="/x", body="public domain")]
    assert [tuple(r) for r in filters.licence(spark.createDataFrame(rows)).collect()] == [("s", "public-domain", "/copyright")]
