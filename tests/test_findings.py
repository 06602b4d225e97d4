"""Queries against their SQL on odd rows that the driver's tables rarely have."""

import pytest
from pyspark.sql import functions as F

from helpers import norm
from lakewright import plans


@pytest.fixture
def odd(spark, tmp_path):
    """odd(table=frame, ...): a folder of tables, and DuckDB's rows of a query over them."""
    import duckdb

    def made(**tables):
        c = duckdb.connect()
        for name, frame in tables.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), lambda query: c.execute(plans.oracle_sql()[query]).df()

    return made


def same(spark, made, query):
    d, sql = made
    found = plans.queries()[query](spark, d).toPandas()
    assert norm(found) == norm(sql(query))
    return found


def documents(spark, texts, source="src3"):
    rows = [(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_last_page(spark, odd):
    """Rows without a text end the listing, beyond page 999 too; labels that repeat a document do not repeat its row."""
    made = odd(documents=documents(spark, [None if k % 5 == 0 else f"{k % 7} text" for k in range(24_010)]), labels=spark.createDataFrame([(5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"))
    assert len(same(spark, made, "browse_last_page")) == 10


def test_hidden_loss(spark, odd):
    """A loss that no whole number of characters a page makes up."""
    pages = spark.createDataFrame([(8, "u", "abc"), (8, "v", "ab"), (9, "w", None)], "page_id long, url string, html string")
    assert same(spark, odd(pages=pages), "hidden_gain").average[0] == -3


def test_cut_references(spark, odd):
    """A page's title may end inside of a reference, which the SQL leaves as it stands."""
    html = ["<h1>a &amp; b &am</h1>c &amp", "x &amp &amp;amp; &amp;quot; &copy;&middot;&quot;z&quot; &ampquot; &x; &", "", None, "&amp;", "plain " * 50]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    same(spark, odd(pages=pages), "page_text")


def test_references_as_the_library_decodes_them(spark):
    """Whole texts as html.unescape() gives them, though Python is sent the references alone."""
    import html
    import random

    from lakewright.functions import text as tx

    r = random.Random(8)
    pieces = ["&", "amp", ";", "#65", "#x41", "&lt", "&notit;", "&NotEqualTilde;", "&#0;", "&#x110000;", "é", " ", "\n", "<", "&nbsp;", "x" * 40, "&#128;", "日", "&CounterClockwiseContourIntegral;", ""]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(500)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for x in rows.select("k", tx.unescape("t").alias("got")).collect():
        assert x.got == (None if texts[x.k] is None else html.unescape(texts[x.k])), texts[x.k]


def test_texts_stay_out_of_python(spark):
    """What goes to Python grows with the references, not with the text."""
    from lakewright.functions import text as tx

    plan = spark.createDataFrame([("a &amp; b",)], "t string").select(tx.clean("t").alias("x"))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sent and all(line.count("t#") == line.count("regexp_extract_all(t#") for line in sent)


ODD = [None, "", " ", "one line\n", "\n\tone", "a 1. b 2. c", "1. a\n2. b", "- a\n- \n- b", " a \n\n b\t", " x ", "x\x0b\n- y\n- z", "• a", "1) a 2) b\nc", "x\r\ny", "- - a\n- b"]


def test_lists_of_odd_texts(spark, odd):
    """Null and empty texts, white space at the ends, numbers inside of a line."""
    same(spark, odd(documents=documents(spark, ODD)), "text_to_list")


def test_bodies_of_a_folder_share_a_file(spark, odd, tmp_path):
    """As many files as folders, though each folder's texts come from many tasks; a missing text counts as none."""
    from lakewright.sources import sinks

    docs = documents(spark, [None if k == 9 else f"text {k % 150}" for k in range(400)]).repartition(8)
    same(spark, odd(documents=docs), "bodies_written")
    sinks.bodies(docs, str(tmp_path / "bodies"))
    files = list((tmp_path / "bodies").rglob("part-*.parquet"))
    assert len(files) == len({f.parent for f in files}) > 50


def test_no_task_takes_the_whole_feed(spark, odd, monkeypatch):
    """The feed lies in several files, in the order of the ids, whatever the order of the input."""
    from lakewright.sources import readers

    seen, read = [], readers.static_captures
    monkeypatch.setattr(readers, "static_captures", lambda s, path: seen.append(path) or read(s, path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = odd(documents=documents(spark, [f"{k} " * (20 + k % 90) for k in range(2000)]).orderBy(F.desc("doc_id")))
        same(spark, made, "long_captures")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(seen[0]).inputFiles()) > 1


def test_one_large_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """A file of one row group is read by one task, whatever its size says."""
    from lakewright import shared

    monkeypatch.setattr(shared, "SMALL_BYTES", 0)
    monkeypatch.setattr(shared, "TASK_BYTES", 1)
    monkeypatch.setattr(shared, "planned_bytes", lambda df: 8)
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    held = shared.rows_by_task(shared.spread(spark.read.parquet(str(tmp_path / "one")), "id"))
    assert len(held) == 8 and max(held) < 250 and sum(held) == 1000
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "eight"))
    monkeypatch.setattr(shared, "planned_bytes", lambda df: 4)
    even = spark.read.parquet(str(tmp_path / "eight"))
    assert shared.spread(even, "id") is even


def test_folds_take_no_time_of_their_own(spark):
    """Work that grew with the square of a text: 30,000 lines, and words that repeat, in one row."""
    import time

    from lakewright.functions import batches, text as tx

    rows = spark.createDataFrame([("\n".join(f"w{k % 50} " * 30 for k in range(30_000)),)], "t string")
    began = time.monotonic()
    assert rows.select(F.size(tx.chunk_blocks(F.split("t", "\n"), 40))).first()[0] == 30_000
    assert rows.select(batches.bag_recall(F.col("t"), F.col("t")).alias("x")).first().x.recall == 100
    assert time.monotonic() - began < 30


def test_evidence_as_the_patterns_say(spark, odd):
    texts = ["FEE is 20", "x@y.org https://a", "Grievance of a member; page 110001", "no fee", "valid until 2020", None, "", "Toll-free 1800 123456", "ministryx", "serviceé yojana"]
    same(spark, odd(documents=documents(spark, texts)), "null_audit")


def test_pairs_of_places_are_counted(spark):
    """Texts that have three terms 255 times each: 195,000 pairs of places a text, by distance."""
    import math
    import time

    from lakewright.operators import fulltext as ft

    said = [[j + 256 * k for j in range(1, 256)] for k in range(3)]
    rows = spark.range(3000).repartition(4).select("id", *[F.array(*[F.lit(p) for p in ps]).alias(f"p{k}") for k, ps in enumerate(said)]).cache()
    rows.count()
    began = time.monotonic()
    got = {r.x for r in rows.select(F.round(ft.all_rank([F.col(f"p{k}") for k in range(3)]), 9).alias("x")).collect()}
    assert time.monotonic() - began < 12
    left = 0.0
    for i in range(3):
        for k in range(i):
            left += sum(math.log1p(-0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30)) for d in (abs(x - y) for x in said[i] for y in said[k]))
    assert got == {round(1 - math.exp(left), 9)}
