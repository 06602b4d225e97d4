import re
from collections import Counter

import pytest

from helpers import SMALL, norm
from pyspark.sql import functions as F

from lakewright.llm import host_rules as hr
from lakewright.llm.queries import oracle_sql, queries


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_against_plain(spark, small, edge):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(edge.select("doc_id", "text")).unionByName(spark.createDataFrame([(90, "a b a b a b a"), (91, "x\ny\nx\n\n \nx"), (92, "a b")], docs.schema))
    for r in hr.measure(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.doc_id


def test_shrinkage(spark):
    rows = [(h, w) for h, n, bad in (("good", 200, 2), ("bad", 200, 190), ("tiny", 1, 1)) for w in [10] * bad + [100] * (n - bad)]
    measured = spark.createDataFrame(rows, "source string, n_words long").selectExpr("*", "0L AS n_repeat_words", "0L AS n_symbols", "500L AS word_chars", "0L AS n_dup_lines", "1L AS n_lines")
    rules = {"base": hr.RULES["base"]}
    got = {r.host: r for r in hr.shrunk_hosts(measured, rules=rules).collect()}
    assert got["bad"].rejected and not got["good"].rejected
    m = 193 / 401
    rates = [2 / 200, 190 / 200, 1.0]
    var = sum((x - sum(rates) / 3) ** 2 for x in rates) / 3
    between = var - m * (1 - m) * (1 / 200 + 1 / 200 + 1) / 3
    strength = max(m * (1 - m) / between - 1, 1.0) if between > 1e-12 else 1.0
    assert abs(got["tiny"].rate_base - (1 + m * strength) / (1 + strength)) < 1e-9
    assert got["tiny"].rate_base < 1.0  # one document does not condemn a host


def test_edges(edge, empty):
    got = hr.judge(edge)
    rows = got.collect()
    assert len(rows) == 12 and all(r.base_failed for r in rows if r.doc_id in (3, 4, 5, 8))
    assert not any(r.kept and r.base_failed for r in rows)
    assert hr.judge(empty).count() == 0
    assert hr.judge(edge.withColumn("n_words", F.lit("own")), keep=("doc_id", "shard")).count() == 12


def test_query_equals_its_sql(spark, duck, small):
    assert norm(queries()["op6_host_rules"](spark, SMALL).toPandas()) == norm(duck.execute(oracle_sql()["op6_host_rules"]).df())


def test_native(spark, small):
    plan = queries()["op6_host_rules"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def hosts_table(spark, path, bad):
    """Twelve hosts of 50 documents; of host 0 `bad` have symbols, of the others two."""
    rows = []
    for h in range(12):
        for k in range(50):
            w = [f"word{h}x{k}x{i}" for i in range(60)]
            rows.append((h * 50 + k, " ".join(w) + (" #" * 20 if k < (bad if h == 0 else 2) else ""), f"host{h}"))
    rows += [(1000, None, None), (1001, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("bad, rejected", [(22, {"host0"}), (2, set())])
def test_production_settings_reject_a_bad_host(spark, tmp_path, bad, rejected):
    import duckdb

    hosts_table(spark, str(tmp_path), bad)
    found = queries()["op6_host_rules"](spark, str(tmp_path)).toPandas()
    host = lambda i: f"host{i // 50}"
    clean = found[~found.base_failed]
    assert {host(i) for i in clean[~clean.kept].doc_id} == rejected and len(clean) == 600
    assert all(len(clean[(clean.doc_id // 50 == int(h[4:])) & clean.kept]) == 0 for h in rejected)  # every document of it
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert norm(found) == norm(c.execute(oracle_sql()["op6_host_rules"]).df())


def test_like_hosts_have_the_corpus_rate(spark):
    rows = [(h, w) for h in "abc" for w in [10] * 20 + [100] * 30]
    measured = spark.createDataFrame(rows, "source string, n_words long").selectExpr("*", "0L AS n_repeat_words", "0L AS n_symbols", "500L AS word_chars", "0L AS n_dup_lines", "1L AS n_lines")
    got = hr.shrunk_hosts(measured, rules={"base": hr.RULES["base"]}).collect()
    assert all(abs(r.rate_base - 0.4) < 1e-9 and not r.rejected for r in got) and len(got) == 3
