import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import SMALL, norm
from lakewright.llm import mixing
from lakewright.llm.queries import oracle_sql, queries


def sources(spark, sizes):
    rows = [(i * 1000 + k, "w " * 5, s) for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repeat_limit(spark):
    docs = sources(spark, {"big": 400, "mid": 100, "small": 40})
    got = mixing.mix(docs, mixing.Target(repeats=2.0), seed=1)
    copies = defaultdict(list)
    for r in got.collect():
        copies[r.source].append(r.n_copies)
    assert len(copies["big"]) == 400 and set(copies["big"]) == {1}
    assert all(c >= 1 for x in copies.values() for c in x)  # none is dropped
    assert sum(copies["small"]) / 40 <= 2.0 + 1e-9 and sum(copies["small"]) / 40 > 1.85
    alpha = 1 - math.log(2) / math.log(10)
    want = 100 * (400 / 100) ** (1 - alpha)
    assert abs(sum(copies["mid"]) - want) <= 4  # blocks are whole


def test_entropy(spark):
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source string, share double")
    entropy = lambda a: -sum(p * math.log(p) for p in [x**a / sum(y**a for y in (0.7, 0.2, 0.1)) for x in (0.7, 0.2, 0.1)])
    a = mixing.bisect_exponent(shares, mixing.Target(entropy=1.0))
    assert abs(entropy(a) - 1.0) < 1e-4
    assert mixing.bisect_exponent(shares, mixing.Target(entropy=0.1)) == 1.0
    assert mixing.bisect_exponent(shares, mixing.Target(entropy=9.0)) == 0.0


def test_budget_and_permutation(spark):
    docs = sources(spark, {"a": 300, "b": 300})
    got = mixing.mix(docs, mixing.Target(repeats=1.5), budget=1500.0, seed=3).collect()  # half of all tokens
    kept = Counter(r.source for r in got if r.n_copies)
    assert all(120 <= kept[s] <= 150 for s in "ab")
    places = mixing.permuted(F.col("block"), F.lit("a"), 3)
    assert spark.range(mixing.BLOCKS).select(F.col("id").alias("block")).select(places).distinct().count() == mixing.BLOCKS


def test_edges(edge, empty):
    got = mixing.mix(edge, mixing.Target(repeats=2.0))
    rows = got.collect()
    assert len(rows) == 12 and all(r.n_copies >= 1 and r.weight is not None for r in rows)
    assert len({(r.block, r.n_copies) for r in rows if r.doc_id == 2}) == 1
    assert mixing.repeat(got, edge.columns).columns == edge.columns
    assert mixing.mix(empty, mixing.Target(repeats=2.0)).count() == 0


def test_query_equals_its_sql(spark, duck, small):
    found = queries()["op2_mixing"](spark, SMALL).toPandas()
    assert norm(found) == norm(duck.execute(oracle_sql()["op2_mixing"]).df())


def test_native(spark, small):
    plan = queries()["op2_mixing"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("n", [1, 2])
def test_one_source(spark, n):
    assert {r.n_copies for r in mixing.mix(sources(spark, {"a": 5} if n == 1 else {"a": 5, "b": 5}), mixing.Target(repeats=2.0)).collect()} == {1}
