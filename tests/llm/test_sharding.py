from collections import Counter

import pytest

from helpers import SMALL, norm
from lakewright.llm import sharding
from lakewright.llm.queries import oracle_sql, queries


def plain_fill(shards, size):
    """Every shard's whole preference list, then turns."""
    orders = [[(sharding._hash(s, "offset") + j * (sharding._hash(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner, at = {}, [0] * len(shards)
    while len(owner) < size:
        for k, order in enumerate(orders):
            while order[at[k]] in owner:
                at[k] += 1
            owner[order[at[k]]] = k
            if len(owner) == size:
                break
    return [owner[i] for i in range(size)]


def test_fill():
    shards = [f"s{i}" for i in range(7)]
    assert sharding.fill(shards, 101) == plain_fill(shards, 101)
    load = Counter(sharding.fill(sharding.SHARDS))
    assert max(load.values()) - min(load.values()) <= 1


def test_little_moves_when_a_shard_leaves():
    shards = [f"s{i}" for i in range(20)]
    a, b = sharding.fill(shards, 10_007), sharding.fill(shards[:-1], 10_007)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved / 10_007 < 0.2


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_arguments(shards, size):
    with pytest.raises(ValueError):
        sharding.fill(shards, size)


def test_edges(edge, empty, spark, tmp_path):
    rows = sharding.place(edge).collect()
    assert len(rows) == 12 and all(r.shard in sharding.SHARDS and 0 <= r.slot < sharding.SIZE for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 2}) == 1
    assert sharding.place(empty).count() == 0
    sharding.write(edge, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_query_equals_its_sql(spark, duck, small):
    assert norm(queries()["op4_sharding"](spark, SMALL).toPandas()) == norm(duck.execute(oracle_sql()["op4_sharding"]).df())
