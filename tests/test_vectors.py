"""The index of vectors against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import retrieval, vectors


def made(spark, rows, path, **kw):
    df = spark.createDataFrame(rows, "slug string, embedding array<float>")
    vectors.write(df, path, **kw)
    return df, vectors.read(spark, path)


def clustered(n, dim, groups, spread, seed):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(groups, dim))
    return mid[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))


@pytest.mark.parametrize("groups,spread", [(12, 0.3), (1, 9.0)])
def test_exact_equals_a_scan_and_recall(spark, tmp_path, groups, spread):
    own = clustered(1500, 24, groups, spread, 3)
    rows = [(f"d{i:04d}", v.tolist()) for i, v in enumerate(own)] + [("copy", own[0].tolist()), ("null", None), ("zero", [0.0] * 24)]
    df, index = made(spark, rows, str(tmp_path / "x"))
    assert index.members.count() == 1501 and index.cells.agg(F.sum("n")).first()[0] == 1501
    scan, hit, asked = df.where("slug not in ('null', 'zero')"), 0, range(0, 1500, 150)
    for i in asked:
        q = own[i].tolist()
        want = [tuple(r) for r in retrieval.vector_candidates(scan, q, 10).collect()]
        got = [tuple(r) for r in vectors.search(index, q, 10).collect()]
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-8)
        hit += len({k for k, _ in want} & {r.slug for r in vectors.search(index, q, 10, exact=False).collect()})
    assert hit >= 0.9 * 10 * len(asked)
    probes = index.cells.first().probes
    assert probes <= 8 if groups > 1 else probes < index.cells.count()


def test_radius_bounds_every_member(spark, tmp_path):
    own = clustered(400, 8, 5, 0.5, 4)
    _, index = made(spark, [(str(i), v.tolist()) for i, v in enumerate(own)], str(tmp_path / "x"), cells=7)
    cells = {r.cell: (np.array(r.center), r.radius) for r in index.cells.collect()}
    for r in index.members.collect():
        c, radius = cells[r.cell]
        v = np.array(r.embedding, float)
        assert np.arccos(np.clip(v @ c / np.linalg.norm(v) / np.linalg.norm(c), -1, 1)) <= radius + vectors.ROOM


def test_few_and_none(spark, tmp_path):
    _, one = made(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0])], str(tmp_path / "one"))
    assert [r.slug for r in vectors.search(one, [1.0, 0.1], 5).collect()] == ["a", "b"]
    _, none = made(spark, [("a", None)], str(tmp_path / "none"))
    assert vectors.search(none, [1.0, 0.1], 5).collect() == []
    _, same = made(spark, [(c, [1.0, 2.0]) for c in "edcba"], str(tmp_path / "same"), cells=3)
    assert [r.slug for r in vectors.search(same, [1.0, 2.0], 3, probes=1).collect()] == ["a", "b", "c"]
