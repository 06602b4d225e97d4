"""The Jaccard join and the passage dedup, which share their linking."""

import itertools
import random

import numpy as np
import pytest

from helpers import SMALL, norm
from lakewright.llm import jaccard_join as jj, near, shingles as sh, substring_dedup as sd
from lakewright.llm.components import components
from lakewright.llm.queries import oracle_sql, queries


def plain_set(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """(n, component) by comparing all pairs of sets."""
    sets = {k: plain_set(t) for k, t in texts.items()}
    comp = {k: k for k in texts}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {k: (len(sets[k]), root(k)) for k in texts}


def family(seed, groups=12, copies=9):
    """Texts in families of near copies at many distances, with shared passages and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = {}
    for _ in range(groups):
        base = [word() for _ in range(r.choice([1, 3, 5, 7, 12, 40, 120, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [word()] * r.randint(0, 2)
            if r.random() < 0.2:
                w += passage
            texts[len(texts)] = " ".join(x.upper() if r.random() < 0.1 else x for x in w)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_link_is_lost(spark, seed):
    texts = family(seed)
    texts |= {1000: None, 1001: "", 1002: " \n"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.components(rows).collect()}
    assert got == brute(texts)


def test_keys_collide_for_every_linked_pair():
    r = np.random.Generator(np.random.PCG64(3))
    for n in [1, 2, 3, 4, 5, 8, 9, 10, 17, 33, 64, 100, 257, 1000]:
        for _ in range(20):
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            drop = int(r.integers(0, n // 5 + 1))
            b = np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, n // 5 + 2)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if sh.similar(a, b):
                assert set(jj.keys_of(a).tolist()) & set(jj.keys_of(b).tolist())


def test_bands_hold_every_linkable_pair():
    known = jj.bands(3000)
    for x in range(1, 1200):
        y = x * 100 // 80
        assert any(lo <= x and y < end and d >= sh.distance_bound(x, y) for lo, end, d in known)


def test_sketch_bounds_the_difference():
    r = np.random.Generator(np.random.PCG64(4))
    for n in (3, 50, 700, 3000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 6], r.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        x, y = (np.frombuffer(sh.parity_sketch(s), "<u8") for s in (a, b))
        width = min(len(x), len(y))
        gap = int(np.bitwise_count(sh.fold(x, width) ^ sh.fold(y, width)).sum())
        assert gap <= len(a) + len(b) - 2 * sh.overlap(a, b)


def test_hot_group_of_near_copies(spark):
    """One large group at the threshold: components as by brute force, candidates not by the square."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(400):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts[k] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.components(rows).collect()}
    assert got == brute(texts)


def test_blocks_of_a_group_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    test_hot_group_of_near_copies(spark)


def test_query_equals_its_sql(spark, duck, small):
    found = queries()["op7_jaccard_join"](spark, SMALL).toPandas()
    assert norm(found) == norm(duck.execute(oracle_sql()["op7_jaccard_join"]).df())


def test_edges(edge, empty):
    rows = jj.components(edge).collect()
    assert len(rows) == 12
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[7] == (1, 7) and got[None] == (0, None)
    assert jj.components(empty).count() == 0
    kept = jj.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jj.keep_one(empty).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(500, 100), (7, 7)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in [100, 500, *range(101, 160)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tuning():
    bands, rows = sd.tune(0.8, 0.9995, 64)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 64
    with pytest.raises(ValueError):
        sd.tune(0.1, 0.9999, 2)


def plain_dedup(texts, min_words=sd.MIN_WORDS):
    """Lines to cut, by comparing all pairs of paragraphs."""
    lines = {}
    for k, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= min_words:
                lines[(k, i)] = line
    ids = {n: key for n, key in enumerate(sorted(lines))}
    comp = {n: c for n, (_, c) in brute({n: lines[key] for n, key in ids.items()}).items()}
    return {ids[n] for n, c in comp.items() if c != n}


@pytest.mark.parametrize("seed", [5, 6])
def test_dedup_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    shared = [[word() for _ in range(r.randint(60, 90))] for _ in range(6)]
    texts = {}
    for k in range(60):
        lines = [" ".join(word() for _ in range(r.randint(3, 60))) for _ in range(r.randint(1, 4))]
        if r.random() < 0.6:
            w = list(r.choice(shared))
            for _ in range(r.randint(0, 1)):
                w[r.randrange(len(w))] = word()
            lines.insert(r.randrange(len(lines) + 1), " ".join(w))
        texts[k] = "\n".join(lines)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in sd.deduplicate(rows, removed="cut").collect()}
    want = plain_dedup(texts)
    assert {(k, i) for k, r_ in out.items() for i in r_.cut} == want and want
    for k, t in texts.items():
        assert out[k].text == "\n".join(line for i, line in enumerate(t.split("\n")) if (k, i) not in want)


def test_dedup_query(spark, small):
    """Against brute force over the whole small table: no wanted line is left, no other is cut."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op3_substring_dedup"](spark, SMALL).collect()}
    assert {(k, i) for k, r in got.items() for i in r.removed_lines} == plain_dedup(docs)


def plain_passages(texts, size=sd.PASSAGE):
    """Words to cut, by looking up all windows."""
    import re

    first, gone = {}, set()
    for k in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[k] or ""))
        for i in range(len(w) - size + 1):
            d, at = first.setdefault(tuple(w[i : i + size]), (k, i))
            if d != k or i >= at + size:
                gone |= {(k, x) for x in range(i, i + size)}
    return gone


def test_passages_in_long_and_over_short_lines(spark):
    r = random.Random(8)
    words = lambda n: ["".join(r.choice("abcdéfgh") for _ in range(5)) for _ in range(n)]
    planted = [words(n) for n in (51, 55, 60)]
    lines = lambda w: "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7))
    texts, want = {}, {}
    for k, p in enumerate(planted):
        for at, shape in enumerate((" ".join, " ".join, lines, lines)):
            before, behind = " ".join(words(r.randint(80, 120))), " ".join(words(r.randint(80, 120)))
            texts[10 * k + at] = f"{before} {shape(p)} {behind}"
            want[10 * k + at] = texts[10 * k + at] if at == 0 else f"{before} {behind}"
    again = words(60)
    texts[90], want[90] = " ".join(again * 3), " ".join(again) + " "  # within one text
    texts[91] = want[91] = " ".join(words(2) + planted[0][:49] + words(2))  # too short a passage
    texts[92], want[92] = "\n".join([" ".join(words(30)), lines(planted[2]), "End  here."]), None
    want[92] = texts[92].split("\n")[0] + "\n\nEnd  here."
    rows = [*texts.items(), (None, texts[0])]
    got = sd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r_.doc_id: r_.text for r_ in got} == want | {None: texts[0]}


def test_passages_of_the_small_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lines = plain_dedup(docs)
    left = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in lines) for k, t in docs.items()}
    gone = plain_passages(left)
    want = {k: [w for i, w in enumerate(t.split()) if (k, i) not in gone] for k, t in left.items()}
    got = {r.doc_id: r.text.split() for r in queries()["op3_substring_dedup"](spark, SMALL).collect()}
    assert got == want and len({k for k, _ in gone}) > 10


def test_dedup_edges(spark, edge, empty):
    got = sd.deduplicate(edge, removed="shard")
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 12 and rows[1].shard == [] and rows[2].text == "" and rows[3].text is None
    assert rows[None].shard == [] and rows[6].text == edge.where("doc_id = 6").first().text
    assert sd.deduplicate(empty).count() == 0
    twice = spark.createDataFrame([(1, "p " + " ".join(f"w{k}" for k in range(60)))] * 2, "doc_id long, text string")
    assert all(r.text for r in sd.deduplicate(twice).collect())


def test_signatures_are_whole(monkeypatch):
    h = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 12_000, dtype=np.uint64)
    starts = np.array([0, 10, 9000, 9500])
    got = sd.signatures(h, starts, 8)
    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(h)])):
        assert (got[k] == (h[lo:hi, None] * sd._FACTOR[:8] + sd._SHIFT[:8]).min(axis=0)).all()


@pytest.mark.parametrize("seed, pairs", [(11, 0), (12, 2)])
def test_one_group_of_all(spark, monkeypatch, seed, pairs):
    """All texts share one key: blocks that name their group again, split by members and by shingles, lose no link."""
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(near, "BLOCK", 40)
    monkeypatch.setattr(near, "PAIRS", pairs)
    called = []
    spanning = near._spanning

    def counted(*args):
        links = spanning(*args)
        called.append(links.count())
        return links

    monkeypatch.setattr(near, "_spanning", counted)
    texts = {k + 5: t for k, t in family(seed).items()} | {1: "quite another text of a few words"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    met = [(near.STAR, 1, k) for k in texts if k != 1] + [(near.GROUP, 7, k) for k in texts]
    comps = near.link(spark.createDataFrame(met, near.MET_DDL), lambda ids: docs.join(ids, "id", "left_semi"))
    got = {k: k for k in texts} | {r.id: r.comp for r in comps.collect()}
    assert got == {k: c for k, (_, c) in brute(texts).items()}
    assert bool(called) == (pairs == 0) and sum(called) < len(texts) * 8


def test_open_group_of_twenty_thousand(spark):
    """All share a passage, few are near copies: rows stay within a few for each member, no link is lost."""
    r = random.Random(21)
    passage = [f"p{k}" for k in range(24)]
    texts, want = {}, {}
    for k in range(20_000):
        if k % 10 == 1:
            texts[k] = texts[k - 1] + " more"
            want[k] = k - 1
        else:
            texts[k] = " ".join(passage + [f"y{r.randrange(10**9)}" for _ in range(9)])
            want[k] = k
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    assert {r_.doc_id: r_.component_id for r_ in jj.components(rows).collect()} == want


def test_likely_pairs_are_no_more_than_a_few_a_member(spark):
    """A group in which every pair passes the sketches yields rows in proportion to its members."""
    r = np.random.Generator(np.random.PCG64(6))
    base = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
    n = 1500
    rows = []
    for k in range(n):
        s = np.unique(np.concatenate([base[: 180], r.integers(0, 2**63, 22, dtype=np.uint64)]))
        rows.append((k, len(s), bytearray(sh.parity_sketch(s))))
    sketches = spark.createDataFrame(rows, "id long, n int, sketch binary")
    groups = spark.range(n).selectExpr("7L AS a", "id AS b")
    none = spark.createDataFrame([], "id long, comp long")
    found = near._likely(groups, none, sketches, 80)
    assert found.where("kind = 1").count() >= 1 and n // 2 <= found.where("kind = 0").count() <= 2 * n
