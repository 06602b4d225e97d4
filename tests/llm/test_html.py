import html
import re
import time

import numpy as np
import pytest

from helpers import SMALL
from lakewright.llm import html_extraction as he, html_pages
from lakewright.llm.queries import queries

BODY = "Long running prose that tells of many things, at some length, so that it reads as text. " * 2


def text(page):
    return he.main_text(page, he.trained())


def test_held_out_pages():
    right = total = 0
    for b, labels in html_pages.labelled(150, seed=77):
        got = he.trained().viterbi(he.describe(b))
        right += sum(x == y for x, y in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_and_marginals_against_all_paths():
    import itertools

    r = np.random.Generator(np.random.PCG64(1))
    crf = he.Crf(r.normal(size=(1 << he.BITS, 2)), r.normal(size=(2, 2)))
    described = [[int(x) for x in r.integers(0, 1 << he.BITS, 4)] for _ in range(7)]
    e = crf.emissions(described)
    score = lambda y: sum(e[k][v] for k, v in enumerate(y)) + sum(crf.steps[a][b] for a, b in zip(y, y[1:]))
    paths = list(itertools.product((0, 1), repeat=7))
    assert tuple(crf.viterbi(described)) == max(paths, key=score)
    weight = np.exp([score(y) for y in paths])
    single, double = crf.marginals(described)
    for k in range(7):
        assert np.isclose(single[k, 1], sum(w for y, w in zip(paths, weight) if y[k]) / weight.sum())
    assert np.isclose(double[0, 1], sum(w * sum(a == 0 and b == 1 for a, b in zip(y, y[1:])) for y, w in zip(paths, weight)) / weight.sum())


def test_layouts():
    furniture = "<header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>"
    after = "<aside><h3>Related</h3><ul><li><a href=/c>Other</a></li></ul></aside><section class=comments><div class=comment><p>I liked this a lot, thanks for it.</p></div></section><form><label>Mail</label><input><button>Go</button></form><footer>&copy; Somebody. All rights.</footer>"
    notice = '<div class="cookie-notice"><p>We use cookies to improve things.</p></div>'
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<main><article>", "</article></main>")):
        page = f"<html><head><title>No</title><script>var a='<p>no</p>'</script></head><body>{notice}{furniture}{open_}<h1>The Title</h1><p>{BODY}</p><p>A &amp; B&nbsp;<b>c</b><br>d</p>{close}{after}</body></html>"
        assert text(page) == f"The Title {BODY.strip()} A & B c d", open_


def test_broken_markup():
    assert text(None) == "" and text("") == "" and text("<") in ("", "<")
    assert "prose" in text(f"<article><p><b>{BODY}<br><p>{BODY}")
    for bad in ("<p title=\"x>never closed", "</p></p></div>", "<!-- open", "<script>open", "<a" * 2000, "&#xZZ; &bogus; &#0;", "<p>" * 3000 + "x"):
        assert isinstance(text(bad), str)
    assert [b.text for b in he.blocks("<p>a <span>b</span>\n c</p>d<br>e<td>f")] == ["a b c", "d e", "f"]


def test_query(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries()["op10_html_extraction"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == " ".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, None, "own"), (1, "u", "", "own"), (2, "u", f"<article><p>{BODY}</p></article>", None), (3, "u", "<article><p>" + "word " * 200_000 + "</p></article>", None)], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.text for r in he.extract(rows).collect()}
    assert got[(1, None)] == "" and got[(2, "u")] == BODY.strip() and len(got[(3, "u")]) == 999_999
    assert he.extract(rows.limit(0)).count() == 0


def test_late_mark_of_a_notice():
    """A block that names cookies late carries the same evidence as one that does so at once."""
    late, never = (he.Block(f"{BODY * 3}{x} are used here.", "p", (), 0.0) for x in ("Cookies", "Rivers"))
    assert len(BODY * 3) > 200
    (a,), (b,) = he.describe([late]), he.describe([never])
    assert set(a) - set(b) == {he._place("legal")}


MARKS = ['<a "', "<!-", "<div>x", "<h1>x", "</x>", "<b>", "<script>", '<a ">" ', "<a '\">", "<p><b>x", "<li>x", '<a href="', "<a b='\">'", "</script", "<!--", "&#9"]


@pytest.mark.parametrize("mark", MARKS)
def test_a_page_is_scanned_once(mark):
    """A megabyte of any mark takes seconds, alone, in a script, and with a quote left open at its end."""
    page = mark * (1_000_000 // len(mark))
    for p in (page, "<script>" + page, page + ">'"):
        began = time.process_time()
        text(p)
        assert time.process_time() - began < 10


def test_long_references_and_open_quotes():
    at = lambda p: [b.text for b in he.blocks(p)]
    assert at("<p>a&#" + "9" * 5000 + ";b") == ["a\ufffdb"] and at("<p>&#" + "0" * 5000 + "65;") == ["A"] and at("<p>&#x41;&#xFFFFFFFF;") == ["A\ufffd"]
    assert at("<p title=\"x>inside</p><p>next</p>") == ["inside", "next"]
    assert at("<p title='a>b'>c<i id=\"d>e\">f</i>") == ["cf"]


def test_nearest_names_count():
    deep = "".join(f"<div class={chr(97 + k // 26)}{chr(97 + k % 26)}z>" for k in range(300)) + "x"
    (b,) = he.blocks(deep)
    assert len(b.above) == he.NAMES and b.above[-1] == ".lnz"
    (b,) = he.blocks("<div class='a b'><section id=a><p>x")
    assert b.above == ("<div>", ".a", ".b", "<section>", "<p>")
