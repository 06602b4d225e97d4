"""Labelled pages to train the extractor on, made from rules.

Each page is put together from parts of common site layouts, with and without semantic
tags; every part is known to be main text or not.  Words are random syllables, so that
only structure, names and the shape of texts can be learned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from .html_extraction import Block, blocks

SYLLABLES = "ka lo mi ren tas vo shu bel dor fin gra hel".split()
#: A character that marks the words of main text while a page is being labelled.
MARKED = "\ue000"


def _words(r: random.Random, n: int, main: bool) -> str:
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) + MARKED * main for _ in range(n)]
    made[0] = made[0].capitalize()
    for k in range(7, n - 1, 11):
        made[k] += r.choice(".,")
    return " ".join(made)


def _prose(r: random.Random, lo: int = 8, hi: int = 90) -> str:
    return _words(r, r.randint(1, 5) if r.random() < 0.12 else r.randint(lo, hi), True) + r.choice([".", ".", ".", "", "!"])


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    a = [f'<a href="/{k}">{_words(r, r.randint(1, 4), False)}</a>' for k in range(n)]
    return f"<ul>{''.join(f'<li>{x}</li>' for x in a)}</ul>" if tag == "li" else " | ".join(a)


def _named(r: random.Random, tag: str, names: str, body: str) -> str:
    name = r.choice(names.split())
    style = r.choice(["class", "id", "class"])
    return f'<{tag} {style}="{name}">{body}</{tag}>'


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, r.randint(2, 12), True)}</h1>"] if r.random() < 0.9 else []
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.62:
            body = _prose(r)
            if r.random() < 0.2:
                body += f' <a href="/x">{_words(r, r.randint(1, 4), True)}</a> ' + _prose(r, 3, 20)
            parts.append(f"<p>{body}</p>" if r.random() < 0.85 else f"<p><b>{body}<br>")
        elif kind < 0.7:
            parts.append(f"<h{r.choice('234')}>{_words(r, r.randint(1, 7), True)}</h2>")
        elif kind < 0.76:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.8:
            parts.append(f"<blockquote>{_prose(r)}</blockquote>")
        elif kind < 0.84:
            parts.append("<table>" + "".join(f"<tr><td>{_words(r, 2, True)}</td><td>{_words(r, 1, True)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.87:
            parts.append(f"<pre>{_words(r, 12, True)}</pre>")
        elif kind < 0.91:
            parts.append(_named(r, "div", "ad ads advert advertisement sponsored promo banner", _words(r, r.randint(2, 25), False) + "."))
        elif kind < 0.94:
            parts.append(_named(r, r.choice(["aside", "div"]), "related sidebar share social newsletter", _links(r, 3)))
        else:
            parts.append(f"<figure><img src=x><figcaption>{_words(r, r.randint(3, 12), True)}</figcaption></figure>")
    body = "".join(parts)
    wrap = r.random()
    if wrap < 0.5:
        return f"<article>{body}</article>"
    if wrap < 0.62:
        return f"<main>{body}</main>"
    if wrap < 0.72:
        return f"<main><article>{body}</article></main>"
    return _named(r, r.choice(["div", "section"]), "content article post entry main story body text post-content article-body entry-content main-content", body)


def _before(r: random.Random) -> list[str]:
    nav = _links(r, r.randint(3, 9), r.choice(["li", "li", "bar"]))
    return [
        x
        for chance, x in (
            (0.85, r.choice([f"<nav>{nav}</nav>", _named(r, "div", "nav menu navbar navigation topnav", nav), f"<header><nav>{nav}</nav></header>"])),
            (0.4, r.choice([f"<header><p>{_words(r, r.randint(1, 9), False)}</p></header>", _named(r, "div", "header masthead top site-header", f"<p>{_words(r, r.randint(1, 9), False)}.</p>")])),
            (0.35, _named(r, "div", "notice cookie cookies consent alert gdpr banner cookie-notice", f"<p>{_words(r, r.randint(4, 30), False)}.</p>")),
            (0.5, _named(r, "div", "ad ads advert advertisement sponsor sponsored promo", _words(r, r.randint(3, 30), False) + ".")),
            (0.2, _named(r, "div", "breadcrumb breadcrumbs", _links(r, 3, "bar"))),
            (0.15, f'<form action="/s"><label>{_words(r, 2, False)}</label><input><button>{_words(r, 1, False)}</button></form>'),
        )
        if r.random() < chance
    ]


def _after(r: random.Random) -> list[str]:
    said = "".join(_named(r, "div", "comment reply", f"<p>{_words(r, r.randint(3, 60), False)}.</p>") for _ in range(r.randint(1, 5)))
    side = r.choice([_links(r, 5), f"<h3>{_words(r, 2, False)}</h3>{_links(r, 4)}", f"<p>{_words(r, r.randint(5, 50), False)}.</p>"])
    return [
        x
        for chance, x in (
            (0.5, r.choice([f"<aside>{side}</aside>", _named(r, "div", "sidebar side widget related rail", side)])),
            (0.45, _named(r, r.choice(["section", "div"]), "comments discussion responses respond", f"<h3>{_words(r, 2, False)}</h3>{said}")),
            (0.2, f"<form><p>{_words(r, r.randint(3, 15), False)}.</p><button>{_words(r, 1, False)}</button></form>"),
            (0.25, _named(r, "div", "share social newsletter subscribe signup", f"<p>{_words(r, r.randint(2, 20), False)}.</p>")),
            (0.3, _named(r, "div", "ad ads advert advertisement sponsored promo", _words(r, r.randint(3, 30), False) + ".")),
            (0.9, r.choice([f"<footer>&copy; {_words(r, r.randint(2, 25), False)}.</footer>", f"<footer><p>{_words(r, r.randint(2, 20), False)}.</p>{_links(r, 3)}</footer>", _named(r, "div", "footer bottom copyright legal site-footer", f"<p>&copy; {_words(r, r.randint(2, 20), False)}.</p>")])),
        )
        if r.random() < chance
    ]


def page(r: random.Random) -> str:
    """A page whose words of main text carry the mark."""
    head = f"<!DOCTYPE html><html><head><title>{_words(r, 4, False)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    body = "".join(_before(r)) + _article(r) + "".join(_after(r))
    if r.random() < 0.3:
        body = _named(r, "div", "page wrapper container layout site", body)
    return head + body + ("</body></html>" if r.random() < 0.9 else "")


def labelled(n: int = 500, seed: int = 3) -> Iterator[tuple[list[Block], list[int]]]:
    """Blocks and labels of n pages; the mark is gone from the blocks."""
    r = random.Random(seed)
    for _ in range(n):
        found = blocks(page(r))
        labels = [int(MARKED in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARKED, "")
        yield found, labels
