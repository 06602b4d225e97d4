"""HTML main text by a linear-chain conditional random field over leaf blocks.

A tolerant scan of the markup yields the page's leaf blocks: runs of text between
block-level tags, each with the tags, classes and ids of its ancestors.  A block is
described by those ancestors, its own tag, its place, length, link share and
punctuation.  A conditional random field with two labels, main text or not, scores a
page's sequence of blocks; it is trained by gradient steps on the exact likelihood
over labelled pages (html_pages.labelled), and decoded by Viterbi.  The blocks decoded
as main text are joined by one space.

Text of scripts, styles, templates, comments and titles never makes a block.

The scan reads a page once, whatever its markup: what is looked for and not found is
not looked for again, and open elements are found by their names, not by search.  Of
the names around a block the NAMES nearest count as features.

Defined cases: null or empty html gives an empty text; broken nesting and unclosed
tags are read as far as they go; a tag whose quotes do not close ends at the next >;
a < without any > behind it is text; character references are decoded, those of
numbers beyond Unicode as U+FFFD, and runs of white space, line breaks among them, are
one space; equal pages give equal texts; extra columns pass through, a column named
like the result is replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import arrow_schema, slices, small_batches

OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
SPECIAL = re.compile("[>\"']")
LEADING = re.compile(r"&#0+(?=[0-9])")
BEYOND = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|[1-9][0-9]{7,});?")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template title noscript textarea select option svg iframe object canvas head".split())
RAW = frozenset("script style textarea title template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag closes these, up to the nearest of the second set.
CLOSES = {
    "p": ("p", "body article section div main aside td th li blockquote"),
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table thead tbody tfoot"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Names around a block that count as its features, the nearest ones.
NAMES = 128


class Block:
    __slots__ = ("text", "tag", "above", "linked")

    def __init__(self, text: str, tag: str, above: tuple, linked: float):
        self.text, self.tag, self.above, self.linked = text, tag, above, linked


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the ancestors of its blocks."""
    found = [f"<{tag}>"]
    for m in NAMED.finditer(attributes):
        found += [f".{w}" for w in PART.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(dict.fromkeys(found))


_short_names = lru_cache(4096)(_names)


class _Tags:
    """The markup of one page, found from left to right."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # places outside of quotes from which an unclosed one is met

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at `at`; there is a > behind."""
        page, k, seen = self.page, at, []
        while k not in self.dead:
            m = SPECIAL.search(page, k)
            c = m and m[0]
            if c == ">":
                return m.start()
            if not c or m.start() >= self.last[c]:
                break
            k = page.find(c, m.end()) + 1
            seen.append(k)
        self.dead.update(seen)
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next markup; comments and declarations have no name."""
        page = self.page
        while m := OPEN.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(page), "", "", ""
            if m.end() > self.last[">"]:  # no tag ends behind this: comments are all that can follow
                at = page.find("<!--", m.start() + 1)
                if at < 0:
                    return None
                continue
            if m[3] is None:
                return m.start(), page.find(">", m.end()) + 1, "", "", ""
            end = self._end(m.end())
            return m.start(), end + 1, m[2], m[3].lower(), page[m.end() : end]
        return None

    def close(self, tag: str, at: int) -> int:
        """Where the closing tag of a raw element begins, or the end of the page."""
        m = _closing(tag).search(self.page, at)
        return m.start() if m and m.end() <= self.last[">"] else len(self.page)


@lru_cache(16)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b", re.I)


class _Open:
    """The open elements, with where those of each name lie."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.count: dict[str, int] = {}  # names around, in the order in which they came
        self.blocks: list[str] = []  # tags that are not inline
        self.silent = self.links = 0
        self.above: tuple[str, ...] | None = ()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names))
        for n in names:
            if n not in self.count:
                self.count[n], self.above = 0, None
            self.count[n] += 1
        if tag not in INLINE:
            self.blocks.append(tag)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag, names = self.stack.pop()
            self.places[tag].pop()
            for n in names:
                self.count[n] -= 1
                if not self.count[n]:
                    del self.count[n]
                    self.above = None
            if tag not in INLINE:
                self.blocks.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def names(self) -> tuple[str, ...]:
        if self.above is None:
            nearest = list(islice(reversed(self.count), NAMES))
            self.above = tuple(reversed(nearest))
        return self.above


def decoded(text: str) -> str:
    """Character references decoded; the library refuses numbers of thousands of digits."""
    if "&#" in text:
        text = BEYOND.sub("\ufffd", LEADING.sub("&#", text))
    return html_lib.unescape(text)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    page = page or ""
    tags, held = _Tags(page), _Open()
    pieces: list[str] = []
    linked = 0

    def close_block():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, held.blocks[-1] if held.blocks else "", held.names(), min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if text and not held.silent:
            if "&" in text:
                text = decoded(text)
            pieces.append(text)
            if held.links:
                linked += len(text.strip())

    at = 0
    while found := tags.next(at):
        start, end, slash, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                continue
            if tag not in INLINE:
                close_block()
            if (k := held.last((tag,))) >= 0:
                held.pop_to(k)
            continue
        if tag not in INLINE:
            close_block()
            if tag in P_ENDS or tag in CLOSES:
                ends, walls = CLOSES.get(tag, CLOSES["p"])
                if (k := held.last(ends)) >= 0 and k >= held.last(walls):
                    held.pop_to(k)
        elif tag == "br":
            if not held.silent:
                pieces.append(" ")
        if tag in VOID or attributes.endswith("/") and tag == "path":
            continue
        if tag == "body":  # whatever the head left open
            held.pop_to(0)
        held.push(tag, (_short_names if len(attributes) < 512 else _names)(tag, attributes))
        if tag in RAW:
            at = tags.close(tag, at)
    add(page[at:])
    close_block()
    return out


BITS = 14


def _place(name: str) -> int:
    h = 2_166_136_261
    for c in name.encode():
        h = (h ^ c) * 16_777_619 & 0xFFFFFFFF
    return (h ^ (h >> 15)) & ((1 << BITS) - 1)


_place = lru_cache(65_536)(_place)


def describe(page_blocks: list[Block]) -> list[list[int]]:
    """Feature places of each block."""
    n, out = len(page_blocks), []
    for k, b in enumerate(page_blocks):
        words = b.text.count(" ") + 1
        names = [*b.above, f"own {b.tag}", "bias"]
        size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 60 else 4
        names.append(f"size {size}")
        names.append(f"links {int(4 * b.linked)}")
        names.append(f"size {size} links {b.linked > 0.5}")
        names.append(f"end {b.text[-1] in '.!?:”»…'}")
        names.append(f"place {min(3, 4 * k // n)}")
        if "©" in b.text or "cookie" in b.text.lower():
            names.append("legal")
        out.append([_place(x) for x in names])
    return out


class Crf:
    """Weights [feature, label] and transitions [label, label]; label 1 is main text."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.weights = np.zeros((1 << BITS, 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps

    def emissions(self, described: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(f) for f in described])
        starts = np.r_[0, np.cumsum([len(f) for f in described])[:-1]]
        return np.add.reduceat(self.weights[flat], starts, axis=0)

    def viterbi(self, described: list[list[int]]) -> list[int]:
        """The most probable labels of a page's blocks."""
        e = self.emissions(described).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        x, y = e[0]
        back = []
        for u, v in e[1:]:
            to0, to1 = y + s10 > x + s00, y + s11 > x + s01
            back.append((to0, to1))
            x, y = (y + s10 if to0 else x + s00) + u, (y + s11 if to1 else x + s01) + v
        label = int(y > x)
        out = [label]
        for to in reversed(back):
            label = int(to[label])
            out.append(label)
        return out[::-1]

    def marginals(self, described: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels by block, and of label pairs summed over neighbours."""
        e, s = self.emissions(described), self.steps
        n = len(e)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = e[0]
        for k in range(1, n):
            ahead[k] = e[k] + np.logaddexp(ahead[k - 1][0] + s[0], ahead[k - 1][1] + s[1])
        for k in range(n - 2, -1, -1):
            to = s + e[k + 1] + behind[k + 1]
            behind[k] = np.logaddexp(to[:, 0], to[:, 1])
        total = np.logaddexp(*ahead[-1])
        single = np.exp(ahead + behind - total)
        double = np.zeros((2, 2))
        for k in range(1, n):
            double += np.exp(ahead[k - 1][:, None] + s + e[k] + behind[k] - total)
        return single, double

    def learn(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> "Crf":
        """Adaptive gradient ascent on the likelihood of labelled pages."""
        seen, seen_steps = np.full(self.weights.shape, 1e-8), np.full((2, 2), 1e-8)
        order = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for p in order.permutation(len(pages)):
                described, labels = pages[p]
                single, double = self.marginals(described)
                gap = np.eye(2)[labels] - single
                flat = np.concatenate([np.asarray(f) for f in described])
                at, inverse = np.unique(flat, return_inverse=True)
                g = np.zeros((len(at), 2))
                np.add.at(g, inverse, np.repeat(gap, [len(f) for f in described], axis=0))
                g -= decay * self.weights[at]
                seen[at] += g * g
                self.weights[at] += rate * g / np.sqrt(seen[at])
                true = np.zeros((2, 2))
                np.add.at(true, (labels[:-1], labels[1:]), 1)
                g = true - double - decay * self.steps
                seen_steps += g * g
                self.steps = self.steps + rate * g / np.sqrt(seen_steps)
        return self


@lru_cache(1)
def trained() -> Crf:
    """The field trained on the labelled pages."""
    from .html_pages import labelled

    return Crf().learn([(describe(b), labels) for b, labels in labelled()])


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, label in zip(found, crf.viterbi(describe(found))) if label)


def extract(df: DataFrame, html: str = "html", text: str = "text", crf: Crf | None = None) -> DataFrame:
    """df with the main text of each page."""
    small_batches(df.sparkSession)
    crf = crf or trained()
    rest = [f for f in df.schema.fields if f.name != text]
    schema = StructType(rest + [StructField(text, StringType())])
    out = arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast((crf.weights, crf.steps))  # 2**BITS x 2 doubles

    def run(batches):
        field = Crf(*sent.value)
        for batch in slices(batches):
            texts = [main_text(p, field) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(out.field(f.name).type) for f in rest] + [pa.array(texts, pa.string())], schema=out)

    return df.select([F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)
