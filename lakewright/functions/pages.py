"""Text of a page's document tree: hidden text included, block boundaries kept, tables as markdown.

Parsing has no built-in form; pages go to Python in Arrow batches, each once.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from .text import STRING, col

# --- Fixed values: elements that break lines, that have no text, and that frame a page. ---
BLOCK = frozenset(
    (
        "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr li main nav ol p pre section table td tfoot th thead tr ul"
    ).split()
)
SILENT = frozenset("script style noscript svg iframe canvas template".split())
CHROME = frozenset("header footer nav aside form".split())
# --- End of fixed values. ---
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """Pieces of text and line breaks of the main element, or of the body without one."""

    def __init__(self, skipped: frozenset[str] = SILENT, markdown: bool = False):
        super().__init__(convert_charrefs=True)
        self.skipped, self.markdown = skipped | {"head"}, markdown
        self.out: list[str] = []
        self.hidden, self.depth = "", 0  # the element that is passed over, and how deep it nests in itself
        self.main, self.done = 0, False
        self.rows: list[list[list[str]]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            self.depth += tag == self.hidden
            return
        if tag in self.skipped or ("aria-hidden", "true") in attrs:
            if tag not in VOID:
                self.hidden, self.depth = tag, 1
            return
        if tag == "main" and not self.done:
            if not self.main:
                self.out.clear()
            self.main += 1
        if self.markdown and tag == "table":
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append([])
        elif tag in BLOCK:
            self._say("\n" * (2 if tag in VOID else 1))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            self.depth -= tag == self.hidden
            if not self.depth:
                self.hidden = ""
            return
        if tag == "table" and self.rows is not None:
            rows = [["".join(cell).split() for cell in r] for r in self.rows if r]
            lines = ["| " + " | ".join(" ".join(c) for c in r) + " |" for r in rows]
            if lines:
                lines.insert(1, "|" + "---|" * len(rows[0]))
            self.rows = None
            self._say("\n\n" + "\n".join(lines) + "\n\n")
        elif tag in BLOCK and tag not in VOID:
            self._say("\n")
        if tag == "main" and self.main:
            self.main -= 1
            self.done = self.done or not self.main

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            text = re.sub(r"\s+", " ", data)
            if text.strip():
                self._say(text)

    def _say(self, text: str) -> None:
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1].append(text)
        elif not self.done:
            self.out.append(text)

    def text(self) -> str:
        self.close()
        joined = re.sub(r"[ \t]+", " ", "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", joined)).strip()


def tree_text(page: str | None, skipped: frozenset[str] = SILENT, markdown: bool = False) -> str | None:
    if page is None:
        return None
    tree = Tree(skipped, markdown)
    tree.feed(page)
    return tree.text()


@pandas_udf(STRING)
def dom_text(pages: pd.Series) -> pd.Series:
    """All text of a page in the order of its tree, what is folded away included; scripts and aria-hidden parts are not."""
    return pages.map(tree_text)


@pandas_udf(STRING)
def main_text(pages: pd.Series) -> pd.Series:
    """Text without the page's frame, its tables as markdown blocks."""
    return pages.map(lambda p: tree_text(p, SILENT | CHROME, True))


def markdown_tables(text: Column | str) -> Column:
    """The blocks of a text that are tables: four bars or more, over more than one line."""
    return F.filter(F.split(col(text), r"\n{2,}"), lambda b: (F.regexp_count(b, F.lit(r"\|")) >= 4) & b.contains("\n"))
