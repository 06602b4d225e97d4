"""English stemming by the published Porter2 rules, and stop words.

Python works on distinct words: a full-text index stems its vocabulary, not its texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .text import STRING, STRINGS

# --- Fixed values: the stop words of an English text search. ---
STOP = frozenset(
    (
        "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
        "herself it its itself they them their theirs themselves what which who whom this that these those am is "
        "are was were be been being have has had having do does did doing a an the and but if or because as until "
        "while of at by for with about against between into through during before after above below to from up "
        "down in out on off over under again further then once here there when where why how all any both each few "
        "more most other some such no nor not only own same so than too very s t can will just don should now"
    ).split()
)
# --- End of fixed values. ---
V = "[aeiouy]"
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Published exceptions: whole words with their stems, and words left as they are.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    m = re.match("gener|commun|arsen", w) or re.match(f".*?{V}[^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.match(f".*?{V}[^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("ie[ds]$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("[us]s$", w) and re.search(f"{V}.+s$", w):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # 1b: past and progressive forms
    m = re.search("(eedly|eed)$", w)
    if m:
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(V, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c: a final y after a consonant that is not the first letter
    if len(w) > 2 and re.search("[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    for ends, left in STEP2:
        if w.endswith(ends):
            if len(w) - len(ends) >= r1:
                w = w[: -len(ends)] + left
            break
    else:
        if w.endswith("logi") and len(w) - 3 >= r1:
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for ends, left in STEP3:
        if w.endswith(ends):
            if len(w) - len(ends) >= r1:
                w = w[: -len(ends)] + left
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for ends in STEP4:
        if w.endswith(ends):
            if len(w) - len(ends) >= r2:
                w = w[: -len(ends)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(words: Column) -> Column:
    """Stems of an array of words, in order."""

    @pandas_udf(STRINGS)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [stem(w) for w in v])

    return run(words)


def lexeme_of(word: str) -> str | None:
    """The stem of a word in lower case, None for a stop word."""
    return None if word in STOP else stem(word)


@pandas_udf(STRING)
def lexeme(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else lexeme_of(w))
