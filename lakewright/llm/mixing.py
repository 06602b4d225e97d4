"""Mixing sources to target weights, in DataFrame functions only.

A source with share p of all tokens gets weight p**a / sum of p**a.  The exponent a is
bisected between 0 (equal weights) and 1 (as found) until the weights reach a target
entropy, or until no source is repeated more than a limit.  The weights are realised
as a budget of tokens: a source of t tokens and weight w gets w * budget / t epochs.
Whole epochs are whole copies; the rest is taken in blocks.  The documents of a source
lie in BLOCKS blocks by a hash of their id, the blocks are put in a seeded
permutation, and the first blocks whose tokens together fit the rest of the budget are
taken once more.

With no budget given it is the least that keeps every document at least once, so no
source is cut: mixing then only repeats.

Defined cases: a null source is a source of its own, null texts have no tokens,
sources without tokens get weight 0 and one copy of each document, an empty table
gives an empty plan.  Rows of equal doc_id fall into the same block.  Columns named
weight, block, place or n_copies (or as `names` calls them) are replaced, others pass
through, whatever their names.

Scale: one pass over the texts counts tokens; sums by source and block combine before
the shuffle and have at most BLOCKS rows a source, and those alone are ordered in
windows by source.  A step of the bisection is an aggregation over the sources; only
scalars reach the driver.  Rows carry no text; the plan of a source is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import WORD, bounded_broadcast, cut, own_name

BLOCKS = 1024
FEW_SOURCES = 50_000
#: Depth of the bisection tree whose inner nodes one aggregation evaluates, and rounds.
DEPTH, ROUNDS = 4, 6


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for: one of the two."""

    entropy: float | None = None  #: nats
    repeats: float | None = None  #: epochs of the most repeated source over those of the least


def tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def block_of(doc_id: Column) -> Column:
    """Block of a document: the first seven hex digits of the id's md5, modulo BLOCKS."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % BLOCKS).cast("int")


def permuted(block: Column, source: Column, seed: int) -> Column:
    """Place of a block in its source's permutation: an odd multiplier is a bijection modulo 2**10."""
    digest = F.md5(F.concat(F.coalesce(source.cast("string"), F.lit("\0")), F.lit(f"/{seed}")).cast("binary"))
    factor, shift = (F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))
    return ((block * ((factor % (BLOCKS // 2)) * 2 + 1) + shift) % BLOCKS).cast("int")


def bisect_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for sources (share > 0); both targets are monotone in it.

    One aggregation evaluates the inner nodes of DEPTH levels of the bisection tree at
    once.  Entropy falls from ln(n) at 0 to that of the shares at 1; the repeat limit
    of an exponent is (largest / smallest share) ** (1 - a).  Targets out of reach give
    the nearer end.
    """
    lo, hi = 0.0, 1.0
    if target.entropy is None:
        row = sources.agg(F.max("share").alias("hi"), F.min("share").alias("lo")).first()
        ratio = (row.hi / row.lo) if row.hi else 1.0
    for _ in range(ROUNDS):
        n = 2**DEPTH
        at = [lo + (hi - lo) * i / n for i in range(n + 1)]
        if target.entropy is not None:
            sums = [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(at)] + [F.sum(F.pow("share", F.lit(a)) * a * F.log("share")).alias(f"y{i}") for i, a in enumerate(at)]
            row = sources.agg(*sums).first()
            too_flat = [row[f"z{i}"] is not None and _entropy(row[f"z{i}"], row[f"y{i}"]) > target.entropy for i in range(n + 1)]
        else:
            too_flat = [ratio ** (1 - a) > target.repeats for a in at]
        low, high = 0, n
        while high - low > 1:  # the walk down the tree
            middle = (low + high) // 2
            low, high = (middle, high) if too_flat[middle] else (low, middle)
        if not too_flat[0]:
            low = high = 0
        elif too_flat[n]:
            low = high = n
        lo, hi = at[low], at[high]
        if lo == hi:
            break
    return round(hi, 6)


def _entropy(z: float, y: float) -> float:
    from math import log

    return log(z) - y / z


def plan(df: DataFrame, target: Target, budget: float | None = None, seed: int = 0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row a source: source, source_tokens, weight, epochs, whole, extra_blocks.

    A document gets `whole` copies, and one more if its block's place in the source's
    permutation is below extra_blocks.
    """
    counted = df.select(F.col(f"`{source}`").alias("source"), block_of(F.col(f"`{doc_id}`")).alias("block"), tokens(text).alias("n"))
    blocks = cut(counted.groupBy("source", "block").agg(F.sum("n").alias("n")))
    totals = blocks.groupBy("source").agg(F.sum("n").alias("source_tokens"))
    total = totals.agg(F.sum("source_tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("source_tokens") / F.lit(float(total or 1)))
    alpha = bisect_exponent(shares.where("share > 0"), target)
    powered = shares.withColumn("power", F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0)))
    norm = powered.agg(F.sum("power").alias("z"), F.max(F.col("source_tokens") / F.when(F.col("power") > 0, F.col("power"))).alias("least")).first()
    z, least = norm.z or 1.0, norm.least or 0.0
    spend = budget if budget is not None else least * z
    weighed = powered.select("source", "source_tokens", (F.col("power") / F.lit(z)).alias("weight"))
    epochs = F.when(F.col("source_tokens") > 0, F.round(F.col("weight") * F.lit(float(spend)) / F.col("source_tokens"), 9)).otherwise(F.lit(1.0))
    weighed = weighed.withColumn("epochs", epochs).withColumn("whole", F.floor("epochs").cast("int"))
    weighed = weighed.withColumn("rest", F.floor((F.col("epochs") - F.col("whole")) * F.col("source_tokens")).cast("long"))
    order = Window.partitionBy("source").orderBy("place")
    so_far = blocks.withColumn("place", permuted(F.col("block"), F.col("source"), seed)).withColumn("upto", F.sum("n").over(order))
    met = weighed.alias("w").join(so_far.alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")))
    # Blocks fit as long as their running total does; empty blocks change nothing.
    fit = F.max(F.when(F.col("b.upto") <= F.col("w.rest"), F.col("b.place") + 1).otherwise(F.lit(0)))
    return met.groupBy("w.source", "w.source_tokens", "w.weight", "w.epochs", "w.whole").agg(F.when(F.max("w.rest") > 0, fit).otherwise(F.lit(0)).cast("int").alias("extra_blocks"))


NEW = ("weight", "block", "place", "n_copies")


def mix(df: DataFrame, target: Target, budget: float | None = None, seed: int = 0, text: str = "text", source: str = "source", doc_id: str = "doc_id", names: tuple[str, ...] = NEW) -> DataFrame:
    """df with weight (of the source), block, place and n_copies, under these or the given names."""
    its, weight, whole, extra = (own_name(df, x) for x in ("source", "weight", "whole", "extra"))
    made = cut(plan(df, target, budget, seed, text, source, doc_id))
    made = made.select(F.col("source").alias(its), F.col("weight").alias(weight), F.col("whole").alias(whole), F.col("extra_blocks").alias(extra))
    met = df.join(bounded_broadcast(made, FEW_SOURCES), F.col(f"`{source}`").eqNullSafe(F.col(its)), "left")
    block = block_of(F.col(f"`{doc_id}`"))
    place = permuted(block, F.col(f"`{source}`"), seed)
    n = F.col(whole) + F.when(place < F.col(extra), 1).otherwise(0)
    own = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return met.select(*own, *[c.alias(k) for c, k in zip((F.col(weight), block, place, n), names)])


def repeat(mixed: DataFrame, columns: list[str], n_copies: str = "n_copies") -> DataFrame:
    """Each row n_copies times, with the given columns only."""
    copy, n = own_name(mixed, "copy"), F.col(f"`{n_copies}`")
    return mixed.where(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*[F.col(f"`{c}`") for c in columns])
