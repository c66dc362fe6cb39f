"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

Weights are ``share ** a`` normalised, where ``share`` is a source's part of all tokens.
The exponent is the largest in [0, 1] whose weights reach a target entropy, raised as far
as needed to keep the most repeated source within a limit of passes. Both are found by
bisection; a round evaluates all outcomes of six halvings in one grouped aggregate over
the table of sources, so sources are never collected.

A source's budget is its weight times the token budget. Its documents lie in blocks by a
hash of their key. Each pass visits the blocks in a new permutation; full passes take all
blocks, the last one takes blocks until the budget is used, and within the block where it
runs out, documents in hash order. Running sums go over block totals only, so a source
with a third of all rows needs no window over its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

WORDS = r"[^\x20\x09-\x0D]+"
HALVINGS, ROUNDS = 6, 5


@dataclass
class Mixture:
    exponent: float
    weights: DataFrame  # source, tokens, weight, budget


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _ladder(shares: DataFrame, low: float, high: float, share: Column) -> dict[float, tuple[float, float]]:
    """(entropy, largest weight over share) at all points that ``HALVINGS`` halvings can reach."""
    steps = 2**HALVINGS
    points = [low + (high - low) * i / steps for i in range(steps + 1)]
    a = F.col("a")
    rows = (
        shares.select(F.explode(F.array(*[F.lit(p) for p in points])).alias("a"), share.alias("s"))
        .select("a", "s", F.pow("s", a).alias("p"))
        .groupBy("a")
        .agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("s")).alias("e"), F.max(F.pow("s", a - 1)).alias("m"))
        .collect()
    )
    return {r.a: (math.log(r.z) - r.a * r.e / r.z, r.m / r.z) for r in rows}


def _bisect(shares: DataFrame, share: Column, enough, largest: bool) -> float:
    """The end of the bisection of [0, 1] for a condition that holds on one side only.

    ``largest``: it holds for small exponents, and the largest one is wanted; else the reverse.
    """
    low, high = 0.0, 1.0
    for turn in range(ROUNDS):
        at = _ladder(shares, low, high, share)
        if turn == 0 and enough(*at[1.0 if largest else 0.0]):
            return 1.0 if largest else 0.0
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            if enough(*at[middle]) == largest:
                low = middle
            else:
                high = middle
    return low if largest else high


def mixture(
    counted: DataFrame,
    budget: int | None = None,
    entropy: float = 0.98,
    max_passes: float = 4.0,
) -> Mixture:
    """Weights of the sources of ``counted`` (``source``, ``tokens``).

    ``entropy`` is the target as a part of the entropy of equal weights; ``budget`` the number
    of tokens of the mixture (default: all tokens once). Sources without tokens get no weight.
    The limit of passes comes before the entropy. A null source is a source of its own.
    """
    sources = written(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "sources")
    n, total = sources.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = int(total or 0)
    budget = total if budget is None else int(budget)
    if budget > max_passes * total:
        raise ValueError(f"{budget} tokens need more than {max_passes} passes over {total}")
    share = F.col("tokens") / F.lit(float(total or 1))
    exponent = 1.0
    if n:
        slack = 1e-12
        target = entropy * math.log(n)
        exponent = _bisect(sources, share, lambda h, m: h >= target - slack, largest=True)
        if n > 1:
            limit = max_passes * total / max(budget, 1) + slack
            exponent = max(exponent, _bisect(sources, share, lambda h, m: m <= limit, largest=False))
    z = sources.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0] or 1.0
    weight = F.pow(share, F.lit(exponent)) / F.lit(z)
    budget_of = F.floor(F.round(weight, 9) * F.lit(float(budget))).cast("long")
    return Mixture(exponent, sources.select("source", "tokens", weight.alias("weight"), budget_of.alias("budget")))


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def mixed(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float = 0.98,
    max_passes: float = 4.0,
    seed: str = "mix",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document and pass that takes it.

    Returns ``key``, ``source``, ``tokens``, ``pass`` (from 0), ``block`` and ``place`` (of the
    block in the permutation of that pass). A null text has no tokens; documents without
    tokens go with their block. Rows that repeat a key have equal hashes and are taken or left
    together. Empty tables give no rows. Further columns are not read.
    """
    counted = written(
        docs.select(
            column(key).alias("doc"),
            column(source).cast("string").alias("source"),
            word_count(column(text)).alias("tokens"),
            _digest(F.lit(seed), column(key)).alias("digest"),
        ).withColumn("block", F.substring("digest", 1, 3)),
        "mixing",
    )
    weights = mixture(counted, budget, entropy, max_passes).weights.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    blocks = counted.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    other = weights.select(F.col("source").alias("of"), "tokens", "budget", "full")
    passes = blocks.join(other, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "block", "block_tokens", "tokens", "budget", "full", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("pass")
    )
    order = Window.partitionBy("source", "pass").orderBy("shuffled", "block")
    left = F.col("budget") - F.col("full") * F.col("tokens")
    through = F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    plan = (
        passes.withColumn("shuffled", _digest(F.lit(seed), F.col("source"), F.col("pass"), F.col("block")))
        .withColumn("place", F.row_number().over(order))
        .withColumn("left", F.when(F.col("pass") < F.col("full"), F.col("block_tokens")).otherwise(left - through + F.col("block_tokens")))
        .filter(F.col("left") > 0)
        .select(F.col("source").alias("of"), F.col("block").alias("in_block"), "pass", "place", "left", (F.col("left") >= F.col("block_tokens")).alias("whole"))
    )
    taken = counted.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in_block")))
    names = ["doc", "source", "tokens", "pass", "block", "place"]
    so_far = F.sum("tokens").over(Window.partitionBy("source", "block", "pass").orderBy("digest").rangeBetween(Window.unboundedPreceding, 0))
    edge = taken.filter(~F.col("whole")).withColumn("so_far", so_far).filter("so_far <= left")
    out = taken.filter("whole").select(*names).unionByName(edge.select(*names))
    return out.withColumnsRenamed({"doc": key})
