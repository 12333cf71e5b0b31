"""Temperature mixing of sources.

The token shares p of the sources are raised to an exponent a in [0, 1] and
normalised to weights. Lower exponents even the mixture out: entropy and
repetition both grow. The exponent is bisected on the grid j / 2**20: the largest
one whose entropy reaches the target, raised again as far as the repetition limit
needs. Each step is an aggregate over the table of sources, a few exponents at a
time; only those few sums reach the driver.

Weights become budgets of tokens, and budgets become blocks: block 0, 1, ... of a
source is a permutation of all its documents by a seeded hash, and the last block
is cut where the budget is used up (the document that crosses it is the last).
The cut is found by refining a histogram of the hash per source, so no task ever
orders a whole source.

Without a given budget the smallest one is taken that uses every document once.

Defined cases: null or empty texts have no tokens and are drawn in whole blocks,
and in the cut one where their turn comes; a null source is a source of its own;
rows repeated with one identifier and source share their turn in every block; a
corpus without any tokens is drawn once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockcast.llm.common import carried, cut, whole

GRID = 2**20
KEY_BITS = 60
BITS = 10


def tokens_of(text_col: str) -> Column:
    """Words between white space."""
    return F.regexp_count(whole(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def turn(seed: int, block: Column, id_col: str = "id") -> Column:
    """A document's place in a block's permutation: 60 bits of a seeded MD5."""
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit("")), block.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def at_exponents(sources: DataFrame, steps: list[int]) -> dict[int, tuple[float, float]]:
    """(entropy, largest repetition when every document is used) per exponent j / GRID."""
    live = sources.filter("tokens > 0").withColumn("j", F.explode(F.array(*[F.lit(j) for j in steps])))
    powered = live.withColumn("x", F.pow(F.col("tokens").cast("double") / F.col("all_tokens"), F.col("j") / F.lit(float(GRID))))
    rate = F.col("x") / F.col("tokens")
    sums = powered.groupBy("j").agg(
        F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("xlogx"), F.max(rate).alias("hi"), F.min(rate).alias("lo")
    ).collect()
    return {r["j"]: (math.log(r["z"]) - r["xlogx"] / r["z"], r["hi"] / r["lo"]) for r in sums}


def largest(sources: DataFrame, holds, low: int = 0, high: int = GRID, width: int = 31) -> int:
    """The largest j in [low, high] for which ``holds`` is true; it is true up to some j. ``low`` if it never is."""
    while high > low:
        steps = sorted({low + max(1, (high - low) * i // width) for i in range(1, width + 1)})
        values = at_exponents(sources, steps)
        good = [j for j in steps if j in values and holds(values[j])]
        bad = [j for j in steps if j not in good]
        low, high = max([low, *good]), min([high + 1, *bad]) - 1
    return low


def exponent(sources: DataFrame, entropy_share: float | None, repetition: float | None) -> int:
    """j of the exponent: entropy of at least ``entropy_share`` of its maximum, unless a source repeats more than ``repetition`` times."""
    if sources.filter("tokens > 0").isEmpty():
        return GRID
    j = GRID
    if entropy_share is not None:
        best = at_exponents(sources, [0])[0][0]
        j = largest(sources, lambda v: v[0] >= entropy_share * best - 1e-9)
    if repetition is not None:
        over = largest(sources, lambda v: v[1] > repetition + 1e-9) if at_exponents(sources, [0])[0][1] > repetition + 1e-9 else -1
        j = max(j, over + 1) if entropy_share is not None else over + 1
    return j


def budgets(docs: DataFrame, entropy_share: float | None, repetition: float | None, budget: int | None) -> DataFrame:
    """One row per source of ``docs`` (source, id, tokens): docs, tokens, weight, budget, full blocks, rest of the last block."""
    sources = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    sources, _ = cut(sources)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("all_tokens", F.lit(total).cast("long"))
    if not total:
        return sources.select("source", "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"),
                              F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"))
    a = exponent(sources, entropy_share, repetition) / GRID
    x = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double") / F.col("all_tokens"), F.lit(a))).otherwise(0.0)
    raised = sources.withColumn("x", x)
    sums = raised.filter("tokens > 0").agg(F.sum("x").alias("z"), F.min(F.col("x") / F.col("tokens")).alias("lo")).first()
    z, spread = sums["z"], budget if budget is not None else sums["z"] / sums["lo"]
    weighted = raised.withColumn("weight", F.round(F.col("x") / z, 12)).withColumn("budget", F.round(F.col("x") / z * spread).cast("long"))
    return weighted.select(
        "source", "docs", "tokens", "weight", "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).alias("full"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
    )


def cut_points(last: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, edge): the key of the document that uses up ``rest``, by a histogram of 1024 key ranges refined until it is one key."""
    found = limits.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, KEY_BITS // BITS + 1):
        shift = KEY_BITS - BITS * level
        place = F.shiftright("k", shift)
        inside = last.join(found, F.col("l").eqNullSafe(F.col("source")) & (F.shiftright("k", shift + BITS) == F.col("prefix")))
        counts = inside.groupBy("source", "rest", place.alias("place")).agg(F.sum("tokens").alias("n"))
        reached = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        found = reached.filter(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("place", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left"))).alias("m")).select(
            "source", F.col("m.left").alias("rest"), F.col("m.place").alias("prefix"))
        found, _ = cut(found)
    return found.select("source", F.col("prefix").alias("edge"))


def mixture(docs: DataFrame, entropy_share: float | None = None, repetition: float | None = None, budget: int | None = None, seed: int = 7,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per document and block it is drawn in: id, source, tokens, weight, block, place (the key to order a block by)."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), tokens_of(text_col).alias("tokens")
    )
    slim, _ = cut(slim)
    plan, _ = cut(budgets(slim, entropy_share, repetition, budget))
    keyed = slim.join(plan.select(F.col("source").alias("p"), "full", "rest"), F.col("source").eqNullSafe(F.col("p")))
    last = keyed.filter("rest > 0").withColumn("k", turn(seed, F.col("full"))).select(F.col("source").alias("l"), "k", "tokens")
    edges = cut_points(last, plan)
    limits = plan.join(edges.withColumnRenamed("source", "e"), F.col("source").eqNullSafe(F.col("e")), "left").select(
        F.col("source").alias("p"), "weight", "full", F.coalesce("edge", F.lit(-1)).alias("edge"))
    rows = docs.select(carried(docs).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")) if carry else slim
    # as many rows as there are sources: Spark broadcasts it if it is small enough
    drawn = rows.join(limits, F.col("source").eqNullSafe(F.col("p"))).withColumn(
        "blocks", F.col("full") + F.when(turn(seed, F.col("full")) <= F.col("edge"), 1).otherwise(0)
    ).filter("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    if carry:
        return drawn.select("row", "block")
    return drawn.select("id", "source", "tokens", "weight", "block", turn(seed, F.col("block")).alias("place"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with all their columns."""
    return mixture(docs, carry=True, **settings).select("row.*")
