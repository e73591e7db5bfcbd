"""Pairs of similar short texts, and an order-dependent grouping of them, as joins.

*Pairs.* The Ratcliff/Obershelp ratio 2M / T of two texts with T characters together needs M = T * ratio / 2 matching characters, in
blocks with at least one of the D = T - 2M other characters between each two. So there are at most D + 1 blocks, and a block of n
characters has n - 1 bigrams: the texts share M - D - 1 bigrams or more. That is a set-overlap
join: in the order of their rarity, two texts that share so many bigrams share one of the first few (prefix filter), at a place from which on enough
are left (position filter). What passes is counted in full, and only then compared character by character.

*Grouping.* Texts come in an order, and each one joins the most similar leader before it, or else becomes a leader itself. A text
only depends on the similar ones before it, so all that have no undecided one before them are decided at once, round by round.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Below this threshold the bound on shared bigrams is no bound any more.
LOWEST = 0.7


def similarity(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio, 2M / T."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def similarity_from(a: str, b: str, least: float) -> float:
    """The ratio, or 0 where the counts of characters alone keep it under `least`."""
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0


def _ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(ratio=[similarity(a, b) for a, b in zip(pdf["later_text"], pdf["earlier_text"], strict=True)])


def compared(pairs: DataFrame) -> DataFrame:
    """(earlier, later, ratio) of pairs that have both texts; each two texts are compared once, wherever they stand."""
    pairs = pairs.select("earlier", "later", "earlier_text", "later_text")
    texts = pairs.select("earlier_text", "later_text").distinct().mapInPandas(_ratios, "earlier_text string, later_text string, ratio double")
    return pairs.join(texts, ["earlier_text", "later_text"]).select("earlier", "later", "ratio")


def shared_bigrams(total: Column, threshold: float) -> Column:
    """Bigrams at least that two different texts of `total` characters share if their ratio reaches the threshold."""
    return F.greatest(F.lit(1), F.ceil(total * (0.5 - 1.5 * (1 - threshold)) - 1 - 1e-9)).cast("int")


def _bigrams(names: DataFrame) -> DataFrame:
    """(at, asks, text, n, gram): each bigram of a text; the second of its kind is another one than the first."""
    n = F.length("text")
    each = names.where(n > 1).select("at", "asks", "text", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col("text"), i, F.lit(2)))).alias("gram"))
    counted = each.groupBy("at", "asks", "text", "n", "gram").agg(F.count("*").alias("times"))
    return counted.select("at", "asks", "text", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda i: F.concat("gram", i.cast("string")))).alias("gram"))


def similar_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(earlier, later, ratio) of all pairs of different texts with a ratio of `threshold` or more.

    `names` has at (a place in the order, no two alike), text, and asks (whether the text is compared with those before it).
    """
    if threshold < LOWEST:
        raise ValueError(f"the threshold must be {LOWEST} or more")
    grams = saved(_bigrams(names))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("rarity"))
    place = F.row_number().over(Window.partitionBy("at").orderBy("rarity", "gram"))  # a text's bigrams
    least = shared_bigrams(F.col("n") + F.ceil(F.col("n") * threshold / (2 - threshold)), threshold)
    prefix = grams.join(rarity, "gram").withColumn("place", place).where(F.col("place") <= F.col("n") - least)
    prefix = saved(prefix.select("gram", "at", "asks", "n", "place"))
    a, b = prefix.alias("a"), prefix.where("asks").alias("b")
    total = F.col("a.n") + F.col("b.n")
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    near = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.at") < F.col("b.at")) & (2 * F.least("a.n", "b.n") >= threshold * total) & (left >= shared_bigrams(total, threshold))
    pairs = a.join(b, near).select(F.col("a.at").alias("earlier"), F.col("b.at").alias("later")).distinct()
    whole = grams.groupBy("at", "text").agg(F.collect_list("gram").alias("grams"))  # as many as a text has characters
    side = lambda name: whole.select(F.col("at").alias(name), F.col("text").alias(f"{name}_text"), F.col("grams").alias(f"{name}_grams"))
    met = pairs.join(side("earlier"), "earlier").join(side("later"), "later").where("earlier_text <> later_text")
    enough = F.size(F.array_intersect("earlier_grams", "later_grams")) >= shared_bigrams(F.length("earlier_text") + F.length("later_text"), threshold)
    return compared(met.where(enough)).where(F.col("ratio") >= threshold)


#: States of a text: undecided; known to join no leader, but perhaps second to one of its own name; leader; not a leader though new; joined to a leader.
OPEN, NEW, LEAD, FOLLOW, MATCHED = "open", "new", "lead", "follow", "matched"


def settled(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """`names` (at, name, state, ...) with the final states.

    An open text with a leader among its earlier partners is matched, and new if all of them are decided
    and none is. Of the new ones of one name the first leads, the others follow.
    """
    rest = [c for c in names.columns if c != "state"]
    names = saved(names)
    while names.where(F.col("state").isin(OPEN, NEW)).limit(1).count():
        asking = names.where(F.col("state") == OPEN).select(F.col("at").alias("later"))
        before = names.select(F.col("at").alias("earlier"), F.col("state").alias("s"))
        seen = pairs.join(asking, "later").join(before, "earlier").groupBy(F.col("later").alias("at"))
        seen = seen.agg(F.max(F.col("s") == LEAD).alias("led"), F.max(F.col("s").isin(OPEN, NEW)).alias("waits"))
        of_name = names.where(F.col("state") != MATCHED).groupBy("name").agg(
            F.min(F.when(F.col("state") != OPEN, F.col("at"))).alias("first_new"), F.min(F.when(F.col("state") == OPEN, F.col("at"))).alias("first_open")
        )
        state = (
            F.when(F.col("state") == OPEN, F.when(F.col("led"), MATCHED).when(F.coalesce("waits", F.lit(False)), OPEN).otherwise(NEW))
            .when(F.col("state") == NEW, F.when(F.col("at") > F.col("first_new"), FOLLOW).when(F.coalesce(F.col("first_open") < F.col("at"), F.lit(False)), NEW).otherwise(LEAD))
            .otherwise(F.col("state"))
        )
        names = saved(names.join(seen, "at", "left").join(of_name, "name", "left").select(*rest, state.alias("state")))
    return names
