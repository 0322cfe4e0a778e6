"""What goes together: pairs by log-likelihood, gaps between them, and recommendations with their reasons.

lines(basket, item) say what was seen together. A basket of more than `widest` items tells nothing of which of them belong together and makes no
pairs; so no basket makes more than widest / 2 pairs a line, and what one hot basket holds is shared out by its items. Each item is linked to its
`links` most associated items, so later steps grow with the items and not with the square of a popular one's neighbours. The number of tasks grows with
the lines, so the memory of one does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.rounds import cut, drop_scratch, small_tasks

WIDEST, LEAST, LINKS = 1000, 2, 10


def pair_counts(lines: DataFrame, widest: int = WIDEST) -> tuple[DataFrame, DataFrame, int]:
    """((a, b, both) with a < b, (item, n), number of baskets), each line of a basket counted once, over baskets of at most widest items. Nulls are no lines."""
    one = lines.filter("basket IS NOT NULL AND item IS NOT NULL").select("basket", "item").distinct()
    sizes = one.groupBy("basket").agg(F.count("*").alias("_size")).filter(F.col("_size") <= widest)
    kept = cut(one.join(sizes.select("basket"), "basket", "left_semi"), "lines")
    items = kept.groupBy("item").agg(F.count("*").alias("n"))
    met = kept.select("basket", F.col("item").alias("a")).join(kept.select("basket", F.col("item").alias("b")), "basket").filter("a < b")
    pairs = cut(met.groupBy("a", "b").agg(F.count("*").alias("both")), "pairs")
    return pairs, items, kept.select("basket").distinct().count()


def log_likelihood(both: Column, a: Column, b: Column, total: Column) -> Column:
    """Dunning's ratio in thousandths, as a whole number, of two items in a and b of all baskets and together in both."""

    def part(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = part(both) + part(a - both) + part(b - both) + part(total - a - b + both)
    return F.floor(2000 * (cells + part(total) - part(a) - part(total - a) - part(b) - part(total - b)) + 0.5).cast("long")


def associations(pairs: DataFrame, items: DataFrame, baskets: int, least: int = LEAST, links: int = LINKS) -> DataFrame:
    """(item, other, weight): for each item the `links` others of highest log-likelihood among those met in `least` baskets or more
    and oftener than by chance; ties to the smaller other."""
    often = pairs.filter(F.col("both") >= least)
    for end in ("a", "b"):
        often = often.join(items.select(F.col("item").alias(end), F.col("n").alias(f"n_{end}")), end)
    n = F.lit(baskets).cast("long")
    often = often.filter(F.col("both") * n > F.col("n_a") * F.col("n_b")).select("a", "b", log_likelihood(F.col("both"), F.col("n_a"), F.col("n_b"), n).alias("weight"))
    ways = often.select(F.col("a").alias("item"), F.col("b").alias("other"), "weight").unionByName(often.select(F.col("b").alias("item"), F.col("a").alias("other"), "weight"))
    order = Window.partitionBy("item").orderBy(F.desc("weight"), "other")
    return ways.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= links).drop("_r")


def gaps(lines: DataFrame, widest: int = WIDEST, least: int = LEAST, links: int = LINKS) -> DataFrame:
    """(item, other, between, score): others that an item was never met with, though items linked to it are linked to them.

    A gap is an open triad: item to middle to other along links, at most links * links an item. between counts the middles, score sums the
    lesser weight of each two links.
    """
    with small_tasks(lines.sparkSession, lines.count()):
        return _gaps(lines, widest, least, links)


def _gaps(lines: DataFrame, widest: int, least: int, links: int) -> DataFrame:
    pairs, items, baskets = pair_counts(lines, widest)
    linked = cut(associations(pairs, items, baskets, least, links), "links")
    onward = linked.select(F.col("item").alias("_middle"), F.col("other").alias("_far"), F.col("weight").alias("_weight"))
    triads = linked.withColumnRenamed("other", "_middle").join(onward, "_middle").filter(F.col("item") != F.col("_far"))
    found = triads.groupBy("item", F.col("_far").alias("other")).agg(F.count("*").alias("between"), F.sum(F.least("weight", "_weight")).alias("score"))
    met = pairs.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other")))
    out = cut(found.join(met, ["item", "other"], "left_anti"), "gaps")
    drop_scratch(pairs, linked)
    return out


def recommendations(held: DataFrame, lines: DataFrame, k: int = 5, reasons: int = 3, widest: int = WIDEST, least: int = LEAST, links: int = LINKS) -> DataFrame:
    """(user, rank, item, score, reasons): the k best items that users of held(user, item) do not hold, by the summed weights of the links from those they do.

    Ties go to the smaller item. reasons are the held items that gave most, ties to the smaller. Sums are taken before the best are chosen, and the
    reasons only of the chosen are gathered, so nobody's whole neighbourhood is in one task.
    """
    with small_tasks(lines.sparkSession, lines.count()):
        return _recommendations(held, lines, k, reasons, widest, least, links)


def _recommendations(held: DataFrame, lines: DataFrame, k: int, reasons: int, widest: int, least: int, links: int) -> DataFrame:
    pairs, items, baskets = pair_counts(lines, widest)
    linked = cut(associations(pairs, items, baskets, least, links), "links")
    own = cut(held.filter("user IS NOT NULL AND item IS NOT NULL").select("user", "item").distinct(), "held")
    ways = own.withColumnRenamed("item", "because").join(linked.select(F.col("item").alias("because"), F.col("other").alias("item"), "weight"), "because")
    sums = ways.groupBy("user", "item").agg(F.sum("weight").alias("score")).join(own, ["user", "item"], "left_anti")
    best = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    chosen = cut(sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "chosen")
    why = Window.partitionBy("user", "item").orderBy(F.desc("weight"), "because")
    given = ways.join(chosen.select("user", "item"), ["user", "item"], "left_semi").withColumn("_r", F.row_number().over(why)).filter(F.col("_r") <= reasons)
    listed = given.groupBy("user", "item").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "because"))), lambda x: x["because"]).alias("reasons"))
    out = cut(chosen.join(listed, ["user", "item"]).select("user", F.col("rank").cast("long").alias("rank"), "item", "score", "reasons"), "recommended")
    drop_scratch(pairs, linked, own, chosen)
    return out
