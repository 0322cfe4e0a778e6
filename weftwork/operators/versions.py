"""Named graphs that change: a log of quads added and removed, read as of any version.

log(graph, s, p, o, version, added): a version takes away the quads with added false and then puts in those with added true, so
a quad that a version both removes and adds is there after it. Versions are whole numbers that ascend. Rows with a null version or a null
added say nothing; nulls in the quad are values like others (a null graph is the unnamed one); repeated rows count once. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUAD = ("graph", "s", "p", "o")


def _told(log: DataFrame) -> DataFrame:
    """Quads with _code, 2 x version + added: the largest code up to a version tells whether the quad is there, so one long is all that is aggregated."""
    return log.filter("version IS NOT NULL AND added IS NOT NULL").select(*QUAD, (F.col("version").cast("long") * 2 + F.col("added").cast("int")).alias("_code"))


def _there(code: Column) -> Column:
    return F.coalesce(F.pmod(code, F.lit(2)) == 1, F.lit(False))


def as_of(log: DataFrame, version: int) -> DataFrame:
    """The quads that are there after a version: one aggregation, combined before its shuffle, so a quad that changes very often is no heavy key."""
    last = _told(log).filter(F.col("_code") <= 2 * version + 1).groupBy(*QUAD).agg(F.max("_code").alias("_code"))
    return last.filter(_there(F.col("_code"))).select(*QUAD)


def triples(log: DataFrame, version: int, graphs: Sequence[str] | None = None) -> DataFrame:
    """(s, p, o), each once, of the named graphs (all, if none are named) merged, as of a version."""
    picked = log if graphs is None else log.filter(F.col("graph").isin(*graphs))
    return as_of(picked, version).select("s", "p", "o").distinct()


def difference(log: DataFrame, old: int, new: int) -> DataFrame:
    """Quads that are there after one of two versions only: (graph, s, p, o, change), change being `added` or `removed` on the way from old to new. One aggregation."""
    def last(version: int) -> Column:
        return F.max(F.when(F.col("_code") <= 2 * version + 1, F.col("_code")))

    both = _told(log).filter(F.col("_code") <= 2 * max(old, new) + 1).groupBy(*QUAD).agg(last(old).alias("_a"), last(new).alias("_b"))
    before, after = _there(F.col("_a")), _there(F.col("_b"))
    return both.filter(before != after).select(*QUAD, F.when(after, "added").otherwise("removed").alias("change"))


def intervals(log: DataFrame) -> DataFrame:
    """(graph, s, p, o, since, until): each longest stretch of versions in which a quad is there, from since on and before until; null until: still there.

    A version's rows of a quad are made one before the shuffle; then a quad has at most a row a version, read in order of versions.
    """
    each = _told(log).groupBy(*QUAD, F.shiftright("_code", 1).alias("version")).agg(F.max("_code").alias("_code"))
    in_order = Window.partitionBy(*QUAD).orderBy("version")
    turns = each.withColumn("_on", _there(F.col("_code"))).withColumn("_was", F.lag("_on", 1, False).over(in_order)).filter("_on <> _was")
    return turns.withColumn("until", F.lead("version").over(in_order)).filter("_on").select(*QUAD, F.col("version").alias("since"), "until")


def provenance(log: DataFrame, version: int) -> DataFrame:
    """(s, p, o, graph, since): for each triple as of a version the graphs that say it and the version since when they do so without a break. A row a graph, no lists."""
    at = intervals(log.filter(F.col("version") <= version)).filter("until IS NULL")
    return at.select("s", "p", "o", "graph", "since")


def compact(log: DataFrame, version: int) -> DataFrame:
    """A log that gives the same graphs as of this version and all later ones: what was there is added at it, older changes are gone."""
    base = as_of(log, version).select(*QUAD, F.lit(version).cast("long").alias("version"), F.lit(True).alias("added"))
    return base.unionByName(log.filter(F.col("version") > version).select(*QUAD, F.col("version").cast("long").alias("version"), "added"))
