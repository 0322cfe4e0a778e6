"""Variables mapped to terms by labels that are nearly the same.

Labels are compared after lower-casing and with runs of other characters than letters and digits as one blank. A label of 7 characters or more may differ by two
edits, one of 4 to 6 by one, a shorter one not at all. Within two edits one of three parts of a label is left whole and moves by two places at most,
so a term is indexed by its three parts, with its length, and a variable asks with the few substrings that could be one of them. Only labels that
share such a part are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.rounds import cut, drop_scratch

PARTS = 3


def normal(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^\\p{L}\\p{N}]+", " "))


def allowed(n: Column) -> Column:
    """Edits that a label of n characters may differ by."""
    return F.when(n >= 7, 2).when(n >= 4, 1).otherwise(0)


def _bounds(n: Column, part: Column) -> tuple[Column, Column]:
    """(start, length) of a part of a label of n characters, from 0; the last parts take what is left over."""
    base = F.floor(n / PARTS).cast("int")
    short = PARTS - (n % PARTS)
    start = part * base + F.greatest(F.lit(0), part - short)
    return start.cast("int"), (base + (part >= short).cast("int")).cast("int")


def _parts(n: Column) -> Column:
    return F.when(n >= 4, F.array(*map(F.lit, range(PARTS)))).otherwise(F.array(F.lit(-1)))


def near_labels(variables: DataFrame, terms: DataFrame) -> DataFrame:
    """(variable, term, edits): all pairs of variables(variable, label) and terms(term, label) whose labels are near enough for both.

    Labels that are null or hold no letter or digit match nothing; repeated rows count once.
    """
    have = terms.select("term", normal(F.col("label")).alias("t")).filter("t <> ''").distinct().withColumn("n", F.length("t"))
    start, size = _bounds(F.col("n"), F.col("part"))
    indexed = have.withColumn("part", F.explode(_parts(F.col("n")))).withColumn("piece", F.when(F.col("part") < 0, F.col("t")).otherwise(F.substring("t", start + 1, size))).select("term", "t", "n", "part", "piece")
    want = variables.select("variable", normal(F.col("label")).alias("v")).filter("v <> ''").distinct().withColumn("m", F.length("v"))
    asked = want.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - allowed(F.col("m"))), F.col("m") + allowed(F.col("m")))))
    asked = asked.withColumn("part", F.explode(_parts(F.col("n"))))
    shifts = F.when(F.col("part") < 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(-2, 3))))
    asked = asked.withColumn("shift", F.explode(shifts)).withColumn("from", start + F.col("shift")).withColumn("size", size).filter((F.col("part") < 0) | ((F.col("from") >= 0) & (F.col("from") + F.col("size") <= F.col("m"))))
    asked = asked.withColumn("piece", F.when(F.col("part") < 0, F.col("v")).otherwise(F.substring("v", F.col("from") + 1, F.col("size")))).select("variable", "v", "m", "n", "part", "piece").distinct()
    met = asked.join(indexed, ["n", "part", "piece"]).select("variable", "v", "m", "term", "t", "n").distinct()
    most = F.least(allowed(F.col("m")), allowed(F.col("n")))
    near = met.withColumn("edits", F.levenshtein("v", "t", 2)).filter((F.col("edits") >= 0) & (F.col("edits") <= most))
    return near.groupBy("variable", "term").agg(F.min("edits").alias("edits"))


def mapping_table(variables: DataFrame, terms: DataFrame, margin: int = 1) -> DataFrame:
    """(variable, term, edits, margin, sure) for each variable that has a near term: the nearest, ties to the smaller; margin is how many more edits the next one needs
    (null: there is none), sure whether that is `margin` at least."""
    near = cut(near_labels(variables, terms), "near")
    order = Window.partitionBy("variable").orderBy("edits", "term")
    ranked = near.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("edits").over(order)).filter("_r = 1")
    gap = F.col("_next") - F.col("edits")
    out = cut(ranked.select("variable", "term", "edits", gap.alias("margin"), (gap.isNull() | (gap >= margin)).alias("sure")), "mapped")
    drop_scratch(near)
    return out
