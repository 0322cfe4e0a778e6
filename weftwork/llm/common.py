"""What the training-data operators share: scratch tables, ordered running sums and skew-safe joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.operators.rounds import cut, drop_scratch

#: ASCII white space, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"

#: DuckDB: a table of one row, `t`, the 256 entries of the CRC-32 table; see crc_sql.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(v, range(1, 9)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY v) AS t
  FROM (SELECT range AS v FROM range(256))
)"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text, where crc_table is in scope."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1])))"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Sequence[str], name: str) -> str:
    """A column name that none of columns has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII, told by equal byte and code point counts, takes the fast path."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0b\\f\\r]+"))).cast("long")


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, out: str, rows: int = 20_000) -> DataFrame:
    """Adds `out`: the sum of `value` over the earlier rows of the same group, in the order of `order`.

    No task sorts a whole group: rows are dealt by ranges of the order, each (group, range) is summed on
    its own, and the sums of earlier ranges are added. `order` must tell rows apart or leave only rows
    that may change places. Groups must not be null. Ranges grow beyond `rows` from 4096 ranges on.
    """
    if {"_range", "_earlier"} & set(df.columns):
        raise ValueError("columns _range and _earlier are taken")
    parts = max(1, min(4096, math.ceil(df.count() / rows)))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*groups, "_range"]
    sums = dealt.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, keys).withColumn(out, (F.col(out) + F.col("_earlier")).cast("long")).drop("_range", "_earlier")


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", hot: int = 200) -> DataFrame:
    """left joined to right, whose rows are unique by keys and carry in `weight` how many left rows they meet.

    The keys that meet more than 1/hot of all these rows are fewer than `hot`, so they may be broadcast
    whatever the input; the others are shuffled and no task gets much more than 1/hot of the rows.
    `how` is inner or left_semi.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = total / hot
    heavy = right.filter(F.col(weight) > limit).limit(hot)
    a = left.join(F.broadcast(heavy.drop(weight)), list(keys), how)
    light = left.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti")
    return a.unionByName(light.join(right.filter(F.col(weight) <= limit).drop(weight), list(keys), how))
