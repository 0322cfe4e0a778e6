"""Sharding by a keyed permutation of global row numbers.

Row i of n (rows in the order of doc_id, size, text CRC-32) goes to place p = P(i), where P is an
alternating Feistel network over Z_a x Z_b, a = ceil(sqrt n), b = ceil(n / a), with cycle walking: while
p >= n, P is applied again. Shard is p mod shards, slot is p div shards. So n, the seed and i alone give
shard and slot, and shard counts differ by one at most (law `rows`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table, running_sum

ROUNDS, PRIME = 6, 2**31 - 1


def round_keys(seed: int) -> list[int]:
    """One key under 2**31 - 1 for each round, from the seed."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x: Column, n: int, seed: int) -> Column:
    """P of x, a long in 0 to n - 1. n is under 2**62.

    A walk leaves only points of Z_a x Z_b outside 0..n-1, all different, so a*b - n + 1 steps, at most
    about sqrt n, end every walk; only the few rows that start one take the second branch.
    """
    a, b = radices(n)
    rounds = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit((a, b)[i % 2]).cast("long").alias("m")) for i, k in enumerate(round_keys(seed))))

    def mixed(r: Column, k: Column) -> Column:
        t = (r + k) % PRIME
        t = (t * t + k) % PRIME
        return (t * t + r) % PRIME

    def once(y: Column) -> Column:
        start = F.struct(F.floor(y / b).cast("long").alias("l"), (y % b).alias("r"))
        if n >= 2**52:  # beyond exact doubles
            start = F.struct(((y - y % b) / b).cast("decimal(38,0)").cast("long").alias("l"), (y % b).alias("r"))
        end = F.aggregate(rounds, start, lambda s, q: F.struct(s["r"].alias("l"), ((s["l"] + mixed(s["r"], q["k"])) % q["m"]).alias("r")))
        return end["l"] * b + end["r"]

    first = once(x)
    excess = a * b - n
    if not excess:
        return first
    walked = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(excess).cast("long")), first, lambda y, _: F.when(y >= n, once(y)).otherwise(y))
    return F.when(first < n, first).otherwise(walked)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_601) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard for every row of docs.

    Null text has size 1 and CRC-32 0; null doc_ids come first in the order; repeated rows get places of
    their own; an empty table gives an empty result. Other columns of docs are not read.
    """
    bare = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    n = bare.count()
    numbered = running_sum(bare.withColumn("_one", F.lit(1).cast("long")), [], ["doc_id", "size", "text_crc32"], "_one", "row_number").drop("_one")
    place = numbered.withColumn("_place", permute(F.col("row_number"), max(n, 1), seed))
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % shards).cast("int").alias("shard"), ((F.col("_place") - F.col("_place") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))


def _oracle(shards: int = 16, seed: int = 20_240_601) -> str:
    steps = []
    for i, k in enumerate(round_keys(seed)):
        t1 = f"((r + {k}) % {PRIME})"
        t2 = f"(({t1} * {t1} + {k}) % {PRIME})"
        steps.append(f"p{i + 1} AS (SELECT x, r AS l, (l + ({t2} * {t2} + r) % {PRIME}) % {'ab'[i % 2]} AS r, a, b, n FROM p{i})")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(v, range(1, 9)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY v) AS t
  FROM (SELECT range AS v FROM range(256))
), docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, v: xor(c // 256, t[xor(c, v) % 256 + 1]))) AS crc
  FROM documents, crc_table
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS i FROM docs
), dims AS (
  SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM documents)
), p0 AS (
  SELECT range AS x, range // b AS l, range % b AS r, a, b, n FROM dims, range((SELECT a * b FROM dims))
), {", ".join(steps)}, perm AS (
  SELECT x, l * b + r AS y, n FROM p{ROUNDS}
), walk AS (
  SELECT x, y, n FROM perm WHERE x < n
  UNION ALL SELECT w.x, p.y, w.n FROM walk w JOIN perm p ON p.x = w.y WHERE w.y >= w.n
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (y % {shards})::INTEGER AS shard,
       (y // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, i::BIGINT AS row_number
FROM numbered JOIN walk ON x = i WHERE y < n"""


QUERIES = {"op7_feistel_sharding": op7_feistel_sharding}
ORACLE_SQL = {"op7_feistel_sharding": _oracle()}
