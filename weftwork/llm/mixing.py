"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree of domain, language and source. The token budget flows from the root: the
children of a node share its budget by their weights, but none gets more than its capacity, its tokens times the number of
epochs allowed. What a child cannot take goes to its siblings by their weights; only where all children of
a node are full does the node itself take less, and then its own siblings share that, and so on up.
Budgets are whole tokens; odd ones go to the largest remainders.

A leaf's budget is read off an endless sequence of epochs, each a seeded shuffle of the leaf's documents: whole
epochs give every document once, and the last, partial epoch gives a prefix that ends within a document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.llm.common import read_table, running_sum, unused, word_count
from weftwork.operators.rounds import cut

LEVELS = ("domain", "lang", "source")
#: Weights of the query by level and value; other values weigh 1. Sources weigh 1 + their number mod 3.
WEIGHTS: tuple[Mapping[str, int], ...] = (
    {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    {"en": 5, "de": 2, "fr": 2, "es": 1},
    {f"src{k}": 1 + k % 3 for k in range(20)},
)
EPOCHS, SEED = 2, 17


def domain_of(source: Column) -> Column:
    """Domain d0 to d3 by the number at the end of a source's name; `other` for names without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (number.cast("int") % 4).cast("string")))


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        if w < 1:
            raise ValueError("weights are whole numbers from 1")
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """children(parent columns, name, w, cap, given) with `got`: each child's part of `given`, the budget of its parent."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_need = group.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), name)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    c = children.withColumn("budget", F.least("given", F.sum("cap").over(group)))
    c = c.withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    c = c.withColumn("full", F.col("c0") * F.col("w") + F.col("cap") * F.col("w0") <= F.col("budget") * F.col("w"))
    c = c.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)))
    c = c.withColumn("open_w", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(group), F.lit(1)))
    c = c.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest * w div open_w")))
    c = c.withColumn("odd", F.when(F.col("full"), F.lit(-1)).otherwise(F.col("rest") * F.col("w") % F.col("open_w")))
    c = c.withColumn("over", F.col("budget") - F.sum("part").over(group))
    c = c.withColumn("turn", F.row_number().over(group.orderBy(F.desc("odd"), name)))
    return c.withColumn("got", (F.col("part") + F.when((F.col("odd") >= 0) & (F.col("turn") <= F.col("over")), 1).otherwise(0)).cast("long")).select(*children.columns, "got")


def leaf_budgets(docs: DataFrame, weights: Sequence[Mapping[str, int]], total: int | None = None, epochs: int = EPOCHS, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(levels, supply, budget) of every leaf of docs(levels, tokens). `total` is by default all tokens there are. Token counts times
    weights must stay under 2**63."""
    leaves = cut(docs.groupBy(*levels).agg(F.sum("tokens").alias("supply")), "leaves")
    given = leaves.agg(F.coalesce(F.lit(total).cast("long"), F.sum("supply"), F.lit(0)).cast("long").alias("given"))
    above: list[str] = []
    budget = given
    for depth, level in enumerate(levels):
        nodes = leaves.groupBy(*above, level).agg((F.sum("supply") * epochs).alias("cap")).withColumn("w", _weight(level, weights[depth]))
        # the first level has one parent, the root, whose budget is one row
        joined = nodes.join(budget, above) if above else nodes.crossJoin(F.broadcast(budget))
        shared = share_out(joined, above, level)
        above = [*above, level]
        budget = shared.select(*above, F.col("got").alias("given"))
    return leaves.join(budget, list(levels)).withColumnRenamed("given", "budget")


def choose(docs: DataFrame, weights: Sequence[Mapping[str, int]] = WEIGHTS, total: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, domain, lang, source, tokens, budget, full_epochs, part_tokens of the rows that are in the mixture.

    full_epochs: how often the whole document is taken; part_tokens: how many of its first tokens the last epoch
    takes. Tokens are words between ASCII white space. A null language or source is that named by the empty string; texts without
    words are in no mixture; rows that repeat a doc_id are chosen one by one; an empty table gives an empty result.
    """
    bare = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), word_count(F.col("text")).alias("tokens"))
    bare = cut(bare.filter("tokens > 0"), "tokens")
    leaves = leaf_budgets(bare, weights, total, epochs).withColumn("full_epochs", F.expr("budget div supply")).withColumn("last", F.expr("budget % supply"))
    # a leaf may hold a third of all rows; leaves are few, so their table is broadcast where it is small and AQE splits the rest
    drawn = bare.join(leaves.select(*LEVELS, "budget", "full_epochs", "last"), list(LEVELS))
    # whole epochs take every document in any order; the partial one, number full_epochs, has a shuffle of its own
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("full_epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    out = running_sum(drawn.withColumn("_key", key), LEVELS, ["_key", "doc_id", "tokens", "text_hash"], "tokens", "_before")
    out = out.withColumn("part_tokens", F.greatest(F.lit(0), F.least("tokens", F.col("last") - F.col("_before"))).cast("long"))
    return out.filter("full_epochs > 0 OR part_tokens > 0").select("doc_id", "text_hash", *LEVELS, "tokens", "budget", "full_epochs", "part_tokens")


def mix(docs: DataFrame, weights: Sequence[Mapping[str, int]] = WEIGHTS, total: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs in the mixture, each as often as it is taken; a document that the last prefix ends in stays whole.

    Rows with equal doc_id and text are taken as one, which has the other columns of the first by their JSON.
    """
    chosen = choose(docs, weights, total, epochs, seed)
    row, times, nth, copy = (unused(docs.columns, name) for name in ("_row", "_times", "_nth", "_copy"))
    taken = chosen.groupBy("doc_id", "text_hash").agg(F.sum(F.col("full_epochs") + (F.col("part_tokens") > 0).cast("long")).cast("int").alias(times))
    taken = taken.select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_hash").alias(row), times)
    keyed = docs.withColumn(row, F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").alias("text_hash")))
    others = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias(nth)))
    one = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(others))).filter(F.col(nth) == 1)
    return one.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose(read_table(spark, sf_dir, "documents")).drop("text_hash")


def _level_sql(name: str, parent: list[str], level: str, weights: Mapping[str, int], budget: str) -> str:
    group = f"PARTITION BY {', '.join(parent)}" if parent else ""
    keys = ", ".join([*parent, level])
    case = f"CASE {level} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in weights.items()) + " ELSE 1 END"
    join = f"JOIN {budget} USING ({', '.join(parent)})" if parent else f", {budget}"
    return f"""
{name}_a AS (SELECT {keys}, sum(supply)::BIGINT * {EPOCHS} AS cap, ({case})::BIGINT AS w FROM leaves GROUP BY {keys}),
{name}_b AS (
  SELECT {name}_a.*, least(given, sum(cap) OVER ({group}))::BIGINT AS budget,
         coalesce(sum(cap) OVER ({group} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c0,
         sum(w) OVER ({group} ORDER BY cap::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w0
  FROM {name}_a {join}
), {name}_c AS (SELECT *, c0 * w + cap * w0 <= budget * w AS filled FROM {name}_b
), {name}_d AS (
  SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({group}), 0)::BIGINT AS rest, sum(CASE WHEN NOT filled THEN w END) OVER ({group})::BIGINT AS open_w FROM {name}_c
), {name}_e AS (
  SELECT *, CASE WHEN filled THEN cap ELSE rest * w // open_w END AS part, CASE WHEN filled THEN -1 ELSE rest * w % open_w END AS odd FROM {name}_d
), {name} AS (
  SELECT {keys}, part + CASE WHEN odd >= 0 AND row_number() OVER ({group} ORDER BY odd DESC, {level}) <= budget - sum(part) OVER ({group}) THEN 1 ELSE 0 END AS given FROM {name}_e
)"""


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = f"""
WITH bare AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::INTEGER % 4) END AS domain,
         lang, source, CASE WHEN trim(text, {_WS}) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, {_WS}), '[ \\t\\n\\x0b\\f\\r]+')) END::BIGINT AS tokens
  FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
), docs AS (SELECT * FROM bare WHERE tokens > 0
), leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM docs GROUP BY ALL
), root AS (SELECT sum(supply)::BIGINT AS given FROM leaves
), {_level_sql("l1", [], "domain", WEIGHTS[0], "root")}, {_level_sql("l2", ["domain"], "lang", WEIGHTS[1], "l1")}, {_level_sql("l3", ["domain", "lang"], "source", WEIGHTS[2], "l2")},
queued AS (
  SELECT docs.*, given AS budget, given // supply AS full_epochs, given % supply AS last,
         sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || (given // supply) || ':' || doc_id), doc_id, tokens) - tokens AS before
  FROM docs JOIN leaves USING (domain, lang, source) JOIN l3 USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, budget::BIGINT AS budget, full_epochs::BIGINT AS full_epochs, greatest(0, least(tokens, last - before))::BIGINT AS part_tokens
FROM queued WHERE full_epochs > 0 OR last > before"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {"op2_mixing": ORACLE}
