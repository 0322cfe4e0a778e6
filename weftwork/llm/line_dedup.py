"""Line dedup over levelled sorted runs of line hashes.

A run is a table of 128-bit line hashes with the smallest document that holds each, bucketed and sorted by
the hash. A batch is merge-anti-joined with the runs of every level; what remains is new and becomes a run
of level 0. Once a level holds `fanout` runs they are merged into one run of the next level, so a hash is
rewritten once a level and a lookup meets few runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import ASCII_SPACE, ascii_lower, read_table, skew_join, unused
from weftwork.operators.rounds import cut, delete, drop_scratch, scratch_path, shuffles_end

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds."""
    return F.xxhash64(key), F.xxhash64(F.lit(40_503), key)


class HashRuns:
    """The levels of runs. `buckets` is fixed for the life of the store; by default it is the number of
    shuffle partitions, so that aggregated batches already lie as the runs do."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        with shuffles_end(self.spark):
            rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose hash no run holds. Keys are dealt once; each run joins where it lies."""
        for name in self.tables():
            keys = keys.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, rows: DataFrame) -> None:
        """Adds unseen (h1, h2, owner) rows as a run and compacts the levels that are full."""
        put, level = self._write(rows), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(put)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for name in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(name))
            put, old, level = self._write(merged.repartition(self.buckets, *HASH)), self.levels[level], level + 1
            self.levels[level - 1] = []
            for name in old:
                self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.paths.pop(name))

    def drop(self) -> None:
        for name in self.tables():
            self._drop(name)
        self.levels = []


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, buckets: int | None = None) -> DataFrame:
    """docs with `text` without repeated lines and with n_lines, n_dropped (both long).

    Lines are split at \\n. A line whose key (ASCII white space stripped, A-Z lower-cased) has min_chars code
    points or more and occurs in several doc_ids stays only in the smallest of them, there as often as it
    occurs. Null text counts as one empty line and stays null; rows that repeat a doc_id are one document in this
    respect and each keeps its row; rows without doc_id are left as they are. An empty table gives an
    empty result. Columns named n_lines or n_dropped are replaced; all others pass through.

    Documents come in batches by ascending doc_id, so a hash that an earlier run holds belongs to a smaller one: its
    lines go from the whole batch. A hash that the runs lack stays with the smallest document of the batch.
    """
    spark = docs.sparkSession
    h1, h2 = _hashes(F.col("key"))
    bounds = docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = sum(((F.col("doc_id") > int(x)).cast("int") for x in sorted(set(bounds))), F.lit(0))
    # a line is known by its document, the hash of its text (several texts may share a doc_id) and its position
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = cut(lines.select("doc_id", "text_hash", "pos", batch.alias("batch"), h1.alias("h1"), h2.alias("h2")), "lines")
    runs, repeated = HashRuns(spark, buckets, fanout), []
    for b in range(len(set(bounds)) + 1):
        keys = lines.filter(F.col("batch") == b).groupBy(*HASH).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("_last"), F.count("*").alias("n"))
        keys = cut(keys, "keys")
        new = cut(runs.unseen(keys), "unseen")
        seen = keys.join(new, HASH, "left_anti").withColumn("owner", F.lit(None).cast("long"))
        repeated.append(cut(seen.unionByName(new.filter("owner < _last")).select(*HASH, F.lit(b).alias("batch"), "owner", "n"), "repeated"))
        runs.add(new.select(*HASH, "owner"))
        drop_scratch(keys, new)
    runs.drop()
    tables = repeated
    repeated = reduce(DataFrame.unionByName, tables)
    extra = skew_join(lines, repeated, [*HASH, "batch"], "n").filter("owner IS NULL OR doc_id > owner")
    rest = docs.drop("n_lines", "n_dropped")
    hashed, gone, split = (unused(rest.columns, name) for name in ("_text_hash", "_gone", "_split"))
    drops = cut(extra.groupBy("doc_id", F.col("text_hash").alias(hashed)).agg(F.array_sort(F.collect_set("pos")).alias(gone)), "drops")
    drop_scratch(lines, *tables)
    out = rest.withColumn(hashed, F.xxhash64("text")).join(drops, ["doc_id", hashed], "left").withColumn(split, _lines(F.col("text")))
    # what stays are the runs of lines between those that go
    before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(F.col(gone), F.array(F.size(split)))
    kept = F.array_join(F.flatten(F.zip_with(before, after, lambda p, q: F.slice(F.col(split), p + 2, q - p - 1))), "\n")
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    return out.select(*rest.columns, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def dedup_sql(table: str) -> str:
    """The rule of op1 in SQL: every row of `table` with kept text, n_lines and n_dropped."""
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, * FROM {table}
), lines AS (
  SELECT row_id, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
), kept AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE dropped IS NOT TRUE), '') AS kept
  FROM owned GROUP BY row_id
)"""


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": dedup_sql("documents") + """
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256
FROM docs JOIN kept USING (row_id)"""
}
