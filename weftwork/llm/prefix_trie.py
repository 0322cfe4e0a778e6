"""The trie of conversation prefixes, by peeling truncations from the deepest turn up.

A conversation becomes the list of its prefixes' keys, 128 bits each, a hash over the key before, role and text. Conversations with the same turns collapse
to one ended row. From the maximum depth down, the conversations that end at a depth meet the nodes that survive from below, are grouped by
their last key and so make that depth's nodes with all their sums; then each node's last turn is stripped and it survives as part of its
parent. Every node is found and summed in this one pass.

Where the rows below every node LEVELS - 1 turns further up are few (ROWS keys at most, by a count), a task peels those LEVELS turns at
once for each such node; else one turn is peeled by one aggregation, summed in part before it is shuffled, so a prefix that a
third of all conversations share is no hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import CRC_TABLE, crc_sql, read_table, running_sum
from weftwork.operators.rounds import cut, drop_scratch

LEVELS, ROWS = 32, 100_000
NOTHING = hashlib.sha256().hexdigest()

_PATHS = "conv_id long, keys array<binary>, sizes array<long>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of conversations and turns; one without a turn has a null role."""
    made: dict[str, list] = {"conv_id": [], "keys": [], "sizes": []}
    schema = pa.schema([("conv_id", pa.int64()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
    held = 0
    for batch in batches:
        for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if not made["conv_id"] or made["conv_id"][-1] != conv:
                if held > 100_000:
                    yield pa.RecordBatch.from_pydict(made, schema=schema)
                    made, held = {"conv_id": [], "keys": [], "sizes": []}, 0
                made["conv_id"].append(conv)
                made["keys"].append([])
                made["sizes"].append([])
            if role is not None:
                keys = made["keys"][-1]
                before = keys[-1] if keys else b""
                keys.append(hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16, key=before).digest())
                made["sizes"][-1].append(len(text))
                held += 1
    if made["conv_id"]:
        yield pa.RecordBatch.from_pydict(made, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of each end's list, in order, to its digest; one hash state is all that is held."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        keys, shas = [], []
        for end, ids in zip(batch["end"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if end != key:
                if key is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = end, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"end": keys, "sha": shas}, schema=pa.schema([("end", pa.binary()), ("sha", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pydict({"end": [key], "sha": [state.hexdigest()]}, schema=pa.schema([("end", pa.binary()), ("sha", pa.string())]))


def ended(paths: DataFrame) -> DataFrame:
    """One row for each sequence of turns at which conversations end: depth, keys, sizes, n, least, kids, leaves, saved, sha.

    sha is the digest of the members' ids in ascending order. Ids are dealt by ranges, each range writes its part of a list, and only the
    parts of one list meet in a task.
    """
    spark = paths.sparkSession
    ends = paths.select("conv_id", F.coalesce(F.element_at("keys", F.nullif(F.size("keys"), F.lit(0))), F.lit(b"")).alias("end"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(paths.count() / 20_000))
    dealt = cut(ends.repartitionByRange(parts, "end", "conv_id").withColumn("range", F.spark_partition_id()), "ends")
    listed = dealt.groupBy("end", "range").agg(F.array_sort(F.collect_list("conv_id")).alias("_ids"))
    text = F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",")
    listed = cut(listed.select("end", "range", text.alias("ids"), F.size("_ids").cast("long").alias("n"), F.element_at("_ids", 1).alias("least")), "lists")
    sums = listed.groupBy("end").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    shas = listed.select("end", "range", "ids").repartition("end").sortWithinPartitions("end", "range").select("end", "ids").mapInArrow(_digests, "end binary, sha string")
    whole = sums.join(shas, "end").join(paths.withColumnRenamed("conv_id", "least"), "least")
    zero = F.lit(0).cast("long")
    rows = whole.select(F.size("keys").alias("depth"), "keys", "sizes", "n", "least", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "sha")
    out = cut(rows.repartitionByRange("depth", "least").sortWithinPartitions("depth"), "ended")
    drop_scratch(dealt, listed)
    return out


_NODE = "depth int, key binary, parent binary, n long, least long, kids long, leaves long, saved long, sha string, keys array<binary>, sizes array<long>"
_NODE_SCHEMA = pa.schema([
    ("depth", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()),
    ("sha", pa.string()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())),
])


def _peel(low: int):
    """Peels the turns from the deepest down to `low` of groups of rows that share the key at low; a group's rows follow each other."""

    def group(rows: list[dict]) -> Iterator[dict]:
        ends: dict[int, list[dict]] = {}
        for r in rows:
            ends.setdefault(len(r["keys"]), []).append(r)
        live: list[dict] = []
        for depth in range(max(ends), low - 1, -1):
            nodes: dict[bytes, dict] = {}
            for r in live + ends.get(depth, []):
                node = nodes.get(key := r["keys"][depth - 1])
                if node is None:
                    nodes[key] = dict(r)
                    continue
                for c in ("n", "kids", "leaves", "saved"):
                    node[c] += r[c]
                node["least"], node["sha"] = min(node["least"], r["least"]), node["sha"] or r["sha"]
            live = []
            for key, node in nodes.items():
                node["saved"] += (node["n"] - 1) * node["sizes"][depth - 1]
                node["leaves"] = node["leaves"] or 1
                parent = node["keys"][depth - 2] if depth > 1 else b""
                top = depth == low
                yield node | {"depth": depth, "key": key, "parent": parent, "keys": node["keys"][: depth - 1] if top else None, "sizes": node["sizes"][: depth - 1] if top else None}
                live.append(node | {"kids": 1, "sha": None})

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        done: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[-1]["keys"][low - 1] != r["keys"][low - 1]:
                    done += group(rows)
                    rows = []
                rows.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_NODE_SCHEMA)
                done = []
        if rows:
            yield pa.RecordBatch.from_pylist(list(group(rows)), schema=_NODE_SCHEMA)

    return peel


def _peel_one(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of one depth, by one aggregation; all rows have keys as deep at least as depth."""
    sums = rows.groupBy(F.element_at("keys", depth).alias("key")).agg(
        F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("least").alias("least"), F.max("sha").alias("sha"),
    )
    saved = F.col("saved") + (F.col("n") - 1) * F.element_at("sizes", depth)
    parent = F.element_at("keys", depth - 1) if depth > 1 else F.lit(b"")
    shorter = [F.slice(c, 1, depth - 1).alias(c) for c in ("keys", "sizes")]
    return sums.select(F.lit(depth).alias("depth"), "key", parent.alias("parent"), "n", "least", "kids", F.greatest("leaves", F.lit(1)).alias("leaves"), saved.alias("saved"), "sha", *shorter)


def prefix_trie(turns: DataFrame, levels: int = LEVELS, limit: int = ROWS) -> DataFrame:
    """The nodes of the trie of turns(conv_id, pos, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first d turns (role, text) of conversations, its members those that start with it. conv_id is its
    smallest member, parent_conv_id its parent's (root: null), n_leaves the childless nodes of its subtree, itself included,
    saved_tokens the sum over its subtree of (n_convs - 1) times the UTF-8 bytes of the last text; ends_sha256 the digest of the comma-joined ids
    of members that end there. Turns come by pos, nulls first, ties by role and text; repeated rows are turns of their own. A null
    text is empty, a null role too; a conversation is turnless if its only row has pos, role and text null, and then belongs to the root
    alone. Rows without conv_id are in no conversation; no conversations, no root. Other columns are not read.

    The keys of one conversation, 40 bytes or so a turn, are held by a task.
    """
    spark = turns.sparkSession
    bare = F.expr("pos IS NULL AND role IS NULL AND text IS NULL")
    binary = [F.when(~bare, F.coalesce(c, F.lit("")).cast("binary")).alias(c) for c in ("role", "text")]
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "pos", *binary)
    paths = cut(rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "role", "text").drop("pos").mapInArrow(_paths, _PATHS), "paths")
    ends = ended(paths)
    drop_scratch(paths)
    columns = ["depth", "keys", "sizes", "n", "least", "kids", "leaves", "saved", "sha"]
    live = spark.createDataFrame([], ends.schema).select(*columns)
    depth = ends.agg(F.max("depth")).first()[0] or 0
    peeled = []
    while depth:
        low = max(1, depth - levels + 1)
        rows = live.unionByName(ends.filter(F.col("depth").between(low, depth)))
        most = rows.groupBy(F.element_at("keys", low).alias("k")).agg(F.sum("depth").alias("keys")).agg(F.max("keys")).first()[0] if levels > 1 else None
        if most is not None and most <= limit:
            dealt = rows.drop("depth").withColumn("_top", F.element_at("keys", low)).repartition("_top").sortWithinPartitions("_top").drop("_top")
            nodes = cut(dealt.mapInArrow(_peel(low), _NODE), "nodes")
        else:
            low = depth
            nodes = cut(_peel_one(live.unionByName(ends.filter(F.col("depth") == depth)), depth), "nodes")
        peeled.append(nodes)
        depth = low - 1
        stripped = nodes.filter(F.col("depth") == low)
        live = stripped.select(F.lit(depth).alias("depth"), "keys", "sizes", "n", "least", F.lit(1).cast("long").alias("kids"), "leaves", "saved", F.lit(None).cast("string").alias("sha"))
    at_root = live.unionByName(ends.filter("depth = 0"))
    root = at_root.agg(*(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")), F.min("least").alias("least"), F.max("sha").alias("sha")).filter("n IS NOT NULL")
    root = root.select(F.lit(0).alias("depth"), F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("parent"), "n", "least", "kids", F.greatest("leaves", F.lit(1)).alias("leaves"), "saved", "sha")
    for nodes in peeled:
        root = root.unionByName(nodes.drop("keys", "sizes"))
    nodes = cut(root, "trie")
    drop_scratch(ends, *peeled)
    above = nodes.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The query's conversations, as turns(conv_id, pos, role, text): the first h turns of conversation c - c % 5, then those of c after its first h, h = crc32(c) % 9."""
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("_one"))
    own = cut(running_sum(rows, ["conv_id"], ["conv_id", "turn", "role", "text"], "_one", "i").select("conv_id", "i", "role", "text"), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    ids = own.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    heads = own.filter("conv_id % 5 = 0 AND i < 8").withColumnRenamed("conv_id", "base").join(ids, "base").filter("i < h").select("conv_id", F.col("i").alias("pos"), "role", "text")
    tails = own.withColumn("h", h).filter("i >= h").select("conv_id", (F.col("i") + 8).alias("pos"), "role", "text")
    turns = heads.unionByName(tails)
    turnless = ids.select("conv_id").join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    none = F.lit(None).cast("string")
    return turns.unionByName(turnless.select("conv_id", F.lit(None).cast("long").alias("pos"), none.alias("role"), none.alias("text")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(read_table(spark, sf_dir, "conversations")))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": f"""
WITH {CRC_TABLE}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id AS c, {crc_sql("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), built AS (
  SELECT c, 0 AS part, i, role, text FROM convs JOIN turns ON conv_id = c - c % 5 AND i <= h
  UNION ALL SELECT c, 1, i, role, text FROM convs JOIN turns ON conv_id = c AND i > h
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM built
), prefixes AS (
  SELECT c, d, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY d) AS key, octet_length(encode(text)) AS bytes FROM counted
  UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (
  SELECT d, key, min(c) AS least, count(*) AS n, any_value(bytes) AS bytes, left(key, greatest(0, (d - 1) * 128)::BIGINT) AS parent FROM prefixes GROUP BY d, key
), ends AS (
  SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(key, d) AS key FROM prefixes GROUP BY c) GROUP BY key
), kids AS (
  SELECT parent AS key, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
  SELECT p.key, sum((x.n - 1) * x.bytes) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM nodes x JOIN prefixes p ON p.c = x.least AND p.d <= x.d LEFT JOIN kids ON kids.key = x.key GROUP BY p.key
)
SELECT x.least AS conv_id, x.d::BIGINT AS depth, up.least AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM nodes x LEFT JOIN nodes up ON x.d > 0 AND up.key = x.parent LEFT JOIN kids ON kids.key = x.key JOIN below ON below.key = x.key LEFT JOIN ends ON ends.key = x.key"""
}
