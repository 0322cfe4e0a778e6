"""Chat formatting of reply trees.

messages(tree, id, parent, role, text, score) form trees. Self-joins that double their reach (1, 2, 4, ... steps up) tell each
message its depth and the sum of scores on its way to the root; messages without replies end a branch, and the branches of a tree are ranked
by their mean score. The same doubled steps, largest first, enumerate the messages of every chosen root-to-leaf
path, each once. A path is formatted as one conversation: pieces, one a turn, whose texts follow each other without a gap.

The template writes a turn as `### role: text</turn>` and a line feed. Control strings inside of texts, and backslashes, get a backslash
before them, in roles colons as well, so marks are told from words and reading takes nothing else away. The loss mask
covers what assistants say, as it stands between the marks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import read_table, running_sum
from weftwork.operators.rounds import cut, drop_scratch

OPEN, SAYS, CLOSE = "### ", ": ", "</turn>\n"
#: What is escaped in texts; in roles a colon too.
CONTROL = r"(\\|### |</turn>)"
ROLE_CONTROL = r"(\\|### |</turn>|:)"


def escaped(s: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(s, control, r"\\$1")


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def _keyed(messages: DataFrame) -> DataFrame:
    """One row for each (tree, id), the least of those that share them; t names the tree without nulls; a parent that is not there is none."""
    t = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")).alias("t")
    rows = messages.filter("id IS NOT NULL").select(t, "tree", "id", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    one = rows.groupBy("t", "id").agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("_m")).select("t", "id", "_m.*")
    there = one.select("t", F.col("id").alias("parent"), F.lit(True).alias("_there"))
    return one.join(there, ["t", "parent"], "left").withColumn("parent", F.when(F.col("_there"), F.col("parent"))).drop("_there")


def ways_up(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(t, id, depth, total) of each of nodes(t, id, parent, score) that has a way to a root, tables (t, id, up) of 1, 2, 4, ... steps up, and the scratch tables behind them.

    depth counts the messages of the way and total sums their scores. A round joins only the messages that have not come to a root
    yet. Where parents go round in a circle none does: the rounds end after as many doublings as there can be messages in a tree.
    """
    scratch = [cut(nodes.select("t", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "up")]
    largest = scratch[0].groupBy("t").count().agg(F.max("count")).first()[0] or 0
    done, steps = [scratch[0].filter("up IS NULL")], []
    for _ in range(max(1, int(largest)).bit_length()):
        under = scratch[-1].filter("up IS NOT NULL")
        if under.isEmpty():
            break
        steps.append(under.select("t", "id", "up"))
        known = under
        for table in done:
            known = known.unionByName(table)
        known = known.select("t", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        further = under.join(known, ["t", "up"]).select("t", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        scratch.append(cut(further, "up"))
        done.append(scratch[-1].filter("up IS NULL"))
    state = done[0]
    for table in done[1:]:
        state = state.unionByName(table)
    return state.drop("up"), steps, scratch


def formatted_paths(messages: DataFrame, per_tree: int | None = None) -> DataFrame:
    """The conversations of messages(tree, id, parent, role, text, score), as pieces: tree, leaf, rank, pos, start, piece, mask_start, mask_end.

    One row a turn. A conversation is a path from a root (parent null or absent) to a message without replies; rank numbers the paths of a tree from 0 by
    descending mean score (null: 0), then by leaf; per_tree keeps the first so many. pos numbers turns from 0; start is the code points before
    the piece; mask_start and mask_end bound what the loss is taken of, within the whole conversation, and are null for turns
    of others. Null role or text is empty; rows with a null tree make one tree; rows without id go; of rows that share tree and id the least by parent,
    role and text counts; messages on or above a circle of parents are in no path; empty input gives an empty result; other columns are not read.

    No task holds a path: ranks and starts are running sums over ranges, and turns stay rows.
    """
    nodes = cut(_keyed(messages), "messages")
    state, steps, scratch = ways_up(nodes)
    answered = nodes.filter("parent IS NOT NULL").select("t", F.col("parent").alias("id"))
    leaves = state.join(answered, ["t", "id"], "left_anti")
    leaves = leaves.select("t", F.col("id").alias("leaf"), F.col("depth"), (-F.col("total") / F.col("depth")).alias("_score"), F.lit(1).alias("_one"))
    chosen = running_sum(leaves, ["t"], ["t", "_score", "leaf"], "_one", "rank").drop("_one", "_score")
    chosen = cut(chosen if per_tree is None else chosen.filter(F.col("rank") < per_tree), "chosen")
    path = chosen.select("t", "leaf", "rank", F.col("leaf").alias("id"), (F.col("depth") - 1).alias("pos"))
    for k in reversed(range(len(steps))):
        here, above = F.struct("id", "pos"), F.struct(F.col("_up").alias("id"), (F.col("pos") - 2**k).alias("pos"))
        both = path.join(steps[k].withColumnRenamed("up", "_up"), ["t", "id"], "left")
        both = both.withColumn("_at", F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, above)))
        path = both.select("t", "leaf", "rank", F.explode("_at").alias("_at")).select("t", "leaf", "rank", "_at.*")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head, body = F.concat(F.lit(OPEN), escaped(role, ROLE_CONTROL), F.lit(SAYS)), escaped(text)
    turns = nodes.select("t", "id", "tree", head.alias("_head"), body.alias("_body"), (role == "assistant").alias("_learn"))
    pieces = path.join(turns, ["t", "id"]).withColumn("piece", F.concat("_head", "_body", F.lit(CLOSE)))
    pieces = pieces.select("t", "tree", "leaf", "rank", "pos", "piece", F.length("piece").alias("_n"), F.length("_head").alias("_before"), F.length("_body").alias("_said"), "_learn")
    pieces = pieces.withColumn("_path", F.concat_ws("\u0000", "t", F.col("leaf").cast("string")))
    placed = running_sum(pieces, ["_path"], ["t", "leaf", "pos"], "_n", "start")
    mask = F.when(F.col("_learn"), F.col("start") + F.col("_before"))
    out = cut(placed.select("tree", "leaf", "rank", "pos", "start", "piece", mask.alias("mask_start"), (mask + F.col("_said")).alias("mask_end")), "pieces")
    drop_scratch(nodes, chosen, *scratch)
    return out


def assembled(pieces: DataFrame) -> DataFrame:
    """tree, leaf, rank, text, mask: each conversation as one text with its masked spans. For conversations that fit in a task."""
    items = F.sort_array(F.collect_list(F.struct("pos", "piece", F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end")).alias("span"))))
    whole = pieces.groupBy("tree", "leaf", "rank").agg(items.alias("_p"))
    spans = F.filter(F.transform("_p", lambda p: p["span"]), lambda s: s["start"].isNotNull())
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("text"), spans.alias("mask"))


def _end(text: str, mark: str, at: int) -> int:
    """Where the next mark without a backslash of its own stands; -1 if there is none."""
    while (at := text.find(mark, at)) >= 0:
        slashes = at
        while slashes and text[slashes - 1] == "\\":
            slashes -= 1
        if (at - slashes) % 2 == 0:
            return at
        at += 1
    return -1


class Reader:
    """Reads a conversation, fed in parts, back into its turns; holds no more than the turn under way."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.learned = "", 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, part: str, spans: list[tuple[int, int]]) -> None:
        """part with the masked spans (start, end) that lie in it, counted from the start of the conversation."""
        for a, b in spans:
            text = unescaped(part[a - self.chars : b - self.chars])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.chars += len(part)
        text, at = self.rest + part, 0
        while (end := _end(text, CLOSE, at)) >= 0:
            says = _end(text, SAYS, at)
            if not text.startswith(OPEN, at) or not 0 <= says < end:
                raise ValueError(f"no turn at {text[at : at + 40]!r}")
            role, body = unescaped(text[at + len(OPEN) : says]), unescaped(text[says + len(SAYS) : end])
            self.said.update(f"{role}\n{body}\n".encode())
            self.turns += 1
            at = end + len(CLOSE)
        self.rest = text[at:]

    def result(self) -> dict:
        if self.rest:
            raise ValueError(f"open turn {self.rest[:40]!r}")
        return {"n_turns": self.turns, "turns_sha256": self.said.hexdigest(), "loss_chars": self.learned, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_READ = "tree long, leaf long, rank long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, reader, rows = None, Reader(), []

    def made() -> pa.RecordBatch:
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
        return pa.RecordBatch.from_pydict({c: [r[c] for r in rows] for c in names}, schema=pa.schema(list(zip(names, kinds, strict=True))))

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("tree", "leaf", "rank", "piece", "mask_start", "mask_end")]
        for tree, leaf, rank, piece, a, b in zip(*columns, strict=True):
            if key is not None and key != (tree, leaf, rank):
                rows.append(dict(zip(("tree", "leaf", "rank"), key, strict=True)) | reader.result())
                reader = Reader()
            key = (tree, leaf, rank)
            reader.feed(piece, [] if a is None else [(a, b)])
        if rows:
            yield made()
            rows = []
    if key is not None:
        rows.append(dict(zip(("tree", "leaf", "rank"), key, strict=True)) | reader.result())
        yield made()


def read_back(pieces: DataFrame) -> DataFrame:
    """tree, leaf, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and its mask alone.

    A digest takes its conversation in order, so one task reads it, part by part; it holds one turn at a time. tree and leaf are longs.
    """
    dealt = pieces.select(F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"), "rank", "pos", "piece", "mask_start", "mask_end")
    return dealt.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "pos").drop("pos").mapInArrow(_read, _READ)


def as_chains(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as trees without branches: each turn replies to the one before it, nulls first, ties by role and text."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("_one"))
    rows = rows.withColumn("_t", F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("")))
    counted = running_sum(rows, ["_t"], ["_t", "turn", "role", "text"], "_one", "id")
    return counted.select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


TRAP = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], turns.schema)
    pieces = formatted_paths(as_chains(turns.unionByName(trap)))
    return read_back(pieces).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {"op11_chat_format": op11_chat_format}
ORACLE_SQL = {
    "op11_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|### |</turn>')) + length(role) + len(regexp_extract_all(role, '\\|### |</turn>|:')) + 14 AS n FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
}
