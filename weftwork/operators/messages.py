"""Message logs: filters, appends, link segments, replies of a remote agent, and the replay of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.scalars import JS_LINE_END, JS_SPACE, first_filled, index_of, js_split, js_substring, js_trim, replace_first, utf16_length

# fixed values: marks of the agent's replies
MESSAGE_MARK, DONE_MARK = "event: message data:", "event: done data:"
PROMPT_MARK, END_MARK = "prompt.", "[DONE]"
SYSTEM_MARK, INTENT_MARK, LINE_MARK = "SYSTEM MESSAGE", "map_intent", "data: "
NO_ANSWER = "I don't know what to do with this prompt."
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
ROLES = ("user", "assistant")


def drop_transient(messages: DataFrame, flag: str = "is_typing") -> DataFrame:
    """Rows whose flag is not true; a null flag is not true."""
    return messages.filter(~F.coalesce(flag, F.lit(False)))


def append_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Both, with nulls for columns that one side lacks; nothing is merged."""
    return log.unionByName(rows, allowMissingColumns=True)


def roles_outside(messages: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Rows whose role is null or none of those allowed."""
    return messages.filter(~F.coalesce(F.col("role").isin(*roles), F.lit(False)))


def joined_text(messages: DataFrame, key: str, order: str, text: str, separator: str) -> DataFrame:
    """(key, joined): the texts of each key in order. A log of one key is one document and is meant to fit in a task."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return messages.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x[text]), separator).alias("joined"))


def segments(text: Column) -> Column:
    """Text and links in turn: an array of (kind, text, target). A text without links is one segment as it is, an empty one too."""
    kind = "array<struct<kind string, text string, target string>>"
    between = F.split(text, LINK, -1)
    links = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))

    def pair(i: Column) -> Column:
        part, link = F.get(between, i), F.get(links, i)
        plain = F.struct(F.lit("text").alias("kind"), part.alias("text"), F.lit(None).cast("string").alias("target"))
        linked = F.struct(F.lit("link").alias("kind"), F.regexp_extract(link, LINK, 1).alias("text"), F.regexp_extract(link, LINK, 2).alias("target"))
        some = F.when(part != "", F.array(plain)).otherwise(F.array().cast(kind))
        return F.concat(some, F.when(link.isNotNull(), F.array(linked)).otherwise(F.array().cast(kind)))

    whole = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("target")))
    found = F.flatten(F.transform(F.sequence(F.lit(0), F.size(between) - 1), pair))
    return F.when(F.size(links) == 0, whole).otherwise(found)


def link_segments(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row a segment: pos, kind, text and target take the place of the text and of columns so named."""
    rest = [c for c in messages.columns if c not in (text, "pos", "kind", "target")]
    return messages.select(*rest, F.posexplode(segments(F.col(text))).alias("pos", "_segment")).select(*rest, "pos", "_segment.*")


def event_payloads(raw: Column) -> Column:
    """Payloads of server-sent `message` events, in order: events are parted by blank lines; the data lines of an
    event are joined; system notices, the end mark and blank payloads are left out."""

    def field(event: Column, name: str) -> Column:
        lines = F.filter(js_split(event, "\n"), lambda x: F.startswith(x, F.lit(name + ":")))
        return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.substring(x, F.lit(len(name) + 2), F.length(x)), "^ ", "")), "\n")

    events = F.filter(F.split(raw, "\n\n", -1), lambda e: field(e, "event") == "message")
    data = F.transform(events, lambda e: field(e, "data"))
    return F.filter(data, lambda d: (js_trim(d) != "") & (d != END_MARK) & ~F.contains(d, F.lit(SYSTEM_MARK)))


def data_lines(raw: Column) -> Column:
    """Trimmed payloads of the lines that carry an answer."""
    lines = F.filter(
        js_split(raw, "\n"),
        lambda x: F.startswith(x, F.lit(LINE_MARK)) & ~F.contains(x, F.lit(SYSTEM_MARK)) & ~F.contains(x, F.lit(END_MARK)) & ~F.contains(x, F.lit(INTENT_MARK)) & (utf16_length(x) > 10),
    )
    return F.filter(F.transform(lines, lambda x: js_trim(F.substring(x, F.lit(len(LINE_MARK) + 1), F.length(x)))), lambda x: x != "")


def _between(raw: Column, start: str, end: str) -> Column:
    a, b = index_of(raw, start), index_of(raw, end)
    return F.when((a != -1) & (b != -1), js_trim(js_substring(raw, a + len(start), b)))


def answer_text(raw: Column) -> Column:
    """The answer in a reply, by the first of four ways that applies; an empty answer counts as found."""
    lines = data_lines(raw)
    bare = raw
    for noise in (INTENT_MARK, NO_ANSWER, END_MARK):
        bare = replace_first(bare, noise, "")
    bare = F.regexp_replace(F.regexp_replace(bare, f"event:[^{JS_LINE_END}]*?data:", ""), f"SYSTEM MESSAGE[^{JS_LINE_END}]*?\\]", "")
    return F.coalesce(
        _between(raw, MESSAGE_MARK, DONE_MARK),
        _between(raw, PROMPT_MARK, END_MARK),
        F.when(F.size(lines) > 0, F.array_join(lines, " ")),
        F.regexp_replace(js_trim(bare), f"[{JS_SPACE}]+", " "),
    )


def reply_content(raw_json: Column) -> Column:
    """message, content or text of a JSON reply, whichever is filled first, else the reply itself."""
    fields = F.from_json(raw_json, "message string, content string, text string")
    return F.coalesce(first_filled(fields["message"], fields["content"], fields["text"]), raw_json)


def replay(events: DataFrame) -> DataFrame:
    """The log of each conversation after its last event: events(conv_id, seq, kind, role, text) to (conv_id, seq, role, text, is_typing).

    `reset` drops what came before; `ask` adds the question and a placeholder; `answer` and `error` drop every
    placeholder and add a reply. So a placeholder is left only if no reply follows it.
    """
    w = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = events.withColumn("_reset", F.max(F.when(F.col("kind") == "reset", F.col("seq"))).over(w)).withColumn("_reply", F.max(F.when(F.col("kind").isin("answer", "error"), F.col("seq"))).over(w))
    live = at.filter((F.col("kind") != "reset") & (F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))))
    said = live.select("conv_id", "seq", "role", "text", F.lit(None).cast("boolean").alias("is_typing"))
    waits = live.filter((F.col("kind") == "ask") & (F.col("_reply").isNull() | (F.col("seq") > F.col("_reply"))))
    return said.unionByName(waits.select("conv_id", "seq", F.lit("assistant").alias("role"), F.lit("").alias("text"), F.lit(True).alias("is_typing")))


def overlapping_asks(events: DataFrame) -> DataFrame:
    """Questions put while the one before had no reply yet; a reset ends what is open."""
    w = Window.partitionBy("conv_id").orderBy("seq")
    return events.filter(F.col("kind").isin("ask", "answer", "error", "reset")).withColumn("_before", F.lag("kind").over(w)).filter("kind = 'ask' AND _before = 'ask'").drop("_before")
