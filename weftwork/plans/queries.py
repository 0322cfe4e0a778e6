"""One query for each operator on the nearest of the given tables, with the SQL that checks it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions import scalars as S
from weftwork.operators import messages as M
from weftwork.operators import ontology as O
from weftwork.operators import affinity, mapping, paths, search, shapes, versions, wiki
from weftwork.operators import quality as Q
from weftwork.operators.rounds import scratch_path
from weftwork.plans import graph
from weftwork.sources import files, ledger, ontology_yaml, page_files as page_sink
from weftwork.streaming import messages as stream_messages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- text functions ------------------------------------------------------------------------------


@query("SELECT regexp_replace(replace(lower(p_name), '_', '-'), '[^a-z0-9-]', '', 'g') AS slug, count(*) AS n FROM part GROUP BY 1")
def slug_part_name(spark, sf_dir):
    return _table(spark, sf_dir, "part").groupBy(S.slug(F.col("p_name")).alias("slug")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || '  ' || p_type), '\\s+', '-', 'g') AS slug FROM part")
def dash_slug_part(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.dash_slug(F.concat("p_name", F.lit("  "), "p_type")).alias("slug"))


@query("SELECT doc_id, CASE WHEN contains(text, 'the') THEN regexp_replace(text, 'the', 'THE') ELSE text END AS text FROM documents")
def replace_first_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.replace_first(F.col("text"), "the", "THE").alias("text"))


@query("SELECT event_id, substring(event_type, least(greatest(event_id % 7 - 1, 0), length(event_type))::INTEGER + 1, 0) AS none, CASE WHEN event_id % 7 > 3 THEN substring(event_type, 4, (least(event_id % 7, length(event_type)) - 3)::INTEGER) ELSE substring(event_type, (event_id % 7)::INTEGER + 1, (3 - event_id % 7)::INTEGER) END AS part FROM events")
def js_substring_event(spark, sf_dir):
    e, n = F.col("event_type"), (F.col("event_id") % 7).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", S.js_substring(e, n - 1, n - 1).alias("none"), S.js_substring(e, n, F.lit(3)).alias("part"))


@query("SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units, instr(text, 'and') - 1 AS first_and FROM documents")
def utf16_units(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.utf16_length(F.col("text")).cast("long").alias("units"), S.index_of(F.col("text"), "and").cast("long").alias("first_and"))


@query("""WITH x AS (SELECT doc_id, chr(65279) || ' ' || chr(133) || chr(128512) || text || chr(133) || ' ' || chr(12288) AS x, text FROM documents), y AS (SELECT *, instr(x, 'the') AS place FROM x)
SELECT doc_id, chr(133) || chr(128512) || text || chr(133) AS trimmed, (length(x) + length(regexp_replace(x, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units,
  CASE WHEN place = 0 THEN -1 ELSE place - 1 + length(regexp_replace(left(x, place - 1), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) END::BIGINT AS first_the,
  chr(65533) || substr(x, 5, 4) AS part, 'a-' || chr(133) || 'b-c-' || doc_id AS slug FROM y""")
def js_text_rules(spark, sf_dir):
    """White space, lengths, positions and parts by JavaScript's rules, on texts with an emoji, U+0085, U+FEFF and U+3000."""
    d = _table(spark, sf_dir, "documents")
    x = F.concat(F.lit("\ufeff \u0085\U0001f600"), "text", F.lit("\u0085 \u3000"))
    slug = S.dash_slug(F.concat(F.lit("A \u0085B\ufeff\u00a0C\u2003"), F.col("doc_id").cast("string")))
    return d.select("doc_id", S.js_trim(x).alias("trimmed"), S.utf16_length(x).cast("long").alias("units"), S.index_of(x, "the").cast("long").alias("first_the"), S.js_substring(x, F.lit(4), F.lit(9)).alias("part"), slug.alias("slug"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> ''))::BIGINT AS n FROM documents")
def nonblank_lines(spark, sf_dir):
    lines = F.filter(S.js_split(F.col("text"), "\n"), lambda x: S.js_trim(x) != "")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages")
def title_extract(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN lpad(page_id::VARCHAR, 11, 'a') END AS video, CASE WHEN page_id % 3 = 0 THEN 'https://img.youtube.com/vi/' || lpad(page_id::VARCHAR, 11, 'a') || '/hqdefault.jpg' END AS image FROM pages")
def video_addresses(spark, sf_dir):
    name = F.lpad(F.col("page_id").cast("string"), 11, "a")
    forms = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), name, F.lit("&t=3"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), name, F.lit("x"))).otherwise(F.col("url"))
    pages = _table(spark, sf_dir, "pages").select("page_id", S.video_id(forms).alias("video"))
    return pages.withColumn("image", S.thumbnail(F.col("video")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS long_date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM orders")
def order_dates(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", S.long_date(F.col("o_orderdate")).alias("long_date"), S.iso_text(F.col("o_orderdate")).alias("iso"))


# --- nulls, arrays, structures and JSON ------------------------------------------------------------


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''), 'none') AS filled, 'type ' || coalesce(nullif(event_type, 'view'), 'null') AS told FROM events")
def default_fill(spark, sf_dir):
    e = F.col("event_type")
    return _table(spark, sf_dir, "events").select("event_id", S.falsy_or(F.when(e == "click", "").otherwise(e), F.lit("none")).alias("filled"), S.text_plus(F.lit("type "), F.nullif(e, F.lit("view"))).alias("told"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, ''), nullif(CASE WHEN event_id % 3 = 1 THEN user_id::VARCHAR END, ''), CASE WHEN event_id % 3 = 0 AND event_type IS NULL THEN '{}' ELSE to_json({message: ''})::VARCHAR END) AS reply FROM events")
def reply_fields(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    raw = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("message"), F.when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).alias("content")))
    return e.select("event_id", M.reply_content(raw).alias("reply"))


@query("""WITH a AS (SELECT o_orderkey, ['a', o_orderstatus, 'F', 'b'] AS xs FROM orders)
SELECT o_orderkey, array_to_string(list_append(list_filter(xs, lambda x: x <> 'F'), 'new'), ',') AS changed, list_contains(xs, 'O') AS has_o, xs[2] || xs[3] AS inner_items, list_filter(xs, lambda x: x <> 'F')[1] AS head FROM a""")
def array_edits(spark, sf_dir):
    xs = F.array(F.lit("a"), "o_orderstatus", F.lit("F"), F.lit("b"))
    left = S.without(xs, F.lit("F"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.append(left, F.lit("new")), ",").alias("changed"), F.array_contains(xs, "O").alias("has_o"), F.array_join(S.inner_items(xs), "").alias("inner_items"), F.get(left, F.lit(0)).alias("head"))


@query("""SELECT c_custkey, c_name AS from_name, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), 'Not provided') AS organization,
CASE WHEN c_acctbal > 5000 THEN 'Researcher' WHEN c_acctbal > 0 THEN 'Volunteer' ELSE 'Student' END AS kind,
CASE WHEN c_nationkey % 3 = 0 THEN 'None selected' ELSE c_mktsegment || ', ' || c_nationkey END AS interests FROM customer""")
def form_fields(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    interests = F.when(F.col("c_nationkey") % 3 != 0, F.array("c_mktsegment", F.col("c_nationkey").cast("string")))
    organization = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return c.withColumnsRenamed({"c_name": "from_name"}).select(
        "c_custkey", "from_name", S.falsy_or(organization, F.lit("Not provided")).alias("organization"),
        F.when(F.col("c_acctbal") > 5000, "Researcher").when(F.col("c_acctbal") > 0, "Volunteer").otherwise("Student").alias("kind"),
        F.when(S.has_items(interests), F.array_join(interests, ", ")).otherwise("None selected").alias("interests"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE round(c_acctbal, 2) END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE c_mktsegment END AS segment FROM customer")
def struct_override(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.round("c_acctbal", 2).alias("value"), F.col("c_mktsegment").alias("segment")).alias("r"))
    r = F.when(F.col("c_custkey") % 2 == 0, F.col("r").withField("value", F.lit(0.0)).withField("segment", F.lit("B"))).otherwise(F.col("r"))
    return c.select("c_custkey", r.alias("r")).select("c_custkey", "r.value", "r.segment")


@query("SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ws FROM documents)")
def indexed_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.js_split(F.col("text"), "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


# --- wiki text -------------------------------------------------------------------------------------


def wiki_pages(spark, sf_dir) -> DataFrame:
    """pages(name, raw): each document as wiki text with headings, links, a table, marks and its whole text as a list item."""
    t = F.col
    raw = F.concat(
        F.lit("== "), t("source"), F.lit(" ==\n==== "), t("lang"), F.lit(" ====\n[[Main_Page|home]] and [["), t("lang"), F.lit(" Text]] at [http://a.b/"), t("source"), F.lit(" site]\n{| class=w\n! id !! lang\n|-\n| "),
        t("doc_id").cast("string"), F.lit(" || "), t("lang"), F.lit("\n|}\n'''"), t("source"), F.lit("''' ''"), t("lang"), F.lit("''\n<pre>q</pre> <code>c</code>\n** "), t("text"),
    )
    return _table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_Doc_"), t("doc_id").cast("string")).alias("name"), raw.alias("raw"))


def _quoted(text: str) -> str:
    """A SQL string; line ends as chr(10)."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _line_sql(pattern: str) -> str:
    """DuckDB has no look-behind; on the tables ^ with the m flag is the same."""
    return "(?m)" + pattern.replace(S.JS_LINE_START, "^") if S.JS_LINE_START in pattern else pattern


def _rule_sql(text: str, rules) -> str:
    for pattern, by in rules:
        for k in (1, 2, 3):
            by = by.replace(f"${k}", f"\\{k}")
        text = f"regexp_replace({text}, {_quoted(_line_sql(pattern))}, {_quoted(by)}, 'g')"
    return text


def _each_sql(pattern: str, by: str) -> str:
    return f"list_aggregate(list_transform(list_zip(string_split_regex(body, '{pattern}'), list_append(regexp_extract_all(body, '{pattern}'), '')), lambda z: z[1] || CASE WHEN z[2] = '' THEN '' ELSE {by} END), 'string_agg', '')"


def _slug_sql(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), '_', '-'), '[^a-z0-9-]', '', 'g')"


_PAGE, _NAMED, _TABLE = wiki.PAGE_LINK, wiki.NAMED_LINK, _line_sql(wiki.TABLE)
_WIKI_SQL = f"""
WITH p AS (
  SELECT source || '_Doc_' || doc_id AS name, '== ' || source || ' ==' || chr(10) || '==== ' || lang || ' ====' || chr(10) || '[[Main_Page|home]] and [[' || lang || ' Text]] at [http://a.b/' || source
    || ' site]' || chr(10) || '{{| class=w' || chr(10) || '! id !! lang' || chr(10) || '|-' || chr(10) || '| ' || doc_id || ' || ' || lang || chr(10) || '|}}' || chr(10) || '''''''' || source || ''''''' ''''' || lang || '''''' || chr(10)
    || '<pre>q</pre> <code>c</code>' || chr(10) || '** ' || text AS body FROM documents
), a AS (SELECT name, {_rule_sql("body", wiki.HEADINGS)} AS body FROM p
), b AS (SELECT name, {_each_sql(_PAGE, f"'[' || regexp_extract(z[2], '{_PAGE}', 1) || '](/wiki/' || {_slug_sql(f"regexp_extract(z[2], '{_PAGE}', 1)")} || ')'")} AS body FROM a
), c AS (SELECT name, {_each_sql(_NAMED, f"'[' || regexp_extract(z[2], '{_NAMED}', 2) || '](/wiki/' || {_slug_sql(f"regexp_extract(z[2], '{_NAMED}', 1)")} || ')'")} AS body FROM b
), d AS (SELECT name, {_rule_sql("body", wiki.LISTS)} AS body FROM c
), e AS (SELECT name, {_each_sql(_TABLE, "coalesce(list_aggregate(list_transform(list_filter(string_split(z[2], chr(10)), lambda l: trim(l) <> '')[2:-2], lambda l: CASE WHEN starts_with(l, '!') THEN '| ' || replace(substring(l, 2), '!!', ' | ') || ' |' || chr(10) || repeat('| --- ', len(string_split(l, '!!'))) || '|' || chr(10) WHEN starts_with(l, '|') THEN replace(l, '||', ' | ') || chr(10) ELSE '' END), 'string_agg', ''), '')")} AS body FROM d
)
SELECT {_slug_sql("name")} AS slug, replace(name, '_', ' ') AS title,
       '---' || chr(10) || 'id: ' || {_slug_sql("name")} || chr(10) || 'title: ' || replace(name, '_', ' ') || chr(10) || '---' || chr(10) || chr(10) || {_rule_sql("body", wiki.MARKS)} AS markdown FROM e"""


@query(_WIKI_SQL)
def wiki_markdown(spark, sf_dir):
    return wiki.wiki_to_markdown(wiki_pages(spark, sf_dir))


@query("SELECT 'module.exports = {wikiSidebar: [{type: ''category'', label: ''Wiki'', link: {type: ''doc'', id: ''index''}, items: ' || to_json(list(slug ORDER BY slug)) || '}]};' || chr(10) AS config FROM (SELECT DISTINCT regexp_replace(replace(lower(p_brand || '_' || p_type), '_', '-'), '[^a-z0-9-]', '', 'g') AS slug FROM part)")
def nav_config_brands(spark, sf_dir):
    return wiki.nav_config(_table(spark, sf_dir, "part").select(S.slug(F.concat("p_brand", F.lit("_"), "p_type")).alias("slug")).distinct())


# --- messages --------------------------------------------------------------------------------------


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def role_filter(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')")
def role_domain_check(spark, sf_dir):
    return M.roles_outside(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(text, ' / ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def conversation_concat(spark, sf_dir):
    return M.joined_text(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", " / ")


@query("SELECT conv_id, to_json(list(role ORDER BY turn)) AS roles FROM conversations GROUP BY conv_id")
def conversation_json(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(turns, lambda x: x["role"])).alias("roles"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT coalesce(CASE WHEN role = 'assistant' THEN turn % 2 = 1 END, false)")
def drop_transient(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").withColumn("is_typing", F.when(F.col("role") == "assistant", F.col("turn") % 2 == 1))
    return M.drop_transient(c).select("conv_id", "turn")


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', NULL FROM conversations GROUP BY conv_id")
def append_reply(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return M.append_rows(c, c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("assistant")))


@query("""WITH t AS (SELECT page_id, 'see [' || page_id || '](' || url || ')' || CASE WHEN page_id % 2 = 0 THEN '[b](/c)' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN ' end' ELSE '' END AS text FROM pages)
SELECT page_id, 'text' AS kind, 'see ' AS text, NULL AS target, 0 AS pos FROM t
UNION ALL SELECT page_id, 'link', page_id::VARCHAR, url, 1 FROM pages
UNION ALL SELECT page_id, 'link', 'b', '/c', 2 FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'text', ' end', NULL, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END FROM pages WHERE page_id % 3 = 0""")
def link_tokens(spark, sf_dir):
    p = F.col("page_id")
    text = F.concat(F.lit("see ["), p.cast("string"), F.lit("]("), "url", F.lit(")"), F.when(p % 2 == 0, "[b](/c)").otherwise(""), F.when(p % 3 == 0, " end").otherwise(""))
    return M.link_segments(_table(spark, sf_dir, "pages").select("page_id", text.alias("text"))).select("page_id", "kind", "text", "target", "pos")


def _sse(spark, sf_dir) -> DataFrame:
    """Each conversation as server-sent events: one event a turn; system turns are notices."""
    c = _table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("event: message\ndata: "), F.when(F.col("role") == "system", F.concat(F.lit(M.SYSTEM_MARK + " "), "text")).otherwise(F.col("text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.withColumn("text", F.regexp_replace("text", "\n", " ")).groupBy("conv_id").agg(F.concat(F.array_join(F.transform(turns, lambda x: x["line"]), "\n\n"), F.lit("\n\nevent: done\ndata: [DONE]\n\n")).alias("raw"))


_SSE_SQL = """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS {0} FROM (SELECT conv_id, turn, role, {1} AS text FROM conversations) WHERE role <> 'system' AND text <> '' AND NOT contains(text, 'SYSTEM MESSAGE') AND {2} GROUP BY conv_id"""


@query("SELECT conv_id, coalesce(said, '') AS said FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (" + _SSE_SQL.format("said", "replace(text, chr(10), ' ')", "text <> '[DONE]' AND trim(text) <> ''") + ") USING (conv_id)")
def sse_events(spark, sf_dir):
    return _sse(spark, sf_dir).select("conv_id", F.array_join(M.event_payloads(F.col("raw")), " ").alias("said"))


@query("SELECT conv_id, coalesce(said, '') AS said FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (" + _SSE_SQL.format("said", "trim(replace(text, chr(10), ' '))", "NOT contains(text, '[DONE]') AND NOT contains(text, 'map_intent') AND length(text) > 4") + ") USING (conv_id)")
def sse_lines(spark, sf_dir):
    return _sse(spark, sf_dir).select("conv_id", F.array_join(M.data_lines(F.col("raw")), " ").alias("said"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN trim('said ' || t) ELSE trim(t) END AS answer
FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM conversations)""")
def answer_fallback(spark, sf_dir):
    t, n = F.regexp_replace("text", "\\s+", " "), F.col("turn") % 4
    raw = F.when(n == 0, F.concat(F.lit("event: message data: "), t, F.lit(" event: done data: [DONE]"))).when(n == 1, F.concat(F.lit("map_intent I don't know what to do with this prompt. "), t, F.lit(" [DONE]")))
    raw = raw.when(n == 3, F.concat(F.lit("data: SYSTEM MESSAGE x\ndata: said "), t, F.lit("\ndata: [DONE]"))).otherwise(F.concat(F.lit("map_intent "), t, F.lit(" [DONE]")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", M.answer_text(raw).alias("answer"))


def _log(spark, sf_dir) -> DataFrame:
    """Conversations as events: user turns ask, assistant turns answer, system turns reset."""
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("seq"), F.when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer").otherwise("reset").alias("kind"), "role", "text")


@query("""WITH e AS (SELECT conv_id, turn AS seq, role, text, max(CASE WHEN role = 'system' THEN turn END) OVER w AS r, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id)),
live AS (SELECT * FROM e WHERE role <> 'system' AND (r IS NULL OR seq > r))
SELECT conv_id, seq, role, text, NULL::BOOLEAN AS is_typing FROM live
UNION ALL SELECT conv_id, seq, 'assistant', '', true FROM live WHERE role = 'user' AND (a IS NULL OR seq > a)""")
def message_replay(spark, sf_dir):
    return M.replay(_log(spark, sf_dir))


@query(ORACLE_SQL["message_replay"])
def streamed_log(spark, sf_dir):
    """The same log from a stream with keyed state. Batches are dealt by a hash, so events come late, one batch comes again, and between two starts of
    the stream its state is compacted."""
    events, folder = _log(spark, sf_dir), scratch_path(spark, "stream")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for parts in ((2, 0, 3), (0, 1)):
        for part in parts:
            events.filter(F.pmod(F.xxhash64("conv_id", "seq"), F.lit(4)) == part).repartition(files).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(stream_messages.EVENTS).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
        stream_messages.keep_state(spark, stream, f"{folder}/out", f"{folder}/state", patience_ms=86_400_000).awaitTermination()
        stream_messages.compact(spark, f"{folder}/out")
    return stream_messages.current(spark, f"{folder}/out").drop("slot")


@query("SELECT user_id AS conv_id, event_id AS seq FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type = 'click' AND b = 'click'")
def single_flight(spark, sf_dir):
    """Clicks of a user ask, views answer, all else resets."""
    kind = F.when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "view", "answer").otherwise("reset")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return M.overlapping_asks(events).select("conv_id", "seq")


# --- graph -----------------------------------------------------------------------------------------


def _g(sql: str) -> str:
    return f"WITH RECURSIVE {graph.SQL}, up AS (SELECT src_iri, dst_iri, 1 AS depth FROM edges WHERE label = 'is_a' UNION ALL SELECT u.src_iri, e.dst_iri, u.depth + 1 FROM up u JOIN edges e ON e.label = 'is_a' AND e.src_iri = u.dst_iri) {sql}"


@query(_g("SELECT label, count(*) AS n FROM edges GROUP BY label"))
def onto_label_counts(spark, sf_dir):
    return O.label_counts(graph.edges(spark, sf_dir))


@query(_g("SELECT class_iri, count(*) AS n FROM nodes WHERE kind = 'entity' GROUP BY class_iri"))
def onto_class_counts(spark, sf_dir):
    return O.class_counts(graph.nodes(spark, sf_dir))


@query(_g("SELECT iri, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src_iri AS iri, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst_iri, 0, 1 FROM edges) GROUP BY iri"))
def onto_degrees(spark, sf_dir):
    return O.degrees(graph.edges(spark, sf_dir))


@query(_g("SELECT kind, iri, name FROM nodes WHERE kind = 'class' AND iri NOT IN (SELECT src_iri FROM edges WHERE label = 'is_a')"))
def onto_roots(spark, sf_dir):
    return O.roots(graph.nodes(spark, sf_dir).filter("kind = 'class'"), graph.edges(spark, sf_dir)).select("kind", "iri", "name")


@query(_g("SELECT kind, iri, name FROM nodes WHERE kind = 'class' AND iri NOT IN (SELECT dst_iri FROM edges WHERE label = 'is_a')"))
def onto_leaves(spark, sf_dir):
    return O.leaves(graph.nodes(spark, sf_dir).filter("kind = 'class'"), graph.edges(spark, sf_dir)).select("kind", "iri", "name")


@query(_g("SELECT src_iri, dst_iri, min(depth) AS depth FROM up GROUP BY ALL"))
def onto_closure(spark, sf_dir):
    return O.closure(graph.edges(spark, sf_dir))


@query(_g("SELECT depth, count(*) AS n FROM (SELECT iri, coalesce(max(depth), 0) AS depth FROM (SELECT DISTINCT iri FROM nodes WHERE kind = 'class') LEFT JOIN up ON src_iri = iri GROUP BY iri) GROUP BY depth"))
def onto_depth_histogram(spark, sf_dir):
    pairs = O.closure(graph.edges(spark, sf_dir))
    return O.depths(graph.nodes(spark, sf_dir).filter("kind = 'class'"), pairs).groupBy("depth").agg(F.count("*").alias("n"))


@query(_g("SELECT iri, class_iri AS type_iri, 0 AS depth FROM nodes WHERE kind = 'entity' UNION ALL SELECT n.iri, u.dst_iri, u.depth FROM nodes n JOIN up u ON n.kind = 'entity' AND n.class_iri = u.src_iri"))
def onto_inferred_types(spark, sf_dir):
    return O.inferred_types(graph.nodes(spark, sf_dir), O.closure(graph.edges(spark, sf_dir)))


@query(_g("SELECT a.class_iri AS domain_iri, e.label, b.class_iri AS range_iri, count(*) AS n FROM edges e JOIN nodes a ON a.kind = 'entity' AND a.iri = e.src_iri JOIN nodes b ON b.kind = 'entity' AND b.iri = e.dst_iri WHERE e.src_kind = 'entity' GROUP BY ALL"))
def onto_schema_profile(spark, sf_dir):
    return O.schema_profile(graph.nodes(spark, sf_dir), graph.edges(spark, sf_dir))


@query(_g("SELECT src_iri, label, dst_iri FROM edges WHERE dst_iri NOT IN (SELECT iri FROM nodes)"))
def onto_unresolved(spark, sf_dir):
    return O.unresolved(graph.edges(spark, sf_dir), graph.nodes(spark, sf_dir)).select("src_iri", "label", "dst_iri")


@query(_g("SELECT e.src_iri, e.label, e.dst_iri, n.name AS dst_name FROM edges e LEFT JOIN nodes n ON n.iri = e.dst_iri"))
def onto_targets(spark, sf_dir):
    return O.targets(graph.edges(spark, sf_dir), graph.nodes(spark, sf_dir)).select("src_iri", "label", "dst_iri", "dst_name")


@query(_g("SELECT iri FROM nodes GROUP BY iri HAVING count(DISTINCT kind) > 1"))
def onto_collisions(spark, sf_dir):
    return O.collisions(graph.nodes(spark, sf_dir)).select("iri")


@query(_g("SELECT kind, count(*) AS nodes, count(name) AS with_name, count(class_iri) AS with_class_iri FROM nodes GROUP BY kind"))
def onto_completeness(spark, sf_dir):
    return O.completeness(graph.nodes(spark, sf_dir), ["name", "class_iri"])


@query(_g("SELECT kind, grp AS \"group\", count(*) AS n FROM nodes GROUP BY ALL"))
def onto_group_counts(spark, sf_dir):
    return O.group_counts(graph.nodes(spark, sf_dir))


@query("SELECT 'p:' || c_custkey AS who, 'o:' || o_orderkey AS what, 'st:' || o_orderstatus AS state, 'r:' || n_regionkey AS area FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def graph_pattern(spark, sf_dir):
    return O.match(graph.triples(spark, sf_dir), [("?who", "placed", "?what"), ("?what", "type", "?state"), ("?who", "type", "?where"), ("?where", "is_a", "?area")]).select("who", "what", "state", "area")


@query(_g(""", both_ways AS (SELECT src_iri AS a, dst_iri AS b FROM edges UNION ALL SELECT dst_iri, src_iri FROM edges),
h0 AS (SELECT 'r:' || r_regionkey AS iri, 0 AS hop FROM region WHERE r_regionkey = 0), h1 AS (SELECT * FROM h0 UNION ALL SELECT b, 1 FROM h0 JOIN both_ways ON a = iri), h2 AS (SELECT * FROM h1 UNION ALL SELECT b, hop + 1 FROM h1 JOIN both_ways ON a = iri WHERE hop = 1)
SELECT iri, min(hop) AS hop FROM h2 GROUP BY iri"""))
def graph_neighbourhood(spark, sf_dir):
    seeds = graph.nodes(spark, sf_dir).filter("iri = 'r:0'").select("iri")
    return O.neighbourhood(graph.edges(spark, sf_dir), seeds, 2)


@query("""WITH a AS (SELECT p_partkey AS name, p_size AS low, p_size + p_partkey % 5 AS high FROM part), b AS (SELECT n_nationkey AS other, n_nationkey * 2 AS low2, n_nationkey * 2 + n_nationkey % 4 AS high2 FROM nation)
SELECT name, other FROM a JOIN b ON low <= high2 AND low2 <= high""")
def range_overlaps(spark, sf_dir):
    a = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("low"), (F.col("p_size") + F.col("p_partkey") % 5).alias("high"))
    b = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), (F.col("n_nationkey") * 2).alias("low"), (F.col("n_nationkey") * 2 + F.col("n_nationkey") % 4).alias("high"))
    return O.age_overlaps(a, b)


@query("SELECT event_id, 'type in domain' AS rule FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, 'value positive' FROM events WHERE NOT coalesce(value > 50, false) UNION ALL SELECT event_id, 'buyer required' FROM events WHERE event_type IS NULL OR event_type <> 'purchase' OR user_id IS NULL")
def rule_violations(spark, sf_dir):
    rules = [("type in domain", Q.one_of("event_type", ["click", "view"])[1]), ("value positive", F.col("value") > 50), Q.required("buyer")]
    events = _table(spark, sf_dir, "events").withColumn("buyer", F.when(F.col("event_type") == "purchase", F.col("user_id")))
    return Q.violations(events, ["event_id"], rules)


@query("SELECT event_id, 'value not above 50' AS reason FROM events WHERE NOT coalesce(value > 50, false)")
def quarantined_events(spark, sf_dir):
    bad = Q.set_aside(_table(spark, sf_dir, "events"), F.col("value") > 50, "value not above 50")[1]
    return bad.select("event_id", "reason")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations")
def insertion_order(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("nth"))


# --- choices, fields and links -----------------------------------------------------------------------


@query("SELECT conv_id, turn FROM conversations WHERE regexp_replace(text, '\\s', '', 'g') <> '' AND coalesce(role, '') <> 'system'")
def sendable_turns(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.filter(S.sendable(F.col("text"), F.col("role") == "system")).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN value > 50 THEN event_type ELSE user_id::VARCHAR END AS told FROM events")
def source_by_flag(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.by_flag(F.col("value") > 50, F.col("event_type"), F.col("user_id").cast("string")).alias("told"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'MACHINERY' THEN 'gear' ELSE 'other' END AS icon, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' END AS bare FROM customer")
def lookup_segment(spark, sf_dir):
    segment = F.col("c_mktsegment")
    return _table(spark, sf_dir, "customer").select("c_custkey", S.lookup(segment, {"BUILDING": "house", "MACHINERY": "gear"}, F.lit("other")).alias("icon"), S.lookup(segment, {"AUTOMOBILE": "car"}).alias("bare"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value ELSE 0 END AS click, CASE WHEN event_type = 'view' THEN value ELSE 0 END AS seen, (2 + CASE WHEN event_type IN ('click', 'view') OR event_type IS NULL THEN 0 ELSE 1 END)::INTEGER AS n_fields FROM events")
def field_by_name(spark, sf_dir):
    """A form of two fields, in which each event sets the field that it names."""
    form = F.create_map(F.lit("click"), F.lit(0.0), F.lit("view"), F.lit(0.0))
    e = _table(spark, sf_dir, "events").select("event_id", S.with_field(form, F.col("event_type"), F.col("value")).alias("form"))
    return e.select("event_id", F.col("form")["click"].alias("click"), F.col("form")["view"].alias("seen"), F.size("form").alias("n_fields"))


@query("SELECT o_orderkey, 'application/json' AS content_type, 'Key ' || o_custkey AS access, 2::INTEGER AS n_headers FROM orders")
def request_headers(spark, sf_dir):
    h = S.header_map({"Content-Type": "application/json", "Authorization": F.concat(F.lit("Key "), F.col("o_custkey").cast("string"))})
    o = _table(spark, sf_dir, "orders").select("o_orderkey", h.alias("h"))
    return o.select("o_orderkey", F.col("h")["Content-Type"].alias("content_type"), F.col("h")["Authorization"].alias("access"), F.size("h").alias("n_headers"))


@query("SELECT page_id, coalesce(starts_with(url, '/'), false) AS whole, coalesce(starts_with(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), false) AS path FROM pages")
def internal_links(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return _table(spark, sf_dir, "pages").select("page_id", S.is_internal(F.col("url")).alias("whole"), S.is_internal(path).alias("path"))


@query("SELECT p_brand AS category, CASE WHEN p_size > 5 THEN p_size END AS position, 'part-' || p_partkey AS slug FROM part ORDER BY 1, 2 NULLS LAST, 3")
def navigation_order(spark, sf_dir):
    position = F.when(F.col("p_size") > 5, F.col("p_size"))
    return wiki.navigation_order(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), position.alias("position"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug")))


@query("""SELECT 'tables' AS source, 'entity' AS src_kind, 'o:' || o_orderkey AS src_iri, 'placed_by' AS label, CASE WHEN r_name = 'EUROPE' OR r_name IS NULL THEN 'r' || o_custkey % 7 || ':' || o_custkey ELSE 'http://a.b/' || lower(r_name) || '/' || o_custkey END AS dst_iri, 0::INTEGER AS seq
FROM orders LEFT JOIN region ON r_regionkey = o_custkey % 7 WHERE o_orderstatus <> 'F' UNION ALL SELECT 'tables', 'entity', 'o:' || o_orderkey, 'state', o_orderstatus, 1::INTEGER FROM orders WHERE o_orderstatus <> 'F'""")
def onto_flatten(spark, sf_dir):
    """Orders with relations; those of status F have none. Regions give the prefixes, all but one, and r5 and r6 have none."""
    prefixes = _table(spark, sf_dir, "region").filter("r_name <> 'EUROPE'").select(F.lit("tables").alias("source"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("prefix"), F.concat(F.lit("http://a.b/"), F.lower("r_name"), F.lit("/")).alias("base"))
    key = F.col("o_custkey").cast("string")
    buyer = F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string"), F.lit(":"), key)
    relations = F.array(F.struct(F.lit("placed_by").alias("label"), buyer.alias("to")), F.struct(F.lit("state").alias("label"), F.col("o_orderstatus").alias("to")))
    orders = _table(spark, sf_dir, "orders").select(F.lit("tables").alias("source"), F.lit("entity").alias("kind"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("iri"), F.when(F.col("o_orderstatus") != "F", relations).alias("relations"))
    return O.flatten(orders, prefixes)


@query("""SELECT iri FROM (SELECT p_partkey AS iri, p_name || ' (id: ' || p_partkey || ')' || chr(10) || 'Definition: ' || CASE WHEN p_size > 40 THEN p_brand ELSE p_type END || CASE WHEN p_size > 20 THEN '  Examples: ' || p_brand ELSE '' END AS title,
p_name || '(id:' || p_partkey || ')Definition:' || p_type || CASE WHEN p_size > 10 THEN 'Examples:' || p_brand ELSE '' END AS told FROM part) WHERE regexp_replace(title, '\\s', '', 'g') <> regexp_replace(told, '\\s', '', 'g')""")
def onto_title_mismatches(spark, sf_dir):
    """Parts as nodes; titles of sizes 11 to 20 lack their example and those over 40 tell the brand in place of the type."""
    size, brand, key = F.col("p_size"), F.col("p_brand"), F.col("p_partkey").cast("string")
    title = F.concat("p_name", F.lit(" (id: "), key, F.lit(")\nDefinition: "), F.when(size > 40, brand).otherwise(F.col("p_type")), F.when(size > 20, F.concat(F.lit("  Examples: "), brand)).otherwise(""))
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("iri"), key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"), F.when(size > 10, brand).alias("example"), title.alias("title"))
    return O.title_mismatches(parts).select("iri")


@query(_g("SELECT DISTINCT u.dst_iri AS seed, u.src_iri AS iri FROM up u WHERE u.dst_iri LIKE 'r:%'"))
def question_kinds(spark, sf_dir):
    """What kinds lie below each region?"""
    regions = graph.nodes(spark, sf_dir).filter("iri LIKE 'r:%'").select("iri")
    return paths.reached(graph.edges(spark, sf_dir), regions, paths.some(paths.back("is_a")))


@query(_g("SELECT DISTINCT u.dst_iri AS seed, h.dst_iri AS iri FROM up u JOIN edges p ON p.label = 'placed' AND p.src_iri = u.src_iri JOIN edges h ON h.label = 'holds' AND h.src_iri = p.dst_iri WHERE u.dst_iri LIKE 'r:%'"))
def question_parts_of_regions(spark, sf_dir):
    """Which parts are in orders of those who belong to each region, at whatever level?"""
    regions = graph.nodes(spark, sf_dir).filter("iri LIKE 'r:%'").select("iri")
    pattern = paths.chain(paths.some(paths.back("is_a")), paths.step("placed"), paths.step("holds"))
    return paths.reached(graph.edges(spark, sf_dir), regions, pattern)


@query(_g("SELECT DISTINCT 'part:' || p_partkey AS seed, n.dst_iri AS iri FROM part JOIN edges h ON h.label = 'holds' AND h.dst_iri = 'part:' || p_partkey JOIN edges p ON p.label = 'placed' AND p.dst_iri = h.src_iri JOIN (SELECT src_iri, dst_iri FROM up UNION ALL SELECT src_iri, src_iri FROM edges WHERE label = 'placed') n ON n.src_iri = p.src_iri WHERE p_size >= 49"))
def question_who_orders(spark, sf_dir):
    """Who orders the largest parts, and what are they kinds of?"""
    largest = _table(spark, sf_dir, "part").filter("p_size >= 49").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("iri"))
    pattern = paths.chain(paths.back("holds"), paths.back("placed"), paths.any_number(paths.step("is_a")))
    return paths.reached(graph.edges(spark, sf_dir), largest, pattern)


_TYPO_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, k) || substr(p_name, k + 2) WHEN 2 THEN substr(p_name, 1, k) || 'q' || substr(p_name, k + 2) ELSE 'zz' || p_name END"


@query(f"""WITH v AS (SELECT p_partkey AS variable, trim(regexp_replace(lower({_TYPO_SQL}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS v FROM (SELECT *, p_partkey % 7 AS k FROM part)),
t AS (SELECT DISTINCT p_name AS term, trim(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM part),
near AS (SELECT variable, term, levenshtein(v, t) AS edits FROM v JOIN t ON abs(length(v) - length(t)) <= 2
  WHERE levenshtein(v, t) <= least(CASE WHEN length(v) >= 7 THEN 2 WHEN length(v) >= 4 THEN 1 ELSE 0 END, CASE WHEN length(t) >= 7 THEN 2 WHEN length(t) >= 4 THEN 1 ELSE 0 END)),
ranked AS (SELECT *, row_number() OVER w AS r, lead(edits) OVER w - edits AS margin FROM near WINDOW w AS (PARTITION BY variable ORDER BY edits, term))
SELECT variable, term, edits, margin, coalesce(margin >= 1, true) AS sure FROM ranked WHERE r = 1""")
def mapped_labels(spark, sf_dir):
    """Part names with up to two typing errors mapped back to the part names."""
    p, k = _table(spark, sf_dir, "part"), (F.col("p_partkey") % 7).cast("int")
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    after = F.substring(name, k + 2, F.length(name))
    label = F.when(kind == 0, name).when(kind == 1, F.concat(F.substring(name, F.lit(1), k), after)).when(kind == 2, F.concat(F.substring(name, F.lit(1), k), F.lit("q"), after)).otherwise(F.concat(F.lit("zz"), name))
    return mapping.mapping_table(p.select(F.col("p_partkey").alias("variable"), label.alias("label")), p.select(name.alias("term"), name.alias("label")))


# --- what goes together ----------------------------------------------------------------------------

_LINKS_SQL = """WITH one AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem),
kept AS (SELECT * FROM one WHERE basket IN (SELECT basket FROM one GROUP BY basket HAVING count(*) <= 1000)),
item AS (SELECT item, count(*) AS n FROM kept GROUP BY item),
pairs AS (SELECT x.item AS a, y.item AS b, count(*) AS times FROM kept x JOIN kept y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL),
often AS (SELECT a, b, times AS k, i.n AS na, j.n AS nb, (SELECT count(DISTINCT basket) FROM kept) AS n FROM pairs JOIN item i ON i.item = a JOIN item j ON j.item = b WHERE times >= 2),
weighed AS (SELECT a, b, floor(2000 * (x(k) + x(na - k) + x(nb - k) + x(n - na - nb + k) + x(n) - x(na) - x(n - na) - x(nb) - x(n - nb)) + 0.5)::BIGINT AS weight FROM often WHERE k * n > na * nb),
ways AS (SELECT a AS item, b AS other, weight FROM weighed UNION ALL SELECT b, a, weight FROM weighed),
links AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY item ORDER BY weight DESC, other) <= 10)"""
_LINKS_SQL = re.sub(r"\bx\(([^()]*)\)", r"(CASE WHEN \1 > 0 THEN (\1)::DOUBLE * ln((\1)::DOUBLE) ELSE 0.0 END)", _LINKS_SQL)


def _baskets(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


@query(_LINKS_SQL + """ SELECT l.item, m.other, count(*) AS between, sum(least(l.weight, m.weight))::BIGINT AS score FROM links l JOIN links m ON m.item = l.other AND m.other <> l.item
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = least(l.item, m.other) AND p.b = greatest(l.item, m.other)) GROUP BY ALL""")
def part_gaps(spark, sf_dir):
    """Parts that no order holds together, though both go with the same third parts."""
    return affinity.gaps(_baskets(spark, sf_dir))


@query(_LINKS_SQL + """, held AS (SELECT DISTINCT o_custkey AS cust, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
given AS (SELECT cust, l.other AS item, h.item AS because, weight FROM held h JOIN links l ON l.item = h.item),
best AS (SELECT cust, item, sum(weight)::BIGINT AS score FROM given WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.cust = given.cust AND h.item = given.item) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, item) AS rank FROM best QUALIFY rank <= 5),
why AS (SELECT cust, item, because, row_number() OVER (PARTITION BY cust, item ORDER BY weight DESC, because) AS r FROM given QUALIFY r <= 3)
SELECT cust, rank, item, score, string_agg(because::VARCHAR, ',' ORDER BY r) AS reasons FROM top JOIN why USING (cust, item) GROUP BY ALL""")
def part_recommendations(spark, sf_dir):
    """Five parts for each customer, each with the parts of theirs that it goes with."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket"), F.col("o_custkey").alias("user"))
    lines = _baskets(spark, sf_dir)
    found = affinity.recommendations(orders.join(lines, "basket"), lines)
    return found.select(F.col("user").alias("cust"), "rank", "item", "score", F.array_join(F.transform("reasons", lambda i: i.cast("string")), ",").alias("reasons"))


# --- shapes and versions of graphs -------------------------------------------------------------------

_SHAPES = (
    shapes.Shape("buyer", (shapes.Count("placed", 1, 12), shapes.Targets("placed", ("st:F", "st:O")), shapes.Closed(("placed",)), shapes.Has("name"), shapes.Unique("stamp")), "entity", ("r:2",)),
    shapes.Shape("open order", (shapes.Count("holds", 2, 6), shapes.Closed(("placed",)), shapes.Has("name")), "entity", ("st:P",)),
    shapes.Shape("kind", (shapes.Count("is_a", 1, 1), shapes.Unique("name")), "class"),
)


@query(_g(""", buyer AS (SELECT iri, right(name, 3) AS stamp FROM nodes WHERE kind = 'entity' AND class_iri IN (SELECT src_iri FROM up WHERE dst_iri = 'r:2')),
part_order AS (SELECT iri FROM nodes WHERE kind = 'entity' AND class_iri = 'st:P')
SELECT 'buyer' AS shape, 'entity' AS kind, iri, 'placed 1..12' AS rule, count(dst_iri) AS found FROM buyer LEFT JOIN edges ON src_kind = 'entity' AND src_iri = iri AND label = 'placed' GROUP BY iri HAVING count(dst_iri) NOT BETWEEN 1 AND 12
UNION ALL SELECT 'buyer', 'entity', iri, 'placed to st:F|st:O', count(*) FROM buyer JOIN edges ON src_kind = 'entity' AND src_iri = iri AND label = 'placed' WHERE dst_iri NOT IN (SELECT iri FROM nodes WHERE class_iri IN ('st:F', 'st:O')) GROUP BY iri
UNION ALL SELECT 'buyer', 'entity', iri, 'stamp unique', n FROM (SELECT iri, count(*) OVER (PARTITION BY stamp) AS n FROM buyer) WHERE n > 1
UNION ALL SELECT 'open order', 'entity', iri, 'holds 2..6', count(dst_iri) FROM part_order LEFT JOIN edges ON src_kind = 'entity' AND src_iri = iri AND label = 'holds' GROUP BY iri HAVING count(dst_iri) NOT BETWEEN 2 AND 6
UNION ALL SELECT 'open order', 'entity', iri, 'only placed', count(*) FROM part_order JOIN edges ON src_kind = 'entity' AND src_iri = iri AND label <> 'placed' GROUP BY iri
UNION ALL SELECT 'open order', 'entity', iri, 'name required', 0 FROM part_order
UNION ALL SELECT 'kind', 'class', iri, 'is_a 1..1', count(dst_iri) FROM nodes LEFT JOIN edges ON src_kind = 'class' AND src_iri = iri AND label = 'is_a' WHERE kind = 'class' GROUP BY iri HAVING count(dst_iri) <> 1
UNION ALL SELECT 'kind', 'class', iri, 'name unique', n FROM (SELECT iri, count(*) OVER (PARTITION BY name) AS n FROM nodes WHERE kind = 'class' AND name IS NOT NULL) WHERE n > 1"""))
def shape_violations(spark, sf_dir):
    """Buyers of region 2 place 1 to 12 orders, none of them open; open orders and classes have rules of their own."""
    edges = graph.edges(spark, sf_dir)
    regions = graph.nodes(spark, sf_dir).filter("iri = 'r:2'").select("iri")
    under = paths.reached(edges, regions, paths.some(paths.back("is_a"))).select(F.col("iri").alias("src_iri"), F.col("seed").alias("dst_iri"))
    nodes = graph.nodes(spark, sf_dir).withColumn("stamp", F.expr("right(name, 3)"))
    return shapes.violations(nodes, edges, _SHAPES, under).drop("source")


_LOG_SQL = """WITH log AS (
  SELECT 'y' || year(o_orderdate) AS graph, 'p:' || o_custkey AS s, 'placed' AS p, 'o:' || o_orderkey AS o, 1 + o_orderkey % 5 AS version, 1 AS added FROM orders
  UNION ALL SELECT 'y' || year(o_orderdate), 'p:' || o_custkey, 'placed', 'o:' || o_orderkey, 6 + o_orderkey % 3, 0 FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'y' || year(o_orderdate), 'p:' || o_custkey, 'placed', 'o:' || o_orderkey, 6 + o_orderkey % 3 + o_orderkey % 2, 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0
  UNION ALL SELECT 's' || l_returnflag, 'o:' || l_orderkey, 'holds', 'part:' || l_partkey, 1 + l_linenumber, 1 FROM lineitem
  UNION ALL SELECT 's' || l_returnflag, 'o:' || l_orderkey, 'holds', 'part:' || l_partkey, 5, 0 FROM lineitem WHERE l_linestatus = 'F'
)"""


def _quad_log(spark, sf_dir) -> DataFrame:
    """Orders are placed in the graph of their year; finished ones are removed later and some come back. Lines are held in the graph of their flag."""
    def quads(rows, graph_of, s, p, o, version, added):
        return rows.select(graph_of.alias("graph"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), version.cast("long").alias("version"), F.lit(added).alias("added"))

    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    done, key = orders.filter("o_orderstatus = 'F'"), F.col("o_orderkey")
    placed = (F.concat(F.lit("y"), F.year("o_orderdate").cast("string")), F.concat(F.lit("p:"), F.col("o_custkey").cast("string")), "placed", F.concat(F.lit("o:"), key.cast("string")))
    held = (F.concat(F.lit("s"), "l_returnflag"), F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")), "holds", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))
    return (
        quads(orders, *placed, 1 + key % 5, True)
        .unionByName(quads(done, *placed, 6 + key % 3, False))
        .unionByName(quads(done.filter("o_custkey % 4 = 0"), *placed, 6 + key % 3 + key % 2, True))
        .unionByName(quads(lines, *held, 1 + F.col("l_linenumber"), True))
        .unionByName(quads(lines.filter("l_linestatus = 'F'"), *held, F.lit(5), False))
    )


_INTERVALS_SQL = _LOG_SQL + """, each AS (SELECT graph, s, p, o, version, max(added) AS added FROM log GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(added, 1, 0) OVER (PARTITION BY graph, s, p, o ORDER BY version) AS before FROM each) WHERE added <> before),
spans AS (SELECT graph, s, p, o, version AS since, lead(version) OVER (PARTITION BY graph, s, p, o ORDER BY version) AS until, added FROM turns)"""


@query(_INTERVALS_SQL + " SELECT graph, s, p, o, since, until FROM spans WHERE added = 1")
def graph_intervals(spark, sf_dir):
    return versions.intervals(_quad_log(spark, sf_dir))


@query(_INTERVALS_SQL + " SELECT s, p, o, graph, since FROM spans WHERE added = 1 AND since <= 7 AND (until IS NULL OR until > 7)")
def graph_provenance(spark, sf_dir):
    """Which graphs say what as of version 7, and since when."""
    return versions.provenance(_quad_log(spark, sf_dir), 7)


@query(_INTERVALS_SQL + """, a AS (SELECT * FROM spans WHERE added = 1 AND since <= 4 AND (until IS NULL OR until > 4)), b AS (SELECT * FROM spans WHERE added = 1 AND since <= 8 AND (until IS NULL OR until > 8))
SELECT graph, s, p, o, 'removed' AS change FROM a ANTI JOIN b USING (graph, s, p, o) UNION ALL SELECT graph, s, p, o, 'added' FROM b ANTI JOIN a USING (graph, s, p, o)""")
def graph_difference(spark, sf_dir):
    """What changes from version 4 to version 8."""
    return versions.difference(versions.compact(_quad_log(spark, sf_dir), 3), 4, 8)


# --- folders of files --------------------------------------------------------------------------------


@query("""SELECT slug, count(*) AS pages, max_by(p_type || ' ' || p_partkey, p_partkey) || chr(10) AS raw, CASE WHEN count(*) > 1 THEN 'clash' END AS reason
FROM (SELECT *, regexp_replace(replace(lower(p_name), '_', '-'), '[^a-z0-9-]', '', 'g') AS slug FROM part) GROUP BY slug""")
def page_files(spark, sf_dir):
    """Parts as pages named by the slug of the part's name, written one file each and read back, with the report of clashes."""
    pages = _table(spark, sf_dir, "part").select(S.slug(F.col("p_name")).alias("slug"), F.concat_ws(" ", "p_type", F.col("p_partkey").cast("string")).alias("markdown"), "p_partkey")
    path = scratch_path(spark, "page_files")
    report = page_sink.write_page_files(pages, path, order="p_partkey")
    back = files.landed_pages(spark, path).withColumnRenamed("name", "slug")
    return back.join(report, "slug", "left").select("slug", F.coalesce("pages", F.lit(1)).alias("pages"), "raw", "reason")


@query("""WITH c AS (SELECT *, 'block-' || c_custkey // 100 || '.yaml' AS source FROM customer), good AS (SELECT * FROM c WHERE (c_custkey // 100) % 5 <> 4)
SELECT source, 'name' AS what, 'http://a.b/p/' || c_custkey AS a, c_name AS b FROM good
UNION ALL SELECT source, 'class', 'http://a.b/p/' || c_custkey, 'http://a.b/n:' || c_nationkey FROM good
UNION ALL SELECT source, 'lives_in', 'http://a.b/p/' || c_custkey, 'http://a.b/n:' || c_nationkey FROM good
UNION ALL SELECT source, 'buys_for', 'http://a.b/p/' || c_custkey, 'q:' || c_mktsegment FROM good WHERE c_custkey % 2 = 0
UNION ALL SELECT DISTINCT source, CASE WHEN (c_custkey // 100) % 5 = 4 THEN 'faulty' ELSE 'read' END, CASE WHEN (c_custkey // 100) % 5 = 4 THEN '0' ELSE '1' END, NULL FROM c""")
def ontology_documents(spark, sf_dir):
    """Customers as YAML documents of at most 100 entities, written one file a document and read by tasks; each has a value to repair and every fifth is broken off."""
    key = F.col("c_custkey").cast("string")
    to_nation = F.concat(F.lit("n:"), F.col("c_nationkey").cast("string"))
    relations = F.concat(F.lit("\n    relations:\n      - label: lives_in\n        to: "), to_nation, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n      - label: buys_for\n        to: q:"), "c_mktsegment")).otherwise(""))
    entity = F.concat(F.lit("\n  - id: p:"), key, F.lit("\n    name: "), "c_name", F.lit("\n    class: "), to_nation, relations)
    blocks = _table(spark, sf_dir, "customer").select(F.expr("c_custkey DIV 100").alias("block"), entity.alias("entity")).groupBy("block").agg(F.array_join(F.array_sort(F.collect_list("entity")), "").alias("entities"))
    head = F.lit("title: some customers\nprefixes:\n  p: http://a.b/p/\n  n: http://a.b/n:\nentities:")
    text = F.when(F.col("block") % 5 == 4, F.concat(head, F.lit(" ["), "entities")).otherwise(F.concat(head, "entities"))
    path = scratch_path(spark, "ontologies")
    page_sink.write_page_files(blocks.select(F.concat(F.lit("block-"), F.col("block").cast("string")).alias("slug"), text.alias("markdown"), "block"), path, ".yaml", "block")
    nodes, edges, _, documents = ontology_yaml.read_ontologies(spark, path)
    return (
        nodes.select("source", F.lit("name").alias("what"), F.col("iri").alias("a"), F.col("name").alias("b"))
        .unionByName(nodes.select("source", F.lit("class").alias("what"), F.col("iri").alias("a"), F.col("class_iri").alias("b")))
        .unionByName(edges.select("source", F.col("label").alias("what"), F.col("src_iri").alias("a"), F.col("dst_iri").alias("b")))
        .unionByName(documents.select("source", F.when(F.col("error").isNull(), "read").otherwise("faulty").alias("what"), F.col("repaired").cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    )


@query("""SELECT event_id, sha256('{"event_id":' || event_id || '}') AS id, 1 AS times FROM events""")
def sent_events(spark, sf_dir):
    """Errors are sent, then all events: the ledger holds each once, whichever run sent it."""
    events, path = _table(spark, sf_dir, "events"), scratch_path(spark, "ledger")
    for rows in (events.filter("event_type = 'error'"), events):
        ledger.send_once(rows, ["event_id"], lambda: lambda row, name: 200, path)
    written = spark.read.schema("id string").text(path).groupBy("id").agg(F.count("*").alias("times"))
    return events.select("event_id", ledger.message_id(["event_id"]).alias("id")).join(written, "id")


# --- search ----------------------------------------------------------------------------------------

_SEARCH_SQL = """WITH held AS (
  SELECT doc_id, len(w) AS size, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
), tf AS (
  SELECT doc_id, term, size, count(*) AS tf FROM held GROUP BY ALL
), df AS (
  SELECT term, count(*) AS held FROM tf GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark
), under AS (
  SELECT a.term AS src, b.term AS dst FROM df a JOIN df b ON length(a.term) >= 6 AND b.term = left(a.term, length(a.term) - 2)
), wide AS (
  SELECT item_id, term, max(weight) AS weight FROM (
    SELECT item_id, term, 4 AS weight FROM asked
    UNION ALL SELECT item_id, src, 2 FROM asked JOIN under ON dst = term
    UNION ALL SELECT item_id, v.src, 1 FROM asked JOIN under u ON u.dst = term JOIN under v ON v.dst = u.src
  ) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(weight * floor(100 * ln(1 + (n - held + 0.5) / (held + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) + 0.5))::BIGINT AS score
  FROM wide JOIN tf USING (term) JOIN df USING (term), (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM held) / count(*)::DOUBLE AS mean FROM documents) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER w AS rank, doc_id, score FROM scored WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10"""


@query(_SEARCH_SQL)
def concept_search(spark, sf_dir):
    """The ten best documents for each benchmark text. A word of six letters or more is_a the word without its last two letters, if there is one."""
    index = search.build_index(_table(spark, sf_dir, "documents"), "doc_id", "text")
    names = index.terms.select("term")
    under = names.filter(F.length("term") >= 6).select(F.col("term").alias("src"), F.expr("left(term, length(term) - 2)").alias("dst")).join(names.withColumnRenamed("term", "dst"), "dst", "left_semi")
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(search.words(F.col("text"))).alias("term"))
    return search.search(index, search.widened(asked, under)).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
