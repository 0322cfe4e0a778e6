"""MediaWiki text to Markdown, rule by rule. The order of the rules is part of the result: headings of levels
1 to 3 become list items through the later list rules, and so on. No rule is repaired here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.scalars import JS_LINE_START, JS_SPACE, inner_items, js_split, js_trim, replace_matches, slug

# fixed values: patterns and replacements in the order in which they apply
_S = f"[{JS_SPACE}]"
HEADINGS = [
    (rf"====={_S}*([^=]+){_S}*=====", "##### $1"),
    (rf"===={_S}*([^=]+){_S}*====", "#### $1"),
    (rf"==={_S}*([^=]+){_S}*===", "### $1"),
    (rf"=={_S}*([^=]+){_S}*==", "## $1"),
    (rf"={_S}*([^=]+){_S}*=", "# $1"),
    (rf"\[http(s)?://([^{JS_SPACE}\]]+){_S}+([^\]]+)\]", "[$3](http$1://$2)"),
]
PAGE_LINK = r"\[\[([^\]|]+)\]\]"
NAMED_LINK = r"\[\[([^\]|]+)\|([^\]]+)\]\]"
LISTS = [
    (rf"{JS_LINE_START}\*\*\*{_S}", "    - "),
    (rf"{JS_LINE_START}\*\*{_S}", "  - "),
    (rf"{JS_LINE_START}\*{_S}", "- "),
    (rf"{JS_LINE_START}###{_S}", "    1. "),
    (rf"{JS_LINE_START}##{_S}", "  1. "),
    (rf"{JS_LINE_START}#{_S}", "1. "),
]
TABLE = rf"(?s)\{{\|(.+?){JS_LINE_START}\|\}}"
MARKS = [
    (r"'''([^']+)'''", "**$1**"),
    (r"''([^']+)''", "*$1*"),
    (r"(?s)<code>(.*?)</code>", "`$1`"),
    (r"(?s)<pre>(.*?)</pre>", "```\n$1\n```"),
]


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _mark_first(pattern: str) -> str:
    """The same pattern with the start of its line looked for behind the first mark, so a text is only looked at where the mark stands."""
    rest = pattern.removeprefix(JS_LINE_START)
    mark = rest[: 1 + rest.startswith("\\")]
    return f"{mark}{JS_LINE_START[:-1]}{mark}){rest.removeprefix(mark)}"


_LISTS = [(_mark_first(pattern), by) for pattern, by in LISTS]


def _page_link(m: Column) -> Column:
    page = F.regexp_extract(m, PAGE_LINK, 1)
    return F.concat(F.lit("["), page, F.lit("](/wiki/"), slug(page), F.lit(")"))


def _named_link(m: Column) -> Column:
    page, label = F.regexp_extract(m, NAMED_LINK, 1), F.regexp_extract(m, NAMED_LINK, 2)
    return F.concat(F.lit("["), label, F.lit("](/wiki/"), slug(page), F.lit(")"))


def _table_line(line: Column) -> Column:
    cells = F.replace(F.substring(line, F.lit(2), F.length(line)), F.lit("!!"), F.lit(" | "))
    rule = F.repeat(F.lit("| --- "), F.size(js_split(line, "!!")))
    header = F.concat(F.lit("| "), cells, F.lit(" |\n"), rule, F.lit("|\n"))
    data = F.concat(F.replace(line, F.lit("||"), F.lit(" | ")), F.lit("\n"))
    return F.when(F.startswith(line, F.lit("!")), header).when(F.startswith(line, F.lit("|")), data).otherwise("")


def table_to_pipes(m: Column) -> Column:
    """A wiki table as a pipe table: the first and last of its non-blank lines go."""
    lines = F.filter(js_split(m, "\n"), lambda x: js_trim(x) != "")
    return F.array_join(F.transform(inner_items(lines), _table_line), "")


def markdown_body(text: Column) -> Column:
    text = _apply(text, HEADINGS)
    text = replace_matches(text, PAGE_LINK, _page_link)
    text = replace_matches(text, NAMED_LINK, _named_link)
    text = _apply(text, _LISTS)
    text = replace_matches(text, TABLE, table_to_pipes)
    return _apply(text, MARKS)


def front_matter(name: Column) -> Column:
    # fixed value: the block at the head of a page
    return F.concat(F.lit("---\nid: "), slug(name), F.lit("\ntitle: "), F.replace(name, F.lit("_"), F.lit(" ")), F.lit("\n---\n\n"))


def wiki_to_markdown(pages: DataFrame) -> DataFrame:
    """pages(name, raw) as docs(slug, title, markdown). A null text gives null Markdown: its page is passed over by the sinks."""
    steps = pages.select("name", F.col("raw").alias("body"))
    # one projection a group of rules keeps each expression small enough for code generation; texts without a group's marks skip it
    for marks, rewrite in (
        (["=", "[http"], lambda c: _apply(c, HEADINGS)),
        (["[["], lambda c: replace_matches(c, PAGE_LINK, _page_link)),
        (["[["], lambda c: replace_matches(c, NAMED_LINK, _named_link)),
        (["*", "#"], lambda c: _apply(c, _LISTS)),
        (["{|"], lambda c: replace_matches(c, TABLE, table_to_pipes)),
        (["''", "<code>", "<pre>"], lambda c: _apply(c, MARKS)),
    ):
        body = F.col("body")
        marked = reduce(Column.__or__, (body.contains(m) for m in marks))
        steps = steps.withColumn("body", F.when(marked, rewrite(body)).otherwise(body))
    return steps.select(slug(F.col("name")).alias("slug"), F.replace("name", F.lit("_"), F.lit(" ")).alias("title"), F.concat(front_matter(F.col("name")), "body").alias("markdown"))


def navigation_order(pages: DataFrame) -> DataFrame:
    """pages(category, position, slug, ...) by category and position; pages without a position come last, ties by slug."""
    return pages.orderBy("category", F.asc_nulls_last("position"), "slug")


def nav_config(slugs: DataFrame, name: str = "wikiSidebar") -> DataFrame:
    """One row `config`: a navigation tree in which `index` leads and all other slugs follow in order."""
    # fixed value: the text around the list of pages
    listed = slugs.filter(~F.col("slug").eqNullSafe(F.lit("index"))).agg(F.to_json(F.sort_array(F.collect_list("slug"))).alias("items"))
    return listed.select(F.concat(F.lit(f"module.exports = {{{name}: [{{type: 'category', label: 'Wiki', link: {{type: 'doc', id: 'index'}}, items: "), "items", F.lit("}]};\n")).alias("config"))
